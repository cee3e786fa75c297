"""Keyword-stuffed and link-list pages (problem 10).

A text is cut into units (lines, and sentences within lines; neighbouring units of fewer than four tokens are joined
up to twelve). Every unit becomes a sequence of classes: function words stand for themselves, other words for their
case and ending, and links, tags, numbers and marks for their kind. An interpolated 3-gram model over the classes is
trained on prose: first on the units built like sentences, then once more on the units of the texts that the first
model finds to be mostly prose, so that headings, requirement lists and time tables count as normal. Units that hold
a link or tag and units whose words keep coming back in their text are kept out of the second training unless the
first model finds them normal and free of links. A unit is abnormal if

* its perplexity is high and its content words keep coming back in the text, or
* its perplexity is out of all proportion, or
* its perplexity is lower than that of all but ``LOW`` of the sentences while its words keep coming back: one
  template repeated.

A page is flagged if abnormal units hold more than half of its characters, blanks aside.

Classes, 2-grams and 3-grams fall into hashed tables of fixed size, so nothing is dropped whatever the size of the
corpus, and what reaches the driver and the executors has a fixed bound (``BITS``). A text counts once for each of
its n-grams, so a page that repeats itself does not train its own phrases. Texts are tokenised once; the following
passes read two bytes a token from the checkpoint folder.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import cut, spread

BITS = (16, 20, 22)  # of the hashed tables of 1-, 2- and 3-grams
WEIGHTS = (0.62, 0.28, 0.09)  # of 3-, 2- and 1-grams; the rest is spread evenly over all classes
LOW = 0.001
STEP, BINS = 0.01, 4_096  # of the histogram of bits
PIECE = 2_000_000  # characters or tokens handled at once

# Function words of the texts' languages.
FUNCTION_WORDS = (
    "a ako ali bez bi bio do dok gdje i ili iz iza jer je još kada kako kao kod koja koje koji li na nad nakon ne nije niti "
    "o od ona oni po pod prema premda pri sa se smo su svi ta te to u uz vi za što iako "
    "aber als am an auch auf aus bei bis da das dem den der des die durch ein eine einem einen einer es für im in ist mit "
    "nach nicht noch nur ob obwohl oder seit sich sie sind über um und uns unser von vor weil wenn wie wir wird zu zum zur "
    "about after all and are as at be before but by for from has have if is it its not of on once or our out than that the "
    "their they this through under until was we were when where while which who will with without you your"
).split()

_TOKEN = re.compile(
    r"(?:https?://|www\.)\S{1,60000}|\w{1,60000}|[.!?]+\s|\n|</?[aA]\b[^<>]{0,2000}>|\]\([^)\s]{0,2000}\)"
    r"|</?[a-zA-Z][^<>]{0,2000}>|[#@][\w.-]{1,60000}|[^\w\s]"
)
# class numbers
START, END, LINE, STOP, ANCHOR, TAG, LINK, TARGET, MARKED, NUMBER, CAPITAL, CAPITALS, MAIL = range(13)
_MARK0, _WORD0 = 16, 128
_ENDING0 = _WORD0 + 256
_ENDINGS = 4_096
_FUNCTION = {w: _WORD0 + i for i, w in enumerate(FUNCTION_WORDS)}

_UNIT = np.dtype([("size", "<i4"), ("tokens", "<i4"), ("echo", "<f4"), ("sentence", "?"), ("link", "?")])


def token_class(token: str) -> int:
    c = token[0]
    if token.startswith(("http://", "https://", "www.")):
        return LINK
    if c.isdigit():
        return NUMBER
    if c.isalnum() or c == "_":
        low = token.lower()
        if low in _FUNCTION:
            return _FUNCTION[low]
        if token != low:
            return CAPITALS if len(token) > 1 and token == token.upper() else CAPITAL
        return _ENDING0 + zlib.crc32(low[-3:].encode()) % _ENDINGS
    if c == "\n":
        return LINE
    if token[-1].isspace():
        return STOP
    if c == "<" and len(token) > 1:
        return ANCHOR if token.lstrip("</")[:1] in "aA" and not token.lstrip("</")[1:2].isalnum() else TAG
    if len(token) > 1:
        return (MAIL if c == "@" and "." in token else MARKED) if c in "#@" else TARGET
    return _MARK0 + zlib.crc32(c.encode()) % (_WORD0 - _MARK0)


class Codes(dict):
    """Packed code of every token met so far: 16 bits class, 16 bits length, 30 bits content word, 1 bit line end."""

    def __missing__(self, token: str) -> int:
        k = token_class(token)
        content = zlib.crc32(token.lower().encode()) & 0x3FFFFFFF or 1 if k >= _ENDING0 or k in (CAPITAL, CAPITALS) else 0
        code = (int(token[-1] == "\n") << 62) | (content << 32) | (len(token.strip()) << 16) | k
        if len(self) < 500_000:
            self[token] = code
        return code


def _pieces(text: str) -> Iterator[str]:
    """A text in slices that end at a line end, else at a blank, where there is one."""
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind("\n", at, at + PIECE) + 1 or text.rfind(" ", at, at + PIECE) + 1 or at + PIECE
        yield text[at:end]
        at = end
    yield text[at:] + "\n"


class Encoded(NamedTuple):
    """Class sequences of some texts: tokens in order, units in order, the text number of each unit."""

    classes: np.ndarray
    units: np.ndarray  # of dtype _UNIT
    text: np.ndarray


def encode(texts: list[str], codes: Codes) -> Encoded:
    parts, counts = [], []
    for t in texts:
        n = 0
        for piece in _pieces(t):
            found = _TOKEN.findall(piece)
            parts.append(np.fromiter(map(codes.__getitem__, found), "int64", len(found)))
            n += len(found)
        counts.append(n)
    code = np.concatenate(parts) if parts else np.zeros(0, "int64")
    text = np.repeat(np.arange(len(texts)), counts)
    kind = (code & 0xFFFF).astype("uint16")
    ends = (code >> 62 == 1) | (kind == STOP)
    first = np.ones(len(code), bool)
    first[1:] = ends[:-1] | (text[1:] != text[:-1])
    unit = np.cumsum(first)
    keep = kind != LINE
    code, kind, text, unit = code[keep], kind[keep], text[keep], unit[keep]
    if not len(code):
        return Encoded(kind, np.zeros(0, _UNIT), text)
    first = np.ones(len(code), bool)
    first[1:] = unit[1:] != unit[:-1]
    at = np.flatnonzero(first)
    tokens = np.diff(np.append(at, len(code)))
    # neighbouring short units are joined
    short, owner = tokens < 4, text[at]
    run_first = np.ones(len(at), bool)
    run_first[1:] = ~(short[1:] & short[:-1] & (owner[1:] == owner[:-1]))
    run = np.cumsum(run_first) - 1
    part = (at - at[run_first][run]) // 12
    group = np.ones(len(at), bool)
    group[1:] = (run[1:] != run[:-1]) | (part[1:] != part[:-1])
    at = at[group]
    units = np.zeros(len(at), _UNIT)
    units["tokens"] = np.diff(np.append(at, len(code)))
    units["size"] = np.add.reduceat((code >> 16) & 0xFFFF, at)
    word = (kind >= _WORD0) | (kind == CAPITAL) | (kind == CAPITALS)
    words = np.add.reduceat(word.astype("int64"), at)
    last = at + units["tokens"] - 1
    opens = (kind[at] == CAPITAL) | (kind[at] == CAPITALS) | ((kind[at] >= _WORD0) & (kind[at] < _ENDING0))
    # a capital first, a stop last, six words at least, and few links and marks inside
    units["sentence"] = opens & (kind[last] == STOP) & (words >= 6) & (words >= 0.7 * units["tokens"])
    units["link"] = np.add.reduceat(((kind >= ANCHOR) & (kind <= MARKED)).astype("int64"), at) > 0
    # share of content words that the whole text uses three times or more
    content = (code >> 32) & 0x3FFFFFFF
    _, which, uses = np.unique((text << 30) | content, return_inverse=True, return_counts=True)
    again = np.add.reduceat(((uses[which] > 2) & (content > 0)).astype("int64"), at)
    units["echo"] = again / np.maximum(1, np.add.reduceat((content > 0).astype("int64"), at))
    return Encoded(kind, units, text[at])


class Grams(NamedTuple):
    """Table positions of the 1-, 2- and 3-gram and of the 2-gram before every token and unit end."""

    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    before: np.ndarray  # position of the class before, START at a unit's first token
    before_two: np.ndarray
    at: np.ndarray  # first position of each unit


def _hash(bits: int, *parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(parts[0]), "uint64")
        for p in parts:
            h = (h + p.astype("uint64") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype("int64")


def grams_of(e: Encoded) -> Grams:
    tokens = e.units["tokens"].astype("int64")
    n_units = len(tokens)
    at = np.cumsum(tokens + 1) - tokens - 1
    w = np.full(len(e.classes) + n_units, END, "int64")
    w[np.arange(len(e.classes)) + np.repeat(np.arange(n_units), tokens)] = e.classes
    v, u = np.zeros_like(w), np.zeros_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    v[at], u[at] = START, START
    u[at + 1] = START
    return Grams(w, _hash(BITS[1], v, w), _hash(BITS[2], u, v, w), v, _hash(BITS[1], u, v), at)


class ClassModel:
    """Interpolated 3-gram model over classes; counts are numbers of texts. Travels as its non-empty table entries."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], texts: int):
        self.tables, self.texts = tables, max(1, texts)
        self._dense: list[np.ndarray] | None = None

    def __getstate__(self):  # noqa: ANN204
        return self.__dict__ | {"_dense": None}

    def bits(self, e: Encoded) -> np.ndarray:
        """Bits per token of every unit."""
        if not len(e.units):
            return np.zeros(0)
        if self._dense is None:
            self._dense = [np.zeros(1 << b, "int32") for b in BITS]
            for dense, (where, n) in zip(self._dense, self.tables, strict=True):
                dense[where] = n
        one, two, three = self._dense
        g = grams_of(e)
        a, b, c = WEIGHTS
        p = c * one[g.one] / max(1, int(one.sum(dtype="int64"))) + (1.0 - a - b - c) / (1 << BITS[0])
        opening = g.before == START
        n = two[g.two]
        p += b * n / np.maximum(1, np.maximum(n, np.where(opening, self.texts, one[g.before])))
        n = three[g.three]
        p += a * n / np.maximum(1, np.maximum(n, np.where(opening, self.texts, two[g.before_two])))
        return np.add.reduceat(-np.log2(np.minimum(p, 1.0)), g.at) / (e.units["tokens"] + 1)


Pick = Callable[[Encoded], np.ndarray]  # units to train on


def _batches(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Encoded]]:
    """Stored texts in groups of bounded size."""
    for b in batches:
        group = b["classes"].map(len).cumsum() // (2 * PIECE)
        for _, part in b.groupby(group.to_numpy(), sort=False):
            units = [np.frombuffer(x, _UNIT) for x in part["units"]]
            yield part, Encoded(
                np.frombuffer(b"".join(part["classes"]), "<u2"),
                np.concatenate(units),
                np.repeat(np.arange(len(units)), [len(x) for x in units]),
            )


def _count(encoded: DataFrame, pick: Pick) -> ClassModel:
    """The model of the picked units; every task hands on the non-empty entries of its tables."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = [np.zeros(1 << b, "int64") for b in BITS]
        texts = 0
        for _, e in _batches(batches):
            chosen = pick(e)
            texts += len(np.unique(e.text[chosen]))
            if not chosen.any():
                continue
            size = e.units["tokens"].astype("int64") + 1
            g, sel = grams_of(e), np.repeat(chosen, size)
            owner = np.repeat(e.text, size)[sel].astype("int64")
            for table, bits, where in zip(tables, BITS, (g.one, g.two, g.three), strict=True):
                keys = np.sort((owner << bits) | where[sel])
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                np.add.at(table, keys[new] & ((1 << bits) - 1), 1)
        yield pd.DataFrame({"n_words": [0], "at": [0], "n": [texts]})
        for k, table in enumerate(tables, 1):
            hit = np.flatnonzero(table)
            yield pd.DataFrame({"n_words": k, "at": hit, "n": table[hit]})

    parts = encoded.select("classes", "units").mapInPandas(run, "n_words int, at int, n bigint")
    total = parts.groupBy("n_words", "at").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for k in (1, 2, 3):
        rows = total[total["n_words"] == k]
        tables.append((rows["at"].to_numpy("int32"), np.minimum(rows["n"].to_numpy("int64"), 2**31 - 1).astype("int32")))
    return ClassModel(tables, int(total.loc[total["n_words"] == 0, "n"].sum()))


def _spread_of_sentences(encoded: DataFrame, model: ClassModel) -> np.ndarray:
    """Histogram of the bits of all sentences."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = np.zeros(BINS, "int64")
        for _, e in _batches(batches):
            b = model.bits(e)[e.units["sentence"]]
            h += np.bincount(np.minimum((b / STEP).astype("int64"), BINS - 1), minlength=BINS)
        hit = np.flatnonzero(h)
        yield pd.DataFrame({"bin": hit, "n": h[hit]})

    rows = encoded.select("classes", "units").mapInPandas(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BINS, "int64")
    out[rows["bin"]] = rows["n"]
    return out


def _mean(h: np.ndarray) -> float:
    return float((h * (np.arange(BINS) + 0.5)).sum() / max(1, h.sum()) * STEP)


def keyword_pages(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", share: float = 0.5, high: float = 0.9, beyond: float = 5.5,
    margin: float = 5.0,
) -> DataFrame:
    """(<id>, abnormal_share) of the texts that are mostly keywords, tags or links.

    A unit is abnormal if its bits per token are ``high`` above the mean of all sentences and a third of its content
    words are repeated in the text, or ``beyond`` above the mean, or, again with repeated words, below the quantile
    ``LOW`` of the sentences. ``margin`` bits above the mean of the first model is abnormal in the second training.
    NULL and blank texts are never flagged; texts are read whole; repeated rows each give their own row; a table
    without any sentence flags nothing; extra columns are ignored. Every pass is a map with partial counts; texts are
    only moved if the scan has fewer partitions than there are cores (``spread``).
    """
    source = spread(docs.where(F.col(text).isNotNull()).select(F.col(id_col), F.col(text).alias("text")))
    key = dict(source.dtypes)[id_col]

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes()
        for b in batches:
            group = b["text"].map(len).cumsum() // PIECE
            for _, part in b.groupby(group.to_numpy(), sort=False):
                e = encode(list(part["text"]), codes)
                n = len(part)
                unit_ends = np.searchsorted(e.text, np.arange(n + 1))
                token_ends = np.append(0, np.cumsum(e.units["tokens"]))[unit_ends]
                classes = e.classes.astype("<u2")
                yield pd.DataFrame({
                    id_col: part[id_col],
                    "classes": [classes[a:z].tobytes() for a, z in zip(token_ends, token_ends[1:], strict=False)],
                    "units": [e.units[a:z].tobytes() for a, z in zip(unit_ends, unit_ends[1:], strict=False)],
                })

    encoded = cut(source.mapInPandas(read, f"`{id_col}` {key}, classes binary, units binary"))
    first = _count(encoded, lambda e: e.units["sentence"])
    far = _mean(_spread_of_sentences(encoded, first)) + margin

    def mostly_prose(e: Encoded) -> np.ndarray:
        normal = first.bits(e) <= far
        n = int(e.text[-1]) + 1 if len(e.text) else 0
        size = e.units["size"]
        prose = 2 * np.bincount(e.text, size * normal, n) > np.bincount(e.text, size, n)
        return prose[e.text] & ~e.units["link"] & (normal | (e.units["echo"] < 1 / 3))

    model = _count(encoded, mostly_prose)
    h = _spread_of_sentences(encoded, model)
    schema = f"`{id_col}` {key}, abnormal_share double"
    if not h.sum():
        return encoded.select(F.col(id_col), F.lit(0.0).alias("abnormal_share")).where(F.lit(False))
    mean = _mean(h)
    lowest = STEP * float(np.searchsorted(np.cumsum(h), LOW * h.sum()))

    def judge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, e in _batches(batches):
            b = model.bits(e)
            again = e.units["echo"] > 1 / 3
            odd = (b > mean + beyond) | (again & ((b > mean + high) | (b < lowest)))
            n, size = len(part), e.units["size"]
            out = np.bincount(e.text, size * odd, n) / np.maximum(1, np.bincount(e.text, size, n))
            hit = out > share
            yield pd.DataFrame({id_col: part[id_col][hit], "abnormal_share": out[hit]})

    return encoded.mapInPandas(judge, schema)
