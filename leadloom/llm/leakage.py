"""Evaluation texts leaking into training text (problem 9).

Winnowing: the words of a text, folded so that case, accents, punctuation, markup and line breaks do not count,
form hashed k-grams; of every ``WINDOW`` consecutive k-grams of a document the one with the smallest hash is kept as
a fingerprint, so every shared run of ``K + WINDOW - 1`` words has a common one. The fingerprints of the corpus are
joined with those of the evaluation items (all their k-grams, as items are few) in Spark. A document and an item
that share fingerprints in ``EVIDENCE`` of the item's words are extended: the item is aligned with the words around
the hits (local alignment with a charge for words between, left out or replaced), and leaks if at least ``share`` of
its words are matched in order, a quarter of its distinctive words (found in three items at most) among them, so that
phrases common to many items are no leak. Half an item whose words are changed once in six words at most always
reaches the evidence.

The corpus is read once. A bitmap of the item fingerprints, of fixed maximal size (``FILTER_BITS``), drops the others
before anything leaves the scan; it only spares work, the join decides. Of a document only the words around its hits
go on. Neither items nor documents nor fingerprints meet in the driver.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.scripts import LOOKALIKES, plain
from leadloom.llm.textnorm import bare, merge_digraphs
from leadloom.session import cut, spread

K, WINDOW = 3, 3
EVIDENCE = 0.065  # of the item's words; half an item in runs of five words has 0.5 / 6
FILTER_BITS = 27

_TAG = re.compile(r"<[^<>]{1,300}>")
_HYPHENATED = re.compile(r"[-‐­](?<=\w.)\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\w+")
_RARE_LETTER = re.compile("[^\x00-\xac\xae-ɏ]")


class _FoldTable(dict):
    """Character by character form of ``bare``, for whole documents."""

    def __missing__(self, code: int) -> str:
        c = LOOKALIKES.get(chr(code), chr(code))
        out = "\n" if c == "\n" else "" if unicodedata.combining(c) else bare(plain(c))
        self[code] = out
        return out


_FOLD = _FoldTable()


def _clean(text: str) -> str:
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", html.unescape(text))
    return _HYPHENATED.sub("", text)


def _folded(text: str) -> list[str]:
    return _WORD.findall(merge_digraphs(text.translate(_FOLD)))


def words(text: str) -> list[str]:
    """Folded words of a text, without markup; words hyphenated at a line end are joined."""
    return _folded(_clean(text))


class WordIds(dict):
    """32-bit hash of the folded form of every token met so far; -1 for a token that is not one word."""

    def __missing__(self, token: str) -> int:
        folded = _folded(token)
        h = zlib.crc32(folded[0].encode()) if len(folded) == 1 else -1
        if len(self) < 1_000_000:
            self[token] = h
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of ``words(text)``. In common letters tokens are folded one by one, which is the same and faster."""
        text = _clean(text)
        if not _RARE_LETTER.search(text):
            found = _TOKEN.findall(text)
            out = np.fromiter(map(self.__getitem__, found), "int64", len(found))
            if not len(out) or out.min() >= 0:
                return out.astype("uint32")
        return np.array([zlib.crc32(w.encode()) for w in _folded(text)], dtype="uint32")


def kgram_hashes(ids: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hash of every run of ``k`` words; texts shorter than that have none."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype="uint64")
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype="uint64")
        for i in range(k):
            h = (h ^ ids[i : i + n].astype("uint64")) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash in every window (the rightmost of equals); all text ends are covered."""
    n = len(hashes)
    if n <= window:
        return np.array([int(n - 1 - np.argmin(hashes[::-1]))]) if n else np.zeros(0, dtype="int64")
    m = n - window + 1
    at, best = np.arange(m), hashes[:m]
    for i in range(1, window):
        lower = hashes[i : i + m] <= best
        best = np.where(lower, hashes[i : i + m], best)
        at = np.where(lower, np.arange(i, i + m), at)
    return np.unique(at) if window > 64 else at[np.append(True, at[1:] != at[:-1])]


def word_places(item: np.ndarray) -> dict[int, int]:
    """For each word a number whose bits are its places in the item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    return where


def common_length(where: dict[int, int], size: int, text: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel), an upper bound of any alignment's matches."""
    full = v = (1 << size) - 1
    for m in map(where.get, text.tolist()):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def aligned_words(item: np.ndarray, text: np.ndarray, gap: float = 0.4) -> list[int]:
    """Positions of the words of ``item`` matched in order by the best local alignment with ``text``.

    Only every so-many-th row of scores is kept and the rows between are computed again on the way back, so the
    memory grows with the text times the root of the item's length.
    """
    n, m = len(item), len(text)
    count = np.arange(m + 1) * gap
    step = max(1, math.isqrt(n))

    def rows(start: np.ndarray, i0: int, i1: int) -> np.ndarray:
        """Scores of rows i0..i1, of which ``start`` is the first."""
        out = np.empty((i1 - i0 + 1, m + 1))
        out[0] = start
        for r in range(1, i1 - i0 + 1):
            hit = np.where(text == item[i0 + r - 1], 1.0, -0.5)
            best = np.maximum(out[r - 1, :-1] + hit, out[r - 1, 1:] - gap)
            row = np.maximum(np.concatenate(([0.0], best)), 0.0)
            # words between: running maximum of score + gap * position
            out[r] = np.maximum.accumulate(row + count) - count
        return out

    kept = [np.zeros(m + 1)]
    top, i, j = 0.0, 0, 0
    for i0 in range(0, n, step):
        block = rows(kept[-1], i0, min(n, i0 + step))
        k = int(np.argmax(block))
        if block.flat[k] > top:
            top, i, j = float(block.flat[k]), i0 + k // (m + 1), k % (m + 1)
        kept.append(block[-1])
    matched: list[int] = []
    base, block = -1, np.zeros((0, 0))
    while i > 0 and j > 0:
        if base < 0 or i <= base:
            base = (i - 1) // step * step
            block = rows(kept[base // step], base, min(n, base + step))
        s, above = block[i - base, j], block[i - base - 1]
        if s <= 1e-9:
            break
        if item[i - 1] == text[j - 1] and abs(s - (above[j - 1] + 1.0)) < 1e-9:
            i, j = i - 1, j - 1
            matched.append(int(i))
        elif abs(s - (block[i - base, j - 1] - gap)) < 1e-9:
            j -= 1
        elif abs(s - (above[j] - gap)) < 1e-9:
            i -= 1
        else:
            i, j = i - 1, j - 1
    return matched


class Item:
    """An evaluation item ready to be compared."""

    def __init__(self, raw: bytes, rare: np.ndarray | None):
        self.words = np.frombuffer(raw, "<u4")
        self.rare = np.isin(self.words, [] if rare is None else rare)
        self.where = word_places(self.words)
        grams = kgram_hashes(self.words)
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]


def matched_words(x: Item, text: np.ndarray, share: float) -> int:
    """Words of an item that the text carries in order; 0 if it does not leak."""
    item, rare, order = x.words, x.rare, x.order
    size, slack = len(item), len(item) // 2 + 8
    need, rare_need = share * size, 0.25 * rare.sum()
    if common_length(x.where, size, text) < need:
        return 0
    h = kgram_hashes(text)
    lo, hi = np.searchsorted(x.grams, h, "left"), np.searchsorted(x.grams, h, "right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return 0
    # where the item would begin, from its last and first place of the k-gram
    early, late = found - order[hi[found] - 1], found - order[lo[found]]
    by = np.argsort(early)
    early, late = early[by], np.maximum.accumulate(late[by])
    best = 0
    # hits that lie together form one stretch of text
    breaks = np.flatnonzero(early[1:] - late[:-1] > slack) + 1
    for first, last in zip(np.append(0, breaks), np.append(breaks, len(early)) - 1, strict=True):
        a, b = max(0, int(early[first]) - slack), min(len(text), int(late[last]) + size + slack)
        # an alignment spans at most 3.5 item lengths (words between cost 0.4 each), so overlapping pieces are exact
        for s in range(a, max(a + 1, b - 4 * size), 8 * size):
            stretch = text[s : min(b, s + 12 * size)]
            if common_length(x.where, size, stretch) < max(need, best) or np.isin(item[rare], stretch).sum() < rare_need:
                continue
            matched = aligned_words(item, stretch)
            if rare[matched].sum() >= rare_need:
                best = max(best, len(matched))
    return best if best >= need else 0


def _item_tables(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(ikey, <item_id>, words, rare) and (hash, ikey, n_words, first, last) of all items of ``K`` words or more;
    first and last are the places of a k-gram in its item."""

    def read(texts: pd.Series) -> pd.Series:
        ids = WordIds()
        return pd.Series([ids.of(t).astype("<u4").tobytes() for t in texts])

    stored = cut(
        items.where(F.col(text).isNotNull())
        .select(F.col(item_id), F.pandas_udf(read, "binary")(F.col(text)).alias("words"))
        .where(F.length("words") >= 4 * K)
        .withColumn("ikey", F.monotonically_increasing_id())
    )

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, raw in zip(b["ikey"], b["words"], strict=True):
                yield pd.DataFrame({"ikey": key, "word": np.unique(np.frombuffer(raw, "<u4")).astype("int64")})

    at = stored.select("ikey", "words").mapInPandas(split, "ikey long, word long")
    common = at.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("word")
    distinctive = at.join(common, "word", "left_anti").groupBy("ikey").agg(F.collect_list("word").alias("rare"))

    def grams(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, raw in zip(b["ikey"], b["words"], strict=True):
                h = kgram_hashes(np.frombuffer(raw, "<u4")).astype("int64")
                yield pd.DataFrame({"hash": h, "ikey": key, "n_words": len(raw) // 4, "place": np.arange(len(h))})

    prints = (
        stored.select("ikey", "words").mapInPandas(grams, "hash long, ikey long, n_words int, place int")
        .groupBy("hash", "ikey", "n_words").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    )
    return cut(stored.join(distinctive, "ikey", "left")), cut(prints)


def _bitmap(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of the leading bits of all item fingerprints; at most 2 ** ``FILTER_BITS`` bits."""
    bits = min(FILTER_BITS, max(10, math.ceil(math.log2(64 * prints.count() + 1))))
    rows = (
        prints.select(F.shiftrightunsigned("hash", 64 - bits).alias("slot"))
        .select(F.shiftright("slot", 3).cast("int").alias("at"), F.pow(F.lit(2), F.pmod("slot", F.lit(8))).cast("int").alias("bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    )
    out = np.zeros(1 << (bits - 3), dtype="uint8")
    out[rows["at"].to_numpy("int64")] = rows["bit"].to_numpy("uint8")
    return bits, out


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    share: float = 0.5,
) -> DataFrame:
    """(<doc_id>, <item_id>, matched_words, item_words) of every document that carries an item.

    Items with fewer than ``K`` words have no fingerprint and are never reported; NULL and blank texts on either
    side match nothing; documents are read whole; repeated documents and items each give their own rows; extra
    columns are ignored; without items or documents the result is empty.
    """
    key = dict(docs.dtypes)[doc_id]
    stored, prints = _item_tables(items, item_id, text)
    bits, bitmap = _bitmap(prints)
    reach = prints.agg(F.max("n_words")).first()[0] or 0
    margin = 2 * reach + 8
    source = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")))
    source = source.withColumn("row", F.monotonically_increasing_id())
    columns = {"doc": key, "row": "long", "around": "binary", "hits": "array<struct<hash:long,first:int,last:int,n:int>>"}

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        shift = np.uint64(64 - bits)
        for b in batches:
            out = []
            for d, row, t in zip(b["doc"], b["row"], b["text"], strict=True):
                x = ids.of(t)
                h = kgram_hashes(x)
                at = winnow(h)
                slot = h[at] >> shift
                at = at[(bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype("uint8")) & 1 == 1]
                if not len(at):
                    continue
                # hits further apart cannot belong to one item
                for part in np.split(at, np.flatnonzero(np.diff(at) > 2 * margin) + 1):
                    base = max(0, int(part[0]) - margin)
                    seen: dict[int, list[int]] = {}
                    for k, p in zip(h[part].astype("int64").tolist(), (part - base).tolist(), strict=True):
                        s = seen.setdefault(k, [p, p, 0])
                        s[1], s[2] = p, s[2] + 1
                    out.append((d, row, x[base : int(part[-1]) + margin].astype("<u4").tobytes(), [(k, *s) for k, s in seen.items()]))
            yield pd.DataFrame(out, columns=list(columns))

    marked = cut(
        source.mapInPandas(scan, ", ".join(f"{c} {t}" for c, t in columns.items())).withColumn("part", F.monotonically_increasing_id())
    )
    hits = marked.select("part", F.inline("hits").alias("hash", "p", "q", "n"))
    evidence = (
        hits.join(prints, "hash")
        .groupBy("part", "ikey")
        .agg(F.sum("n").alias("n"), F.first("n_words").alias("n_words"),
             F.min(F.col("p") - F.col("last")).alias("lo"), F.max(F.col("q") - F.col("first")).alias("hi"))
        .where(F.col("n") >= EVIDENCE * F.col("n_words"))
    )
    slack = F.expr("n_words div 2") + 8
    begin = F.greatest(F.lit(0), F.col("lo") - slack)
    length = F.col("hi") + F.col("n_words") + slack - begin
    pairs = (
        evidence.join(marked.select("part", "row", "doc", "around"), "part")
        .withColumn("stretch", F.substring(F.col("around"), (4 * begin + 1).cast("int"), (4 * length).cast("int")))
        .join(stored, "ikey")
        .select("doc", "row", "ikey", F.col(item_id), "stretch", "words", "rare", "n_words")
    )

    def extend(stretch: pd.Series, item: pd.Series, rare: pd.Series) -> pd.Series:
        ready: dict[bytes, Item] = {}
        out = []
        for s, i, r in zip(stretch, item, rare, strict=True):
            if i not in ready:
                ready[i] = Item(i, r)
            out.append(matched_words(ready[i], np.frombuffer(s, "<u4"), share))
        return pd.Series(out, dtype="int32")

    matched = F.pandas_udf(extend, "int")("stretch", "words", "rare")
    # an item found in several parts of a document is one leak
    return (
        pairs.select("doc", "row", "ikey", item_id, "n_words", matched.alias("m"))
        .where("m > 0")
        .groupBy("row", "ikey")
        .agg(F.first("doc").alias(doc_id), F.first(item_id).alias(item_id), F.max("m").alias("matched_words"), F.first("n_words").alias("item_words"))
        .select(doc_id, item_id, "matched_words", "item_words")
    )
