"""Same postal address written differently (problem 1).

1. Every address is read into street, house number (with its letter, or none) and town. Floor and yard remarks,
   country names and post codes are set aside; a missing or abbreviated town is completed from the record's
   own city or location.
2. The distinct readings are weighted vectors of character 3-grams (inverse frequency over all readings). An
   inverted index is built from each vector's prefix, its rarest grams up to the point where the rest cannot
   reach the cosine threshold any more; postings are keyed by house number, town and gram. A reading is looked up
   under its own town and under the towns that are one typing error away, which share a text with one letter left out.
3. Pairs that meet in a posting are verified: cosine, equal house number, and street and town spellings that
   differ by typing errors only. Two street spellings that are both widespread (found in a share of
   ``established`` of all towns, in three at least, and the lesser in a quarter of the other's) are names of
   different streets.
4. Each reading follows its best-established verified neighbour (pointer jumping, checkpointed every round, until
   nothing changes); readings with the same representative are one place.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.textnorm import fold, osa_within
from leadloom.session import cut, shuffled

GRAM_BUCKETS = 1 << 16  # grams are hashed, so the weight table has a fixed size

# Written abbreviations (folded) of street words, town words and remarks in the texts' languages.
STREET_WORDS = {
    "ul": "", "u": "", "ulica": "", "ob": "obala", "pril": "prilaz", "c": "cesta",
    "str": "strasse", "pl": "platz", "g": "gasse", "all": "allee", "gr": "grosse", "kl": "kleine",
}
STREET_ENDINGS = (
    ("str.", "strasse"), ("str", "strasse"), ("stra", "strasse"), ("pl.", "platz"), ("pl", "platz"),
    ("all.", "allee"), ("g.", "gasse"),
)
TOWN_WORDS = {"v": "veliki", "m": "mali", "d": "donji", "g": "gornji"}
TOWN_PHRASES = (("n/m", "na moru"), ("p/g", "pod gorom"), ("a. d.", "an der"), ("a.d.", "an der"), ("o. d.", "ob der"),
                ("i. g.", "im grund"), ("a. f.", "am forst"))
COUNTRIES = {"hrvatska", "croatia", "deutschland", "germany", "hr", "de", "republika hrvatska"}
REMARK = re.compile(r"\((?:[^()]*\d[^()]*|prizemlje|dvoriste|kat|hinterhaus|vorderhaus|hof|eg|og|dg|ug)\)")

_POSTCODE = re.compile(r"^(?:[a-z]{1,3}\s?-\s?)?(\d{5})\s+(?=\D)")
_NUMBER = re.compile(
    r"(?:\b(?:br|nr|kbr|kucni broj|broj|hausnr|no)\b\.?\s*)?(?<![\w])(\d{1,4})\s*[-/]?\s*([a-z])?(?![a-z0-9])"
)
_NO_NUMBER = re.compile(r"\bb\.?\s?b\b\.?|\bbez broja\b|\bo\.\s?nr\b\.?|\bohne (?:hausnr|hausnummer|nr)\b\.?|\bs/n\b")
_SEP = re.compile(r"[,;\n|]")
_SPACE = re.compile(r"\s+")
_NONWORD = re.compile(r"[^a-z0-9]+")


def town_of(text: str | None) -> str:
    """Folded town of a city or location field, without post code and country. Short fields are remembered."""
    return _town_cached(text) if text is not None and len(text) <= 100 else _town_of(text)


def _town_of(text: str | None) -> str:
    if not text or not text.strip():
        return ""
    for part in _SEP.split(_SPACE.sub(" ", fold(text)).strip()):
        part = _POSTCODE.sub("", part.strip())
        part = re.sub(r"^\d{5}$", "", part)
        if part and part not in COUNTRIES:
            return _town(part)
    return ""


_town_cached = lru_cache(maxsize=65_536)(_town_of)


def _town(text: str) -> str:
    text = f" {text} "
    for short, full in TOWN_PHRASES:
        text = text.replace(f" {short} ", f" {full} ")
    words = _NONWORD.sub(" ", text).split()
    return " ".join(words[:1] + [TOWN_WORDS.get(w, w) for w in words[1:]])


def _compatible(town: str, context: str) -> bool:
    """The written town is the context town, word by word in full or abbreviated."""
    a, b = town.split(), context.split()
    return bool(a) and len(a) == len(b) and all(y.startswith(x) for x, y in zip(a, b, strict=True))


def _expand(raw: str) -> str:
    """Full form of a compound whose street word is abbreviated, also if the abbreviation holds a typing error."""
    for ending, full in STREET_ENDINGS:
        if len(raw) > len(ending) + 2 and raw.endswith(ending):
            return raw[: -len(ending)] + full
    if raw.endswith(".") and len(raw) > 6:
        stem = raw[:-1]
        for short, full in (("str", "strasse"), ("pl", "platz"), ("all", "allee"), ("g", "gasse")):
            for n in (len(short), len(short) + 1, len(short) - 1):
                if n >= 2 and osa_within(stem[-n:], short, 1) <= 1:
                    return stem[:-n] + full
    return raw


def _street(text: str) -> str:
    words = []
    for raw in _SPACE.sub(" ", text).strip(" -/").split(" "):
        word = _expand(raw)
        for w in _NONWORD.sub(" ", word).split():
            words.append(STREET_WORDS.get(w, w))
    return "".join(words)


def parse_address(address: str | None, context: str | None) -> tuple[str, str, str] | None:
    """(street, house, town) of an address, NULL for one without a street. Any length, never fails."""
    if not address or not address.strip():
        return None
    ctx = town_of(context)
    text = REMARK.sub(" ", fold(address))
    parts = [p for p in (_SPACE.sub(" ", x).strip() for x in _SEP.split(text)) if p and p not in COUNTRIES]
    street, house, town, spare = "", "", "", []
    found = False
    for part in parts:
        if m := _POSTCODE.match(part):
            town = town or part[m.end() :]
            continue
        m = None if found else (_NO_NUMBER.search(part) or _NUMBER.search(part))
        if m is None:
            spare.append(part)
            continue
        found = True
        groups = m.groups() if m.re is _NUMBER else (None, None)
        house = f"{int(groups[0])}{groups[1] or ''}" if groups[0] else ""
        before, after = part[: m.start()].strip(), part[m.end() :].strip()
        if before:
            street = before
            if after:
                spare.append(after)
        else:
            street = after
    if not found and spare:  # no number at all: the part that is not the town names the street
        rest = [p for p in spare if not _compatible(_town(p), ctx)]
        if not rest:
            return None
        street = rest[0]
        spare.remove(street)
    for p in spare:
        if not town or _compatible(_town(p), ctx):
            town = p
    street = _street(street)
    town = _town(town)
    if not street:
        return None
    if not town or _compatible(town, ctx):
        town = ctx or town
    return street, house, town


def _grams(street: str, town: str) -> list[int]:
    text = f"^{street}|{town}$"
    return [zlib.crc32(text[i : i + 3].encode()) % GRAM_BUCKETS for i in range(max(1, len(text) - 2))]


def _weights(readings: DataFrame) -> dict[int, float]:
    """Inverse frequency of every gram bucket over all readings; at most ``GRAM_BUCKETS`` entries."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(GRAM_BUCKETS, dtype="int64")
        for b in batches:
            for s, t in zip(b["street"], b["town"], strict=True):
                acc[list(set(_grams(s, t)))] += 1
        hit = np.nonzero(acc)[0]
        yield pd.DataFrame({"gram": hit.astype("int32"), "n": acc[hit]})

    total = readings.count()
    counts = readings.select("street", "town").mapInPandas(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: math.log(1.0 + total / r["n"]) for r in counts.toLocalIterator()}


class GramVectors:
    """Unit vectors of 3-grams with the prefix that a cosine of ``threshold`` needs."""

    def __init__(self, weights: dict[int, float], threshold: float):
        self.weights, self.threshold = weights, threshold

    def vector(self, street: str, town: str) -> dict[int, float]:
        vec: dict[int, float] = {}
        for g in _grams(street, town):
            vec[g] = vec.get(g, 0.0) + self.weights.get(g, 1.0)
        norm = math.sqrt(sum(w * w for w in vec.values()))
        return {g: w / norm for g, w in vec.items()}

    def prefix(self, street: str, town: str) -> list[int]:
        """Rarest grams first, until the norm of the rest falls below the threshold."""
        vec = self.vector(street, town)
        order = sorted(vec, key=lambda g: (-self.weights.get(g, 1.0), g))
        rest, out = 1.0, []
        for g in order:
            if math.sqrt(max(rest, 0.0)) < self.threshold:
                break
            out.append(g)
            rest -= vec[g] * vec[g]
        return out

    def cosine(self, a: tuple[str, str], b: tuple[str, str]) -> float:
        x, y = self.vector(*a), self.vector(*b)
        return sum(w * y.get(g, 0.0) for g, w in x.items())


def same_spelling(a: str, b: str, per: int = 6) -> bool:
    """Only typing errors apart: one up to ``per`` letters, two beyond; the empty text equals only itself."""
    if a == b:
        return True
    shorter = min(len(a), len(b))
    return shorter >= 4 and osa_within(a, b, 1 if shorter < per else 2) <= (1 if shorter < per else 2)


def resolve_addresses(
    records: DataFrame, id_col: str, address: str, context: str, threshold: float = 0.4, established: float = 0.02
) -> DataFrame:
    """(<id>, <address>, street, house, town, place): ``place`` is equal for addresses that mean one place.

    NULL or blank addresses and ones without a street give no row. A NULL context leaves the town as written.
    Equal records are resolved once and keep their own rows; extra columns are ignored; an empty table gives
    an empty result. Records of one place, however many, never meet in one task here: only distinct readings
    are indexed and compared.
    """

    def read(addresses: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        rows = [parse_address(a, c) or (None, None, None) for a, c in zip(addresses, contexts, strict=True)]
        return pd.DataFrame(rows, columns=["street", "house", "town"])

    parse = F.pandas_udf(read, "street string, house string, town string")
    parsed = cut(
        records.where(F.col(address).isNotNull())
        .select(F.col(id_col), F.col(address), parse(F.col(address), F.col(context)).alias("r"))
        .where(F.col("r.street").isNotNull())
        .select(id_col, address, "r.street", "r.house", "r.town")
    )
    by_street = parsed.select("street", "town").distinct().groupBy("street").agg(F.count(F.lit(1)).alias("n_towns"))
    readings = cut(
        parsed.groupBy("street", "house", "town")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(shuffled(by_street), "street")
        .withColumn("kid", F.xxhash64("street", "house", "town"))
    )
    widespread = max(3.0, established * readings.select("town").distinct().count())
    vectors = GramVectors(_weights(readings), threshold)

    def prefixes(streets: pd.Series, towns: pd.Series) -> pd.Series:
        return pd.Series([vectors.prefix(s, t) for s, t in zip(streets, towns, strict=True)])

    grams = readings.select(
        "kid", "house", "town", F.explode(F.pandas_udf(prefixes, "array<int>")("street", "town")).alias("gram")
    )
    near = near_towns(readings.select("town").distinct())
    # one pair of towns in one direction; pairs of one town in the order of their keys
    own = grams.select("kid", F.xxhash64("house", "town", "gram").alias("key"))
    other = (
        grams.join(shuffled(near.select(F.col("a").alias("town"), F.col("b").alias("at"))), "town")
        .select(F.col("kid").alias("kid_b"), F.xxhash64("house", "at", "gram").alias("key"))
    )
    postings = cut(own)
    left = postings.select(F.col("kid").alias("kid_a"), "key")
    met = (
        left.join(shuffled(postings.select(F.col("kid").alias("kid_b"), "key")), "key").where("kid_a < kid_b")
        .unionByName(left.join(shuffled(other), "key")).select("kid_a", "kid_b").distinct()
    )
    side = lambda s: readings.select(*[F.col(c).alias(c + s) for c in ("kid", "street", "town", "n_towns", "n")])
    spelled = lambda s: F.levenshtein("street_a", "street_b", s)
    # a swap of neighbours is one typing error and two plain edits
    likely = met.join(shuffled(side("_a")), "kid_a").join(shuffled(side("_b")), "kid_b").where(spelled(4) >= 0)

    def verify(sa: pd.Series, ta: pd.Series, sb: pd.Series, tb: pd.Series) -> pd.Series:
        out = []
        for a, t, b, u in zip(sa, ta, sb, tb, strict=True):
            ok = t == u or same_town(t, u)
            out.append(ok and same_spelling(a, b) and vectors.cosine((a, t), (b, u)) >= threshold)
        return pd.Series(out, dtype="bool")

    different_streets = (F.col("street_a") != F.col("street_b")) & (
        F.least("n_towns_a", "n_towns_b") >= F.greatest(F.lit(widespread), 0.25 * F.greatest("n_towns_a", "n_towns_b"))
    )
    checked = likely.where(~different_streets).where(F.pandas_udf(verify, "boolean")("street_a", "town_a", "street_b", "town_b"))
    better = lambda x: F.struct(F.col(f"n_towns_{x}").alias("t"), F.col(f"n_{x}").alias("n"), F.col(f"kid_{x}").alias("k"))
    ranked = checked.select(better("a").alias("x"), better("b").alias("y"))
    parent = cut(
        ranked.select(F.least("x", "y")["k"].alias("kid"), F.greatest("x", "y").alias("up"))
        .groupBy("kid").agg(F.max("up")["k"].alias("up"))
    )
    # parents strictly improve, so chains end; each round halves their length
    while True:
        hop = parent.select(F.col("kid").alias("up"), F.col("up").alias("up2"))
        step = cut(parent.join(shuffled(hop), "up", "left").select("kid", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
        parent = step.select("kid", "up")
        if not step.where("moved").limit(1).count():
            break
    place = readings.select("street", "house", "town", "kid").join(shuffled(parent), "kid", "left").select(
        "street", "house", "town", F.coalesce("up", "kid").alias("place")
    )
    return parsed.join(shuffled(place), ["street", "house", "town"]).select(id_col, address, "street", "house", "town", "place")


def same_town(a: str, b: str) -> bool:
    """Towns of eight letters and more that are one typing error apart."""
    return len(a) >= 8 and osa_within(a, b, 1) <= 1


def near_towns(towns: DataFrame) -> DataFrame:
    """(a, b) of different towns that are one typing error apart, each pair once; they share a text with one letter left out."""

    def shorter(texts: pd.Series) -> pd.Series:
        return pd.Series([list({t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}) for t in texts])

    left_out = towns.where(F.length("town") >= 7).select("town", F.explode(F.pandas_udf(shorter, "array<string>")("town")).alias("rest"))
    side = lambda c: left_out.select(F.col("town").alias(c), F.xxhash64("rest").alias("rest"))
    pairs = side("a").join(shuffled(side("b")), "rest").where("a < b").select("a", "b").distinct()

    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_town(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")

    return pairs.where(F.pandas_udf(verify, "boolean")("a", "b"))


def same_place_pairs(resolved: DataFrame, id_col: str, address: str) -> DataFrame:
    """(record_a, record_b) of one place whose address strings differ, record_a < record_b as strings.

    Different spellings of a place are paired first, then their records, so records that share one spelling, however
    many, never meet.
    """
    rows = resolved.select("place", F.xxhash64("place", address).alias("spelling"), F.col(id_col).alias("record"))
    spellings = rows.select("place", "spelling").distinct()
    pairs = (
        spellings.join(shuffled(spellings.withColumnRenamed("spelling", "other")), "place")
        .where("spelling <> other").select("spelling", "other")
    )
    a = rows.join(shuffled(pairs), "spelling").select(F.col("record").alias("record_a"), F.col("other").alias("spelling"))
    b = rows.select("spelling", F.col("record").alias("record_b"))
    return a.join(shuffled(b), "spelling").where("record_a < record_b").select("record_a", "record_b")
