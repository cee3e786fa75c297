"""Matching entities across sources without keys (problem 5).

Records are reduced to *mentions*: one per place and distinct list of own name words (records without such
words: per place and contact). MinHash blocking runs per attribute, always inside a place: banded signatures
of the 3-grams of each name word, beside them the word pairs that the segment join of ``names`` finds, and the one-element sets of web host, phone and e-mail, whose signature is
the value itself. Pairs that meet get a name view (identical words, words one or two typing errors apart,
best similarity) and a contact view (shared and conflicting hosts, phones, e-mails). No labels exist, so each
view labels the other: a logistic model of the name view is fitted to "shares a contact", one of the contact
view to "shares a name word". Both see positives as incompletely labelled and are calibrated by the labelling
rate among unmistakable matches (positive-unlabelled correction); the log-odds add up to the pair's
probability. Pairs from 0.5 link mentions into entities.

The models are fitted on about ``SAMPLE`` pairs at most, drawn by hash; every pair is scored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contacts import (
    canonical_email,
    canonical_phone,
    host_of,
    usable_email,
    usable_phone,
    usable_website,
)
from leadloom.llm.graph import components
from leadloom.llm.names import WHOLE, accepted_words, own_words, place_of
from leadloom.session import cut, shuffled

SAMPLE = 40_000
SHARED_HOST = 0.005  # share of all places (five at least) from which a host is no evidence
BANDS, ROWS = 12, 2
_MIX = np.random.default_rng(20_260_101).integers(1, 2**63 - 1, size=(2, BANDS * ROWS), dtype="int64").astype("uint64")
NAME_VIEW = ["same_1", "same_2", "err_1", "err_2", "similarity"]
CONTACT_VIEW = ["host", "phone", "email", "no_host", "no_phone", "no_email"]
# intercept first
NAME_START = (-3.0, 4.0, 5.0, 4.0, 3.0, 0.0)
CONTACT_START = (-1.0, 3.0, 2.0, 3.0, -1.0, -0.5, -0.5)


@lru_cache(maxsize=65_536)
def _bands(word: str) -> list[int]:
    text = f"^{word}$"
    grams = np.array([zlib.crc32(text[i : i + 3].encode()) for i in range(max(1, len(text) - 2))], dtype="uint64")
    with np.errstate(over="ignore"):
        mixed = (grams[:, None] * (_MIX[0] | np.uint64(1)) + _MIX[1]) >> np.uint64(20)
    sig = mixed.min(axis=0)
    return [zlib.crc32(sig[i * ROWS : (i + 1) * ROWS].tobytes()) * BANDS + i for i in range(BANDS)]


def minhash_bands(word: str) -> list[int]:
    """One key per band of the word's 3-gram signature."""
    return _bands(word)


class Logistic:
    """Logistic regression by Newton steps, with a positive-unlabelled calibration factor.

    The weights have a unit Gaussian prior around ``start``, which decides alone where there is nothing to learn from
    and fades with the number of pairs.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, sure: np.ndarray, start: tuple[float, ...]):
        x1 = np.hstack([np.ones((len(x), 1)), x])
        w0 = np.array(start)

        def loss(w: np.ndarray) -> float:
            z = x1 @ w
            return float(np.logaddexp(0.0, z).sum() - y @ z + 0.5 * ((w - w0) ** 2).sum())

        self.w = w0.copy()
        for _ in range(100):
            p = 1.0 / (1.0 + np.exp(-np.clip(x1 @ self.w, -30, 30)))
            hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.eye(len(w0))
            step = np.linalg.solve(hessian, x1.T @ (y - p) - (self.w - w0))
            now, scale = loss(self.w), 1.0
            while scale > 1e-6 and loss(self.w + scale * step) > now:
                scale /= 2
            self.w = self.w + scale * step
            if np.abs(scale * step).max() < 1e-6:
                break
        self.prior = (y.sum() + 6.0) / (len(y) + 20.0)
        # share of true pairs that carry the label, estimated where there is no doubt
        self.rate = float(np.clip((y[sure].sum() + 16.0) / (sure.sum() + 20.0), 0.05, 1.0))

    def probability(self, x: np.ndarray) -> np.ndarray:
        p = 1.0 / (1.0 + np.exp(-np.clip(np.hstack([np.ones((len(x), 1)), x]) @ self.w, -30, 30)))
        return np.clip(p / self.rate, 1e-4, 1 - 1e-4)

    def base_odds(self) -> float:
        p = float(np.clip(self.prior / self.rate, 1e-3, 0.999))
        return p / (1 - p)


def fit_views(sample: pd.DataFrame) -> tuple[Logistic, Logistic]:
    name, contact = sample[NAME_VIEW].to_numpy(float), sample[CONTACT_VIEW].to_numpy(float)
    shared = contact[:, :3].sum(axis=1)
    alike = name[:, 0] + name[:, 1]
    return (
        Logistic(name, (shared > 0).astype(float), name[:, 1] > 0, NAME_START),
        Logistic(contact, (alike > 0).astype(float), shared > 1, CONTACT_START),
    )


def match_probability(pairs: pd.DataFrame, models: tuple[Logistic, Logistic]) -> np.ndarray:
    by_name, by_contact = models
    p, q = by_name.probability(pairs[NAME_VIEW].to_numpy(float)), by_contact.probability(pairs[CONTACT_VIEW].to_numpy(float))
    odds = (p / (1 - p)) * (q / (1 - q)) / np.sqrt(by_name.base_odds() * by_contact.base_odds())
    return odds / (1 + odds)


def employer_records(jobs: DataFrame) -> DataFrame:
    """(rid, source, company, place, host, phone, email) with unusable contacts blanked."""
    # canonical forms and tests in steps of their own, so that each is computed once
    tested = jobs.select(
        F.col("id").alias("rid"), "source", "company",
        place_of(F.col("location"), F.col("employer_address")).alias("place"),
        host_of(F.col("employer_website")).alias("host"), usable_website(F.col("employer_website")).alias("host_ok"),
        canonical_phone(F.col("employer_phone")).alias("phone"), usable_phone(F.col("employer_phone")).alias("phone_ok"),
        canonical_email(F.col("employer_email")).alias("email"), usable_email(F.col("employer_email")).alias("email_ok"),
    )
    return tested.select("rid", "source", "company", "place", *[F.when(F.col(f"{c}_ok"), F.col(c)).alias(c) for c in ("host", "phone", "email")])


def _contacts(df: DataFrame, *keep: str) -> DataFrame:
    """One row per contact value: kind h, p or e and the value."""
    kinds = (("h", "host"), ("p", "phone"), ("e", "email"))
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds])
    return df.select(*keep, F.explode(cells).alias("x")).select(*keep, "x.kind", "x.value").where("value IS NOT NULL")


def _hosts(df: DataFrame) -> DataFrame:
    """(rid, place, value): web hosts and mail domains."""
    return df.select(
        "rid", "place", F.explode(F.array_distinct(F.array("host", F.substring_index("email", "@", -1)))).alias("value")
    ).where("value IS NOT NULL")


def match_employers(records: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``members`` (rid, source, entity) and ``links`` (mention_a, mention_b, probability), scored pairs.

    ``records`` is shaped like ``employer_records``. A record without a place takes the only place its words or
    contacts are found in; with neither words nor contacts it stays unmatched, as do NULLs throughout. Repeated
    rows fall into one mention; empty tables give empty results. Blocks hold distinct mentions, not rows, so
    an employer with a third of all rows is no larger than its spellings.
    """
    records = cut(records)
    named, nodes, member = own_words(records, "rid", "company", "place")
    # hosts and mail domains that occur in many places belong to providers or chains and identify nobody here
    hosts = _hosts(records).where("place <> ''").select("place", "value").distinct()
    many = max(5.0, SHARED_HOST * hosts.select("place").distinct().count())
    shared_hosts = cut(hosts.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= many).select("value"))
    contacts = cut(
        _hosts(records).join(shuffled(shared_hosts), "value", "left_anti").select("rid", "place", F.lit("h").alias("kind"), "value")
        .unionByName(_contacts(records, "rid", "place").where("kind <> 'h'")).distinct()
    )
    # places for records without one: words and contacts vote, the more the fewer places they are found in
    words_at = named.where("place = ''").select("rid", F.explode("words").alias("value")).join(
        shuffled(nodes.select(F.col("word").alias("value"), F.col("place").alias("at")).distinct()), "value"
    )
    known = contacts.where("place <> ''").select(F.col("place").alias("at"), "kind", "value").distinct()
    contacts_at = contacts.where("place = ''").drop("place").join(shuffled(known), ["kind", "value"])
    votes = words_at.select("rid", "value", "at").unionByName(contacts_at.select("rid", "value", "at"))
    share = votes.groupBy("rid", "value").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    tally = votes.join(shuffled(share), ["rid", "value"]).groupBy("rid", "at").agg(F.sum("w").alias("w"))
    placed = (
        tally.groupBy("rid").agg(F.max(F.struct("w", "at")).alias("top"), F.sum("w").alias("all"))
        .where(F.col("top.w") >= 0.6 * F.col("all")).select("rid", F.col("top.at").alias("lo"))
    )
    own = (
        member.join(shuffled(nodes), "node").groupBy("list")
        .agg(F.sort_array(F.collect_list(F.struct("word", "support"))).alias("own"))
    )
    lost_words = (
        named.where("place = ''").join(shuffled(placed), "rid").select("rid", F.col("lo").alias("place"), F.explode("words").alias("word"))
        .join(shuffled(nodes.select("place", "word", "support")), ["place", "word"])
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("word", "support"))).alias("own"))
    )
    words_of = (
        named.where("place <> ''").select("rid", F.xxhash64("place", "words").alias("list")).join(shuffled(own), "list")
        .select("rid", "own").unionByName(lost_words.select("rid", "own"))
    )
    full = (
        records.join(shuffled(placed.select("rid", "lo")), "rid", "left")
        .join(shuffled(words_of), "rid", "left")
        .withColumn("place", F.when(F.col("place") != "", F.col("place")).otherwise(F.col("lo")))
        .where(F.col("place").isNotNull())
        .withColumn("words", F.transform("own", lambda x: x["word"]))
    )
    contact_key = F.coalesce(F.concat(F.lit("h"), "host"), F.concat(F.lit("e"), "email"), F.concat(F.lit("p"), "phone"))
    mention = F.when(F.col("words").isNotNull(), F.xxhash64("place", F.lit("n"), "words")).otherwise(
        F.xxhash64("place", F.lit("c"), contact_key)
    )
    full = cut(
        full.where(F.col("words").isNotNull() | contact_key.isNotNull())
        .select("rid", "source", "place", "own", "host", "phone", "email", mention.alias("mention"))
    )
    mentions = cut(
        full.groupBy("mention").agg(F.first("own").alias("own"), F.first("place").alias("place"))
        .withColumn("words", F.transform("own", lambda x: x["word"]))
    )

    def bands(words: pd.Series) -> pd.Series:
        return pd.Series([[zlib.crc32(w.encode()) * BANDS] if w.startswith(WHOLE) else minhash_bands(w) for w in words])

    spoken = mentions.select("mention", "place", F.explode("words").alias("word"))
    name_keys = (
        spoken.select("mention", "place", F.explode(F.pandas_udf(bands, "array<long>")("word")).alias("band"))
        .select("mention", F.lit("n").alias("kind"), F.xxhash64("place", F.lit("n"), "band").alias("key"))
    )
    contact_keys = cut(
        full.select("rid", "mention", F.col("place").alias("at")).join(shuffled(contacts), "rid")
        .select("mention", "kind", F.xxhash64("at", "kind", "value").alias("key")).distinct()
    )
    has = contact_keys.groupBy("mention").agg(*[F.max(F.col("kind") == k).alias(f"has_{k}") for k in "hpe"])
    keys = cut(name_keys.distinct().unionByName(contact_keys))
    left = keys.select(F.col("mention").alias("a"), "kind", "key")
    right = keys.select(F.col("mention").alias("b"), "key")
    met = left.join(shuffled(right), "key").where("a < b").select(
        "a", "b", *[(F.col("kind") == k).cast("int").alias(f"met_{k}") for k in "hpe"], F.lit(0).alias("err_1"), F.lit(0).alias("err_2")
    )
    # short typed words often meet in no band: every pair within the accepted errors is a block of its own
    word = nodes.where(~F.col("word").startswith(WHOLE))
    said = spoken.select("mention", "word", F.xxhash64("place", "word").alias("node"))
    by_word = lambda m, n, w: said.select(F.col("mention").alias(m), F.col("node").alias(n), F.col("word").alias(w))
    typed = (
        accepted_words(word).select(F.col("a").alias("x"), F.col("b").alias("y"), "errors")
        .join(shuffled(by_word("m", "x", "wm")), "x").join(shuffled(by_word("o", "y", "wo")), "y")
    )
    # words that both mentions have say nothing about the others
    own = lambda m: mentions.select(F.col("mention").alias(m), F.col("words").alias(f"words_{m}"))
    typed = (
        typed.where("m <> o").join(shuffled(own("m")), "m").join(shuffled(own("o")), "o")
        .where(~F.array_contains("words_o", F.col("wm")) & ~F.array_contains("words_m", F.col("wo")))
        .select(F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b"), *[F.lit(0).alias(f"met_{k}") for k in "hpe"],
                *[(F.col("errors") == n).cast("int").alias(f"err_{n}") for n in (1, 2)])
    )
    grouped = met.unionByName(typed).groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("met_h", "met_p", "met_e", "err_1", "err_2")])
    flags = mentions.select("mention", F.coalesce("words", F.array().cast("array<string>")).alias("words")).join(shuffled(has), "mention", "left")
    side = lambda s: flags.select(
        F.col("mention").alias(s), F.col("words").alias(f"words_{s}"), *[F.coalesce(f"has_{k}", F.lit(False)).alias(f"has_{k}_{s}") for k in "hpe"]
    )
    both = grouped.join(shuffled(side("a")), "a").join(shuffled(side("b")), "b").withColumn("same", F.size(F.array_intersect("words_a", "words_b")))
    grams = lambda ws: F.transform(
        F.filter(ws, lambda w: ~w.startswith(WHOLE)),
        lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.substring(w, i, F.lit(2))),
    )
    likeness = F.array_max(F.flatten(F.transform(grams("words_a"), lambda x: F.transform(
        grams("words_b"), lambda y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))))))
    conflict = lambda k: (F.col(f"has_{k}_a") & F.col(f"has_{k}_b") & (F.col(f"met_{k}") == 0)).cast("double")
    unlike = (F.col("same") == 0) & (F.col("err_1") == 0) & (F.col("err_2") == 0)
    pairs = cut(
        both.select("a", "b",
                    (F.col("same") == 1).cast("double").alias("same_1"), (F.col("same") > 1).cast("double").alias("same_2"),
                    F.col("err_1").cast("double"), F.col("err_2").cast("double"),
                    F.when(unlike, F.coalesce(likeness, F.lit(0.0))).otherwise(0.0).alias("similarity"),
                    *[F.col(f"met_{k}").cast("double").alias(n) for k, n in zip("hpe", CONTACT_VIEW[:3], strict=True)],
                    *[conflict(k).alias(n) for k, n in zip("hpe", CONTACT_VIEW[3:], strict=True)])
    )
    share = min(1.0, SAMPLE / max(1, pairs.count()))
    lot = F.pmod(F.xxhash64("a", "b"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    drawn = pairs.where(lot).select(*NAME_VIEW, *CONTACT_VIEW).toPandas()
    models = fit_views(drawn)

    def score(*cols: pd.Series) -> pd.Series:
        frame = pd.concat(cols, axis=1, keys=[*NAME_VIEW, *CONTACT_VIEW])
        return pd.Series(match_probability(frame, models))

    links = cut(pairs.select("a", "b", F.pandas_udf(score, "double")(*NAME_VIEW, *CONTACT_VIEW).alias("probability")))
    comp = components(links.where(F.col("probability") >= threshold))
    members = cut(
        full.join(shuffled(comp.withColumnRenamed("node", "mention")), "mention", "left")
        .select("rid", "source", "mention", F.coalesce("component", "mention").alias("entity"))
    )
    return members, links.select(F.col("a").alias("mention_a"), F.col("b").alias("mention_b"), "probability")


def cross_source_pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b, mention_a, mention_b) of one entity with different source, id_a < id_b as strings.

    Rows of an entity meet the rows of its other sources only, so one that a single source lists, of whatever size,
    never meets itself.
    """
    listed = members.select("entity", "source").distinct()
    others = (
        listed.join(shuffled(listed.withColumnRenamed("source", "source_b")), "entity").where("source <> source_b")
        .select("entity", "source", "source_b")
    )
    a = members.join(shuffled(others), ["entity", "source"]).select(
        "entity", F.col("source_b").alias("source"), F.col("rid").alias("id_a"), F.col("mention").alias("mention_a")
    )
    b = members.select("entity", "source", F.col("rid").alias("id_b"), F.col("mention").alias("mention_b"))
    return a.join(shuffled(b), ["entity", "source"]).where("id_a < id_b").select("id_a", "id_b", "mention_a", "mention_b", "entity")
