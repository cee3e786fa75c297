"""Best representative of each duplicate group, field by field (problem 7).

Token-level consensus: the distinct usable values of a group's field are split into tokens and aligned
progressively into columns; every value votes its weight for its token in each column; the winning tokens
form the consensus, and the existing value closest to it survives, with the row that supplied it last.

Two weightings:

* ``"latest"`` - the most recent value weighs 1, all others of the group together 1/2, so the survivor is the
  value supplied by the latest usable row (what ``p7_found`` asks for);
* ``"support"`` - a value weighs the number of rows that carry it, the plain majority consensus.

Scale: values are reduced to distinct (group, field, canonical value) before the shuffle. Groups with more
than ``bucket`` distinct values are aligned in hashed buckets whose profiles are merged level by level, so no
task sees more than ``bucket`` members; profiles keep every token, nothing is dropped.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.contacts import CANONICAL, USABLE
from leadloom.session import cut

_TOKEN = re.compile(r"\d{1,3}|[^\W\d_]+|[^\w\s]|_", re.U)
GAP = ""
Profile = list[dict[str, float]]


def tokens(value: str) -> list[str]:
    """Digit triples, letter runs and single marks of a canonical value."""
    return _TOKEN.findall(value)


def _column_match(col: dict[str, float], other: dict[str, float]) -> float:
    """Weighted agreement of two columns in -1..1."""
    a, b = sum(col.values()), sum(other.values())
    if not a or not b:
        return 0.0
    small, large = (col, other) if len(col) <= len(other) else (other, col)
    same = sum(w * large.get(t, 0.0) for t, w in small.items() if t != GAP)
    return 2.0 * same / (a * b) - 1.0


def align(left: Profile, right: Profile, gap: float = -0.6) -> Profile:
    """Merge two profiles along their best global alignment."""
    if not left or not right:
        return left or right
    n, m = len(left), len(right)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = i * gap
    for j in range(1, m + 1):
        score[0][j] = j * gap
    match = [[_column_match(a, b) for b in right] for a in left]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i][j] = max(
                score[i - 1][j - 1] + match[i - 1][j - 1], score[i - 1][j] + gap, score[i][j - 1] + gap
            )
    wl, wr = sum(left[0].values()), sum(right[0].values())
    out: Profile = []
    i, j = n, m
    while i or j:
        if i and j and math.isclose(score[i][j], score[i - 1][j - 1] + match[i - 1][j - 1], abs_tol=1e-12):
            i, j = i - 1, j - 1
            col = dict(left[i])
            for t, w in right[j].items():
                col[t] = col.get(t, 0.0) + w
        elif i and math.isclose(score[i][j], score[i - 1][j] + gap, abs_tol=1e-12):
            i -= 1
            col = dict(left[i])
            col[GAP] = col.get(GAP, 0.0) + wr
        else:
            j -= 1
            col = dict(right[j])
            col[GAP] = col.get(GAP, 0.0) + wl
        out.append(col)
    return out[::-1]


def consensus(profile: Profile) -> list[str]:
    """Heaviest token of every column (ties: the smaller token), gaps left out."""
    winners = (min(col.items(), key=lambda x: (-x[1], x[0]))[0] for col in profile)
    return [t for t in winners if t != GAP]


def token_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _merge(pdf: pd.DataFrame) -> list[dict[str, float]]:
    """Progressive alignment in order of weight (ties: the profile text), heaviest first."""
    out: Profile = []
    for text in pdf.sort_values(["weight", "profile"], ascending=[False, True])["profile"]:
        out = align(out, json.loads(text))
    return out


def _profiles(values: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series(
        [json.dumps([{t: w} for t in tokens(v)]) for v, w in zip(values, weights, strict=True)], dtype="object"
    )


def surviving_values(
    members: DataFrame,
    group: str,
    row_id: str,
    fields: list[str],
    order: str,
    weighting: str = "support",
    bucket: int = 256,
) -> DataFrame:
    """(<group>, field_name, <row_id>, value, consensus): one surviving value per group and field.

    ``members`` holds one row per group member with the contact ``fields`` and the recency column ``order``.
    Unusable values (blank, filler, fragment, portal contact, NULL) never vote; a group without a usable
    value gives no row; NULL group ids are ignored; a NULL ``order`` counts as oldest; ties go to the later
    row, then the larger row id; repeated rows add to the support of their value only.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field_name"),
                F.col(f).alias("value"),
                CANONICAL[f](F.col(f)).alias("canon"),
                USABLE[f](F.col(f)).alias("ok"),
            )
            for f in fields
        ]
    )
    latest = F.struct(F.col(order).alias("at"), F.col("rid").alias("rid"), F.col("value").alias("value"))
    distinct = cut(
        members.where(F.col(group).isNotNull())
        .select(F.col(group).alias("g"), F.col(row_id).alias("rid"), F.col(order), F.explode(cells).alias("c"))
        .where("c.ok")
        .select("g", "rid", order, "c.field_name", "c.value", "c.canon")
        .groupBy("g", "field_name", "canon")
        .agg(F.max(latest).alias("last"), F.count(F.lit(1)).cast("double").alias("support"))
    )
    per_group = distinct.groupBy("g", "field_name").agg(
        F.max("last").alias("newest"), F.count(F.lit(1)).alias("n_values")
    )
    newest = (F.col("last.rid") == F.col("newest.rid")) & (F.col("last.at").eqNullSafe(F.col("newest.at")))
    weight = (
        F.when(newest, F.lit(1.0)).otherwise(F.lit(0.5) / F.col("n_values"))
        if weighting == "latest"
        else F.col("support")
    )
    votes = distinct.join(per_group, ["g", "field_name"]).withColumn("weight", weight)
    multi = votes.where("n_values > 1").select(
        "g",
        "field_name",
        "weight",
        F.pandas_udf(_profiles, "string")("canon", "weight").alias("profile"),
        F.ceil(F.col("n_values") / bucket).alias("buckets"),
        F.xxhash64("canon").alias("h"),
    )
    largest = per_group.agg(F.max("n_values")).first()[0] or 0
    schema = "g {0}, field_name string, weight double, profile string, buckets bigint, h bigint".format(
        dict(distinct.dtypes)["g"]
    )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame(
            {
                "g": [first["g"]],
                "field_name": [first["field_name"]],
                "weight": [float(pdf["weight"].sum())],
                "profile": [json.dumps(_merge(pdf))],
                "buckets": [int(math.ceil(first["buckets"] / bucket))],
                "h": [int(pdf["h"].min())],
            }
        )

    levels = max(1, math.ceil(math.log(max(largest, 2)) / math.log(bucket)) + (largest > bucket))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = multi
    for _ in range(levels):
        slot = F.pmod(F.col("h"), F.col("buckets"))
        merged = (
            merged.withColumn("slot", slot)
            .repartition(tasks, "g", "field_name", "slot")  # few bytes but much work: as many tasks as configured
            .groupBy("g", "field_name", "slot")
            .applyInPandas(merge, schema)
        )

    def vote(profiles: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(consensus(json.loads(p))) for p in profiles], dtype="object")

    winners = merged.select("g", "field_name", F.pandas_udf(vote, "string")("profile").alias("winner"))

    def distance(canon: pd.Series, winner: pd.Series) -> pd.Series:
        return pd.Series(
            [0 if w is None else token_distance(tokens(c), json.loads(w)) for c, w in zip(canon, winner, strict=True)],
            dtype="int64",
        )

    # singletons need no vote: their only value is the consensus
    scored = votes.join(winners, ["g", "field_name"], "left").withColumn(
        "d", F.pandas_udf(distance, "long")("canon", "winner")
    )
    best = scored.groupBy("g", "field_name").agg(
        F.max(F.struct((-F.col("d")).alias("d"), "weight", "last", "winner")).alias("b")
    )
    return best.select(
        F.col("g").alias(group),
        "field_name",
        F.col("b.last.rid").alias(row_id),
        F.col("b.last.value").alias("value"),
        F.coalesce(
            F.array_join(F.from_json("b.winner", "array<string>"), ""), _canonical(F.col("field_name"), F.col("b.last.value"))
        ).alias("consensus"),
    )


def _canonical(field, value):
    out = F.lit(None).cast("string")
    for name, fn in CANONICAL.items():
        out = F.when(field == name, fn(value)).otherwise(out)
    return out
