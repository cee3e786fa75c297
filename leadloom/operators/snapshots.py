"""Change data capture between full snapshots (problem 4).

``snapshot_changes`` compares every snapshot with the one just before it in a single pass: rows are
reduced to one content hash per (series, key, snapshot index), then one window per key looks at the
neighbouring indexes. A different lagged hash is a change; an index gap is a removal at the first
missing snapshot and an addition at the first one after the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_content_hash(payload: Column) -> Column:
    """64-bit hash of a flat JSON object that ignores layout, key order, NULL and ``""`` values.

    Unparseable or NULL text hashes as the raw text (NULL like an empty object), so two equal broken
    payloads are equal and a broken one differs from any object.
    """
    parsed = F.from_json(payload, "map<string,string>")
    kept = F.map_filter(parsed, lambda _, v: v.isNotNull() & (v != ""))
    pairs = F.array_sort(
        F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("\x1f"), e["value"]))
    )
    broken = parsed.isNull() & payload.isNotNull()
    return F.xxhash64(F.when(broken, F.array(F.lit("\x1e"), payload)).otherwise(F.coalesce(pairs, F.array().cast("array<string>"))))


def snapshot_index(runs: DataFrame) -> DataFrame:
    """(run_id, series, idx, last_idx) of completed runs, numbered per source by ``created_at`` (ties: id)."""
    w = Window.partitionBy("source").orderBy("created_at", "id")
    return (
        runs.where(F.col("status") == "completed")
        .select(
            F.col("id").alias("run_id"),
            F.col("source").alias("series"),
            F.row_number().over(w).alias("idx"),
            F.count(F.lit(1)).over(Window.partitionBy("source")).cast("int").alias("last_idx"),
        )
    )


def snapshot_changes(
    snapshots: DataFrame,
    runs: DataFrame,
    key: str = "detail_url",
    payload: str = "job_payload",
    version: str = "scraped_at",
    tie: str = "id",
) -> DataFrame:
    """(run_id, <key>, change_kind) for every snapshot but the first of its series.

    * several rows of one key in one snapshot: the latest ``version`` counts, then the larger ``tie``
    * rows of runs that are not completed, of unknown runs, or with a NULL key are ignored
    * a NULL ``version`` counts as the oldest
    * empty inputs give an empty result; further columns are not read

    Scale: the payload is hashed in the scan stage, duplicates are combined before the shuffle (a key
    repeated any number of times leaves each task once per snapshot), and the window sees at most one
    row per key and snapshot. ``runs`` joins by size statistics, without a forced broadcast.
    """
    idx = snapshot_index(runs)
    rows = (
        snapshots.where(F.col(key).isNotNull())
        .select(
            F.col("run_id"),
            F.col(key).alias("key"),
            F.struct(
                F.col(version).alias("v"), F.col(tie).alias("t"), json_content_hash(F.col(payload)).alias("h")
            ).alias("state"),
        )
        .join(idx.select("run_id", "series", "idx"), "run_id")
        .groupBy("series", "key", "idx")
        .agg(F.max("state")["h"].alias("h"))
    )
    w = Window.partitionBy("series", "key").orderBy("idx")
    prev_idx, prev_h, next_idx = F.lag("idx").over(w), F.lag("h").over(w), F.lead("idx").over(w)
    steps = rows.select(
        "series", "key", "idx", "h", prev_idx.alias("pi"), prev_h.alias("ph"), next_idx.alias("ni")
    )
    event = "struct<at:int,kind:string>"
    here = (
        F.when((F.col("pi") == F.col("idx") - 1) & (F.col("ph") != F.col("h")), F.lit("changed"))
        .when((F.col("pi") == F.col("idx") - 1), F.lit(None).cast("string"))
        .when(F.col("idx") > 1, F.lit("added"))
    )
    gone = F.when(F.col("ni").isNull() | (F.col("ni") > F.col("idx") + 1), F.lit("removed"))
    events = F.array(
        F.struct(F.col("idx").alias("at"), here.alias("kind")).cast(event),
        F.struct((F.col("idx") + 1).alias("at"), gone.alias("kind")).cast(event),
    )
    flat = (
        steps.select("series", "key", F.explode(F.filter(events, lambda e: e["kind"].isNotNull())).alias("e"))
        .select("series", "key", F.col("e.at").alias("idx"), F.col("e.kind").alias("change_kind"))
    )
    # a removal after the last snapshot has no run to report it and falls out of this inner join
    return flat.join(idx.select("series", "idx", "run_id"), ["series", "idx"]).select(
        "run_id", F.col("key").alias(key), "change_kind"
    )
