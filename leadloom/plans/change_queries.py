"""Queries of the general data problems: snapshot changes and packed fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leadloom.operators.multivalue import split_packed
from leadloom.operators.snapshots import snapshot_changes
from leadloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "job_snapshots"), table(spark, sf_dir, "scrape_runs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hotels = table(spark, sf_dir, "omh_hoteli")
    split = split_packed(hotels, "hotel_id", {"email": "email", "phone_number": "phone"})
    return split.where("n_items > 1").select("hotel_id", "field_name", "item_no", "item")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p6_found": p6_found}

P4_SQL = r"""
WITH runs AS (
  SELECT id AS run_id, source, row_number() OVER (PARTITION BY source ORDER BY created_at, id) AS idx
  FROM scrape_runs WHERE status = 'completed'
), ranked AS (
  SELECT r.source, r.idx, s.detail_url, s.job_payload,
         row_number() OVER (PARTITION BY s.run_id, s.detail_url ORDER BY s.scraped_at DESC, s.id DESC) AS rn
  FROM job_snapshots s JOIN runs r ON r.run_id = s.run_id WHERE s.detail_url IS NOT NULL
), items AS (
  SELECT source, idx, detail_url,
         list_sort(list_filter(list_transform(json_keys(job_payload),
           lambda k: k || chr(31) || coalesce(json_extract_string(job_payload, '$."' || k || '"'), '')),
           lambda x: NOT ends_with(x, chr(31)))) AS content
  FROM ranked WHERE rn = 1
), pairs AS (SELECT a.run_id, a.source, a.idx FROM runs a WHERE a.idx > 1)
SELECT p.run_id, n.detail_url, CASE WHEN o.detail_url IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM pairs p JOIN items n ON n.source = p.source AND n.idx = p.idx
LEFT JOIN items o ON o.source = p.source AND o.idx = p.idx - 1 AND o.detail_url = n.detail_url
WHERE o.detail_url IS NULL OR o.content <> n.content
UNION ALL
SELECT p.run_id, o.detail_url, 'removed' AS change_kind
FROM pairs p JOIN items o ON o.source = p.source AND o.idx = p.idx - 1
WHERE NOT EXISTS (SELECT 1 FROM items n WHERE n.source = p.source AND n.idx = p.idx AND n.detail_url = o.detail_url)
"""

P6_SQL = r"""
WITH fields AS (
  SELECT hotel_id, 'email' AS field_name,
         regexp_extract_all(email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS items
  FROM omh_hoteli
  UNION ALL
  SELECT hotel_id, 'phone_number' AS field_name,
         list_transform(list_filter(
           regexp_split_to_array(phone_number, '[;,|\n"]| / | i | ili |[A-Za-z]+[.:]?'),
           lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 5),
           lambda x: CASE WHEN starts_with(ltrim(x), '+') THEN '+' ELSE '' END || regexp_replace(x, '[^0-9]', '', 'g')) AS items
  FROM omh_hoteli
), numbered AS (
  SELECT hotel_id, field_name, unnest(items) AS item, unnest(generate_series(1, len(items))) AS item_no
  FROM fields WHERE len(items) > 1
)
SELECT hotel_id, field_name, CAST(item_no AS INTEGER) AS item_no, item FROM numbered
"""

ORACLE: dict[str, str] = {"p4_found": P4_SQL, "p6_found": P6_SQL}
