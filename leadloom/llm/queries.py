"""Queries of the text and entity problems, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.address import resolve_addresses, same_place_pairs
from leadloom.llm.leakage import leaked_items
from leadloom.llm.matching import cross_source_pairs, employer_records, match_employers
from leadloom.llm.names import entity_pairs, name_entities, place_of
from leadloom.llm.packing import pack, token_count
from leadloom.llm.prose import keyword_pages
from leadloom.llm.scripts import confusable_values
from leadloom.llm.survivor import surviving_values
from leadloom.session import cut, shuffled, spread, table

CONTACTS = ["employer_email", "employer_website", "employer_phone"]


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, address, context) of hotels, agencies and jobs."""
    parts = [
        ("omh_hoteli", "hotel:", "hotel_id", "address", "city"),
        ("gelbeseiten_agencies", "agency:", "agency_id", "address", "city"),
        ("jobs", "job:", "id", "employer_address", "location"),
    ]
    out = None
    for name, prefix, key, address, context in parts:
        part = table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("record"),
            F.col(address).alias("address"),
            F.col(context).alias("context"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_addresses(_addresses(spark, sf_dir), "record", "address", "context")
    return same_place_pairs(resolved, "record", "address")


def p1_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_addresses(_addresses(spark, sf_dir), "record", "address", "context")
    return resolved.select("record", "street", "house", "town", "place")


def _named(spark: SparkSession, sf_dir: str, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leads, jobs of the given sources or of all, and the entities of both."""
    leads = table(spark, sf_dir, "hzz_ugostitelji_radnici_u_turizmu").select(
        F.concat(F.lit("l"), F.col("lead_id").cast("string")).alias("rid"), "lead_id", "company",
        place_of(F.col("city")).alias("place"),
    )
    jobs = table(spark, sf_dir, "jobs").where(F.col("source").isin(sources) if sources else F.lit(True)).select(
        F.concat(F.lit("j"), F.col("id")).alias("rid"), F.col("id").alias("job_id"), "source", "company",
        place_of(F.col("location"), F.col("employer_address")).alias("place"),
    )
    both = cut(leads.select("rid", "company", "place").unionByName(jobs.select("rid", "company", "place")))
    return leads, jobs, cut(name_entities(both, "rid", "company", "place"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: one row for each lead (l...) and job (j...) of any source whose employer is told apart."""
    return _named(spark, sf_dir)[2].select(F.col("rid").alias("record"), "entity")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # by definition leads and jobs of hzz; those of the other Croatian listing bridge their spellings
    leads, jobs, entities = _named(spark, sf_dir, ["hzz", "mojposao"])
    return entity_pairs(entities, leads, jobs.where("source = 'hzz'"), "lead_id", "job_id", "company")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs")
    return confusable_values(jobs, "id", ["company", "title", "location"], "job_id").select("job_id", "field_name")


def p3_plain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs")
    return confusable_values(jobs, "id", ["company", "title", "location"], "job_id")


def _employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").select("id", "source", "company", "location", "employer_address", *CONTACTS)
    return employer_records(spread(jobs))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = match_employers(_employers(spark, sf_dir))
    return cross_source_pairs(members).select(F.col("id_a").alias("job_id_a"), F.col("id_b").alias("job_id_b"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: one row for each job whose employer is told apart."""
    members, _ = match_employers(_employers(spark, sf_dir))
    return members.select(F.col("rid").alias("job_id"), "source", "entity")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with a confidence: the pair's own probability, else the weakest link of its entity."""
    members, links = match_employers(_employers(spark, sf_dir))
    linked = links.where("probability >= 0.5")
    weakest = (
        linked.join(shuffled(members.select(F.col("mention").alias("mention_a"), "entity").distinct()), "mention_a")
        .groupBy("entity").agg(F.min("probability").alias("weakest"))
    )
    direct = linked.unionByName(
        linked.select(F.col("mention_b").alias("mention_a"), F.col("mention_a").alias("mention_b"), "probability")
    )
    confidence = F.coalesce(
        "probability", F.when(F.col("mention_a") == F.col("mention_b"), F.lit(1.0)), "weakest", F.lit(1.0)
    )
    return (
        cross_source_pairs(members)
        .join(shuffled(direct), ["mention_a", "mention_b"], "left")
        .join(shuffled(weakest), "entity", "left")
        .select(F.col("id_a").alias("job_id_a"), F.col("id_b").alias("job_id_b"), confidence.alias("confidence"))
    )


def _group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").withColumnRenamed("id", "job_id")
    return table(spark, sf_dir, "job_groups").join(jobs.select("job_id", "updated_at", *CONTACTS), "job_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surviving_values(_group_members(spark, sf_dir), "group_id", "job_id", CONTACTS, "updated_at", "latest")
    return out.select("group_id", "field_name", "job_id")


def p7_consensus_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_values(_group_members(spark, sf_dir), "group_id", "job_id", CONTACTS, "updated_at", "support")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", token_count(F.col("text")).alias("n"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens."""
    return pack(_measured(spark, sf_dir), "doc_id", "n", (2_048,))


def p8_mixed_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of four permitted sizes."""
    return pack(_measured(spark, sf_dir), "doc_id", "n", (512, 1_024, 2_048, 4_096))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_places": p1_places,
    "p2_found": p2_found,
    "p2_entities": p2_entities,
    "p3_found": p3_found,
    "p3_plain_values": p3_plain_values,
    "p5_found": p5_found,
    "p5_members": p5_members,
    "p5_confidence": p5_confidence,
    "p7_found": p7_found,
    "p7_consensus_values": p7_consensus_values,
    "p8_containers": p8_containers,
    "p8_mixed_containers": p8_mixed_containers,
    "p9_found": p9_found,
    "p10_found": p10_found,
}

_LABEL = r"[\p{L}\p{N}]([\p{L}\p{N}-]*[\p{L}\p{N}])?"
_HOST = rf"({_LABEL}\.)+\p{{L}}{{2,24}}"
_ASSET = r"\.(png|jpe?g|gif|webp|svg|ico|bmp|tiff?|css|js|pdf)$"
_PORTAL = r"(^|\.)(hzz|mojposao|meinestadt|gelbeseiten)\.example$"

# The same rows by the plain definition: latest row among the usable ones.
P7_SQL = rf"""
WITH m AS (
  SELECT g.group_id, j.id AS job_id, j.updated_at, unnest(['employer_email', 'employer_website', 'employer_phone']) AS field_name,
         unnest([j.employer_email, j.employer_website, j.employer_phone]) AS v
  FROM job_groups g JOIN jobs j ON j.id = g.job_id
), t AS (
  SELECT *, regexp_replace(v, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS s, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM m WHERE v IS NOT NULL
), h AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(s), '^[a-z][a-z0-9+.-]*:/+', ''), '[/?#].*$', ''), '^www\.', '') AS host,
         regexp_replace(lower(s), '^mailto:', '') AS mail FROM t
), u AS (
  SELECT *, CASE field_name
    WHEN 'employer_email' THEN regexp_matches(mail, '^[\p{{L}}\p{{N}}._%+''-]+@{_HOST}$') AND NOT regexp_matches(mail, '{_ASSET}')
      AND NOT regexp_matches(mail, '\.\.|^\.|\.@') AND NOT regexp_matches(split_part(mail, '@', 2), '{_PORTAL}')
    WHEN 'employer_website' THEN regexp_matches(host, '^{_HOST}$') AND NOT regexp_matches(host, '{_ASSET}')
      AND NOT regexp_matches(host, '{_PORTAL}') AND NOT regexp_matches(s, '\s')
    ELSE regexp_matches(s, '(?i)^(tel|mob|fon|phone|rec|fax)?[.: ]*[+0-9(][0-9\s\pZ()/.+-]*[0-9]\)?$') AND length(digits) BETWEEN 9 AND 16
      AND replace(digits, digits[1], '') <> '' END AS usable
  FROM h
)
SELECT group_id, field_name, arg_max(job_id, (updated_at, job_id)) AS job_id FROM u WHERE usable GROUP BY 1, 2
"""

# Values with any character outside the plain letters, unless they are written in Cyrillic words throughout.
P3_SQL = r"""
WITH v AS (SELECT id AS job_id, unnest(['company', 'title', 'location']) AS field_name, unnest([company, title, location]) AS value FROM jobs)
SELECT job_id, field_name FROM v
WHERE NOT regexp_matches(value, '^[\x20-\x7eČčĆćŽžŠšĐđÄäÖöÜüß]*$') AND NOT regexp_matches(value, '^(\p{Cyrillic}+|[ -@\[-`{-~]+)+$')
"""

ORACLE: dict[str, str] = {"p3_found": P3_SQL, "p7_found": P7_SQL}
