"""From raw items to the canonical job table: normalise, classify, limit, upsert, snapshot, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import clean_or_null, company_key, fold, parse_date
from leadloom.operators.dedupe import drop_reasons, first_by_key
from leadloom.operators.upsert import upsert
from leadloom.sources.raw import raw_items

JOB_COLUMNS = (
    "title company location category detail_url source published_at employer_website employer_email employer_address "
    "employer_phone".split()
)


def _clean(name: str) -> Column:
    return clean_or_null(F.col(f"raw.{name}"))


def _or(*cols: Column) -> Column:
    return F.coalesce(*cols)


def normalized(items: DataFrame, source: str, category: Column | None = None) -> DataFrame:
    """``items`` (with the struct ``raw``) plus the struct ``job`` of canonical columns.

    ``category`` is the searched category where the source's items do not carry one.
    """
    none = F.lit(None).cast("string")
    cat = none if category is None else category
    site = {
        "hzz": dict(
            category=cat, published_at=parse_date(_clean("valid_from")), employer_website=none, employer_email=_clean("email"),
            employer_address=_clean("employer_address"), employer_phone=_clean("phone"),
        ),
        "mojposao": dict(
            category=_clean("category"), published_at=parse_date(_clean("published_at")), employer_website=_clean("employer_website"),
            employer_email=none, employer_address=none, employer_phone=none,
        ),
        "meinestadt": dict(
            category=_clean("category"), published_at=parse_date(_clean("published_at")), employer_website=_clean("employer_website"),
            employer_email=_or(_clean("employer_email"), _clean("email")), employer_address=none, employer_phone=none,
        ),
        "gelbeseiten": dict(
            title=_or(_clean("title"), _clean("company")), location=_or(_clean("city"), _clean("location")), category=cat,
            published_at=F.lit(None).cast("date"), employer_website=_or(_clean("employer_website"), _clean("website")),
            employer_email=_clean("email"), employer_address=_or(_clean("employer_address"), _clean("address")),
            employer_phone=_clean("phone"),
        ),
    }[source]
    base = {c: _clean(c) for c in ("title", "company", "location", "detail_url")} | {"source": F.lit(source)}
    cols = base | site
    return items.withColumn("job", F.struct(*[cols[c].alias(c) for c in JOB_COLUMNS]))


def is_excluded_employer(company: Column) -> Column:
    """Schools and kindergartens, as whole words of the folded name."""
    return fold(company).rlike(r"\b(skola|vrtic)\b")


def classify(jobs: DataFrame, detail_url: str = "detail_url", company: str = "company") -> DataFrame:
    """Adds ``reason``: invalid (no listing address), excluded (employer), else valid."""
    return drop_reasons(
        jobs, [("invalid", F.col(detail_url).isNull()), ("excluded", is_excluded_employer(F.col(company)))], "valid"
    )


def limit_companies(jobs: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """No limit keeps every row; a limit keeps the first row of each company, ``limit`` companies at most."""
    if limit is None:
        return jobs
    return first_by_key(jobs, company_key(F.col("company"), F.col("detail_url")), order, limit)


def snapshot_payload(raw: Column, job: Column, job_fields: list[str]) -> Column:
    """JSON of the raw item overlaid by the canonical fields, NULLs kept."""
    as_map = lambda c: F.from_json(F.to_json(c, {"ignoreNullFields": "false"}), "map<string,string>")
    left = F.map_filter(as_map(raw), lambda k, _: ~k.isin(job_fields))
    return F.to_json(F.map_concat(left, as_map(job)), {"ignoreNullFields": "false"})


def run_summary(classified: DataFrame, by: list[str]) -> DataFrame:
    """scraped, upserted, failed and excluded counts; excluded employers are not failures."""
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scraped_count"),
        F.count_if(F.col("reason") == "valid").alias("upserted_count"),
        F.count_if(F.col("reason") == "invalid").alias("failed_count"),
        F.count_if(F.col("reason") == "excluded").alias("excluded_count"),
    )


def ingest(payloads: DataFrame, stored: DataFrame, source: str, order: list[Column], limit: int | None = None, payload: str = "job_payload", delivered: list[Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, snapshots, classified) of one delivery of a source.

    Raw items are normalised and classified in one pass; valid ones are limited by company (the first in ``delivered``
    order, which a limit needs), then upserted into ``stored`` (the first of a listing in ``order`` wins, so give the
    latest first; known addresses are kept) and written as snapshot rows of raw item and canonical fields.
    ``classified`` feeds ``run_summary``.
    """
    if limit is not None and not delivered:
        raise ValueError("a limit needs the order of delivery")
    items = normalized(raw_items(payloads, payload, source), source)
    flat = items.select("*", *[F.col(f"job.{c}").alias(c) for c in JOB_COLUMNS if c not in payloads.columns])
    classified = classify(flat)
    valid = limit_companies(classified.where("reason = 'valid'"), delivered or order, limit)
    jobs = upsert(
        stored, valid, ["source", "detail_url"], order, preserve=["employer_email", "employer_phone", "employer_address", "employer_website"]
    )
    snapshots = valid.select("source", "detail_url", snapshot_payload(F.col("raw"), F.col("job"), JOB_COLUMNS).alias(payload))
    return jobs, snapshots, classified
