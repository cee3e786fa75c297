"""Export layouts, counters, catalogs, lookups and keyword matches over the job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.operators.dedupe import drop_reasons, first_by_key
from leadloom.operators.upsert import upsert
from leadloom.plans import sqltext as S
from leadloom.plans import table_queries
from leadloom.plans.registry import Registry
from leadloom.session import table
from leadloom.sources.csvio import exclusion_lists

R = Registry()
c = F.col
_blank = lambda name: F.coalesce(text.strip_ws(c(name)), F.lit(""))
_empty = lambda name: f"coalesce({S.strip(name)}, '')"


# ---- export layouts ---------------------------------------------------------------------------------------------


@R.add(f"SELECT agency_id, {_empty('agency_name')} AS agency_name, {_empty('address')} AS address, {_empty('city')} AS city, {_empty('email')} AS email, "
       f"{_empty('phone_number')} AS phone_number, {_empty('website')} AS website FROM gelbeseiten_agencies")  # fmt: skip
def directory_export_rows(spark: SparkSession, d: str) -> DataFrame:
    """The directory layout of six columns, with the id beside them."""
    names = ["agency_name", "address", "city", "email", "phone_number", "website"]
    return table(spark, d, "gelbeseiten_agencies").select("agency_id", *[_blank(n).alias(n) for n in names])


@R.add(f"SELECT id, {_empty('employer_email')} AS email, '' AS first_name, '' AS last_name, {_empty('company')} AS company, {_empty('location')} AS city, "
       f"'DE' AS country, {_empty('title')} AS title, source, {_empty('category')} AS category, coalesce(CAST(published_at AS VARCHAR), '') AS published_at, "
       f"{_empty('detail_url')} AS detail_url, {_empty('employer_website')} AS employer_website FROM jobs "
       f"WHERE source = 'meinestadt' AND {S.or_null('employer_email')} IS NOT NULL")  # fmt: skip
def lead_export_rows_wide(spark: SparkSession, d: str) -> DataFrame:
    """The lead layout of twelve columns, with the id beside them; rows without an address have none."""
    rows = table(spark, d, "jobs").where((c("source") == "meinestadt") & text.clean_or_null(c("employer_email")).isNotNull())
    return rows.select(
        "id", _blank("employer_email").alias("email"), F.lit("").alias("first_name"), F.lit("").alias("last_name"),
        _blank("company").alias("company"), _blank("location").alias("city"), F.lit("DE").alias("country"), _blank("title").alias("title"),
        "source", _blank("category").alias("category"), F.coalesce(c("published_at").cast("string"), F.lit("")).alias("published_at"),
        _blank("detail_url").alias("detail_url"), _blank("employer_website").alias("employer_website"),
    )


# ---- counters ---------------------------------------------------------------------------------------------------

_LEAD_KEY = f"coalesce(nullif({S.fold('company')}, ''), lower({S.strip('email')}))"


@R.add(
    f"""WITH x AS (SELECT {S.or_null('email')} IS NULL AS missing, {_LEAD_KEY} AS k FROM hzz_ugostitelji_radnici_u_turizmu)
    SELECT count(DISTINCT k) FILTER (WHERE NOT missing) AS kept, count(*) FILTER (WHERE missing) AS skipped_missing_email,
      count(*) FILTER (WHERE NOT missing) - count(DISTINCT k) FILTER (WHERE NOT missing) AS skipped_duplicate_company FROM x"""
)
def csv_dedupe_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the company de-duplication of a lead list keeps and skips, and why."""
    return dedupe_counts(table(spark, d, "hzz_ugostitelji_radnici_u_turizmu"), "email", "company")


def dedupe_counts(leads: DataFrame, email: str, company: str) -> DataFrame:
    """(kept, skipped_missing_email, skipped_duplicate_company) of one list; an empty list gives zeros."""
    mail = text.clean_or_null(c(email))
    key = F.coalesce(F.nullif(text.fold(c(company)), F.lit("")), F.lower(mail))
    keys = leads.select(mail.isNull().alias("missing"), key.alias("k")).groupBy("missing", "k").agg(F.count(F.lit(1)).alias("n"))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return keys.agg(
        F.count_if(~c("missing")).alias("kept"), count(F.sum(F.when(c("missing"), c("n")))).alias("skipped_missing_email"),
        count(F.sum(F.when(~c("missing"), c("n") - 1))).alias("skipped_duplicate_company"),
    )


@R.add(
    f"""WITH x AS (SELECT source, count(DISTINCT {S.company_key('company', 'detail_url')}) AS available FROM jobs GROUP BY 1)
    SELECT source, available, least(available, 200) AS selected FROM x"""
)
def company_limit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Companies a delivery offers and those a limit of 200 lets through, for each source."""
    keys = table(spark, d, "jobs").select("source", text.company_key(c("company"), c("detail_url")).alias("k"))
    return keys.groupBy("source").agg(F.countDistinct("k").alias("available")).withColumn("selected", F.least("available", F.lit(200).cast("long")))


_KNOWN = f"SELECT DISTINCT lower({S.collapse('email')}) AS k FROM hzz_ugostitelji_radnici_u_turizmu WHERE lower({S.collapse('email')}) <> '' AND lead_id % 2 = 0"


@R.add(
    f"""WITH e AS ({_KNOWN}), x AS (SELECT id, {S.fold_keep('company')} AS ck, CASE WHEN {S.or_null('employer_email')} IS NULL THEN 'no_email'
        WHEN regexp_matches({S.fold('company')}, '\\b(skola|vrtic|kuhar|hotel)\\b') THEN 'excluded'
        WHEN lower({S.collapse('employer_email')}) IN (SELECT k FROM e) THEN 'known' ELSE 'kept' END AS r FROM jobs WHERE source IN ('hzz', 'mojposao')),
    y AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY id) AS rn FROM x WHERE r = 'kept')
    SELECT reason, count(*) AS n FROM (SELECT r AS reason FROM x WHERE r <> 'kept' UNION ALL SELECT CASE WHEN rn = 1 THEN 'kept' ELSE 'duplicate' END FROM y) GROUP BY 1"""
)
def export_pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    """The whole export in one plan: address filter, employer exclusion, known leads (every other one of the list, so that
    both sides occur), then one row for each company, blank companies being one company; rows counted by their fate."""
    leads = table(spark, d, "hzz_ugostitelji_radnici_u_turizmu").where("lead_id % 2 = 0")
    emails, _ = exclusion_lists([leads])
    jobs = table(spark, d, "jobs").where(c("source").isin("hzz", "mojposao")).withColumn("email_key", text.casefold_key(c("employer_email")))
    flagged = jobs.join(emails.withColumn("known", F.lit(True)), "email_key", "left").withColumn("company_key", text.fold_keep(c("company")))
    reasons = [("no_email", text.clean_or_null(c("employer_email")).isNull()), ("excluded", text.fold(c("company")).rlike(r"\b(skola|vrtic|kuhar|hotel)\b")), ("known", c("known"))]
    judged = drop_reasons(flagged, reasons).select("id", "company_key", "reason")
    first = judged.where("reason = 'kept'").groupBy("company_key").agg(F.count(F.lit(1)).alias("n"))
    fates = judged.where("reason <> 'kept'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    kept = first.agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).alias("duplicate"))
    both = kept.select(F.inline(F.array(F.struct(F.lit("kept").alias("reason"), c("kept").alias("n")), F.struct(F.lit("duplicate").alias("reason"), c("duplicate").alias("n")))))
    return fates.unionByName(both.where("n > 0"))


@R.add("SELECT count(*) FILTER (WHERE action = 'reuse') AS reused_count, count(*) FILTER (WHERE action = 'skip') AS skipped_count, "
       f"count(*) FILTER (WHERE action = 'lookup') AS open_count FROM ({table_queries.ORACLE['company_history_action']})")  # fmt: skip
def enrichment_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters over the outcome column of the company history."""
    by = lambda a, n: F.count_if(c("action") == a).alias(n)
    return table_queries.company_history_action(spark, d).agg(by("reuse", "reused_count"), by("skip", "skipped_count"), by("lookup", "open_count"))


# ---- catalogs, lookups, upserts by name --------------------------------------------------------------------------


@R.add("SELECT source, json_extract_string(filters, '$.category') AS category, count(*) AS n_runs FROM scrape_runs WHERE json_extract_string(filters, '$.category') IS NOT NULL GROUP BY 1, 2")
def category_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The categories a source is asked for, as a catalog."""
    runs = table(spark, d, "scrape_runs").select("source", F.get_json_object("filters", "$.category").alias("category"))
    return runs.where("category IS NOT NULL").groupBy("source", "category").agg(F.count(F.lit(1)).alias("n_runs"))


@R.add("SELECT id, title, company FROM jobs WHERE id = (SELECT min(id) FROM jobs)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One row by its unique id; the filter reaches the scan."""
    jobs = table(spark, d, "jobs")
    wanted = jobs.agg(F.min("id")).first()[0]
    return jobs.where(c("id") == wanted).select("id", "title", "company")


@R.add("""WITH b AS (SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'new ' || c_name, c_acctbal FROM customer WHERE c_custkey % 3 = 1)
    SELECT coalesce(c.c_name, b.name) AS name, c.c_custkey AS id, CASE WHEN b.name IS NOT NULL THEN b.balance + 1 ELSE c.c_acctbal END AS balance
    FROM customer c FULL JOIN b ON b.name = c.c_name""")  # fmt: skip
def upsert_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted or replaced by their unique name; the id stays the stored one."""
    stored = table(spark, d, "customer").select(c("c_name").alias("name"), c("c_custkey").alias("id"), c("c_acctbal").alias("balance"))
    again = stored.where("id % 3 = 0").select("name", (c("balance") + 1).alias("balance"))
    fresh = stored.where("id % 3 = 1").select(F.concat(F.lit("new "), "name").alias("name"), (c("balance") + 1).alias("balance"))
    return upsert(stored, again.unionByName(fresh), ["name"], [c("balance")])


@R.add("SELECT id, email_status FROM jobs WHERE email_status IN ('queued', 'not_sent') AND (email_enrichment_next_attempt_at IS NULL OR email_enrichment_next_attempt_at <= TIMESTAMPTZ '2026-06-01 00:00:00+00')")
def due_rows(spark: SparkSession, d: str) -> DataFrame:
    """Waiting rows whose time has come or was never set."""
    now = F.to_timestamp(F.lit("2026-06-01 00:00:00"))
    at = c("email_enrichment_next_attempt_at")
    waiting = table(spark, d, "jobs").where(c("email_status").isin("queued", "not_sent"))
    return waiting.where(at.isNull() | (at <= now)).select("id", "email_status")


@R.add(
    f"""WITH p AS (SELECT hotel_id, {S.collapse('hotel_name')} AS title, detail_url AS link, hotel_id % 30 AS city_id FROM omh_hoteli),
    f AS (SELECT * FROM p WHERE title <> '' ORDER BY hotel_id DESC LIMIT 1000), c AS (SELECT n_nationkey AS id, n_name AS name FROM nation)
    SELECT link, hotel_id, title, city FROM (SELECT f.link, f.hotel_id, f.title, coalesce(c.name, '') AS city, row_number() OVER (PARTITION BY f.link ORDER BY f.hotel_id DESC) AS rn
    FROM f LEFT JOIN c ON c.id = f.city_id) WHERE rn = 1"""
)
def directory_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts with a title, newest first, cut at the walker's limit and only then de-duplicated by link; names of their
    cities where the city is known. The limit is the feature."""
    posts = table(spark, d, "omh_hoteli").select("hotel_id", text.collapse_ws(c("hotel_name")).alias("title"), c("detail_url").alias("link"), (c("hotel_id") % 30).alias("city_id"))
    taken = posts.where("title <> ''").orderBy(F.desc("hotel_id")).limit(1_000)
    cities = table(spark, d, "nation").select(c("n_nationkey").alias("city_id"), c("n_name").alias("name"))
    named = taken.join(cities, "city_id", "left").withColumn("city", F.coalesce("name", F.lit("")))
    return first_by_key(named, c("link"), [F.desc("hotel_id")], keep_null=True).select("link", "hotel_id", "title", "city")


# ---- keyword matches ---------------------------------------------------------------------------------------------

_HAY = S.slug("coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(location, '') || ' ' || coalesce(category, '')")


@R.add(
    f"""WITH k AS (SELECT DISTINCT coalesce(json_extract_string(filters, '$.category'), '') AS keyword FROM scrape_runs),
    j AS (SELECT id, {_HAY} AS hay, {S.slug('category')} AS label FROM jobs)
    SELECT keyword, count(*) AS n FROM k JOIN j ON keyword = '' OR contains(hay, {S.slug('keyword')}) OR label = {S.slug('keyword')} GROUP BY 1"""
)
def keyword_column_match(spark: SparkSession, d: str) -> DataFrame:
    """Rows that match each keyword of a list: the keyword's slug inside the slug of title, company, place and category, or
    the category label; an empty keyword matches every row. The few keywords travel with the plan as a literal array."""
    runs = table(spark, d, "scrape_runs").select(F.coalesce(F.get_json_object("filters", "$.category"), F.lit("")).alias("k")).distinct()
    keywords = [r[0] for r in runs.limit(MAX_KEYWORDS + 1).collect()]
    if len(keywords) > MAX_KEYWORDS:
        raise ValueError("too many keywords for one pass")
    return keyword_hits(table(spark, d, "jobs"), keywords).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


MAX_KEYWORDS = 1_000  # of one pass; a longer list is refused


def keyword_hits(rows: DataFrame, keywords: list[str], fields: tuple[str, ...] = ("title", "company", "location", "category"), label: str = "category") -> DataFrame:
    """(keyword, *columns) of the rows that match; NULL fields count as empty."""
    hay = text.slug(F.concat_ws(" ", *[F.coalesce(c(n), F.lit("")) for n in fields]))
    listed = F.array(*[F.struct(F.lit(k).alias("keyword"), text.slug(F.lit(k)).alias("slug")) for k in keywords])
    match = lambda k: (k["keyword"] == "") | F.contains(c("_hay"), k["slug"]) | (c("_label") == k["slug"])
    out = rows.withColumn("_hay", hay).withColumn("_label", text.slug(c(label)))
    return out.select("*", F.explode(F.filter(listed, match)).alias("_k")).select(c("_k.keyword").alias("keyword"), *rows.columns)


@R.add(
    f"""SELECT id, keyword FROM (SELECT id, {S.slug("coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(location, '') || ' ' || coalesce(json_extract_string(job_payload, '$.description'), coalesce(json_extract_string(job_payload, '$.category'), ''))")} AS hay
      FROM (SELECT id, json_extract_string(job_payload, '$.title') AS title, json_extract_string(job_payload, '$.company') AS company, json_extract_string(job_payload, '$.location') AS location, job_payload FROM job_snapshots)) s,
      (VALUES ('kuhar'), ('Pflege')) k(keyword) WHERE contains(hay, {S.slug('keyword')})"""
)
def summary_keyword_match(spark: SparkSession, d: str) -> DataFrame:
    """Keyword match over delivered items, whose summary is their description, else their category."""
    get = lambda k: F.get_json_object("job_payload", f"$.{k}")
    items = table(spark, d, "job_snapshots").select(
        "id", get("title").alias("title"), get("company").alias("company"), get("location").alias("location"), F.coalesce(get("description"), get("category")).alias("summary")
    )
    hits = keyword_hits(items.withColumn("label", F.lit("-")), ["kuhar", "Pflege"], ("title", "company", "location", "summary"), "label")
    return hits.select("id", "keyword")


@R.add(
    """WITH d AS (SELECT doc_id, text, string_split(text, '@') AS parts FROM documents WHERE contains(text, '@')),
    e AS (SELECT doc_id, text, generate_series AS i, list_sum(list_transform(parts[1:generate_series], lambda x: length(x) + 1)) AS p
      FROM d, generate_series(1, len(parts) - 1))
    SELECT doc_id, CAST(i AS BIGINT) AS hit_no, substring(text, greatest(CAST(e.p AS BIGINT) - 120, 1), 121 + least(CAST(e.p AS BIGINT) - 1, 120)) AS around FROM e"""
)
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    """120 characters either side of every at sign."""
    docs = table(spark, d, "documents").where(c("text").contains("@")).withColumn("parts", F.split("text", "@", -1))
    ends = docs.select("doc_id", "text", F.posexplode(
        F.slice(F.aggregate("parts", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1))), F.lit(2), F.size("parts") - 1)
    ).alias("i", "at"))
    begin = F.greatest(c("at") - 120, F.lit(1))
    return ends.select("doc_id", (c("i") + 1).cast("long").alias("hit_no"), F.substring(c("text"), begin, F.lit(121) + F.least(c("at") - 1, F.lit(120))).alias("around"))


QUERIES, ORACLE = R.queries, R.sql

