"""Queries over selections, joins, de-duplication, aggregates, windows, set operations and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import text, urls
from leadloom.functions.extract import is_email
from leadloom.operators.admission import admit
from leadloom.operators.allocation import cascade, cut_per_group
from leadloom.operators.dedupe import drop_reasons, first_by_key
from leadloom.operators.upsert import append_new, update_from, upsert
from leadloom.plans import enrich, ingest
from leadloom.plans import sqltext as S
from leadloom.plans.registry import Registry
from leadloom.session import shared_folder, table
from leadloom.sources.csvio import exclusion_lists, read_csv, write_csv
from leadloom.sources.raw import raw_items

R = Registry()
c = F.col
NOW = "2026-03-09 04:00:00"

# ---- normalisers ------------------------------------------------------------------------------------------------

_P = "json_extract_string(job_payload, '$.{}')"


def _v(name: str) -> str:
    return S.or_null(_P.format(name))


def _date(x: str) -> str:
    v = rf"regexp_replace({x}, '{S.WS}+', '', 'g')"
    return (
        rf"CAST(coalesce(try_strptime(CASE WHEN regexp_matches({v}, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}\.?$') THEN rtrim({v}, '.') END, '%d.%m.%Y'), "
        rf"try_strptime(CASE WHEN regexp_matches({v}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN {v} END, '%Y-%m-%d')) AS DATE)"
    )


def _normal_sql(source: str, **over: str) -> str:
    cols = {k: _v(k) for k in ("title", "company", "location", "detail_url")} | {"source": f"'{source}'"} | over
    body = ", ".join(f"{cols[k]} AS {k}" for k in ingest.JOB_COLUMNS)
    return f"SELECT id, {body} FROM job_snapshots WHERE source = '{source}'"


def _normalized(spark: SparkSession, d: str, source: str) -> DataFrame:
    rows = table(spark, d, "job_snapshots").where(c("source") == source)
    items = raw_items(rows.drop("source", "detail_url"), "job_payload", source)
    return ingest.normalized(items, source).select("id", "job.*")


N = "CAST(NULL AS VARCHAR)"


@R.add(_normal_sql("hzz", category=N, published_at=_date(_v("valid_from")), employer_website=N, employer_email=_v("email"),
                   employer_address=_v("employer_address"), employer_phone=_v("phone")))
def normalize_hzz(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, "hzz")


@R.add(_normal_sql("mojposao", category=_v("category"), published_at=_date(_v("published_at")), employer_website=_v("employer_website"),
                   employer_email=N, employer_address=N, employer_phone=N))
def normalize_mojposao(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, "mojposao")


@R.add(_normal_sql("meinestadt", category=_v("category"), published_at=_date(_v("published_at")), employer_website=_v("employer_website"),
                   employer_email=f"coalesce({_v('employer_email')}, {_v('email')})", employer_address=N, employer_phone=N))
def normalize_meinestadt(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, "meinestadt")


@R.add(_normal_sql("gelbeseiten", title=f"coalesce({_v('title')}, {_v('company')})", location=f"coalesce({_v('city')}, {_v('location')})",
                   category=N, published_at="CAST(NULL AS DATE)", employer_website=f"coalesce({_v('employer_website')}, {_v('website')})",
                   employer_email=_v("email"), employer_address=f"coalesce({_v('employer_address')}, {_v('address')})", employer_phone=_v("phone")))
def normalize_gelbeseiten(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d, "gelbeseiten")


@R.add("SELECT id, title, coalesce(company, '') AS company, detail_url, coalesce(category, '') AS category, 'hr' AS raw_lang FROM jobs")
def snapshot_payload(spark: SparkSession, d: str) -> DataFrame:
    """Raw item overlaid by canonical fields as JSON, read back field by field."""
    rows = table(spark, d, "jobs").select(
        "id", F.struct(F.lit("raw").alias("title"), F.lit("hr").alias("lang")).alias("raw"),
        F.struct("title", "company", "detail_url", "category").alias("job"),
    )
    out = rows.select("id", ingest.snapshot_payload(c("raw"), c("job"), ["title", "company", "detail_url", "category"]).alias("p"))
    get = lambda k: F.get_json_object("p", f"$.{k}")
    return out.select(
        "id", get("title").alias("title"), F.coalesce(get("company"), F.lit("")).alias("company"), get("detail_url").alias("detail_url"),
        F.coalesce(get("category"), F.lit("")).alias("category"), get("lang").alias("raw_lang"),
    )


@R.add(f"SELECT id, lower({S.collapse('employer_email')}) AS email, '' AS first_name, '' AS last_name, {S.collapse('company')} AS company, "
       f"{S.collapse('location')} AS city, 'HR' AS country FROM jobs WHERE source = 'hzz' AND employer_email IS NOT NULL")  # fmt: skip
def lead_export_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").where("source = 'hzz' AND employer_email IS NOT NULL")
    return rows.select(
        "id", text.casefold_key(c("employer_email")).alias("email"), F.lit("").alias("first_name"), F.lit("").alias("last_name"),
        text.collapse_ws(c("company")).alias("company"), text.collapse_ws(c("location")).alias("city"), F.lit("HR").alias("country"),
    )


@R.add(f"SELECT j.id, coalesce({S.or_null('j.employer_address')}, {_v('address')}) AS address, coalesce({S.or_null('j.employer_phone')}, {_v('phone')}) AS phone "
       "FROM jobs j LEFT JOIN (SELECT detail_url, max_by(job_payload, (scraped_at, id)) AS job_payload FROM job_snapshots WHERE source = 'gelbeseiten' GROUP BY 1) s "
       "USING (detail_url) WHERE j.source = 'gelbeseiten'")  # fmt: skip
def gap_fill_merge(spark: SparkSession, d: str) -> DataFrame:
    """Detail fields fill only what the listing left empty."""
    latest = (
        table(spark, d, "job_snapshots").where("source = 'gelbeseiten'").groupBy("detail_url")
        .agg(F.max_by("job_payload", F.struct("scraped_at", "id")).alias("p"))
    )
    jobs = table(spark, d, "jobs").where("source = 'gelbeseiten'").join(latest, "detail_url", "left")
    fill = lambda col, key: F.coalesce(text.clean_or_null(c(col)), text.clean_or_null(F.get_json_object("p", f"$.{key}")))
    return jobs.select("id", fill("employer_address", "address").alias("address"), fill("employer_phone", "phone").alias("phone"))


# ---- selections -------------------------------------------------------------------------------------------------


def email_targets(jobs: DataFrame, source: str | None = None, run_id: str | None = None, ids: DataFrame | None = None,
                  only_not_emailed: bool = True, require_email: bool = True) -> DataFrame:
    """Optional predicates, each left out when not given; latest update first."""
    out = jobs
    if source:
        out = out.where(c("source") == source)
    if run_id:
        out = out.where(c("last_run_id") == run_id)
    if ids is not None:
        out = out.join(ids, "id", "left_semi")
    if only_not_emailed:
        out = out.where(c("email_status") != "sent")
    if require_email:
        out = out.where(c("employer_email").isNotNull())
    return out.orderBy(F.desc("updated_at"), "id")


@R.add("SELECT id, company, employer_email FROM jobs WHERE source = 'hzz' AND email_status <> 'sent' AND employer_email IS NOT NULL")
def target_selection(spark: SparkSession, d: str) -> DataFrame:
    return email_targets(table(spark, d, "jobs"), source="hzz").select("id", "company", "employer_email")


@R.add("SELECT id, source FROM jobs WHERE id IN (SELECT job_id FROM job_groups)")
def id_list_semi_join(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "job_groups").select(c("job_id").alias("id"))
    return email_targets(table(spark, d, "jobs"), ids=ids, only_not_emailed=False, require_email=False).select("id", "source")


@R.add(f"SELECT id, last_run_id FROM jobs WHERE employer_email IS NULL AND NOT email_enrichment_unusable AND "
       f"(email_enrichment_next_attempt_at IS NULL OR email_enrichment_next_attempt_at <= TIMESTAMPTZ '{NOW}+00')")  # fmt: skip
def pending_due(spark: SparkSession, d: str) -> DataFrame:
    due = c("email_enrichment_next_attempt_at").isNull() | (c("email_enrichment_next_attempt_at") <= F.lit(NOW).cast("timestamp"))
    return table(spark, d, "jobs").where(c("employer_email").isNull() & ~c("email_enrichment_unusable") & due).select("id", "last_run_id")


_CLASS = (
    f"CASE WHEN detail_url IS NULL THEN 'invalid' WHEN regexp_matches({S.fold('company')}, '\\b(skola|vrtic)\\b') THEN 'excluded' ELSE 'valid' END"
)


@R.add(f"SELECT id, {_CLASS} AS reason FROM jobs")
def employer_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return ingest.classify(table(spark, d, "jobs")).select("id", "reason")


# Terms whose presence anywhere in a folded company keeps it out of lead exports.
EXPORT_TERMS = ("skola", "vrtic", "dom za njegu", "zeitarbeit")


@R.add("SELECT id FROM jobs WHERE NOT (" + " OR ".join(f"contains({S.fold_keep('company')}, '{t}')" for t in EXPORT_TERMS) + ")")
def export_exclusion(spark: SparkSession, d: str) -> DataFrame:
    key = text.fold_keep(c("company"))
    hit = F.lit(False)
    for t in EXPORT_TERMS:
        hit = hit | key.contains(t)
    return table(spark, d, "jobs").where(~hit).select("id")


_HAY = S.slug("coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(location, '') || ' ' || coalesce(category, '')")


@R.add(f"SELECT id FROM jobs WHERE contains({_HAY}, {S.slug(chr(39) + 'Kuhar' + chr(39))})")
def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n: F.coalesce(c(n), F.lit(""))
    hay = text.slug(F.concat_ws(" ", part("title"), part("company"), part("location"), part("category")))
    return table(spark, d, "jobs").where(hay.contains("kuhar")).select("id")


@R.add(f"SELECT id FROM jobs WHERE {S.or_null('company')} IS NOT NULL AND {S.or_null('location')} IS NOT NULL")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    some = text.clean_or_null(c("company")).isNotNull() & text.clean_or_null(c("location")).isNotNull()
    return table(spark, d, "jobs").where(some).select("id")


@R.add("SELECT source, count(*) AS n FROM job_snapshots WHERE scraped_at >= TIMESTAMPTZ '2026-02-16 00:00:00+00' AND scraped_at < TIMESTAMPTZ '2026-02-23 00:00:00+00' GROUP BY 1")
def time_range_count(spark: SparkSession, d: str) -> DataFrame:
    """Half-open range, counted where the rows are."""
    at = c("scraped_at")
    inside = (at >= F.lit("2026-02-16").cast("timestamp")) & (at < F.lit("2026-02-23").cast("timestamp"))
    return table(spark, d, "job_snapshots").where(inside).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---- joins ------------------------------------------------------------------------------------------------------


def resolve_category(labels: DataFrame, catalog: DataFrame) -> DataFrame:
    """``labels`` (label) with the catalog (key, name) entry whose key or slug of key or name they are."""
    keys = catalog.select("key", F.explode(F.array_distinct(F.array("key", text.slug(c("key")), text.slug(c("name"))))).alias("_s"))
    first = keys.groupBy("_s").agg(F.min("key").alias("key"))
    named = labels.withColumn("_exact", c("label")).withColumn("_s", text.slug(c("label")))
    exact = catalog.select(c("key").alias("_exact"), c("key").alias("_k"))
    return named.join(exact, "_exact", "left").join(first, "_s", "left").withColumn("key", F.coalesce("_k", "key")).drop("_s", "_exact", "_k")


@R.add(
    f"""WITH cat AS (SELECT DISTINCT {S.slug("json_extract_string(filters, '$.category')")} AS key FROM scrape_runs)
    SELECT j.id, cat.key AS category_key FROM jobs j LEFT JOIN cat ON cat.key = {S.slug('j.category')}"""
)
def category_resolution(spark: SparkSession, d: str) -> DataFrame:
    name = F.get_json_object("filters", "$.category")
    runs = table(spark, d, "scrape_runs").select(text.slug(name).alias("key"), name.alias("name"))
    catalog = runs.groupBy("key").agg(F.min("name").alias("name"))
    labels = table(spark, d, "jobs").select("id", c("category").alias("label"))
    return resolve_category(labels, catalog).select("id", c("key").alias("category_key"))


_MAIL = S.collapse("employer_email")
_LOCAL = f"lower(split_part({_MAIL}, '@', 1))"
_SCORE = (
    "CASE " + " ".join(f"WHEN contains({_LOCAL}, '{w}') THEN {100 - i}" for i, w in enumerate(enrich.PREFERRED_LOCAL)) + " ELSE 0 END"
    f" - CASE WHEN {' OR '.join(f"contains({_LOCAL}, '{w}')" for w in enrich.LOW_LOCAL)} THEN 50 ELSE 0 END + greatest(20 - length({_LOCAL}), 0)"
)


@R.add(
    f"""WITH last AS (SELECT source, arg_max(id, (created_at, id)) AS run FROM scrape_runs WHERE status = 'completed' GROUP BY 1),
    x AS (SELECT j.*, {S.fold('company')} AS k, {S.is_email(_MAIL)} AS ok, coalesce(l.run = j.last_run_id, false) AS newest FROM jobs j LEFT JOIN last l ON l.source = j.source),
    b AS (SELECT id, k FROM x WHERE newest AND coalesce(NOT ok, true) AND k <> ''),
    h AS (SELECT k, {_MAIL} AS e, ok, updated_at, {_SCORE} AS s, coalesce(email_enrichment_unusable, false) OR coalesce(email_enrichment_attempt_count, 0) > 0
            OR email_enrichment_last_attempt_at IS NOT NULL AS f FROM x WHERE k <> '' AND id NOT IN (SELECT id FROM b)),
    a AS (SELECT k, arg_max(e, (s, updated_at, e)) FILTER (WHERE ok) AS known_email, bool_or(f) AS had_failure FROM h GROUP BY k)
    SELECT b.id, CASE WHEN a.known_email IS NOT NULL THEN 'reuse' WHEN a.had_failure THEN 'skip' ELSE 'lookup' END AS action, a.known_email
    FROM b LEFT JOIN a ON a.k = b.k"""
)
def company_history_action(spark: SparkSession, d: str) -> DataFrame:
    """What to do with the newest run's rows without an address, by the history of their company; a row is no part of
    its own history."""
    runs = table(spark, d, "scrape_runs").where("status = 'completed'")
    last = runs.groupBy("source").agg(F.max(F.struct("created_at", "id"))["id"].alias("run"))
    jobs = table(spark, d, "jobs").withColumn("company_key", text.fold(c("company"))).where("company_key <> ''").join(last, "source", "left")
    missing = ~F.coalesce(is_email(text.collapse_ws(c("employer_email"))), F.lit(False))
    jobs = jobs.withColumn("in_batch", F.coalesce(c("run") == c("last_run_id"), F.lit(False)) & missing)
    history = enrich.company_history(jobs.where("NOT in_batch"), c("company_key"))
    rows = jobs.where("in_batch").select("id", "company_key").join(history, "company_key", "left")
    action = F.when(c("known_email").isNotNull(), "reuse").when(c("had_failure"), "skip").otherwise("lookup")
    return rows.select("id", action.alias("action"), "known_email")


def _seed(key: str) -> str:
    return (
        f"SELECT {key} AS k, min(e) AS e FROM (SELECT *, CASE WHEN {S.is_email('trim(email)')} THEN lower({S.collapse('email')}) END AS e FROM gelbeseiten_agencies) "
        f"WHERE coalesce({key}, '') <> '' AND e IS NOT NULL GROUP BY 1 HAVING count(DISTINCT e) = 1"
    )


_US = S.with_scheme(r"regexp_replace(website, '[\s\pZ]+', '', 'g')")
_WK = (
    f"(CASE WHEN coalesce({S.url_part(_US, 2)}, '') <> '' THEN regexp_replace(lower({S.url_part(_US, 1)}) || '://' || lower({S.url_part(_US, 2)}) || {S.url_part(_US, 3)}, '/+$', '') ELSE '' END)"
)
_CK, _HK = f"lower({S.collapse('agency_name')})", S.host("website")


@R.add(
    f"""WITH w AS ({_seed(_WK)}), n AS ({_seed(_CK)}), h AS ({_seed(_HK)}),
    a AS (SELECT agency_id, CASE WHEN {S.is_email('trim(email)')} THEN 1 END AS has, {_WK} AS wk, {_CK} AS ck, {_HK} AS hk FROM gelbeseiten_agencies)
    SELECT agency_id, CASE WHEN has IS NULL THEN coalesce(w.e, n.e, h.e) END AS reused_email,
      CASE WHEN has IS NULL THEN CASE WHEN w.e IS NOT NULL THEN 'website' WHEN n.e IS NOT NULL THEN 'company' WHEN h.e IS NOT NULL THEN 'host' END END AS reused_by
    FROM a LEFT JOIN w ON w.k = nullif(wk, '') LEFT JOIN n ON n.k = nullif(ck, '') LEFT JOIN h ON h.k = nullif(hk, '')"""
)
def email_reuse_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gelbeseiten_agencies")
    return enrich.reuse_emails(rows, "email", "website", "agency_name").select("agency_id", "reused_email", "reused_by")


@R.add(
    f"""WITH e AS (SELECT DISTINCT lower({S.collapse('email')}) AS k FROM hzz_ugostitelji_radnici_u_turizmu WHERE lower({S.collapse('email')}) <> ''),
    n AS (SELECT DISTINCT {S.fold_keep('company')} AS k FROM hzz_ugostitelji_radnici_u_turizmu WHERE {S.fold_keep('company')} <> '')
    SELECT id FROM jobs WHERE source = 'hzz' AND lower({S.collapse('employer_email')}) NOT IN (SELECT k FROM e) AND {S.fold_keep('company')} NOT IN (SELECT k FROM n)"""
)
def exclusion_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Two hash anti joins in place of one join on an OR."""
    emails, companies = exclusion_lists([table(spark, d, "hzz_ugostitelji_radnici_u_turizmu")])
    jobs = table(spark, d, "jobs").where("source = 'hzz'").select(
        "id", text.casefold_key(c("employer_email")).alias("email_key"), text.fold_keep(c("company")).alias("company_key")
    )
    return jobs.join(emails, "email_key", "left_anti").join(companies, "company_key", "left_anti").select("id")


@R.add(
    f"""WITH e AS (SELECT DISTINCT lower({S.collapse('email')}) AS k FROM hzz_ugostitelji_radnici_u_turizmu WHERE lower({S.collapse('email')}) <> '')
    SELECT CASE WHEN employer_email IS NULL THEN 'no_email' WHEN regexp_matches({S.fold('company')}, '\\b(skola|vrtic)\\b') THEN 'excluded'
      WHEN lower({S.collapse('employer_email')}) IN (SELECT k FROM e) THEN 'known' ELSE 'kept' END AS reason, count(*) AS n FROM jobs WHERE source = 'hzz' GROUP BY 1"""
)
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """Mutually exclusive reasons in a fixed order."""
    emails, _ = exclusion_lists([table(spark, d, "hzz_ugostitelji_radnici_u_turizmu")])
    jobs = table(spark, d, "jobs").where("source = 'hzz'").withColumn("email_key", text.casefold_key(c("employer_email")))
    flagged = jobs.join(emails.withColumn("known", F.lit(True)), "email_key", "left")
    reasons = [("no_email", c("employer_email").isNull()), ("excluded", ingest.is_excluded_employer(c("company"))), ("known", c("known"))]
    return drop_reasons(flagged, reasons).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT r.id AS run_id, r.status, count(s.id) AS n_rows, count(DISTINCT s.detail_url) AS n_listings FROM scrape_runs r LEFT JOIN job_snapshots s ON s.run_id = r.id GROUP BY 1, 2")
def run_children(spark: SparkSession, d: str) -> DataFrame:
    """One to many; the children are counted before the join, so a run with a tenth of all rows stays one row."""
    rows = (
        table(spark, d, "job_snapshots").groupBy("run_id")
        .agg(F.count("id").alias("n_rows"), F.countDistinct("detail_url").alias("n_listings"))
    )
    runs = table(spark, d, "scrape_runs").select(c("id").alias("run_id"), "status")
    return runs.join(rows, "run_id", "left").na.fill(0, ["n_rows", "n_listings"])


@R.add(
    """WITH x AS (SELECT c_custkey, unnest([c_nationkey + 20, c_nationkey, (c_nationkey + 7) % 25]) AS k, unnest([0, 1, 2]) AS pos FROM customer)
    SELECT c_custkey, arg_min(n_name, pos) AS city FROM x JOIN nation ON n_nationkey = k GROUP BY 1"""
)
def city_lookup_first_match(spark: SparkSession, d: str) -> DataFrame:
    """First id of an ordered list that the lookup knows."""
    nk = c("c_nationkey")
    ids = table(spark, d, "customer").select("c_custkey", F.posexplode(F.array(nk + 20, nk, (nk + 7) % 25)).alias("pos", "n_nationkey"))
    return ids.join(table(spark, d, "nation"), "n_nationkey").groupBy("c_custkey").agg(F.min_by("n_name", "pos").alias("city"))


_RULES = [("all", None, True), ("hzz only", "hzz", True), ("off", "hzz", False), ("de", "meinestadt", True)]


@R.add(
    """WITH rules(name, source, enabled) AS (VALUES ('all', NULL, true), ('hzz only', 'hzz', true), ('off', 'hzz', false), ('de', 'meinestadt', true))
    SELECT r.id AS run_id, rules.name AS rule FROM scrape_runs r JOIN rules ON enabled AND (rules.source IS NULL OR rules.source = r.source)"""
)
def rule_theta_join(spark: SparkSession, d: str) -> DataFrame:
    """Rules without a source match every run. The few rules travel with the plan as a literal array, so no run is moved."""
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(source).cast("string").alias("source")) for name, source, on in _RULES if on])
    match = lambda r: r["source"].isNull() | (r["source"] == c("source"))
    runs = table(spark, d, "scrape_runs")
    return runs.select(c("id").alias("run_id"), F.explode(F.filter(rules, match)).alias("r")).select("run_id", c("r.rule").alias("rule"))


@R.add(
    """WITH t(template_id, subject) AS (VALUES (1, 'first'), (2, NULL))
    SELECT n_nationkey, coalesce(t.subject, n_name) AS subject FROM nation LEFT JOIN t ON t.template_id = n_regionkey"""
)
def template_override(spark: SparkSession, d: str) -> DataFrame:
    """A stored template replaces the inline content."""
    templates = spark.createDataFrame([(1, "first"), (2, None)], "n_regionkey int, subject string")
    rows = table(spark, d, "nation").join(templates, "n_regionkey", "left")
    return rows.select("n_nationkey", F.coalesce("subject", "n_name").alias("subject"))


@R.add(
    f"""WITH k AS (SELECT {S.host('website')} AS host, min(agency_id) AS first_id, count(*) AS n FROM gelbeseiten_agencies WHERE website IS NOT NULL GROUP BY 1)
    SELECT a.agency_id, k.first_id, k.n FROM gelbeseiten_agencies a JOIN k ON k.host = {S.host('a.website')} WHERE a.website IS NOT NULL"""
)
def result_join_by_host(spark: SparkSession, d: str) -> DataFrame:
    """One lookup result per host, joined back to all rows of the host."""
    rows = table(spark, d, "gelbeseiten_agencies").where("website IS NOT NULL").select("agency_id", urls.website_host(c("website")).alias("host"))
    found = rows.groupBy("host").agg(F.min("agency_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return rows.join(found, "host").select("agency_id", "first_id", "n")


# ---- de-duplication ---------------------------------------------------------------------------------------------


@R.add(
    f"""WITH x AS (SELECT id, {S.company_key('company', 'detail_url')} AS k FROM jobs), y AS (SELECT k, min(id) AS id FROM x GROUP BY 1)
    SELECT id, k AS company_key FROM y ORDER BY id LIMIT 200"""
)
def company_limit_first(spark: SparkSession, d: str) -> DataFrame:
    """The feature itself is a limit: the first row of each company, 200 companies."""
    jobs = table(spark, d, "jobs")
    out = ingest.limit_companies(jobs, [c("id")], 200)
    return out.select("id", text.company_key(c("company"), c("detail_url")).alias("company_key"))


@R.add(f"SELECT count(DISTINCT nullif({S.fold('company')}, '')) AS companies, count(*) AS n FROM jobs")
def company_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").agg(F.countDistinct(F.nullif(text.fold(c("company")), F.lit(""))).alias("companies"), F.count(F.lit(1)).alias("n"))


@R.add(
    f"""WITH x AS (SELECT id, lower({S.strip('employer_email')}) AS k, updated_at FROM jobs WHERE {S.or_null('employer_email')} IS NOT NULL)
    SELECT id, k AS recipient FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY updated_at DESC, id) AS rn FROM x) WHERE rn = 1"""
)
def recipient_dedupe(spark: SparkSession, d: str) -> DataFrame:
    key = F.lower(text.clean_or_null(c("employer_email")))
    out = first_by_key(table(spark, d, "jobs"), key, [F.desc("updated_at"), c("id")])
    return out.select("id", key.alias("recipient"))


@R.add(
    f"""WITH x AS (SELECT lead_id, coalesce(nullif({S.fold('company')}, ''), {S.fold('email')}) AS k FROM hzz_ugostitelji_radnici_u_turizmu WHERE {S.or_null('email')} IS NOT NULL)
    SELECT min(lead_id) AS lead_id, k AS company_key FROM x GROUP BY k"""
)
def csv_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Rows without e-mail dropped, then the first row of each folded company, else e-mail."""
    leads = table(spark, d, "hzz_ugostitelji_radnici_u_turizmu").where(text.clean_or_null(c("email")).isNotNull())
    key = F.coalesce(F.nullif(text.fold(c("company")), F.lit("")), text.fold(c("email")))
    return first_by_key(leads, key, [c("lead_id")]).select("lead_id", key.alias("company_key"))


@R.add(f"SELECT min(id) AS id FROM jobs GROUP BY lower({S.collapse('title')}), lower({S.collapse('company')})")
def title_company_dedupe(spark: SparkSession, d: str) -> DataFrame:
    key = F.struct(text.casefold_key(c("title")), text.casefold_key(c("company")))
    return first_by_key(table(spark, d, "jobs"), key, [c("id")]).select("id")


@R.add("SELECT id, run_id, detail_url FROM (SELECT *, row_number() OVER (PARTITION BY run_id, detail_url ORDER BY scraped_at, id) AS rn FROM job_snapshots) WHERE rn = 1")
def listing_dedupe_in_run(spark: SparkSession, d: str) -> DataFrame:
    out = first_by_key(table(spark, d, "job_snapshots"), F.struct("run_id", "detail_url"), [c("scraped_at"), c("id")])
    return out.select("id", "run_id", "detail_url")


@R.add(f"SELECT min(id) AS id, coalesce(nullif({S.slug_hr('company')}, ''), detail_url) AS k FROM jobs WHERE source = 'hzz' GROUP BY 2")
def slug_company_first(spark: SparkSession, d: str) -> DataFrame:
    key = F.coalesce(F.nullif(text.slug_hr(c("company")), F.lit("")), c("detail_url"))
    return first_by_key(table(spark, d, "jobs").where("source = 'hzz'"), key, [c("id")]).select("id", key.alias("k"))


@R.add(
    f"""WITH e AS (SELECT doc_id, unnest(l) AS email, unnest(generate_series(1, len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{S.EMAIL}') AS l FROM documents)),
    f AS (SELECT doc_id, email, min(pos) AS pos FROM e GROUP BY 1, 2)
    SELECT doc_id, string_agg(email, '|' ORDER BY pos) AS emails FROM f GROUP BY 1"""
)
def ordered_unique_values(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(S.EMAIL), 0))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, "|").alias("emails")).where("emails <> ''")


# ---- aggregates -------------------------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed' ELSE 'queued' END"


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Delivery-like rows over the event table: one campaign per user."""
    return table(spark, d, "events").select("event_id", c("user_id").alias("campaign"), "ts", F.expr(_STATUS).alias("status"))


@R.add(
    f"""SELECT user_id AS campaign, count(*) AS total, count(*) FILTER (WHERE {_STATUS} = 'sent') AS sent, count(*) FILTER (WHERE {_STATUS} = 'failed') AS failed,
    count(*) FILTER (WHERE {_STATUS} = 'queued') AS queued FROM events GROUP BY 1"""
)
def campaign_rollup(spark: SparkSession, d: str) -> DataFrame:
    count = lambda s: F.count_if(c("status") == s).alias(s)
    return _deliveries(spark, d).groupBy("campaign").agg(F.count(F.lit(1)).alias("total"), count("sent"), count("failed"), count("queued"))


@R.add(f"SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE {_STATUS} = 'sent' GROUP BY 1")
def daily_sent_count(spark: SparkSession, d: str) -> DataFrame:
    return _deliveries(spark, d).where("status = 'sent'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"SELECT {S.fold('company')} AS company_key, arg_max(employer_email, (updated_at, id)) AS email FROM jobs WHERE employer_email IS NOT NULL AND {S.fold('company')} <> '' GROUP BY 1")
def last_wins_reuse_map(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").withColumn("company_key", text.fold(c("company"))).where("employer_email IS NOT NULL AND company_key <> ''")
    return rows.groupBy("company_key").agg(F.max_by("employer_email", F.struct("updated_at", "id")).alias("email"))


@R.add(f"SELECT {S.host('website')} AS host, arg_min(website, agency_id) AS website FROM gelbeseiten_agencies WHERE website IS NOT NULL GROUP BY 1")
def first_website_per_host(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gelbeseiten_agencies").where("website IS NOT NULL")
    return rows.groupBy(urls.website_host(c("website")).alias("host")).agg(F.min_by("website", "agency_id").alias("website"))


@R.add(
    f"""SELECT last_run_id, count(*) AS scraped_count, count(*) FILTER (WHERE {_CLASS} = 'valid') AS upserted_count, count(*) FILTER (WHERE {_CLASS} = 'invalid') AS failed_count,
    count(*) FILTER (WHERE {_CLASS} = 'excluded') AS excluded_count FROM jobs GROUP BY 1"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest.run_summary(ingest.classify(table(spark, d, "jobs")), ["last_run_id"])


@R.add(
    f"""WITH x AS (SELECT {S.fold('company')} AS k, id, employer_email FROM jobs)
    SELECT k AS company_key, count(*) AS n, min(id) AS first_id, count(employer_email) AS with_email FROM x WHERE k <> '' GROUP BY 1"""
)
def company_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").withColumn("company_key", text.fold(c("company"))).where("company_key <> ''")
    return rows.groupBy("company_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.count("employer_email").alias("with_email"))


@R.add(
    f"""WITH r AS ({R.sql["email_reuse_priority"]}), a AS (SELECT r.*, coalesce({S.is_email('trim(email)')}, false) AS has FROM gelbeseiten_agencies JOIN r USING (agency_id))
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT has) AS missing_before, count(*) FILTER (WHERE reused_by = 'website') AS by_website,
      count(*) FILTER (WHERE reused_by = 'company') AS by_company, count(*) FILTER (WHERE reused_by = 'host') AS by_host,
      count(*) FILTER (WHERE NOT has AND reused_email IS NULL) AS missing_after FROM a"""
)
def enrichment_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many addresses were missing before and after reuse, and by which key they were filled."""
    rows = enrich.reuse_emails(table(spark, d, "gelbeseiten_agencies"), "email", "website", "agency_name")
    missing = ~F.coalesce(is_email(F.trim("email")), F.lit(False))
    by = lambda k: F.count_if(c("reused_by") == k).alias(f"by_{k}")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("missing_before"), by("website"), by("company"), by("host"),
        F.count_if(missing & c("reused_email").isNull()).alias("missing_after"),
    )


# ---- windows and shares -----------------------------------------------------------------------------------------


@R.add("SELECT source, arg_max(id, (updated_at, id)) AS run_id, epoch_us(max(updated_at)) AS updated_us FROM scrape_runs GROUP BY 1")
def latest_row_per_source(spark: SparkSession, d: str) -> DataFrame:
    latest = F.max(F.struct("updated_at", "id")).alias("m")
    return table(spark, d, "scrape_runs").groupBy("source").agg(latest).select("source", c("m.id").alias("run_id"), F.unix_micros(c("m.updated_at")).alias("updated_us"))


_QUOTA = 700
_CASCADE = f"""WITH q AS (SELECT user_id AS campaign, min(ts) AS created, count(*) AS queued FROM events WHERE {_STATUS} = 'queued' GROUP BY 1),
  a AS (SELECT campaign, queued, CAST(greatest(0, least(queued, {_QUOTA} - coalesce(sum(queued) OVER (ORDER BY created, campaign ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allotted FROM q)"""


def _allotted(spark: SparkSession, d: str) -> DataFrame:
    queued = (
        _deliveries(spark, d).where("status = 'queued'").groupBy("campaign").agg(F.min("ts").alias("created"), F.count(F.lit(1)).alias("queued"))
    )
    return cascade(queued, "queued", [c("created"), c("campaign")], F.lit(_QUOTA))


@R.add(f"{_CASCADE} SELECT campaign, queued, allotted FROM a")
def quota_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _allotted(spark, d).select("campaign", "queued", "allotted")


@R.add(
    f"""{_CASCADE}, r AS (SELECT event_id, user_id AS campaign, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE {_STATUS} = 'queued')
    SELECT r.event_id, r.campaign FROM r JOIN a USING (campaign) WHERE rn <= allotted"""
)
def quota_cut_per_campaign(spark: SparkSession, d: str) -> DataFrame:
    rows = _deliveries(spark, d).where("status = 'queued'")
    allotted = _allotted(spark, d).select("campaign", "allotted").where("allotted > 0")
    return cut_per_group(rows, "campaign", [c("ts"), c("event_id")], allotted).select("event_id", "campaign")


@R.add(
    r"""WITH h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1))) AS link FROM documents),
    r AS (SELECT doc_id, link, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN contains(link, '.test') THEN 1 ELSE 0 END DESC, link DESC) AS rank FROM h)
    SELECT doc_id, link, rank FROM r WHERE rank <= 3"""
)
def priority_links(spark: SparkSession, d: str) -> DataFrame:
    """The page budget is the feature: the three best distinct links of a page by (score, link), descending."""
    from leadloom.functions.extract import hrefs

    score = F.when(c("link").contains(".test"), 1).otherwise(0)
    links = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(hrefs(c("text")))).alias("link"))
    w = Window.partitionBy("doc_id").orderBy(score.desc(), F.desc("link"))
    return links.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("doc_id", "link", c("rank").cast("long").alias("rank"))


@R.add("SELECT id, source FROM scrape_runs ORDER BY created_at DESC, id LIMIT 10")
def newest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: the ten newest runs."""
    return table(spark, d, "scrape_runs").orderBy(F.desc("created_at"), "id").limit(10).select("id", "source")


@R.add("SELECT n_nationkey, n_name AS link FROM nation UNION ALL SELECT n_nationkey, 'u' || n_name FROM nation")
def link_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Links delivered as texts or as objects with a url."""
    links = F.format_string('["%s", {"url": "u%s", "text": "x"}]', c("n_name"), c("n_name"))
    each = table(spark, d, "nation").select("n_nationkey", F.explode(F.from_json(links, "array<string>")).alias("l"))
    return each.select("n_nationkey", F.coalesce(F.get_json_object("l", "$.url"), c("l")).alias("link"))


@R.add(
    """SELECT doc_id, substring(text, greatest(strpos(text, 'Pitanje') - 20, 1), 20 + least(strpos(text, 'Pitanje') - 20, 1) - 1 + length('Pitanje') + 20) AS around
    FROM documents WHERE strpos(text, 'Pitanje') > 20"""
)
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Twenty characters either side of the first hit."""
    at = F.instr("text", "Pitanje")
    rows = table(spark, d, "documents").where(at > 20)
    return rows.select("doc_id", F.substring(c("text"), at - 20, F.lit(20 + 7 + 20)).alias("around"))


# ---- set operations ---------------------------------------------------------------------------------------------


@R.add(
    """SELECT 'hotel' AS kind, CAST(hotel_id AS VARCHAR) AS id, hotel_name AS name, city FROM omh_hoteli
    UNION ALL SELECT 'agency', CAST(agency_id AS VARCHAR), agency_name, city FROM gelbeseiten_agencies
    UNION ALL SELECT 'lead', CAST(lead_id AS VARCHAR), company, city FROM hzz_ugostitelji_radnici_u_turizmu"""
)
def union_of_exports(spark: SparkSession, d: str) -> DataFrame:
    parts = (("hotel", "omh_hoteli", "hotel_id", "hotel_name"), ("agency", "gelbeseiten_agencies", "agency_id", "agency_name"),
             ("lead", "hzz_ugostitelji_radnici_u_turizmu", "lead_id", "company"))
    out = None
    for kind, name, key, label in parts:
        part = table(spark, d, name).select(F.lit(kind).alias("kind"), c(key).cast("string").alias("id"), c(label).alias("name"), "city")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@R.add(
    f"""SELECT DISTINCT {S.host('website')} AS host FROM gelbeseiten_agencies WHERE {S.host('website')} <> ''
    EXCEPT SELECT DISTINCT {S.host('employer_website')} FROM jobs"""
)
def unknown_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts still to be fetched: known ones removed by an anti join."""
    wanted = table(spark, d, "gelbeseiten_agencies").select(urls.website_host(c("website")).alias("host")).where("host <> ''").distinct()
    known = table(spark, d, "jobs").select(urls.website_host(c("employer_website")).alias("host"))
    return wanted.join(known, "host", "left_anti")


# ---- table maintenance ------------------------------------------------------------------------------------------


@R.add(
    """WITH b AS (SELECT source, detail_url, json_extract_string(job_payload, '$.title') AS title, json_extract_string(job_payload, '$.employer_email') AS employer_email,
      row_number() OVER (PARTITION BY source, detail_url ORDER BY scraped_at DESC, id DESC) AS rn FROM job_snapshots), n AS (SELECT * FROM b WHERE rn = 1)
    SELECT coalesce(j.source, n.source) AS source, coalesce(j.detail_url, n.detail_url) AS detail_url, CASE WHEN n.rn = 1 THEN n.title ELSE j.title END AS title,
      coalesce(n.employer_email, j.employer_email) AS employer_email, j.email_send_count
    FROM jobs j FULL OUTER JOIN n ON n.source = j.source AND n.detail_url = j.detail_url"""
)
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Stored jobs overlaid by all snapshot rows; a known address is not overwritten by NULL."""
    get = lambda k: F.get_json_object("job_payload", f"$.{k}").alias(k)
    batch = table(spark, d, "job_snapshots").select("source", "detail_url", get("title"), get("employer_email"), "scraped_at", "id")
    jobs = table(spark, d, "jobs").select("source", "detail_url", "title", "employer_email", "email_send_count")
    order = [F.desc("scraped_at"), F.desc("id")]
    return upsert(jobs, batch.select("*"), ["source", "detail_url"], order, preserve=["employer_email"])


@R.add(
    """SELECT j.id, CASE WHEN g.job_id IS NOT NULL THEN 'queued' ELSE j.email_status END AS email_status FROM jobs j
    LEFT JOIN (SELECT DISTINCT job_id FROM job_groups) g ON g.job_id = j.id"""
)
def update_by_ids(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "job_groups").select(c("job_id").alias("id")).distinct().withColumn("email_status", F.lit("queued"))
    return update_from(table(spark, d, "jobs").select("id", "email_status"), changes, "id", ["email_status"])


@R.add("SELECT count(*) AS n, count(DISTINCT detail_url) AS listings FROM (SELECT detail_url FROM jobs UNION ALL (SELECT DISTINCT detail_url FROM job_snapshots WHERE detail_url NOT IN (SELECT detail_url FROM jobs)))")
def append_unknown(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "jobs").select("detail_url")
    batch = table(spark, d, "job_snapshots").select("detail_url").distinct()
    out = append_new(jobs, batch, ["detail_url"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("detail_url").alias("listings"))


@R.add(
    f"""WITH b AS (SELECT detail_url, {_v('title')} AS title, coalesce({_v('employer_email')}, {_v('email')}) AS mail,
      row_number() OVER (PARTITION BY {_v('detail_url')} ORDER BY scraped_at DESC, id DESC) AS rn FROM job_snapshots
      WHERE source = 'meinestadt' AND {_v('detail_url')} IS NOT NULL AND NOT regexp_matches({S.fold(_v('company'))}, '\\b(skola|vrtic)\\b')),
    n AS (SELECT * FROM b WHERE rn = 1), s AS (SELECT * FROM jobs WHERE source = 'meinestadt')
    SELECT coalesce(s.detail_url, n.detail_url) AS detail_url, CASE WHEN n.rn = 1 THEN n.title ELSE s.title END AS title, coalesce(n.mail, s.employer_email) AS employer_email,
      s.email_send_count FROM s FULL OUTER JOIN n ON n.detail_url = s.detail_url"""
)
def ingest_delivery(spark: SparkSession, d: str) -> DataFrame:
    """All deliveries of one source taken into the job table."""
    rows = table(spark, d, "job_snapshots").where("source = 'meinestadt'").select("job_payload", "scraped_at", c("id").alias("snapshot_id"))
    stored = table(spark, d, "jobs").where("source = 'meinestadt'").select(
        "source", "detail_url", "title", "company", "employer_email", "employer_phone", "employer_address", "employer_website", "email_send_count"
    )
    jobs, _, _ = ingest.ingest(rows, stored, "meinestadt", [F.desc("scraped_at"), F.desc("snapshot_id")])
    return jobs.select("detail_url", "title", "employer_email", "email_send_count")


@R.add(f"SELECT lead_id, coalesce(email, '') AS email, coalesce(company, '') AS company, coalesce(city, '') AS city FROM hzz_ugostitelji_radnici_u_turizmu")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Leads written as a quoted CSV into the shared folder and read back."""
    folder = shared_folder(spark, "csv")
    leads = table(spark, d, "hzz_ugostitelji_radnici_u_turizmu").select("lead_id", "email", "company", "city")
    write_csv(leads, folder)
    back = read_csv(spark, folder, ["lead_id", "email", "company", "city"], missing_as_empty=True)
    return back.select(c("lead_id").cast("long").alias("lead_id"), "email", "company", "city")


_ADMIT = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
  s AS (SELECT event_id, user_id, rn, true AS admitted, [t] AS log FROM e WHERE rn = 1
    UNION ALL SELECT e.event_id, e.user_id, e.rn, len(list_filter(s.log, lambda x: x > e.t - 86400000000)) < 3,
      CASE WHEN len(list_filter(s.log, lambda x: x > e.t - 86400000000)) < 3 THEN list_append(list_filter(s.log, lambda x: x > e.t - 86400000000), e.t) ELSE list_filter(s.log, lambda x: x > e.t - 86400000000) END
    FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
  SELECT event_id, admitted FROM s"""


@R.add(_ADMIT)
def sliding_log_admission(spark: SparkSession, d: str) -> DataFrame:
    """Three events per user and day."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return admit(events, "user_id", "ts", "event_id", 3, 86_400).select("event_id", "admitted")


QUERIES, ORACLE = R.queries, R.sql
