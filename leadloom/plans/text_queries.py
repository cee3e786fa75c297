"""Queries over text, URL and extraction functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import extract, text, urls
from leadloom.plans import sqltext as S
from leadloom.plans.registry import Registry
from leadloom.session import table

R = Registry()
c = F.col


@R.add(f"SELECT id, {S.or_null('company')} AS company, {S.or_null('employer_phone')} AS phone FROM jobs")
def clean_or_null_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select(
        "id", text.clean_or_null(c("company")).alias("company"), text.clean_or_null(c("employer_phone")).alias("phone")
    )


@R.add(f"SELECT doc_id, {S.collapse('text')} AS clean FROM documents")
def clean_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.collapse_ws(c("text")).alias("clean"))


@R.add(f"SELECT id, {S.company_key('company', 'detail_url')} AS company_key FROM jobs")
def fold_company_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", text.company_key(c("company"), c("detail_url")).alias("company_key"))


@R.add(f"SELECT id, {S.fold_keep('company')} AS company_key FROM jobs")
def fold_keep_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", text.fold_keep(c("company")).alias("company_key"))


@R.add(f"SELECT id, {S.slug('title')} AS slug, {S.slug_hr('category')} AS category_slug FROM jobs")
def slug_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select(
        "id", text.slug(c("title")).alias("slug"), text.slug_hr(c("category")).alias("category_slug")
    )


@R.add(f"SELECT agency_id, lower({S.collapse('agency_name')}) AS name_key, lower({S.collapse('email')}) AS email_key FROM gelbeseiten_agencies")
def casefold_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gelbeseiten_agencies").select(
        "agency_id", text.casefold_key(c("agency_name")).alias("name_key"), text.casefold_key(c("email")).alias("email_key")
    )


@R.add(
    "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), "
    "'&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&') AS plain "
    "FROM documents WHERE text IS NOT NULL"
)
def html_unescape_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", text.unescape_html(c("text")).alias("plain"))


@R.add("SELECT agency_id, agency_name || '+' AS decoded FROM gelbeseiten_agencies WHERE agency_name IS NOT NULL")
def percent_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gelbeseiten_agencies").where("agency_name IS NOT NULL")
    encoded = F.concat(F.replace(F.url_encode("agency_name"), F.lit("+"), F.lit("%20")), F.lit("+"))
    return rows.select("agency_id", text.percent_decode(encoded).alias("decoded"))


@R.add("SELECT agency_id, agency_name AS decoded FROM gelbeseiten_agencies WHERE agency_name IS NOT NULL")
def base64_decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Values whose padding was cut off."""
    rows = table(spark, d, "gelbeseiten_agencies").where("agency_name IS NOT NULL")
    encoded = F.rtrim(F.base64(F.encode("agency_name", "UTF-8")), F.lit("="))
    return rows.select("agency_id", text.decode_base64(encoded).alias("decoded"))


_U = S.with_scheme("employer_website")


@R.add(
    f"SELECT id, CASE WHEN {S.url_part(_U, 2)} <> '' THEN lower({S.url_part(_U, 1)}) || '://' || {S.url_part(_U, 2)} || "
    f"{S.url_part(_U, 3)} END AS website FROM jobs"
)
def website_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", urls.normalize_website(c("employer_website")).alias("website"))


_US = S.with_scheme(r"regexp_replace(employer_website, '[\s\pZ]+', '', 'g')")


@R.add(
    f"SELECT id, CASE WHEN coalesce({S.url_part(_US, 2)}, '') <> '' THEN regexp_replace(lower({S.url_part(_US, 1)}) || '://' || "
    f"lower({S.url_part(_US, 2)}) || {S.url_part(_US, 3)}, '/+$', '') ELSE '' END AS website, {S.host('employer_website')} AS host FROM jobs"
)
def website_strict_host(spark: SparkSession, d: str) -> DataFrame:
    w = c("employer_website")
    return table(spark, d, "jobs").select(
        "id", urls.normalize_website_strict(w).alias("website"), urls.website_host(w).alias("host")
    )


@R.add(
    f"SELECT id, coalesce('website:' || nullif(lower({S.url_part(_U, 2)}), ''), 'company:' || nullif({S.fold('company')}, ''), "
    "'detail:' || detail_url) AS group_key FROM jobs"
)
def company_group_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select(
        "id", urls.group_key(c("employer_website"), c("company"), c("detail_url")).alias("group_key")
    )


_H, _D = "h", "split_part(lower(employer_email), '@', 2)"


@R.add(
    f"""WITH x AS (SELECT id, {S.host('employer_website')} AS h, {_D} AS m FROM jobs WHERE employer_email LIKE '%@%' AND employer_website IS NOT NULL),
    y AS (SELECT *, array_to_string(str_split(h, '.')[-2:], '.') AS hb, array_to_string(str_split(m, '.')[-2:], '.') AS mb FROM x)
    SELECT id, h <> '' AND m <> '' AND (h = m OR ends_with(h, '.' || m) OR ends_with(m, '.' || h) OR hb = mb) AS same_site FROM y"""
)
def domain_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").where("employer_email LIKE '%@%' AND employer_website IS NOT NULL")
    mail = F.split_part(F.lower("employer_email"), F.lit("@"), F.lit(2))
    return rows.select("id", urls.domains_match(urls.website_host(c("employer_website")), mail).alias("same_site"))


@R.add(
    f"SELECT id, CASE WHEN {S.url_part('detail_url', 2)} <> '' THEN lower({S.url_part('detail_url', 1)}) || '://' || "
    f"{S.url_part('detail_url', 2)} ELSE '' END AS origin FROM jobs"
)
def website_origin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", urls.origin(c("detail_url")).alias("origin"))


@R.add(
    "SELECT id, detail_url || CASE WHEN contains(detail_url, '?') THEN '&' ELSE '?' END || 'page=2' AS paged FROM jobs"
)
def paged_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs").select("id", urls.paged_url(urls.paged_url(c("detail_url"), F.lit(1)), F.lit(2)).alias("paged"))


@R.add(
    "SELECT id, 'https://jobs.example/search?q=' || replace(url_encode(" + S.collapse("category") + "), '%20', '+') || '&l=' || "
    "replace(url_encode(" + S.slug("location") + "), '%20', '+') AS url FROM jobs WHERE category IS NOT NULL"
)
def search_url_build(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").where("category IS NOT NULL")
    return rows.select("id", urls.search_url("https://jobs.example/search", c("category"), text.slug(c("location"))).alias("url"))


_P = "json_extract_string(job_payload, '$.{}')"


@R.add(
    rf"""WITH x AS (SELECT id, regexp_replace(coalesce({_P.format('valid_from')}, {_P.format('published_at')}), '{S.WS}+', '', 'g') AS v FROM job_snapshots)
    SELECT id, CAST(coalesce(try_strptime(CASE WHEN regexp_matches(v, '^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}\.?$') THEN rtrim(v, '.') END, '%d.%m.%Y'),
      try_strptime(CASE WHEN regexp_matches(v, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN v END, '%Y-%m-%d')) AS DATE) AS published_at FROM x"""
)
def date_parse_multi(spark: SparkSession, d: str) -> DataFrame:
    p = c("job_payload")
    written = F.coalesce(F.get_json_object(p, "$.valid_from"), F.get_json_object(p, "$.published_at"))
    return table(spark, d, "job_snapshots").select("id", text.parse_date(written).alias("published_at"))


@R.add(
    f"SELECT id, CAST(CAST(nullif({S.strip(_P.format('email_enrichment_next_attempt_at'))}, '') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS VARCHAR) AS next_at "
    "FROM job_snapshots"
)
def timestamp_coerce(spark: SparkSession, d: str) -> DataFrame:
    written = F.get_json_object("job_payload", "$.email_enrichment_next_attempt_at")
    return table(spark, d, "job_snapshots").select("id", text.parse_timestamp(written).cast("string").alias("next_at"))


@R.add(
    "SELECT lead_id, 'Dear ' || coalesce(company, '') || ' in ' || coalesce(city, '') || ', $' || coalesce(country, '') || '!' AS body "
    "FROM hzz_ugostitelji_radnici_u_turizmu"
)
def render_template(spark: SparkSession, d: str) -> DataFrame:
    keys = ("company", "city", "country")
    values = F.create_map(*[x for k in keys for x in (F.lit(k), c(k))])
    template = F.lit("Dear {{ company }} in {{city}},{{ unknown }} ${{ country }}!")
    leads = table(spark, d, "hzz_ugostitelji_radnici_u_turizmu")
    return leads.select("lead_id", text.render(template, values).alias("body"))


_A = S.collapse("address")


@R.add(
    rf"SELECT hotel_id, CASE WHEN regexp_extract({_A}, '\d{{5}}\s+(.+)$', 1) <> '' THEN regexp_extract({_A}, '\d{{5}}\s+(.+)$', 1) ELSE {_A} END AS after_code, "
    rf"CASE WHEN contains(address, ',') THEN {S.collapse('''regexp_extract(address, '([^,]*)$', 1)''')} WHEN address IS NOT NULL THEN '' END AS after_comma "
    "FROM omh_hoteli WHERE address IS NOT NULL"
)
def city_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "omh_hoteli").where("address IS NOT NULL")
    return rows.select(
        "hotel_id", text.city_after_code(c("address")).alias("after_code"), text.city_after_comma(c("address")).alias("after_comma")
    )


@R.add(rf"SELECT id, regexp_replace({S.collapse('''category || '  ' || CAST(email_send_count AS VARCHAR)''')}, '\s+\d+$', '') AS label FROM jobs WHERE category IS NOT NULL")
def strip_trailing_count(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "jobs").where("category IS NOT NULL")
    counted = F.concat(c("category"), F.lit("  "), c("email_send_count").cast("string"))
    return rows.select("id", text.strip_count(counted).alias("label"))


GENERIC = ["info@hzz.example", "noreply@burza.hzz.example"]
_EM = f"list_filter(regexp_extract_all(coalesce(text, ''), '{S.EMAIL}'), lambda e: lower(e) NOT IN ('info@hzz.example', 'noreply@burza.hzz.example'))"


@R.add(f"SELECT doc_id, coalesce({_EM}[1], '') AS email FROM documents")
def email_extract_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", extract.first_email(c("text"), GENERIC).alias("email"))


_PH = r"""regexp_replace(regexp_replace(regexp_extract(coalesce(text, ''), '(\+?\d[\d\s()/.\-]{5,}\d)', 1), '\s+', ' ', 'g'), '^[ .,;\-]+|[ .,;\-]+$', '', 'g')"""


@R.add(f"SELECT doc_id, CASE WHEN length(regexp_replace({_PH}, '[^0-9]', '', 'g')) >= 6 THEN {_PH} ELSE '' END AS phone FROM documents")
def phone_extract_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", extract.first_phone(c("text")).alias("phone"))


_LN = rf"""list_filter(list_transform(regexp_split_to_array(coalesce(employer_address || chr(10) || company, ''), '\r\n?|\n'), lambda x: {S.collapse('x')}),
  lambda x: regexp_matches(x, '\d{{5}}\s+\S+') AND NOT contains(lower(x), 'mjesto rada'))"""


@R.add(rf"SELECT id, coalesce(regexp_replace({_LN}[1], '(?i)^(adresa|adresa poslodavca|sjedište|sjediste|kontakt|poslodavac)\s*:\s*', ''), '') AS address FROM jobs")
def address_extract(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(c("employer_address"), F.lit("\n"), c("company"))
    return table(spark, d, "jobs").select("id", extract.first_address(page).alias("address"))


@R.add(
    rf"SELECT doc_id, {S.collapse(r'''regexp_extract(coalesce(text, ''), '(?is)Pitanje:\s*([^\n]+)', 1)''')} AS question, "
    rf"{S.collapse(r'''regexp_extract(coalesce(text, ''), '(?is)Antwort:\s*([^\n]+)', 1)''')} AS answer FROM documents"
)
def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", extract.labelled_value(c("text"), "Pitanje:").alias("question"), extract.labelled_value(c("text"), "Antwort:").alias("answer")
    )


@R.add(
    f"""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{S.EMAIL}')) AS email FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, email, count(*) AS n FROM e WHERE length(email) - length(replace(email, '@', '')) = 1
      AND NOT regexp_matches(lower(email), '\\.(png|jpg|jpeg|gif|svg|webp|css|js|ico)$') AND NOT starts_with(lower(email), 'favicon')
      AND split_part(lower(email), '@', 2) NOT IN ('meinestadt.example') GROUP BY 1, 2"""
)
def email_candidates_valid(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.explode(extract.email_candidates(c("text"))).alias("email"))
    kept = found.where(extract.valid_candidate(c("email"), ["meinestadt.example"]))
    return kept.groupBy("doc_id", "email").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    r"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1)) AS href FROM documents)
    SELECT doc_id, replace(href, '&amp;', '&') AS link, count(*) AS n FROM h GROUP BY 1, 2"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "url", F.explode(extract.hrefs(c("text"))).alias("href"))
    return docs.select("doc_id", urls.resolve_url(c("url"), c("href")).alias("link")).groupBy("doc_id", "link").agg(
        F.count(F.lit(1)).alias("n")
    )


@R.add("SELECT id FROM jobs WHERE source = 'meinestadt' AND regexp_matches(detail_url, '^https://jobs\\.meinestadt\\.example/[^/?]+/[^/?]+[^?]*\\?(.*&)?id=')")
def listing_url_filter(spark: SparkSession, d: str) -> DataFrame:
    ok = urls.is_detail_url(c("detail_url"), "jobs.meinestadt.example", "id", ["/jk/", "/jkl/", "/skills/", "/magazin/", "/arbeitgeber/"])
    return table(spark, d, "jobs").where(ok).select("id")


@R.add(
    rf"""WITH x AS (SELECT id, employer_website AS w, {S.host('employer_website')} AS h FROM jobs)
    SELECT id, h AS host FROM x WHERE regexp_matches(lower(w), '^https?://[^/?#]+') AND NOT contains(lower(w), 'apply')
      AND NOT regexp_matches(h, '(^|\.)(hzz|mojposao|meinestadt|gelbeseiten)\.example$')"""
)
def external_site_filter(spark: SparkSession, d: str) -> DataFrame:
    own = ["hzz.example", "mojposao.example", "meinestadt.example", "gelbeseiten.example"]
    rows = table(spark, d, "jobs").where(urls.is_external_site(c("employer_website"), own))
    return rows.select("id", urls.website_host(c("employer_website")).alias("host"))


_SITE = r"^(?i)https?://[^/?#]"


@R.add(
    rf"""WITH x AS (
      SELECT hotel_id, {S.collapse('address')} AS a, {S.collapse('phone_number')} AS p,
        CASE WHEN regexp_matches(website, '{_SITE}') AND NOT contains({S.host('website')}, 'omh.example') THEN rtrim(website, '/') ELSE '' END AS w
      FROM omh_hoteli)
    SELECT hotel_id, CASE WHEN (contains(a, ',') OR regexp_matches(a, '[0-9]')) AND NOT contains(a, '@') AND NOT regexp_matches(lower(a), '^(email|submit|newsletter)')
      AND (p <> '' OR w <> '') THEN a ELSE '' END AS address, p AS phone, w AS website FROM x"""
)
def html_contact_list(spark: SparkSession, d: str) -> DataFrame:
    """Contact blocks of every hotel: a NULL or blank part has no entry, markup is escaped, a website without a scheme
    is a relative link and so none."""
    rows = table(spark, d, "omh_hoteli")
    item = '<li class="elementor-icon-list-item">{}<span class="elementor-icon-list-text">{}</span>{}</li>'
    address, phone, site = (text.escape_html(c(x)) for x in ("address", "phone_number", "website"))
    shown = lambda name, entry, *values: F.when(text.collapse_ws(c(name)) != "", F.format_string(entry, *values))
    html = F.concat_ws(
        "\n",
        shown("address", item.format("", "%s", ""), address),
        shown("phone_number", item.format('<a href="tel:%s">', "%s", "</a>"), phone, phone),
        shown("website", item.format('<a href="%s">', "Web", "</a>"), site),
    )
    out = rows.select("hotel_id", extract.contact_list(html, [], ["omh.example"]).alias("f"))
    return out.select("hotel_id", "f.address", "f.phone", "f.website")


@R.add("SELECT n_nationkey, n_nationkey AS page, n_regionkey + 1 AS pages FROM nation")
def pagination_state(spark: SparkSession, d: str) -> DataFrame:
    line = F.format_string("  Seite  %d von %d  ", c("n_nationkey"), c("n_regionkey") + 1)
    out = table(spark, d, "nation").select("n_nationkey", extract.page_state(line).alias("s"))
    return out.select("n_nationkey", "s.page", "s.pages")


@R.add()
def email_rank(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the documents ranked for the site each document comes from."""
    from leadloom.plans.enrich import ranked_emails

    docs = table(spark, d, "documents").withColumn("company", F.regexp_extract("text", r"^([^\s,]+)", 1))
    return ranked_emails(docs, "doc_id", "text", "url", "company", "url")


QUERIES, ORACLE = R.queries, R.sql
