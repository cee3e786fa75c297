"""Queries over page and card parsers: pages are written from table columns and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import pages, text
from leadloom.functions.extract import emails_in_order
from leadloom.plans import sqltext as S
from leadloom.plans.registry import Registry
from leadloom.session import table

R = Registry()
c = F.col

_SOME = "title IS NOT NULL AND trim(company) <> '' AND trim(location) <> ''"
_TELLING = (
    f"{_SOME} AND NOT contains(company, ':') AND NOT contains(location, ':') AND title <> company AND title <> location AND company <> location "
    f"AND {S.collapse('title')} = title AND {S.collapse('company')} <> '' AND {S.collapse('location')} <> '' "
    f"AND {S.collapse('title')} <> {S.collapse('company')} AND {S.collapse('title')} <> {S.collapse('location')} AND {S.collapse('company')} <> {S.collapse('location')}"
)
_CO, _LO = S.collapse("company"), S.collapse("location")


def _telling(spark: SparkSession, d: str) -> DataFrame:
    t, co, lo = text.collapse_ws(c("title")), text.collapse_ws(c("company")), text.collapse_ws(c("location"))
    rows = table(spark, d, "jobs").where(c("title").isNotNull() & (co != "") & (lo != "") & (t == c("title")))
    return rows.where(~c("company").contains(":") & ~c("location").contains(":") & (t != co) & (t != lo) & (co != lo)
                      & (F.trim("company") != "") & (F.trim("location") != "")
                      & (c("title") != c("company")) & (c("title") != c("location")) & (c("company") != c("location")))


@R.add(f"SELECT id, {_CO} AS company, {_LO} AS location FROM jobs WHERE {_TELLING}")
def listing_row_labelled(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", c("title"), F.concat(F.lit("Poslodavac: "), c("company")), F.concat(F.lit("Mjesto rada: "), c("location")), F.lit("Rok za prijavu: sutra"))
    return _telling(spark, d).select("id", pages.listing_row(body, c("title")).alias("f")).select("id", "f.*")


@R.add(f"SELECT id, {_CO} AS company, {_LO} AS location FROM jobs WHERE {_TELLING}")
def listing_row_positional(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", c("title"), c("location"), c("company"), F.lit("Rok: 1"))
    return _telling(spark, d).select("id", pages.listing_row(body, c("title")).alias("f")).select("id", "f.*")


@R.add(f"SELECT id, {_CO} AS company, {_LO} AS location, '01.02.2026' AS published_at FROM jobs WHERE {_TELLING}")
def listing_card_fields(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", F.lit("Neu"), c("title"), F.lit("TOP-Job"), c("company"), F.lit(" 01.02.2026 "), c("location"), F.lit("02.02.2026"))
    return _telling(spark, d).select("id", pages.listing_card(body, c("title")).alias("f")).select("id", "f.*")


@R.add(f"SELECT id, {_LO} AS location, {_CO} AS company FROM jobs WHERE {_TELLING}")
def detail_page_fields(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", c("title"), F.lit("E-Mail: x@y.example"), F.lit("Jetzt bewerben"), c("company"), F.lit("Standort:"), F.lit("Neu"), c("location"))
    found = _telling(spark, d).select("id", "title", body.alias("body"), pages.detail_location(body).alias("location"))
    return found.select("id", "location", pages.detail_company(c("body"), c("title"), c("location")).alias("company"))


@R.add(f"SELECT id, {_CO} AS company, {_LO} AS location, '1.200 EUR' AS salary, 'prije 3 dana' AS published_at, true AS is_remote FROM jobs WHERE {_TELLING} "
       f"AND NOT regexp_matches(lower({_CO}), '^(report|image)') AND NOT regexp_matches({_CO}, '€') AND NOT regexp_matches({_LO}, '€')")  # fmt: skip
def result_card_fields(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", c("title"), F.lit("1.200 EUR"), F.lit("Rad od kuće"), F.lit("Report"), F.lit("image: x"), c("company"), c("location"), F.lit("prije 3 dana"))
    return _telling(spark, d).select("id", pages.result_card(body, c("title")).alias("f")).select("id", "f.*")


# The same pages of every job: a NULL or blank field has no line, and what the parser then reads is stated as lists of lines.
_EVERY = f"(SELECT id, {S.collapse('title')} AS t, {_CO} AS co, {_LO} AS lo FROM jobs)"
_at = lambda lines, n: f"coalesce(({lines})[{n}], '')"
_DATE = r"regexp_matches({x}, '\b\d{{2}}\.\d{{2}}\.\d{{4}}\b') OR lower({x}) IN ('neu', 'aktualisiert')"
_listing_noise = lambda x: f"{S.slug(x)} IN ({', '.join(map(repr, pages.LISTING_NOISE))}) OR {_DATE.format(x=x)}"
_detail_noise = lambda x: f"lower({x}) IN ({', '.join(map(repr, pages.DETAIL_NOISE))}) OR {_DATE.format(x=x)}"


def _shown(name: str, label: str = "") -> Column:
    return F.when(text.collapse_ws(c(name)) != "", F.concat(F.lit(label), c(name)))


# a field that its label names, else the first (place) or second (company) free line, of which there is none here
@R.add(f"SELECT id, co AS company, lo AS location FROM {_EVERY}")
def listing_row_labelled_every(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("\n", _shown("title"), _shown("company", "Poslodavac: "), _shown("location", "Mjesto rada: "), F.lit("Rok za prijavu: sutra"))
    return table(spark, d, "jobs").select("id", pages.listing_row(body, c("title")).alias("f")).select("id", "f.*")


_FREE = "list_filter([lo, co], lambda x: x <> '' AND x <> t AND NOT contains(x, ':'))"


@R.add(f"SELECT id, {_at(_FREE, 2)} AS company, {_at(_FREE, 1)} AS location FROM {_EVERY}")
def listing_row_positional_every(spark: SparkSession, d: str) -> DataFrame:
    """By position alone: without a place the company is read as the place."""
    body = F.concat_ws("\n", _shown("title"), _shown("location"), _shown("company"), F.lit("Rok: 1"))
    return table(spark, d, "jobs").select("id", pages.listing_row(body, c("title")).alias("f")).select("id", "f.*")


_CARD = f"list_filter([co, lo], lambda x: x <> '' AND NOT ({_listing_noise('x')}))"


@R.add(f"SELECT id, {_at(_CARD, 1)} AS company, {_at(_CARD, 2)} AS location, "
       f"CASE WHEN {_at(_CARD, 1)} = '' THEN '' WHEN {_at(_CARD, 1)} = co THEN '01.02.2026' ELSE '02.02.2026' END AS published_at FROM {_EVERY}")  # fmt: skip
def listing_card_fields_every(spark: SparkSession, d: str) -> DataFrame:
    """By position alone: without a company the place is read as the company, and the date is the first behind it."""
    body = F.concat_ws("\n", F.lit("Neu"), _shown("title"), F.lit("TOP-Job"), _shown("company"), F.lit(" 01.02.2026 "), _shown("location"), F.lit("02.02.2026"))
    return table(spark, d, "jobs").select("id", pages.listing_card(body, c("title")).alias("f")).select("id", "f.*")


@R.add(f"SELECT id, CASE WHEN {_detail_noise('lo')} THEN '' ELSE lo END AS location, CASE WHEN co IN (t, lo) OR {_detail_noise('co')} OR contains(co, '@') "
       f"OR regexp_matches(lower(co), '^(e-mail|web):') THEN '' ELSE co END AS company FROM {_EVERY}")  # fmt: skip
def detail_page_fields_every(spark: SparkSession, d: str) -> DataFrame:
    """A line that repeats the title or the place is no company."""
    body = F.concat_ws("\n", _shown("title"), F.lit("E-Mail: x@y.example"), F.lit("Jetzt bewerben"), _shown("company"), F.lit("Standort:"), F.lit("Neu"), _shown("location"))
    found = table(spark, d, "jobs").select("id", "title", body.alias("body"), pages.detail_location(body).alias("location"))
    return found.select("id", "location", pages.detail_company(c("body"), c("title"), c("location")).alias("company"))


_RESULT = "list_filter([co, lo], lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(image:|reportimage)'))"


@R.add(f"SELECT id, {_at(_RESULT, 1)} AS company, {_at(_RESULT, 2)} AS location, '1.200 EUR' AS salary, 'prije 3 dana' AS published_at, true AS is_remote FROM {_EVERY}")
def result_card_fields_every(spark: SparkSession, d: str) -> DataFrame:
    """By position alone: without a company the place is read as the company."""
    body = F.concat_ws("\n", _shown("title"), F.lit("1.200 EUR"), F.lit("Rad od kuće"), F.lit("Report"), F.lit("image: x"), _shown("company"), _shown("location"), F.lit("prije 3 dana"))
    return table(spark, d, "jobs").select("id", pages.result_card(body, c("title")).alias("f")).select("id", "f.*")


_AG = f"agency_name = {S.collapse('agency_name')} AND city = {S.collapse('city')} AND NOT regexp_matches(agency_name || city, '[<>&]') AND website IS NOT NULL AND NOT regexp_matches(website, '[%+\\s]')"


@R.add(f"SELECT agency_id, agency_name AS company, city, website, 2 AS total FROM gelbeseiten_agencies WHERE {_AG}")
def directory_card_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "gelbeseiten_agencies").where(
        (c("agency_name") == text.collapse_ws(c("agency_name"))) & (c("city") == text.collapse_ws(c("city")))
        & ~F.concat("agency_name", "city").rlike("[<>&]") & c("website").isNotNull() & ~c("website").rlike(r"[%+\s]")
    )
    card = (
        '<span id="mod-TrefferlisteInfo">2</span><article class="mod mod-Treffer"><h2 class="mod-Treffer__name">%s</h2>'
        '<a href="https://www.gelbeseiten.example/gsbiz/%s">x</a><div class="mod-AdresseKompakt__adress-text">Weg 1, '
        '<span class="nobr mod-AdresseKompakt__adress__ort">01234 %s</span></div><span data-webseiteLink="%s"></span></article>'
        '<article class="mod mod-Treffer">no name</article>'
    )
    coded = F.rtrim(F.base64(F.encode("website", "UTF-8")), F.lit("="))
    html = F.format_string(card, c("agency_name"), c("agency_id"), c("city"), coded)
    out = rows.select("agency_id", F.explode(pages.directory_cards(html)).alias("e"), pages.total_results(html).alias("total"))
    return out.select("agency_id", "e.company", "e.city", "e.website", "total")


@R.add(f"SELECT agency_id, {S.collapse('agency_name')} AS company, {S.collapse('city')} AS city, coalesce(website, '') AS website, 2 AS total FROM gelbeseiten_agencies WHERE {S.collapse('agency_name')} <> ''")
def directory_card_fields_every(spark: SparkSession, d: str) -> DataFrame:
    """Cards of every agency: values are escaped, websites percent-coded, NULL parts left out; every other card has
    its city in the contact JSON only. A card without a name is none."""
    rows = table(spark, d, "gelbeseiten_agencies")
    card = (
        '<span id="mod-TrefferlisteInfo">2</span><article class="mod mod-Treffer"%s><h2 class="mod-Treffer__name">%s</h2>'
        '<a href="https://www.gelbeseiten.example/gsbiz/%s">x</a><div class="mod-AdresseKompakt__adress-text">Weg 1, '
        '%s</div>%s</article><article class="mod mod-Treffer">no name</article>'
    )
    name, city = (text.escape_html(F.coalesce(x, F.lit(""))) for x in ("agency_name", "city"))
    generic = F.struct(F.struct(F.struct(F.struct(F.coalesce("city", F.lit("")).alias("city")).alias("generic")).alias("organizationQuery")).alias("inboxConfig"))
    in_json = c("agency_id") % 2 == 1
    data = F.when(in_json, F.format_string(' data-parameters="%s"', text.escape_html(F.to_json(generic)))).otherwise("")
    place = F.when(in_json | (city == ""), "").otherwise(F.format_string('<span class="nobr mod-AdresseKompakt__adress__ort">01234 %s</span>', city))
    coded = F.rtrim(F.base64(F.encode(F.replace("website", F.lit("%"), F.lit("%25")), "UTF-8")), F.lit("="))
    site = F.when(F.coalesce("website", F.lit("")) != "", F.format_string('<span data-webseiteLink="%s"></span>', coded)).otherwise("")
    html = F.format_string(card, data, name, c("agency_id"), place, site)
    out = rows.select("agency_id", F.explode(pages.directory_cards(html)).alias("e"), pages.total_results(html).alias("total"))
    return out.select("agency_id", "e.company", "e.city", "e.website", "total")


@R.add("SELECT n_nationkey, '10' AS position, n_name AS name FROM nation")
def load_more_fields(spark: SparkSession, d: str) -> DataFrame:
    form = '<form class="mod mod-LoadMore" id="x"><input type="hidden" name="position" value="10"><input type="hidden" name="name" value="%s"></form>'
    m = pages.load_more_params(F.format_string(form, c("n_name")))
    return table(spark, d, "nation").select("n_nationkey", m["position"].alias("position"), m["name"].alias("name"))


@R.add("SELECT agency_id, array_to_string(list_transform(['kontakt', 'kontakt/', 'contact', 'contact/', 'contact-us', 'impressum', 'impressum/', 'Ueber-Uns?x=1'], "
       "lambda p: 'https://' || h || '/' || p), '|') AS pages FROM (SELECT agency_id, " + S.host("website") + " AS h FROM gelbeseiten_agencies) WHERE h <> ''")  # fmt: skip
def contact_page_candidates(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.functions.urls import website_host

    rows = table(spark, d, "gelbeseiten_agencies").select("agency_id", website_host(c("website")).alias("h")).where("h <> ''")
    page = F.concat(F.lit("https://"), c("h"), F.lit("/"))
    html = F.lit('<a href="/kontakt#top">k</a><a href="Ueber-Uns?x=1">j</a><a href="jobs?x=1">j</a><a href="https://other.test/kontakt">o</a><a href="/news">n</a>')
    return rows.select("agency_id", F.array_join(pages.contact_candidates(page, html), "|").alias("pages"))


# in turn: the mailbox name, the kind of page, the first seen of equals, the own domain and the page budget decide
@R.add("SELECT agency_id, ['info@' || h, 'x@' || h, 'aa@' || h, 'jobs@' || h, 'a@other.test'][agency_id % 5 + 1] AS email FROM (SELECT agency_id, "
       + S.host("website") + " AS h FROM gelbeseiten_agencies) WHERE h <> '' AND regexp_matches(h, '^[a-z0-9.-]+[.][a-z]{2,}$')")
def best_website_email(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.functions.urls import website_host

    rows = table(spark, d, "gelbeseiten_agencies").select("agency_id", website_host(c("website")).alias("h"))
    rows = rows.where(c("h").rlike("^[a-z0-9.-]+[.][a-z]{2,}$"))
    page = lambda url, *parts: F.struct(F.lit(url).alias("url"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("html"))
    h = c("h")
    cases = [
        [page("https://x/", "shop@", h, " kontakt@other.test logo@2x.png"), page("https://x/kontakt", "<a href='mailto:INFO@", h, "'>mail</a>")],
        [page("https://x/jobs", "jobs@", h, " career@", h), page("https://x/Impressum", "x@", h)],
        [page("https://x/", "aa@", h), page("https://x/y", "bb@", h, " info@other.test")],
        [page("https://x/", "info@other.test jobs@", h), page("https://x/z", "kontakt@other.test")],
        [page("https://x/", "a@other.test"), page("https://x/2", "bbb@other.test"), page("https://x/3", ""), page("https://x/4", "noreply@other.test"), page("https://x/5", "info@", h)],
    ]
    visited = F.array(*[F.array(*x) for x in cases])[c("agency_id") % len(cases)]
    return rows.select("agency_id", pages.best_page_email(visited, c("h")).alias("email"))


@R.add("SELECT agency_id, 'https://' || h || '/x' AS site FROM (SELECT agency_id, " + S.host("website") + " AS h FROM gelbeseiten_agencies) WHERE h <> ''")
def external_website_first(spark: SparkSession, d: str) -> DataFrame:
    from leadloom.functions.urls import website_host

    rows = table(spark, d, "gelbeseiten_agencies").select("agency_id", website_host(c("website")).alias("h")).where("h <> ''")
    html = F.concat(F.lit('<a href="mailto:a@b.example">m</a><a href="/intern">i</a><a href="https://jobs.portal.test/a">p</a><a href="https://'), c("h"), F.lit('/x">s</a>'))
    return rows.select("agency_id", pages.external_website(html, F.lit("https://www.portal.test/job"), ["portal.test"]).alias("site"))


@R.add("SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(l, '\\b\\d{2}\\.\\d{2}\\.\\d{4}\\b') OR lower(l) IN ('neu', 'aktualisiert')) AS dates, "
       "count(*) FILTER (WHERE regexp_matches(l, '(?i)\\d[\\d.,]*\\s*(€|eur|kn|hrk)\\b|€')) AS salaries "
       f"FROM (SELECT doc_id, {S.collapse('x')} AS l FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n?|\\n')) AS x FROM documents)) WHERE l <> '' GROUP BY 1")  # fmt: skip
def noise_line_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(pages.lines_of(c("text"))).alias("l"))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(pages.looks_like_date(c("l"))).alias("dates"), F.count_if(pages.looks_like_salary(c("l"))).alias("salaries")
    )


@R.add("""SELECT hotel_id, hotel_name AS title, CASE WHEN hotel_id % 3 = 0 THEN 'associated' ELSE 'regular' END AS kind FROM omh_hoteli WHERE hotel_name IS NOT NULL""")
def post_title_and_kind(spark: SparkSession, d: str) -> DataFrame:
    """Title as an object or a plain text; posts without a region are associated ones."""
    rows = table(spark, d, "omh_hoteli").where("hotel_name IS NOT NULL")
    title = F.when(c("hotel_id") % 2 == 0, F.to_json(F.struct(c("hotel_name").alias("rendered")))).otherwise(c("hotel_name"))
    region = F.when(c("hotel_id") % 3 == 0, F.lit("[]")).otherwise(F.lit("[7]"))
    shown = F.coalesce(F.get_json_object(title, "$.rendered"), title)
    kind = F.when(F.size(F.from_json(region, "array<int>")) > 0, "regular").otherwise("associated")
    return rows.select("hotel_id", text.collapse_ws(shown).alias("title"), kind.alias("kind"))


@R.add("SELECT lead_id, company, city, coalesce(country, '') AS country FROM hzz_ugostitelji_radnici_u_turizmu WHERE company = trim(company) AND company IS NOT NULL")
def merge_data_struct(spark: SparkSession, d: str) -> DataFrame:
    """Placeholder values as one struct, written to JSON and read back."""
    rows = table(spark, d, "hzz_ugostitelji_radnici_u_turizmu").where("company = trim(company)")
    data = F.to_json(F.struct("company", "city", "country"), {"ignoreNullFields": "false"})
    back = rows.select("lead_id", F.from_json(data, "company string, city string, country string").alias("m"))
    return back.select("lead_id", "m.company", "m.city", F.coalesce("m.country", F.lit("")).alias("country"))


@R.add("SELECT doc_id, string_agg(lower(e), '|' ORDER BY pos) AS emails FROM (SELECT doc_id, e, min(pos) AS pos FROM (SELECT doc_id, unnest(l) AS e, unnest(generate_series(1, len(l))) AS pos "
       f"FROM (SELECT doc_id, regexp_extract_all(lower(text), '{S.EMAIL}') AS l FROM documents WHERE NOT contains(lower(text), 'mailto:'))) GROUP BY 1, 2) GROUP BY 1")  # fmt: skip
def emails_by_source_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(~F.lower("text").contains("mailto:"))
    return docs.select("doc_id", F.array_join(emails_in_order(c("text")), "|").alias("emails")).where("emails <> ''")


QUERIES, ORACLE = R.queries, R.sql
