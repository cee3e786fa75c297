"""Text, URL and extraction functions against plain Python."""

import base64
import unicodedata

from pyspark.sql import functions as F

from leadloom.functions import extract, text, urls
from leadloom.functions.contacts import canonical_phone, host_of, usable_email, usable_phone, usable_website

TEXTS = [
    "  Caffè Bar Ðuro d.o.o.  ", "Građevina ŠKOLA", "Straße  9", "ﬁnal ½", "", None, "　tab\tand\nline ", "Łódź Çelik",
    "日本 text", "a" * 5000,
]


def column(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def py_fold(v):
    s = unicodedata.normalize("NFKD", v or "").encode("ascii", "ignore").decode().casefold()
    return " ".join(s.split())


def test_fold_matches_definition(spark):
    assert column(spark, TEXTS, text.fold_exact) == [py_fold(v) for v in TEXTS]
    simple = [v for v in TEXTS if not v or ("ﬁ" not in v and "½" not in v)]
    assert column(spark, simple, text.fold) == [py_fold(v) for v in simple]


def test_collapse_and_clean(spark):
    assert column(spark, TEXTS, text.collapse_ws) == [" ".join((v or "").split()) for v in TEXTS]
    assert column(spark, [" x ", "  ", None, " y "], text.clean_or_null) == ["x", None, None, "y"]


def test_five_folds_differ(spark):
    v = ["Građevina Straße"]
    assert column(spark, v, text.fold) == ["graevina strae"]
    assert column(spark, v, text.fold_keep) == ["građevina strasse"]
    assert column(spark, v, text.slug_hr) == ["gradevina_stra_e"]
    assert column(spark, v, text.slug) == ["graevina_strae"]
    assert column(spark, v, text.casefold_key) == ["građevina straße"]


def test_dates(spark):
    v = ["09.04.2026.", "9.4.2026.", "09. 04. 2026.", "2026-04-09", "soon", "", None, "31.02.2026."]
    got = [str(x) if x else None for x in column(spark, v, text.parse_date)]
    assert got == ["2026-04-09"] * 4 + [None] * 4


def test_template_keeps_odd_values(spark):
    df = spark.sql("select map('a', '$1 {{ b }}', 'b', null) as m")
    out = df.select(text.render(F.lit("x {{ a }}-{{b}}-{{ c }}!"), F.col("m"))).first()[0]
    assert out == "x $1 {{ b }}--!"


def test_base64_tolerates_missing_padding(spark):
    coded = base64.b64encode("šumska".encode()).decode().rstrip("=")
    assert column(spark, [coded, "%%%", None], text.decode_base64) == ["šumska", "", ""]


def test_percent_decoding_keeps_plus(spark):
    assert column(spark, ["a%20b+c", "%zz", "x"], text.percent_decode) == ["a b+c", "%zz", "x"]


def test_urls(spark):
    v = ["www.Shop.example/a?x=1#y", " https://WWW.b.example ", "mailto:x", "", None]
    assert column(spark, v, urls.website_host) == ["shop.example", "b.example", "mailto:x", "", ""]
    assert column(spark, v[:2], urls.normalize_website) == ["https://www.Shop.example/a", "https://WWW.b.example"]
    pairs = spark.createDataFrame([("a.b.example", "b.example", True), ("b.example", "c.example", False), ("", "x.y", False)], "a string, b string, want boolean")
    assert pairs.where(urls.domains_match(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_link_resolution(spark):
    rows = [("/kontakt", "https://a.example/kontakt"), ("x.html#top", "https://a.example/dir/x.html"), ("mailto:a@b.example", None),
            ("//c.example/p", "https://c.example/p"), ("http://d.example", "http://d.example")]
    df = spark.createDataFrame(rows, "h string, want string").withColumn("base", F.lit("https://a.example/dir/page"))
    assert df.where(~urls.resolve_url(F.col("base"), F.col("h")).eqNullSafe(F.col("want"))).count() == 0


def test_emails(spark):
    page = "Write to logo@2x.png or INFO@Firm.example, see mailto:jobs@firm.example"
    got = column(spark, [page, None, ""], extract.emails_in_order)
    assert got == [["jobs@firm.example", "info@firm.example"], [], []]
    assert column(spark, [page], lambda c: extract.first_email(c, ["logo@2x.png"])) == ["INFO@Firm.example"]


def test_labelled_value_and_section(spark):
    body = "Head\nRadno vrijeme: puno\nSmještaj: da\nPoslodavac\nFirma\nUlica 1\nKontakt:\nx"
    assert column(spark, [body], lambda c: extract.labelled_value(c, "Radno vrijeme:", ["Smještaj:"])) == ["puno"]
    assert column(spark, [body], lambda c: extract.section(c, "Poslodavac", ["Kontakt:"])) == ["Firma Ulica 1"]
    assert column(spark, [body, None], lambda c: extract.labelled_value(c, "Plaća:")) == ["", ""]


def test_contact_list_pending_address(spark):
    item = '<li class="elementor-icon-list-item">{}</li>'
    span = '<span class="elementor-icon-list-text">{}</span>'
    html = item.format(span.format("Ulica 5, Grad")) + item.format('<a href="tel:+3851">' + span.format("01 234") + "</a>") + item.format(
        '<a href="mailto:a@x.example;b@x.example">' + span.format("mail") + "</a>"
    )
    df = spark.createDataFrame([(html,), (None,)], "h string")
    got = [tuple(r[0]) for r in df.select(extract.contact_list(F.col("h"), [], [])).collect()]
    assert got == [("Ulica 5, Grad", "01 234", "a@x.example, b@x.example", ""), ("", "", "", "")]


def test_usable_contacts(spark):
    mails = {"hr@firma.example": True, "Alt.X@FIRMA.HR.EXAMPLE": True, "info@": False, "a@@b.example": False, "logo@2x.png": False,
             "x@burza.hzz.example": False, "test@test": False, "": False, None: False, "a b@c.example": False, "x" * 5000 + "@c.example": False}
    assert column(spark, list(mails), usable_email) == list(mails.values())
    sites = {"www.firma.example/x": True, "https://firma,example": False, "www firma": False, "localhost": False, "http://www": False,
             "https://jobs.meinestadt.example/f": False, "FIRMA.EXAMPLE": True, None: False}
    assert column(spark, list(sites), usable_website) == list(sites.values())
    phones = {"+385 (0)1 2345678": True, "+385": False, "000000": False, "11111111111": False, "na upit": False, "05970 4383020": True, None: False}
    assert column(spark, list(phones), usable_phone) == list(phones.values())
    same = column(spark, ["+385 (0)1 2345678", "01 2345678", "003851 2345678"], canonical_phone)
    assert same == ["12345678"] * 3
    assert column(spark, ["HTTP://WWW.A.example/x?y", "a.example:80"], host_of) == ["a.example", "a.example"]
