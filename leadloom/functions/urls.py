"""URL functions as Column expressions that never fail on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import clean_or_null, collapse_ws, fold, percent_decode

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def with_scheme(url: Column) -> Column:
    u = clean_or_null(url)
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), u).otherwise(F.concat(F.lit("https://"), u))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def query_value(url: Column, key: str) -> Column:
    """Decoded value of a query parameter; NULL if absent."""
    found = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{key}="), percent_decode(found))


def normalize_website(url: Column) -> Column:
    """https by default, query and fragment dropped, path kept; NULL without a host."""
    u = with_scheme(url)
    return F.when(netloc(u) != "", F.concat(scheme(u), F.lit("://"), netloc(u), path(u)))


def normalize_website_strict(url: Column) -> Column:
    """Blanks removed, scheme and host lower-cased, trailing slash dropped; the empty text without a host."""
    u = with_scheme(F.regexp_replace(url, r"[\s\p{Z}]+", ""))
    full = F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), path(u))
    return F.when(F.coalesce(netloc(u), F.lit("")) != "", F.regexp_replace(full, "/+$", "")).otherwise(F.lit(""))


def website_host(url: Column) -> Column:
    """Lower-case host without ``www.``; the empty text if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(netloc(with_scheme(url))), r"^www\.", ""), F.lit(""))


def base_domain(host: Column) -> Column:
    """Last two labels of a host."""
    return F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), F.lit(2)), ".")


def domains_match(a: Column, b: Column) -> Column:
    """Equal, one a sub-domain of the other, or the same last two labels; empty hosts never match."""
    some = (a != "") & (b != "")
    return some & (
        (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)) | (base_domain(a) == base_domain(b))
    )


def origin(url: Column) -> Column:
    return F.when(netloc(url) != "", F.concat(scheme(url), F.lit("://"), netloc(url))).otherwise(F.lit(""))


def group_key(website: Column, company: Column, detail_url: Column) -> Column:
    """Website host, else folded company, else the listing."""
    site = F.nullif(F.lower(netloc(with_scheme(website))), F.lit(""))
    name = F.nullif(fold(company), F.lit(""))
    return F.coalesce(
        F.concat(F.lit("website:"), site), F.concat(F.lit("company:"), name), F.concat(F.lit("detail:"), detail_url)
    )


def search_url(base: str, term: Column, place: Column) -> Column:
    """``base`` with an encoded keyword and place."""
    enc = lambda c: F.url_encode(collapse_ws(c))
    return F.concat(F.lit(base + "?q="), enc(term), F.lit("&l="), enc(place))


def paged_url(url: Column, page: Column) -> Column:
    """``url`` with the query parameter ``page`` set, other parameters kept."""
    without = F.regexp_replace(F.regexp_replace(url, r"([?&])page=[^&#]*&?", "$1"), r"[?&]$", "")
    sep = F.when(without.contains("?"), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(without, sep, F.lit("page="), page.cast("string"))


def is_external_site(url: Column, own_hosts: list[str], forbid_apply: bool = True) -> Column:
    """http(s) link with a host outside ``own_hosts`` that is neither an image nor, if asked, an apply link."""
    host = website_host(url)
    ok = F.lower(url).rlike(r"^https?://[^/?#]+") & ~F.lower(path(url)).rlike(r"\.(png|jpe?g|gif|svg|webp|ico|pdf)$")
    for h in own_hosts:
        ok = ok & (host != h) & ~F.endswith(host, F.lit("." + h))
    return F.coalesce(ok & ~F.lower(url).contains("apply") if forbid_apply else ok, F.lit(False))


def is_detail_url(url: Column, host: str, id_param: str, forbidden: list[str]) -> Column:
    """Listing address: host suffix, id parameter, no forbidden path part, two path segments at least."""
    ok = F.endswith(netloc(url), F.lit(host)) & url.rlike(rf"[?&]{id_param}=")
    for part in forbidden:
        ok = ok & ~path(url).contains(part)
    segments = F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))
    return F.coalesce(ok & (segments >= 2), F.lit(False))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link on the page ``base``; fragments dropped, mail and script links give NULL."""
    h = F.regexp_replace(clean_or_null(href), "#.*$", "")
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.concat(root, F.regexp_extract(F.concat(path(base), F.lit("")), r"^(.*/)?", 0))
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)
    return (
        F.when(h.rlike("(?i)^(mailto|tel|javascript|data):") | (h == ""), F.lit(None).cast("string"))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .otherwise(F.concat(folder, h))
    )
