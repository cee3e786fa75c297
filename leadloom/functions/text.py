"""Text cleaning, folding and key functions as Column expressions.

White space is the explicit class below: it equals what Python calls a blank, which the engine's own ``\\s`` and
``trim`` do not (no-break and ideographic spaces, unit separators).
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\p{Z}]"


@cache
def fold_tables() -> tuple[str, str]:
    """(from, to) strings of every BMP character whose compatibility decomposition leaves one ASCII character."""
    src, dst = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        ascii_form = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(ascii_form) == 1:
            src.append(ch)
            dst.append(ascii_form)
    return "".join(src), "".join(dst)


@cache
def expansion_table() -> dict[str, str]:
    """Characters that decompose to several ASCII characters (ligatures, fractions, symbols)."""
    out = {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ascii_form = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(ascii_form) > 1:
            out[chr(code)] = ascii_form
    return out


@cache
def accent_tables() -> tuple[str, str]:
    """(from, to) strings of precomposed letters whose decomposition leaves one base character, of any script."""
    src, dst = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_or_null(c: Column) -> Column:
    """Stripped text; blank becomes NULL."""
    return F.nullif(strip_ws(c), F.lit(""))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank, ends are stripped; NULL becomes the empty text."""
    return strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def unescape_html(c: Column) -> Column:
    """Five common entities, no-break space and numeric references; the ampersand last."""
    out = F.coalesce(c, F.lit(""))
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("#x27", "'"), ("nbsp", " ")):
        out = F.regexp_replace(out, f"&{name};", ch)
    return F.regexp_replace(out, "&amp;", "&")


def escape_html(c: Column) -> Column:
    """Markup characters as entities, the ampersand first."""
    for ch, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        c = F.replace(c, F.lit(ch), F.lit(f"&{name};"))
    return c


def clean_html_text(c: Column) -> Column:
    return collapse_ws(unescape_html(c))


def percent_decode(c: Column) -> Column:
    """Percent decoding that leaves a plus sign alone; malformed input is returned as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def fold(c: Column) -> Column:
    """Compatibility-decomposed ASCII, lower case, blanks collapsed: the company key form."""
    src, dst = fold_tables()
    ascii_only = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), src, dst), r"[^\x00-\x7F]", "")
    return strip_ws(F.regexp_replace(F.lower(ascii_only), r"[\s\x1c-\x1f]+", " "))


def fold_exact(c: Column) -> Column:
    """``fold`` that also spells out ligatures and fractions, for texts that hold any."""
    out = F.coalesce(c, F.lit(""))
    several = expansion_table()
    probe = "[" + "".join(f"\\x{{{ord(k):x}}}" for k in several) + "]"
    replaced = F.aggregate(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in several.items()]),
        out,
        lambda acc, kv: F.replace(acc, kv["k"], kv["v"]),
    )
    return fold(F.when(out.rlike(probe), replaced).otherwise(out))


def fold_keep(c: Column) -> Column:
    """Combining marks dropped, letters without decomposition kept, sharp s spelled out, blanks collapsed."""
    src, dst = accent_tables()
    bare = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), src, dst), r"\p{Mn}", "")
    return collapse_ws(F.replace(F.lower(bare), F.lit("ß"), F.lit("ss")))


def slug(c: Column) -> Column:
    """ASCII slug with underscores."""
    src, dst = fold_tables()
    ascii_only = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), src, dst), r"[^\x00-\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug_hr(c: Column) -> Column:
    """Slug that maps the five Croatian letters and turns every other accent into a separator."""
    mapped = F.translate(F.lower(F.coalesce(c, F.lit(""))), "čćšžđ", "ccszd")
    return F.regexp_replace(F.regexp_replace(mapped, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def casefold_key(c: Column) -> Column:
    return F.lower(collapse_ws(c))


def strip_count(c: Column) -> Column:
    """Drops a trailing count of a category label."""
    return F.regexp_replace(collapse_ws(c), r"\s+\d+$", "")


def company_key(company: Column, detail_url: Column) -> Column:
    """Folded company, else the listing itself."""
    return F.coalesce(F.nullif(fold(company), F.lit("")), F.concat(F.lit("detail:"), detail_url))


def parse_date(c: Column) -> Column:
    """Dates written ``d.m.Y.``, ``d.m.Y`` or ``Y-m-d`` with any blanks inside; anything else is NULL."""
    packed = F.regexp_replace(c, f"{WS}+", "")
    return F.coalesce(
        F.try_to_date(F.when(packed.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}\.?$"), F.rtrim(packed, F.lit("."))), "d.M.yyyy"),
        F.try_to_date(F.when(packed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), packed), "yyyy-M-d"),
    )


def parse_timestamp(c: Column) -> Column:
    """ISO timestamps; ``Z`` is UTC, a missing zone is UTC, blank is NULL, anything else is NULL."""
    return F.try_to_timestamp(F.nullif(strip_ws(c), F.lit("")))


def city_after_code(c: Column) -> Column:
    """City of "<5 digits> <city>", else the text itself."""
    text = collapse_ws(c)
    found = F.regexp_extract(text, r"\d{5}\s+(.+)$", 1)
    return F.when(found != "", found).otherwise(text)


def city_after_comma(c: Column) -> Column:
    return F.when(c.contains(","), collapse_ws(F.substring_index(c, ",", -1))).otherwise(F.lit(""))


def decode_base64(c: Column) -> Column:
    """Text of a base64 value; missing padding is accepted, invalid input gives the empty text."""
    return F.coalesce(F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8"), F.lit(""))


_PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"


def render(template: Column, values: Column) -> Column:
    """Fills ``{{ key }}`` from a map in one pass; unknown and NULL keys give the empty text.

    Literals and keys are split once and joined again, so values that hold braces or ``$`` stay as they are.
    """
    literals = F.split(template, _PLACEHOLDER, -1)
    keys = F.regexp_extract_all(template, F.lit(_PLACEHOLDER), 1)
    return F.array_join(
        F.transform(
            literals,
            lambda text, i: F.concat(text, F.coalesce(F.try_element_at(values, F.get(keys, i)), F.lit(""))),
        ),
        "",
    )
