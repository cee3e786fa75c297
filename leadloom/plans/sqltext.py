"""SQL spellings of the text functions, for the counterparts of the queries."""

from __future__ import annotations

from leadloom.functions.text import accent_tables, fold_tables

WS = r"[\s\x1c-\x1f\x85\pZ]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def or_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')")


def _ascii(x: str) -> str:
    src, dst = fold_tables()
    return f"lower(regexp_replace(translate(coalesce({x}, ''), {_q(src)}, {_q(dst)}), '[^\\x00-\\x7F]', '', 'g'))"


def fold(x: str) -> str:
    return strip(f"regexp_replace({_ascii(x)}, '[\\s\\x1c-\\x1f]+', ' ', 'g')")


def fold_keep(x: str) -> str:
    src, dst = accent_tables()
    bare = f"regexp_replace(translate(coalesce({x}, ''), {_q(src)}, {_q(dst)}), '\\p{{Mn}}', '', 'g')"
    return collapse(f"replace(lower({bare}), 'ß', 'ss')")


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace({_ascii(x)}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def slug_hr(x: str) -> str:
    mapped = f"translate(lower(coalesce({x}, '')), 'čćšžđ', 'ccszd')"
    return f"regexp_replace(regexp_replace({mapped}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def with_scheme(x: str) -> str:
    u = or_null(x)
    return f"(CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN {u} ELSE 'https://' || {u} END)"


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"


def url_part(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{_URL}', {n})"


def host(x: str) -> str:
    return f"coalesce(regexp_replace(lower({url_part(with_scheme(x), 2)}), '^www\\.', ''), '')"


def company_key(company: str, url: str) -> str:
    return f"coalesce(nullif({fold(company)}, ''), 'detail:' || {url})"


EMAIL = r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"


def is_email(x: str) -> str:
    return rf"regexp_matches({x}, '(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}$')"
