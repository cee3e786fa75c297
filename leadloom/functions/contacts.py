"""Contact fields as Column expressions: usability, canonical forms, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of the listing portals; their own contacts never identify an employer.
PORTAL_HOSTS = ("hzz.example", "mojposao.example", "meinestadt.example", "gelbeseiten.example")
# File endings that make an address-like string an asset name.
ASSET_TLDS = r"(png|jpe?g|gif|webp|svg|ico|bmp|tiff?|css|js|pdf)"

# a label starts and ends with a letter or digit; possessive, so no position is tried twice
_LABEL = r"[\p{L}\p{N}][\p{L}\p{N}-]*+(?<!-)"
HOST_PATTERN = rf"^(?:{_LABEL}\.)+\p{{L}}{{2,24}}$"
EMAIL_PATTERN = rf"^[\p{{L}}\p{{N}}._%+'-]++@(?:{_LABEL}\.)+\p{{L}}{{2,24}}$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host without scheme, ``www.``, user, port, path, query or fragment; NULL if blank."""
    bare = F.regexp_replace(F.lower(blank_to_null(url)), r"^[a-z][a-z0-9+.-]*:/+", "")
    bare = F.regexp_replace(bare, r"[/?#].*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[^@]*@", ""), r":\d+$", "")
    return F.nullif(F.regexp_replace(bare, r"^www\.", ""), F.lit(""))


def is_portal_host(host: Column) -> Column:
    out = F.lit(False)
    for p in PORTAL_HOSTS:
        out = out | (host == p) | host.endswith("." + p)
    return out


def usable_website(url: Column) -> Column:
    """Well-formed host with a dot that is not a portal's; NULL counts as unusable."""
    host = host_of(url)
    well_formed = host.rlike(HOST_PATTERN) & ~host.rlike(rf"\.{ASSET_TLDS}$")
    well_formed = well_formed & (F.length(host) <= 253)
    return F.coalesce(well_formed & ~is_portal_host(host) & ~blank_to_null(url).rlike(r"\s"), F.lit(False))


def usable_email(email: Column) -> Column:
    e = F.regexp_replace(F.lower(blank_to_null(email)), r"^mailto:", "")
    host = F.substring_index(e, "@", -1)
    ok = (F.length(e) <= 254) & e.rlike(EMAIL_PATTERN) & ~e.rlike(rf"\.{ASSET_TLDS}$") & ~e.rlike(r"\.\.|^\.|\.@")
    return F.coalesce(ok & ~is_portal_host(host), F.lit(False))


def phone_digits(phone: Column) -> Column:
    return F.regexp_replace(phone, r"\D", "")


def usable_phone(phone: Column) -> Column:
    """At least nine digits, only phone punctuation, not one digit throughout."""
    d = phone_digits(phone)
    shape = blank_to_null(phone).rlike(r"^(?i)(tel|mob|fon|phone|rec|fax)?[.: ]*[+\d(][\d\s\p{Z}()/.+-]*\d\)?$")
    return F.coalesce(shape & (F.length(d) >= 9) & (F.length(d) <= 16) & ~d.rlike(r"^(\d)\1*$"), F.lit(False))


def canonical_email(email: Column) -> Column:
    return F.regexp_replace(F.lower(blank_to_null(email)), r"^mailto:", "")


def canonical_phone(phone: Column) -> Column:
    """National digits: international prefix, country code 385 or 49 and trunk zeros are dropped."""
    d = phone_digits(phone)
    international = blank_to_null(phone).rlike(r"^[^\d+]*\+") | d.startswith("00")
    rest = F.regexp_replace(d, r"^0+", "")
    return F.when(international, F.regexp_replace(rest, r"^(385|49)0*", "")).otherwise(rest)


USABLE = {"employer_email": usable_email, "employer_website": usable_website, "employer_phone": usable_phone}
CANONICAL = {"employer_email": canonical_email, "employer_website": host_of, "employer_phone": canonical_phone}
