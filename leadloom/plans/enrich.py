"""Spreading known contacts over rows of one company and ranking addresses found on its pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.extract import email_candidates, is_email
from leadloom.functions.text import casefold_key, collapse_ws, fold
from leadloom.functions.urls import domains_match, normalize_website_strict, path, website_host
from leadloom.operators.dedupe import unique_values

# Hints and weights of the address ranking; an earlier entry of the first two lists weighs more.
PATH_HINTS = (
    "contact", "kontakt", "contacts", "about", "o-nama", "o_nama", "about-us", "careers", "career", "jobs", "job",
    "karijere", "karijera", "posao", "zaposlenje", "zaposljavanje", "careers-contact",
)
PREFERRED_LOCAL = (
    "contact", "kontakt", "info", "hr", "kadrovska", "kadrovi", "company", "office", "general", "jobs", "careers",
    "career", "hiring", "recruitment", "employment", "posao", "karijere",
)
LOW_LOCAL = (
    "onlineshop", "webshop", "shop", "store", "orders", "press", "media", "pr", "news", "marketing",
)
CONTEXT_WORDS = (
    "contact", "kontakt", "email", "e-mail", "mail", "reach", "support", "info", "career", "careers", "job", "jobs",
    "apply", "application", "applications", "prijava", "prijave", "posao", "karijera", "karijere", "hr",
    "human resources", "recruitment", "hiring",
)
FOREIGN_WORDS = ("partner", "vendor", "external", "agency", "supplier", "outsourced")
ACCEPT_SCORE = 25
SPAN = 120


def _first_hit(c: Column, words: tuple[str, ...], top: int) -> Column:
    """``top`` minus the position of the first listed word that ``c`` contains, else 0."""
    out = F.lit(0)
    for i, w in reversed(list(enumerate(words))):
        out = F.when(c.contains(w), F.lit(top - i)).otherwise(out)
    return out


def _hits(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def score_email(email: Column, text: Column, page_url: Column, company: Column, site_host: Column) -> Column:
    """Rank of an address found on a page: domain, local part, page path and the words around every occurrence."""
    low, mail = F.lower(F.coalesce(text, F.lit(""))), F.lower(email)
    local = F.substring_index(mail, "@", 1)
    tokens = F.filter(F.split(fold(company), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)
    named = lambda window: F.exists(tokens, lambda t: window.contains(t))
    # text between occurrences: the window around occurrence i ends the piece before and starts the piece after
    pieces = F.split(low, F.concat(F.lit(r"\Q"), mail, F.lit(r"\E")), -1)

    def around(i: Column) -> Column:
        """120 characters either side of the i-th occurrence, rebuilt from the pieces."""
        prefix = F.call_function("array_join", F.slice(pieces, 1, i), mail)
        suffix = F.call_function("array_join", F.slice(pieces, i + 1, F.size(pieces)), mail)
        before = F.substring(prefix, F.greatest(F.length(prefix) - SPAN + 1, F.lit(1)), F.lit(SPAN))
        return F.concat(before, mail, F.substring(suffix, 1, SPAN))

    occurrences = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    context = F.aggregate(
        F.transform(
            occurrences,
            lambda i: 8 * _hits(around(i), CONTEXT_WORDS) - 18 * _hits(around(i), FOREIGN_WORDS) + F.when(named(around(i)), 12).otherwise(0),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return (
        F.when(domains_match(F.substring_index(mail, "@", -1), site_host), 100).otherwise(10)
        + _first_hit(local, PREFERRED_LOCAL, 40)
        - F.when(reduce(lambda a, b: a | b, [local.contains(w) for w in LOW_LOCAL]), 25).otherwise(0)
        + _first_hit(F.lower(F.coalesce(path(page_url), F.lit(""))), PATH_HINTS, 30)
        + context
        + F.when(named(low), 4).otherwise(0)
        + F.greatest(F.lit(10) - F.length(local), F.lit(0))
    )


def ranked_emails(pages: DataFrame, page_id: str, text: str, url: str, company: str, website: str) -> DataFrame:
    """(<page_id>, email, score, rank, accepted) of every distinct address of every page, best first.

    Ties go to the shorter address, then to the smaller text.
    """
    host = website_host(F.col(website))
    found = pages.select(
        page_id, text, url, company, host.alias("_host"), F.explode(F.array_distinct(email_candidates(F.col(text)))).alias("raw")
    ).withColumn("email", F.regexp_replace("raw", r"^[.,;:()\[\]<>\"']+|[.,;:()\[\]<>\"']+$", ""))
    scored = (
        found.where(is_email(F.col("email")))
        .withColumn("score", score_email(F.col("email"), F.col(text), F.col(url), F.col(company), F.col("_host")))
        .dropDuplicates([page_id, "email"])
    )
    order = F.struct((-F.col("score")).alias("s"), F.length("email").alias("l"), F.col("email").alias("e"))
    accepted = domains_match(F.lower(F.substring_index("email", "@", -1)), F.col("_host")) | (F.col("score") >= ACCEPT_SCORE)
    w = Window.partitionBy(page_id).orderBy(order)
    return scored.select(page_id, "email", "score", F.row_number().over(w).alias("rank"), accepted.alias("accepted"))


def company_history(jobs: DataFrame, key: Column) -> DataFrame:
    """Per company of earlier rows: (company_key, known_email, had_failure).

    The known address is the one with the best local part (preferred names first, unwanted ones last, short ones
    before long ones), then the latest update, then the greatest text. A lookup has failed before if a row is marked
    unusable or was ever attempted.
    """
    mail = collapse_ws(F.col("employer_email"))
    local = F.lower(F.substring_index(mail, "@", 1))
    unwanted = reduce(lambda a, b: a | b, [local.contains(w) for w in LOW_LOCAL])
    score = _first_hit(local, PREFERRED_LOCAL, 100) - F.when(unwanted, 50).otherwise(0) + F.greatest(F.lit(20) - F.length(local), F.lit(0))
    best = F.when(is_email(mail), F.struct(score.alias("score"), F.col("updated_at").alias("at"), mail.alias("email")))
    failed = (
        F.coalesce("email_enrichment_unusable", F.lit(False))
        | (F.coalesce("email_enrichment_attempt_count", F.lit(0)) > 0)
        | F.col("email_enrichment_last_attempt_at").isNotNull()
    )
    return (
        jobs.select(key.alias("company_key"), best.alias("_best"), failed.alias("_failed"))
        .where("company_key IS NOT NULL AND company_key <> ''")
        .groupBy("company_key")
        .agg(F.max("_best").alias("_best"), F.bool_or("_failed").alias("had_failure"))
        .select("company_key", F.col("_best.email").alias("known_email"), "had_failure")
    )


def reuse_emails(rows: DataFrame, email: str, website: str, company: str) -> DataFrame:
    """Adds ``reused_email`` and ``reused_by``: unique known address by website, else company, else host."""
    keys = {
        "website": normalize_website_strict(F.col(website)),
        "company": casefold_key(F.col(company)),
        "host": website_host(F.col(website)),
    }
    known = F.when(is_email(F.trim(email)), casefold_key(F.col(email)))
    out = rows
    for name, key in keys.items():
        seeds = unique_values(rows, key, known).select(F.col("key").alias(f"_{name}"), F.col("value").alias(f"_{name}_email"))
        out = out.join(seeds, F.nullif(key, F.lit("")) == F.col(f"_{name}"), "left")
    pick = F.coalesce(*[F.col(f"_{n}_email") for n in keys])
    by = F.coalesce(*[F.when(F.col(f"_{n}_email").isNotNull(), F.lit(n)) for n in keys])
    missing = known.isNull()
    drop = [c for n in keys for c in (f"_{n}", f"_{n}_email")]
    return (
        out.withColumn("reused_email", F.when(missing, pick)).withColumn("reused_by", F.when(missing, by)).drop(*drop)
    )
