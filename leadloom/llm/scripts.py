"""Visually identical text with different characters (problem 3).

``plain`` brings a text to plain spelling: compatibility forms, combining sequences, invisible characters,
odd blanks and punctuation are normalised, and every token is written in one script. For a token the script
sets of its letters are intersected; an empty intersection (mixed scripts) or a token that lies wholly in
another script but consists of look-alikes only (whole-script confusable) is respelled in the consistent
script. A token whose script is vouched for by unmistakable letters in the same text stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look the same as a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Һ": "H",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "Ѵ": "V", "ӏ": "l", "Ӏ": "I",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï", "ђ": "đ", "Ђ": "Đ",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Ս": "U", "Տ": "S",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꭱ": "R",
}
# Similar enough to pass inside a word of another script, but no evidence on their own.
SIMILAR = {
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "ү": "y",
    "α": "a", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ρ": "p", "σ": "o", "τ": "t", "υ": "u",
    "ω": "w", "χ": "x", "ո": "n", "ց": "g", "զ": "q", "Լ": "L",
}
# Latin letters outside the alphabets in use that look like one inside them.
LATIN_LOOKALIKES = {"ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g", "ǀ": "l", "ꞵ": "ß"}
# Punctuation and digits' neighbours with an ordinary ASCII spelling.
PUNCTUATION = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "ʼ": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"', "«": '"', "»": '"', "″": '"',
    "⁄": "/", "∕": "/", "∶": ":", "․": ".", "。": ".", "´": "'",
}
# Letters that the plain spelling of the texts' languages uses; a text of only these needs no further look.
PLAIN_PATTERN = r"^[\x20-\x7eČčĆćŽžŠšĐđÄäÖöÜüß]*$"

_INVISIBLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯"
    "ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f-\x9f]"
)
_TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")


@lru_cache(maxsize=65_536)
def script_of(ch: str) -> str:
    """First word of the character's Unicode name, which is its script for letters."""
    return unicodedata.name(ch, "UNKNOWN").split(" ", 1)[0]


@lru_cache(maxsize=65_536)
def script_set(ch: str) -> frozenset[str]:
    """Scripts the letter can be read in: its own, and Latin if it looks the same as a Latin letter."""
    own = script_of(ch)
    return frozenset((own, "LATIN")) if ch in LOOKALIKES else frozenset((own,))


_LATIN_READING = SIMILAR | LOOKALIKES | LATIN_LOOKALIKES
_TO_OTHER = {
    script: {v: k for k, v in LOOKALIKES.items() if script_of(k) == script} for script in ("CYRILLIC", "GREEK")
}


def _respell(token: str, vouched: frozenset[str]) -> str:
    own = {script_of(c) for c in token}
    if own == {"LATIN"}:
        return "".join(LATIN_LOOKALIKES.get(c, c) for c in token)
    resolved = frozenset.intersection(*(script_set(c) for c in token))
    if len(own) == 1:
        script = next(iter(own))
        if "LATIN" in resolved and script not in vouched:  # whole-script confusable
            return "".join(LOOKALIKES.get(c, c) for c in token)
        return token
    if "LATIN" in resolved:  # mixed, and the Latin reading covers every letter
        return "".join(_LATIN_READING.get(c, c) for c in token)
    counts = {s: sum(script_of(c) == s for c in token) for s in own}
    for script in sorted(own - {"LATIN"}):  # mixed, and only another script can cover it
        table = _TO_OTHER.get(script, {})
        if counts[script] > counts.get("LATIN", 0) and all(script_of(c) == script or c in table for c in token):
            return "".join(c if script_of(c) == script else table[c] for c in token)
    return "".join(_LATIN_READING.get(c, c) for c in token)


def _plain(text: str) -> str:
    text = _INVISIBLE.sub("", text)
    text = "".join(
        " " if unicodedata.category(c) in ("Zs", "Zl", "Zp") else PUNCTUATION.get(c, c) for c in text
    )
    text = unicodedata.normalize("NFKC", text)
    # scripts with letters that cannot be mistaken for Latin, in a token without Latin letters
    vouched = frozenset(
        script_of(t[0])
        for t in _TOKEN.findall(text)
        if len({script_of(c) for c in t}) == 1 and any(script_set(c) == {script_of(c)} for c in t)
    )
    return _TOKEN.sub(lambda m: _respell(m.group(), vouched), text)


_plain_cached = lru_cache(maxsize=65_536)(_plain)


def plain(text: str) -> str:
    """The plain spelling of ``text``; unchanged exactly if the text is plain already. Short texts are remembered."""
    return _plain_cached(text) if len(text) <= 200 else _plain(text)


def plain_text(column: Column) -> Column:
    """Plain spelling of a string column; NULL stays NULL. Only texts outside plain letters visit Python."""

    def respell(values: pd.Series) -> pd.Series:
        return values.map(lambda v: plain(v) if isinstance(v, str) else None).astype("object")

    return F.when(column.rlike(PLAIN_PATTERN), column).otherwise(F.pandas_udf(respell, "string")(column))


def confusable_values(df: DataFrame, id_col: str, columns: list[str], id_as: str | None = None) -> DataFrame:
    """(<id>, field_name, value, plain_value) of every value that is not in plain spelling.

    NULL and empty values are no cases; values of any length are read whole; repeated rows each give their
    own row; extra columns are ignored. No shuffle: the built-in pattern keeps plain values in the JVM and
    only the rest (a small share) passes through one Arrow batch function.
    """

    def respell(values: pd.Series) -> pd.Series:
        return values.map(plain).astype("object")

    cells = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in columns])
    odd = F.filter(cells, lambda x: x["v"].isNotNull() & ~x["v"].rlike(PLAIN_PATTERN))
    return (
        df.select(F.col(id_col).alias(id_as or id_col), F.explode(odd).alias("cell"))
        .select(id_as or id_col, F.col("cell.f").alias("field_name"), F.col("cell.v").alias("value"))
        .withColumn("plain_value", F.pandas_udf(respell, "string")(F.col("value")))
        .where(F.col("plain_value") != F.col("value"))
    )
