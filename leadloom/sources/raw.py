"""Schemas of the raw listing items, one per source, and how they are read from JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields of the raw items; every one a nullable string.
RAW_FIELDS = {
    "hzz": "title company location employees_needed employment_type working_hours accommodation valid_from valid_to "
    "jobseeker_info detail_url email phone employer_address source".split(),
    "mojposao": "title company location detail_url employer_website published_at category source".split(),
    "meinestadt": "title company location published_at detail_url category employer_email email employer_website source".split(),
    "gelbeseiten": "title company address city location email phone website employer_address employer_website "
    "detail_url source category".split(),
}


def raw_items(payloads: DataFrame, payload: str, source: str) -> DataFrame:
    """Columns of ``payloads`` plus the struct ``raw``; broken JSON gives a struct of NULLs."""
    schema = ", ".join(f"{c} string" for c in RAW_FIELDS[source])
    return payloads.withColumn("raw", F.from_json(payload, schema))
