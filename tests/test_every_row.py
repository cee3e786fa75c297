"""Page queries over all rows: awkward and missing fields beside the SQL, on the test tables and on a fixture."""

import os

import oracle
import pytest
from pyspark.sql import functions as F

from leadloom.functions import pages
from leadloom.plans import page_queries, text_queries

HOTELS = [
    (1, "Put 3,  Grad & Sin <d.o.o.>", "+385 1 234 567", "https://a.example/"), (2, "Put 3, Grad", "01/234-567, 00385 1 234 568", "www.b.example"),
    (3, None, "rec. 01 / 234 567", None), (4, "Trg 1", None, "http://c.example/x?a=1&b=2"), (5, "Trg 1", None, None), (6, None, None, None),
    (7, "Grad", "012345678", "HTTPS://www.OMH.example/"), (8, "a@b, 1", " ", "https://"), (9, "", "(01) 23 45", "b.example"),
]


def test_contact_list_of_every_hotel(spark, tmp_path):
    df = spark.createDataFrame(HOTELS, "hotel_id int, address string, phone_number string, website string")
    df.write.parquet(str(tmp_path / "omh_hoteli.parquet"))
    got = {r[0]: tuple(r)[1:] for r in text_queries.QUERIES["html_contact_list"](spark, str(tmp_path)).collect()}
    assert got == {
        1: ("Put 3, Grad & Sin <d.o.o.>", "+385 1 234 567", "https://a.example"), 2: ("Put 3, Grad", "01/234-567, 00385 1 234 568", ""),
        3: ("", "rec. 01 / 234 567", ""), 4: ("Trg 1", "", "http://c.example/x?a=1&b=2"), 5: ("", "", ""), 6: ("", "", ""),
        7: ("", "012345678", ""), 8: ("", "", ""), 9: ("", "(01) 23 45", ""),
    }


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_contact_list_leaves_no_hotel_out(spark):
    name = "html_contact_list"
    oracle.compare(spark, text_queries.QUERIES[name], text_queries.ORACLE[name], "/root/testdata/sf0.1")
    assert text_queries.QUERIES[name](spark, "/root/testdata/sf0.1").count() == 1489


JOBS = [
    ("1", "Kuhar  (m/ž) ", "A & B <d.o.o.>", " Grad  Novi "), ("2", "Kuhar", None, "Grad"), ("3", "Kuhar", "Firma", None), ("4", None, "Firma", "Grad"),
    ("5", "Firma", "Firma", "Grad"), ("6", "Kuhar", "Grad", "Grad"), ("7", "Grad", "Firma", "Grad"), ("8", "Kuhar", None, None), ("9", "Kuhar", " ", ""),
]
AGENCIES = [(i, n, t, w) for i, (n, t, w) in enumerate(
    [("A & B  <GmbH>", "Bad  Ort", "https://a.example/?q=a%20b+c"), ("&amp; Co \"KG\"", "Ort & \"Dorf\"", None), (" C ", None, "www.c.example"), ("D", "Ort'", "100 % d.example"), (None, "Ort", None)]
)]
JOB_QUERIES = ["listing_row_labelled", "listing_row_positional", "listing_card_fields", "detail_page_fields", "result_card_fields"]
EVERY = [f"{n}_every" for n in [*JOB_QUERIES, "directory_card_fields"]]


@pytest.mark.parametrize("name", EVERY)
def test_awkward_rows(spark, tmp_path, name):
    jobs = spark.createDataFrame(JOBS, "id string, title string, company string, location string")
    jobs.write.parquet(str(tmp_path / "jobs.parquet"))
    df = spark.createDataFrame(AGENCIES, "agency_id int, agency_name string, city string, website string")
    df.write.parquet(str(tmp_path / "gelbeseiten_agencies.parquet"))
    os.mkdir(tmp_path / "flat")
    for t in ("jobs", "gelbeseiten_agencies"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).toPandas().to_parquet(tmp_path / "flat" / f"{t}.parquet")
    oracle.compare(spark, page_queries.QUERIES[name], page_queries.ORACLE[name], str(tmp_path / "flat"))


def test_title_with_doubled_blanks_is_the_title(spark):
    df = spark.createDataFrame([("Kuhar  (m) ",)], "t string")
    body = F.concat_ws("\n", "t", F.lit("Grad"), F.lit("Firma"))
    got = df.select(pages.listing_row(body, F.col("t")).alias("f"), pages.listing_card(body, F.col("t")).alias("g"), pages.detail_company(body, F.col("t"), F.lit("Grad")).alias("h"))
    r = got.first()
    assert (r.f.company, r.f.location, r.g.company, r.h) == ("Firma", "Grad", "Grad", "Firma")
