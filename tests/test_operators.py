"""De-duplication, maintenance, admission, allocation and file operators."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadloom.functions.text import fold
from leadloom.operators.admission import AdmissionLog, admit
from leadloom.operators.allocation import cascade, cut_per_group
from leadloom.operators.dedupe import drop_reasons, first_by_key, unique_values
from leadloom.operators.upsert import append_new, update_from, upsert
from leadloom.plans.enrich import ranked_emails
from leadloom.plans.ingest import classify, limit_companies, run_summary
from leadloom.sources.csvio import existing_files, read_csv, write_csv

c = F.col


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_company_limit_takes_first_rows(spark):
    df = spark.createDataFrame([(1, "A", "u1"), (2, "a ", "u2"), (3, "B", "u3"), (4, "C", "u4"), (5, None, "u5")], "ord int, company string, detail_url string")
    assert rows(limit_companies(df, [c("ord")], 2), "ord") == [(1,), (3,)]
    assert limit_companies(df, [c("ord")], None).count() == 5
    assert limit_companies(df.limit(0), [c("ord")], 3).count() == 0


def test_first_by_key_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "x"), (4, None)], "id int, k string")
    assert rows(first_by_key(df, c("k"), [c("id")]), "id") == [(2,)]
    assert rows(first_by_key(df, c("k"), [c("id")], keep_null=True), "id") == [(1,), (2,)]


def test_drop_reason_is_first_that_holds(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, v string")
    out = drop_reasons(df, [("blank", c("v").isNull()), ("b", c("v") == "b")])
    assert rows(out, "id", "reason") == [(1, "blank"), (2, "b")]


def test_unique_values(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), (None, "3"), ("", "4"), ("c", None)], "k string, v string")
    assert rows(unique_values(df, c("k"), c("v")), "key", "value") == [("a", "1")]


def test_upsert_keeps_missing_columns_and_preserved_values(spark):
    cur = spark.createDataFrame([(1, "old", "m1", 5), (2, "keep", "m2", 6)], "id int, title string, mail string, sent int")
    new = spark.createDataFrame([(1, "x", None, 1), (1, "new", None, 2), (3, "add", "m3", 1), (None, "bad", "z", 1)], "id int, title string, mail string, v int")
    out = upsert(cur, new, ["id"], [F.desc("v")], preserve=["mail"])
    assert rows(out, "id", "title", "mail", "sent")[:2] == [(1, "new", "m1", 5), (2, "keep", "m2", 6)]
    assert out.where("id = 3 AND title = 'add' AND sent IS NULL").count() == 1 and out.count() == 3
    plain = upsert(cur, new, ["id"], [F.desc("v")])
    assert plain.where("id = 1 AND mail IS NULL").count() == 1


def test_update_and_append(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    ch = spark.createDataFrame([(2, None)], "id int, s string")
    assert sorted(update_from(cur, ch, "id", ["s"]).collect(), key=lambda r: r[0])[1][1] is None
    more = spark.createDataFrame([(2, "x"), (3, "y")], "id int, s string")
    assert append_new(cur, more, ["id"]).count() == 3


def test_classification_counts(spark):
    df = spark.createDataFrame([("Osnovna ŠKOLA", "u"), ("Dječji vrtić", "u"), ("Firma", "u"), ("Školarac", "u"), ("X", None)], "company string, detail_url string")
    s = run_summary(classify(df).withColumn("r", F.lit(1)), ["r"]).first()
    assert (s["scraped_count"], s["upserted_count"], s["failed_count"], s["excluded_count"]) == (5, 2, 1, 2)


def test_admission_matches_plain_fold(spark):
    rng = random.Random(1)
    data = [(i, rng.choice(["a", "b", None]), rng.randrange(0, 400)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in admit(df, "k", "ts", "id", 3, 60).collect()}
    want, logs = {}, {}
    for i, k, s in sorted(data, key=lambda x: (x[2], x[0])):
        if k is not None:
            want[i] = logs.setdefault(k, AdmissionLog(3, 60)).check(s)
    assert got == want
    assert admit(df.limit(0), "k", "ts", "id", 3, 60).count() == 0


def test_admission_wait_rounding():
    floor, up = AdmissionLog(1, 60, [0.0]), AdmissionLog(1, 60, [0.0], ceil=True)
    assert floor.check(30.5) == (False, 29) and up.check(30.5) == (False, 30)
    assert AdmissionLog(1, 60, [0.0]).check(60.0) == (True, 0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1000), max_size=60), st.integers(1, 4))
def test_admission_never_exceeds_limit(times, limit):
    log = AdmissionLog(limit, 50)
    accepted = [t for t in sorted(times) if log.check(t)[0]]
    assert all(sum(t - 50 < x <= t for x in accepted) <= limit for t in accepted)


def test_cascade(spark):
    df = spark.createDataFrame([(1, 3), (2, 5), (3, 4)], "id int, n bigint")
    assert rows(cascade(df, "n", [c("id")], F.lit(6)), "id", "allotted") == [(1, 3), (2, 3), (3, 0)]
    assert rows(cascade(df, "n", [c("id")], F.lit(None).cast("int")), "allotted") == [(3,), (4,), (5,)]
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "g int, i int")
    shares = spark.createDataFrame([(1, 1), (2, 0)], "g int, allotted bigint")
    assert rows(cut_per_group(items, "g", [c("i")], shares), "i") == [(1,)]


def test_csv_round_trip(spark, tmp_path):
    data = [("a", 'say "hi"', "two\nlines"), ("b", None, "x,y")]
    df = spark.createDataFrame(data, "k string, v string, w string")
    path = str(tmp_path / "out")
    write_csv(df, path)
    back = read_csv(spark, path, ["k", "v", "w"], missing_as_empty=True)
    assert rows(back, "k", "v", "w") == [("a", 'say "hi"', "two\nlines"), ("b", "", "x,y")]
    bom = tmp_path / "bom.csv"
    bom.write_bytes("﻿email,company\n".encode())
    assert read_csv(spark, str(bom)).columns == ["email", "company"] and read_csv(spark, str(bom)).count() == 0
    assert existing_files(spark, [str(bom), str(tmp_path / "none.csv")]) == [str(bom)]


def test_email_ranking(spark):
    page = "Kontakt: kontakt@firma.example. Shop: webshop@firma.example, vendor partner x@other.example"
    df = spark.createDataFrame([(1, page, "https://firma.example/kontakt", "Firma", "firma.example")], "id int, t string, u string, n string, w string")
    out = {r["email"]: (r["rank"], r["score"], r["accepted"]) for r in ranked_emails(df, "id", "t", "u", "n", "w").collect()}
    assert out["kontakt@firma.example"][0] == 1 and out["kontakt@firma.example"][2]
    assert out["kontakt@firma.example"][1] > out["webshop@firma.example"][1] > out["x@other.example"][1]


def test_fold_of_null_is_empty(spark):
    assert spark.createDataFrame([(None,)], "v string").select(fold(c("v"))).first()[0] == ""


def test_dedupe_counts(spark):
    from leadloom.plans.report_queries import dedupe_counts

    rows = [("a@x.example", "Firma"), ("b@x.example", " FIRMA "), ("", "Firma"), (None, "Neu"), ("c@x.example", None), ("C@x.example", ""), ("d@x.example", "Neu")]
    df = spark.createDataFrame(rows, "email string, company string").withColumn("n", F.lit(1)).withColumn("k", F.lit("k"))
    assert tuple(dedupe_counts(df, "email", "company").first()) == (3, 2, 2)
    assert tuple(dedupe_counts(df.limit(0), "email", "company").first()) == (0, 0, 0)


def test_cascade_over_many_partitions(spark):
    from leadloom.operators.allocation import cascade

    rows = [(i, (i * 7) % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, wanted int")
    got = {r["k"]: r["allotted"] for r in cascade(df, "wanted", [F.col("k")], F.lit(200), buckets=16).collect()}
    left, want = 200, {}
    for k, n in rows:
        want[k] = min(n, left)
        left -= want[k]
    assert got == want
    free = cascade(df, "wanted", [F.col("k")], F.lit(None).cast("int"), buckets=3).collect()
    assert all(r["allotted"] == r["wanted"] for r in free) and cascade(df.limit(0), "wanted", [F.col("k")], F.lit(1)).count() == 0


def test_csv_with_byte_order_mark(spark, tmp_path):
    from leadloom.sources.csvio import read_csv, write_csv

    df = spark.createDataFrame([("a", 'x "y"\nz, 1'), (None, "š")], "name string, note string")
    write_csv(df, str(tmp_path / "out"), byte_order_mark=True)
    head = next((tmp_path / "out").glob("part*")).read_bytes()
    back = read_csv(spark, str(tmp_path / "out"), missing_as_empty=True)
    assert head.startswith(b"\xef\xbb\xbf") and sorted(map(tuple, back.collect())) == [("", "š"), ("a", 'x "y"\nz, 1')]
