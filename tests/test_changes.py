"""Snapshot changes and packed fields: brute force and edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators.multivalue import learn, split_packed
from leadloom.operators.snapshots import json_content_hash, snapshot_changes

RUNS = "id string, source string, status string, created_at int"
SNAPS = "id string, run_id string, detail_url string, job_payload string, scraped_at int, source string, idx int, h int"


def brute(runs, snaps):
    out = set()
    for source in {r[1] for r in runs}:
        order = [r[0] for r in sorted((r for r in runs if r[1] == source and r[2] == "completed"), key=lambda r: (r[3], r[0]))]
        states = []
        for run in order:
            best = {}
            for s in snaps:
                if s[1] == run and s[2] is not None:
                    key = (s[4] is not None, s[4] or 0, s[0])
                    if s[2] not in best or key > best[s[2]][0]:
                        content = {k: v for k, v in json.loads(s[3]).items() if v not in (None, "")}
                        best[s[2]] = (key, content)
            states.append({u: v[1] for u, v in best.items()})
        for i in range(1, len(order)):
            old, new = states[i - 1], states[i]
            out |= {(order[i], u, "added") for u in new.keys() - old.keys()}
            out |= {(order[i], u, "removed") for u in old.keys() - new.keys()}
            out |= {(order[i], u, "changed") for u in new.keys() & old.keys() if new[u] != old[u]}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes_match_brute_force(spark, seed):
    rng = random.Random(seed)
    runs = [(f"r{i}", rng.choice("ab"), rng.choice(["completed", "completed", "failed"]), rng.randrange(5)) for i in range(10)]
    snaps = []
    for i in range(250):
        item = {"t": rng.choice(["x", "y"]), "e": rng.choice([None, "", "z"])}
        if rng.random() < 0.3:
            del item["e"]
        text = json.dumps(item, indent=rng.choice([None, 1]), sort_keys=rng.random() < 0.5)
        snaps.append((f"s{i}", rng.choice([r[0] for r in runs] + ["none"]), rng.choice(["u1", "u2", "u3", "u4", None]), text, rng.choice([None, 1, 2, 3]), "q", 1, 1))
    got = snapshot_changes(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(runs, RUNS))
    rows = [tuple(r) for r in got.select("run_id", "detail_url", "change_kind").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(runs, snaps)


def test_changes_of_empty_tables(spark):
    none = snapshot_changes(spark.createDataFrame([], SNAPS), spark.createDataFrame([], RUNS))
    assert none.count() == 0 and none.columns == ["run_id", "detail_url", "change_kind"]


def test_completed_run_without_rows_removes_all(spark):
    runs = [("a", "s", "completed", 1), ("b", "s", "completed", 2), ("c", "s", "completed", 3)]
    snaps = [("1", "a", "u", "{}", 1, "s", 0, 0), ("2", "c", "u", "{}", 1, "s", 0, 0)]
    got = snapshot_changes(spark.createDataFrame(snaps, SNAPS), spark.createDataFrame(runs, RUNS))
    assert {tuple(r) for r in got.collect()} == {("b", "u", "removed"), ("c", "u", "added")}


def test_content_hash_ignores_layout_and_blanks(spark):
    texts = ['{"a":1,"b":null}', '{ "b": "", "a": 1 }', '{"a":1}', '{"a":2}', "broken", None, "{}", '{"a":"\\u010d"}', '{"a":"č"}']
    h = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(json_content_hash(F.col("t"))).collect()]
    assert h[0] == h[1] == h[2] != h[3] and h[5] == h[6] != h[4] and h[7] == h[8]


FIELDS = {"email": "email", "phone": "phone"}


def split(spark, rows):
    df = spark.createDataFrame(rows, "id int, email string, phone string, item string, items string, pos int")
    out = {}
    for r in split_packed(df, "id", FIELDS).orderBy("id", "field_name", "item_no").collect():
        assert r["item_no"] == len(out.setdefault((r["id"], r["field_name"]), [])) + 1
        out[r["id"], r["field_name"]].append(r["item"])
    return out


def test_split_packed_fields(spark):
    mails = ["a@x.example;b@x.example", '"Firma, recepcija" <r@x.example>, "Firma, info" <i@x.example>', "mailto:s@x.example", "a@x.example a@x.example",
             '"a@x.example","b@x.example"', "info: i@x.example prodaja: p@x.example", None, "", "   ", "nema"]
    phones = ["(036) 697-53-90, 036 9955039", "+385 (0)1 234567|00385111222333", "tel. 058/364-6634 mob: +385 90 391 7693", "058 472 7192\n090/400-4875",
              '"+385 28 039 8552";"090 580 4378"', "027 609 1431 / 090 798 0334 / 027 769 7337", "036 123 4567", None, "nema", ""]
    base = [(i, m, p, "x", "y", 0) for i, (m, p) in enumerate(zip(mails, phones, strict=True))]
    filler = [(100 + i, f"u{i}@x.example", f"0{36 + i % 9} {100 + i} {1000 + 7 * i}", "", "", 0) for i in range(60)]
    got = split(spark, base + filler)
    assert got[0, "email"] == ["a@x.example", "b@x.example"] and got[1, "email"] == ["r@x.example", "i@x.example"]
    assert got[2, "email"] == ["s@x.example"] and got[3, "email"] == ["a@x.example"] * 2 and got[4, "email"] == ["a@x.example", "b@x.example"]
    assert got[5, "email"] == ["i@x.example", "p@x.example"] and not any((i, "email") in got for i in (6, 7, 8, 9))
    assert got[0, "phone"] == ["0366975390", "0369955039"] and got[1, "phone"] == ["+38501234567", "00385111222333"]
    assert got[2, "phone"] == ["0583646634", "+385903917693"] and got[3, "phone"] == ["0584727192", "0904004875"]
    assert got[4, "phone"] == ["+385280398552", "0905804378"] and got[5, "phone"] == ["0276091431", "0907980334", "0277697337"]
    assert got[6, "phone"] == ["0361234567"] and not any((i, "phone") in got for i in (7, 8, 9))


def test_split_packed_long_and_empty(spark):
    many = "; ".join(f"m{i}@x.example" for i in range(3000))
    got = split(spark, [(1, many, ", ".join(f"036 12{i:02d} 345" for i in range(100)), "", "", 0)])
    assert got[1, "email"] == [f"m{i}@x.example" for i in range(3000)] and len(got[1, "phone"]) == 100
    empty = spark.createDataFrame([], "id int, email string, phone string")
    assert split_packed(empty, "id", FIELDS).count() == 0


def test_split_packed_number_of_many_atoms(spark):
    """Digits written one by one: a number of 19 atoms stays one number."""
    got = split(spark, [(1, None, "0 9 1 2 3 4 5 6 7 8", "", "", 0), (2, None, "036 123 4567, 0 9 1 2 3 4 5 6 7 9", "", "", 0)])
    assert got[1, "phone"] == ["0912345678"] and got[2, "phone"] == ["0361234567", "0912345679"]


def test_learn_keeps_every_atom(spark):
    """More atoms and shapes than the driver was ever given (20,000): each has its learned weight."""
    n = 20_500
    word = F.translate(F.lpad(F.col("id").cast("string"), 5, "0"), "0123456789", "abcdefghij")
    df = spark.range(n).select(F.concat(word, F.lit(": 036 123 4567")).alias("phone"))
    weighted, totals = learn(df, "phone", "phone", 1)
    kept = weighted.select(F.explode("counts").alias("c")).select("c.*").distinct()
    assert kept.where("what = 'n' AND shape LIKE '%:' AND n > 0.9").count() == n
    assert totals["v"] == pytest.approx(n, rel=0.01)
