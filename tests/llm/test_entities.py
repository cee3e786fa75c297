"""Script, survivor, address, name and matching operators: brute force and edge cases."""

import itertools
import random
import string

import pytest
from pyspark.sql import functions as F

from leadloom.llm import matching, names
from leadloom.llm.address import parse_address, resolve_addresses, same_place_pairs
from leadloom.llm.graph import components
from leadloom.llm.scripts import confusable_values, plain
from leadloom.llm.survivor import surviving_values
from leadloom.llm.textnorm import osa_within

LONG = "Ulica naranče 5, Grad " + "x" * 20_000


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance_is_exact():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        for k in (0, 1, 2, 3):
            assert osa_within(a, b, k) == min(osa(a, b), k + 1)


def test_segment_join_misses_nothing(spark):
    """All pairs of words of one place that differ by accepted errors come out, swaps over segment borders among them."""
    rng = random.Random(5)
    some = {"".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(rng.randrange(4, 12))) for _ in range(120)}
    for w in sorted(some):
        for _ in range(2):
            b = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                i, op = rng.randrange(len(b) - 1), rng.choice("dist")
                b[i : i + 1 + (op == "t")] = {"d": [], "i": [b[i], rng.choice("abcdef")], "s": [rng.choice("abcdef")], "t": [b[i + 1], b[i]]}[op]
            some.add("".join(b))
    rows = [(n, "p", w, rng.choice([1, 1, 2])) for n, w in enumerate(sorted(some))]
    got = {tuple(sorted((r["a"], r["b"]))): r["errors"] for r in names.accepted_words(spark.createDataFrame(rows, "node long, place string, word string, support int")).collect()}
    want = {(x[0], y[0]): e for x, y in itertools.combinations(rows, 2) if (e := names.word_errors(x[2], x[3], y[2], y[3])) < 9}
    assert got == want and len(want) > 150 and 2 in want.values()


def test_near_words_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 8)))
    some, common = sorted({word() for _ in range(300)}), sorted({word() for _ in range(12)})
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = {r[0] for r in names.near_words(frame(some), frame(common)).collect()}
    assert got == {w for w in some if len(w) >= 4 and any(len(g) >= 4 and osa(w, g) <= 1 for g in common)}


@pytest.mark.parametrize(
    ("odd", "want"),
    [
        ("Меtallbau", "Metallbau"), ("ﬆrasse", "strasse"), ("Do​jotrola", "Dojotrola"), ("Ｄｏｎｊｉ", "Donji"), ("čevap", "čevap"),
        ("Graðevina", "Građevina"), ("a b", "a b"), ("x‑y", "x-y"), ("ΒΑU", "BAU"), ("𝖺bc", "abc"), ("РОЅ", "POS"),
    ],
)
def test_plain_respells(odd, want):
    assert plain(odd) == want


@pytest.mark.parametrize("ok", ["Помоћни кувар", "Кувар", "Ždralovi  d.o.o. ", "MÜLLER & Söhne", "", "a" * 9000, "Αθήνα ταξί"])
def test_plain_leaves_proper_texts(ok):
    assert plain(ok) == ok


def test_confusable_values(spark):
    rows = [("1", "Меtall", None, "x"), ("1", "Меtall", None, "x"), ("2", "plain", "Кувар", ""), ("3", None, None, None), ("4", "x" * 50_000 + "​", "b", "c")]
    df = spark.createDataFrame(rows, "id string, company string, title string, value string").withColumn("cell", F.lit(1))
    got = sorted((r[0], r[1], r[3][:7]) for r in confusable_values(df, "id", ["company", "title"]).collect())
    assert got == [("1", "company", "Metall"), ("1", "company", "Metall"), ("4", "company", "xxxxxxx")]
    assert confusable_values(df.limit(0), "id", ["company"]).count() == 0


MEMBERS = "g long, row string, employer_email string, employer_website string, employer_phone string, at int"
FIELDS = ["employer_email", "employer_website", "employer_phone"]


def test_survivor_latest_usable(spark):
    rows = [
        (1, "a", "old@firma.example", "firma.example", "036 123 4567", 1), (1, "b", "new@firma.example", "www", "+385", 2),
        (1, "c", "nema", None, "", 3), (2, "d", None, None, None, 1), (3, "e", "x@y.example", None, None, None), (None, "f", "x@y.example", "", "", 9),
        (1, "b", "new@firma.example", "www", "+385", 2),
    ]
    df = spark.createDataFrame(rows, MEMBERS).withColumn("canon", F.lit("clash")).withColumn("value", F.lit(0))
    got = {(r["g"], r["field_name"]): r["row"] for r in surviving_values(df, "g", "row", FIELDS, "at", "latest").collect()}
    assert got == {(1, "employer_email"): "b", (1, "employer_website"): "a", (1, "employer_phone"): "a", (3, "employer_email"): "e"}
    assert surviving_values(df.limit(0), "g", "row", FIELDS, "at", "latest").count() == 0


def test_survivor_consensus_and_large_groups(spark):
    rows = [(7, f"r{i}", f"info@firm{i % 40}.example", None, None, i) for i in range(400)]
    rows += [(7, f"s{i}", "info@firm.example", None, None, i) for i in range(30)]
    df = spark.createDataFrame(rows, MEMBERS)
    small = surviving_values(df, "g", "row", FIELDS, "at", "support", bucket=8).collect()
    assert [(r["value"], r["row"]) for r in small] == [("info@firm.example", "s29")]
    latest = surviving_values(df, "g", "row", FIELDS, "at", "latest", bucket=8).collect()
    assert latest[0]["row"] == "r399"


def test_address_readings():
    want = ("cestastarihlipa", "66", "brekegradec")
    for text, town in [("C. starih lipa 66", "Brekegradec"), ("66 Cesta Starih Lipa, HR-91000 BREKEGRADEC", None), ("Brekegradec, Cesta starih lipa br. 66", "Brekegradec"),
                       ("CESTA STARIH LIPA 66 BREKEGRADEC (1. KAT)", "Brekegradec, Hrvatska")]:
        assert parse_address(text, town) == want
    assert parse_address("Große Holunder Str. 29/a", "Salzmaringen") == ("grosseholunderstrasse", "29a", "salzmaringen")
    assert parse_address("Untere Quellenlp. 3", "X-Dorf")[0] == parse_address("Untere Quellenplatz 3", "X-Dorf")[0]
    assert parse_address("Put soline bb", "Grad Gornji") == ("putsoline", "", "grad gornji")
    assert parse_address("Put soline 3, Grad G.", "Grad Gornji")[2] == "grad gornji"
    assert parse_address("  ", "x") is None and parse_address(None, None) is None and parse_address(LONG, None)[1] == "5"
    assert parse_address("1a Am Forst", "Dorf am Forst") == ("amforst", "1a", "dorf am forst")


def test_same_place_pairs(spark):
    rows = [
        ("a", "Ulica naranče 5, Grad", "Grad"), ("b", "Ul. naranče 5", "Grad"), ("c", "Ulica narnače 5, 10000 Grad", None), ("d", "Ulica naranče 5, Grad", "Grad"),
        ("e", "Ulica naranče 5a, Grad", "Grad"), ("f", "Ulica naranče 5, Selo", "Selo"), ("g", None, "Grad"), ("h", "", "Grad"), ("i", "Trg lipa 5, Grad", "Grad"),
        ("j", LONG, None),
    ]
    df = spark.createDataFrame(rows, "id string, adr string, ctx string").withColumn("place", F.lit(1)).withColumn("street", F.lit("s"))
    got = {tuple(r) for r in same_place_pairs(resolve_addresses(df, "id", "adr", "ctx"), "id", "adr").collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert resolve_addresses(df.limit(0), "id", "adr", "ctx").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == 100 and got[200] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def people(spark):
    trades = ["Konoba", "Pekara", "Hotel"]
    rows = []
    for t in range(12):  # the same trades everywhere make them common words
        rows += [(f"f{t}{k}", f"{k} Firma{string.ascii_lowercase[t] * 2}{k.lower()} d.o.o.", f"mjesto{t}") for k in trades]
    rows += [
        ("1", "Konoba Šokaviždra, obrt, vl. Ivan Vrelarunac", "grad"), ("2", "KONOBA SOKAVIZDRA", "grad"), ("3", "Vrelarunac I., konoba obrt", "grad"),
        ("4", "Konoba Šokavižrda", "grad"), ("5", "Konoba Šokaviždra", "selo"), ("6", None, "grad"), ("7", "Konoba", "grad"), ("8", "Pekara Medojola", "grad"),
        ("9", "Konoba Vrelarunac", ""), ("1b", "Konoba Šokaviždra, obrt, vl. Ivan Vrelarunac", "grad"), ("10", "z" * 30_000, "grad"),
    ]
    return spark.createDataFrame(rows, "rid string, company string, place string").withColumn("words", F.lit(1)).withColumn("entity", F.lit(2))


def test_name_entities(spark):
    got = {r["rid"]: r["entity"] for r in names.name_entities(people(spark), "rid", "company", "place").collect()}
    assert got["1"] == got["2"] == got["3"] == got["4"] == got["9"] == got["1b"]
    assert got["5"] != got["1"] and got["8"] != got["1"] and "6" not in got and "7" not in got and "10" in got
    assert names.name_entities(people(spark).limit(0), "rid", "company", "place").count() == 0


def test_names_of_common_words_only(spark):
    """An employer that hires everywhere keeps its name, a trade alone is none."""
    rows = [(f"f{t}{k}", f"{k} Firma{string.ascii_lowercase[t] * 2}{k.lower()} d.o.o.", f"mjesto{t}") for t in range(12) for k in ("Konoba", "Hotel")]
    rows += [(f"c{t}{n}", name, f"mjesto{t}") for t in range(12) for n, name in enumerate(["Šikavošt Personal d.o.o.", "SIKAVOST PERSONAL", "personal šikavošt", "Mrkovil GmbH", "MRKOVIL"])]
    rows += [("k1", "Konoba", "mjesto1"), ("k2", "KONOBA", "mjesto1")]
    df = spark.createDataFrame(rows, "rid string, company string, place string")
    got = {r["rid"]: r["entity"] for r in names.name_entities(df, "rid", "company", "place").collect()}
    assert all(got[f"c{t}0"] == got[f"c{t}1"] == got[f"c{t}2"] and got[f"c{t}3"] == got[f"c{t}4"] != got[f"c{t}0"] for t in range(12))
    assert got["c10"] != got["c20"] and not {"k1", "k2"} & set(got)
    records = df.selectExpr("rid", "if(rid like '%0', 'hzz', 'mojposao') as source", "company", "place", "cast(null as string) host", "cast(null as string) phone", "cast(null as string) email")
    members, _ = matching.match_employers(records)
    pairs = {tuple(r)[:2] for r in matching.cross_source_pairs(members).collect()}
    assert {(f"c{t}0", f"c{t}{n}") for t in range(12) for n in (1, 2)} <= pairs and not any({"k1", "k2"} & set(p) for p in pairs)


TYPED = [("saffrecoklu", "safrecokku"), ("sevinjisa", "seinjusa"), ("berraupfarau", "berraufparau"), ("vrelar", "vreral"), ("mokina", "mokrna")]


def test_typed_words_that_meet_in_no_band(spark):
    rows = [(f"{s}{i}", ["hzz", "mojposao"][s], w, f"mjesto{i}", None, None, None) for i, p in enumerate(TYPED) for s, w in enumerate(p)]
    df = spark.createDataFrame(rows, "rid string, source string, company string, place string, host string, phone string, email string")
    accepted = [p for p in TYPED if names.word_errors(p[0], 1, p[1], 1) < 9]
    assert any(not set(matching.minhash_bands(a)) & set(matching.minhash_bands(b)) for a, b in accepted)
    assert matching.match_employers(df)[1].count() >= len(accepted) > 2


def test_match_across_sources(spark):
    """Held-out accuracy on invented employers with typed names and partly filled contacts."""
    rng = random.Random(9)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rows, truth = [], {}
    for e in range(240):
        core, place = "".join(rng.choices(syllables, k=5)), f"mjesto{e % 12}"
        for n in range(rng.randrange(2, 5)):
            rid, source, word = f"{e}-{n}", ["hzz", "mojposao"][n % 2], core
            if rng.random() < 0.3:
                i = rng.randrange(1, len(core) - 1)
                word = core[:i] + core[i + 1] + core[i] + core[i + 2 :]
            name = None if rng.random() < 0.1 else f"{rng.choice(['Konoba', 'Hotel', 'Pekara'])} {word.title()} d.o.o."
            pick = lambda v: v if rng.random() < 0.5 else None  # noqa: B023, E731
            rows.append((rid, source, name, place, pick(f"{core}.example"), pick(f"1{e:08d}"), pick(f"info@{core}.example")))
            if name or any(rows[-1][4:]):
                truth[rid] = (e, source)
    rows += [("z", "hzz", None, None, None, None, None), ("q", "hzz", "Hotel", "mjesto1", None, None, None), rows[0]]
    df = spark.createDataFrame(rows, "rid string, source string, company string, place string, host string, phone string, email string")
    members, links = matching.match_employers(df)
    pairs = {tuple(r)[:2] for r in matching.cross_source_pairs(members).collect()}
    ids = sorted(truth)
    want = {(a, b) for a, b in itertools.combinations(ids, 2) if truth[a][0] == truth[b][0] and truth[a][1] != truth[b][1]}
    assert len(pairs & want) / len(pairs) > 0.97 and len(pairs & want) / len(want) > 0.9
    assert not any({"z", "q"} & set(p) for p in pairs) and all(a < b for a, b in pairs)
    assert all(0 <= r["probability"] <= 1 for r in links.collect())
    empty, none = matching.match_employers(df.limit(0))
    assert empty.count() == 0 and none.count() == 0 and matching.cross_source_pairs(empty).count() == 0


def test_employer_records_blank_unusable(spark):
    cols = "id string, source string, company string, location string, employer_address string, employer_website string, employer_phone string, employer_email string, place int"
    df = spark.createDataFrame([("1", "hzz", "A", None, "Put 3, Grad", "www", "+385", "nema", 1), ("2", None, None, None, None, None, None, None, None)], cols)
    got = {r["rid"]: r for r in matching.employer_records(df).collect()}
    assert got["1"]["place"] == "grad" and got["1"]["host"] is None and got["2"]["place"] == ""
