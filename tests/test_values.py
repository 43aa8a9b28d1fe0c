"""Made values, their variants, corrections of entities and near duplicates by group."""

import itertools
import re

from pyspark.sql import functions as F

from speechloom.operators import dedup, gates
from speechloom.operators import entities as E
from speechloom.operators import values as V
from speechloom.plans import value_queries as Q

SF = "/root/testdata/sf0.01"
RAWS = {
    "number": {"$5": r"\$\d+\.\d\d", "$0.50": r"\$\d+\.\d\d", "40%": r"\d+%", "7 percent": r"\d+ percent", "0": "[1-5]", "999": r"99\d", "99999": r"99\d\d\d", "123456": r"12345\d", "9" * 30: "9{29}\\d", "1.2.10": r"1\.2\.\d", "seven": "[a-z]+"},
    "time": {"noon": "midnight", "5 pm": r"\d+ PM", "17:45": r"\d+:\d\d", "10:30 AM": r"\d+:\d\d AM", "quarter to 12": r"quarter to \d+", "7 o'clock": r"\d+ o'clock", "dawn": ".+"},
    "date": {"Friday": "[A-Za-z]+", "tomorrow": "today|yesterday", "next friday": r"Next \w+day", "March 3rd": r"\w+ \d+(st|nd|rd|th)", "may 31": r"\w+ \d+", "Sunday night": r"\w+day Night", "the 18th of August": r"the \d+(st|nd|rd|th) of August"},
    "name": {"Ada": r"\w+", "Bruno Silva": r"\w+ Silva"},
    "item": {"lamp": ".+"},
    "location": {"The beach": "the .+"},
    "tech": {"kafka": r"\w+"},
}


def test_other_values_keep_the_form_and_differ(spark):
    raws = spark.createDataFrame([(k, r) for k, d in RAWS.items() for r in d], "kind string, raw string").withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: i.cast("string"))))
    got = raws.withColumn("other", V.other_value(F.col("kind"), F.col("raw"), F.col("key"))).collect()
    for r in got:
        assert r.other.lower() != r.raw.lower() and re.fullmatch(RAWS[r.kind][r.raw], r.other), r
    assert len({r.other for r in got if r.raw == "5 pm"}) == 11  # every other hour is met


def test_other_value_of_odd_input(spark):
    d = spark.createDataFrame([("number", ""), ("date", ""), ("time", None), (None, "x"), ("colour", "red")], "kind string, raw string")
    got = [r[0] for r in d.select(V.other_value(F.col("kind"), F.col("raw"), F.lit("k"))).collect()]
    assert got[0] in E.NUMBER_WORDS and got[1] and got[3:] == [None, None]


def test_samples_are_distinct(spark):
    for r in spark.range(200).select(V.sample(E.ITEMS, F.col("id").cast("string"), "s", F.lit(6)).alias("v")).collect():
        assert len(set(r.v)) == 6 and set(r.v) <= set(E.ITEMS)


def test_made_values_are_extracted(spark):
    """What is made as an entity is found again as one span of its kind."""
    kinds = {"price": "number", "percent": "number", "port": "number", "version": "number", "id": "number"} | {k: k for k in ("number", "time", "date", "name", "item", "location", "tech")}
    d = spark.range(300).select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("made"), V.made(k, F.col("id").cast("string")).alias("v")) for k in kinds])).alias("m")).select("m.*")
    for r in d.withColumn("spans", E.resolve(E.candidates(F.concat(F.lit("We said "), "v", F.lit("."))))).collect():
        assert [(s.kind, s.raw) for s in r.spans] == [(kinds[r.made], r.v)], r


def test_corrections_against_python(spark):
    rows = Q.q_correct_entities(spark, SF).collect()
    assert len(rows) > 20
    for r in rows:
        starts = [m.start() for m in re.finditer(re.escape(r.kept), r.text)]
        assert any(r.noisy.startswith(r.text[:s]) and r.noisy.endswith(r.text[s + len(r.kept) :]) for s in starts)
        assert r.abandoned and r.abandoned.lower() != r.kept.lower() and r.abandoned in r.noisy and r.kept in r.noisy


def test_no_span_no_correction(spark):
    d = spark.createDataFrame([("Nothing here.",), ("",), (None,)], "text string").withColumn("spans", E.resolve(E.candidates("text")))
    assert [r[0] for r in d.select(V.corrected(F.col("text"), F.col("spans"), F.lit("k"), F.lit("easy"))).collect()] == [None] * 3


def test_near_pairs_by_group(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen".split()
    rows = [(i, "g" if i % 2 else "h", " ".join(base[:15] + ([base[15 + i % 3]] if i % 5 else [])), " ".join(base[: 10 + i % 4])) for i in range(40)]
    got = {(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, g string, x string, y string"), "id", [F.col("x"), F.col("y")], group=F.col("g")).collect()}

    def grams(r):
        return {tuple(w[i : i + 3]) for w in (r[2].split(), r[3].split()) for i in range(len(w) - 2)}

    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and len(grams(a) & grams(b)) >= 0.85 * len(grams(a) | grams(b))}
    assert got == want and want


def test_split_of_one_large_stratum(spark):
    import hashlib

    ids = [f"r{i}" for i in range(3000)]
    d = spark.createDataFrame([(i, "a" if k % 10 else None) for k, i in enumerate(ids)], "id string, s string")
    got = {r.id: r.split for r in dedup.stratified_split(d, "s", "id").collect()}
    assert len(got) == 3000
    for part in ([i for k, i in enumerate(ids) if k % 10], ids[::10]):
        ranked = sorted(part, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        n, v = round(0.05 * len(part)), round(0.1 * len(part))
        assert [got[i] for i in ranked] == ["test"] * n + ["validation"] * v + ["train"] * (len(part) - n - v)


def test_values_of_a_text_are_kept(spark):
    from speechloom.operators import audit

    rows = [
        ("Meet Ada on Friday at 10:30 am.", "meet ada on friday at 10:30 am", (5, 0)),  # meet ada, friday, 10, 30, 10:30 am
        ("the 3.5 kilos in march", "3 kilos in March", (2, 1)),
        ("nothing here", "", (0, 0)),
        ("Zoé danse", "", (0, 0)),  # an accented letter is part of its word
        (None, "x", None),
    ]
    d = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").select(audit.eps_inferred(F.col("a"), F.col("b")).alias("e"))
    got = [tuple(r.e) for r in d.collect()]
    assert got[1:4] == [w for *_, w in rows[1:4]] and got[0] == rows[0][2]


def test_commands_made_again_are_all_different(spark):
    """Of 5,128 formatting plans (0.1 GB) nine in ten must give records of which none is near another."""
    def made(ids, detail):
        c = ids.select("id", V.command(F.concat(F.lit(f"{detail}:"), F.col("id").cast("string")), detail).alias("c")).select("id", "c.*")
        return c.localCheckpoint()

    first = made(spark.range(5128), False)
    late = dedup.near_later(first, "id", [F.col("input"), F.col("output")])
    again = made(late, True)
    both = first.join(late, "id", "left_anti").union(again)
    assert late.count() > 1500 and dedup.near_later(both, "id", [F.col("input"), F.col("output")]).count() < 5
    bad = again.where(gates.formatting_issue(F.col("output"), F.col("type")) | F.col("input").contains("{") | F.col("output").contains("{"))
    assert bad.count() == 0
