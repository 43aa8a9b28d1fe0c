import random
import re

from pyspark.sql import functions as F

from speechloom.operators import dictionary as D
from speechloom.operators import entities as E

LEXICON = "kind string, value string, rank int, cased boolean"


def brute(values, text):
    """Every occurrence by one expression a value; lower case only of ASCII and umlauts, so that lengths stay."""
    out = set()
    for kind, value, rank, cased in values:
        for m in re.finditer(rf"(?<!\w)(?=({re.escape(value)})(?!\w))", text, 0 if cased else re.IGNORECASE):
            out.add((m.start(1), m.end(1), kind, m.group(1), rank))
    return sorted(out, key=lambda s: (s[0], s[1], s[4], s[2]))


def test_all_occurrences_equal_expressions(spark):
    rng = random.Random(5)
    parts = ["new", "york", "city", "c++", "o'clock", "ärzte", "x", "ab", "aba", "_", "7", " ", " ", "-", ".", "日本", "Linux"]
    phrases = {" ".join(rng.choices(["new", "york", "city", "ab", "aba", "ärzte", "linux", "7"], k=rng.randint(1, 3))) for _ in range(150)}
    values = [(rng.choice("pqr"), v.title() if cased else v, 0, cased) for v in sorted(phrases) for cased in (False, True)] + [("t", "c++", 1, False), ("t", "o'clock", 1, False), ("t", "日本", 1, True), ("t", "日本", 1, True)]
    values = [(k, v, ord(k) - 112, c) for k, v, _, c in values]
    texts = ["".join(rng.choice((str.upper, str.lower, str.title, str))(rng.choice(parts)) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    lexicon = spark.createDataFrame(values, LEXICON)
    for chars in (D.SLICE_CHARS, 300):  # one automaton, several
        find = D.dictionary(lexicon, chars)
        got = {r.id: sorted(((s.start, s.end, s.kind, s.raw, s["rank"]) for s in r.found), key=lambda s: (s[0], s[1], s[4], s[2])) for r in d.select("id", find(F.col("text")).alias("found")).collect()}
        assert got == {i: brute(values, t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 500


def test_odd_values_and_texts(spark):
    lexicon = spark.createDataFrame([("a", None, 0, False), ("a", "", 0, False), ("a", "Ada", 0, True), ("a", "Ada", 0, True), ("b", "ada", 1, False), ("b", "stadt", 1, None)], LEXICON)
    d = spark.createDataFrame([(0, None), (1, ""), (2, "Ada, ada; Adam"), (3, "İ Ada in der STADT")], "id long, text string")
    got = {r.id: [(s.start, s.end, s.kind, s.raw) for s in r.found] for r in d.select("id", D.dictionary(lexicon)(F.col("text")).alias("found")).collect()}
    assert got == {0: [], 1: [], 2: [(0, 3, "a", "Ada"), (0, 3, "b", "Ada"), (5, 8, "b", "ada")], 3: [(2, 5, "a", "Ada"), (2, 5, "b", "Ada"), (13, 18, "b", "STADT")]}
    assert [len(r.found) for r in d.select(D.dictionary(lexicon.limit(0))(F.col("text")).alias("found")).collect()] == [0] * 4


def test_corrections_and_nearest_of_single_rows(spark):
    rows = [
        (0, [("Ada", "Hana")], "Call someone.", "Call Hana."), (1, [("Ada", "Hana")], "Call Hana.", "Call Hana."), (2, [("Ada", "Hana"), ("Hana", "Jun")], "Call Hana and Jun.", "Call Jun."),
        (3, [("Ada", "Hana")], "Call Ada, Hana.", "Call Hana."), (4, [("Ada", "")], "Call.", "Call."),
    ]
    d = spark.createDataFrame(rows, "id int, c array<struct<abandoned:string,kept:string>>, actual string, expected string")
    got = d.select("id", F.array_join(E.correction_failures(F.col("c"), F.col("actual"), F.col("expected")), ",").alias("f")).collect()
    assert {r.id: r.f for r in got} == {0: "kept-missing", 1: "", 2: "superseded-survived,abandoned-survived", 3: "abandoned-survived", 4: ""}
    d = spark.createDataFrame([(0, ["hana", "jun"], ["hanna", "jun"]), (1, ["ada"], ["zzzz"]), (2, ["kafka"], ["kafko", "kofko"])], "id int, e array<string>, a array<string>")
    near = {r.id: r.n and (r.n.missing, r.n.found, r.n.distance) for r in d.select("id", E.nearest(F.col("e"), F.col("a")).alias("n")).collect()}
    assert near == {0: ("hana", "hanna", 1), 1: None, 2: ("kafka", "kafko", 1)}
