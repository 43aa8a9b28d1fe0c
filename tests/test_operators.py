"""Rules of single operators on small fixtures."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from speechloom.functions import text as T
from speechloom.operators import audit, dedup
from speechloom.operators import entities as E
from speechloom.plans import quota


def column(spark, values, f, kind="string"):
    d = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in d.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize(spark):
    texts = ['  "Hello  World" ', "ﬁne day", "ABC", "", '"', None]

    def want(t):
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t).strip()
        if len(t) >= 2 and t[0] == t[-1] == '"':
            t = t[1:-1].strip()
        return " ".join(t.lower().split())

    assert column(spark, texts, T.normalize) == [want(t) for t in texts]


def test_percentile_takes_the_later_element(spark):
    d = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)], "g string, v int")
    assert audit.percentiles(d, "v", "g").first()["p50"] == 3
    assert column(spark, [[1, 2, 3, 4], []], lambda c: T.percentile_floor(c, 0.5), "array<int>") == [3, 0]


def test_word_errors(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(8))], [rng.choice("abcd") for _ in range(rng.randrange(8))]) for _ in range(60)]

    def edit(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r[0] for r in d.orderBy("i").select(T.word_errors(F.col("a"), F.col("b"))).collect()]
    assert got == [edit(a, b) for a, b in pairs]


def test_spans_do_not_overlap_and_longest_wins(spark):
    texts = ["Ada left the beach towel at the beach on Friday at 5 pm.", "afternoon", ""]
    spans = column(spark, texts, lambda c: E.resolve(E.candidates(c)))
    assert [(s["kind"], s["raw"]) for s in spans[0]] == [("name", "Ada"), ("item", "beach towel"), ("location", "the beach"), ("date", "Friday"), ("time", "5 pm")]
    assert spans[1] == [] and spans[2] == []


def test_near_pairs(spark):
    base = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(1, base), (2, base + " x"), (3, "short"), (4, None), (5, " ".join(f"v{i}" for i in range(40)))], "id long, t string")
    assert [(r["a"], r["b"]) for r in dedup.near_pairs(d, "id", F.col("t")).collect()] == [(1, 2)]


def test_split_sizes_round_half_even(spark):
    d = spark.range(50).select(F.col("id"), F.lit("s").alias("g"))
    n = {r["split"]: r["count"] for r in dedup.stratified_split(d, "g", "id").groupBy("split").count().collect()}
    assert n == {"test": 2, "validation": 5, "train": 43}


@pytest.mark.parametrize("total", [240, 15000])
def test_quotas(total):
    q = {b: y - x for b, x, y in quota.quotas(total)}
    assert sum(q.values()) == total and abs(q["noop"] - total * 0.2) <= 1 and q["formatting"] == total // 10
    with pytest.raises(ValueError):
        quota.quotas(10, (("a", 0.5), ("b", 0.4)))


def test_near_pairs_of_large_groups(spark):
    """Copies and near copies whose shingles all have more than 20 holders, against brute force."""
    from speechloom.operators import dedup

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(25)] + [(100 + i, " ".join([*base[:58], f"x{i % 5}", "y"])) for i in range(25)] + [(200, "a b"), (201, "a b"), (202, " ".join(base[:30]))]
    grams = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in rows for w in [t.split()]}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= dedup.NEAR}
    got = [(r.a, r.b) for r in dedup.near_pairs(spark.createDataFrame(rows, "id long, t string"), "id", F.col("t")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_versions_of_all_ids(spark, tmp_path):
    from speechloom.plans import corpus_queries

    ids = [0, 101, 9999, 10000, 10101, 123456, 79760101, 10**12, -1]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.version, r.ok) for r in corpus_queries.q_dataset_versions(spark, str(tmp_path)).collect()}
    assert set(got) == set(ids) and got[101] == ("20240101.2", True) and got[10101] == ("20250101.0", True) and got[10000] == ("20250000.1", False)
    assert all(len(v) == 10 for v, _ in got.values()) and got[79760101][0].startswith("20240101.")


def test_word_in_and_marker(spark):
    d = spark.createDataFrame([("the at-noon cat",), ("cattle",), (None,), ("cat2",)], "t string")
    assert [r[0] for r in d.select(T.word_in("cat", F.col("t"))).collect()] == [True, False, False, True]
    d = spark.createDataFrame([("Meet at 3, no wait, 5 pm", "3", "5"), ("5 or 3", "3", "5"), ("9 - 9", "9", "9"), ("x", "3", "5")], "t string, a string, k string")
    assert [r[0] for r in d.select(T.marker_between(F.col("t"), F.col("a"), F.col("k"))).collect()] == ["no wait", None, "", None]


def test_near_links_of_copies_and_near_texts(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 120))]
        for i in range(6):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[100 * k + i] = " ".join(t)
    texts |= {9000 + i: texts[0] for i in range(300)}  # 301 copies: 45,150 pairs
    grams = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in ((i, t.split()) for i, t in texts.items())}
    first = {}
    for i in sorted(grams):
        first.setdefault(frozenset(grams[i]), i)
    reps = sorted(first.values())
    near = {(a, b) for a in reps for b in reps if a < b and len(grams[a] & grams[b]) >= dedup.NEAR * len(grams[a] | grams[b])}
    copies = {(first[frozenset(g)], i) for i, g in grams.items() if first[frozenset(g)] != i}
    got = dedup.near_links(spark.createDataFrame(list(texts.items()), "id long, t string"), "id", F.col("t")).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(near | copies) and len(near) > 20


def test_near_classes_store_sets_once(spark):
    d = spark.createDataFrame([(i, " ".join(f"a{i}b{j}" for j in range(200))) for i in range(50)], "id long, t string")
    members, near = dedup.near_classes(d, "id", F.col("t"))
    assert members.count() == 50 and near.count() == 0
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # a stored table: later reads repeat no search


def test_edit_distance_is_levenshtein(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé𝄞 ") for _ in range(n))
    rows = [("", ""), ("", "ab"), (None, "a"), ("a", None), ("Ab" * 40, "ab" * 40)]
    for _ in range(300):
        a = word(rng.randrange(60))
        b = rng.choice([word(rng.randrange(60)), a + word(3), word(3) + a, a[2:], a[:-2], a[:9] + word(2) + a[12:], a[:20] + word(18) + a[20:]])
        rows.append((a, b))
    d = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.edit_distance(F.col("a"), F.col("b")).alias("got"), F.levenshtein("a", "b").alias("want"))
    assert [r for r in d.collect() if r.got != r.want] == []


def test_edit_distance_of_long_near_texts_is_not_quadratic(spark):
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(12_000))
    rows = [(long, f"{i} {long}") for i in range(10)] + [(long, long[: 900 * i] + "XY" + long[900 * i + 2 :]) for i in range(1, 11)]
    d = spark.createDataFrame(rows, "a string, b string").coalesce(1).cache()
    d.count()

    def took(e) -> float:
        began = time.perf_counter()
        d.select(F.sum(e)).collect()
        return time.perf_counter() - began

    assert took(T.edit_distance(F.col("a"), F.col("b"))) < took(F.levenshtein("a", "b")) / 2
    d.unpersist()
