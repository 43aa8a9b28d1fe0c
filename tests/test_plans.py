"""Plans, texts assigned to them, disfluencies and the records made of them, against Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from speechloom.functions.constants import COMBOS, FILLERS
from speechloom.operators import bank, pools, realize
from speechloom.operators import disfluency as D
from speechloom.operators import entities as E
from speechloom.plans import allocate, generate, plan_queries, reuse
from speechloom.sources import views
from speechloom.sources.io import RECORD


def draw(key, site):
    return int(hashlib.md5(f"42:{key}:{site}".encode()).hexdigest()[:15], 16)


def md5(x):
    return hashlib.md5(str(x).encode()).hexdigest()


def test_quotas_of_buckets():
    n = {s.bucket: (s.n, s.real) for s in allocate.by_bucket(15_000)}
    assert n == {"noop": (3000, 2550), "simple": (2250, 1912), "correction": (3750, 3187), "compositional": (4500, 3825), "formatting": (1500, 0)}
    assert {s.bucket: s.n for s in allocate.by_bucket(240)} == {"noop": 48, "simple": 36, "correction": 60, "compositional": 72, "formatting": 24}


def test_quotas_of_categories():
    full = allocate.by_category(15_000, dict.fromkeys(COMBOS, 225))
    assert sum(s.n for s in full) == 15_000
    by = Counter()
    for s in full:
        by[s.category, s.identity, s.preservation, s.longform] += s.n
    assert by == {
        ("basic", True, False, False): 338, ("basic", False, False, False): 1912, ("filler", False, False, False): 1500, ("repetition", False, False, False): 1350, ("repetition", False, True, False): 150, ("correction", False, False, False): 2700,
        ("correction", False, True, False): 300, ("reformulation", False, False, False): 1350, ("reformulation", False, True, False): 150, ("formatting", False, False, False): 750, ("long", False, False, True): 2250, ("mixed", False, False, False): 2025, ("mixed", False, False, True): 225,
    }
    small = allocate.by_category(240)
    assert sum(s.n for s in small) == 240 and sum(s.n for s in small if s.combo) == 36
    assert {s.turns[0][0]: s.turns[0][1] for s in small if s.combo}["multi-corr"] == ("self_correction", "self_correction")
    with pytest.raises(ValueError, match="the matrix sums to"):
        allocate.by_category(240, dict.fromkeys(COMBOS, 225))


@pytest.mark.parametrize("make", [allocate.by_bucket, allocate.by_category])
def test_every_row_is_a_plan(spark, make):
    n = 500
    got = {r["i"]: r for r in allocate.assign(spark.range(n).withColumnRenamed("id", "i"), make(n)).collect()}
    i = 0
    for s in make(n):
        for place in range(s.n):
            r = got[i]
            at = place % len(s.turns)
            if s.weights:
                u = draw(r["key"], "combo") % 100
                at = next(k for k in range(len(s.weights)) if u < sum(s.weights[: k + 1]))
            u = draw(r["key"], "level") % 100
            level = next(k for k in range(3) if u < sum(s.levels[: k + 1]))
            kind, transforms = s.turns[at]
            assert (r["bucket"], r["kind"], tuple(r["transforms"]), r["difficulty"]) == (s.bucket, kind, transforms, allocate.LEVELS[level])
            assert (r["source"], r["domain"]) == ("real" if place < s.real else "template", bank.DOMAINS[i % 12])
            assert r["corrections"] == transforms.count("self_correction")
            assert r["combo"] == (kind if s.combo else None)
            i += 1
    assert i == n


def test_numbered_rows(spark):
    got = {r["x"]: r["i"] for r in allocate.numbered(spark.createDataFrame([(k,) for k in range(50)], "x long"), "x").collect()}
    assert got == {k: i for i, k in enumerate(sorted(range(50), key=md5))}


def brute_match(plans, texts, uses, words, same_words):
    """Plans in hash order take slots in order: first uses of all texts in hash order, then second ones."""
    out = {}
    same = sorted((t for t, w, _ in texts if w <= same_words), key=md5)
    order = lambda where: [(t, u) for u in range(uses) for t in sorted((t for t, w, k in texts if w <= words and where(k)), key=lambda t: md5(f"{u}:{t}"))]
    of = lambda f: sorted((k for k, i, v in plans if f(i, v)), key=md5)
    for k, t in zip(of(lambda i, v: i), same, strict=False):
        out[k] = (t, 0)
    first = list(zip(of(lambda i, v: not i and v), order(lambda k: k > 0), strict=False))
    out.update(first)
    taken = {s for _, s in first}
    out.update(zip(of(lambda i, v: not i and not v), [s for s in order(lambda k: True) if s not in taken], strict=False))
    return out


@pytest.mark.parametrize("n", [30, 90, 400])
def test_texts_of_plans(spark, n):
    rng = random.Random(n)
    texts = [(f"t{i}", rng.randrange(1, 90), rng.randrange(2)) for i in range(60)]
    plans = [(f"p{i}", rng.random() < 0.3, rng.random() < 0.4) for i in range(n)]
    p, t = spark.createDataFrame(plans, "key string, identity boolean, needs_value boolean"), spark.createDataFrame(texts, "text_id string, words int, kinds int")
    m = reuse.match(p, t, uses=2)
    got = {r["key"]: (r["text_id"], r["use_no"]) for r in m.collect()}
    want = brute_match(plans, texts, 2, reuse.WORDS, reuse.IDENTITY_WORDS)
    assert got == {k: want.get(k, (None, None)) for k, _, _ in plans}
    u = {r["identity"]: r for r in reuse.usage(m, t, uses=2).collect()}
    for flag in (True, False):
        assert u[flag]["plans"] == sum(i == flag for _, i, _ in plans)
        assert u[flag]["matched"] == sum(i == flag and k in want for k, i, _ in plans)
        assert u[flag]["unused"] == u[flag]["slots"] - u[flag]["matched"] >= 0


def some_rows(rng, n):
    rows = []
    for i in range(n):
        ws = [rng.choice(["alpha", "be", "Gamma", "-", "delta,", "42", "eps", "naïve"]) for _ in range(rng.randrange(1, 14))]
        text = rng.choice(["", " "]) + "".join(w + rng.choice([" ", "  "]) for w in ws)
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        spans = sorted(rng.sample(tokens, min(len(tokens), rng.randrange(4))))
        rows.append((f"k{i}", text, rng.choice(["easy", "medium", "hard"]), spans, [text[a:b] for a, b in spans]))
    return rows


@pytest.fixture(scope="module")
def noisy(spark):
    rows = some_rows(random.Random(3), 400)
    d = spark.createDataFrame(rows, "key string, text string, level string, spans array<struct<start:int,end:int>>, raw array<string>")
    c = [F.col(x) for x in ("text", "key", "level", "spans")]
    r = D.repeated(*c)
    return d.select("*", D.tokens(c[0]).alias("tokens"), D.filler(*c).alias("filled"), r["text"].alias("repeated"), D.moved(F.col("spans"), r["edits"]).alias("moved")).collect()


def test_tokens_with_places(noisy):
    for r in noisy:
        assert [(t["token"], t["start"], t["end"]) for t in r["tokens"]] == [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", r["text"])]


def test_fillers_keep_protected_words(noisy):
    bank_ = "|".join(sorted(map(re.escape, FILLERS), key=len, reverse=True))
    counts = Counter()
    for r in noisy:
        text, got = r["text"], r["filled"]
        inserted = re.findall(rf", (?:{bank_}),", got)
        if re.sub(rf", (?:{bank_}),", "", got) == text:
            least, most = D.FILLER_COUNTS[r["level"]]
            tokens = [(t["start"], t["end"]) for t in r["tokens"]]
            gaps = [a for a, b in zip(tokens, tokens[1:], strict=False) if text[b[0]].isalnum() and not any(a[1] >= s["start"] and b[0] <= s["end"] for s in r["spans"])]
            assert min(least, len(gaps)) <= len(inserted) <= most
            counts[r["level"], len(inserted)] += 1
        else:
            assert re.match(rf"(?i)(?:{bank_}), ", got) and got.endswith(text[1:])
            counts["front"] += 1
    assert counts["front"] > 20 and {n for k, n in (c for c in counts if c != "front") if k == "hard"} >= {2, 3, 4}


def test_repetitions_move_protected_words(noisy):
    changed = Counter()
    for r in noisy:
        assert [r["repeated"][s["start"] : s["end"]] for s in r["moved"]] == r["raw"] or not any(t["token"][0].isalnum() and not any(t["start"] < s["end"] and t["end"] > s["start"] for s in r["spans"]) for t in r["tokens"])
        assert len(r["repeated"]) > len(r["text"])
        changed["-" in r["repeated"].replace(" - ", " ").replace("- ", "").replace(" -", ""), ", " in r["repeated"].replace("delta, ", "")] += 1
    assert len(changed) == 4


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    rows = spark.range(260).withColumnRenamed("id", "i")
    plans = allocate.assign(rows, allocate.by_category(260)).drop("i", "place")
    real = F.when(F.col("category").isin("correction", "filler"), F.concat(F.lit("Ask Ada to bring the umbrella to the office on Friday at 5 pm, note "), F.substring(F.md5("key"), 1, 9)))
    plans = plans.withColumn("text", real).withColumn("source", F.when(F.col("text").isNotNull(), "real").otherwise("template"))
    held = spark.createDataFrame([("zzz",)], "output string")
    return plans.collect(), generate.compile_records(plans, bank.template_table(spark), pools.Pools(bank.lexicon_table(spark)), held, rounds=1).collect()


def test_records_of_all_kinds_of_plans(spark, made):
    plans, records = made
    by = {p["key"]: p for p in plans}
    assert len(records) >= 0.85 * len(plans)
    assert {c.name for c in spark.createDataFrame([], RECORD).schema} <= set(records[0].asDict())
    assert len({r["id"] for r in records}) == len({(r["input"], r["output"]) for r in records}) == len(records)
    seen = Counter()
    for r in records:
        p = by[r["plan"]]
        assert (r["category"], r["combo"], r["difficulty"]) == (p["category"], p["combo"], p["difficulty"])
        assert r["transformations"] == sorted(p["transforms"]) and r["num_transformations"] == len(p["transforms"])
        assert len(r["corrections"]) == p["corrections"]
        kinds = [c["kind"] for c in r["corrections"]]
        assert len(set(kinds)) == len(kinds)
        for c in r["corrections"]:
            assert c["abandoned"].lower() in r["input"].lower() and c["kept"].lower() in r["output"].lower() and c["abandoned"].lower() not in r["output"].lower()
        assert (r["input"] == r["output"]) == (not p["transforms"])
        assert bool(r["reformulations"]) == ("reformulation" in p["transforms"])
        assert bool(r["formatting"]) == (p["formatting"] and not p["longform"])
        assert all(x in r["output"] for x in r["preserved"]) and bool(r["preserved"]) == p["preservation"] == r["preservation_case"]
        assert (r["source"] == "real") <= (p["source"] == "real")
        assert not p["longform"] or 50 <= len(r["output"].split()) <= 300
        seen[r["category"]] += 1
    assert set(seen) == {c for c, _ in allocate.CATEGORY_SHARES}
    assert {r["combo"] for r in records} >= set(COMBOS)
    assert {r["split"] for r in records} == {"train", "validation", "test"}


def test_corrections_are_said_as_they_are_listed(spark):
    rows = [(f"k{i}", "Ask Ada to bring the umbrella to the office on Friday at 5 pm.", level, n) for i in range(20) for level in ("easy", "hard") for n in (1, 2)]
    d = spark.createDataFrame(rows, "key string, said string, level string, n int").withColumn("s", E.resolve(E.candidates("said")))
    for r in d.withColumn("c", realize.corrected(*[F.col(c) for c in ("said", "s", "key", "level", "n")])).collect():
        text = r["c"]["text"]
        assert len(r["c"]["corrections"]) == r["n"] == len({c["kind"] for c in r["c"]["corrections"]})
        plain = text
        for c in reversed(r["c"]["corrections"]):
            phrase = text[c["span"][0] : c["span"][1]]
            assert c["abandoned"] in phrase and phrase.endswith(c["kept"]) and c["marker"] in phrase
            plain = plain[: c["span"][0]] + c["kept"] + plain[c["span"][1] :]
        assert plain == r["said"]
        assert [text[w["start"] : w["end"]] for w in r["c"]["wrong"]] == [c["abandoned"] for c in r["c"]["corrections"]]


def test_distinct_kinds(spark):
    d = spark.createDataFrame([("Ask Ada and Bruno on Friday.",), ("Nothing.",)], "t string")
    assert [r[0] for r in d.select(realize.kinds(E.resolve(E.candidates("t")))).collect()] == [["date", "name"], []]


def jaccard(a, b):
    grams = lambda r: {tuple(w[i : i + 3]) for t in r for w in [t.lower().split()] for i in range(len(w) - 2)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0


def test_near_records_are_made_again(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    line = lambda: " ".join(rng.sample(words, 30))
    base = [line() for _ in range(12)]
    near = lambda t: " ".join([*t.split()[:-1], "end"])
    texts = [*base, base[0], base[0], near(base[1]), near(base[2]), near(base[2]) + " more", line()]
    schema = "plan string, input string, output string, category string, template_id string, entities struct<times:array<string>,dates:array<string>,names:array<string>,items:array<string>,locations:array<string>,techs:array<string>,numbers:array<string>>"
    none = ([],) * 7
    row = lambda k, t, c="basic": (f"p{k:02d}", t, t, c, None, none)
    first = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)] + [row(50, base[3], "filler")], schema)
    asked = []

    def remake(late, suffix):
        keys = sorted(r["plan"] for r in late.collect())
        asked.append(keys)
        fresh = {"p12": base[5], "p13": line(), "p14": line(), "p15": line(), "p16": None}  # one runs into another record, one fails
        if suffix != "n0":
            fresh = dict.fromkeys(keys, base[5])  # and never gets away from it
        return spark.createDataFrame([row(int(k[1:]), fresh[k]) for k in keys if fresh[k]], schema)

    got, counts = generate.regenerate(first, remake)
    rows = got.collect()
    assert asked == [["p12", "p13", "p14", "p15", "p16"], ["p12"], ["p12"]]
    assert counts == [(5, 1, 0), (1, 0, 0), (1, 0, 0), (0, 0, 1)]
    assert {r["plan"] for r in rows} == {f"p{i:02d}" for i in (*range(12), 13, 14, 15, 17, 50)}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            assert a["category"] != b["category"] or jaccard((a["input"], a["output"]), (b["input"], b["output"])) < 0.85


def test_utterances_of_the_compile_job_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(plan_queries, "utterances", lambda *a: (made.append(a), views.utterances(*a))[1])
    monkeypatch.setattr(generate, "compile_records", lambda plans, *a, **k: plans)
    plans = plan_queries.compiled(spark, "/root/testdata/sf0.001")
    assert plans.where("text is not null").count() > 0 and len(made) == 1  # twice before


def test_plans_beyond_a_million_have_keys_of_their_own(spark):
    i = [5, 123_456, 1_234_560, 1_234_561, 2_000_000]
    d = spark.createDataFrame([(x,) for x in i], "i long")
    got = {r["i"]: r for r in allocate.assign(d, allocate.by_bucket(3_000_000)).withColumn("own", allocate.plan_key(F.col("i"))).collect()}
    assert got[5]["own"] == got[5]["key"] == "plan:42:000005" and got[123_456]["own"] == got[123_456]["key"]
    assert len({r["own"] for r in got.values()}) == len(i)
    assert d.select(allocate.padded(F.col("i")).alias("n")).distinct().count() == len(i)


def test_plans_that_share_a_hash_take_one_text_each(spark):
    p = spark.createDataFrame([(k, "plan:42:123456", False, False) for k in range(11)], "key long, order string, identity boolean, needs_value boolean")
    t = spark.createDataFrame([(f"t{k}", 5, 0) for k in range(4)], "text_id string, words int, kinds int")
    got = reuse.match(p, t, order="order").collect()
    assert sorted(r["key"] for r in got) == list(range(11))
    assert len({(r["text_id"], r["use_no"]) for r in got}) == 11


def test_the_first_candidate_of_a_plan_and_the_others(spark):
    p = spark.createDataFrame([("a", "said"), ("b", None)], "key string, text string")
    ranks = lambda first: sorted((r["plan"], r["rank"]) for branch, held in ((0, p.where("text is not null")), (1, p)) for r in generate._attempts(held, branch, "x", 2, first).collect())
    assert ranks(True) == [("a", 0), ("b", 2)]
    assert ranks(False) == [("a", 1), ("a", 2), ("a", 3), ("b", 3)]
    assert sorted(ranks(True) + ranks(False)) == ranks(None)
