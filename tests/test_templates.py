"""Templates, pools and long forms: their invariants, and draws against Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from speechloom.operators import bank, longform, pools, templates



def draw(key, site, i):
    return int(hashlib.md5(f"42:{key}:{site}:{i}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def held(spark):
    return pools.Pools(bank.lexicon_table(spark))


@pytest.fixture(scope="module")
def filled(spark, held):
    t = bank.template_table(spark).select("template_id", "text", "preserved", templates.slots(F.col("text")).alias("slots"))
    plans = t.crossJoin(spark.range(3)).select(F.concat_ws("-", "template_id", "id").alias("key"), "*", F.lit(False).alias("repeat_same")).drop("id")
    return templates.fill(plans, held).collect()


def test_bank():
    rows = bank.templates()
    assert len({r[0] for r in rows}) == len(rows) == len({r[2] for r in rows}) >= 540
    assert all(sum(r[1] == d for r in rows) >= 40 for d in bank.DOMAINS)
    known = {"items", "name2", *pools.FAMILIES, *(k for ks in pools.FAMILIES.values() for k in ks), *pools.MADE}
    for _, domain, text, parts in rows:
        assert set(re.findall(r"\{(\w+)\}", text)) <= known
        assert bool(parts) == (domain == "preservation")
    words = lambda t: len(t.split(" "))
    assert min(words(r[2]) for r in rows if not r[3]) >= longform.SHORTEST
    assert min(words(c) for c, _ in bank.CLAUSES) >= longform.SHORTEST_CLAUSE


def test_filled_sentences(filled):
    seen = {}
    for r in filled:
        assert "{" not in r["clean"]
        assert not re.search(r"\b(the the|a a)\b", r["clean"])
        assert [v["kind"] for v in r["slot_values"]] == re.findall(r"\{(\w+)\}", r["text"])
        assert all(part in r["clean"] for part in r["kept"])
        of = {}
        for v in r["slot_values"]:
            of.setdefault(v["kind"], []).append(v["value"])
            seen.setdefault(v["kind"], set()).add(v["value"])
        for kind, values in of.items():
            assert kind == "name" and len(set(values)) == 1 or len(set(values)) == len(values)
        firsts = {v.split(" ")[0] for k in ("name", "name2") for v in set(of.get(k, []))}
        assert len(firsts) == sum(len(set(of.get(k, []))) for k in ("name", "name2"))
    assert len(seen["name"]) >= 90
    assert len({x for v in seen["items"] for x in re.split(", | and ", v)}) >= 150
    assert len(seen["tech"]) >= 60
    assert all(not v.endswith("s") for v in seen["item_s"])
    assert all(v.endswith("s") for v in seen["item_p"])
    assert {len(re.split(", | and ", v)) for v in seen["items"]} == {2, 3, 4}


def test_repeated_values(spark, held):
    d = spark.createDataFrame([("k", "Keep {number} as {number} on {date}, not {date}.", ["{number} on {date}"], True), ("l", "From {time} to {time}.", [], None)], "key string, text string, preserved array<string>, repeat_same boolean")
    r = {x["key"]: x for x in templates.fill(d.withColumn("slots", templates.slots(F.col("text"))), held).collect()}
    v = [x["value"] for x in r["k"]["slot_values"]]
    assert v[0] == v[1] and v[2] == v[3]
    assert r["k"]["kept"] == [f"{v[0]} on {v[2]}"]
    assert len({x["value"] for x in r["l"]["slot_values"]}) == 2


def test_no_slots_and_unknown_kinds(spark, held):
    d = spark.createDataFrame([("a", "Nothing here.", []), ("b", "An {unknown} kind.", []), ("c", None, None)], "key string, text string, preserved array<string>")
    r = {x["key"]: x["clean"] for x in templates.fill(d.withColumn("slots", templates.slots(F.col("text"))).withColumn("repeat_same", F.lit(None).cast("boolean")), held).collect()}
    assert r == {"a": "Nothing here.", "b": None, "c": None}


def test_choice_fits_the_plan(spark):
    rows = [(str(i), d, need) for i, (d, need) in enumerate((d, need) for d in (*bank.DOMAINS, "nonsense") for need in ([], ["date"], ["time", "date"], ["date", "date"], ["port"]) for _ in range(6))]
    plans = spark.createDataFrame(rows, "key string, domain string, required array<string>")
    got = templates.choose(plans, bank.template_table(spark)).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in bank.templates()}
    fits = lambda d, need: [t for t, r in by_id.items() if r[1] == d and set(need) <= set(re.findall(r"\{(\w+)\}", r[2]))]
    for r in got:
        assert (r["template_id"] in fits(r["domain"], r["required"])) if fits(r["domain"], r["required"]) else r["template_id"] is None
    assert len({r["template_id"] for r in got}) > 100


def brute_draws(held, key, kinds):
    used, out = [], []
    for i, kind in enumerate(kinds):
        form = draw(key, "form", i) % 100
        family = lo = n = None
        at = 0
        for share, f, first, size in held.ranges.get(kind, []):
            if at <= form < at + share:
                family, lo, n = f, first, size
            at += share
        place = None
        if family is not None:
            free = [p for p in range(lo, lo + n) if (family, p) not in used]
            if free:
                place = free[draw(key, "draw", i) % len(free)]
        used.append((family, place))
        out.append((family, place))
    return out


def test_draws_are_those_of_python(spark):
    lex = [("item_s", f"s{i}") for i in range(3)] + [("item_p", f"p{i}") for i in range(2)] + [("name", f"n{i}") for i in range(4)] + [("name", "n0"), ("other", "x")]
    held = pools.Pools(spark.createDataFrame(lex, "kind string, value string"))
    assert held.ranges["item"] == [(100, "item", 0, 5)]
    rng = random.Random(2)
    rows = [(str(i), [rng.choice(["item", "item_s", "item_p", "name", "surname", "time", "date", "nothing"]) for _ in range(rng.randrange(12))]) for i in range(200)]
    got = {r["key"]: [(x["family"], x["place"]) for x in r["d"]] for r in spark.createDataFrame(rows, "key string, kinds array<string>").select("key", held.draws(F.col("kinds"), F.col("key")).alias("d")).collect()}
    assert got == {k: brute_draws(held, k, kinds) for k, kinds in rows}
    assert any(place is None and family == "item" for v in got.values() for family, place in v)
    values = {(r["family"], r["place"]): r["value"] for r in held.values.collect()}
    assert sorted(values) == [("item", i) for i in range(5)] + [("name", i) for i in range(4)]
    assert {values["item", i] for i in (0, 1)} == {"p0", "p1"}


def test_made_places_differ(spark):
    for kind, forms in pools.MADE.items():
        n = min(2000, sum(f[1] for f in forms))
        got = [r[0] for r in spark.range(n).select(pools.made_value(F.lit(kind), F.col("id"))).collect()]
        assert None not in got and len(set(got)) == n
        assert sum(f[0] for f in forms) == 100


def test_ranks_are_dense(spark):
    rows = [(i % 3, f"v{i}") for i in range(300)]
    got = pools.ranked(spark.createDataFrame(rows, "g int, v string"), ["g"], "v", "r").collect()
    for g in range(3):
        want = sorted((v for h, v in rows if h == g), key=lambda v: hashlib.md5(v.encode()).hexdigest())
        assert [r["v"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])] == want
        assert sorted(r["r"] for r in got if r["g"] == g) == list(range(100))


@pytest.fixture(scope="module")
def long_texts(spark, held):
    rows = [(f"{d}{i}", d, level) for d in bank.DOMAINS for level in longform.BOUNDS for i in range(4)]
    plans = spark.createDataFrame([(f"{k}:{level}", d, level) for k, d, level in rows], "key string, domain string, level string")
    return longform.compose(plans, bank.template_table(spark), held).collect()


def test_long_texts(long_texts):
    allowed = {t: ds for t, ds in bank.CLAUSES}
    stem = {t: re.escape(t).replace(r"\{", "{").replace(r"\}", "}") for t in allowed}
    assert sum(r["clean"] is None for r in long_texts) <= 0.01 * len(long_texts)
    for r in (r for r in long_texts if r["clean"] is not None):
        assert len(r["units"]) > longform.SENTENCES[r["level"]]
        lo, hi = longform.BOUNDS[r["level"]]
        assert lo <= len(r["clean"].split()) <= hi
        assert r["units"][0]["start"] == 0 and r["units"][-1]["end"] == len(r["clean"])
        for a, b in zip(r["units"], r["units"][1:], strict=False):
            assert b["start"] == a["end"] + 1
        for u in r["units"]:
            assert r["clean"][u["start"] : u["end"]] == u["text"]
            if u["connective"]:
                assert u["text"].startswith(u["connective"][0].upper() + u["connective"][1:])
        said = [u["connective"] for u in r["units"] if u["connective"]]
        assert len(said) == len(set(said)) == len(r["units"]) - 2
        assert not re.search(r"\w\.\s*,", r["clean"])
        for t, ds in allowed.items():
            if ds and r["domain"] not in ds:
                assert not re.search(re.sub(r"\{\w+\}", ".+?", stem[t]), r["clean"])


def brute_gathered(said, order, opener, closer, least, lo, hi):
    parts, words = [], len(closer.split())
    comma = dict(bank.CONNECTIVES)
    for s in said:
        if len(parts) >= least and words >= lo:
            continue
        c = order[len(parts) - 1]
        text = f"{opener} {s[0].lower()}{s[1:]}" if not parts else f"{c[0].upper()}{c[1:]}{',' if comma[c] else ''} {s[0].lower()}{s[1:]}"
        if words + len(text.split()) <= hi:
            parts.append(text)
            words += len(text.split())
    return parts, words


def test_sentences_taken_and_passed_over(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lo = rng.randrange(10, 90)
        rows.append((f"k{i}", [" ".join(["Word"] * rng.randrange(1, 40)) for _ in range(rng.randrange(1, 12))], rng.randrange(1, 4), lo, lo + rng.randrange(30)))
    d = spark.createDataFrame(rows, "key string, said array<string>, least int, lo int, hi int")
    opener, closer = (longform.T.pick(F.col("key"), site, values) for site, values in (("opener", bank.OPENERS), ("closer", bank.CLOSERS)))
    d = d.select("*", opener.alias("opener"), closer.alias("closer"), longform.gathered(*[F.col(c) for c in ("said", "key", "least", "lo", "hi")], closer).alias("g"))
    passed = 0
    for r in d.collect():
        order = sorted((c for c, _ in bank.CONNECTIVES), key=lambda c: hashlib.md5(f"42:{r['key']}:connective:{c}".encode()).hexdigest())
        parts, words = brute_gathered(r["said"], order, r["opener"], r["closer"], r["least"], r["lo"], r["hi"])
        assert ([x["text"] for x in r["g"]["parts"]], r["g"]["words"]) == (parts, words)
        assert words <= r["hi"] or not parts
        passed += words >= r["lo"] and len(parts) >= r["least"]
    assert passed > 50


def test_unknown_domain_of_a_long_text(spark, held):
    d = spark.createDataFrame([("a", "nonsense", "easy")], "key string, domain string, level string")
    assert longform.compose(d, bank.template_table(spark), held).collect()[0]["clean"] is None


def test_plans_are_made_once(spark, held):
    """The draws of a sentence and its text come from one pass over the plans, and plans without slots or template stay."""
    seen = spark.sparkContext.accumulator(0)

    def text(i: int) -> str | None:
        seen.add(1)
        return ("Call {name} at {time}.", "Go home.", None)[i % 3]

    p = spark.range(0, 30, 1, 4).select(F.col("id").cast("string").alias("key"), F.udf(text, "string")("id").alias("text"), F.lit(False).alias("repeat_same"), F.expr("cast(null as array<string>)").alias("preserved"))
    got = templates.fill(p.withColumn("slots", templates.slots(F.col("text"))), held).select("key", "clean").collect()
    assert sorted(r.key for r in got) == sorted(map(str, range(30)))
    assert all((r.clean or "").startswith("Call ") if int(r.key) % 3 == 0 else r.clean == ("Go home." if int(r.key) % 3 == 1 else None) for r in got)
    assert seen.value == 30
