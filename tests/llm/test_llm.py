"""The corpus operators against brute force, and their defined results for odd input."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from speechloom.llm import chars, embedding_dedup, language_id, mixing, packing, passages, pii, quality_rules, queries, resample, simhash_dedup, toxicity
from speechloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names clash with those of the operators' results play no part.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, score string, id long, row string, fp long"


def odd_docs(spark, texts=None):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, clashing extra columns."""
    prose = "The quick brown fox jumps over the lazy dog while seven bright stars watch the quiet river flow toward an old mill. "
    long = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
    rows = [
        (1, prose * 6, "en", "a"), (2, prose * 6, "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, " \t\n\x0b\x0c\r ", "de", "b"),
        (6, long, "en", "a"), (7, "x", "en", "é"), (None, "no id here", None, "a"), (8, "same", "en", "a"), (8, "same", "en", "a"),
        (9, "der die das und ist nicht ein eine mit von zu im auf " * 5, "de", "b"), (10, "mail a.b@c.de now +49 30 1234567 or 10.0.0.1 and 4111 1111 1111 1111", "en", "a"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), -1, "k", "s", -2, "r", 0) for i, t, lang, s in rows]
    return spark.createDataFrame(rows, CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1


def brute_targets(sizes):
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(out.values())
        level = left / sum(w[k] for k in free)
        over = {k for k in free if level * w[k] > 2 * sizes[k] + 1e-9}
        if not over:
            out.update({k: level * w[k] for k in free})
            break
        out.update({k: 2.0 * sizes[k] for k in over})
        free -= over
    return out


@pytest.mark.parametrize("made", [docs, odd_docs])
def test_mixing(spark, made):
    d = made(spark)
    got = mixing.mix_sizes(spark, d).collect()
    want_size = collections.Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in d.collect())
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == want_size
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r["size"]
    target = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[k] - target[k]) <= 1 for k in sizes)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixing.mix_sizes(spark, d.repartition(3)).collect())


def test_mix_reads_whole_and_cut_texts(spark):
    d = docs(spark)
    plan = {r.doc_id: r for r in mixing.mix_sizes(spark, d).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    words = collections.Counter()
    for r in mixing.mix(spark, d).collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    assert all(words[k] == r.taken for k, r in plan.items())
    assert mixing.mix(spark, odd_docs(spark)).columns == odd_docs(spark).columns and mixing.mix(spark, empty(spark)).count() == 0
    assert mixing.mix_sizes(spark, empty(spark)).count() == 0


def test_position_inverts_the_integral(spark):
    knots = [1.25, 1.0, 0.25, 2.0]
    t = np.linspace(0, 1, 30_001)
    w = np.interp(t, np.linspace(0, 1, 4), knots)
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    u = [0.0, 0.1, 0.33, 0.5, 0.8, 0.999]
    k = F.array(*[F.lit(x) for x in knots])
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(mixing.position(F.col("u"), k)).collect()]
    assert np.allclose(got, np.interp(u, area / area[-1], t), atol=1e-4)


# --- 2


def tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("made", [docs, odd_docs])
def test_packing_round_trip(spark, made):
    d = made(spark)
    got = packing.pack(spark, d, queries.tokenizer_path()).collect()
    want = collections.Counter()
    for r in d.collect():
        ids = tokens(r.text)
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[(r.doc_id, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    floor = math.ceil(sum(r.length for r in got) / 4096)
    assert len(bins) <= max(floor + 2, 1.01 * floor)


def test_packing_plan_covers_any_histogram(spark):
    rng = random.Random(3)
    for lengths in ({5: 1}, {4096: 3}, {4095: 7, 2: 3}, {rng.randrange(1, 4096): rng.randrange(1, 400) for _ in range(300)}):
        made, used = packing.plan(spark, lengths), collections.Counter()
        for b, n in made:
            assert sum(b) <= 4096 and n > 0
            for k in b:
                used[k] += n
        assert used == collections.Counter(lengths)
    assert packing.pack(spark, empty(spark), queries.tokenizer_path()).count() == 0


def test_words_are_encoded_as_whole_texts():
    enc = packing.WordIds(queries.tokenizer_path())
    texts = ["", "a  b\tc\n", "I'm 12.5% the’s İstanbul ΑΣ <|endoftext|> fooé.,", "can't ''s a's. b'", "\x85x\xa0y ź", "ΑΣ ΟΔΟΣ. Ärger İ", "e\u0301te\u0301 ﬁn"]
    texts += ["a.b,c!! éÉ###ß ÿ-œ. x_y (z) [q]", "\x01 a \x02 b", "w" * 500 + " ok", "a\x1cb c\u2028d", "<|startoftext|>x", "end\x02"]
    rng = random.Random(12)
    texts += ["".join(rng.choice("abcdeAÉéß .,'#-1\n\x02İΣ|<>°") for _ in range(rng.randrange(80))) for _ in range(400)]
    assert enc.plain is not None
    assert [np.frombuffer(x, "<u4").tolist() for x in enc(texts)] == [tokens(t).tolist() for t in texts]


def test_crossover_beats_best_fit():
    """Triplets that fill a bin exactly: best fit alone leaves room, the islands' evolution packs closer."""
    rng, items = random.Random(6), []
    for _ in range(60):
        a = rng.randrange(380, 490)
        b = rng.randrange(260, (1000 - a) - 250)
        items += [a, b, 1000 - a - b]
    alone = len(packing.best_fit(items, [], 1000))
    found = packing.evolve(items, 1000, 5, [], generations=60)
    assert sorted(x for b in found for x in b) == sorted(items) and all(sum(b) <= 1000 for b in found)
    assert 60 <= len(found) < alone


def test_crossover_injects_whole_bins():
    rng = random.Random(1)
    one, two = [[500, 300], [400, 400], [200, 100]], [[500, 400, 100], [400, 300, 200]]
    for _ in range(20):
        got = packing.crossover(one, two, 1000, rng)
        assert sorted(x for b in got for x in b) == [100, 200, 300, 400, 400, 500] and all(sum(b) <= 1000 for b in got)
        assert any(sorted(b) in ([100, 400, 500],) or sum(b) >= 900 for b in got)


# --- 3


def test_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared, other = [word() for _ in range(70)], [word() for _ in range(40)]
    fuzzy = [w if i % 14 else word() for i, w in enumerate(shared)]
    text = lambda *mid: " ".join([*(word() for _ in range(60)), *mid, *(word() for _ in range(60))])
    rows = [(1, text(*shared)), (2, text(*shared)), (3, text(*fuzzy)), (4, text(*other)), (5, text(*other)), (6, text()), (7, text()), (8, None), (9, ""), (10, "tiny text")]
    rows += [(11, rows[5][1]), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.find(spark, d).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r.n_passages} == {1, 2, 3, 6, 11}
    assert {got[k].component_id for k in (1, 2, 3)} == {1} and got[11].class_id == 6
    a, b = map(int, got[1].spans.split(":"))
    assert 58 <= a <= 62 and 128 <= b <= 132 and got[6].spans == "0:120"
    assert passages.find(spark, empty(spark)).count() == 0
    assert passages.find(spark, odd_docs(spark)).count() == odd_docs(spark).count()


def test_many_holders_of_one_passage(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(6))
    shared = [word() for _ in range(55)]
    d = spark.createDataFrame([(i, " ".join([*(word() for _ in range(30)), *shared, *(word() for _ in range(30))])) for i in range(60)], "doc_id long, text string")
    got = passages.find(spark, d).collect()
    assert all(r.n_passages == 1 and r.component_id == 0 for r in got)


def test_passage_of_two_frequent_lines(spark):
    """Few texts hold both lines in a row, many hold one of them; one line is also repeated inside a text."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("uvwxyzabcd") for _ in range(6))
    one, two = [word() for _ in range(30)], [word() for _ in range(30)]
    mid = {i: one if i % 2 else two for i in range(600)} | {i: one + two for i in (101, 300, 477)} | {600: [w for _ in range(40) for w in (*one, word())]}
    d = spark.createDataFrame([(i, " ".join([*(word() for _ in range(12)), *m, *(word() for _ in range(12))])) for i, m in mid.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.find(spark, d.repartition(5)).collect()}
    assert {k for k, r in got.items() if r.n_passages} == {101, 300, 477}
    assert {got[k].component_id for k in (101, 300, 477)} == {101} and all(58 <= got[k].passage_words <= 62 for k in (101, 300, 477))


def test_second_passage_of_the_same_texts(spark):
    """A header and a footer on one diagonal with other words between; a header too short to report before a passage."""
    rng = random.Random(15)
    words = lambda n: ["".join(rng.choice("efghijklmn") for _ in range(6)) for _ in range(n)]
    head, foot, short, late = words(60), words(55), words(30), words(52)
    rows = [(i, " ".join([*head, *words(100), *foot])) for i in (1, 2)] + [(i, " ".join([*short, *words(60), *late])) for i in (3, 4)]
    got = {r.doc_id: r for r in passages.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].spans for i in (1, 2, 3, 4)] == ["0:60,160:215"] * 2 + ["90:142"] * 2
    x, y = (np.array(z, np.uint32) for z in ([*range(60), *range(100, 120), *range(200, 260)], [*range(60), *range(300, 320), *range(200, 260)]))
    assert passages.align(x, y, [(0, 0), (55, 55), (80, 80), (135, 135)]) == [(0, 60, 0, 60), (80, 140, 80, 140)]


def edited(rng, words, n):
    """words with n single-word changes, additions or losses, and the share of five-word shingles kept."""
    at, out, kind = sorted(rng.sample(range(5, len(words) - 5), n)), list(words), {}
    for i in reversed(at):
        kind[i] = rng.choice("cal")
        new = [f"z{rng.random()}"]
        out[i : i + (kind[i] != "a")] = [] if kind[i] == "l" else new
    a, b = (collections.Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (words, out))
    return out, (a & b).total() / max(len(words) - 4, len(out) - 4)


def test_fuzzy_passages_of_the_stated_similarity(spark):
    """Pairs that share an edited passage: all that keep 0.8 of their shingles are linked, and most others of 0.8 equal words."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfghklmn") for _ in range(5))
    rows, like = [], {}
    for i in range(0, 600, 2):
        one = [word() for _ in range(rng.choice((51, 56, 64, 80, 120)))]
        two, like[i] = edited(rng, one, rng.randrange(1, 5))
        if len(two) < 50:
            two, like[i] = one, 1.0
        rows += [(i + k, " ".join([*(word() for _ in range(rng.randrange(40, 60))), *x, *(word() for _ in range(45))])) for k, x in enumerate((one, two))]
    got = {r.doc_id: r for r in passages.find(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    linked = lambda i: got[i].component_id == got[i + 1].component_id == i
    assert sum(s >= 0.8 for s in like.values()) > 60 and all(linked(i) for i, s in like.items() if s >= 0.8)
    assert sum(linked(i) for i in like) >= 0.95 * len(like)


def test_template_of_many_holders_without_exact_passage(spark):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(80)]
    rows = []
    for k in range(80):  # every twentieth word is the text's own: no 50 words are equal, and seeds have about 60 holders
        own = [word() if i % 20 == k % 20 else w for i, w in enumerate(base)]
        rows.append((k, " ".join([*(word() for _ in range(20)), *own, *(word() for _ in range(20))])))
    got = passages.find(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.component_id for r in got} == {0} and all(r.n_passages == 1 for r in got)


def test_seeds_of_many_windows_are_all_met(spark):
    rows = [(i, "seed", 7, 10, None, 40, 1 if i < 39 else 2, i, None) for i in range(40)]
    d = spark.createDataFrame(rows, "row long, kind string, key long, at int, to int, n long, before int, after int, within long")
    got = {(r.a, r.b) for r in passages.matches(d).collect()}
    assert got == {(i, j) for i in range(39) for j in range(i + 1, 39)}  # a bound of 32 gave none


def met(monkeypatch) -> list:
    """The number of matches that each later call of find makes."""
    counts, matches = [], passages.matches
    monkeypatch.setattr(passages, "matches", lambda *a: (d := matches(*a), counts.append(d.count()))[0])
    return counts


def test_a_common_line_alone_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(24)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    line = [word() for _ in range(25)]
    rows = [(k, " ".join([*(word() for _ in range(90)), *line, *(word() for _ in range(90))])) for k in range(60)]
    counts = met(monkeypatch)
    got = passages.find(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.component_id for r in got} == set(range(60)) and not any(r.n_passages for r in got)
    assert counts[0] < 1770  # rare seeds across an edge of the line; each seed of the line made 1770 pairs before


def test_a_common_line_in_texts_with_copies_meets_only_copies(spark, monkeypatch):
    rng = random.Random(27)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    line, rows = [word() for _ in range(25)], []
    for k in range(0, 80, 2):  # two near copies each, every twentieth word changed in one of them
        one = [*(word() for _ in range(60)), *line, *(word() for _ in range(60))]
        rows += [(k, " ".join(one)), (k + 1, " ".join(w if i % 20 else word() for i, w in enumerate(one)))]
    counts = met(monkeypatch)
    got = passages.find(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 and r.n_passages == 1 for r in got)
    assert counts[0] < 3000  # each seed of the line made 3160 pairs of texts before


def test_runs_of_one_word_are_matched_at_their_ends(spark, monkeypatch):
    rng = random.Random(25)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    x, y = [word() for _ in range(22)], [word() for _ in range(22)]
    rows = [(k, " ".join([*(word() for _ in range(30)), *x, *["same"] * (24 + 4 * k), *y, *(word() for _ in range(30))])) for k in range(2)]
    counts = met(monkeypatch)
    got = passages.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and [r.spans for r in sorted(got, key=lambda r: r.doc_id)] == ["30:98", "30:102"]
    assert counts[0] < 40  # each place of a run with each of the other before: 20 * 24


def test_runs_of_one_word_end_with_their_text(spark):
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    run, shared = ["na"] * 20, prose(120)
    changed = [f"c{i}" if i % 24 == 23 else w for i, w in enumerate(shared)]
    texts = [prose(60) + run, run + shared, run + changed, prose(60) + run]
    words = passages.Words()
    codes = [words(" ".join(t)) for t in texts]
    batch = passages.Texts(passages.pa.array([c.tobytes() for c in codes], passages.pa.binary()))
    p = np.concatenate([np.arange(len(c) - passages.SEED + 1) + b for c, b in zip(codes, batch.begins, strict=True)])
    k = batch.of(p)
    at, h, _, of = passages._ends(batch, p, batch.windows(passages.SEED)[p].view(np.int64), np.full(len(p), 2), k)
    assert (at >= batch.begins[of]).all() and (at + passages.SEED <= batch.ends[of]).all()
    assert (batch.windows(passages.SEED)[at].view(np.int64) == h).all() and (batch.of(at) == of).all()
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in passages.find(spark, d).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1
    assert got[1]["spans"] == "0:139" and got[2]["spans"] == "0:139"  # the last word is changed
    assert got[0]["spans"] == got[3]["spans"] == ""


def test_words_that_may_lie_in_a_passage():
    rng = np.random.default_rng(26)
    for _ in range(300):
        n = int(rng.integers(0, 160))
        covered = np.repeat(rng.random(n) < 0.8, rng.integers(1, 9, n))[:n]
        want = np.zeros(n, bool)
        for i in range(n):
            for j in range(i + passages.MIN_WORDS, n + 1):
                hole = "0" * passages.HOLE in "".join("01"[c] for c in covered[i:j].tolist())
                whole = covered[i] and covered[j - 1] and not hole  # a passage begins and ends in a block
                want[i:j] |= whole and covered[i:j].sum() >= passages.IDENTITY * (j - i)
        assert not (want & ~passages.hopeful(n, covered)).any()
    line = np.arange(200) // 25 == 4
    assert not passages.hopeful(200, line).any() and passages.hopeful(200, ~line)[~line].all()


def test_fuzzy_copy_of_a_frequent_passage(spark):
    """A passage that more texts hold than are joined all with all, and two that hold it with changes."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choice("opqrstuvwx") for _ in range(6))
    shared = [word() for _ in range(58)]
    near = [*shared[:29], "other", *shared[30:]]
    mid = {i: shared for i in range(90)} | {90: near, 91: [*shared[:25], "else", *shared[26:]]}
    d = spark.createDataFrame([(i, " ".join([*(word() for _ in range(30)), *m, *(word() for _ in range(30))])) for i, m in mid.items()], "doc_id long, text string")
    got = passages.find(spark, d).collect()
    assert all(r.n_passages == 1 and r.component_id == 0 for r in got)


def test_rows_that_share_an_id_are_texts_of_their_own(spark):
    rng = random.Random(23)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    one, two = text(), text()
    d = spark.createDataFrame([(1, one), (1, two), (2, two), (3, one), (3, "x")], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_copies, r.component_id, r.spans) for r in passages.find(spark, d).collect())
    assert got == [(1, 1, 1, 1, "0:60"), (1, 1, 1, 1, "0:60"), (2, 1, 1, 1, "0:60"), (3, 1, 1, 1, "0:60"), (3, 3, 0, 3, "")]


def test_chains_are_the_best_of_all_in_reach():
    rng = random.Random(16)
    for _ in range(60):
        a, b = zip(*sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(60)} | {(k, k) for k in range(0, 30, 4)} | {(k, k) for k in range(100, 130, 5)}), strict=True)
        reach, score = passages.MAX_GAP + passages.SEED, []
        for i in range(len(a)):
            before = [j for j in range(i) if 0 < a[i] - a[j] <= reach and 0 < b[i] - b[j] <= reach]
            score.append(passages.SEED + max([0, *(score[j] - passages.GAP_COST * abs(b[i] - a[i] - b[j] + a[j]) - passages.GAP_COST / 10 * (a[i] - a[j]) for j in before)]))
        cost = lambda c: passages.SEED * len(c) - sum(passages.GAP_COST * abs(b[j] - a[j] - b[i] + a[i]) + passages.GAP_COST / 10 * (a[j] - a[i]) for i, j in zip(c, c[1:], strict=False))
        chains = [c.tolist() for c in passages.chain(np.array(a), np.array(b))]
        assert math.isclose(cost(chains[0]), max(score)) and all(0 < a[j] - a[i] <= reach and 0 < b[j] - b[i] <= reach for c in chains for i, j in zip(c, c[1:], strict=False))


# --- 4


def brute_rules(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(win)
    covered = {j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("made", [docs, odd_docs])
def test_quality_rules(spark, made):
    d = made(spark)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = sorted((key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in quality_rules.judge(d).collect()))
    want = sorted(key((r.doc_id, *(b := brute_rules(r.text)), b[0] < 50 or 100 * b[4] > 50 * b[0])) for r in d.collect())
    assert got == want


def test_repeated_words_of_any_text(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(80)] + [" ".join(f"w{i % 40_000}" for i in range(70_000))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(d).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_rules(t)[4] for t in texts]


def test_line_rules(spark):
    prose = "The old miller walked along the quiet river and counted bright stars until morning came over far hills again."
    more = "Nobody else had seen how green those meadows were when summer rain finally fell upon our thirsty little valley."
    last = "Later every child in town would tell stories about what happened before winter closed all mountain roads completely."
    good = "\n".join([prose, "Home | About | Contact | Login", more, "Licensed under CC BY 4.0.", last])
    menu = "\n".join(["one | two | three | four | five | six | seven"] * 3 + [f"a{i} | b{i} | c{i} | d{i} | e{i} | f{i} | g{i}" for i in range(9)])
    d = spark.createDataFrame([(1, good), (2, menu)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert got[1].kept and got[1].clean_text == "\n".join([prose, more, last]) and not got[2].kept
    assert quality_rules.clean(empty(spark)).count() == 0 and quality_rules.clean(odd_docs(spark)).columns == odd_docs(spark).columns


def test_lines_of_a_menu_without_signs(spark):
    rng = random.Random(44)
    word = lambda: "".join(rng.choice("abdefgilmnorstu") for _ in range(6))
    prose = "\n".join(f"The {' '.join(word() for _ in range(11))} came." for _ in range(8))
    menu = "\n".join(x for _ in range(20) for x in (word().title(), f"{word()} {word()}", f"Log {word()}"))
    mixed = "A Short Heading\n" + prose + "\nHe went home."
    d = spark.createDataFrame([(1, menu), (2, prose), (3, mixed)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert not got[1].kept and got[2].kept and got[2].clean_text == prose and got[3].clean_text == prose + "\nHe went home."


# --- 5


def brute_links(rows):
    n = len(rows)
    unit = []
    for _, v, k in rows:
        ok = v and k is not None and None not in v and all(map(math.isfinite, v)) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    near = [[i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98 for j in range(n)] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in range(n) if near[i][j])]) for i in range(n)]
    return {rows[i][0]: (sum(near[i]), min(rows[j][0] for j in range(n) if comp[j] == comp[i])) for i in range(n)}


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for c in range(12):
        base = rng.normal(size=32)
        for _ in range(9):
            rows.append((i, [float(x) for x in base + rng.normal(size=32) * 0.09], c % 3))
            i += 1
    rows += [(i + k, v, lab) for k, (v, lab) in enumerate([(rows[0][1], 0), (rows[0][1], 0), (rows[0][1], 1), (None, 1), ([0.0] * 32, 1), ([float("nan")] * 32, 1), ([None] * 32, 1), (rows[3][1], None), ([], 1), ([1.0, 2.0], 1)])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark, d).collect()}
    assert got == brute_links(rows)
    assert embedding_dedup.near_duplicates(spark, d.limit(0)).count() == 0


def test_recall_of_longer_keys():
    """Pairs at the least cosine share a bucket nearly always, however many rotations a key has."""
    rng = np.random.default_rng(12)
    for width in (16, 64):
        x = rng.normal(size=(800, width))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.981 * x + math.sqrt(1 - 0.981**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        for n in (10**4, 10**7, 10**9):
            parts, tables = embedding_dedup.layout(n, width)
            a, b = embedding_dedup.keys(x, parts, tables), embedding_dedup.keys(y, parts, tables)
            assert (embedding_dedup.first_shared(a, b) < np.iinfo(np.int64).max).mean() >= 0.97, (width, n, parts, tables)
    assert embedding_dedup.layout(10**4, 64)[0] == 2 < embedding_dedup.layout(10**9, 64)[0]


def test_bucket_of_many_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * 0.03], 1) for i in range(700)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i].n_links for i in range(700)] == want.tolist() and {r.component_id for r in got.values()} == {0}


# --- 6, 7, 8


def test_toxicity_on_held_out_rows(spark):
    s = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{s}/documents.parquet"), spark.read.parquet(f"{s}/labels.parquet")
    got = toxicity.score(spark, d, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted for r in got if r.toxic == 1)
    assert hit >= 0.7 * sum(r.toxic for r in got) and sum(r.predicted for r in got if r.toxic == 0) <= 0.02 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_of_odd_input(spark):
    d = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    some = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (9, 0, 1), (10, 1, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for labels in (none, some):
        assert toxicity.score(spark, d, labels).count() == d.count() and toxicity.score(spark, empty(spark), labels).count() == 0
        got = resample.resample(spark, d, labels).collect()
        assert len(got) == d.count() and all(r.log_weight == 0 for r in got if r.doc_id in (3, 4, 5))
        assert resample.resample(spark, empty(spark), labels).count() == 0
    got = language_id.identify(spark, d).collect()
    assert len(got) == d.count() and {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"} and {r.lang_pred for r in got if r.doc_id == 9} == {"de"}
    assert language_id.identify(spark, empty(spark)).count() == 0


def test_held_out_folds(spark):
    got = language_id.identify(spark, docs(spark)).join(docs(spark).select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lab = language_id.Labeller(["a", "b", "c"], [], np.ones((3, 3), bool))
    lab.scores = rng.normal(size=(50, 3)).astype(np.float32) * 6
    lab.letters = np.ones(50, np.int32)
    texts = [rng.integers(0, 50, n) for n in (5, 0, 1, 7, 6)]
    total = lambda t, p: sum(lab.scores[w, k] for w, k in zip(t, p, strict=True)) - language_id.SWITCH * sum(x != y for x, y in zip(p[1:], p[:-1], strict=True))
    import itertools

    for t, p in zip(texts, lab.paths(texts), strict=True):
        best = max((total(t, q) for q in itertools.product(range(3), repeat=len(t))), default=0)
        assert len(p) == len(t) and abs(total(t, p.tolist()) - best) < 1e-3


def test_every_script_is_learned(spark):
    """Two languages of one script that is rare in the corpus, beside Latin text of many letters."""
    rng = random.Random(41)
    many = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž"
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(text(many), "xx") for _ in range(400)] + [(text(x), k) for x, k in (("абвгдежзи", "yy"), ("клмнопрст", "zz")) for _ in range(60)]
    rows += [(text(f"{chr(0x4E00 + 40 * k)}{chr(0x4E03 + 40 * k)}{chr(0x4E11 + 40 * k)}"), f"l{k}") for k in range(70) for _ in range(8)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    got = [r for r in language_id.identify(spark, d).collect() if r.held_out]
    right = collections.Counter(rows[r.doc_id][1] for r in got if r.lang_pred == rows[r.doc_id][1])
    total = collections.Counter(rows[r.doc_id][1] for r in got)
    assert all(right[k] >= 0.95 * total[k] for k in ("xx", "yy", "zz")) and sum(right.values()) >= 0.95 * len(got) and len(total) > 60


def test_character_models_are_those_of_the_formulas():
    """Word scores of a language, and the evidence of both classes, against plain dictionaries."""
    rng = random.Random(42)
    word = lambda: "".join(rng.choice("abcж") for _ in range(rng.randrange(1, 6)))
    sets = [collections.Counter(word() for _ in range(150)) for _ in range(2)]

    def ngrams(w, order):
        x = ["^"] * (order - 1) + list(w) + ["$"]
        return [tuple(x[k : k + order]) for k in range(len(x) - order + 1)]

    def count(words, order):
        n = collections.Counter()
        for w, c in words.items():
            for g in ngrams(w, order):
                n[g] += c
        return n

    def keyed(words, order):
        g, i = chars.grams(list(words), order)
        u, inv = np.unique(g, return_inverse=True)
        return u, np.bincount(inv, weights=np.array(list(words.values()))[i])

    n = [collections.Counter(), *(collections.Counter() for _ in range(3))]
    for g, c in count(sets[0], 3).items():
        for k in (1, 2, 3):
            n[k][g[-k:]] += c

    def p(g):
        if not g:
            return 1 / 6
        context = {x: c for x, c in n[len(g)].items() if x[:-1] == g[:-1]}
        kinds = max(1, len(context))
        return (n[len(g)][g] + kinds * p(g[1:])) / (sum(context.values()) + kinds)

    model = language_id.CharModel(*keyed(sets[0], 3), 6)
    for w in ("abc", "жaж", "q", "cab"):
        assert math.isclose(model(chars.grams([w], 3)[0]).sum(), sum(math.log(p(g)) for g in ngrams(w, 3)), rel_tol=1e-5)

    c4 = [count(s, 4) for s in sets]
    n3 = collections.Counter(g[1:] for g in set(c4[0]) | set(c4[1]))
    n2 = collections.Counter(g[1:] for g in n3)
    n1 = collections.Counter(g[1:] for g in n2)

    def kn(counts, g, below):
        context = [c for x, c in counts.items() if x[:-1] == g[:-1] and c]
        if not context:
            return below
        return max(counts[g] - 0.75, 0) / sum(context) + 0.75 * len(context) / sum(context) * below

    def shared(g):
        uni = (n1[g[-1:]] + 0.5) / (sum(n1.values()) + 0.5 * (len(n1) + 1))
        return kn(n3, g[-3:], kn(n2, g[-2:], uni))

    keys = np.unique(np.concatenate([keyed(s, 4)[0] for s in sets]))
    both = [np.zeros(len(keys)) for _ in sets]
    for x, s in zip(both, sets, strict=True):
        k, v = keyed(s, 4)
        x[np.searchsorted(keys, k)] = v
    scorer = toxicity.Scorer(*toxicity.evidence(keys, *both))
    for w in ("abc", "жaж", "cab", "aaaa", "qa"):
        scorer.words([w])
        assert math.isclose(scorer.seen[w][0], sum(math.log(kn(c4[0], g, shared(g))) - math.log(kn(c4[1], g, shared(g))) for g in ngrams(w, 4)), rel_tol=1e-4, abs_tol=1e-4)


def test_mixed_language_spans(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = {r.lang: " ".join(r.text.split()[:60]) for r in d.where("length(text) > 900").limit(80).collect()}
    model = language_id.train(spark, d.select("text", F.col("lang").alias("label")))
    mixed = spark.createDataFrame([(1, half["en"] + " " + half["de"])], "id long, text string")
    r = language_id.label(mixed, model).first()
    assert [s["lang"] for s in r.spans] == ["en", "de"] and abs(r.spans[0]["end"] - 60) <= 2


def test_kth_largest_is_exact(spark):
    rng = random.Random(9)
    values = [rng.randrange(1 << 62) for _ in range(300)] + [5] * 20
    d = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 150, 310, 320):
        assert resample.kth_largest(d, k) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(d, 0) is None


# --- 9


def brute_print(text):
    w = [x.encode() for x in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", " \t", "a", "A b", "Ä B c d", "x " * 500, "The quick BROWN fox jumps over\nthe lazy dog"):
        assert simhash_dedup.fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("pairwise", [0, 24])
def test_links_are_those_of_all_pairs(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash_dedup, "PAIRWISE", pairwise)
    rng = random.Random(11)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(10):
            prints.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    d = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash_dedup.links(spark, d).collect()
    close = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    assert all(close(e.u, e.v) for e in edges)

    def classes(pairs):
        up = {p: p for p in signed}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[root(a)] = root(b)
        out = collections.defaultdict(set)
        for p in signed:
            out[root(p)].add(p)
        return {frozenset(x) for x in out.values()}

    assert classes((e.u, e.v) for e in edges) == classes((a, b) for i, a in enumerate(signed) for b in signed[:i] if close(a, b))


def test_links_broadcast_no_table_of_prints(spark):
    rng = random.Random(12)
    signed = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    plan = simhash_dedup.links(spark, spark.createDataFrame([(p,) for p in signed], "fp long"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_of_odd_input(spark):
    got = simhash_dedup.near_duplicates(spark, odd_docs(spark)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.component_id].add(r.doc_id)
    assert len(got) == odd_docs(spark).count() and {1, 2} <= by[1] and {3, 4, 5} <= by[3]
    assert simhash_dedup.near_duplicates(spark, empty(spark)).count() == 0
    kept = simhash_dedup.dedup(spark, odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and {r.doc_id for r in kept.collect()} == {1, 3, 6, 7, 8, 9, 10, None}


def test_dedup_keeps_one_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "t u v w"), (1, "t u v w"), (2, "t u v w"), (3, "other words here"), (None, "t u v w")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash_dedup.dedup(spark, d).collect()) == [(1, "t u v w"), (3, "other words here")]


def test_dedup_by_row_where_an_id_has_two_texts(spark):
    d = spark.createDataFrame([(0, "t u v w"), (1, "t u v w"), (1, "other words here and more")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash_dedup.dedup(spark, d).collect()) == [(0, "t u v w"), (1, "other words here and more")]
    d = spark.createDataFrame([(None, "t u v w"), (None, "T U v w"), (None, None), (None, ""), (None, "other words here and more")], "doc_id long, text string")
    kept = [(r.text or "").lower() for r in simhash_dedup.dedup(spark, d).collect()]
    assert sorted(kept) == ["", "other words here and more", "t u v w"]


def test_dedup_of_rows_repeated_beyond_the_broadcast_bound(spark):
    rows = [(5, "a b c d")] * 1500 + [(None, "e f g h")] * 1200 + [(7, "i j k l")] + [(None, "i j k l")] * 1100 + [(9 + i, "m n o p") for i in range(1300)] + [(3, f"one {i} two") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    kept = sorted((r.doc_id or 0, r.text) for r in simhash_dedup.dedup(spark, d).collect())
    assert [k for k in kept if k[0] != 3] == [(0, "e f g h"), (5, "a b c d"), (7, "i j k l"), (9, "m n o p")] and len(kept) == 9
    named = collections.Counter(r.component_id for r in simhash_dedup.near_duplicates(spark, d).collect())
    assert named == {5: 1500, None: 1200, 7: 1101, 9: 1300, 3: 5}


def test_components_of_a_chain(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(10_000), 300)
    d = spark.createDataFrame([*zip(nodes[:199], nodes[1:200], strict=True), *((nodes[200], x) for x in nodes[201:]), (5_000_000, 5_000_000)], "u long, v long")
    got = {r.node: r.root for r in connected_components(spark, d).collect()}
    assert {got[x] for x in nodes[:200]} == {min(nodes[:200])} and {got[x] for x in nodes[200:]} == {min(nodes[200:])} and len(got) == 300
    assert connected_components(spark, d.limit(0)).count() == 0


def test_components_of_hubs(spark):
    """Hubs above the bound of 1,000 rows, linked to one another through a chain, beside pairs of their own."""
    edges = [(0, i) for i in range(1, 1500)] + [(5000, i) for i in range(5001, 7500)] + [(1499, 8000), (8000, 8001), (8001, 7499)]
    edges += [(20_000 + 2 * i, 20_001 + 2 * i) for i in range(50)]
    d = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(spark, d).collect()}
    assert len(got) == 1500 + 2500 + 2 + 100
    assert {k for k, v in got.items() if v == 0} == {k for k in got if k < 10_000}
    assert all(v == (k if k % 2 == 0 else k - 1) for k, v in got.items() if k >= 20_000)


# --- 10


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans():
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1290@.+-() é\n") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0256.1.1.1 00001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567++49 30 901820", "x" * 5000 + "@y.z", "9" * 5000]
    for t in texts:
        assert [(k, a, b) for k, spans in pii.base_spans(t).items() for a, b in spans] == brute_spans(t), t


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(i, f'set token = "{h}" here') for i, h in enumerate(hexes)] + [(100, f'set token = "{hexes[0][:39]}" here'), (101, f"code {hexes[1][:39]}f0 stays"), (102, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(zip(r.kinds, r.starts, r.ends, strict=True)) for r in pii.find(spark, d).collect()}
    assert got[100] == [("id", 13, 52)] and got[102] == [] and got[101] == []
    assert pii.find(spark, empty(spark)).count() == 0 and pii.find(spark, odd_docs(spark)).count() == odd_docs(spark).count()
    hidden = {r.doc_id: r.text for r in pii.redact(spark, odd_docs(spark)).collect()}
    assert hidden[10] == "mail <EMAIL> now <PHONE> or <IP> and <CARD>" and hidden[3] is None


def brute_patterns(texts, rounds=pii.ROUNDS):
    """Scores of the pattern-instance graph by plain loops."""
    edges = collections.Counter()
    facts = {}
    for t in texts:
        for a, b, kind, seed, held in pii.candidates(t or "", pii.base_spans(t or "")):
            for p in held:
                edges[p, t[a:b]] += 1
                s, d = facts.get((p, t[a:b]), (False, 0.0))
                facts[p, t[a:b]] = (s or seed, max(d, 1.0 if seed or kind in ("num", "plain", "mail") else pii.DOUBT))
    score = {e: float(s) for e, (s, _) in facts.items()}
    for _ in range(rounds):
        rate = {}
        for p in {p for p, _ in edges}:
            mine = [e for e in edges if e[0] == p]
            support = sum(score[e] > 0 for e in mine)
            r = sum(score[e] * edges[e] for e in mine) / sum(max(score[e], facts[e][1]) * edges[e] for e in mine)
            if support >= pii.MIN_SUPPORT and r >= pii.MIN_SCORE:
                rate[p] = (r, support)
        best = collections.defaultdict(float)
        for p, i in edges:
            if p in rate:
                best[i] = max(best[i], rate[p][0])
        score = {e: 1.0 if facts[e][0] else pii.DECAY * best[e[1]] for e in edges}
    return rate


def planted(rng):
    """Texts with seeds in contexts, and identifiers of no known shape in the same contexts."""
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    phone = lambda: f"+49 30 {rng.randrange(10**6, 10**7)}"
    texts = [f"Reach us, phone: {phone()} or mail." for _ in range(40)] + [f'Set db.password = "{hexes(18)}" first.' for _ in range(20)]
    texts += [f"Please ask for customer number {rng.choice('4')}111 1111 1111 1111 today." for _ in range(3)] + [f"In the year {y} it rained, see note: sunny" for y in range(1990, 2010)]
    unseen = [(f"Or phone: {(x := f'555-123-{k:04}')} then.", x) for k in range(10)] + [(f"use db.password = '{(x := hexes(21))}'", x) for _ in range(10)] + [(f"session.key={(x := hexes(22))} end", x) for _ in range(10)]
    return texts, unseen


def test_pattern_scores_are_those_of_brute_force(spark):
    texts, unseen = planted(random.Random(31))
    texts += [t for t, _ in unseen] + [None, ""]
    got = {r.pattern: (round(r.score, 9), r.support) for r in pii.learn_patterns(spark, spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()}
    want = {pii._key(p): (round(r, 9), n) for p, (r, n) in brute_patterns(texts).items()}
    assert got == want and len(got) >= 4


def test_identifiers_of_no_known_shape_are_found(spark):
    texts, unseen = planted(random.Random(32))
    rows = [(i, t) for i, t in enumerate([*texts, *(t for t, _ in unseen)])]
    got = {r.doc_id: [r.text[a:b] for k, a, b in zip(r.kinds, r.starts, r.ends, strict=True) if k == "id"] for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[len(texts) + i] == [x] for i, (_, x) in enumerate(unseen))
    assert found >= 0.9 * len(unseen)
    assert all(not got[i] for i in range(len(texts)) if "password" not in texts[i])


def test_spans_of_patterns_in_the_documents(spark):
    """All spans that patterns add on the tables are secrets: values of password= or token = fields, or keys."""
    s = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{s}/documents.parquet")
    ids = [r.text[max(0, a - 12) : b] for r in pii.find(spark, d).collect() for k, a, b in zip(r.kinds, r.starts, r.ends, strict=True) if k == "id"]
    assert len(ids) >= 10 and all(re.search(r"password=|token = |AKIA", x) for x in ids)


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    d = docs(spark)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        d = spark.createDataFrame(out.collect(), d.schema)
        assert d.count() > 0, name
    first = quality_rules.judge(docs(spark)).where("kept").count()
    assert P.STAGES[0][1](spark, docs(spark), SF).count() == first
    assert {"doc_id", "sequence_id", "offset"} <= set(P.run(spark, SF).columns)


def test_pipeline_of_odd_documents(spark, tmp_path):
    import corpus_pipeline as P

    for name, made in (("odd", odd_docs(spark)), ("none", empty(spark))):
        made.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = P.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in out} <= {1, 6, 10} and bool(out) == (name == "odd")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].astype(str).values.tolist())) == sorted(map(str, want[cols].astype(str).values.tolist()))


def test_rare_ngrams_count_in_toxicity(spark, monkeypatch):
    """No n-gram is left out of the model, whatever its share; words whose n-grams are not broadcast get the same scores by joins."""
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "zu") for b in "aeiou" for c in ("rd", "st", "mm")]
    rng = random.Random(5)
    plain = [(k, " ".join(rng.choices(words, k=40))) for k in range(60)]
    toxic = [(k, " ".join(rng.choices(words, k=38)) + f" vuqq{chr(97 + k % 7)}") for k in range(60, 90)]
    d = spark.createDataFrame([*plain, *toxic, (90, "xyzzy new"), (91, ""), (92, None), (91, ""), (93, "bard bard vuqqa !! bard")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in range(90)], "doc_id long, toxic int")
    rows = d.join(labels, "doc_id").select(F.col("text"), (F.col("toxic") + 2 * (F.col("doc_id") % 2)).alias("label"))
    counts = toxicity.chars.gram_counts(rows, toxicity.ORDER)
    grams, contexts = toxicity.model_tables(spark, counts)
    c = counts.toPandas()
    for part, keep in ((toxicity.ALL, c.label >= 0), (0, c.label // 2 == 1)):
        x = c[keep]
        keys, at = np.unique(x.gram.to_numpy(), return_inverse=True)
        seen, about = toxicity.evidence(keys, *[np.bincount(at, weights=np.where(x.label % 2 == k, x.n, 0), minlength=len(keys)) for k in (1, 0)])
        for table, key, want in ((grams, "gram", seen), (contexts, "context", about)):
            got = table.where(F.col("part") == part).toPandas().sort_values(key)
            assert got[key].tolist() == want.keys.tolist() and np.allclose(got["value"], want.values, atol=1e-5)
    want = sorted((r.doc_id, r.score) for r in toxicity.score(spark, d, labels).collect())
    monkeypatch.setattr(toxicity, "HELD", 40)
    got = sorted((r.doc_id, r.score) for r in toxicity.score(spark, d, labels).collect())
    assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([v for _, v in got], [v for _, v in want], atol=1e-5)
