"""Fill-in-middle, periodic runs and byte-level BPE against brute force and the tokenizers library, and their defined results for odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from speechloom.llm import byte_bpe, fill_middle, periodic_runs, queries

from test_llm import SF, WORD, docs, empty, odd_docs

BLANKS = " \t\n\x0b\x0c\r"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11


def brute_fill(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(f"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts(rng, n):
    parts = ["a", "bc", "<", ">", "P", "<P", "<S>", "M>", "é", "世界", "\U0001f600", *BLANKS, "  ", "word", "<<M", "\x00"]
    out = []
    for i in range(n):
        own = parts if rng.random() < 0.4 else [x for x in parts if "<" not in x]
        out.append((i, "".join(rng.choice(own) for _ in range(rng.randrange(40)))))
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, fill_middle.CHUNK])
def test_fill_middle_is_that_of_brute_force(spark, chunk):
    texts = some_texts(random.Random(chunk), 400)
    got = {r["doc_id"]: r for r in fill_middle.transform(spark, rows_of(spark, texts), chunk=chunk).select("*", fill_middle.restore(fill_middle.F.col("output"), fill_middle.F.col("form")).alias("restored")).collect()}
    assert len(got) == len(texts)
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}
    for i, t in texts:
        r = got[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fill(i, t)
        assert r["restored"] == t


def test_sums_of_chunks_compose():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("<<>PSM a\n") for _ in range(rng.randrange(12)))
        c = fill_middle.points(text)
        want = ([], [], [])
        for start in range(4):
            state = start
            words = marks = 0
            for x in c.tolist():
                state, w, m = fill_middle.step(state, x)
                words, marks = words + w, marks + m
            for held, value in zip(want, (state, words, marks), strict=True):
                held.append(value)
        assert tuple(map(list, fill_middle.summary(c))) == want
        cut = rng.randrange(len(text) + 1)
        both = fill_middle.compose(fill_middle.summary(c[:cut]), fill_middle.summary(c[cut:]))
        assert tuple(map(list, both)) == want


@pytest.mark.parametrize("chunk", [1000, fill_middle.CHUNK])
def test_fill_middle_of_odd_input(spark, chunk):
    d = odd_docs(spark)
    made = {(r["doc_id"], r["text"]): (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fill_middle.transform(spark, d, chunk=chunk).collect()}
    assert fill_middle.transform(spark, d, chunk=chunk).count() == 12
    assert all(made[r["doc_id"], r["text"] or ""] == brute_fill(r["doc_id"], r["text"]) for r in d.collect())
    assert fill_middle.transform(spark, empty(spark), chunk=chunk).count() == 0


def test_fill_middle_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_fill_middle(spark, SF).collect()}
    for r in docs(spark).collect():
        n, form, p, m, output = brute_fill(r["doc_id"], r["text"])
        g = got[r["doc_id"]]
        assert tuple(g) == (r["doc_id"], n, form, p, m, sha(output), sha(r["text"] or ""))


# --- 12


def brute_runs(words, least=12):
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, length, p) for (s, length), p in best.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_are_those_of_brute_force():
    rng = random.Random(5)
    seen = 0
    for _ in range(1500):
        kind = rng.random()
        n = rng.randrange(90)
        if kind < 0.4:
            w = [rng.randrange(2) for _ in range(n)]
        elif kind < 0.7:  # powers within other text, and powers of powers
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            w = [rng.randrange(4) for _ in range(rng.randrange(9))] + (unit * rng.randrange(2, 6) + [9] * rng.randrange(2)) * rng.randrange(1, 4)
        else:
            a, b = [0], [0, 1]
            while len(b) < n + 2:
                a, b = b, b + a
            w = b[:n]
        least = rng.choice((2, 3, 5, 12, 12, 13))
        got = [tuple(r) for r in periodic_runs.find_runs(np.array(w, np.int32), least).tolist()]
        assert got == brute_runs(w, least)
        seen += len(got)
    assert seen > 2000


def test_extensions_are_those_of_brute_force(monkeypatch):
    rng = random.Random(6)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(rng.randrange(1, 120))]
        n = len(w)
        e = periodic_runs.Extensions(np.array(w))
        pairs = [(rng.randrange(-1, n + 1), rng.randrange(-1, n + 1)) for _ in range(200)]
        pairs = [(i, j) for i, j in pairs if i != j]
        want = []
        for i, j in pairs:
            k = 0
            while min(i, j) >= 0 and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            want.append(k)
        assert e(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])).tolist() == want


def test_grid_in_parts(monkeypatch):
    whole = [np.concatenate(x).tolist() for x in zip(*periodic_runs.grid(75), strict=True)]
    monkeypatch.setattr(periodic_runs, "PAIRS", 10)
    assert [np.concatenate(x).tolist() for x in zip(*periodic_runs.grid(75), strict=True)] == whole
    assert sorted(zip(*whole, strict=True)) == [(p, j * p) for p in range(1, 38) for j in range(75 // p) if (j + 1) * p < 75]


def test_words_of_a_text_in_slices(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice(["a", "é", "世", *BLANKS, " x "]) for _ in range(500))
    for size in (1, 5, 1 << 20):
        monkeypatch.setattr(periodic_runs, "SLICE", size)
        w = periodic_runs.Words(text)
        assert w.joined(None).split(" ") == WORD.findall(text)


def test_runs_of_odd_input(spark):
    long = " ".join(f"w{i}" for i in range(15_000))
    texts = [(1, None), (2, ""), (3, BLANKS), (4, "a " * 11), (5, "a " * 12), (6, " ".join([long, long, long, "end"])), (6, "a b c " * 4), (None, "x y " * 9), (None, "x y " * 9)]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.runs(rows_of(spark, texts)).collect()), key=str)
    want = []
    for i, t in texts:
        w = WORD.findall(t or "")
        runs = [(0, 45_000, 15_000)] if len(w) > 40_000 else brute_runs(w)
        want.append((i, len(w), runs, brute_collapsed(w, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs.runs(empty(spark)).count() == 0
    assert periodic_runs.runs(odd_docs(spark)).count() == 12


def test_runs_query(spark):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert any(r["n_runs"] for r in got.values())
    for r in docs(spark).collect():
        w = WORD.findall(r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # brute force takes the square of the words
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join("{},{},{}\n".format(*x) for x in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(runs), *best, milli, sha(lines), sha(brute_collapsed(w, runs)))


# --- 13


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(queries.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def odd_texts(rng, n):
    out = []
    for _ in range(n):
        k = rng.random()
        if k < 0.3:
            out.append("".join(rng.choice(["a", "b", "'", "s", "t", "re", "ll", "'ve", "'d", " ", "  ", "\n", "\t", "1", "é", "世", "<|endoftext|>", "<|endof"]) for _ in range(rng.randrange(60))))
        elif k < 0.5:
            out.append("".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x250), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x110000), 0x558, 0x1E900, 0x85, 0x3000])) for _ in range(rng.randrange(40))))
        elif k < 0.7:
            out.append(rng.choice(["a", "ab", "é", " ", "0", "the", "'s", "語", "\r\n"]) * rng.randrange(200))
        else:
            out.append(" ".join("".join(rng.choice("etaoinshrdlu,.") for _ in range(rng.randrange(1, 25))) for _ in range(30)))
    return out


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize(("size", "remembered", "packed"), [(1 << 20, 400_000, 16), (40, 50, 16)])
def test_ids_are_those_of_the_library(codec, library, monkeypatch, size, remembered, packed):
    monkeypatch.setattr(byte_bpe, "SLICE", size)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", remembered)
    codec._forget()
    texts = odd_texts(random.Random(size), 1500)
    for text, raw in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(raw) == want
        assert codec.decode(raw) == library.decode(want, skip_special_tokens=False)


def test_both_kinds_of_trees_agree(codec):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdest \xe9") for _ in range(rng.randrange(1, 50))).encode()[:64] for _ in range(300)]
    rows = np.frombuffer(b"".join(w.ljust(64, b"\0") for w in words), np.uint8).reshape(-1, 64)
    flat, places, counts = codec._merged(rows, np.array([len(w) for w in words]))
    for w, a, n in zip(words, places, counts, strict=True):
        assert flat[a : a + n].tolist() == codec.merges.alone(codec.byte_ids[np.frombuffer(w, np.uint8)].tolist())


def test_any_ids_decode_as_by_the_library(codec, library):
    rng = random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(None) is None


def test_pieces_of_one_hash_are_told_apart(codec, library, monkeypatch):
    monkeypatch.setattr(np, "unique", _first_only(np.unique))
    codec._forget()
    text = "one two three four two one thirteen"
    assert ids_of(codec.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids
    codec._forget()


def _first_only(real):
    """np.unique as if all keys were equal, where places are asked for."""

    def unique(a, return_index=False, return_inverse=False):
        if not return_inverse:
            return real(a)
        return a[:1], np.array([0]), np.zeros(len(a), np.int64)

    return unique


def test_long_pieces(codec, library):
    for text in ("a" * 20_000, "ab" * 9_000, "語" * 5_000, "x" * 65, "y" * 64, "-" * 17):
        assert ids_of(codec.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_odd_input(spark, library):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    d = odd_docs(spark)
    got = sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), r["text"]) for r in byte_bpe.decode(spark, byte_bpe.encode(spark, d, path), path).collect())
    want = []
    for r in d.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert byte_bpe.decode(spark, byte_bpe.encode(spark, empty(spark), path), path).count() == 0


def test_bpe_query(spark, library):
    got = {r["doc_id"]: tuple(r) for r in queries.op13_byte_bpe(spark, SF).collect()}
    for r in docs(spark).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want = (r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False)))
        assert got[r["doc_id"]] == want
