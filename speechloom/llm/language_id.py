"""Language by words: scripts narrow the candidates, then a Viterbi path with a switching penalty labels spans.

Every language gets a model of the characters within its words (order 3, backing off to its order 2 and 1). A word's candidates
are the languages that use its script in the training texts (all, if none does). The path that maximises the sum of word
scores minus a penalty for each change of language labels every word; the document's language holds most letters of the path.
All characters and all languages of the training texts are learned; what is broadcast grows with them, by 1 / SHARE n-grams a language at most.

Cases: null texts and texts without a letter are ``und`` with score 0; null lang is not learned from; without any training
text everything is ``und``; words without letters take the language around them; ties go to the language that sorts first; repeated
rows are labelled alike; an empty table gives no rows; very long texts are labelled whole, in memory of a few bytes for each word and language; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chars
from .storage import Sent, written

ORDER = 3
SWITCH = 6.0
CACHE = 200_000
#: N-grams that are less than this share of their language's are left to the lower orders.
SHARE = 4e-6
#: Words times languages whose paths are found together (a longer text is alone), and characters that are read for it.
STEP_CELLS, STEP_CHARS = 8_000_000, 10_000_000
#: Script ranges of Unicode.
SCRIPTS = (
    ("latin", "A-Za-zªºÀ-ɏḀ-ỿ"),
    ("greek", "Ͱ-Ͽἀ-῿"),
    ("cyrillic", "Ѐ-ԯ"),
    ("armenian", "԰-֏"),
    ("hebrew", "֐-׿"),
    ("arabic", "؀-ۿݐ-ݿ"),
    ("devanagari", "ऀ-ॿ"),
    ("bengali", "ঀ-৿"),
    ("tamil", "஀-௿"),
    ("thai", "฀-๿"),
    ("georgian", "Ⴀ-ჿ"),
    ("hangul", "ᄀ-ᇿ가-힯"),
    ("kana", "぀-ヿ"),
    ("han", "㐀-䶿一-鿿"),
)
_SCRIPT = [(name, re.compile(f"[{r}]")) for name, r in SCRIPTS]


def script_of(word: str) -> int:
    """Index of the script of most of a word's letters; len(SCRIPTS) for others, -1 without a letter."""
    if word.isascii():
        return 0 if any(c.isalpha() for c in word) else -1
    n = [len(r.findall(word)) for _, r in _SCRIPT]
    best = max(range(len(n)), key=n.__getitem__)
    return best if n[best] else (len(n) if any(c.isalpha() for c in word) else -1)


class CharModel:
    """log P(c | a b) of one language from trigram counts, each order mixed with the next lower by its kinds (Witten-Bell)."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, size: int):
        self.orders: list[tuple[chars.Lookup, chars.Lookup]] = []
        self.floor = -np.log(size)
        for order in range(1, ORDER + 1):
            keys, at = np.unique(chars.lower(gram, order), return_inverse=True)
            count = np.bincount(at, weights=n)
            context, to = np.unique(keys >> chars.BITS, return_inverse=True)
            total, kinds = np.bincount(to, weights=count), np.bincount(to)
            p = (count + kinds[to] * np.exp(self(keys))) / (total + kinds)[to]
            self.orders.append((chars.Lookup(keys, np.log(p), 0.0), chars.Lookup(context, np.log(kinds / (total + kinds)), 0.0)))

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        out = np.full(len(gram), self.floor)
        for order, (held, back) in enumerate(self.orders, 1):
            key = chars.lower(gram, order)
            value, known = held(key)
            out = np.where(known, value, out + back(key >> chars.BITS)[0])
        return out


class Labeller:
    """Scores of words by language and paths through texts."""

    def __init__(self, langs: list[str], models: list[CharModel], allowed: np.ndarray):
        self.langs, self.models, self.allowed = langs, models, allowed
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)), np.float32)
        self.letters = np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        bare = [w.strip(chars.STRIP) for w in new]
        g, i = chars.grams(bare, ORDER)
        script = np.array([script_of(w) for w in bare])
        letters = np.array([sum(map(str.isalpha, w)) for w in bare], np.int32)
        able = self.allowed[script]
        able[~able.any(axis=1)] = True
        rows = np.full((len(new), len(self.langs)), -np.inf)
        u, back = np.unique(g, return_inverse=True)
        for k, m in enumerate(self.models):
            if able[:, k].any():  # languages of other scripts are not asked
                rows[:, k] = np.bincount(i, weights=m(u)[back], minlength=len(new))
        rows = np.where(able, rows, np.where(able, rows, -np.inf).max(axis=1, keepdims=True) - 40.0)
        rows -= rows.max(axis=1, keepdims=True)
        rows[script < 0] = 0.0
        base = len(self.letters)
        self.index.update((w, base + k) for k, w in enumerate(new))
        self.scores = np.vstack([self.scores, rows.astype(np.float32)])
        self.letters = np.concatenate([self.letters, letters])

    def paths(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The best path of each text (arrays of word indexes): all texts move on together, one word a step."""
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        lengths = np.array([len(docs[k]) for k in order])
        n = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(n), side="left")  # texts longer than t
        flat = np.concatenate([docs[k] for k in order]) if n else np.zeros(0, np.int64)
        base = np.cumsum(lengths) - lengths
        v = np.zeros((len(order), len(self.langs)), np.float32)
        stays, tops = np.zeros((len(flat), len(self.langs)), bool), np.zeros(len(flat), np.int16)
        for t in range(n):
            a = active[t]
            s = self.scores[flat[base[:a] + t]]
            head = v[:a]
            if t:
                top = head.argmax(axis=1)
                jump = head[np.arange(a), top][:, None] - SWITCH
                stay = head >= jump
                stays[base[:a] + t], tops[base[:a] + t] = stay, top
                head = np.where(stay, head, jump)
                head -= head.max(axis=1, keepdims=True)
            v[:a] = head + s
        state = v.argmax(axis=1)
        out = np.zeros(len(flat), np.int16)
        out[base[lengths > 0] + lengths[lengths > 0] - 1] = state[lengths > 0]
        for t in range(n - 1, 0, -1):
            a = active[t]
            at, cur = base[:a] + t, state[:a]
            cur = np.where(stays[at, cur], cur, tops[at])
            state[:a] = cur
            out[at - 1] = cur
        made: list[np.ndarray] = [np.zeros(0, np.int16)] * len(docs)
        for j, k in enumerate(order):
            made[k] = out[base[j] : base[j] + lengths[j]]
        return made

    def texts(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans of words as (first, end, language)) of each text."""
        if len(self.letters) > CACHE:
            self.reset()
        docs = []
        for at in range(0, len(texts), 64):
            split = [t.lower().split() for t in texts[at : at + 64]]
            if new := list({w for ws in split for w in ws if w not in self.index}):
                self.learn(new)
            get = self.index.__getitem__
            docs += [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in split]
        paths: list[np.ndarray] = []
        group: list[np.ndarray] = []
        size = 0
        for k, words in enumerate(docs):
            group.append(words)
            size += len(words)
            if k == len(docs) - 1 or (size + len(docs[k + 1])) * len(self.langs) > STEP_CELLS:
                paths += self.paths(group)
                group, size = [], 0
        out = []
        for words, path in zip(docs, paths, strict=True):
            letters = self.letters[words]
            by = np.bincount(path, weights=letters, minlength=len(self.langs))
            if not by.sum():
                out.append(("und", 0.0, []))
                continue
            best = int(by.argmax())
            cuts = np.flatnonzero(np.diff(path)) + 1
            edges = [0, *cuts.tolist(), len(path)]
            out.append((self.langs[best], float(by[best] / by.sum()), [(a, b, self.langs[path[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]))
        return out


def train(spark: SparkSession, rows: DataFrame) -> tuple | None:
    """The labeller's arguments from rows (text, label); None if there are none. Counts are taken over all rows."""
    rows = rows.where("label is not null and text is not null")
    langs = sorted(r[0] for r in rows.select(F.col("label").cast("string")).distinct().collect())  # a row a language
    if not langs:
        return None
    index = F.array_position(F.array(*[F.lit(k) for k in langs]), F.col("label").cast("string")) - 1
    held = written(spark, rows.select("text", index.alias("label")))
    cells = chars.common(chars.gram_counts(held, ORDER), SHARE).toPandas()
    label, gram, n = (cells[c].to_numpy() for c in ("label", "gram", "n"))
    size = len(np.unique(chars.lower(gram, 1))) + 1
    models = [CharModel(gram[label == k], n[label == k], size) for k in range(len(langs))]

    def scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int], int] = {}
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, (_, r) in enumerate(_SCRIPT):
                    if r.search(t):
                        n[(k, i)] = n.get((k, i), 0) + 1
        yield pa.record_batch([pa.array([k[0] for k in n], pa.int64()), pa.array([k[1] for k in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["label", "script", "n"])

    seen = held.select("text", F.col("label").cast("long")).mapInArrow(scripts, "label long, script long, n long").groupBy("label", "script").agg(F.sum("n").alias("n")).collect()
    allowed = np.zeros((len(SCRIPTS) + 2, len(langs)), bool)  # the last row is for words without letters
    most: dict[int, int] = {}
    for r in seen:
        most[r["label"]] = max(most.get(r["label"], 0), r["n"])
    for r in seen:
        allowed[r["script"], r["label"]] = r["n"] * 100 >= most[r["label"]]
    return langs, models, allowed


def label(docs: DataFrame, model: tuple | None) -> DataFrame:
    """id, lang_pred, score and spans of rows (id, text)."""
    if model is None:
        return docs.select("id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<first:int,end:int,lang:string>>)").alias("spans"))
    held = Sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(*held.value)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        ids: list = []
        texts: list[str] = []

        def made() -> pa.RecordBatch:
            got = lab.texts(texts)
            spans = [[{"first": x, "end": y, "lang": z} for x, y, z in m[2]] for m in got]
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array([m[0] for m in got], pa.string()), pa.array([m[1] for m in got], pa.float64()), pa.array(spans, kind)], names=["id", "lang_pred", "score", "spans"])

        size = 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1]) + 100
                if size > STEP_CHARS:
                    yield made()
                    ids, texts, size = [], [], 0
        yield made()

    return docs.select("id", "text").mapInArrow(run, "id long, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>")


def identify(spark: SparkSession, docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every document; rows whose crc32(doc_id) mod folds is held are not learned from."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label"))
    out = F.coalesce(chars.fold(F.col("id"), folds) == held, F.lit(False))
    model = train(spark, d.where(~out).select("text", "label"))
    return label(d, model).select(F.col("id").alias("doc_id"), out.alias("held_out"), "lang_pred", "score", "spans")
