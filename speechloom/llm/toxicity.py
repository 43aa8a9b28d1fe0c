"""Toxicity by class-conditional Kneser-Ney models of characters within words.

The toxic and the ordinary labelled texts each get an interpolated Kneser-Ney model of order 4; both back off to the
same continuation counts, learned from all training texts together, so that rare and unseen forms of an expression are judged by
the pieces they share with known ones. A word's evidence is the difference of its two log-likelihoods, divided by its length; a
document's is the length-normalised difference over its whole text and over its most toxic words; a logistic function learned on
the training rows turns both into the score.

Counts are taken over all labelled training rows and all characters, and the models are made of them as tables: every n-gram counts, however
rare. Where they hold up to HELD n-grams and contexts, these are broadcast. Beyond that the most frequent n-grams are, and a word with
another one is scored by joins with the tables: its evidence is the same, and so is the score.
The logistic function is fitted on a sample of about ``FIT_ROWS`` of them (a hash of the id decides), each scored by the counts of the
half of the rows that it is not in.

Cases: null and empty texts have no evidence and get the score of such a text; with no label of either class every score is
0; labels that are null are not learned from; several labels of one document all count; repeated rows are scored alike; ties need no order; an
empty table gives no rows; a very long text is scored whole; other columns play no part, a column of labels that clashes included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chars
from .storage import Sent, written

ORDER = 4
DISCOUNT = 0.75
#: Expected size of the sample of labelled rows that the logistic function is fitted on.
FIT_ROWS = 10_000
CACHE = 200_000
PREDICT_AT = 0.7
N_FEATURES = 4
#: N-grams and contexts that are broadcast at most; words with others are scored by joins.
HELD = 2_000_000
#: Parts of the counts: those of each half's other half, and all.
ALL = 2


def kneser_ney(counts: np.ndarray, context: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(last | first ones) of n-grams from their counts, contexts and lower-order probabilities; and each context with its weight of the lower order."""
    kept, inv = np.unique(context, return_inverse=True)
    total = np.maximum(np.bincount(inv, weights=counts, minlength=len(kept)), 1.0)
    back = DISCOUNT * np.bincount(inv, weights=counts > 0, minlength=len(kept)) / total
    return np.maximum(counts - DISCOUNT, 0) / total[inv] + back[inv] * below, kept, back


def evidence(gram: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> tuple[chars.Lookup, chars.Lookup]:
    """log P(toxic) - log P(plain) of each 4-gram seen, and of any other by its context; the lower orders are continuation counts of both classes.

    Where a 4-gram is in neither class, both models give the shared lower order times their context's weight, so its evidence is that of the weights.
    """
    def continuation(below: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct lower keys of so many characters, and in how many contexts each occurs."""
        return np.unique(chars.lower(below, order), return_counts=True)

    tri, n3 = continuation(gram, 3)
    bi, n2 = continuation(tri, 2)
    uni, n1 = continuation(bi, 1)
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * (len(n1) + 1))
    p2 = kneser_ney(n2, bi >> chars.BITS, p1[np.searchsorted(uni, chars.lower(bi, 1))])[0]
    p3 = kneser_ney(n3, tri >> chars.BITS, p2[np.searchsorted(bi, chars.lower(tri, 2))])[0]
    below, context = p3[np.searchsorted(tri, chars.lower(gram, 3))], chars.lower(gram >> chars.BITS, 3)
    logs, weights = [], []
    for n in (toxic, plain):
        seen = n > 0
        some = kneser_ney(n[seen], context[seen], below[seen])
        weight = chars.Lookup(some[1], some[2], 1.0)
        p = weight(context)[0] * below
        p[seen] = some[0]
        logs.append(np.log(p))
        weights.append(weight)
    every = np.unique(context)
    return chars.Lookup(gram, logs[0] - logs[1], 0.0), chars.Lookup(every, np.log(weights[0](every)[0]) - np.log(weights[1](every)[0]), 0.0)


def _key(c: str, order: int) -> Column:
    """chars.lower of a column."""
    return F.col(c).bitwiseAND(F.lit((1 << chars.BITS * order) - 1))


def _context(c: str) -> Column:
    return F.shiftrightunsigned(c, chars.BITS)


def _joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """A join of tables that grow with the n-grams: never by broadcast."""
    return left.join(right.hint("merge"), list(keys))


def model_tables(spark: SparkSession, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``evidence`` as tables, of every part: (part, gram, n, value) and (part, context, value), from (label: class + 2 * half, gram, n)."""
    c, half, toxic = F.col, F.floor(F.col("label") / 2).cast("int"), F.col("label") % 2 == 1
    each = counts.select(F.explode(F.array(F.lit(ALL), 1 - half)).alias("part"), "gram", F.when(toxic, c("n")).otherwise(0).alias("t"), F.when(toxic, 0).otherwise(c("n")).alias("p"))
    grams = each.groupBy("part", "gram").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    grams = written(spark, grams.withColumn("tri", _key("gram", 3)).withColumn("context", _context("gram").bitwiseAND(F.lit((1 << chars.BITS * 3) - 1))))
    tri = grams.groupBy("part", "tri").agg(F.count("*").alias("n3")).withColumn("bi", _key("tri", 2)).withColumn("c3", _context("tri"))
    tri = written(spark, tri)
    bi = written(spark, tri.groupBy("part", "bi").agg(F.count("*").alias("n2")).withColumn("uni", _key("bi", 1)).withColumn("c2", _context("bi")))
    uni = bi.groupBy("part", "uni").agg(F.count("*").alias("n1"))
    size = uni.groupBy("part").agg(F.sum("n1").alias("s"), F.count("*").alias("k"))  # a row a part
    uni = uni.join(F.broadcast(size), "part").select("part", "uni", ((c("n1") + 0.5) / (c("s") + 0.5 * (c("k") + 1))).alias("p1"))

    def smoothed(d: DataFrame, n: str, context: str, below: str, name: str) -> DataFrame:
        sums = d.groupBy("part", context).agg(F.sum(n).alias("__s"), F.count("*").alias("__k"))
        p = F.greatest(c(n) - DISCOUNT, F.lit(0.0)) / c("__s") + DISCOUNT * c("__k") / c("__s") * c(below)
        return _joined(d, sums, "part", context).withColumn(name, p)

    p2 = smoothed(_joined(bi, uni, "part", "uni"), "n2", "c2", "p1", "p2").select("part", "bi", "p2")
    p3 = smoothed(_joined(tri, p2, "part", "bi"), "n3", "c3", "p2", "p3").select("part", "tri", "p3")
    kinds = lambda n: F.count(F.when(c(n) > 0, 1))
    weight = lambda n: F.when(kinds(n) > 0, DISCOUNT * kinds(n) / F.sum(n)).otherwise(1.0)
    contexts = written(spark, grams.groupBy("part", "context").agg(F.greatest(F.sum("t"), F.lit(1)).alias("st"), F.greatest(F.sum("p"), F.lit(1)).alias("sp"), weight("t").alias("wt"), weight("p").alias("wp")))
    d = _joined(_joined(grams, p3, "part", "tri"), contexts, "part", "context")
    log_p = lambda n: F.log(F.greatest(c(n) - DISCOUNT, F.lit(0.0)) / c("s" + n) + c("w" + n) * c("p3"))
    made = written(spark, d.select("part", "gram", (c("t") + c("p")).alias("n"), (log_p("t") - log_p("p")).cast("float").alias("value")))
    return made, contexts.select("part", "context", (F.log("wt") - F.log("wp")).cast("float").alias("value"))


def _lookup(rows: DataFrame, key: str) -> chars.Lookup:
    held = rows.select(key, "value").toPandas()
    return chars.Lookup(held[key].to_numpy(np.int64), held["value"].to_numpy(), 0.0)


class Model:
    """The tables of a part, and what of them is broadcast: everything if it is at most HELD rows, else the most frequent n-grams."""

    def __init__(self, tables: tuple[DataFrame, DataFrame], part: int):
        self.grams, self.contexts = (t.where(F.col("part") == part).drop("part") for t in tables)
        by = {r["b"]: r["n"] for r in self.grams.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
        self.whole = sum(by.values()) + self.contexts.count() <= HELD
        least = 0
        while not self.whole and sum(n for b, n in by.items() if b >= least) > HELD:
            least += 1
        hot = self.grams.where(F.col("n") >= F.lit(1 << least))
        self.args = (_lookup(hot, "gram"), _lookup(self.contexts if self.whole else self.contexts.limit(0), "context"), self.whole)

    def features(self, rows: DataFrame) -> DataFrame:
        """id, f of rows (id, text), where some words have n-grams that are not broadcast."""
        spark, c, held = rows.sparkSession, F.col, Sent(rows.sparkSession, self.args)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*held.value)
            for whole in batches:
                for at in range(0, max(1, whole.num_rows), 512):
                    b = whole.slice(at, 512)
                    got = scorer.partial([t or "" for t in b.column(1).to_pylist()])
                    kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))
                    yield pa.record_batch([b.column(0), *[pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)]], names=["id", "sums", "tops", "open"])

        made = rows.select("id", "text").mapInArrow(run, "id long, sums array<double>, tops array<double>, open array<struct<word:string,n:long>>")
        made = written(spark, made.withColumn("rid", F.monotonically_increasing_id()))
        asked = made.select("rid", F.explode("open").alias("o")).select("rid", "o.word", "o.n")

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = b.column(0).to_pylist()
                g, i = chars.grams(words, ORDER) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.record_batch([b.column(0).take(pa.array(i)), pa.array(g), pa.array(chars.lower(g >> chars.BITS, 3))], names=["word", "gram", "context"])

        parts = asked.select("word").distinct().mapInArrow(pieces, "word string, gram long, context long")
        parts = parts.join(self.grams.select("gram", c("value").alias("v")).hint("merge"), "gram", "left").join(self.contexts.select("context", c("value").alias("w")).hint("merge"), "context", "left")
        words = parts.groupBy("word").agg(F.sum(F.coalesce("v", "w", F.lit(0.0)).cast("double")).alias("e"), F.count("*").alias("k"))
        rate = c("e") / (c("k") + 2.0)
        more = asked.join(words.hint("merge"), "word").groupBy("rid").agg(
            F.array(F.sum(c("e") * c("n")), F.sum(c("k") * c("n")).cast("double"), F.sum(rate * c("n")), F.sum("n").cast("double")).alias("s"),
            F.flatten(F.collect_list(F.array_repeat(rate, F.least(c("n"), F.lit(3)).cast("int")))).alias("r"),  # of the words of one text
        )
        d = made.join(more.hint("merge"), "rid", "left")
        x = [F.get("sums", F.lit(k)) + F.coalesce(F.get("s", F.lit(k)), F.lit(0.0)) for k in range(4)]
        top = F.sort_array(F.concat("tops", F.coalesce("r", F.expr("cast(array() as array<double>)"))), asc=False)
        d = d.select("id", F.array(*x).alias("x"), F.slice(top, 1, 3).alias("top"))
        at = lambda k: F.get("x", F.lit(k))
        return d.select("id", F.when(at(3) > 0, F.array(at(0) / at(1), at(2) / at(3), F.get("top", F.lit(0)), F.element_at("top", -1))).otherwise(F.array(*[F.lit(0.0)] * N_FEATURES)).alias("f"))


class Scorer:
    """Features of texts: the mean evidence per character, and the mean, largest and third largest evidence of words per character.

    Where not all n-grams are given, words with another one are left open.
    """

    def __init__(self, seen: chars.Lookup, contexts: chars.Lookup, whole: bool = True):
        self.held, self.contexts, self.whole, self.seen = seen, contexts, whole, {"": (0.0, 0.0)}

    def words(self, new: list[str]) -> None:
        stripped = [w.strip(chars.STRIP) for w in new]
        g, i = chars.grams(stripped, ORDER)
        value, known = self.held(g)
        value = np.where(known, value, self.contexts(chars.lower(g >> chars.BITS, 3))[0])
        total = np.bincount(i, weights=value, minlength=len(new))
        length = np.fromiter(map(len, stripped), np.float64, len(new))
        total[length == 0] = 0.0
        self.seen.update(zip(new, zip(total.tolist(), (length + 1).tolist(), strict=True), strict=True))
        if not self.whole:
            lacking = (np.bincount(i, weights=~known, minlength=len(new)) > 0) & (length > 0)
            self.seen.update((new[k], None) for k in np.flatnonzero(lacking))

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of them known after this."""
        split = [t.lower().split() for t in texts]
        if len(self.seen) > CACHE:
            self.seen = {"": (0.0, 0.0)}
        if new := list({w for ws in split for w in ws if w not in self.seen}):
            self.words(new)
        return split

    def partial(self, texts: list[str]) -> list[tuple[list[float], list[float], list[dict]]]:
        """Of each text's known words the sums of evidence, characters and rates, their number and three largest rates; and the open words with their numbers."""
        out = []
        for ws in self.split(texts):
            e = np.array([x for w in ws if (x := self.seen[w]) is not None]).reshape(-1, 2)
            rate = e[:, 0] / (e[:, 1] + 2.0)
            left = Counter(w.strip(chars.STRIP) for w in ws if self.seen[w] is None)
            out.append(([float(e[:, 0].sum()), float(e[:, 1].sum()), float(rate.sum()), float(len(e))], np.sort(rate)[::-1][:3].tolist(), [{"word": w, "n": n} for w, n in left.items()]))
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = self.split(texts)
        seen = self.seen
        out = np.zeros((len(texts), N_FEATURES))
        for k, ws in enumerate(split):
            if ws:
                e = np.array([seen[w] for w in ws])
                rate = e[:, 0] / (e[:, 1] + 2.0)  # short words say little
                top = np.sort(rate[np.argpartition(rate, -3)[-3:]] if len(rate) > 3 else rate)[::-1]
                out[k] = (e[:, 0].sum() / e[:, 1].sum(), rate.mean(), top[0], top[min(2, len(top) - 1)])
        return out


def score_rows(df: DataFrame, model: Model, weights: np.ndarray | None) -> DataFrame:
    """id, score (or the features if there are no weights) of rows (id, text)."""
    if not model.whole:
        made = model.features(df)
        if weights is None:
            return made
        z = sum((F.get("f", F.lit(k)) * float(weights[k]) for k in range(N_FEATURES)), F.lit(float(weights[-1])))
        return made.select("id", (1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    held = Sent(df.sparkSession, (model.args, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        args, w = held.value
        scorer = Scorer(*args)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(at, 512)
                f = scorer([t or "" for t in b.column(1).to_pylist()])
                if w is None:
                    yield pa.record_batch([b.column(0), pa.array(list(f), pa.list_(pa.float64()))], names=["id", "f"])
                else:
                    yield pa.record_batch([b.column(0), pa.array(sigmoid(f, w))], names=["id", "score"])

    return df.select("id", "text").mapInArrow(run, "id long, f array<double>" if weights is None else "id long, score double")


def sigmoid(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(f @ w[:-1] + w[-1], -30, 30)))


def fit_logistic(f: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and bias by Newton's method with a small ridge; features are scaled inside."""
    mean, sd = f.mean(axis=0), f.std(axis=0) + 1e-9
    x = np.column_stack([(f - mean) / sd, np.ones(len(f))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(f) * np.eye(x.shape[1]) * 0.01
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * len(f) * 0.01 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def train(spark: SparkSession, labelled: DataFrame) -> tuple[Model, np.ndarray] | None:
    """The model and the logistic weights, from rows (id, text, label 0/1); None if a class is missing."""
    half = F.xxhash64("id", F.lit("half")).bitwiseAND(1)
    rows = written(spark, labelled.where("label is not null").select("id", "text", (F.col("label").cast("int") == 1).cast("int").alias("label"), half.alias("half")))
    counts = chars.gram_counts(rows.select("text", (F.col("label") + 2 * F.col("half")).alias("label")), ORDER)
    there = {r["label"] for r in counts.select("label").distinct().collect()}  # four at most
    if len({k % 2 for k in there}) < 2:
        return None
    tables = model_tables(spark, counts)
    args = Model(tables, ALL)
    share = min(1.0, FIT_ROWS / max(1, rows.count()))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64("id"), 11) < int(share * (1 << 53)))
    parts = []
    for h in (0, 1):  # each half by the counts of the other, or by all where that lacks a class
        fair = len({k % 2 for k in there if k // 2 != h}) == 2
        part = sample.where(F.col("half") == h)
        parts.append(score_rows(part, Model(tables, h) if fair else args, None).join(part.select("id", "label").distinct(), "id").toPandas())
    x, y = np.array([f for p in parts for f in p.f]), np.concatenate([p.label.to_numpy() for p in parts]).astype(float)
    if not len(y):  # no row of the sample: any sample row serves
        return args, np.append(np.ones(N_FEATURES), 0.0)
    return args, fit_logistic(x, y)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows whose crc32(doc_id) mod folds is held are not learned from."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where("label is not null")
    out = chars.fold(F.col("id"), folds) == held
    model = train(spark, d.where(~F.coalesce(out, F.lit(False))).join(marks.hint("merge"), "id"))  # labels grow with the corpus: never broadcast
    made = d.select("id", F.lit(0.0).alias("score")) if model is None else score_rows(d, *model)
    return made.select(F.col("id").alias("doc_id"), F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
