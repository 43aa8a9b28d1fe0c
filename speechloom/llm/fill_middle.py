"""Fill-in-the-middle examples: texts cut at two token boundaries and put in the order prefix, suffix, middle or suffix, prefix, middle.

A token is a word with the white space before it; white space at the end is one more. Tokens and marks (``<P>``, ``<S>``, ``<M>``) are read by an automaton
of four states. A chunk of text is summed up, without knowing what stands before it, by the state it leads to from each state and by what it
counts from each; such sums compose associatively. A text that is one chunk is decided where it is read. The chunks of a longer text
are dealt over the cluster: their sums are composed in order, which gives the state that each chunk is entered in and the tokens before it, so that
each cut is looked for in one chunk only. Texts of one chunk are never shuffled.

Cases: null text is empty; an empty text, or one that holds a mark, stays plain; a null doc_id is hashed as the empty string; repeated rows
each give the same row; a text has as many chunks as it needs; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

#: Code points of a chunk.
CHUNK = 1 << 16
#: States: in white space (and at the start), in a word, after ``<``, after ``<P``, ``<S`` or ``<M``.
SPACE, WORD, OPEN, NAMED = range(4)
MARKS = ("<P>", "<S>", "<M>")
#: The automaton forgets all but its last characters.
MEMORY = 2

_SUM = "chars long, ends array<int>, words array<long>, marks array<long>"


def step(state: int, c: int) -> tuple[int, int, int]:
    """The next state, and whether a word or a mark ended with this character: the word before it, the mark with it."""
    if c == 32 or 9 <= c <= 13:
        return SPACE, int(state != SPACE), 0
    if c == ord("<"):
        return OPEN, 0, 0
    if state == OPEN and chr(c) in "PSM":
        return NAMED, 0, 0
    return WORD, 0, int(state == NAMED and c == ord(">"))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def blank(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


def word_ends(c: np.ndarray, state: int) -> np.ndarray:
    """Places of white space right after a word, if the chunk is entered in the state."""
    b = blank(c)
    before = np.concatenate([[state == SPACE], b[:-1]]) if len(b) else b
    return np.flatnonzero(b & ~before)


def summary(c: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """From each state: the state at the chunk's end, words ended, marks ended. The states differ in the first characters only."""
    tail = c[MEMORY:]
    b = blank(c[MEMORY - 1 :])
    words = int((b[1:] & ~b[:-1]).sum())
    named = (c[1:-1] == ord("P")) | (c[1:-1] == ord("S")) | (c[1:-1] == ord("M"))
    marks = int(((tail == ord(">")) & named & (c[:-2] == ord("<"))).sum()) if len(tail) else 0
    ends, word_counts, mark_counts = [], [], []
    for state in range(4):
        w = m = 0
        for x in c[:MEMORY].tolist():
            state, ended, marked = step(state, x)
            w, m = w + ended, m + marked
        if len(tail):
            for x in c[-MEMORY:].tolist():
                state = step(state, x)[0]
        ends.append(state)
        word_counts.append(w + words)
        mark_counts.append(m + marks)
    return ends, word_counts, mark_counts


def compose(a: tuple[list[int], ...], b: tuple[list[int], ...]) -> tuple[list[int], ...]:
    """The sums of two neighbouring chunks as those of one."""
    return [b[0][e] for e in a[0]], [n + b[1][e] for n, e in zip(a[1], a[0], strict=True)], [n + b[2][e] for n, e in zip(a[2], a[0], strict=True)]


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of the document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def cut_units(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: tokens, whether a mark is there, code points before each cut."""
    for batch in batches:
        rows = []
        for text, h1, h2 in zip(batch["text"].to_pylist(), batch["h1"].to_pylist(), batch["h2"].to_pylist(), strict=True):
            c = points(text)
            _, words, marks = summary(c)
            n = words[SPACE] + (len(c) > 0)
            places = np.concatenate([[0], word_ends(c, SPACE), [len(c)]])  # of n + 1 cuts
            rows.append((n, marks[SPACE] > 0, *(int(places[k]) for k in cut_units(n, h1, h2))))
        n, marked, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
        kept = [batch[c] for c in ("doc_id", "text", "h3", "h4")]
        made = [pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        yield pa.record_batch([*kept, *made], names=["doc_id", "text", "h3", "h4", "n", "marked", "cut1", "cut2"])


def _split(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for i in range(0, len(text), size):
                    yield pa.record_batch([pa.array([key]), pa.array([i // size], pa.int32()), pa.array([text[i : i + size]])], names=["key", "chunk", "piece"])

    return run


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cs = [points(t) for t in batch["piece"].to_pylist()]
        ends, words, marks = (list(x) for x in zip(*map(summary, cs), strict=True)) if cs else ([], [], [])
        lists = [pa.array(ends, pa.list_(pa.int32())), pa.array(words, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))]
        yield pa.record_batch([batch["key"], batch["chunk"], pa.array([len(c) for c in cs], pa.int64()), *lists], names=["key", "chunk", "chars", "ends", "words", "marks"])


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each of a text's two cuts: its chunk, the state that chunk is entered in, the word end wanted there and the code points before it."""
    for batch in batches:
        out = []
        for key, h1, h2, sums in zip(*(batch[c].to_pylist() for c in ("key", "h1", "h2", "sums")), strict=True):
            whole = ([SPACE, WORD, OPEN, NAMED], [0] * 4, [0] * 4)  # of no text
            before, chars = [], [0]
            for s in sums:
                before.append(whole)
                whole = compose(whole, (s["ends"], s["words"], s["marks"]))
                chars.append(chars[-1] + s["chars"])
            n = whole[1][SPACE] + (chars[-1] > 0)
            ended = np.array([w[1][SPACE] for w in before])
            for cut, k in enumerate(cut_units(n, h1, h2), 1):
                at = max(int(np.searchsorted(ended, k, side="left")) - 1, 0)  # the last chunk with fewer than k words ended before it
                inside = 0 < k < n
                out.append((key, n, whole[2][SPACE] > 0, cut, at if inside else 0, before[at][0][SPACE] if inside else SPACE, k - int(ended[at]) if inside else 0, chars[at] if inside else chars[-1] if k else 0))
        names = ["key", "n", "marked", "cut", "chunk", "state", "wanted", "before"]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = []
        for piece, state, wanted, before in zip(*(batch[c].to_pylist() for c in ("piece", "state", "wanted", "before")), strict=True):
            places.append(before + (int(word_ends(points(piece), state)[wanted - 1]) if wanted else 0))
        yield pa.record_batch([batch["key"], batch["n"], batch["marked"], batch["cut"], pa.array(places, pa.int64())], names=["key", "n", "marked", "cut", "place"])


def cuts(spark: SparkSession, docs: DataFrame, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, h3, h4 with n (tokens), marked, cut1 and cut2 (code points before each cut) of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", *draws(F.col("doc_id"), seed))
    small = d.where(F.char_length("text") <= chunk).mapInArrow(_decide, "doc_id long, text string, h3 long, h4 long, n long, marked boolean, cut1 long, cut2 long")
    large = d.where(F.char_length("text") > chunk).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256))
    heads = large.groupBy("key").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"))  # rows alike in id and text have one key and one result
    pieces = written(spark, large.mapInArrow(_split(chunk), "key string, chunk int, piece string").dropDuplicates(["key", "chunk"]))
    sums = pieces.repartition("key", "chunk").mapInArrow(_sum_up, f"key string, chunk int, {_SUM}")
    sums = sums.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "chars", "ends", "words", "marks"))).alias("sums"))  # a string has at most 2^31 / chunk of them
    entered = heads.join(sums, "key").mapInArrow(_enter, "key string, n long, marked boolean, cut int, chunk int, state int, wanted long, before long")
    found = entered.join(pieces, ["key", "chunk"]).mapInArrow(_select, "key string, n long, marked boolean, cut int, place long")
    found = found.groupBy("key").agg(F.first("n").alias("n"), F.first("marked").alias("marked"), F.min("place").alias("cut1"), F.max("place").alias("cut2"))
    return small.unionByName(large.join(found, "key").drop("key", "h1", "h2"))


def transform(spark: SparkSession, docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, n, form (plain, psm, spm), prefix_chars and middle_chars (null if plain) and output of every row of docs."""
    d = cuts(spark, docs, seed, chunk)
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= percent)
    d = d.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    one, two = F.col("cut1").cast("int"), F.col("cut2").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), one), F.substr("text", one + 1, two - one), F.substr("text", two + 1)
    psm = F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle)
    spm = F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    cut = F.col("form") != "plain"
    return d.select("doc_id", "text", "n", "form", F.when(cut, F.col("cut1")).alias("prefix_chars"), F.when(cut, F.col("cut2") - F.col("cut1")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; the marks are the only ones in it unless it is plain."""
    parts = F.split(output, "<[PSM]>")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
