"""Best-fit packing by a grouping genetic algorithm over the corpus's piece lengths.

Pieces of one length are interchangeable, so the plan is made from the histogram of lengths (at most ``limit`` rows, whatever
the corpus) and then dealt to the pieces by their rank within their length. A histogram too large to evolve is thinned: bins
for 1/F of it are evolved, those filled well enough are used F times, and what is left goes to the next, finer level; the last
level has F = 1 and packs everything. Each level is evolved on islands (Spark tasks) that exchange their elites in a ring:
crossover injects whole well-filled bins of one parent into the other, removes the bins that hold the same items and
puts their remaining items back by best fit.

Cases: null text is empty and packs as the end token alone; empty tables give no rows; repeated documents are packed as often as
they occur; ties in a length's order are broken by doc_id and piece, rows equal in both change places freely; very long
texts are cut in pieces of ``limit`` tokens; other columns play no part.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import re
import sys
import types
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

LIMIT = 4096
END = 1
#: Pieces that one level evolves at most, and the bound of the plan that is broadcast for it.
LEVEL_ITEMS = 4000
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 6, 2, 6, 6
#: A thinned level keeps bins filled to this share.
FULL = 0.9995
#: Words, and runs of letters, that one generation of a worker's memory holds; it keeps two.
CACHE = 150_000

#: Marks in a batch of texts: a word that is encoded elsewhere, and the end of a text.
HOLE, TEXT_END = "\x01", "\x02"
#: Letters and signs of plain words, which are whole under every Unicode normal form that composes.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿœŒ", r"!-&(-/:-@\[-_{-~"
SIGN_RUN = re.compile(f"[{SIGNS}]+")
#: Words between spaces and line feeds that are not plain; very long ones are among them.
NOT_PLAIN = re.compile(rf"(?<![^ \n])(?![{LETTERS}{SIGNS}]{{1,200}}+(?![^ \n])|\x02(?![^ \n]))([^ \n]+)")

Bins = list[tuple[int, ...]]


# --- tokens


def kept_in_worker(name: str, make):
    """A value that stays in the Python worker from task to task, made when it is first asked for."""
    holder = sys.modules.setdefault("_loom_worker", types.ModuleType("_loom_worker")).__dict__
    if name not in holder:
        holder[name] = make()
    return holder[name]


class WordIds:
    """Ids of whole texts, as bytes. White space never joins tokens in this kind of tokenizer, so a text is encoded word by word.

    Words of Latin letters and signs go through one byte-pair encoder together (``plain_encoder``).
    Other words are remembered, and so are their letters without full stops and the like, which are tokens of their own. New runs of
    letters are encoded in one text, where a token that ends a word ends one run; whatever is not so simple is encoded by itself.
    """

    TAIL = ".,;:!?"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task: more only add memory
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        n = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.seen: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {"": b""}
        self.old_seen: dict[str, bytes] = {}
        self.old_cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.plain = self.plain_encoder()

    def alone(self, texts: list[str]) -> list[bytes]:
        parts = (texts[i : i + 1000] for i in range(0, len(texts), 1000))
        return [np.array(e.ids, "<u4").tobytes() for part in parts for e in self.tok.encode_batch(part, add_special_tokens=False)]

    def learn_cores(self, new: list[str]) -> None:
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.cores.update((w, raw[x:y]) for w, x, y in zip(part, at[:-1], at[1:], strict=True))
            else:
                self.cores.update(zip(part, self.alone(part), strict=True))

    def learn(self, new: list[str]) -> None:
        simple, other = [], []
        for w in new:
            core = w.rstrip(self.TAIL)
            low = core.lower() if core.isascii() else core  # a final sigma is lower-cased by the tokenizer in its own way
            if core and core.isalpha() and core.lower().isalpha():
                simple.append((w, low, w[len(core) :]))
            else:
                other.append(w)
        unknown = {low for _, low, _ in simple if low not in self.cores}
        back = unknown & self.old_cores.keys()
        self.cores.update(zip(back, map(self.old_cores.__getitem__, back), strict=True))
        if unknown := list(unknown - back):
            self.learn_cores(unknown)
        if tails := [t for t in {t for _, _, t in simple} if t not in self.tails]:
            self.tails.update(zip(tails, self.alone(tails), strict=True))
        self.seen.update((w, self.cores[low] + self.tails[t]) for w, low, t in simple)
        if other:
            self.seen.update(zip(other, self.alone(other), strict=True))

    def other(self, words: list[str]) -> list[bytes]:
        """Ids of words by the memory, or by the tokenizer."""
        if len(self.seen) > CACHE:  # words still in use come back from the last generation
            self.seen, self.old_seen = {"": b""}, self.seen
        if len(self.cores) > CACHE:
            self.cores, self.old_cores = {"": b""}, self.cores
        seen = self.seen
        if new := {w for w in words if w not in seen}:
            back = new & self.old_seen.keys()
            seen.update(zip(back, map(self.old_seen.__getitem__, back), strict=True))
            if new := new - back:
                self.learn(list(new))
        return list(map(seen.__getitem__, words))

    def plain_encoder(self):
        """A byte-pair encoder of runs of letters and of signs, where a space ends a run, or None if it and the tokenizer differ on samples.

        Ids rise with the order of merges, and a byte with its run's end comes before all merges, so ids serve as ranks.
        """
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that a vocabulary shows as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {}
        for t, i in self.tok.get_vocab().items():
            run = t.removesuffix("</w>")
            if t not in self.special and all(c in byte for c in run):
                ranks[bytes(byte[c] for c in run) + b" " * t.endswith("</w>")] = i
        top = self.tok.get_vocab_size()
        ranks |= {HOLE.encode() + b" ": top, TEXT_END.encode() + b" ": top + 1}
        if not all(bytes([b, *end]) in ranks for b in range(256) for end in (b"", b" ") if end == b"" or b > 2):
            return None
        made = tiktoken.Encoding("plain", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        rng, held = random.Random(1), sorted(t for t in (x.decode("utf-8", "ignore").strip() for x in ranks) if t)
        runs = [[t for t in held if re.fullmatch(f"[{c}]+", t) and t == t.lower()] for c in (LETTERS, SIGNS)]
        sample = " ".join(rng.choice(r) + rng.choice(r) for _ in range(4000) for r in runs) + " "
        return made if made.encode_ordinary(sample) == self.tok.encode(sample, add_special_tokens=False).ids else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        end = END.to_bytes(4, "little")
        if self.plain is None:
            return [b"".join(self.other(t.replace("\n", " ").split(" "))) + end if not self.odd(t) else self.alone([t])[0] + end for t in texts]
        odd = {i: self.alone([t])[0] + end for i, t in enumerate(texts) if self.odd(t)}
        parts = NOT_PLAIN.split("".join(f" {TEXT_END} " if i in odd else f"{t} {TEXT_END} " for i, t in enumerate(texts)))
        text = SIGN_RUN.sub(r" \g<0> ", HOLE.join(parts[::2]).lower())
        ids = self.plain.encode_to_numpy(" ".join(text.split()) + " ").astype("<u4")
        holes = np.flatnonzero(ids == self.tok.get_vocab_size())
        ends = np.flatnonzero(ids == self.tok.get_vocab_size() + 1)
        ids[ends] = END
        ends = ends + 1
        if len(holes):
            filled = self.other(parts[1::2])
            size = np.ones(len(ids), np.int64)
            size[holes] = np.fromiter(map(len, filled), np.int64, len(filled)) // 4
            after = np.cumsum(size)
            ends = after[ends - 1]
            is_hole = np.zeros(len(ids), bool)
            is_hole[holes] = True
            of_hole = np.repeat(is_hole, size)
            out = np.empty(len(of_hole), "<u4")
            out[~of_hole] = ids[~is_hole]
            out[of_hole] = np.frombuffer(b"".join(filled), "<u4")
            ids = out
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [odd.get(i) or raw[x:y] for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True))]

    def odd(self, text: str) -> bool:
        """Texts that hold a special token's string or the mark of a text's end are encoded as they are."""
        return TEXT_END in text or any(s in text for s in self.special)


def tokenize(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_in_worker(path, lambda: WordIds(path))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows: list[tuple] = []
                for d, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    for k, a in enumerate(range(0, len(ids), 4 * limit)):
                        part = ids[a : a + 4 * limit]
                        rows.append((d, k, a // 4, len(part) // 4, zlib.crc32(part)))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm, on lists of lengths


def best_fit(items: list[int], bins: list[list[int]], limit: int) -> list[list[int]]:
    """items, longest first, each into the bin with the least room that still holds it."""
    free = sorted((limit - sum(b), i) for i, b in enumerate(bins))
    for x in sorted(items, reverse=True):
        k = bisect.bisect_left(free, (x, -1))
        if k < len(free):
            room, i = free.pop(k)
        else:
            room, i = limit, len(bins)
            bins.append([])
        bins[i].append(x)
        bisect.insort(free, (room - x, i))
    return bins


def fitness(bins: list, limit: int) -> float:
    return sum((sum(b) / limit) ** 2 for b in bins) / max(1, len(bins))


def crossover(one: list, two: list, limit: int, rng: random.Random) -> list[list[int]]:
    """Well-filled bins of two go into one whole; bins of one that hold the same items give way, their other items are best-fitted."""
    good = sorted(two, key=sum, reverse=True)
    good = [b for b in good[: max(1, len(good) // 2)] if rng.random() < 0.5] or good[:1]
    double = Counter(x for b in good for x in b)
    kept, loose = [], []
    order = list(one)
    rng.shuffle(order)
    order.sort(key=sum)  # the worst-filled give their items first
    for b in order:
        if any(double[x] for x in b):
            for x in b:
                if double[x]:
                    double[x] -= 1
                else:
                    loose.append(x)
        else:
            kept.append(list(b))
    return best_fit(loose, [*map(list, good), *kept], limit)


def dominate(free: list[int], bins: list[list[int]], limit: int) -> list[int]:
    """Items of bins give way to longer free ones, or to two free ones that fill the bin better; the items now free are shorter."""
    free = sorted(free)
    for b in bins:
        room = limit - sum(b)
        for k in range(len(b)):
            if not room:
                break
            x = b[k]
            i = bisect.bisect_right(free, x + room) - 1
            one = free[i] if i >= 0 else 0
            best, pair = one, None
            for u in range(min(len(free), 12)):  # the shortest free items with the longest that fits beside each
                v = bisect.bisect_right(free, x + room - free[u]) - 1
                if v > u and free[u] + free[v] > best:
                    best, pair = free[u] + free[v], (u, v)
            if best > x:
                room -= best - x
                got = [free[i]] if pair is None else [free[pair[0]], free[pair[1]]]
                for y in got:
                    free.pop(bisect.bisect_left(free, y))
                b[k : k + 1] = got
                bisect.insort(free, x)
    return free


def mutate(bins: list, limit: int, rng: random.Random) -> list[list[int]]:
    """The worst-filled bins and a few others are opened; their items replace shorter ones elsewhere, and the rest is best-fitted anew."""
    order = sorted(bins, key=sum)
    out = set(range(max(1, len(order) // 20))) | {rng.randrange(len(order)) for _ in range(max(1, len(order) // 20))}
    kept = [list(b) for i, b in enumerate(order) if i not in out]
    rng.shuffle(kept)
    return best_fit(dominate([x for i in out for x in order[i]], kept, limit), kept, limit)


def evolve(items: list[int], limit: int, seed: int, elites: list[Bins], generations: int = GENERATIONS) -> Bins:
    """The best grouping an island finds from its elites, or from best fit on perturbed orders."""
    rng = random.Random(seed)
    people = [[list(b) for b in e] for e in elites]
    while len(people) < POPULATION:
        if not people:
            people.append(best_fit(items, [], limit))
        else:
            people.append(mutate(people[0], limit, rng))
    floor = math.ceil(sum(items) / limit)
    for _ in range(generations):
        people.sort(key=lambda p: (len(p), -fitness(p, limit)))
        if len(people[0]) == floor:
            break
        half = people[: POPULATION // 2]
        people = half + [mutate(crossover(rng.choice(half), rng.choice(half), limit, rng), limit, rng) for _ in range(POPULATION - len(half))]
    best = min(people, key=lambda p: (len(p), -fitness(p, limit)))
    return [tuple(sorted(b, reverse=True)) for b in best]


def islands(spark: SparkSession, items: list[int], limit: int) -> Bins:
    """Rounds of evolution on islands, the elites migrating in a ring between rounds; items are at most a level's."""
    best: list[Bins] = []
    for r in range(ROUNDS):
        mine = [[best[i], best[i - 1]] if best else [] for i in range(ISLANDS)]
        ctx = spark.sparkContext.broadcast((items, mine))

        def live(batches: Iterator[pa.RecordBatch], r: int = r, ctx=ctx) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column(0).to_pylist():
                    found = evolve(ctx.value[0], limit, 1000 * r + i, ctx.value[1][i])
                    yield pa.record_batch([pa.array([i], pa.int64()), pa.array([[list(x) for x in found]], pa.list_(pa.list_(pa.int32())))], names=["i", "bins"])

        got = spark.range(0, ISLANDS, 1, ISLANDS).mapInArrow(live, "i long, bins array<array<int>>").collect()
        best = [[tuple(x) for x in row["bins"]] for row in sorted(got, key=lambda row: row["i"])]
        if min(map(len, best)) <= math.ceil(sum(items) / limit):
            break
    return min(best, key=lambda p: (len(p), -fitness(p, limit)))


def plan(spark: SparkSession, lengths: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, number of such bins) for a histogram of lengths up to limit."""
    left, out = Counter({k: n for k, n in lengths.items() if n and k < limit}), []
    if lengths.get(limit):
        out.append(((limit,), lengths[limit]))
    while left:
        times = max(1, math.ceil(sum(left.values()) / LEVEL_ITEMS))
        items = [k for k, n in left.items() for _ in range(n // times)]
        bins = Counter(islands(spark, items, limit)) if items else Counter()
        if times > 1:
            bins = Counter({b: n for b, n in bins.items() if sum(b) >= FULL * limit})
            if sum(n * len(b) for b, n in bins.items()) * 4 < len(items):  # too little was kept: pack this level as it is
                bins = Counter(islands(spark, items, limit)) if items else Counter({(k,): 1 for k in list(left)[:1]})
                times = times if items else 1
        for b, n in bins.items():
            out.append((b, n * times))
            for k in b:
                left[k] -= n * times
        left = +left
    return out


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: the pieces of a length take its ranges in turn. The number of ranges is bounded by the plan's."""
    rows, at, base = [], Counter(), 0
    for b, n in made:
        offsets: dict[int, list[int]] = {}
        o = 0
        for k in b:
            offsets.setdefault(k, []).append(o)
            o += k
        for k, os_ in offsets.items():
            rows += [(k, at[k] + j * n, n, base, o) for j, o in enumerate(os_)]
            at[k] += n * len(os_)
        base += n
    rows.sort()
    names = ("length", "first", "n", "bin", "offset")
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(names)}


def pack_pieces(spark: SparkSession, pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pieces (a table that is cheap to read again) with sequence_id and offset."""
    full = pieces.where(F.col("length") == limit).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))  # sequences of their own, neither ranked nor shuffled
    pieces = pieces.where(F.col("length") < limit)
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most limit rows
    table = slots(plan(spark, lengths, limit))
    held = spark.sparkContext.broadcast(table)
    # the rank of a piece within its length: prefix sums over 256 hash buckets, then within one
    p = pieces.withColumn("b", F.xxhash64("doc_id", "piece", "ids_crc32").bitwiseAND(255))
    counts = p.groupBy("length", "b").agg(F.count("*").alias("c"))
    counts = counts.select("length", "b", F.coalesce(F.sum("c").over(W.partitionBy("length").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    p = p.join(counts, ["length", "b"])
    p = p.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("length", "b").orderBy("doc_id", "piece", "start")) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        key = t["length"] * (1 << 48) + t["first"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*cols, pa.array(t["bin"][i] + rank - t["first"][i]), pa.array(t["offset"][i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    chosen = p.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return chosen.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").union(full.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


def pack(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack_pieces(spark, written(spark, tokenize(docs, path, limit)), limit)
