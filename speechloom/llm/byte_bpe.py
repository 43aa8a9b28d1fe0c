"""Byte-level BPE: texts to ids and back, with the merges found by segment trees.

A text is cut into pieces as the vocabulary file asks for. A piece is a row of bytes; the leaves of its tree hold the rank of each adjacent pair
together with its place, so that the root is the leftmost pair of lowest rank. That pair becomes one token, three leaves change, and their paths to
the root are renewed, until no pair can be merged. Trees of short pieces of one size are kept as one array and merged side by side; a long piece has a
tree of its own. Many texts are cut together, and each of their different pieces is merged once; a worker remembers so many short pieces,
then begins anew.

Letters, digits and white space are those that the tokenizer's library knows: code points that it takes for something else than the
expression's module does are found on the driver (``kinds``).

Cases: null text is empty and has no tokens; a special token's string in a text becomes its id, the leftmost and longest first; a very long text is
cut where white space follows a word, which changes nothing; ids without a token are refused; a null doc_id is carried; repeated rows each give
the same row; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Sent

#: Pieces of more bytes than this have a tree of their own.
SHORT = 64
#: Pieces up to this size are compared as two numbers, and remembered.
PACKED = 16
#: Pieces that a worker remembers.
REMEMBERED = 400_000
#: Code points of text cut into pieces together, about.
SLICE = 1 << 20

NONE = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The character that stands for each byte in a vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return [table[b] for b in range(256)]


LETTER, NUMBER, BLANK, OTHER = range(4)


def kinds() -> np.ndarray:
    """The kind of every code point by the tokenizer's library. Letters, numbers and blanks are asked for among those of the expression's module."""
    import regex
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, names, before, after in ((LETTER, "\\p{L}", "a", ""), (NUMBER, "\\p{N}", "1", ""), (BLANK, "\\s", "\n", "\n")):
        points = np.array([ord(c) for c in regex.findall(names, every)])
        cuts = {span for _, span in library.pre_tokenize_str("".join(f"!{before}{chr(c)}{after}" for c in points))}
        width = 2 + len(before + after)
        out[points[[(i * width + 1, i * width + 3) in cuts for i in range(len(points))]]] = kind  # one piece holds a neighbour of the kind and the point
    return out


def piece_starts(c: np.ndarray, first: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces start in code points of texts side by side, of which first marks the starts.

    A piece is a run of letters, of numbers or of other signs, with one space before it; what is left of a run of white space, without its last
    character if something follows; or one of ``'s 't 're 've 'm 'll 'd`` where no space or sign stands before.
    """
    n = len(c)
    k = kind[c]
    blank = k == BLANK
    change = first.copy()
    change[1:] |= k[1:] != k[:-1]
    spaced = np.zeros(n, bool)
    spaced[1:] = c[:-1] == 32
    spaced &= ~first
    start = change & (blank | ~spaced)
    start[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:]
    quotes = np.flatnonzero((c == ord("'")) & start)
    if len(quotes):
        follows = np.zeros((len(quotes), 2), np.int64)  # the next two characters of the same text, or 0
        for j in (1, 2):
            ok = quotes + j < n
            ok[ok] &= ~first[quotes[ok] + j]
            if j == 2:
                ok &= follows[:, 0] > 0
            follows[ok, j - 1] = c[quotes[ok] + j]
        short = np.isin(follows[:, 0], [ord(x) for x in "stmd"])
        long = np.zeros(len(quotes), bool)
        for x, y in ("re", "ve", "ll"):
            long |= (follows[:, 0] == ord(x)) & (follows[:, 1] == ord(y))
        start[quotes[short | long] + 1] = False
        ends = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Merges:
    """Ranks of pairs, and the two ways to merge."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.made = pairs[order], order.astype(np.int64), made
        self.table: dict[int, int] | None = None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE where the pair cannot be merged."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def side_by_side(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids, of which the first sizes count; returns (ids, which of them are left). The width is a power of two."""
        m, width = ids.shape
        ids = np.concatenate([ids, np.zeros((m, 1), ids.dtype)], axis=1)
        place = np.arange(width + 1)
        left = place[None, :width] < sizes[:, None]
        after = np.where(place[None, :] + 1 < sizes[:, None], place + 1, width)
        before = np.tile(place - 1, (m, 1))
        tree = np.full((m, 2 * width), NONE)
        pair = place[None, : width - 1] + 1 < sizes[:, None]
        r = np.where(pair, self.rank(ids[:, : width - 1], ids[:, 1:width]), NONE)
        tree[:, width : 2 * width - 1] = np.where(r < NONE, r * width + place[: width - 1], NONE)
        for i in range(width.bit_length() - 2, -1, -1):
            a, b = 2**i, 2 ** (i + 1)
            tree[:, a:b] = np.minimum(tree[:, 2 * a : 2 * b : 2], tree[:, 2 * a + 1 : 2 * b : 2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at = root % width
            gone = after[rows, at]
            then = after[rows, gone]
            ids[rows, at] = self.made[root // width]
            left[rows, gone] = False
            after[rows, at] = then
            before[rows, then] = at  # column width is for what follows the last
            prior = before[rows, at]
            right = np.where(then < width, self.rank(ids[rows, at], ids[rows, then]), NONE)
            back = np.where(prior >= 0, self.rank(ids[rows, prior], ids[rows, at]), NONE)
            tree[rows, width + gone] = NONE
            tree[rows, width + at] = np.where(right < NONE, right * width + at, NONE)
            has = prior >= 0
            tree[rows[has], width + prior[has]] = np.where(back < NONE, back * width + prior, NONE)[has]
            node = np.stack([gone, at, np.where(has, prior, at)]) + width
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] < NONE]
        return ids[:, :width], left

    def alone(self, ids: list[int]) -> list[int]:
        """One row of any length."""
        if self.table is None:
            self.table = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))
        n, table, made, none = len(ids), self.table, self.made, len(self.made)
        width = 1 << max(n - 1, 1).bit_length()
        never = none * width
        tree = [never] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = table.get(ids[i] << 32 | ids[i + 1], none) * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        ids, after, before = [*ids, 0], [*range(1, n + 1), n], list(range(-1, n))

        def put(i: int, key: int) -> None:
            i += width
            tree[i] = key
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] < never:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            then = after[at] = after[gone]
            ids[at] = int(made[rank])
            ids[gone] = -1
            put(gone, never)
            put(at, table.get(ids[at] << 32 | ids[then], none) * width + at if then < n else never)
            if then < n:
                before[then] = at
            if (prior := before[at]) >= 0:
                put(prior, table.get(ids[prior] << 32 | ids[at], none) * width + prior)
        return [i for i in ids[:n] if i >= 0]


class Codec:
    """Ids of texts and texts of ids by one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, pre, added = held["model"], held["pre_tokenizer"], held["added_tokens"]
        plain = held["normalizer"] is None and pre["type"] == held["decoder"]["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        vocab = model["vocab"]
        chars = byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.byte_ids = np.array([vocab[c] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        self.merges = Merges(pairs, np.array([vocab[a + b] for a, b in merges], np.int64))
        self.special = {t["content"]: t["id"] for t in added}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for i, t in names.items()}
        self.kinds = kinds()
        self._ready()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("mark", "cut", "slots", "packed", "sizes", "places", "counts", "flat")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        import regex

        self.mark = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cut = regex.compile("(?<=\\S)\\s")
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}  # a hash of a short piece: its place in the arrays
        self.packed, self.sizes = np.zeros((0, 2), "<u8"), np.zeros(0, np.int64)
        self.places, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def slices(self, text: str) -> Iterator[str]:
        """The text in parts that end before white space that follows a word."""
        at = 0
        while len(text) - at > SLICE:
            found = self.cut.search(text, at + SLICE)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def parts(self, text: str) -> Iterator[str | int]:
        """Ordinary text and ids of special tokens in turn."""
        at = 0
        if self.mark and any(s in text for s in self.special):
            for m in self.mark.finditer(text):
                yield from self.slices(text[at : m.start()])
                yield self.special[m.group()]
                at = m.end()
        yield from self.slices(text[at:] if at else text)

    def _merged(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of rows of bytes in one array, where those of each row start in it, and how many they are."""
        held, places, counts, total = [np.zeros(0, "<u4")], np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), 0
        width = 2
        while width <= rows.shape[1]:
            of = np.flatnonzero((sizes <= width) & ((sizes > width // 2) | (width == 2)))
            for lo in range(0, len(of), 20_000):
                some = of[lo : lo + 20_000]
                ids, left = self.merges.side_by_side(self.byte_ids[rows[some, :width]], sizes[some])
                n = left.sum(axis=1)
                counts[some], places[some] = n, total + np.cumsum(n) - n
                total += int(n.sum())
                held.append(ids[left].astype("<u4"))
            width *= 2
        return np.concatenate(held), places, counts

    def _of_long(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of long pieces, each different one merged once."""
        known: dict[bytes, np.ndarray] = {}
        for p in set(pieces):
            if len(p) > SHORT:
                known[p] = np.array(self.merges.alone(self.byte_ids[np.frombuffer(p, np.uint8)].tolist()), "<u4")
        short = list(set(pieces) - known.keys())
        if short:
            rows = np.frombuffer(b"".join(p.ljust(SHORT, b"\0") for p in short), np.uint8).reshape(len(short), SHORT)
            flat, places, counts = self._merged(rows, np.array([len(p) for p in short]))
            known.update((p, flat[a : a + n]) for p, a, n in zip(short, places.tolist(), counts.tolist(), strict=True))
        return [known[p] for p in pieces]

    def _remembered(self, rows: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each different short piece, and which of them have none since another piece has their hash."""
        packed = rows.view("<u8")
        if len(self.slots) + len(keys) > REMEMBERED:
            self._forget()
        at = np.array([self.slots.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, places, counts = self._merged(rows[new], sizes[new])
            at[new] = len(self.sizes) + np.arange(len(new))
            self.slots.update(zip(keys[new].tolist(), at[new].tolist(), strict=True))
            self.packed, self.sizes = np.concatenate([self.packed, packed[new]]), np.concatenate([self.sizes, sizes[new]])
            self.places = np.concatenate([self.places, len(self.flat) + places])
            self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])
        return at, (self.packed[at] != packed).any(axis=1) | (self.sizes[at] != sizes)

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of stretches of ordinary text."""
        whole = "".join(parts)
        if not whole:
            return [b""] * len(parts)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        c = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        first = np.zeros(len(c), bool)
        first[(ends - lengths)[lengths > 0]] = True
        at = piece_starts(c, first, self.kinds)
        data = whole.encode()
        if len(data) == len(c):
            starts = at
        else:
            wide = 1 + (c > 0x7F).astype(np.int8) + (c > 0x7FF) + (c > 0xFFFF)
            starts = (np.cumsum(wide) - wide)[at]
        sizes = np.diff(starts, append=len(data))
        rows = np.frombuffer(data + b"\0" * PACKED, np.uint8)[starts[:, None] + np.arange(PACKED)]
        rows = rows * (np.arange(PACKED) < sizes[:, None])
        packed = rows.view("<u8")
        h = (packed[:, 0] ^ sizes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32)) ^ packed[:, 1]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        short = np.flatnonzero(sizes <= PACKED)
        counts, places = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        extra: list[np.ndarray] = []
        odd = np.flatnonzero(sizes > PACKED)
        if len(short):
            keys, one, inverse = np.unique(h[short], return_index=True, return_inverse=True)
            one = short[one]
            slot, clash = self._remembered(rows[one], sizes[one], keys)
            same = ~clash[inverse] & (packed[short] == packed[one][inverse]).all(axis=1) & (sizes[short] == sizes[one][inverse])
            counts[short], places[short] = self.counts[slot][inverse], self.places[slot][inverse]
            odd = np.concatenate([odd, short[~same]])  # pieces of one hash that differ are treated as long ones
        flat = self.flat
        if len(odd):
            ids = self._of_long([data[a : a + z] for a, z in zip(starts[odd].tolist(), sizes[odd].tolist(), strict=True)])
            counts[odd] = [len(i) for i in ids]
            places[odd] = len(flat) + np.cumsum(counts[odd]) - counts[odd]
            flat = np.concatenate([flat, *ids])
        after = np.cumsum(counts)
        ids = flat[np.repeat(places - (after - counts), counts) + np.arange(after[-1])].tobytes()
        bounds = np.concatenate([[0], after])[np.searchsorted(at, np.concatenate([[0], ends]))]
        return [ids[4 * a : 4 * z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, str]] = []
        size = 0

        def finish() -> None:
            for (i, _), ids in zip(waiting, self._of_parts([p for _, p in waiting]), strict=True):
                out[i].append(ids)
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text or ""):
                if isinstance(part, int):
                    finish()
                    size = 0
                    out[i].append(part.to_bytes(4, "little"))
                else:
                    waiting.append((i, part))
                    size += len(part)
                if size > SLICE:
                    finish()
                    size = 0
        finish()
        return [b"".join(o) for o in out]

    def decode(self, ids: bytes | None) -> str | None:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if ids is None:
            return None
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _held(sent: Sent, path: str) -> Codec:
    """The codec stays in the Python worker from task to task, with what it remembers."""
    holder = sys.modules.setdefault("_loom_worker", types.ModuleType("_loom_worker")).__dict__
    if ("bpe", path) not in holder:
        holder["bpe", path] = sent.value
    return holder["bpe", path]


def encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian 32-bit numbers) of every row's text, with special tokens' strings as their ids."""
    sent = Sent(spark, Codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _held(sent, path)
        for batch in batches:
            ids = codec.encode(batch["text"].to_pylist())
            yield pa.record_batch([batch["doc_id"], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encoded with text, what their ids stand for."""
    sent = Sent(spark, Codec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _held(sent, path)
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array([codec.decode(i) for i in batch["ids"].to_pylist()], pa.string())], names=[*batch.schema.names, "text"])

    kept = encoded.drop("text")
    return kept.mapInArrow(run, kept.select("*", F.lit("").alias("text")).schema)
