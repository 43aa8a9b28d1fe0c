"""Personal data by bootstrapped contextual extraction.

Seed entities (the base expressions, the shapes of well-known keys and the values of well-known credential fields) induce lexical patterns: the
field name, the two words to the left, the words on either side, or how a key begins, each with the form of what they hold.
Spark counts, over the whole corpus, which pattern holds which instance, and scores the graph in turns: a pattern by the share of known
instances among those it holds, an instance by its best pattern. What a pattern above the threshold holds is an identifier, known or not;
a seed that is not a base entity is marked only where such a pattern holds it too.

Cases: null text is empty; offsets count code points, ends are exclusive; spans of the method never replace base spans and
never overlap them; repeated rows are scanned alike and count as often as they occur; an empty table gives no rows and no
patterns; ties need no order since a pattern's score decides alone; a very long text is scanned whole, in time that grows with its
length; other columns play no part, a column that clashes included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Table, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern marks what it holds if its score and the different known instances it holds reach these.
MIN_SCORE = 0.6
MIN_SUPPORT = 2
#: And if its known instances are at least this share of all: with three patterns an instance, 3,000,000 patterns of 8 bytes at most are broadcast.
MIN_SHARE = 1e-6
#: An instance is worth so much of its best pattern's score; an unknown secret-like one counts so much against a pattern, others 1.
DECAY, DOUBT = 0.9, 0.1

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Shapes of keys, and names of fields, that seed the bootstrap beside the base expressions.
_SEED_KEY = re.compile(r"\A(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40})\Z")
_SEED_FIELD = re.compile(r"(?:\A|[._-])(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)\Z")
#: Where an identifier may lie: at a digit, or after a field's sign.
_HINT = re.compile(r"[0-9]|[=:] {0,2}[\"'`]?")
_STOP = " \t\n\r\x0b\x0c\"'`,;(){}[]<>="
_REST = re.compile(r"[^\s\"'`,;(){}\[\]<>=]*")
_FIELD = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]{1,30}) {0,2}([=:])\s{0,2}[\"'`(]?\Z")
_INNER = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]{1,30}:(?=.{5})")
_LEFT = re.compile(r"([^\W\d_]{2,30})?\W{1,3}([^\W\d_]{2,30})\W{0,3}\Z")
_RIGHT = re.compile(r"\W{0,3}([^\W\d_]{2,30})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if start < at:
                found["email"].append((start, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found["phone"].append(m.span())
    return found


def form(token: str) -> str:
    """What a token is made of: num (7 or more digits, with signs), hex (16 or more), mix and sym (letters with digits, 12 or 8 and more, with signs); else plain."""
    digits = sum(c.isdigit() for c in token)
    if not any(c.isalpha() for c in token):
        return "num" if digits >= 7 else "plain"
    if not digits:
        return "plain"
    if token.isalnum():
        return "hex" if len(token) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token) else "mix" if len(token) >= 12 else "plain"
    return "sym" if len(token) >= 8 else "plain"


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int, str, bool, list[str]]]:
    """(start, end, form, seed, patterns) of every base entity and of every token that has a digit or is a field's value."""
    taken = sorted((a, b, k) for k, spans in base.items() for a, b in spans)
    for a, b, k in taken:
        yield a, b, "mail" if k == "email" else "num", True, patterns(text, a, b, "mail" if k == "email" else "num")
    last, at = 0, 0
    for m in _HINT.finditer(text):
        if m.start() < last:
            continue
        a = m.end()
        if m.group()[0] not in "=:":
            a -= 1
            while a > last and text[a - 1] not in _STOP:
                a -= 1
        elif m.group()[0] == ":" and m.end() < len(text) and text[m.end()].isspace():
            continue
        last = max(_REST.match(text, a).end(), m.end())
        if f := _INNER.match(text, a, last):
            a = f.end()
        b = a + len(text[a:last].rstrip(".!?:"))
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if b - a < 5 or any(x < b and a < y for x, y, _ in taken[at : at + 8]):
            continue
        kind, found = form(text[a:b]), _FIELD.search(text, max(0, a - 40), a)
        seed = kind != "plain" and bool(_SEED_KEY.match(text[a:b]) or (found and _SEED_FIELD.search(found.group(1).lower())))
        yield a, b, kind, seed, patterns(text, a, b, kind)


def patterns(text: str, a: int, b: int, kind: str) -> list[str]:
    """The lexical patterns that hold text[a:b]: three at most."""
    secret = kind in ("hex", "mix", "sym")
    if f := _FIELD.search(text, max(0, a - 40), a):
        return [f"field|{f.group(1).lower()}{f.group(2)}|{kind}", *([f"field|{f.group(2)}|{kind}"] if secret else [])]
    out = []
    if secret and text[a:b].isalnum():
        out.append(f"head|{text[a : a + 4]}|{kind}{b - a}")
    left, right = _LEFT.search(text, max(0, a - 70), a), _RIGHT.match(text, b)
    if left and left.group(1):
        out.append(f"left|{left.group(1).lower()} {left.group(2).lower()}|{kind}")
    if left and right:
        out.append(f"both|{left.group(2).lower()} {right.group(1).lower()}|{kind}")
    return out


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def may_hold(text: str | None) -> bool:
    return bool(text) and ("@" in text or _HINT.search(text) is not None)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, item, seed, doubt, n): counts within a batch of which pattern holds which instance."""
    for b in batches:
        n: Counter = Counter()
        for text in b.column(0).to_pylist():
            if may_hold(text):
                for s, e, kind, seed, held in candidates(text, base_spans(text)):
                    item = _key(text[s:e])
                    n.update((_key(p), item, seed, 1.0 if seed or kind in ("num", "plain", "mail") else DOUBT) for p in held)
        rows = [(*k, v) for k, v in n.items()]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=["pattern", "item", "seed", "doubt", "n"])


def learn_patterns(spark: SparkSession, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern (its 64-bit key), score, support of the patterns that mark, scored over the pattern-instance graph.

    A pattern's score is the sum of its instances' scores over the sum of their weights, each as often as it occurs; a seed is worth 1, another instance DECAY times the
    best score of its patterns, if that reaches MIN_SCORE. Sums and maxima by key are aggregated where rows are read, so a hot pattern is.
    """
    seen = docs.select(F.col("text").cast("string")).mapInArrow(_gather, "pattern long, item long, seed boolean, doubt double, n long")
    edges = written(spark, seen.groupBy("pattern", "item").agg(F.max("seed").alias("seed"), F.max("doubt").alias("doubt"), F.sum("n").alias("n")))
    least = max(MIN_SUPPORT, (edges.where("seed").agg(F.count("*")).first()[0]) * MIN_SHARE)
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    old: list[Table] = []
    for turn in range(rounds):
        weight = F.greatest(F.col("score"), F.col("doubt"))
        rated = Table(spark, scored.groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / F.sum(weight * F.col("n"))).alias("rate"), F.sum((F.col("score") > 0).cast("long")).alias("support")).where((F.col("support") >= least) & (F.col("rate") >= MIN_SCORE)))
        for t in old:
            t.drop()
        old = [rated]
        if turn < rounds - 1:
            best = edges.join(rated.df.hint("merge"), "pattern").groupBy("item").agg(F.max("rate").alias("best"))  # most patterns are gone by now
            items = Table(spark, best)
            old.append(items)
            scored = edges.join(items.df.hint("merge"), "item", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce(DECAY * F.col("best"), F.lit(0.0))))
    return rated.df.select("pattern", F.col("rate").alias("score"), "support")


def _known(spark: SparkSession, found: DataFrame):
    """The patterns' keys, sorted, on every executor: at most 3 / MIN_SHARE of 8 bytes."""
    return spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in found.select("pattern").collect()], np.int64)))


def _marked(text: str, base: dict[str, list[tuple[int, int]]], known: np.ndarray) -> list[tuple[int, int]]:
    """Spans that a known pattern holds, beside the base spans."""
    if not len(known):
        return []
    taken = {s for spans in base.values() for s in spans}
    out = []
    for a, b, _, _, held in candidates(text, base):
        if (a, b) not in taken and held:
            keys = np.array([_key(p) for p in held], np.int64)
            if (known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys).any():
                out.append((a, b))
    return sorted(out)


def find(spark: SparkSession, docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, text, kinds, starts, ends of all spans by kind (base kinds as listed, then "id") and start; n_<kind> of the base."""
    known = _known(spark, learn_patterns(spark, docs) if found is None else found)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                text = text or ""
                if not may_hold(text):
                    rows.append(([], [], [], 0, 0, 0, 0))
                    continue
                base = base_spans(text)
                spans = [(k, x, y) for k in KINDS for x, y in base[k]]
                spans += [("id", x, y) for x, y in _marked(text, base, known.value)]
                rows.append(([s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], *(len(base[k]) for k in KINDS)))
            types = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), *made], names=["doc_id", "text", "kinds", "starts", "ends", "n_email", "n_ip", "n_card", "n_phone"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mark, "doc_id long, text string, kinds array<string>, starts array<long>, ends array<long>, n_email long, n_ip long, n_card long, n_phone long")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs in its columns with every span replaced by <KIND>; n_chars, if there, follows."""
    known = _known(spark, learn_patterns(spark, docs))
    at, lengths = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def hide(text: str | None) -> str | None:
        if not may_hold(text):
            return text
        base = base_spans(text)
        spans = sorted([(a, b, k) for k in KINDS for a, b in base[k]] + [(a, b, "id") for a, b in _marked(text, base, known.value)])
        out, last = [], 0
        for a, b, k in spans:
            if b <= last:
                continue
            out += [text[last : max(a, last)], f"<{k.upper()}>"]
            last = b
        return "".join([*out, text[last:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            new = [hide(t) for t in cols[at].to_pylist()]
            cols[at] = pa.array(new, pa.string())
            if lengths is not None:
                cols[lengths] = pa.array([None if t is None else len(t) for t in new], pa.int64())
            yield pa.record_batch(cols, names=b.schema.names)

    typed = docs.select(*[F.col(c).cast({"text": "string", "n_chars": "long"}.get(c, docs.schema[c].dataType)).alias(c) for c in docs.columns])
    return typed.mapInArrow(run, typed.schema)
