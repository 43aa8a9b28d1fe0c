"""Fillers and repetitions in long texts."""

import re
import time

from pyspark.sql import functions as F

from speechloom.operators import disfluency as D


def test_tokens_of_any_white_space(spark):
    texts = ["", "  ", None, "one", " a bc\t d\n", "x  y　z ", "  lead"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "x string").select(D.tokens(F.col("x")).alias("t")).collect()]
    assert [[(t.token, t.start, t.end) for t in ts] for ts in got] == [[(m.group(), *m.span()) for m in re.finditer(r"\S+", t or "")] for t in texts]


def test_repetitions_in_a_long_text_are_not_quadratic(spark):
    """A text of 4,000 words against eight of 500: runs of free words were looked for by a count over all words at each word."""
    words = " ".join(f"w{chr(97 + i % 26)}{i}" for i in range(4000))

    def took(rows: list) -> float:
        d = spark.createDataFrame(rows, "key string, text string").coalesce(1).cache()
        d.count()
        noisy = D.repetition(F.col("text"), F.col("key"), F.lit("hard"), F.expr(D.NO_SPANS))
        began = time.perf_counter()
        d.select(F.sum(F.length(noisy))).collect()
        return time.perf_counter() - began

    keys = range(24)
    split = words.split(" ")
    short = [(str(k), " ".join(split[i : i + 500])) for k in keys for i in range(0, 4000, 500)]
    took(short)
    assert took([(str(k), words) for k in keys]) < 4 * took(short)
