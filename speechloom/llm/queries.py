"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, fill_middle, language_id, mixing, packing, passages, periodic_runs, pii, quality_rules, resample, simhash_dedup, toxicity
from .storage import WORD_RE, small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file; op2's contract names this one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(spark, table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(spark, table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judge(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents")).drop("spans")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find(spark, table(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"]))
    base = F.filter(F.col("spans"), lambda x: ~x.startswith("id:"))
    d = d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", spans.alias("spans"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_middle.transform(spark, table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    d = periodic_runs.runs(d).withColumn("best", periodic_runs.longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text that op12's contract asks for: a tenth of the documents, by a hash of their ids, repeat some of their words to the end."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        repeat = lambda w, n, a, p: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")
        bound = F.transform(F.array(F.struct(w.alias("w"), n.alias("n"), a.alias("a"), p.alias("p"))), lambda v: repeat(v["w"], v["n"], v["a"], v["p"]))
        return F.when(F.size(w) > 0, F.element_at(bound, 1)).otherwise(text)

    words = F.array(F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0)))  # bound once: the lambda would split the text for every word
    return F.when((h % 10 == 0) & text.isNotNull(), F.element_at(F.transform(words, planted), 1)).otherwise(text)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    d = byte_bpe.decode(spark, byte_bpe.encode(spark, table(spark, sf_dir, "documents"), path), path)
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mixing, op2_packing, op3_passages, op4_quality_rules, op5_embedding_dedup, op6_toxicity, op7_resample, op8_language_id, op9_simhash, op10_pii, op11_fill_middle, op12_periodic_runs, op13_byte_bpe, pipeline)}

_WORDS = "list_filter(regexp_split_to_array({t}, '[ \\t-\\r]+'), lambda x: x <> '')"
_TIGHT = "regexp_replace({t}, '[ \\t-\\r]+', '', 'g')"
_GONE = "length({t}) - length(translate({t}, '{c}', ''))"
_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in quality_rules.BOILERPLATE)
_FAILS = (
    f"({_PHRASES} OR contains(x, '©') OR ({_GONE.format(t='x', c='|»›•')} >= 2 AND ({_GONE.format(t='x', c='|»›•')}) * 4 >= len({_WORDS.format(t='x').replace('lambda x: x', 'lambda y: y')}))"
    f" OR (length({_TIGHT.format(t='x')}) >= 10 AND ({_GONE.format(t='x', c='#*$%&|<>')}) * 10 > length({_TIGHT.format(t='x')}))"
    f" OR (len({_WORDS.format(t='x').replace('lambda x: x', 'lambda y: y')}) >= 5 AND {_GONE.format(t='x', c='!')} >= len({_WORDS.format(t='x').replace('lambda x: x', 'lambda y: y')})))"
)
_NO_SENTENCE = (
    f"(length(x) <= {quality_rules.SHORT_CHARS} AND len({_WORDS.format(t='x').replace('lambda x: x', 'lambda y: y')}) <= {quality_rules.SHORT_WORDS}"
    f" AND NOT regexp_matches(x, '{quality_rules.SENTENCE_END.replace(chr(39), chr(39) * 2)}'))"
)
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": (
        f"WITH d AS (SELECT doc_id, text, {_WORDS.format(t='text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),"
        " win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)), dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),"
        " cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),"
        f" c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_GONE.format(t='text', c='#*$%&|<>')} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,"
        f" coalesce(list_sum(list_transform(list_filter(ls, lambda x: regexp_matches(x, '\\pL') AND NOT {_NO_SENTENCE} AND NOT {_FAILS}), lambda x: length({_TIGHT.format(t='x')}))), 0) AS remaining FROM d LEFT JOIN cov USING (doc_id)),"
        f" b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c)"
        f" SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND remaining >= {quality_rules.MIN_KEPT_SHARE} * word_chars AS kept FROM b"
    ),
    "op5_embedding_dedup": (
        "WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),"
        f" l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.MIN_COSINE}),"
        " reach AS (SELECT vec_id AS v, vec_id AS r FROM v UNION SELECT reach.v, l.b FROM reach JOIN l ON reach.r = l.a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)"
        " SELECT vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(r) AS component_id, vec_id = min(r) AS kept FROM v JOIN reach ON v.vec_id = reach.v LEFT JOIN n ON n.a = vec_id GROUP BY vec_id"
    ),
    "op11_fill_middle": (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),"
        " a AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),"
        " b AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:n], '') AS s,"
        " CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM a)"
        " SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,"
        " sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM b"
    ),
}
