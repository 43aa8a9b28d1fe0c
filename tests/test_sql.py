from pyspark.sql import functions as F

from speechloom import registry, sql
from speechloom.operators import entities as E
from speechloom.operators import record_metrics
from speechloom.sources.views import utterances

SF = "/root/testdata/sf0.001"


def test_sql_text_alone_equals_dataframes(spark):
    sql.register(spark, SF)
    sql.register(spark, SF)
    got = spark.sql("SELECT u.utt_id AS id, s.start, s.end, s.kind, s.raw FROM utterance_spans u, LATERAL entity_spans(u.spans) s").collect()
    want = [r for r in registry.QUERIES["q_entity_spans"](spark, SF).collect() if "-" in r.id]
    assert sorted(map(tuple, got)) == sorted((r.id, r.start, r.end, r.kind, r.raw) for r in want) and got
    got = spark.sql("SELECT utt_id, size(entity_candidates(text)) AS n FROM utterances").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, utterances(spark, SF).select("utt_id", F.size(E.candidates("text"))).collect()))
    r = spark.sql("SELECT entity_canonical('  The  Beach ') AS c, entity_share(array('a', 'b'), array('b')) AS x, entity_share(array(), array('b')) AS y").first()
    assert tuple(r) == ("the beach", 0.5, 1.0)


def test_failure_report_has_all_buckets(spark):
    d = spark.createDataFrame([("verbosity",), ("verbosity",), ("hallucination",), (None,)], "bucket string")
    got = {r.bucket: (r.n, r.share, r.failures, r.failure_rate, r.advice is None) for r in record_metrics.failure_report(d).collect()}
    assert set(got) == set(record_metrics.BUCKETS) and got["verbosity"] == (2, 0.5, 3, 0.75, False) and got["punctuation_only"] == (0, 0.0, 3, 0.75, True)
    none = record_metrics.failure_report(d.limit(0)).collect()
    assert len(none) == 10 and {(r.n, r.records, r.failures, r.failure_rate) for r in none} == {(0, 0, 0, 0.0)}
