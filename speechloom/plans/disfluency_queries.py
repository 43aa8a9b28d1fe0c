"""Queries over fillers and repetitions with protected spans; words of nine letters stand for entities, which SQL can find too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import FILLERS
from ..operators import disfluency as D
from ..registry import query
from ..sources.views import SQL, sql_draw, utterances
from .template_queries import quoted

LEVELS = ("easy", "medium", "hard")
LONG = "[A-Za-z]{9}"


def _count(site: str, bounds: dict) -> str:
    return "CASE level " + " ".join(f"WHEN '{k}' THEN {sql_draw('key', site)} % {hi - lo + 1} + {lo}" for k, (lo, hi) in bounds.items()) + " END"


_TOKENS = (
    f"{SQL['utt']}, base AS (SELECT utt_id AS key, text, {quoted(LEVELS)}[1 + {sql_draw('utt_id', 'level')} % 3] AS level, regexp_extract_all(text, '\\s*\\S+') AS ps FROM utt),"
    " ends AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x)))::INT) AS es, list_transform(ps, lambda p: ltrim(p)) AS ts FROM base),"
    f" tok AS (SELECT *, len(ps) AS n, list_transform(range(1, len(ps) + 1), lambda i: es[i] - length(ts[i])) AS ss, list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(ts[i], '{LONG}')) AS held FROM ends)"
)
_WORD = "regexp_matches(ts[{i}], '^[\\p{{L}}\\p{{N}}]')"


def protected(toks: Column) -> Column:
    return F.transform(F.filter(toks, lambda t: t["token"].rlike(LONG)), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = utterances(spark, sf_dir)
    return u.select("utt_id", "text", T.pick(F.col("utt_id"), "level", LEVELS).alias("level"))


def _noisy(change: Callable[..., Column]) -> Column:
    """A text changed outside its protected words; its tokens are found once."""
    c = F.col
    return T.let(D.tokens(c("text")), lambda toks: change(c("text"), c("utt_id"), c("level"), protected(toks), toks=toks))


@query(f"WITH {_TOKENS} SELECT key AS utt_id, unnest(range(n))::INT AS place, unnest(ts) AS token, unnest(ss)::INT AS start, unnest(es)::INT AS \"end\" FROM tok")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = utterances(spark, sf_dir).select("utt_id", F.posexplode(D.tokens(F.col("text"))).alias("place", "t"))
    return d.select("utt_id", "place", "t.token", "t.start", "t.end")


@query(
    f"WITH {_TOKENS}, g AS (SELECT *, list_filter(range(1, n), lambda i: {_WORD.format(i='i + 1')} AND len(list_filter(held, lambda h: es[i] >= ss[h] AND ss[i + 1] <= es[h])) = 0) AS gaps FROM tok),"
    f" f AS (SELECT *, list_transform(list_sort(list_transform({quoted(FILLERS)}, lambda w: {{'h': md5('42:' || key || ':fill.word:' || w), 'w': w}})), lambda x: x.w)[1:{_count('fill.n', D.FILLER_COUNTS)}] AS said,"
    " list_transform(list_sort(list_transform(gaps, lambda i: {'h': md5('42:' || key || ':fill.gap:' || (i - 1)), 'i': i})), lambda x: x.i) AS chosen FROM g), c AS (SELECT *, chosen[1:len(said)] AS put FROM f)"
    " SELECT key AS utt_id, CASE WHEN len(gaps) > 0 THEN array_to_string(list_transform(range(1, n + 1), lambda i: ps[i] || CASE WHEN list_contains(put, i) THEN ', ' || said[list_position(put, i)] || ',' ELSE '' END), '')"
    " ELSE upper(said[1][1]) || lower(said[1][2:]) || ', ' || lower(text[1]) || text[2:] END AS noisy FROM c"
)
def q_protected_filler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four fillers by difficulty, none next to or within a protected word."""
    return _rows(spark, sf_dir).select("utt_id", _noisy(D.filler).alias("noisy"))


def _sql_pick(i: int) -> str:
    """The i-th pick from words (free and not in use), as first, k, form."""
    n = "(len({c}))"
    draw = f"('0x' || substr(md5('42:' || key || ':rep.at:{i}'), 1, 15))::BIGINT"
    form = f"(('0x' || substr(md5('42:' || key || ':rep.form:{i}'), 1, 15))::BIGINT % 100)"
    runs = lambda k, upto, name: f"list_transform(list_filter(ws, lambda x: x - 1 + {k} <= {upto} AND len(list_filter(ws, lambda y: y >= x AND y < x + {k})) = {k}), lambda x: {{'first': x, 'k': {k}, 'form': '{name}'}})"
    at = lambda c: f"({c})[1 + {draw} % {n.format(c=c)}]"
    word = at("list_transform(ws, lambda x: {'first': x, 'k': 1, 'form': 'word'})")
    return (
        f"c{i} AS (SELECT *, list_filter(free, lambda x: NOT list_contains(used, x)) AS ws FROM s{i}), d{i} AS (SELECT *, list_concat({runs(3, 'n', 'phrase')}, {runs(2, 'n', 'phrase')}) AS phrases, list_concat({runs(4, 'n - 2', 'clause')}, list_concat({runs(3, 'n - 2', 'clause')}, {runs(2, 'n - 2', 'clause')})) AS clauses,"
        f" list_transform(list_filter(ws, lambda x: length(ts[x]) >= 4 AND regexp_full_match(ts[x], '\\p{{L}}+')), lambda x: {{'first': x, 'k': 1, 'form': 'stutter'}}) AS parts FROM c{i}),"
        f" e{i} AS (SELECT *, CASE WHEN len(ws) = 0 OR {i} >= reps THEN NULL WHEN {form} < 40 OR len(ws) < 2 THEN {word} WHEN {form} < 65 AND n >= 4 THEN CASE WHEN len(phrases) > 0 THEN {at('phrases')} ELSE {word} END"
        f" WHEN {form} < 85 THEN CASE WHEN len(parts) > 0 THEN {at('parts')} ELSE {word} END WHEN n >= 6 AND len(clauses) > 0 THEN {at('clauses')} ELSE {word} END AS p FROM d{i}),"
        f" s{i + 1} AS (SELECT * EXCLUDE (ws, phrases, clauses, parts, p) REPLACE (CASE WHEN p IS NULL THEN used ELSE list_concat(used, range(p.first, p.first + p.k)) END AS used, CASE WHEN p IS NULL THEN got ELSE list_append(got, p) END AS got) FROM e{i})"
    )


_OWN = "array_to_string(ts[p.first:p.first + p.k - 1], ' ')"
_PART = "('0x' || substr(md5('42:' || key || ':rep.part:' || (p.first - 1)), 1, 15))::BIGINT % 2 + 1"


@query(
    f"WITH {_TOKENS}, s0 AS (SELECT key, text, level, ps, ts, ss, es, n, list_filter(range(1, n + 1), lambda i: {_WORD.format(i='i')} AND len(list_filter(held, lambda h: ss[i] < es[h] AND es[i] > ss[h])) = 0) AS free, []::BIGINT[] AS used,"
    f" []::STRUCT(first BIGINT, k INT, form VARCHAR)[] AS got, {_count('rep.n', D.REPEAT_COUNTS)} AS reps FROM tok), {', '.join(_sql_pick(i) for i in range(3))}, picked AS (SELECT *, CASE WHEN len(got) = 0 THEN [{{'first': 1, 'k': 1, 'form': 'word'}}] ELSE got END AS all_got FROM s3)"
    f" SELECT key AS utt_id, array_to_string(list_transform(range(1, n + 1), lambda i: CASE WHEN len(list_filter(all_got, lambda p: i > p.first AND i < p.first + p.k)) > 0 THEN '' ELSE coalesce(list_transform(list_filter(all_got, lambda p: p.first = i),"
    f" lambda p: ps[i][1:length(ps[i]) - length(ts[i])] || CASE p.form WHEN 'stutter' THEN {_OWN}[1:{_PART}] || '-' || {_OWN} WHEN 'clause' THEN {_OWN} || ', ' || {_OWN} ELSE {_OWN} || ' ' || {_OWN} END)[1], ps[i]) END), '') AS noisy FROM picked"
)
def q_protected_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three repeated words, phrases, stutters or clauses, none of a protected word."""
    return _rows(spark, sf_dir).select("utt_id", _noisy(D.repetition).alias("noisy"))
