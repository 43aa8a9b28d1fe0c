"""Queries over made values, their variants, formatting commands, corrections of extracted entities and near duplicates by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup
from ..operators import entities as E
from ..operators import values as V
from ..registry import query
from ..sources.views import SQL, predictions, sql_draw, table, utterances


def _d(site: str) -> str:
    return sql_draw("doc_id", site)


def _l(values: tuple) -> str:
    return "[" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _p(site: str, values: tuple) -> str:
    return f"{_l(values)}[1 + {_d(site)} % {len(values)}]"


def _u(site: str) -> str:
    return f"({_d(site)} / pow(2, 60))"


def _nth(n: str) -> str:
    return f"({n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"


def _from(items: str, site: str) -> str:
    return f"({items})[1 + {_d(site)} % len({items})]"


def _other(values: tuple, raw: str, site: str) -> str:
    return _from(f"list_filter({_l(values)}, lambda x: lower(x) <> lower({raw}))", site)


def _sql_made() -> dict[str, str]:
    def b(kind: str, part: str, n: int) -> str:
        return f"({_d(f'make.{kind}.{part}')} % {n})"

    u = {k: _u(f"make.{k}.form") for k in V.MADE}
    p = lambda kind, part, values: _p(f"make.{kind}.{part}", values)
    h, day, n = f"({b('time', 'h', 12)} + 1)", p("date", "d", E.DAYS), f"({b('date', 'n', 28)} + 1)"
    return {
        "number": f"CASE WHEN {u['number']} < 0.65 THEN ({b('number', 'n', 999)} + 1)::VARCHAR ELSE {p('number', 'w', E.NUMBER_WORDS)} END",
        "price": f"'$' || ({b('price', 'n', 99)} + 1) || '.' || lpad({b('price', 'c', 100)}::VARCHAR, 2, '0')",
        "percent": f"({b('percent', 'n', 91)} + 5) || ' percent'",
        "version": f"({b('version', 'a', 9)} + 1) || '.' || {b('version', 'b', 10)} || '.' || {b('version', 'c', 10)}",
        "duration": f"{p('duration', 'n', V.DURATIONS)} || ' minutes'",
        "port": f"CASE WHEN {u['port']} < 0.8 THEN {p('port', 'p', V.PORTS)} ELSE ({b('port', 'n', 64512)} + 1024)::VARCHAR END",
        "id": f"CASE WHEN {u['id']} < 0.7 THEN {b('id', 'n', 9000)} + 1000 ELSE {b('id', 'm', 90000)} + 10000 END::VARCHAR",
        "time": f"CASE WHEN {u['time']} < 0.25 THEN {h} || ' ' || {p('time', 'm', ('AM', 'PM'))} WHEN {u['time']} < 0.5 THEN {h} || ':' || {p('time', 'q', V.QUARTERS)} || ' ' || {p('time', 'm', ('AM', 'PM'))}"
        f" WHEN {u['time']} < 0.7 THEN 'half past ' || ({b('time', 'e', 11)} + 1) WHEN {u['time']} < 0.85 THEN {p('time', 'to', ('quarter past ', 'quarter to '))} || {h} WHEN {u['time']} < 0.95 THEN {h} || ' o''clock' ELSE {p('time', 'n', ('noon', 'midnight'))} END",
        "date": f"CASE WHEN {u['date']} < 0.35 THEN {day} WHEN {u['date']} < 0.5 THEN 'next ' || {day} WHEN {u['date']} < 0.85 THEN {p('date', 'mo', E.MONTHS)} || ' ' || CASE WHEN {_u('make.date.ord')} < 0.6 THEN {_nth(n)} ELSE {n}::VARCHAR END ELSE {day} || ' ' || {p('date', 'part', E.PARTS)} END",
        "name": f"{p('name', 'v', E.NAMES)} || CASE WHEN {u['name']} < 0.3 THEN ' ' || {p('name', 'last', V.SURNAMES)} ELSE '' END",
    } | {k: p(k, "v", V.POOLS[k]) for k in ("item", "location", "tech")}


_MADE = _sql_made()
_MADE_SQL = "made AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {s} AS value FROM documents" for k, s in _MADE.items()) + ")"


@query(f"WITH {_MADE_SQL} SELECT * FROM made")
def q_made_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of every kind for every document."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    return d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), V.made(x, k).alias("value")) for x in V.MADE])).alias("v")).select("doc_id", "v.*")


def _sql_others() -> str:
    def index(at: str, n: int, site: str) -> str:
        return f"(({at} + 1 + {_d(site)} % {n - 1}) % {n})"

    whole = f"CASE WHEN n < 1000 THEN {_from(f'list_filter(list_transform({_l(V.NEAR_STEPS)}, lambda s: n + s), lambda x: x BETWEEN 1 AND 999)', 'other.whole')} ELSE {_from(f'list_filter(list_transform({_l(V.FAR_STEPS)}, lambda s: n + s), lambda x: x BETWEEN 1000 AND 99999)', 'other.whole')} END"
    price, clock = index("((a - 1) * 100 + c)", 9900, "other.price"), index("((a - 1) * 4 + c // 15)", 48, "other.clock")
    hour = f"({index('(h - 1)', 12, 'other.hour')} + 1)"
    said = lambda m: f"CASE WHEN value ~ '.*[a-z]$' THEN {_nth(m)} ELSE {m}::VARCHAR END"
    same, anew, first, second = f"({index('(n - 1)', 28, 'other.n')} + 1)", f"({_d('other.n')} % 28 + 1)", "split_part(value, ' ', 1)", "split_part(value, ' ', 2)"
    days = "(" + "|".join(E.DAYS) + ")"
    day = lambda raw: _other(E.DAYS, raw, "other.day")
    date = (
        f"CASE WHEN regexp_full_match(value, '{days}') THEN CASE WHEN {_u('other.rel')} < 0.3 THEN {_p('other.relative', E.RELATIVE)} ELSE {day('value')} END WHEN value LIKE 'next %' THEN 'Next ' || {day(second)}"
        f" WHEN {first} IN {E.DAYS!r} THEN {day(first)} || ' ' || upper({second}[1]) || {second}[2:] WHEN {_u('other.same')} < 0.6 THEN {first} || ' ' || {said(same)} ELSE {_other(E.MONTHS, first, 'other.month')} || ' ' || {said(anew)} END"
    )
    time = (
        f"CASE WHEN value = 'noon' THEN 'midnight' WHEN value = 'midnight' THEN 'noon' WHEN contains(value, ':') THEN ({clock} // 4 + 1) || ':' || {_l(V.QUARTERS)}[1 + {clock} % 4] || right(value, 3)"
        f" WHEN value LIKE '% %M' THEN {hour} || right(value, 3) WHEN value LIKE '%clock' THEN {hour} || ' o''clock' ELSE regexp_extract(value, '^[a-z ]+') || {hour} END"
    )
    number = (
        f"CASE kind WHEN 'price' THEN '$' || ({price} // 100 + 1) || '.' || lpad(({price} % 100)::VARCHAR, 2, '0') WHEN 'percent' THEN ({index('(h - 5)', 91, 'other.percent')} + 5) || ' percent'"
        f" WHEN 'version' THEN value[:-2] || ((right(value, 1)::INT + {_p('other.step', V.STEPS)} + 10) % 10) ELSE CASE WHEN n IS NULL THEN {_other(E.NUMBER_WORDS, 'value', 'other.word')} ELSE ({whole})::VARCHAR END END"
    )
    pools = " ".join(f"WHEN '{k}' THEN {_other(V.POOLS[k], 'value', f'other.{k}')}" for k in ("item", "location", "tech"))
    return f"CASE kind {pools} WHEN 'name' THEN {_other(E.NAMES, first, 'other.name')} || value[length({first}) + 1:] WHEN 'time' THEN {time} WHEN 'date' THEN {date} ELSE {number} END"


@query(
    f"WITH {_MADE_SQL}, parts AS (SELECT doc_id, kind, value, CASE kind WHEN 'date' THEN TRY_CAST(regexp_extract(value, '[0-9]+') AS BIGINT) ELSE TRY_CAST(value AS BIGINT) END AS n, TRY_CAST(regexp_extract(value, '[0-9]+') AS BIGINT) AS h,"
    " TRY_CAST(regexp_extract(value, '([0-9]+)[.:]', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(value, '[.:]([0-9]+)', 1) AS BIGINT) AS c FROM made WHERE kind <> 'duration')"
    f" SELECT doc_id, kind, value, {_sql_others()} AS other FROM parts"
)
def q_other_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another value of the same kind for every made one; durations are no entities of their own."""
    number = F.col("kind").isin("number", "price", "percent", "version", "port", "id")
    m = q_made_values(spark, sf_dir).where("kind <> 'duration'")
    return m.select("doc_id", "kind", "value", V.other_value(F.when(number, "number").otherwise(F.col("kind")), F.col("value"), F.col("doc_id").cast("string")).alias("other"))


def _filled(t: str) -> str:
    for k in ("date", "time", "name", "location", "item"):
        t = f"replace({t}, '{{{k}}}', {_MADE[k]})"
    return t


_GERUND = "CASE split_part(base, ' ', 1) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.GERUNDS) + " END || substr(base, length(split_part(base, ' ', 1)) + 1)"


@query(
    f"WITH f AS (SELECT doc_id, {_u('fmt.type')} AS u, {_u('fmt.numbers')} AS v, list_transform(list_sort([{', '.join(f'''{{'h': md5('42:' || doc_id || ':fmt.item:{i}'), 'v': '{x}'}}''' for i, x in enumerate(E.ITEMS))}]), lambda s: s.v)[1:2 + {_d('fmt.n')} % 5] AS items,"
    f" {_filled(_p('fmt.topic', V.TOPICS))} AS topic, {_filled(_p('fmt.request', V.REQUESTS))} AS request, {_p('fmt.wrap', V.WRAPPERS)} AS wrap FROM documents),"
    " g AS (SELECT *, lower(request[1]) || request[2:-2] AS base, list_transform(items, lambda x: upper(x[1]) || x[2:]) AS titled FROM f)"
    f" SELECT doc_id, CASE WHEN u < 0.45 THEN 'bullet_list' WHEN u < 0.7 THEN 'heading' ELSE 'polite_message' END AS type,"
    f" CASE WHEN u < 0.45 THEN replace({_p('fmt.bullets', V.BULLETS)}, '{{x}}', array_to_string(items[:-2], ', ') || ' and ' || items[-1]) WHEN u < 0.7 THEN replace({_p('fmt.titles', V.TITLES)}, '{{x}}', topic) ELSE replace({_p('fmt.polite', V.POLITE)}, '{{x}}', request) END AS input,"
    " CASE WHEN u < 0.45 THEN array_to_string(list_transform(titled, lambda x, i: CASE WHEN v < 0.25 THEN i || '. ' ELSE '- ' END || x), chr(10)) WHEN u < 0.7 THEN '# ' || upper(topic[1]) || topic[2:]"
    f" ELSE replace(replace(wrap, '{{base}}', base), '{{gerund}}', {_GERUND}) END AS output, CASE WHEN u < 0.45 THEN len(items) ELSE 1 END AS n_items FROM g"
)
def q_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spoken formatting command and its artifact for every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", V.command(F.col("doc_id").cast("string")).alias("c"))
    return d.select("doc_id", "c.type", "c.input", "c.output", F.size("c.items").cast("long").alias("n_items"))


@query()
def q_correct_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with an extracted entity said wrong first; tests compare them with Python."""
    u, k = utterances(spark, sf_dir), F.col("utt_id")
    u = u.select("utt_id", "text", E.resolve(E.candidates("text")).alias("spans"))
    made = u.select("utt_id", "text", V.corrected(F.col("text"), F.col("spans"), k, T.pick(k, "level", ("easy", "medium", "hard"))).alias("c"))
    return made.where("c is not null").select("utt_id", "text", "c.*")


_G = "[array_to_string({w}[i:i + 2], ' ') for i in range(1, len({w}) - 1)]"


@query(
    f"WITH {SQL['preds']}, w AS (SELECT utt_id, category, lang, list_filter(string_split(lower(input), ' '), lambda x: x <> '') AS p, list_filter(string_split(lower(output), ' '), lambda x: x <> '') AS q FROM preds),"
    f" s AS (SELECT utt_id, category, lang, list_distinct(list_concat({_G.format(w='p')}, {_G.format(w='q')})) AS g FROM w), e AS (SELECT utt_id, category, lang, len(g) AS n, unnest(g) AS x FROM s),"
    " p AS (SELECT a.utt_id AS a, b.utt_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM e a JOIN e b ON a.category = b.category AND a.lang = b.lang AND a.x = b.x AND a.utt_id < b.utt_id GROUP BY ALL)"
    " SELECT DISTINCT unnest([a, b]) AS id FROM p WHERE shared / (na + nb - shared) >= 0.85"
)
def q_near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose shingles of input and output are near another's in the same group (here: category and language)."""
    p = predictions(spark, sf_dir)
    return dedup.near_offenders(p, "utt_id", [F.col("input"), F.col("output")], group=F.concat_ws("\t", "category", "lang"))
