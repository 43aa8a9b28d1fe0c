"""Queries over templates, pools and long forms, with SQL that repeats every draw by a recursive fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bank, longform, pools, templates
from ..operators.entities import DAYS, MONTHS, NUMBER_WORDS, PARTS
from ..registry import query
from ..sources.views import sql_draw, table


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rows(rows) -> str:
    cell = lambda x: quoted(x) + "::VARCHAR[]" if isinstance(x, (list, tuple)) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def _at(values, i: str) -> str:
    return f"({quoted(values)})[1 + {i}]"


_NTH = "CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END"
#: Values of made places q (counted within their form), by kind and form.
_MADE = {
    "number": ["(q + 1)::VARCHAR", _at(NUMBER_WORDS, "q")],
    "price": ["'$' || (q // 100 + 1) || '.' || lpad((q % 100)::VARCHAR, 2, '0')"],
    "percent": ["(q + 5) || ' percent'"],
    "version": ["(q // 100 + 1) || '.' || (q % 100 // 10) || '.' || (q % 10)"],
    "duration": ["5 * (q + 1) || ' minutes'"],
    "port": ["(q + 8000)::VARCHAR", "(q + 49152)::VARCHAR"],
    "id": ["(q + 1000)::VARCHAR", "(q + 10000)::VARCHAR"],
    "time": ["(q // 2 + 1) || ' ' || " + _at(("AM", "PM"), "q % 2"), f"(q // 8 + 1) || ':' || {_at(pools.QUARTERS, 'q % 8 // 2')} || ' ' || {_at(('AM', 'PM'), 'q % 2')}", "'half past ' || (q + 1)", _at(("quarter past ", "quarter to "), "q % 2") + " || (q // 2 + 1)", "(q + 1) || ' o''clock'", _at(("noon", "midnight"), "q")],
    "date": [_at(DAYS, "q"), "'next ' || " + _at(DAYS, "q"), f"{_at(MONTHS, 'q // 28')} || ' ' || (q % 28 + 1) || {_NTH.format(n='(q % 28 + 1)')}", f"{_at(MONTHS, 'q // 28')} || ' ' || (q % 28 + 1)", f"{_at(DAYS, 'q // 4')} || ' ' || {_at(PARTS, 'q % 4')}"],
}


def _made_ranges() -> list[tuple]:
    """kind, a, b (the share of its form), family, first place, places, form."""
    out = []
    for kind, forms in pools.MADE.items():
        a = at = 0
        for i, (share, n, _) in enumerate(forms):
            out.append((kind, a, a + share, kind, at, n, i))
            a, at = a + share, at + n
    return out


_MADE_VALUE = "CASE m.kind || m.form " + " ".join(f"WHEN '{k}{i}' THEN {x.replace('q', '(p.place - m.lo)')}" for k, xs in _MADE.items() for i, x in enumerate(xs)) + " END"
_MADE_VALUE = _MADE_VALUE.replace("(p.place - m.lo)uarter", "quarter")

#: From lex (kind, value): the ranges of kinds and the values of places.
SQL_POOLS = (
    "fam(kind, family, prior) AS (VALUES ('name', 'name', ''), ('surname', 'surname', ''), ('location', 'location', ''), ('item_p', 'item', ''), ('item_s', 'item', 'item_p'), ('tech_p', 'tech', ''), ('tech_s', 'tech', 'tech_p')),"
    " sizes AS (SELECT kind, count(*) AS n FROM (SELECT DISTINCT kind, value FROM lex) GROUP BY kind),"
    " leaf AS (SELECT f.kind, f.family, coalesce(b.n, 0) AS lo, coalesce(s.n, 0) AS n FROM fam f LEFT JOIN sizes s ON s.kind = f.kind LEFT JOIN sizes b ON b.kind = f.prior),"
    f" formed(kind, a, b, family, lo, n, form) AS (SELECT * FROM {_rows(_made_ranges())}),"
    " rng AS (SELECT kind, 0 AS a, 100 AS b, family, lo, n FROM leaf UNION ALL SELECT family, 0, 100, family, 0, sum(n)::BIGINT FROM leaf WHERE family <> kind GROUP BY family UNION ALL SELECT kind, a, b, family, lo, n FROM formed),"
    " vals AS (SELECT family, lo + row_number() OVER (PARTITION BY l.kind ORDER BY md5(value), value) - 1 AS place, value FROM (SELECT DISTINCT kind, value FROM lex) l JOIN leaf USING (kind))"
)


def _draw(site: str, i: str) -> str:
    return f"('0x' || substr(md5('42:' || key || ':{site}:' || {i}), 1, 15))::BIGINT"


#: From ask (key, i, kind, further columns): placed (key, i, family, place) and got (key, i, value). Needs WITH RECURSIVE.
SQL_DRAWS = (
    f"asked AS (SELECT a.key, a.i, r.family, r.lo, r.n FROM ask a LEFT JOIN rng r ON r.kind = a.kind AND {_draw('form', 'a.i').replace('key', 'a.key')} % 100 >= r.a AND {_draw('form', 'a.i').replace('key', 'a.key')} % 100 < r.b),"
    " fold AS (SELECT key, 0::BIGINT AS i, []::STRUCT(f VARCHAR, p BIGINT)[] AS used FROM ask GROUP BY key UNION ALL"
    " SELECT key, i + 1, list_append(used, {'f': family, 'p': CASE WHEN n > len(mine) THEN lo + list_reduce(list_prepend("
    + _draw("draw", "i")
    + " % nullif(n - len(mine), 0), mine), lambda x, u: CASE WHEN u <= x THEN x + 1 ELSE x END) END}) FROM (SELECT f.key, f.i, f.used, a.family, a.lo, a.n,"
    " list_sort(list_transform(list_filter(f.used, lambda u: u.f = a.family AND u.p >= a.lo AND u.p < a.lo + a.n), lambda u: u.p - a.lo)) AS mine FROM fold f JOIN asked a ON a.key = f.key AND a.i = f.i)),"
    " ended AS (SELECT key, arg_max(used, i) AS used FROM fold GROUP BY key), placed AS (SELECT key, i, used[i + 1].f AS family, used[i + 1].p AS place FROM (SELECT key, used, unnest(range(len(used))) AS i FROM ended)),"
    f" got AS (SELECT p.key, p.i, coalesce(v.value, {_MADE_VALUE}) AS value FROM placed p LEFT JOIN vals v ON v.family = p.family AND v.place = p.place LEFT JOIN formed m ON m.family = p.family AND p.place >= m.lo AND p.place < m.lo + m.n)"
)

#: Lexicon of the draws: names of nations, regions and parts, brands and market segments.
_LEX = (
    "lex AS (SELECT 'location' AS kind, n_name AS value FROM nation UNION ALL SELECT 'surname', r_name FROM region UNION ALL SELECT 'item_s', p_name FROM part UNION ALL SELECT 'item_p', p_brand FROM part UNION ALL SELECT 'tech_s', c_mktsegment FROM customer)"
)
_ASKED = ("item_s", "item", "item", "item_p", "location", "surname", "surname", "surname", "surname", "surname", "surname", "tech_p", "tech", "tech_s", "time", "time", "number", "number", "price", "percent", "version", "duration", "duration", "port", "id", "date", "date", "date")


@query(
    f"WITH RECURSIVE {_LEX}, {SQL_POOLS}, ask AS (SELECT doc_id::VARCHAR AS key, unnest(range({len(_ASKED)})) AS i, unnest({quoted(_ASKED)}) AS kind FROM documents), {SQL_DRAWS}"
    " SELECT key::BIGINT AS doc_id, i::INT AS place, kind, value FROM got JOIN ask USING (key, i)"
)
def q_pool_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values drawn for every document from families of pools over the given tables: none twice in a family; the sixth of five regions and a pool without values give null."""
    named = lambda kind, t, c: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    lex = named("location", "nation", "n_name").union(named("surname", "region", "r_name"))
    lex = lex.union(named("item_s", "part", "p_name")).union(named("item_p", "part", "p_brand")).union(named("tech_s", "customer", "c_mktsegment"))
    held = pools.Pools(lex)
    kinds = F.array(*map(F.lit, _ASKED))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.arrays_zip(kinds.alias("kind"), held.draws(kinds, F.col("doc_id").cast("string")).alias("d"))).alias("i", "x"))
    d = d.select("doc_id", F.col("i").alias("slot"), "x.kind", "x.d.family", "x.d.place")
    return pools.resolved(d, held).select("doc_id", F.col("slot").alias("place"), "kind", "value")


_BANK = f"tmpl(template_id, domain, text, preserved) AS (SELECT * FROM {_rows(bank.templates())}), slotted AS (SELECT *, regexp_extract_all(text, '\\{{(\\w+)\\}}', 1) AS slots FROM tmpl), lex(kind, value) AS (SELECT * FROM {_rows(bank.lexicon())})"
#: From plans (key, domain, required): chosen (key, template_id, text, preserved), with nulls where no template fits.
SQL_CHOOSE = (
    "classes AS (SELECT DISTINCT domain, required FROM plans), fit AS (SELECT c.domain, c.required, t.template_id, t.text, t.preserved, row_number() OVER (PARTITION BY c.domain, c.required ORDER BY md5(t.template_id), t.template_id) - 1 AS place,"
    " count(*) OVER (PARTITION BY c.domain, c.required) AS n FROM classes c JOIN slotted t ON t.domain = c.domain AND len(list_filter(c.required, lambda k: NOT list_contains(t.slots, k))) = 0),"
    f" chosen AS (SELECT p.key, f.template_id, f.text, f.preserved FROM plans p LEFT JOIN fit f ON f.domain = p.domain AND f.required = p.required AND f.place = {sql_draw('p.key', 'template')} % f.n)"
)
#: From source (key, text, same): clean (key, clean). Slots that repeat a value are not drawn.
SQL_FILL = (
    "places AS (SELECT key, same, slots, unnest(range(len(slots))) AS place, unnest(slots) AS kind FROM (SELECT key, same, regexp_extract_all(text, '\\{(\\w+)\\}', 1) AS slots FROM source)),"
    " owned AS (SELECT *, CASE WHEN same OR kind = 'name' THEN list_position(slots, kind) - 1 ELSE place END AS src FROM places),"
    " parts AS (SELECT key, place, part, CASE WHEN kind = 'items' THEN 'item' WHEN part = 1 THEN 'surname' WHEN kind = 'name2' THEN 'name2' ELSE kind END AS kind FROM (SELECT *, unnest(range(CASE WHEN kind = 'items' THEN "
    + _draw("items", "place")
    + " % 3 + 2 WHEN kind IN ('name', 'name2') AND "
    + _draw("surname", "place")
    + " % 10 < 3 THEN 2 ELSE 1 END)) AS part FROM owned WHERE src = place)),"
    " ask AS (SELECT key, place, part, CASE kind WHEN 'name2' THEN 'name' ELSE kind END AS kind, row_number() OVER (PARTITION BY key ORDER BY place, part) - 1 AS i FROM parts),"
)
SQL_CLEAN = (
    " listed AS (SELECT key, place, list(value ORDER BY part) AS vs FROM got JOIN ask USING (key, i) GROUP BY key, place),"
    " said AS (SELECT o.key, o.place, CASE WHEN o.kind = 'items' THEN array_to_string(l.vs[:-2], ', ') || ' and ' || l.vs[-1] ELSE array_to_string(l.vs, ' ') END AS value FROM owned o JOIN listed l ON l.key = o.key AND l.place = o.src),"
    " ordered AS (SELECT key, list(value ORDER BY place) AS vs FROM said GROUP BY key),"
    " clean AS (SELECT key, CASE WHEN vs IS NULL THEN text ELSE pieces[1] || array_to_string(list_transform(range(1, len(vs) + 1), lambda i: vs[i] || pieces[i + 1]), '') END AS clean FROM (SELECT s.key, s.text, o.vs, string_split_regex(s.text, '\\{\\w+\\}') AS pieces FROM source s LEFT JOIN ordered o USING (key)))"
)
_DOMAIN = (*bank.DOMAINS, "preservation")
_NEEDS = ("date", "time", "item_s", "name2", "tech")


@query(
    f"WITH RECURSIVE {_BANK}, {SQL_POOLS}, plans AS (SELECT doc_id::VARCHAR AS key, {quoted(_DOMAIN)}[1 + {sql_draw('doc_id', 'domain')} % {len(_DOMAIN)}] AS domain, CASE WHEN {sql_draw('doc_id', 'needs')} % 2 = 0 THEN [{quoted(_NEEDS)}[1 + {sql_draw('doc_id', 'need')} % {len(_NEEDS)}]] ELSE []::VARCHAR[] END AS required FROM documents),"
    f" {SQL_CHOOSE}, source AS (SELECT key, text, {sql_draw('key', 'same')} % 8 = 0 AS same FROM chosen WHERE text IS NOT NULL), {SQL_FILL} {SQL_DRAWS}, {SQL_CLEAN}"
    " SELECT p.key::BIGINT AS doc_id, p.domain, p.required[1] AS required, c.template_id, s.clean, coalesce(len(c.preserved), 0)::INT AS n_kept FROM plans p JOIN chosen c USING (key) LEFT JOIN clean s USING (key)"
)
def q_fill_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for every document as a plan: a template that fits its domain and required slot, filled; one in eight repeats its values. n_kept counts the preserved parts found in the sentence."""
    k = F.col("doc_id").cast("string")
    need = F.when(T.draw(k, "needs") % 2 == 0, F.array(T.pick(k, "need", _NEEDS))).otherwise(F.expr("cast(array() as array<string>)"))
    p = table(spark, sf_dir, "documents").select(k.alias("key"), T.pick(k, "domain", _DOMAIN).alias("domain"), need.alias("required"), (T.draw(k, "same") % 8 == 0).alias("repeat_same"))
    made = templates.fill(templates.choose(p, bank.template_table(spark)), pools.Pools(bank.lexicon_table(spark)))
    n = F.when(F.col("kept").isNull(), 0).otherwise(F.size(F.filter("kept", lambda x: F.contains("clean", x))))
    return made.select(F.col("key").cast("long").alias("doc_id"), "domain", F.get("required", F.lit(0)).alias("required"), "template_id", "clean", n.alias("n_kept"))


_LEVELS = ("easy", "medium", "hard")
_CASE = lambda values: "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
_WORDS = "len(list_filter(string_split({t}, ' '), lambda x: x <> ''))"
_LONG = (
    f"texts AS (SELECT doc_id::VARCHAR AS parent, {quoted(_LEVELS)}[1 + {sql_draw('doc_id', 'level')} % 3] AS level, {quoted(bank.DOMAINS)}[1 + {sql_draw('doc_id', 'domain')} % {len(bank.DOMAINS)}] AS domain FROM documents),"
    f" units AS (SELECT *, unnest(range({_CASE({k: longform.most(k) for k in _LEVELS})})) AS unit FROM texts), plans AS (SELECT parent || ':u' || unit AS key, parent, level, domain, unit, []::VARCHAR[] AS required FROM units),"
    f" clause(t, ds) AS (SELECT * FROM {_rows([(t, list(ds)) for t, ds in bank.CLAUSES])}), ranked AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY md5('42:' || key || ':clause:' || t)) AS k FROM plans p JOIN clause c ON len(c.ds) = 0 OR list_contains(c.ds, p.domain)),"
    f" added AS (SELECT p.key, string_agg(', ' || r.t, '' ORDER BY r.k) AS more FROM plans p JOIN ranked r USING (key) WHERE r.k <= {_CASE(longform.CLAUSES)} + {sql_draw('p.key', 'clauses')} % 2 GROUP BY p.key), {SQL_CHOOSE},"
    " source AS (SELECT key, regexp_replace(text, '[.?!]$', '') || more || regexp_extract(text, '[.?!]$') AS text, false AS same FROM chosen JOIN added USING (key))"
)
_UPPER = "upper({c}[1]) || {c}[2:]"
_JOINED = (
    f" conn AS (SELECT parent, list(c.v ORDER BY md5('42:' || parent || ':connective:' || c.v)) AS cs, list(c.c ORDER BY md5('42:' || parent || ':connective:' || c.v)) AS commas FROM texts, (SELECT * FROM {_rows([(c, ',' if m else '') for c, m in bank.CONNECTIVES])} t(v, c)) c GROUP BY parent),"
    f" ends AS (SELECT parent, level, cs, commas, {quoted(bank.OPENERS)}[1 + {sql_draw('parent', 'opener')} % {len(bank.OPENERS)}] AS opener, {quoted(bank.CLOSERS)}[1 + {sql_draw('parent', 'closer')} % {len(bank.CLOSERS)}] AS closer,"
    f" {_CASE({k: b[0] for k, b in longform.BOUNDS.items()})} AS lo, {_CASE({k: b[1] for k, b in longform.BOUNDS.items()})} AS hi, {_CASE(longform.SENTENCES)} AS least FROM texts JOIN conn USING (parent)),"
    f" gather AS (SELECT parent, 0 AS unit, []::VARCHAR[] AS parts, {_WORDS.format(t='closer')} AS words FROM ends UNION ALL"
    " SELECT parent, unit + 1, CASE WHEN fits THEN list_append(parts, text) ELSE parts END, CASE WHEN fits THEN words + w ELSE words END FROM (SELECT *, (len(parts) < least OR words < lo) AND words + w <= hi AS fits FROM (SELECT *,"
    f" {_WORDS.format(t='text')} AS w FROM (SELECT g.*, e.lo, e.hi, e.least, CASE WHEN len(g.parts) = 0 THEN e.opener ELSE {_UPPER.format(c='e.cs[len(g.parts)]')} || e.commas[len(g.parts)] END || ' ' || lower(s.clean[1]) || s.clean[2:] AS text"
    " FROM gather g JOIN ends e USING (parent) JOIN plans p ON p.parent = g.parent AND p.unit = g.unit JOIN clean s ON s.key = p.key)))),"
    " taken AS (SELECT parent, arg_max(parts, unit) AS parts, arg_max(words, unit) AS words FROM gather GROUP BY parent)"
)


@query(
    f"WITH RECURSIVE {_BANK}, {SQL_POOLS}, {_LONG}, {SQL_FILL} {SQL_DRAWS}, {SQL_CLEAN}, {_JOINED} SELECT parent::BIGINT AS doc_id, level, CASE WHEN ok THEN len(parts) + 1 END::INT AS n_units, CASE WHEN ok THEN array_to_string(parts, ' ') || ' ' || closer END AS clean,"
    " CASE WHEN ok THEN array_to_string(cs[1:len(parts) - 1], '|') END AS connectives, CASE WHEN ok THEN length(array_to_string(parts, ' ')) + 1 END::BIGINT AS closer_start FROM (SELECT *, words >= lo AND len(parts) >= least AS ok FROM taken JOIN ends USING (parent))"
)
def q_longform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long text for every document as a plan, within the words of its level, or null."""
    k = F.col("doc_id").cast("string")
    p = table(spark, sf_dir, "documents").select(k.alias("key"), T.pick(k, "level", _LEVELS).alias("level"), T.pick(k, "domain", bank.DOMAINS).alias("domain"))
    d = longform.compose(p, bank.template_table(spark), pools.Pools(bank.lexicon_table(spark)))
    said = F.filter(F.transform("units", lambda u: u["connective"]), lambda c: c.isNotNull())
    return d.select(F.col("key").cast("long").alias("doc_id"), "level", F.when(F.col("units").isNotNull(), F.size("units")).alias("n_units"), "clean", F.array_join(said, "|").alias("connectives"), F.element_at("units", -1)["start"].cast("long").alias("closer_start"))
