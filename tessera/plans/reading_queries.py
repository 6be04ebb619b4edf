"""Registered queries of reading plans, days' readings, joined views and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import corpus as co
from tessera.operators import linking as li
from tessera.operators import reading as re_
from tessera.operators import reports as rp
from tessera.plans.registry import EV, SEG, WRD, _micros, _segs, _turn_words, _words, query
from tessera.store import materialize

# ---- plans --------------------------------------------------------------------------------------------------------

_UNITS = SEG + r""", s AS (SELECT doc_id AS text, CASE lang WHEN 'en' THEN 'verse' WHEN 'fr' THEN 'section' ELSE 'line' END AS cite, seq // 7 AS book, seq, CASE WHEN lang = 'fr' THEN CASE WHEN seq % 4 = 1 THEN 'S' || seq END WHEN seq % 9 = 4 THEN 'x' WHEN seq % 3 = 1 THEN (seq - 1) || 'a' ELSE '' || seq END AS ref0, len(list_filter(string_split(content, ' '), lambda x: x <> '')) AS words FROM seg),
f AS (SELECT *, CASE WHEN cite = 'section' THEN coalesce(last_value(ref0 IGNORE NULLS) OVER (PARTITION BY text ORDER BY seq ROWS UNBOUNDED PRECEDING), '') ELSE ref0 END AS ref FROM s),
k AS (SELECT *, cite <> 'verse' OR regexp_matches(ref, '^\d+[a-z]?$') AS named, CASE WHEN cite = 'verse' THEN regexp_replace(ref, '[a-z]$', '') ELSE ref END AS key, row_number() OVER (PARTITION BY text, book ORDER BY seq) = 1 AS top FROM f),
b AS (SELECT *, last_value(CASE WHEN named OR top THEN key END IGNORE NULLS) OVER (PARTITION BY text, book ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM k), n AS (SELECT *, top OR (named AND key <> pk) AS fresh FROM b),
m AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY text, book ORDER BY seq ROWS UNBOUNDED PRECEDING) AS u FROM n),
units AS (SELECT text, cite, book, CAST(u AS BIGINT) AS u, arg_min(key, seq) AS key, arg_min(ref, seq) AS "first", arg_max(ref, seq) AS "last", CAST(sum(words) AS BIGINT) AS words, bool_or(top OR (fresh AND named)) AS open, arg_max(named, seq) AS close FROM m GROUP BY text, cite, book, u)"""


def _units(t):
    seq, lang = F.col("seq"), F.col("lang")
    ref = F.when(lang == "fr", F.when(seq % 4 == 1, F.concat(F.lit("S"), seq.cast("string")))).when(seq % 9 == 4, "x").when(seq % 3 == 1, F.concat((seq - 1).cast("string"), F.lit("a"))).otherwise(seq.cast("string"))
    cite = F.when(lang == "en", "verse").when(lang == "fr", "section").otherwise("line")
    n = F.size(F.filter(F.split("content", " "), lambda x: x != ""))
    return re_.plan_units(_segs(t).select(F.col("doc_id").alias("text"), cite.alias("cite"), F.floor(seq / 7).alias("book"), "seq", ref.alias("ref"), n.cast("long").alias("words")))


@query(f"WITH {_UNITS} SELECT * FROM units")
def plan_units(t, spark):
    return _units(t)


_DAYS = 9
_PLAN = _UNITS + """, p AS (SELECT d.source AS plan, units.* FROM units JOIN documents d ON d.doc_id = units.text), o AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY text, book, u) AS i, sum(words) OVER (PARTITION BY plan ORDER BY text, book, u) - words AS before, count(*) OVER (PARTITION BY plan) AS n, sum(words) OVER (PARTITION BY plan) AS total, row_number() OVER (PARTITION BY plan, text, book ORDER BY u) = 1 AS b1, min(book) OVER (PARTITION BY plan, text) AS b0, lag(close) OVER (PARTITION BY plan, text, book ORDER BY u) AS pc FROM p),
z AS (SELECT plan, any_value(n) AS n, any_value(total) AS total, least(""" + str(_DAYS) + """, any_value(n)) AS d FROM o GROUP BY plan),
near AS (SELECT o.plan, k, i - 1 AS pos, 10 * abs(before * d - k * z.total) - CASE WHEN NOT b1 THEN 0 WHEN book = b0 THEN 5 ELSE 3 END * z.total AS score FROM o JOIN z USING (plan), range(1, """ + str(_DAYS) + """) r(k) WHERE open AND (b1 OR pc) AND i > 1 AND k < d AND 2 * abs(before * d - k * z.total) <= z.total AND i - 1 <= z.n - (d - k)),
c0 AS (SELECT plan, 0 AS cut FROM z), """ + ", ".join(
    f"c{k} AS (SELECT z.plan, CASE WHEN {k} = any_value(d) THEN any_value(n) WHEN {k} < any_value(d) THEN coalesce(arg_min(pos, score * 1000000 + pos), least(greatest(any_value(cut) + 1, {k}), any_value(n) - (any_value(d) - {k}))) END AS cut FROM c{k - 1} JOIN z USING (plan) LEFT JOIN near ON near.plan = z.plan AND near.k = {k} AND near.pos > c{k - 1}.cut GROUP BY z.plan)" for k in range(1, _DAYS + 1)) + ", cuts AS (" + " UNION ALL ".join(f"SELECT plan, {k} AS day, CAST(cut AS BIGINT) AS cut FROM c{k} WHERE cut IS NOT NULL" for k in range(1, _DAYS + 1)) + ")"


def _plan(t):
    names = t("documents").select(F.col("doc_id").alias("text"), F.col("source").alias("plan"))
    return _units(t).join(names, "text").withColumn("sort", F.col("text"))


@query(f"WITH {_PLAN} SELECT * FROM cuts")
def plan_cuts(t, spark):
    return re_.split_plan(_plan(t), _DAYS)


@query(f"""WITH {_PLAN}, dated AS (SELECT o.*, (SELECT min(day) FROM cuts WHERE cuts.plan = o.plan AND cuts.cut >= o.i) AS day FROM o), e AS (SELECT plan, text, book, min(u) AS u0, max(u) AS u1 FROM p GROUP BY ALL),
g AS (SELECT plan, day, text, book, any_value(cite) AS cite, sum(words) AS words, min(u) AS a, max(u) AS b, arg_min("first", u) AS f, arg_max("last", u) AS l, arg_min(key, u) AS ka, arg_max(key, u) AS kb FROM dated GROUP BY plan, day, text, book)
SELECT g.plan, day, g.text AS sort, g.text, g.book, CAST(words AS BIGINT) AS words, CASE WHEN cite = 'verse' THEN g.book || '.' || CASE WHEN a = u0 THEN 'start' ELSE f END || '-' || g.book || '.' || CASE WHEN b = u1 THEN 'end' ELSE l END ELSE f || '-' || l END AS v,
CASE WHEN cite = 'verse' THEN 'T' || g.text || ' ' || CASE WHEN a = u0 AND b = u1 THEN '' || g.book ELSE CASE WHEN regexp_matches(f, '^\\d+[a-z]?$') THEN g.book || ':' || ka ELSE '' || g.book END || CASE WHEN a = b THEN '' ELSE '–' || kb END END ELSE 'T' || g.text || ' B' || g.book || CASE WHEN a = u0 AND b = u1 THEN '' ELSE ' ' || f || '–' || l END END AS label FROM g JOIN e ON e.plan = g.plan AND e.text = g.text AND e.book = g.book""")
def plan_parts(t, spark):
    plan = materialize(_plan(t), "plan")
    units = plan.withColumn("title", F.concat(F.lit("T"), F.col("text").cast("string"))).withColumn("label", F.concat(F.lit("B"), F.col("book").cast("string"))).withColumn("multi", F.lit(True))
    return re_.plan_parts(units, re_.split_plan(plan, _DAYS))


@query(f"WITH {_UNITS} SELECT text, book, min(u) AS first, max(u) AS last FROM units GROUP BY text, book")
def unit_ranges(t, spark):
    return re_.first_last(_units(t), ["text", "book"], "u")


@query("""WITH x AS (SELECT 'c' || c_custkey AS text, c_mktsegment AS category, 'n' || c_nationkey AS collection, c_custkey AS sort, c_custkey % 10 = 0 AS hidden FROM customer), n AS (SELECT 'c' || o_custkey AS text, count(*) AS n FROM orders GROUP BY 1)
SELECT 'category:' || category AS target, text, sort, NULL::INT AS book_from, NULL::INT AS book_to FROM x WHERE NOT hidden UNION ALL SELECT 'collection:' || collection, text, sort, NULL, NULL FROM x WHERE NOT hidden UNION ALL SELECT text, text, sort, NULL, NULL FROM x WHERE NOT hidden
UNION ALL SELECT x.text || ':2-4', x.text, sort, 2, 4 FROM x JOIN n USING (text) WHERE NOT hidden AND n >= 4 UNION ALL SELECT x.text || ':1', x.text, sort, CASE WHEN n > 1 THEN 1 END, CASE WHEN n > 1 THEN 1 END FROM x JOIN n USING (text) WHERE NOT hidden""")
def plan_targets(t, spark):
    c = t("customer")
    name = lambda k: F.concat(F.lit("c"), F.col(k).cast("string"))
    texts = c.select(name("c_custkey").alias("text"), F.col("c_mktsegment").alias("category"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("collection"), (F.col("c_custkey") % 10 == 0).alias("hidden"), F.col("c_custkey").alias("sort"))
    books = t("orders").select(name("o_custkey").alias("text"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"))
    asked = F.array(F.concat(F.lit("category:"), "category"), F.concat(F.lit("collection:"), "collection"), F.col("text"), F.concat("text", F.lit(":2-4")), F.concat("text", F.lit(":1")), F.concat("text", F.lit(":4-2")))
    return re_.plan_targets(texts.select(F.explode(asked).alias("target")), texts, books)


# ---- days' readings ---------------------------------------------------------------------------------------------------

_TITLES = "r AS (SELECT o_orderkey AS id, o_custkey % 5 AS b, 1 + o_orderkey % 40 AS c, 1 + o_orderkey % 11 AS v FROM orders)"


def _titles(t):
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    b, c, v = F.col("o_custkey") % 5, 1 + k % 40, 1 + k % 11
    title = F.concat(F.lit("Bk "), s(b), F.lit(" "), s(c), F.lit(":"), s(v), F.lit("-"), s(v + 5), F.lit(": "), s(c + 1), F.lit(":1-3, 7; Ps "), s(c), F.lit(":"), s(v), F.lit("; Hymn"))
    return re_.parse_titles(t("orders").select(k.alias("id"), title.alias("title")), "id", "title")


@query(f"WITH {_TITLES} SELECT id, 0 AS part, 'Bk ' || b AS name, c || ':' || v || '-' || (v + 5) || '; ' || (c + 1) || ':1-3, 7' AS refs FROM r UNION ALL SELECT id, 1, 'Ps', c || ':' || v FROM r UNION ALL SELECT id, 2, NULL, NULL FROM r")
def reading_titles(t, spark):
    return _titles(t)


@query(f"WITH {_TITLES} SELECT id, 0 AS part, 0 AS piece, c AS c1, v AS v1, c AS c2, v + 5 AS v2 FROM r UNION ALL SELECT id, 0, 1, c + 1, 1, c + 1, 3 FROM r UNION ALL SELECT id, 0, 2, c + 1, 7, c + 1, 7 FROM r UNION ALL SELECT id, 1, 0, c, v, c, v FROM r")
def reading_places(t, spark):
    return re_.parse_places(_titles(t), ["id", "part"], "refs")


@query(f"""WITH {_TITLES}, vs AS (SELECT text, c, v, row_number() OVER (PARTITION BY text ORDER BY c, v) AS idx FROM (SELECT DISTINCT 'Bk ' || l_suppkey % 5 AS text, l_partkey // 20 % 45 AS c, l_partkey % 20 AS v FROM lineitem)),
hit AS (SELECT DISTINCT r.id, text, idx, vs.c, vs.v FROM r JOIN vs ON vs.text = 'Bk ' || r.b AND ((vs.c = r.c AND vs.v BETWEEN r.v AND r.v + 5) OR (vs.c = r.c + 1 AND (vs.v BETWEEN 1 AND 3 OR vs.v = 7)))),
isl AS (SELECT *, idx - row_number() OVER (PARTITION BY id, text ORDER BY idx) AS g FROM hit), runs AS (SELECT id, text, g, min(idx) AS first, arg_min(c, idx) AS c1, arg_min(v, idx) AS v1, arg_max(c, idx) AS c2, arg_max(v, idx) AS v2, count(*) AS n FROM isl GROUP BY id, text, g),
s AS (SELECT *, lag(c2) OVER (PARTITION BY id, text ORDER BY first) AS b FROM runs)
SELECT id, text, string_agg(CASE WHEN b = c1 THEN '' ELSE c1 || ':' END || v1 || CASE WHEN n = 1 THEN '' WHEN c1 = c2 THEN '-' || v2 ELSE '-' || c2 || ':' || v2 END, ', ' ORDER BY first) AS label FROM s GROUP BY id, text""")
def reading_labels(t, spark):
    """Readings' places met with the verses there are: runs, the chapter named where it changes."""
    part = F.col("l_partkey")
    verses = t("lineitem").select(F.concat(F.lit("Bk "), (F.col("l_suppkey") % 5).cast("string")).alias("text"), (F.floor(part / 20) % 45).cast("int").alias("c"), (part % 20).cast("int").alias("v")).distinct()
    verses = verses.withColumn("idx", F.row_number().over(Window.partitionBy("text").orderBy("c", "v"))).withColumn("div", F.col("c")).withColumn("ref", F.col("v"))
    named = _titles(t).filter("part = 0").withColumnRenamed("name", "text")
    return re_.label_readings(named, ["id"], verses, "text", "refs")


# ---- joined views and reports -------------------------------------------------------------------------------------------

@query("SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def linked_parts(t, spark):
    links = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"))
    return li.linked(links, t("part").select(F.col("p_partkey").alias("key"), "p_name", "p_brand"), ["key"]).drop("key")


@query("SELECT c_custkey, c_nationkey, (SELECT max(x.c_custkey) FROM customer x WHERE x.c_nationkey = c.c_nationkey) AS last_of, (SELECT count(*) FROM customer x WHERE x.c_nationkey = c.c_nationkey) AS sharing FROM customer c")
def group_statistics(t, spark):
    return li.with_group_stat(t("customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], last_of=F.max("c_custkey"), sharing=F.count("*"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent, EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AS has_supplier FROM customer")
def any_flags(t, spark):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return li.has_any(t("customer").select("c_custkey"), ["c_custkey"], has_orders=o, has_urgent=o.filter("o_orderpriority = '1-URGENT'"), has_supplier=t("supplier").select(F.col("s_suppkey").alias("c_custkey")))


@query(f"WITH {EV} SELECT user_id, count(*) AS units, min(us) AS first, max(us + 1000000 * (event_id % 9)) AS last, CAST(sum(1000000 * (event_id % 9)) AS BIGINT) AS seconds, median(event_id % 100) AS median_score, count(*) FILTER (event_id % 100 < 20) AS weak, count(*) FILTER (event_type = 'error') AS passed_over, count(*) FILTER (event_type = 'signup') AS heard, count(*) FILTER (event_type = 'signup') AS speakers FROM ev GROUP BY user_id")
def recording_reports(t, spark):
    e = _micros(t).select("user_id", "event_type", F.col("us").alias("start"), (F.col("us") + 1000000 * (F.col("event_id") % 9)).alias("end"), (F.col("event_id") % 100).alias("score"))
    return rp.recording_report(e, ["user_id"], F.col("event_type") == "signup", F.col("event_type") == "error", 20)


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), a AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem WHERE l_linenumber <> 2), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS v FROM lineitem WHERE l_linenumber <> 4), j AS (SELECT k, count(*) FILTER (a.v IS NOT NULL) AS r, count(*) FILTER (b.v IS NOT NULL) AS c, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS m FROM a FULL JOIN b USING (k, v) GROUP BY k), e AS (SELECT coalesce(r, 0) AS r, coalesce(c, 0) AS c, coalesce(m, 0) AS m FROM w LEFT JOIN j USING (k))
SELECT CAST(sum(m) AS BIGINT) AS shared, CAST(1000 * sum(m) // sum(c) AS BIGINT) AS precision, CAST(1000 * sum(m) // sum(r) AS BIGINT) AS recall, count(*) FILTER (r = m AND c = m) AS same_set, count(*) FILTER (m > 0) AS any_shared, count(*) FILTER (r > 0) AS with_ref FROM e""")
def link_report(t, spark):
    l = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("v"), "l_linenumber")  # noqa: E741
    return rp.link_report(l.filter("l_linenumber <> 2"), l.filter("l_linenumber <> 4"), l, ["k"], "v")


@query(f"""WITH {WRD}, k AS (SELECT doc_id, seq, word_index, unnest(regexp_extract_all(word, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[.;·!?]')) AS token, generate_subscripts(regexp_extract_all(word, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[.;·!?]'), 1) AS t FROM wrd),
s AS (SELECT *, coalesce(sum(CASE WHEN regexp_full_match(token, '[.;·!?]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq, word_index, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM k),
f AS (SELECT doc_id, CAST(sentence AS BIGINT) AS sentence, seq, word_index, arg_min(token, t) AS token FROM s WHERE NOT regexp_full_match(token, '[.;·!?]') GROUP BY ALL),
o AS (SELECT DISTINCT doc_id, sentence FROM f WHERE (seq * 31 + word_index * 17) % 40 = 0)
SELECT f.* FROM f JOIN o ON o.doc_id = f.doc_id AND o.sentence = f.sentence""")
def unanalysed_sentences(t, spark):
    w = _words(t).select("doc_id", "seq", "word_index", "word")
    return co.unanalysed_sentences(w, w.filter((F.col("seq") * 31 + F.col("word_index") * 17) % 40 != 0), "doc_id")


@query("SELECT 'chat' AS text, conv_id AS div, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, '' || turn AS ref, text AS content, nullif(trim(CASE WHEN role = 'system' THEN ' ' ELSE role END), '') AS gloss FROM conversations")
def generic_turns(t, spark):
    c = t("conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("line"), "text", F.when(F.col("role") == "system", " ").otherwise(F.col("role")).alias("role"))
    return co.generic_segments(c, "chat", "text", "role")


@query("SELECT name, a.d AS \"left\", b.d AS \"right\" FROM (SELECT p_name AS name, min(p_brand) AS d FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT p_name AS name, min(p_brand) AS d FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1) b USING (name) WHERE a.d IS DISTINCT FROM b.d")
def index_difference(t, spark):
    side = lambda cond: t("part").filter(cond).groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("definition"))
    return rp.index_difference(side("p_partkey % 3 <> 0"), side("p_partkey % 5 <> 0"))


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations), x AS (SELECT conv_id, turn, unnest(w) AS word FROM w), c AS (SELECT conv_id, turn, word, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS k FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word GROUP BY ALL)
SELECT a.conv_id, a.turn AS pair, CAST(2000 * coalesce(k, 0) // (len(a.w) + len(b.w)) AS BIGINT) AS ratio FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN m ON m.conv_id = a.conv_id AND m.turn = a.turn WHERE len(a.w) > 0 AND len(b.w) > 0""")
def turn_similarity(t, spark):
    """Neighbour turns by their words in common, each as often as both have it."""
    from tessera.operators import alignment as al

    w = _turn_words(t)
    a, b = w.withColumnRenamed("turn", "pair"), w.withColumn("pair", F.col("turn") - 1).drop("turn")
    name = lambda df: df.withColumn("g", F.struct("conv_id", "pair"))
    pairs = name(li.match_occurrences(a, b, ["conv_id", "pair"], "word", "i"))
    size = lambda df: name(df).groupBy("g").agg(F.count("*").alias("n"))
    return al.similarity(pairs, size(a), size(b), "g").select("g.conv_id", "g.pair", "ratio")
