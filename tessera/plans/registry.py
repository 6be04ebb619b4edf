"""Registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import alignment as al
from tessera.operators import corpus as co
from tessera.operators import linking as li
from tessera.operators import reports as rp
from tessera.operators import sequence as sq
from tessera.sources import readers as rd
from tessera.store import materialize, new_path
from tessera.streaming import events as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers f(t, spark) under its name; t(name) reads a table."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            t.dir = sf_dir
            return f(t, spark)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


SEG = "seg AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)"
WRD = SEG + ", wrd AS (SELECT doc_id, source, lang, seq, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS word_index FROM (SELECT *, list_filter(string_split(content, ' '), lambda x: x <> '') AS w FROM seg))"
EV = "ev AS (SELECT *, epoch_us(ts) AS us FROM events)"


def _fold(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^a-z]', '', 'g')"


def _segs(t) -> DataFrame:
    return co.segments(t("documents"))


def _dealt(t, *cols: str) -> DataFrame:
    """doc_id, text and cols, dealt by id: whole texts are shuffled once, so that a file that is read in one piece doesn't stay one task."""
    return t("documents").select("doc_id", "text", *cols).repartition("doc_id")


def _words(t) -> DataFrame:
    return co.words(_segs(t), ("doc_id", "source", "lang", "seq"))


def _bare_words(t, *keys: str) -> DataFrame:
    """Words without their places: one pass over whole texts, nothing but `keys` goes with them."""
    return t("documents").select(*keys, F.explode(F.split("text", "[ \n]+")).alias("word")).filter("word <> ''")


def _micros(t) -> DataFrame:
    """Microseconds since 1970 of the events' local time, whatever the session's zone."""
    return t("events").withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


# ---- linking -----------------------------------------------------------------------------------------------

def _levels() -> list:
    folded = tx.fold_latin(F.col("word"))
    return [("exact", F.col("word")), ("case", F.lower("word")), ("folded", folded), ("loose", F.regexp_replace(folded, "s$", ""))]


def _level_sql(name: str, key: str, once: bool) -> str:
    return f"{name} AS (SELECT k, min(entry) AS e FROM (SELECT entry, {key} AS k FROM entries) WHERE k <> '' GROUP BY k{' HAVING count(*) = 1' if once else ''})"


@query(f"""WITH {WRD}, entries AS (SELECT DISTINCT word AS entry FROM wrd WHERE source = 'src1'),
{_level_sql('l0', 'entry', False)}, {_level_sql('l1', 'lower(entry)', True)}, {_level_sql('l2', _fold('entry'), True)}, {_level_sql('l3', "regexp_replace(" + _fold('entry') + ", 's$', '')", True)},
q AS (SELECT lang, word, count(*) AS n FROM wrd WHERE source <> 'src1' GROUP BY lang, word)
SELECT lang, CASE WHEN l0.e IS NOT NULL THEN 'exact' WHEN l1.e IS NOT NULL THEN 'case' WHEN l2.e IS NOT NULL THEN 'folded' WHEN l3.e IS NOT NULL THEN 'loose' ELSE 'none' END AS method,
CAST(sum(n) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS forms
FROM q LEFT JOIN l0 ON q.word = l0.k LEFT JOIN l1 ON lower(q.word) = l1.k LEFT JOIN l2 ON {_fold('q.word')} = l2.k LEFT JOIN l3 ON regexp_replace({_fold('q.word')}, 's$', '') = l3.k GROUP BY 1, 2""")
def flagship_coverage(t, spark):
    # one pass over the words: counts by language, and how many of them are the lexicon's
    own = F.col("source") == "src1"
    counts = materialize(_bare_words(t, "lang", "source").groupBy("lang", "word").agg(F.count_if(~own).alias("n"), F.count_if(own).alias("entries")), "counts")
    asked = counts.filter("n > 0").select("lang", "word", "n")
    linked = li.cascade(asked, counts.filter("entries > 0").select(F.col("word").alias("entry")), _levels())
    return asked.join(linked, "word").groupBy("lang", "method").agg(F.sum("n").alias("tokens"), F.count("*").alias("forms"))


@query(f"""WITH {WRD}, entries AS (SELECT DISTINCT word AS entry FROM wrd WHERE source = 'src1'), q AS (SELECT lang, word, count(*) AS n FROM wrd WHERE source <> 'src1' GROUP BY ALL)
SELECT lang, CAST(sum(CASE WHEN entry IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS hit, CAST(sum(n) AS BIGINT) AS total,
CAST(100 * sum(CASE WHEN entry IS NOT NULL THEN n ELSE 0 END) // sum(n) AS BIGINT) AS percent FROM q LEFT JOIN entries ON word = entry GROUP BY lang""")
def weighted_coverage(t, spark):
    w = _bare_words(t, "lang", "source")
    entries = w.filter("source = 'src1'").select("word").distinct().withColumn("hit", F.lit(True))
    asked = w.filter("source <> 'src1'").groupBy("lang", "word").agg(F.count("*").alias("n"))
    return rp.coverage(asked.join(entries, "word", "left").withColumn("m", F.col("hit").isNotNull()), ["lang"], "m", "n")


_PASSAGES = "passage AS (SELECT doc_id, seq // 4 AS p, min(seq) AS s, max(seq) AS e FROM seg GROUP BY ALL), note AS (SELECT doc_id, min(seq) AS s, min(seq) + doc_id % 6 AS e FROM seg GROUP BY doc_id, seq // 5)"


def _passages(t) -> tuple[DataFrame, DataFrame]:
    s = _segs(t).select("doc_id", "seq")
    p = s.groupBy("doc_id", F.floor(F.col("seq") / 4).cast("int").alias("p")).agg(F.min("seq").alias("start"), F.max("seq").alias("end"))
    n = s.groupBy("doc_id", F.floor(F.col("seq") / 5).alias("g")).agg(F.min("seq").alias("start")).select("doc_id", "start", (F.col("start") + F.col("doc_id") % 6).cast("int").alias("end"))
    return p, n


@query(f"WITH {SEG}, {_PASSAGES} SELECT p.doc_id, p.p, p.s AS start, n.s AS r_start, n.e AS r_end FROM passage p JOIN note n ON p.doc_id = n.doc_id AND p.s <= n.e AND n.s <= p.e")
def interval_overlap(t, spark):
    p, n = _passages(t)
    return li.overlapping(p, n, ["doc_id"], 8).select("doc_id", "p", "start", "r_start", "r_end")


@query(f"WITH {SEG}, {_PASSAGES} SELECT s.doc_id, s.seq, count(n.s) AS n_cover FROM seg s LEFT JOIN note n ON s.doc_id = n.doc_id AND s.seq BETWEEN n.s AND n.e GROUP BY ALL")
def cover_counts(t, spark):
    return li.count_cover(_segs(t).select("doc_id", F.col("seq").alias("pos")), _passages(t)[1], ["doc_id"]).select("doc_id", F.col("pos").alias("seq"), "n_cover")


@query(f"WITH {EV}, u AS (SELECT user_id, us, max(event_id) AS unit FROM ev WHERE event_type = 'click' GROUP BY ALL) SELECT p.event_id, u.unit FROM (SELECT * FROM ev WHERE event_type = 'purchase') p ASOF LEFT JOIN u ON p.user_id = u.user_id AND p.us >= u.us")
def asof_lookup(t, spark):
    e = _micros(t)
    units = e.filter("event_type = 'click'").groupBy("user_id", F.col("us").alias("at")).agg(F.max("event_id").alias("unit"))
    return li.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("at")), units, ["user_id"], "unit").select("event_id", "unit")


@query(f"""WITH {EV} SELECT event_type, count(*) AS n, CAST(count(*) FILTER (near) AS BIGINT) AS n_near FROM (
SELECT event_type, EXISTS (SELECT 1 FROM ev s WHERE s.event_type = 'view' AND s.user_id = p.user_id AND p.us BETWEEN s.us - 300000000 AND s.us + 900000000) AS near FROM ev p WHERE event_type <> 'view') GROUP BY event_type""")
def near_span(t, spark):
    e = _micros(t)
    spans = e.filter("event_type = 'view'").select("user_id", F.col("us").alias("start"), F.col("us").alias("end"))
    got = li.near_any(e.filter("event_type <> 'view'").select("event_type", "user_id", F.col("us").alias("at")), spans, 300000000.0, 900000000.0, ["user_id"])
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("near").alias("n_near"))


@query(f"WITH {EV} SELECT p.event_id, min(abs(p.us - r.us)) AS dist FROM ev p LEFT JOIN ev r ON p.user_id = r.user_id AND r.event_type = 'signup' WHERE p.event_type = 'error' GROUP BY p.event_id")
def nearest_reference(t, spark):
    e = _micros(t).select("event_id", "event_type", "user_id", F.col("us").alias("at"))
    return li.nearest(e.filter("event_type = 'error'"), e.filter("event_type = 'signup'"), ["user_id"]).select("event_id", "dist")


@query("SELECT c.conv_id, c.turn, CASE WHEN c.turn = 0 THEN '' ELSE p.role END AS head_role FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1")
def parent_link(t, spark):
    c = t("conversations").select("conv_id", "turn", "role", (F.col("turn") + 1).alias("id"), F.col("turn").alias("head"))
    return li.with_parent(c, "conv_id", "id", "head", "role", "head_role").select("conv_id", "turn", "head_role")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unlabelled(t, spark):
    return li.unmatched(t("documents").select("doc_id"), t("labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_labelled(t, spark):
    return li.only_in(t("documents").select("doc_id", "lang"), t("labels").filter("toxic = 1"), ["doc_id"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), b AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT coalesce(a.k, b.k) AS cust, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS "both", count(*) FILTER (b.v IS NULL) AS only_ref, count(*) FILTER (a.v IS NULL) AS only_cand,
count(*) FILTER (b.v IS NULL) = 0 AND count(*) FILTER (a.v IS NULL) = 0 AS equal FROM a FULL JOIN b ON a.k = b.k AND a.v = b.v GROUP BY 1""")
def set_compare(t, spark):
    o = t("orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("v"), "o_orderdate")
    return li.compare_sets(o.filter("o_orderdate < timestamp'1995-01-01'"), o.filter("o_orderdate >= timestamp'1995-01-01'"), ["cust"], "v")


@query(f"WITH {SEG}, {_PASSAGES}, l AS (SELECT doc_id, seq FROM seg WHERE length(content) > 60) SELECT doc_id, s AS start, e AS \"end\" FROM passage p WHERE (SELECT count(*) FROM l WHERE l.doc_id = p.doc_id AND l.seq BETWEEN p.s AND p.e) < e - s + 1")
def uncovered(t, spark):
    lines = _segs(t).filter(F.length("content") > 60).select("doc_id", F.col("seq").alias("pos"))
    return li.uncovered_passages(_passages(t)[0].drop("p"), lines, ["doc_id"])


_TURNW = "tw AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations))"


def _turn_words(t) -> DataFrame:
    w = F.filter(F.split("text", " "), lambda x: x != "")
    return t("conversations").select("conv_id", "turn", F.posexplode(w).alias("i", "word")).withColumn("i", F.col("i") + 1)


@query(f"""WITH {_TURNW}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, word ORDER BY i) AS nth FROM tw)
SELECT a.conv_id, a.turn AS pair, a.word, a.nth, a.i AS left_i, b.i AS right_i FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.word = b.word AND a.nth = b.nth""")
def occurrence_match(t, spark):
    w = _turn_words(t)
    return li.match_occurrences(w.withColumnRenamed("turn", "pair"), w.withColumn("pair", F.col("turn") - 1).drop("turn"), ["conv_id", "pair"], "word", "i").select("conv_id", "pair", "word", "nth", "left_i", "right_i")


@query("""WITH s AS (SELECT l_partkey AS item, l_suppkey AS version, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL)
SELECT item, version, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, version) AS r FROM s) WHERE r = 1""")
def best_version(t, spark):
    s = t("lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("version")).agg(F.sum("l_quantity").cast("long").alias("score"))
    return li.best_version(s, "item", "version", "score")


@query(f"WITH {SEG}, spans AS (SELECT doc_id, seq // 3 AS ref, min(seq) AS f, max(seq) AS t FROM seg GROUP BY ALL) SELECT l.doc_id, l.ref, f AS seq_from, t AS seq_to FROM (SELECT doc_id, quality + toxic * 2 AS ref FROM labels) l JOIN spans s ON l.doc_id = s.doc_id AND l.ref = s.ref")
def place_notes(t, spark):
    segs = _segs(t).select("doc_id", "seq", F.floor(F.col("seq") / 3).alias("ref"))
    notes = t("labels").select("doc_id", (F.col("quality") + F.col("toxic") * 2).cast("long").alias("ref"))
    return li.place_notes(notes, segs, ["doc_id"])[0]


@query("SELECT c_custkey, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'urgent' WHEN b.value IS NOT NULL THEN 'any' ELSE 'none' END AS from_source FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a ON c_custkey = a.o_custkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS value FROM orders GROUP BY 1) b ON c_custkey = b.o_custkey")
def fallback_sources(t, spark):
    first = lambda cond: t("orders").filter(cond).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("value"))
    return li.coalesce_sources(t("customer").select("c_custkey"), ["c_custkey"], ("urgent", first("o_orderpriority = '1-URGENT'")), ("any", first("true")))


@query(f"""WITH RECURSIVE {SEG}, e AS (SELECT DISTINCT doc_id AS m, md5(content) AS h FROM seg WHERE length(content) > 0), p AS (SELECT DISTINCT a.m AS a, b.m AS b FROM e a JOIN e b ON a.h = b.h),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a) SELECT a AS member, min(b) AS group_id FROM r GROUP BY a HAVING count(*) > 1""")
def sharing_groups(t, spark):
    links = _segs(t).filter(F.length("content") > 0).select(F.col("doc_id").alias("member"), F.md5("content").alias("target"))
    return al.sharing_groups(links)


# ---- aggregations and reports ---------------------------------------------------------------------------------

@query("SELECT l_returnflag AS cls, count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem GROUP BY 1")
def class_counts(t, spark):
    return rp.class_counts(t("lineitem").withColumnRenamed("l_returnflag", "cls"), ["l_orderkey", "l_partkey"], "cls")


@query("SELECT o_custkey, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n FROM orders GROUP BY 1")
def group_bounds(t, spark):
    return rp.group_bounds(t("orders"), ["o_custkey"], "o_orderkey")


@query(f"""WITH {WRD}, k AS (SELECT {_fold('word')} AS key, word, count(*) AS n, min((doc_id * 100000 + seq) * 100000 + word_index) AS first FROM wrd GROUP BY 1, 2)
SELECT key, word, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS r FROM k WHERE key <> '') WHERE r = 1""")
def commonest_form(t, spark):
    w = _words(t).withColumn("first", (F.col("doc_id") * 100000 + F.col("seq")) * 100000 + F.col("word_index"))
    return rp.commonest_form(w, "key", "word", "first", tx.fold_latin(F.col("word")))


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.06), c AS (SELECT count(*) AS tp FROM a JOIN b USING (l_orderkey, l_partkey))
SELECT tp, (SELECT count(*) FROM a) AS n_ref, (SELECT count(*) FROM b) AS n_cand, 2000 * tp // ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) AS f1 FROM c""")
def link_scores(t, spark):
    l = t("lineitem")
    return rp.score_links(l.filter("l_shipdate < timestamp'1996-01-01'"), l.filter("l_discount < 0.06"), ["l_orderkey", "l_partkey"])


@query(f"""WITH {EV}, p AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id) - us AS gap FROM ev)
SELECT user_id, count(*) AS n, CAST(count(*) FILTER (gap < 60000000) AS BIGINT) AS short_gaps, median(gap) AS median_gap FROM p GROUP BY user_id""")
def timing_report(t, spark):
    gap = F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id")) - F.col("us")
    return _micros(t).withColumn("gap", gap).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") < 60000000).alias("short_gaps"), F.median("gap").alias("median_gap"))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def pivot_counts(t, spark):
    return rp.pivot_counts(t("documents"), "source", "lang", ["de", "en", "es", "fr"])


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE n IS NULL OR n > 1")
def exactly_once(t, spark):
    return rp.exactly_once(t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", t("customer"))


@query("SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS votes_a, CAST(sum(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS votes_b, CASE WHEN votes_a >= votes_b THEN 'a' ELSE 'b' END AS winner FROM orders GROUP BY 1")
def hypothesis_vote(t, spark):
    return rp.vote(t("orders"), ["o_orderpriority"], F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 3 == 0)


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def nested_turns(t, spark):
    c = t("conversations").select("conv_id", "turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("x"))
    return rp.nest(c, ["conv_id"], ["turn"], ["turn", "x"], "rows").select("conv_id", F.array_join(F.transform("rows", lambda r: r["x"]), "|").alias("turns"))


@query("SELECT source, min(doc_id) AS first_seen, count(*) AS n FROM documents GROUP BY source")
def first_seen(t, spark):
    return rp.first_seen_order(t("documents"), "source", "doc_id")


@query(f"WITH {SEG} SELECT source, lang, count(DISTINCT doc_id) AS docs, count(*) AS lines FROM seg GROUP BY ROLLUP (source, lang)")
def build_report(t, spark):
    return _segs(t).rollup("source", "lang").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("lines"))


@query(f"WITH {WRD}, c AS (SELECT word, count(*) AS n FROM wrd GROUP BY word) SELECT word, n FROM c ORDER BY n DESC, word DESC LIMIT 20")
def top_words(t, spark):
    return rp.top_k(_words(t), "word", 20)


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang = 'de' DESC, doc_id) AS r FROM documents) WHERE r = 1")
def preferred_first(t, spark):
    return rp.preferred_first(t("documents").select("source", "doc_id", "lang"), ["source"], F.col("lang") == "de", "doc_id").select("source", "doc_id")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':7'), o_orderkey LIMIT 100")
def hash_sample(t, spark):
    return rp.hash_sample(t("orders").select("o_orderkey"), "o_orderkey", 100)


@query("SELECT kind, sum(length(value)) AS bytes FROM (SELECT 'text' AS kind, text AS value FROM documents UNION ALL SELECT 'url', url FROM pages UNION ALL SELECT 'turn', text FROM conversations) GROUP BY kind")
def size_report(t, spark):
    one = lambda k, name, c: t(name).select(F.lit(k).alias("kind"), F.length(c).cast("long").alias("b"))
    return one("text", "documents", "text").unionByName(one("url", "pages", "url")).unionByName(one("turn", "conversations", "text")).groupBy("kind").agg(F.sum("b").alias("bytes"))


# ---- sets and tables ------------------------------------------------------------------------------------------

@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(t, spark):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@query("SELECT source, n, row_number() OVER (ORDER BY o, n) AS pos FROM (SELECT 'orders' AS source, 0 AS o, o_orderkey AS n FROM orders UNION ALL SELECT 'customers', 1, c_custkey FROM customer)")
def union_numbered(t, spark):
    return rp.union_numbered(["n"], orders=t("orders").select(F.col("o_orderkey").alias("n")), customers=t("customer").select(F.col("c_custkey").alias("n")))


@query(f"WITH {SEG} SELECT doc_id, content, min(seq) AS seq FROM seg GROUP BY ALL")
def ordered_distinct(t, spark):
    return rp.ordered_distinct(_segs(t), ["doc_id", "content"], "seq")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, -o_custkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def insert_ignore(t, spark):
    o = t("orders").select("o_orderkey", "o_custkey")
    twice = o.filter("o_orderkey % 2 = 0").unionByName(o.filter("o_orderkey % 2 = 0").withColumn("o_custkey", F.col("o_custkey") + 5))
    return rp.insert_ignore(twice, o.filter("o_orderkey % 3 = 0").withColumn("o_custkey", -F.col("o_custkey")), ["o_orderkey"], ["o_custkey"])


@query("SELECT o_orderkey, -o_custkey AS o_custkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def insert_replace(t, spark):
    o = t("orders").select("o_orderkey", "o_custkey")
    twice = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.explode(F.array(-F.col("o_custkey") - 1, -F.col("o_custkey"))).alias("o_custkey"))
    return rp.insert_replace(o.filter("o_orderkey % 2 = 0"), twice, ["o_orderkey"], ["o_custkey"])


@query("SELECT p_size, p_partkey, p_brand, p_type, p_name FROM part")
def compact_round_trip(t, spark):
    p = t("part").select("p_size", "p_partkey", "p_brand", "p_type", "p_name")
    chunks, dicts = rp.compact(p, ["p_size"], ["p_brand", "p_type"], ["p_partkey"])
    return rp.restore(chunks, dicts, ["p_size"], ["p_brand", "p_type"], p.columns)


@query("WITH a AS (SELECT p_partkey % 50 AS k, p_brand FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey % 50 AS k, p_brand FROM part WHERE p_partkey % 4 <> 0) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b, true AS same_schema")
def table_difference(t, spark):
    """As multisets: how many rows only one side has."""
    side = lambda cond: t("part").filter(cond).select((F.col("p_partkey") % 50).alias("k"), "p_brand")
    return rp.tables_equal(side("p_partkey % 3 <> 0"), side("p_partkey % 4 <> 0"))


@query("SELECT count(*) AS rows_changed FROM (SELECT source FROM documents GROUP BY source HAVING bool_or(lang = 'es'))")
def incremental_changes(t, spark):
    d = t("documents").select("source", "text", "lang")
    built = d.filter("lang <> 'es'").groupBy("source").agg(st.content_hash("text").alias("hash"))
    return st.rebuild_changed(d, built, "source", "text").agg(F.count("*").alias("rows_changed"))


# ---- windows ------------------------------------------------------------------------------------------------------

_O = "o AS (SELECT o_custkey AS k, o_orderkey AS i, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS m FROM orders)"


def _marks(t) -> DataFrame:
    return t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey")).alias("m"))


@query(f"WITH {_O} SELECT k, i, last_value(m IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS m FROM o")
def forward_fill(t, spark):
    return sq.forward_fill(_marks(t), "m", ["k"], ["i"])


@query(f"WITH {_O} SELECT k, i, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(m IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS m FROM o")
def fill_both_ways(t, spark):
    return sq.fill_both(_marks(t), "m", ["k"], ["i"])


@query(f"WITH {SEG} SELECT doc_id, seq, CAST(coalesce(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM seg")
def cumulative_before(t, spark):
    return sq.cumulative_before(_segs(t).withColumn("n", F.length("content")), "n", ["doc_id"], ["seq"], "before").select("doc_id", "seq", "before")


@query(f"WITH {EV} SELECT event_id, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us + 1000000) - us AS length FROM ev")
def unit_ends(t, spark):
    e = _micros(t).withColumn("start", F.struct("us", "event_id"))
    return sq.ends_at_next(e, "start", ["user_id"], F.struct((F.col("us") + 1000000).alias("us"), "event_id")).select("event_id", (F.col("end.us") - F.col("us")).alias("length"))


@query("WITH o AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderkey * 7919 % 1000 AS m FROM orders), f AS (SELECT *, coalesce(m > max(m) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS kept FROM o) SELECT k, i, kept, CAST(sum(CAST(kept AS INT)) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS grp FROM f")
def increasing_markers(t, spark):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") * 7919 % 1000).alias("m"))
    return sq.increasing_markers(o, "m", ["k"], ["i"]).select("k", "i", "kept", "grp")


@query("WITH d AS (SELECT DISTINCT l_suppkey AS k, l_partkey // 4 AS p FROM lineitem), g AS (SELECT *, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM d) SELECT k, min(p) AS first, max(p) AS last, count(*) AS n FROM g GROUP BY k, g")
def gaps_and_islands(t, spark):
    d = t("lineitem").select(F.col("l_suppkey").alias("k"), F.floor(F.col("l_partkey") / 4).alias("p"))
    return sq.islands(sq.dealt(d, "k").distinct(), "p", ["k"])


_SPANS = "iv AS (SELECT user_id, us AS s, us + event_id % 60 * 60000000 AS e FROM ev), f AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 1000000 THEN 0 ELSE 1 END AS o FROM iv), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f), merged AS (SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY user_id, g)"


def _merged(t) -> DataFrame:
    iv = _micros(t).select("user_id", F.col("us").alias("start"), (F.col("us") + F.col("event_id") % 60 * 60000000).alias("end"))
    return sq.merge_intervals(iv, ["user_id"], 1000000)


@query(f"WITH {EV}, {_SPANS} SELECT user_id, s AS start, e AS \"end\", n FROM merged")
def merge_intervals(t, spark):
    return _merged(t)


@query(f"WITH {EV}, {_SPANS} SELECT user_id, s AS start, CAST(coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM merged")
def stitched_timeline(t, spark):
    return sq.stitched(_merged(t), ["user_id"]).select("user_id", "start", "offset")


@query(f"WITH {SEG} SELECT doc_id, seq, CAST(((row_number() OVER (PARTITION BY doc_id ORDER BY seq)) * 3 - 1) // count(*) OVER (PARTITION BY doc_id) AS INT) AS slot FROM seg")
def proportional_share(t, spark):
    return sq.proportional_share(_segs(t).select("doc_id", "seq"), ["doc_id"], ["seq"], 3)


@query(f"WITH {EV}, m AS (SELECT user_id, us, CASE WHEN event_type = 'click' THEN 'start' ELSE 'end' END AS kind FROM ev WHERE event_type IN ('click', 'view')), n AS (SELECT *, lead(kind) OVER w AS k, lead(us) OVER w AS e FROM m WINDOW w AS (PARTITION BY user_id ORDER BY us, kind)) SELECT user_id, us AS start, e AS \"end\" FROM n WHERE kind = 'start' AND k = 'end'")
def silence_spans(t, spark):
    e = _micros(t).filter("event_type IN ('click', 'view')")
    return sq.silence_spans(e.select("user_id", F.col("us").alias("at"), F.when(F.col("event_type") == "click", "start").otherwise("end").alias("kind")), ["user_id"])


@query(f"WITH {EV}, {_SPANS}, p AS (SELECT user_id, s, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s), e) - e AS pause FROM merged) SELECT user_id, s AS start, pause, CASE WHEN pause > 4000000 THEN pause - 1500000 ELSE 0 END AS skip FROM p")
def pause_rules(t, spark):
    p = sq.pauses(_merged(t).withColumnRenamed("end", "speech_end"), ["user_id"], F.col("speech_end"))
    return p.select("user_id", "start", "pause", sq.skip_rule(F.col("pause"), 1500000, 4000000).cast("long").alias("skip"))


@query("""WITH c AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents),
d AS (SELECT source, unnest(range(1, 7)) AS day FROM (SELECT DISTINCT source FROM documents))
SELECT d.source, CAST(d.day AS INT) AS day, CAST(arg_min(c.i, CAST(abs(c.cum * 7 - d.day * c.total) AS BIGINT) * 100000 + c.i) AS INT) AS cut FROM d JOIN c ON c.source = d.source GROUP BY ALL""")
def portion_plan(t, spark):
    return sq.portions(t("documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 7)


# ---- text ---------------------------------------------------------------------------------------------------------

@query(f"WITH {WRD} SELECT {_fold('word')} AS key, count(*) AS n, count(DISTINCT word) AS forms FROM wrd GROUP BY 1")
def folded_keys(t, spark):
    words = _words(t).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(tx.fold_latin(F.col("word")).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def cleaned_pages(t, spark):
    return t("pages").select("page_id", F.md5(tx.clean_html(F.col("html"))).alias("digest"))


@query(f"WITH {WRD} SELECT regexp_extract(word, '^([^\\p{{L}}\\p{{N}}]*)', 1) AS lead, regexp_extract(word, '([^\\p{{L}}\\p{{N}}]*)$', 1) AS trail, count(*) AS n FROM wrd WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]') GROUP BY 1, 2")
def split_words(t, spark):
    w = _words(t).filter(F.col("word").rlike(r"[\p{L}\p{N}]")).withColumn("s", tx.split_word(F.col("word")))
    return w.groupBy(F.col("s.lead").alias("lead"), F.col("s.trail").alias("trail")).agg(F.count("*").alias("n"))


@query(r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \n\t]+', ' ', 'g')) AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 90 THEN rtrim(substr(x, 1, 88)) || '…' ELSE x END AS snippet FROM f")
def snippets(t, spark):
    return t("documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query("""SELECT n, replace(substr('ΡΣΤΥΦΧΨΩϠ', n // 100 % 10, CASE WHEN n // 100 % 10 > 0 THEN 1 ELSE 0 END) || substr('ΙΚΛΜΝΞΟΠϞ', n // 10 % 10, CASE WHEN n // 10 % 10 > 0 THEN 1 ELSE 0 END) || substr('ΑΒΓΔΕϚΖΗΘ', n % 10, CASE WHEN n % 10 > 0 THEN 1 ELSE 0 END), 'Ϛ', 'ΣΤ') || 'ʹ' AS numeral, c AS docs
FROM (SELECT CAST(doc_id % 999 + 1 AS INT) AS n, count(*) AS c FROM documents GROUP BY 1)""")
def numerals(t, spark):
    d = t("documents").groupBy((F.col("doc_id") % 999 + 1).cast("int").alias("n")).agg(F.count("*").alias("docs"))
    return d.join(tx.numeral_dim(spark), "n").select("n", "numeral", "docs")


@query("SELECT doc_id, CAST(doc_id % 50 + 1 AS INT) AS c1, '3' AS f1, CAST(doc_id % 50 + 1 AS INT) AS c2, CAST(doc_id % 50 + 2 AS INT) AS c3, 3 AS pieces FROM documents")
def place_specs(t, spark):
    c = F.col("doc_id") % 50 + 1
    spec = F.concat(c.cast("string"), F.lit(".3-7,9,"), (c + 1).cast("string"), F.lit(".12a"))
    p = t("documents").select("doc_id", tx.parse_spec(spec).alias("p"))
    return p.select("doc_id", F.col("p")[0]["chapter_from"].alias("c1"), F.col("p")[0]["from"].alias("f1"), F.col("p")[1]["chapter_to"].alias("c2"), F.col("p")[2]["chapter_from"].alias("c3"), F.size("p").alias("pieces"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 1 AS INT) AS day, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)) AS INT) AS span FROM orders")
def plan_days(t, spark):
    day = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", tx.day_of(F.lit("1992-01-01").cast("date"), day).alias("day"), tx.span_days(F.lit(2), F.lit("months"), day).cast("int").alias("span"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' WHEN 'R' THEN 'returned' END || '/' || CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS labels FROM lineitem")
def decoded_tags(t, spark):
    scheme = spark.createDataFrame([(0, "A", "accepted"), (0, "N", "none"), (0, "R", "returned"), (1, "O", "open"), (1, "F", "filled")], "pos int, char string, label string")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("tag"))
    return tx.decode_tags(rows, "tag", scheme, 2).select("l_orderkey", "l_linenumber", F.array_join("tag_labels", "/").alias("labels"))


@query("SELECT p_partkey, translate(p_brand, 'abdnr#', 'αβδνρ·') AS spelled FROM part")
def transliterated(t, spark):
    letters = spark.createDataFrame(list(zip("abdnr#", "αβδνρ·", strict=True)), "char string, to string")
    return tx.transliterate(t("part").select("p_partkey", "p_brand"), "p_brand", letters).select("p_partkey", "spelled")


@query(f"WITH {SEG}, h AS (SELECT doc_id, seq, list_filter(regexp_split_to_array(content, '\\s+'), lambda x: regexp_matches(x, '\\p{{L}}')) AS w, len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{Ll}}') AND length(regexp_replace(x, '\\P{{L}}', '', 'g')) >= 2)) >= 2 AND len(list_filter(w, lambda x: (regexp_matches(x, '\\p{{Ll}}') OR length(regexp_replace(x, '\\P{{L}}', '', 'g')) < 2) AND length(regexp_replace(x, '\\P{{L}}', '', 'g')) > 2)) = 0 AS caps FROM seg) SELECT doc_id, CAST(count(*) FILTER (caps) AS BIGINT) AS headings, count(*) AS lines FROM h GROUP BY doc_id")
def caps_headings(t, spark):
    return _segs(t).groupBy("doc_id").agg(F.count_if(tx.is_caps_heading(F.col("content"))).alias("headings"), F.count("*").alias("lines"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '”\s*“', ' ', 'g'), '([“‘«(])[ \t]+', '\1', 'g'), '[ \t]+([”»)])', '\1', 'g'), '\s+([,.;:!?’])', '\1', 'g'), ' {2,}', ' ', 'g'))) AS digest FROM documents")
def tidied(t, spark):
    return t("documents").select("doc_id", F.md5(tx.tidy_punct(F.col("text"))).alias("digest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(t, spark):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# ---- segments and readers --------------------------------------------------------------------------------------------

@query(f"WITH {WRD} SELECT doc_id, seq, count(*) AS n_words FROM wrd GROUP BY ALL")
def segment_words(t, spark):
    return _words(t).groupBy("doc_id", "seq").agg(F.count("*").alias("n_words"))


@query("WITH c AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) SELECT conv_id, turn, CAST(part AS BIGINT) AS part, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn) AS para, role || ' (' || k || ')' AS label FROM c")
def dialogue_parts(t, spark):
    return co.segment_dialogue(t("conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").drop("role")


@query(f"WITH {SEG}, g AS (SELECT *, sum(CASE WHEN regexp_matches(content, '^[a-z]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS line FROM seg) SELECT doc_id, CAST(line AS BIGINT) AS line, md5(string_agg(content, ' ' ORDER BY seq)) AS digest FROM g GROUP BY doc_id, line")
def stitched_lines(t, spark):
    return co.stitch_continuations(_segs(t).select("doc_id", "seq", "content"), "^[a-z]").select("doc_id", "line", F.md5("content").alias("digest"))


@query(f"WITH {SEG}, b AS (SELECT doc_id, bool_or(regexp_matches(content, '###')) AS bad FROM seg GROUP BY doc_id) SELECT s.doc_id, count(*) AS lines FROM seg s JOIN b USING (doc_id) WHERE NOT bad GROUP BY s.doc_id")
def clean_groups(t, spark):
    return co.drop_slipped_groups(_segs(t), ["doc_id"], F.col("content").contains("###")).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(r"SELECT page_id, CAST(len(regexp_extract_all(html, '<p>([^<]*)<', 1)) AS BIGINT) AS n, CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, '<p>([^<]*)<', 1), lambda x: length(x))), 0) AS BIGINT) AS chars FROM pages WHERE html LIKE '%<p>%'")
def html_rows(t, spark):
    rows = rd.extract_rows(t("pages"), "page_id", "html", "<p", {"body": "^"})
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("body")).cast("long").alias("chars"))


@query(f"WITH {SEG}, n AS (SELECT *, CASE WHEN seq % 5 = 2 THEN seq END AS m FROM seg) SELECT doc_id, seq, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 1) AS line, CASE WHEN seq < 2 THEN 'title: x' ELSE 'x' END AS note FROM n")
def numbered_notes(t, spark):
    marked = _segs(t).select("doc_id", "seq", F.when(F.col("seq") % 5 == 2, F.concat(F.col("seq").cast("string"), F.lit(". x"))).otherwise(F.lit("x")).alias("note"))
    return rd.numbered_notes(marked, "doc_id", "seq", "note", "title: ").select("doc_id", "seq", "line", "note")


# ---- alignment --------------------------------------------------------------------------------------------------------

@query("SELECT conv_id, turn AS pair, 0 AS crossings FROM conversations WHERE false")
def alignment_crossings(t, spark):
    """Aligned neighbour turns never cross: the result is empty."""
    w = _turn_words(t).withColumn("grp", F.concat_ws("/", "conv_id", "turn")).withColumn("key", tx.fold_latin(F.col("word"))).filter("key <> ''")
    nxt = w.withColumn("grp", F.concat_ws("/", "conv_id", (F.col("turn") - 1).cast("string")))
    pairs = al.longest_runs(w, nxt, "grp", "key")
    x = pairs.withColumn("last_b", F.max("b").over(Window.partitionBy("grp").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))).filter("b <= last_b")
    return x.groupBy("grp").agg(F.count("*").alias("crossings")).select(F.split("grp", "/")[0].cast("long").alias("conv_id"), F.split("grp", "/")[1].cast("long").alias("pair"), F.col("crossings").cast("int"))


@query(f"""WITH {WRD}, a AS (SELECT doc_id || '/' || seq AS line, word_index AS i, word, sum(length(word)) OVER (PARTITION BY doc_id, seq ORDER BY word_index) AS e FROM wrd), h AS (SELECT doc_id || '/' || seq AS line, string_agg(word, '' ORDER BY word_index) AS s FROM wrd GROUP BY 1),
b AS (SELECT line, k AS i, k * 5 AS s0, least((k + 1) * 5, length(s)) AS s1 FROM (SELECT line, s, unnest(range(0, (length(s) + 4) // 5)) AS k FROM h)), m AS (SELECT a.line, a.i AS a, b.i AS b FROM a JOIN b ON a.line = b.line AND a.e - length(a.word) < b.s1 AND b.s0 < a.e),
n AS (SELECT *, count(*) OVER (PARTITION BY line, a) AS na, count(*) OVER (PARTITION BY line, b) AS nb FROM m) SELECT line, a, b, CASE WHEN na = 1 AND nb = 1 THEN 'exact' WHEN nb = 1 THEN 'split' WHEN na = 1 THEN 'joined' ELSE 'mixed' END AS match FROM n""")
def regrouped_words(t, spark):
    a = _words(t).select(F.concat_ws("/", "doc_id", "seq").alias("line"), F.col("word_index").alias("i"), "word")
    whole = a.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), "").alias("s"))
    fives = whole.select("line", F.posexplode(F.regexp_extract_all("s", F.lit("(?s).{1,5}"), F.lit(0))).alias("i", "word"))
    return al.regroup(a, fives, "line")


# ---- views ---------------------------------------------------------------------------------------------------------------

@query("SELECT r_name, n_name, count(c_custkey) AS customers, CAST(coalesce(sum(c_acctbal > 0), 0) AS BIGINT) AS in_credit FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def library_listing(t, spark):
    c = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 0).alias("in_credit"))
    j = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left")
    return j.select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("in_credit", F.lit(0)).alias("in_credit"))


@query("SELECT doc_id, source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_doc FROM documents")
def next_place(t, spark):
    return sq.next_of(t("documents").select("doc_id", "source"), ["source"], ["doc_id"], "doc_id", "next_doc")


@query(f"WITH {SEG}, {_PASSAGES} SELECT s.doc_id, s.seq, length(s.content) AS chars, count(n.s) AS notes, l.quality FROM seg s LEFT JOIN note n ON s.doc_id = n.doc_id AND s.seq BETWEEN n.s AND n.e LEFT JOIN labels l ON s.doc_id = l.doc_id GROUP BY ALL")
def book_page(t, spark):
    cover = li.count_cover(_segs(t).select("doc_id", F.col("seq").alias("pos"), F.length("content").alias("chars")), _passages(t)[1], ["doc_id"])
    return cover.join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.col("pos").alias("seq"), "chars", F.col("n_cover").alias("notes"), "quality")


# ---- streams ------------------------------------------------------------------------------------------------------------------

@query("SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY ALL")
def stream_latest_place(t, spark):
    out = st.drain(st.latest_place(st.read_events(spark, t.dir), ["user_id", "event_type"]), new_path(spark, "stream"), "update")
    last = out.groupBy("user_id", "event_type").agg(F.max_by(F.struct("ts", "value"), "epoch").alias("m"))
    return last.select("user_id", "event_type", "m.ts", "m.value")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, g")
def activity_spans(t, spark):
    return st.activity_spans(t("events"), ["user_id"], "30 minutes")


@query("WITH m AS (SELECT user_id, event_id % 20 AS day, ts, event_type <> 'error' AS done FROM events), l AS (SELECT user_id, day, arg_max(done, ts) AS last_done FROM m GROUP BY user_id, day) SELECT user_id, CAST(sum(CAST(last_done AS INTEGER)) AS BIGINT) AS n_done FROM l GROUP BY user_id")
def stream_plan_progress(t, spark):
    e = st.read_events(spark, t.dir).select("user_id", (F.col("event_id") % 20).cast("int").alias("day"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"), (F.col("event_type") != "error").alias("done"))
    out = st.drain(st.plan_progress(e), new_path(spark, "stream"), "update")
    return out.groupBy("user_id").agg(F.max_by("n_done", "epoch").alias("n_done"))
