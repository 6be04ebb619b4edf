"""Registered queries of the text functions on distinct words, of sinks that are read back, and of streams that are drained."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import alignment as al
from tessera.operators import corpus as co
from tessera.operators import reports as rp
from tessera.operators import sequence as sq
from tessera.plans.registry import EV, SEG, WRD, _micros, _segs, _words, query
from tessera.sources import readers as rd
from tessera.sources import sinks
from tessera.store import materialize, new_path
from tessera.streaming import events as st

_LATIN, _GREEK = "abgdezhqiklmnoprstufwxyc", "αβγδεζηθικλμνοπρστυφωξψς"
_FORMS = f"{WRD}, forms AS (SELECT word, count(*) AS n FROM wrd GROUP BY word), greek AS (SELECT word, n, regexp_replace(replace(translate(strip_accents(lower(translate(word, '{_LATIN}', '{_GREEK}'))), 'ς', 'σ'), 'ß', ''), '[^α-ω]', '', 'g') AS key FROM forms)"


def _forms(t):
    """Distinct words with their count."""
    return _words(t).groupBy("word").agg(F.count("*").alias("n"))


def _spelled_greek(t):
    return _forms(t).withColumn("greek", F.translate("word", _LATIN, _GREEK))


def _composed(vowels: str) -> str:
    """Composed letters over the given vowels, with the vowels themselves."""
    return vowels + "".join(c for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in vowels)


# ---- text functions -----------------------------------------------------------------------------------------------

@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def normalized_texts(t, spark):
    """Decomposed and composed again."""
    return t("documents").select("doc_id", F.md5(tx.nfc(tx.nfd(F.col("text")))).alias("digest"))


@query(f"WITH {_FORMS} SELECT key, CAST(sum(n) AS BIGINT) AS n FROM greek GROUP BY key")
def greek_keys(t, spark):
    return _spelled_greek(t).groupBy(tx.fold_greek(F.col("greek")).alias("key")).agg(F.sum("n").alias("n"))


@query(f"WITH {_FORMS} SELECT CASE WHEN length(key) > 2 AND regexp_matches(key, '(εν|ιν)$') THEN left(key, length(key) - 1) ELSE key END AS key, CAST(sum(n) AS BIGINT) AS n FROM greek GROUP BY 1")
def loose_keys(t, spark):
    return _spelled_greek(t).groupBy(tx.loose_key(tx.fold_greek(F.col("greek"))).alias("key")).agg(F.sum("n").alias("n"))


@query(f"WITH {_FORMS} SELECT regexp_replace(strip_accents(lower(word)), '[^\\pL]', '', 'g') AS key, CAST(sum(n) AS BIGINT) AS n FROM forms GROUP BY 1")
def letter_keys(t, spark):
    """Letters alone; the elision signs that some keys lack are no letters of these texts, so both functions agree."""
    plain = _forms(t).select(tx.fold_letters(F.col("word")).alias("key"), tx.fold_no_elision(F.col("word")).alias("other"), "n")
    return plain.filter("key = other").groupBy("key").agg(F.sum("n").alias("n"))


@query(f"WITH {_FORMS} SELECT word, regexp_replace(word, '[^\\pL\\pN_’]', '', 'g') AS spelled, regexp_replace(word, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g') AS stripped, CASE WHEN word LIKE '%''' THEN left(word, length(word) - 1) || '’' ELSE word END AS elided, translate(word, 'àèìòùÀÈÌÒÙ', 'áéíóúÁÉÍÓÚ') AS acute FROM (SELECT replace(word, '’', '''') AS w0, replace(replace(word, '''', '’'), 'ʼ', '’') AS w1, word FROM forms) WHERE word NOT LIKE '%''%'")
def spellings(t, spark):
    w = F.col("word")
    f = _forms(t).filter(~w.contains("'"))
    return f.select("word", tx.spelled(w).alias("spelled"), tx.strip_edges(w).alias("stripped"), tx.norm_elision(w).alias("elided"), tx.acute(w).alias("acute"))


@query(f"WITH {_FORMS} SELECT CASE WHEN doc_id % 3 = 0 THEN lang || '’' WHEN doc_id % 3 = 1 THEN lang || '’' ELSE lang END AS elided, count(*) AS n FROM documents GROUP BY 1")
def elisions(t, spark):
    """Three signs of elision become one."""
    k = F.col("doc_id") % 3
    word = F.concat("lang", F.when(k == 0, "'").when(k == 1, "ʼ").otherwise(""))
    return t("documents").groupBy(tx.norm_elision(word).alias("elided")).agg(F.count("*").alias("n"))


@query(f"WITH {_FORMS} SELECT word, regexp_matches(lower(word), '[áéíóúàèìòù][^{_composed('aeiou')}]*$') AS accented FROM forms WHERE NOT regexp_matches(word, '[yỳýÿ]')")
def final_accents(t, spark):
    return _forms(t).filter(~F.col("word").rlike("[yỳýÿ]")).select("word", tx.has_final_accent(tx.nfd(F.col("word")), "aeiou").alias("accented"))


@query(f"WITH {_FORMS} SELECT word, translate(word, 'éáíóúèàìòùÉÁÍÓÚÈÀÌÒÙ', 'eaioueaiouEAIOUEAIOU') AS bare, upper(strip_accents(word)) AS upper FROM forms WHERE NOT regexp_matches(word, '[^\\x20-\\x7eáéíóúàèìòùâêîôûäëïöüñçÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ]')")
def dropped_marks(t, spark):
    """Acute and grave go, other marks stay; and capitals without any mark."""
    f = _forms(t).filter(~F.col("word").rlike(r"[^\x20-\x7eáéíóúàèìòùâêîôûäëïöüñçÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ]"))
    return f.select("word", tx.nfc(tx.drop_marks(tx.nfd(F.col("word")), "́̀")).alias("bare"), tx.monotonic_upper(F.col("word")).alias("upper"))


@query(f"WITH {_FORMS}, k AS (SELECT DISTINCT key FROM greek WHERE key <> '') SELECT key, CASE length(key) % 4 WHEN 0 THEN key WHEN 1 THEN key || 'ν' WHEN 2 THEN key || 'ς' ELSE left(key, length(key) - 1) END AS spelt FROM k")
def as_spelt(t, spark):
    """A form takes the final letters of another edition's key: the same, one more nu or sigma, or one letter less."""
    k = _spelled_greek(t).select(tx.fold_greek(F.col("greek")).alias("key")).distinct().filter("key <> ''")
    n = F.length("key") % 4
    other = F.when(n == 0, F.col("key")).when(n == 1, F.concat("key", F.lit("ν"))).when(n == 2, F.concat("key", F.lit("σ"))).otherwise(F.substr("key", F.lit(1), F.length("key") - 1))
    return k.select("key", tx.as_spelt(F.col("key"), other).alias("spelt"))


@query(f"WITH {_FORMS}, p AS (SELECT word, n FROM forms WHERE regexp_full_match(word, '[a-z]+')) SELECT word, CASE n % 3 WHEN 0 THEN word || 'à' WHEN 1 THEN upper(left(word, 1)) || substr(word, 2) || 'á' ELSE upper(left(word, 1)) || substr(word, 2) || 'à' END AS taken FROM p")
def taken_case(t, spark):
    """The guide is small, a capital before a stop, or a capital before an elision, which is no stop."""
    p = _forms(t).filter(F.col("word").rlike("^[a-z]+$"))
    guide = F.when(F.col("n") % 3 == 0, "guide").when(F.col("n") % 3 == 1, "Guide;").otherwise("Guide’")
    return p.select("word", tx.take_case_and_stop(F.concat("word", F.lit("à")), guide).alias("taken"))


@query("SELECT event_id, CAST(round(event_id / 8, 2) AS DOUBLE) AS at FROM events")
def rounded_times(t, spark):
    return tx.round_times(t("events").select("event_id", (F.col("event_id") / 8).alias("at")), ["at"])


@query(r"SELECT doc_id, 'the ' || lang || ' page of ' || source || ', see here.' AS cleaned FROM documents")
def cleaned_wiki(t, spark):
    """Mark-up of every kind around the same words."""
    parts = ("12. <!-- a note\n of two lines -->the ''", F.col("lang"), "''<ref name=x>cited {{in}} full</ref> [[Page one|page]] of <b>", F.col("source"), "</b>{{box|a={{inner|b}}}},<ref group=\"n\" />\t [[see]]  [http://x.org/y here].")
    return t("documents").select("doc_id", tx.clean_wiki(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).alias("cleaned"))


@query("SELECT doc_id, lang || ' é € “' || source || '” <b> λόγος Τύπος out of To' AS cleaned FROM documents")
def unescaped(t, spark):
    """References of every kind, and Latin letters inside Greek words."""
    said = F.concat("lang", F.lit(" &eacute; &#8364; &ldquo;"), "source", F.lit("&#x201D; &lt;b&gt; λόγoς Tύπoς out of To"))
    return t("documents").select("doc_id", tx.greek_letters(tx.unescape(said)).alias("cleaned"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'noun, third, plural' WHEN 'view' THEN 'verb, plural' ELSE NULL END AS labels FROM events""")
def ordered_tags(t, spark):
    """Tags of fixed length as words: only those with a known sign per place."""
    scheme = spark.createDataFrame([(0, "n", "noun"), (0, "v", "verb"), (1, "3", "third"), (2, "p", "plural")], "pos int, char string, label string")
    tag = F.when(F.col("event_type") == "click", "n3p").when(F.col("event_type") == "view", "v-p").otherwise("n3")
    return tx.decode_tags(t("events").select("event_id", tag.alias("tag")), "tag", scheme, 3).select("event_id", F.array_join("tag_labels", ", ").alias("labels"))


_ROBINSON = {"N-NSF": "noun, nominative, singular, feminine", "V-AAI-3S": "verb, aorist, active, indicative, 3rd person, singular", "V-2AAP-NSM": "verb, second aorist, active, participle, nominative, singular, masculine", "P-1GS": "personal pronoun, 1st person, genitive, singular", "S-1SNSM": "possessive pronoun, 1st person, singular possessor, nominative, singular, masculine", "ADV-C": "adverb, comparative", "N-PRI": "noun, proper name, indeclinable", "Q-X": "correlative or interrogative pronoun"}
_CATSS = {"V.AAI3S": "verb, aorist, active, indicative, 3rd person, singular", "V.PAPNSM": "verb, present, active, participle, nominative, singular, masculine", "N.DSF": "noun, dative, singular, feminine", "A.ASMC": "adjective, accusative, singular, masculine, comparative", "C+RP.NS": "conjunction + personal pronoun, nominative, singular", "N": "noun, proper name, indeclinable", "P": "preposition", "V.FMN": "verb, future, middle, infinitive"}
_case = lambda codes: " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(codes.values()))


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(_ROBINSON)} {_case(_ROBINSON)} END AS labels FROM orders")
def robinson_codes(t, spark):
    codes = F.array(*map(F.lit, _ROBINSON))
    rows = t("orders").select("o_orderkey", F.get(codes, (F.col("o_orderkey") % len(_ROBINSON)).cast("int")).alias("code"))
    return tx.decode_robinson(rows, "code").select("o_orderkey", F.array_join("code_labels", ", ").alias("labels"))


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(_CATSS)} {_case(_CATSS)} END AS labels FROM orders")
def catss_codes(t, spark):
    codes = F.array(*map(F.lit, _CATSS))
    rows = t("orders").select("o_orderkey", F.get(codes, (F.col("o_orderkey") % len(_CATSS)).cast("int")).alias("code"))
    return tx.decode_catss(rows, "code").select("o_orderkey", F.array_join("code_labels", ", ").alias("labels"))


@query(r"WITH " + SEG + r""", p AS (SELECT doc_id, seq, unnest(a) AS part, generate_subscripts(a, 1) - 1 AS i FROM (SELECT doc_id, seq, string_split(regexp_replace(content, '([.;·!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM seg)),
o AS (SELECT *, sum(CASE WHEN length(regexp_replace(part, '[^\pL]', '', 'g')) < 6 AND i > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, seq ORDER BY i) - 1 AS piece FROM p) SELECT doc_id, seq, CAST(piece AS BIGINT) AS piece, string_agg(part, ' ' ORDER BY i) AS text FROM o GROUP BY doc_id, seq, piece""")
def sentence_pieces(t, spark):
    return co.sentences(_segs(t))


# ---- sinks, read back -------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def written_table(t, spark):
    """A table written by partition, twice over, and read back."""
    path = new_path(spark, "table")
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    for rows in (c.filter("c_custkey < 5"), c):
        sinks.write_table(rows, path, ["c_nationkey"], ["c_custkey"])
    return spark.read.parquet(path).select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 5 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS v FROM customer")
def overwritten_slices(t, spark):
    """Every fifth nation's slice is replaced, the others stay."""
    path = new_path(spark, "slices")
    c = t("customer").select("c_custkey", F.col("c_custkey").alias("v"), "c_nationkey")
    sinks.write_table(c, path, ["c_nationkey"])
    sinks.overwrite_slice(c.filter("c_nationkey % 5 = 0").withColumn("v", F.col("v") + 1000000), path, ["c_nationkey"])
    return spark.read.parquet(path).select("c_custkey", "c_nationkey", "v")


@query("SELECT '' || o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders")
def exported_lines(t, spark):
    """Tab-separated lines, a null as an empty field."""
    path = new_path(spark, "tsv")
    sinks.export_tsv(t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))), path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("key"), parts[1].alias("priority"))


@query("SELECT 'B' || l_suppkey AS book, CAST(l_linenumber AS INT) AS c, CAST(l_partkey AS INT) AS v, l_returnflag || ' ' || l_linestatus AS text FROM lineitem")
def verse_lines(t, spark):
    """Verses written a line each, with lines that are none between them."""
    path = new_path(spark, "vpl")
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("B"), s("l_suppkey"), F.lit(" "), s("l_linenumber"), F.lit(":"), s("l_partkey"), F.lit(" "), "l_returnflag", F.lit(" "), "l_linestatus")
    t("lineitem").select(F.explode(F.array(line, F.lit("# no verse"))).alias("value")).write.text(path)
    return rd.read_vpl(spark, path)


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS note, NULL::BIGINT AS score FROM nation")
def evolved_nations(t, spark):
    return rp.evolve_schema(t("nation").select("n_nationkey", "n_name"), {"n_name": "string", "note": "string", "score": "bigint"})


@query("SELECT l_returnflag, count(*) AS n, true AS same, false AS changed FROM lineitem GROUP BY 1")
def content_versions(t, spark):
    """A version doesn't depend on the order of rows, and differs where one value does."""
    out = None
    for flag in "ANR":
        rows = t("lineitem").filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber", "l_shipdate")
        v = lambda df, name: rp.content_version(df, df.columns).select(F.lit(flag).alias("l_returnflag"), F.col("version").alias(name), F.col("n").alias(f"n_{name}"))  # noqa: B023, E731
        other = rows.withColumn("l_linenumber", F.when(F.col("l_orderkey") == rows.agg(F.min("l_orderkey")).first()[0], F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")))
        one = v(rows, "a").join(v(rows.repartition(5).sortWithinPartitions(F.desc("l_shipdate")), "b"), "l_returnflag").join(v(other, "c"), "l_returnflag")
        out = one if out is None else out.unionByName(one)
    return out.select("l_returnflag", F.col("n_a").alias("n"), (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("changed"))


# ---- sequences ---------------------------------------------------------------------------------------------------------

@query("WITH p AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT k, i, 'w' || i AS value FROM p")
def swapped_pairs(t, spark):
    """Every other pair of neighbours has each other's value, and takes its own back."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    p = t("orders").select(F.col("o_custkey").alias("k"), F.row_number().over(w.orderBy("o_orderkey")).alias("i"), F.count("*").over(w).alias("n"))
    to = F.when((F.col("i") % 4 == 1) & (F.col("i") < F.col("n")), F.col("i") + 1).when(F.col("i") % 4 == 2, F.col("i") - 1).otherwise(F.col("i"))
    name = lambda c: F.concat(F.lit("w"), c.cast("string"))
    return sq.swap_pairs(p.withColumn("label", name(F.col("i"))).withColumn("value", name(to)), "label", "value", ["k"], "i").select("k", "i", "value")


@query("SELECT o_custkey AS k, o_orderkey AS i, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS verse FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 9 END AS v FROM orders)")
def reflowed(t, spark):
    """Without sentence ends a word goes with the verse before it, else with the first after."""
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 9)).alias("own"), F.lit(False).alias("stop"))
    return al.reflow(o, "k", "own", "i", "stop").select("k", "i", "verse")


# ---- streams ------------------------------------------------------------------------------------------------------------

@query("SELECT event_id, CASE WHEN value < 10 THEN 'low' ELSE 'high' END AS unit FROM events WHERE value >= 0")
def stream_enriched(t, spark):
    units = spark.createDataFrame([(0.0, 10.0, "low"), (10.0, 1e300, "high")], "start double, until double, unit string")
    every = materialize(t("events").select("user_id").distinct().join(F.broadcast(units)), "units")  # two rows a user
    return st.drain(st.enrich(st.read_events(spark, t.dir), every, ["user_id"]).select("event_id", "unit"), new_path(spark, "stream")).select("event_id", "unit")


@query(f"""WITH {EV}, m AS (SELECT user_id, event_id % 12 AS piece, us, event_id, event_type = 'error' AS gone FROM ev), l AS (SELECT user_id, piece, max(us * 1000 + event_id % 1000) AS r FROM m WHERE gone GROUP BY ALL)
SELECT m.user_id, m.piece, arg_min(event_id, us * 1000 + event_id % 1000) AS event_id FROM m LEFT JOIN l USING (user_id, piece) WHERE NOT gone AND (r IS NULL OR us * 1000 + event_id % 1000 > r) GROUP BY ALL""")
def stream_bookmarks(t, spark):
    """Adds and removals: the first add after a key's last removal."""
    e = _marks(st.read_events(spark, t.dir))
    out = st.drain(st.bookmarks(e, ["user_id", "piece"]), new_path(spark, "stream"), "update")
    last = out.groupBy("user_id", "piece").agg(F.max_by("event_id", "epoch").alias("event_id"))
    return last.filter("event_id IS NOT NULL")


@query(f"""WITH {EV}, m AS (SELECT user_id, event_id % 12 AS piece, us, event_id, event_type = 'error' AS gone FROM ev), l AS (SELECT user_id, piece, max(us * 1000 + event_id % 1000) AS r FROM m WHERE gone GROUP BY ALL)
SELECT m.user_id, m.piece, arg_min(event_id, us * 1000 + event_id % 1000) AS event_id FROM m LEFT JOIN l USING (user_id, piece) WHERE NOT gone AND (r IS NULL OR us * 1000 + event_id % 1000 > r) GROUP BY ALL""")
def first_added(t, spark):
    return st.bookmarks(_marks(t("events")), ["user_id", "piece"]).filter("event_id IS NOT NULL")


def _marks(events):
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return events.select("user_id", (F.col("event_id") % 12).alias("piece"), (us * 1000 + F.col("event_id") % 1000).alias("at"), "event_id", (F.col("event_type") == "error").alias("removed"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, g")
def stream_spans(t, spark):
    e = st.read_events(spark, t.dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.drain(st.activity_spans(e, ["user_id"], "30 minutes", "36500 days"), new_path(spark, "stream"), "complete")
    return out.join(out.agg(F.max("epoch").alias("epoch")), "epoch").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH e AS (SELECT user_id, ts, to_seconds(60 * (1 + event_id % 9)) AS gap FROM events), o AS (SELECT *, max(ts + gap) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT *, sum(CASE WHEN ts <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o), s AS (SELECT user_id, min(ts) AS start, max(ts + gap) AS "end", count(*) AS n FROM g GROUP BY user_id, g)
SELECT * FROM s WHERE "end" <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 6 HOUR""")
def stream_closed_spans(t, spark):
    """Spans with a gap of every event's own, in append mode under a watermark of six hours: each is given out when it has ended, and its state goes."""
    e = st.read_events(spark, t.dir).withColumn("ts", F.col("ts").cast("timestamp"))
    gap = F.concat((1 + F.col("event_id") % 9).cast("string"), F.lit(" minutes"))
    out = st.drain(st.activity_spans(e, ["user_id"], gap, "6 hours"), new_path(spark, "stream"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT DISTINCT user_id, event_id % 12 AS piece FROM events WHERE event_type = 'click'")
def stream_first_adds(t, spark):
    """Adds alone: a key once within the watermark, which spans the table."""
    e = st.read_events(spark, t.dir).withColumn("ts", F.col("ts").cast("timestamp")).filter("event_type = 'click'").select("user_id", (F.col("event_id") % 12).alias("piece"), "ts")
    return st.drain(st.first_adds(e, ["user_id", "piece"], "3650 days"), new_path(spark, "stream")).select("user_id", "piece")


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS place FROM events WHERE value IS NOT NULL), u AS (SELECT user_id, event_id AS unit, CAST(floor(value) AS BIGINT) AS start, CAST(floor(value) AS BIGINT) + 1 + event_id % 7 * (event_id % 7) * (event_id % 7) AS until FROM events WHERE event_id % 3 = 0 AND value IS NOT NULL)
SELECT event_id, unit FROM e JOIN u USING (user_id) WHERE place >= start AND place < until""")
def stream_units(t, spark):
    """Positions against units of many lengths that overlap, several of a user: each meets those around it."""
    at = F.floor("value").cast("long")
    units = t("events").filter("event_id % 3 = 0 AND value IS NOT NULL").select("user_id", F.col("event_id").alias("unit"), at.alias("start"), (at + 1 + F.pow(F.col("event_id") % 7, 3).cast("long")).alias("until"))
    e = st.read_events(spark, t.dir).filter("value IS NOT NULL").select("user_id", "event_id", at.alias("value"))
    return st.drain(st.enrich(e, materialize(units, "units"), ["user_id"]).select("event_id", "unit"), new_path(spark, "stream")).select("event_id", "unit")


@query("""WITH m AS (SELECT user_id, event_id % 20 AS day, ts, event_type <> 'error' AS done FROM events), l AS (SELECT user_id, day, arg_max(done, ts) AS done FROM m GROUP BY ALL),
p AS (SELECT user_id, user_id % 25 - 1 AS today, count(*) FILTER (done) AS n_done, count(*) FILTER (done AND day >= 1 AND day < least(user_id % 25 - 1, 20)) AS in_time, count(*) FILTER (done AND day > user_id % 25 - 1) AS ahead FROM l GROUP BY user_id),
b AS (SELECT *, greatest(least(today, 20) - 1, 0) - in_time AS behind FROM p)
SELECT user_id, n_done, behind, ahead, CASE WHEN n_done >= 19 THEN 'finished' WHEN today < 1 THEN 'not started' WHEN today > 19 THEN 'ended' WHEN behind > 0 THEN 'behind' WHEN ahead > 0 THEN 'ahead' ELSE 'on schedule' END AS status FROM b""")
def stream_plan_status(t, spark):
    """Plans of 19 days on the day that the user's number says: status from the last mark of every day."""
    e = st.read_events(spark, t.dir).select("user_id", (F.col("event_id") % 20).cast("int").alias("day"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"), (F.col("event_type") != "error").alias("done"))
    out = st.drain(st.plan_status(st.plan_progress(e), F.col("user_id") % 25 - 1, F.lit(19)), new_path(spark, "stream"), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n_done", "behind", "ahead", "status"), "epoch").alias("m"))
    return last.select("user_id", "m.n_done", F.col("m.behind").cast("long").alias("behind"), F.col("m.ahead").cast("long").alias("ahead"), "m.status")


@query("SELECT user_id, CAST(sum(least(event_id % 1000, 400)) AS BIGINT) AS saved FROM events GROUP BY user_id")
def stream_saved(t, spark):
    p = st.read_events(spark, t.dir).select("user_id", (F.col("event_id") % 1000).alias("piece"), F.lit(400).cast("long").alias("remaining"))
    out = st.drain(st.saved_bytes(p, ["user_id"]), new_path(spark, "stream"), "update")
    return out.groupBy("user_id").agg(F.max_by("saved", "epoch").alias("saved"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_rebuilt(t, spark):
    """Slices of a table are built anew where the stream brought rows: a partition per type holds all of its rows."""
    path = new_path(spark, "rebuilt")
    st.rebuild_slices(st.read_events(spark, t.dir).select("event_id", "event_type"), path, "event_type", "event_id", new_path(spark, "checkpoint"))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
