"""Registered queries of the readers and text functions: marked-up texts are made from the tables by expressions, then read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import corpus as co
from tessera.operators import reports as rp
from tessera.plans.registry import SEG, WRD, _segs, _words, query
from tessera.sources import readers as rd
from tessera.store import materialize

#: A line as plain lower-case words: what can stand inside any mark-up.
_PLAIN = r"trim(regexp_replace(regexp_replace(lower(content), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"
PLAIN = f"plain AS (SELECT doc_id, seq, {_PLAIN} AS line FROM seg)"


def _plain(t):
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower("content"), "[^a-z ]", ""), " +", " "))
    return _segs(t).select("doc_id", "seq", line.alias("line"))


def _marked(t, mark, sep: str = " "):
    """doc_id, body: a text's plain lines, each after its mark."""
    rows = _plain(t).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("x"))
    return rows.select("doc_id", F.array_join(F.transform("x", lambda r: F.concat(mark(r["seq"]), r["line"])), sep).alias("body"))


# ---- readers ------------------------------------------------------------------------------------------------------

@query(f"WITH {SEG}, {PLAIN} SELECT doc_id, CAST(1 AS INT) AS c, CAST(seq + 1 AS INT) AS v, line AS text FROM plain WHERE line <> ''")
def inline_marks(t, spark):
    mark = lambda seq: F.concat(F.lit("1:"), (seq + 1).cast("string"), F.lit(" "))
    return rd.split_on_marks(_marked(t, mark), "doc_id", "body").filter("text <> ''")


@query(f"WITH {SEG}, {PLAIN} SELECT doc_id, CAST(seq AS INT) AS marker, CASE WHEN seq % 3 = 1 THEN '“said” ' ELSE '' END || line AS passage FROM plain")
def milestones(t, spark):
    """Milestones with quoted speech, and footnotes that hold a milestone of their own."""
    note = lambda seq: F.when(seq % 3 == 1, '<note n="1">see <milestone unit="line" n="99"/> there</note><q>said</q> ').otherwise("")
    mark = lambda seq: F.concat(F.lit('<milestone unit="line" n="'), seq.cast("string"), F.lit('"/>'), note(seq))
    flat = _marked(t, mark, "").withColumn("body", rd.flatten_notes(F.col("body")))
    p = rd.milestone_passages(flat, "doc_id", "body", r'<milestone unit="line" n="(\d+)"/>')
    return p.filter("marker IS NOT NULL").select("doc_id", F.col("marker").cast("int").alias("marker"), F.col("passage"))


@query(f"WITH {SEG}, {PLAIN} SELECT doc_id, CAST(CASE WHEN seq % 3 = 2 THEN 1000 + seq // 3 ELSE seq + 1 END AS BIGINT) AS section_no, line AS body FROM plain")
def wiki_sections(t, spark):
    """Every third heading has no number: those are counted from 1000."""
    mark = lambda seq: F.concat(F.lit("== "), F.when(seq % 3 == 2, F.lit("note")).otherwise((seq + 1).cast("string")), F.lit(" ==\n"))
    s = rd.split_sections(_marked(t, mark, "\n"), "doc_id", "body")
    return s.filter("section_no > 0").select("doc_id", F.col("section_no").cast("long").alias("section_no"), "body")


@query(f"WITH {SEG}, {PLAIN} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS line, line AS content, CASE WHEN seq % 5 = 0 THEN CAST(seq AS VARCHAR) END AS marker FROM plain WHERE line <> ''")
def poem_lines(t, spark):
    mark = lambda seq: F.when(seq % 5 == 0, F.concat(F.lit("{{r|"), seq.cast("string"), F.lit("}}"))).otherwise(F.lit(""))
    rows = _plain(t).filter("line <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: F.concat(mark(r["seq"]), r["line"])), "\n")
    return rd.poem_lines(rows.select("doc_id", F.concat(F.lit("<poem>\n"), text, F.lit("\n</poem>")).alias("body")), "doc_id", "body")


@query(f"""WITH {SEG}, {PLAIN}, k AS (SELECT *, sum(CASE WHEN seq % 12 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS book FROM plain), r AS (SELECT * FROM k WHERE seq % 12 <> 3 AND line <> '' AND book > 0), c AS (SELECT *, sum(CASE WHEN seq % 5 = 4 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, book ORDER BY seq) AS n FROM r)
SELECT doc_id, CAST(book AS BIGINT) AS book, CAST(n AS BIGINT) AS line, string_agg(CASE WHEN seq % 5 = 4 THEN '[' || line || ']' ELSE line END, ' ' ORDER BY seq) AS content, max(CASE WHEN seq % 4 = 0 AND seq % 5 <> 4 THEN seq END) AS printed FROM c WHERE n > 0 GROUP BY doc_id, book, n""")
def volume_lines(t, spark):
    """Headings, continuations in brackets and numbers at line ends, put to the texts' lines."""
    seq, line = F.col("seq"), F.col("line")
    text = F.when(seq % 12 == 3, F.concat(F.lit("BOOK "), seq.cast("string"))).when(line == "", F.lit("  ")).when(seq % 5 == 4, F.concat(F.lit("["), line, F.lit("]"))).when(seq % 4 == 0, F.concat(line, F.lit("  "), seq.cast("string"))).otherwise(line)
    got = rd.read_volume(_plain(t).select("doc_id", "seq", text.alias("text")), "doc_id", "seq", "text")
    return got.select("doc_id", F.col("book").cast("long").alias("book"), F.col("line").cast("long").alias("line"), "content", "printed")


@query(f"""WITH {SEG}, {PLAIN}, k AS (SELECT *, seq % 10 = 2 AS head, (seq % 10 <> 2 AND (line = '' OR seq % 7 = 5)) AS blank FROM plain), p AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY seq) AS part FROM k),
h AS (SELECT doc_id, part, CASE WHEN part % 3 = 0 THEN 'Third' ELSE 'Part' END AS name, row_number() OVER (PARTITION BY doc_id, CASE WHEN part % 3 = 0 THEN 'Third' ELSE 'Part' END ORDER BY part) AS n FROM p WHERE head),
o AS (SELECT *, NOT blank AND NOT head AND coalesce(lag(blank OR head) OVER (PARTITION BY doc_id, part ORDER BY seq), true) AS opens FROM p), q AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id, part ORDER BY seq) AS para FROM o)
SELECT q.doc_id, q.seq, CAST(q.part AS BIGINT) AS part, CASE WHEN n > 1 THEN name || ' (' || n || ')' ELSE name END AS label, CAST(para AS BIGINT) AS para, CASE WHEN seq % 4 = 1 THEN 'PRIEST' END AS speaker, line AS content FROM q LEFT JOIN h ON h.doc_id = q.doc_id AND h.part = q.part WHERE NOT head AND NOT blank""")
def service_parts(t, spark):
    """Headings (two names in turn), blank lines and speakers, put to the texts' lines."""
    seq, line = F.col("seq"), F.col("line")
    rows = _plain(t)
    part = F.sum((seq % 10 == 2).cast("int")).over(Window.partitionBy("doc_id").orderBy("seq"))
    name = F.when(F.col("part0") % 3 == 0, "== Third").otherwise("== Part")
    text = F.when(seq % 10 == 2, name).when((line == "") | (seq % 7 == 5), F.lit(" ")).when(seq % 4 == 1, F.concat(F.lit("PRIEST: "), line)).otherwise(line)
    marked = rows.withColumn("part0", part).select("doc_id", "seq", text.alias("text"))
    got = rd.read_service(marked, "doc_id", "seq", "text")
    return got.select("doc_id", "seq", F.col("part").cast("long").alias("part"), "label", F.col("para").cast("long").alias("para"), "speaker", "content")


@query("SELECT 'p' || c_custkey AS page, 'p' || (c_custkey - c_custkey % 4) AS target FROM customer")
def redirect_targets(t, spark):
    k = F.col("c_custkey")
    text = F.when(k % 4 > 0, F.concat(F.lit("#REDIRECT [[p"), (k - 1).cast("string"), F.lit("]]"))).otherwise(F.lit("text"))
    return rd.resolve_redirects(t("customer").select(F.concat(F.lit("p"), k.cast("string")).alias("name"), text.alias("body")), "name", "body")


@query("SELECT conv_id, CAST(turn AS INT) AS id, role AS form FROM conversations")
def xml_words(t, spark):
    w = F.concat(F.lit('<w id="'), F.col("turn").cast("string"), F.lit('"><form>'), F.col("role"), F.lit("</form></w>"))
    s = t("conversations").groupBy("conv_id").agg(F.concat(F.lit("<s>"), F.array_join(F.collect_list(w), ""), F.lit("</s>")).alias("xml"))
    return rd.xml_rows(s, "xml", "w", "_id int, form string").select("conv_id", F.col("element._id").alias("id"), F.col("element.form").alias("form"))


@query("SELECT o_custkey AS key, arg_min(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1")
def first_definitions(t, spark):
    rows = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    return rd.first_definitions(rows, "key", "value", "o_orderkey")


@query("WITH s AS (SELECT o_custkey AS grp, o_orderkey AS start FROM orders WHERE o_orderkey % 3 = 0) SELECT o.o_custkey AS grp, o.o_orderkey AS pos, max(s.start) AS ref FROM orders o LEFT JOIN s ON o.o_custkey = s.grp AND s.start <= o.o_orderkey GROUP BY ALL")
def offset_slices(t, spark):
    o = t("orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("pos"))
    starts = o.filter("pos % 3 = 0").select("grp", F.col("pos").alias("start"), F.col("pos").alias("ref"))
    return rd.slice_by_offsets(o.withColumn("word", F.lit("")), starts).select("grp", "pos", "ref")


@query(f"WITH {SEG}, {PLAIN} SELECT p.doc_id, p.seq, w.line AS next_line FROM plain p JOIN plain w ON p.doc_id = w.doc_id AND p.seq + 1 = w.seq")
def zipped_columns(t, spark):
    p = _plain(t).withColumn("pos", F.struct("doc_id", "seq"))
    nxt = _plain(t).select(F.struct("doc_id", (F.col("seq") - 1).alias("seq")).alias("pos"), F.col("line").alias("next_line"))
    return rd.zip_by_position(p.select("pos", "doc_id", "seq"), nxt).select("doc_id", "seq", "next_line")


@query(f"WITH {SEG}, {PLAIN} SELECT CAST(doc_id AS VARCHAR) || '/' || seq AS place, CAST(0 AS INT) AS word_index, lang AS parse FROM plain JOIN documents USING (doc_id) WHERE seq % 2 = 0")
def parse_cache(t, spark):
    """Cached parses whose text has changed (here: of odd segments) are not used."""
    place = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("seq").cast("string"))
    segs = _plain(t).select(place.alias("place"), "doc_id", F.col("line").alias("content"), "seq")
    known = segs.join(t("documents").select("doc_id", "lang"), "doc_id")
    text = F.when(F.col("seq") % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("!")))
    cache = known.select(F.to_json(F.create_map("place", F.struct(text.alias("text"), F.create_map(F.lit("0"), "lang").alias("words")))).alias("doc"))
    return rd.read_parse_cache(cache, segs.select("place", "content"), "place", "doc")


@query("SELECT l_orderkey, l_linenumber, 'scholia ' || l_returnflag AS source, CAST(l_suppkey AS INT) AS book, CAST(l_linenumber AS INT) AS line, CAST(CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE l_linenumber + l_partkey % 4 END AS INT) AS line_to FROM lineitem")
def keyed_ranges(t, spark):
    """References "B.L-L" or "B.L-C.M": a range that leaves its book is clipped to its line."""
    s = lambda c: F.col(c).cast("string")
    to = F.when(F.col("l_partkey") % 3 == 0, F.concat((F.col("l_suppkey") + 1).cast("string"), F.lit(".9"))).otherwise((F.col("l_linenumber") + F.col("l_partkey") % 4).cast("string"))
    notes = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("volume"), F.concat(s("l_suppkey"), F.lit("."), s("l_linenumber"), F.lit("-"), to).alias("ref"))
    volumes = spark.createDataFrame([(v, f"scholia {v}") for v in "ANR"], "volume string, source string")
    return rd.keyed_notes(notes, "ref", volumes).select("l_orderkey", "l_linenumber", "source", "book", "line", "line_to")


@query("SELECT doc_id AS div, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, 'all' AS text FROM documents")
def catalogue_build(t, spark):
    return rd.build_corpus(spark, [{"type": "documents", "slug": "all", "path": f"{t.dir}/documents.parquet"}]).select("div", "seq", "text")


# ---- text functions -------------------------------------------------------------------------------------------------

@query(r"SELECT doc_id, md5(regexp_replace(text, '([A-Za-z0-9_])-\s*\n\s*([A-Za-z0-9_])', '\1\2', 'g')) AS digest FROM documents")
def dehyphenated(t, spark):
    return t("documents").select("doc_id", F.md5(tx.dehyphenate(F.col("text"))).alias("digest"))


@query("SELECT doc_id, seq, lang AS lemma, source AS note FROM (SELECT doc_id, lang, source, 0 AS seq FROM documents)")
def lemma_notes(t, spark):
    d = t("documents").select("doc_id", "lang", F.lit(0).alias("seq"), tx.split_lemma_note(F.concat("lang", F.lit("] "), "source")).alias("s"))
    return d.select("doc_id", "seq", "s.lemma", F.col("s.text").alias("note"))


@query(f"WITH {SEG}, {PLAIN} SELECT doc_id, seq, CASE WHEN seq % 2 = 0 THEN line ELSE seq || '. ' || line END AS text FROM plain")
def lead_numbers(t, spark):
    """A leading number goes if it is the row's own."""
    no = F.when(F.col("seq") % 2 == 0, F.col("seq") + 1).otherwise(F.col("seq"))
    p = _plain(t).withColumn("noted", F.concat(no.cast("string"), F.lit(". "), "line"))
    return p.select("doc_id", "seq", tx.drop_lead_number(F.col("noted"), F.col("seq") + 1).alias("text"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber + CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 9 ELSE 0 END AS INT) AS line_to FROM lineitem")
def range_phrases(t, spark):
    n = F.col("l_linenumber").cast("int")
    said = F.concat(F.lit("Vs. "), n.cast("string"), F.lit("-"), (n + F.col("l_partkey") % 9).cast("string"), F.lit(". words"))
    text = F.when(F.col("l_partkey") % 2 == 0, said).otherwise("words")
    return t("lineitem").select("l_orderkey", "l_linenumber", tx.range_phrase(text, n).cast("int").alias("line_to"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS label FROM orders")
def short_labels(t, spark):
    return t("orders").select("o_orderkey", tx.short_label(F.regexp_extract("o_orderpriority", r"^(\d+)", 1), F.col("o_orderkey")).alias("label"))


@query("SELECT conv_id, string_agg(role, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def styled_runs(t, spark):
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    runs = F.to_json(F.transform("x", lambda r: F.array(F.lit("plain"), r["role"])))
    return rows.select("conv_id", tx.runs_text(runs).alias("text"))


@query("WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, arg_max(lang, n * 1000 + ascii(lang) * 2 + ascii(substr(lang, 2))) AS best FROM n GROUP BY source")
def likeliest_key(t, spark):
    """The key with the greatest value; of equals, the greater key by its letters."""
    n = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    weight = F.col("n") * 1000 + F.ascii("lang") * 2 + F.ascii(F.substring("lang", 2, 1))
    return n.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", weight.alias("w")))).alias("m")).select("source", tx.argmax_key(F.col("m")).alias("best"))


@query("SELECT p_partkey, 1 AS prio, replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-') AS slug FROM part")
def name_slugs(t, spark):
    c = tx.name_candidates(F.regexp_replace("p_name", "[^A-Za-z0-9]+", " "))
    return t("part").select("p_partkey", F.inline(c)).filter("prio = 1")


@query("""WITH n AS (SELECT c_custkey, c_custkey % 4 AS k, lower(translate(n_name, ' _', '--')) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_custkey, CASE k WHEN 0 THEN s WHEN 1 THEN '2-' || s WHEN 2 THEN s END AS slug FROM n""")
def resolved_names(t, spark):
    """Names as they are, with an ordinal and filler words, by an alias, and unknown ones."""
    slug = F.translate(F.lower("n_name"), " _", "--")
    slugs = t("nation").select(F.explode(F.array(slug, F.concat(F.lit("2-"), slug))).alias("slug"))
    aliases = t("nation").select(F.concat(F.lit("old-"), slug).alias("name"), slug.alias("to"))
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("The  Second Book of "), "n_name")).when(k == 2, F.concat(F.lit("Old "), "n_name")).otherwise(F.concat(F.lit("New "), "n_name"))
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", name.alias("name"))
    return tx.resolve_names(rows, "name", slugs, aliases).select("c_custkey", "slug")


@query("""SELECT o_orderkey, 'Part ' || n || ' (' || upper(substr(stem, 1, 1)) || substr(stem, 2) || 'ον)' AS label FROM (SELECT o_orderkey, CAST(o_orderkey % 9 + 1 AS INT) AS n,
list_extract(['πρῶτ', 'δεύτερ', 'τρίτ', 'τέταρτ', 'πέμπτ', 'ἕκτ', 'ἕβδομ', 'ὄγδο', 'ἔνατ'], CAST(o_orderkey % 9 + 1 AS INT)) AS stem FROM orders)""")
def rendered_labels(t, spark):
    o = t("orders").select("o_orderkey", (F.col("o_orderkey") % 9 + 1).cast("int").alias("n"))
    met = o.join(F.broadcast(tx.ordinal_dim(spark)), "n").join(F.broadcast(tx.numeral_dim(spark, 9)), "n")  # fixed tables
    return met.select("o_orderkey", tx.render_label(F.lit("Part {n} ({nth})"), F.col("n"), F.col("numeral"), F.col("ordinal")).alias("label"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'predicate' WHEN 'error' THEN 'subject, coordinated' WHEN 'click' THEN 'object, in apposition' WHEN 'view' THEN 'xyz' END AS relation_label FROM events")
def relation_labels(t, spark):
    e = F.col("event_type")
    rel = F.when(e == "signup", "PRED").when(e == "error", "SBJ_CO").when(e == "click", "OBJ_AP").when(e == "view", "xyz").otherwise("")
    return tx.relation_label(t("events").select("event_id", rel.alias("rel")), "rel").select("event_id", "relation_label")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' ELSE 'R' END || ' open or ' || CASE l_linestatus WHEN 'O' THEN 'o' ELSE 'filled' END AS spelled FROM lineitem")
def spelled_readings(t, spark):
    abbr = spark.createDataFrame([("A", "accepted"), ("N", "none"), ("x", "open"), ("F", "filled"), ("O", "o")], "abbr string, words string")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.lit(" x; "), "l_linestatus").alias("r"))
    return tx.spell_readings(rows, "r", abbr).select("l_orderkey", "l_linenumber", "spelled")


@query(f"""WITH {WRD}, c AS (SELECT lower(word) AS key, word, count(*) AS n FROM wrd WHERE regexp_full_match(word, '[A-Za-z]+') GROUP BY ALL), f AS (SELECT key, word AS form FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, word) AS r FROM c) WHERE r = 1)
SELECT CASE WHEN regexp_full_match(word, '[A-Z]+') THEN CASE WHEN word_index = 0 THEN upper(form[1]) || form[2:] ELSE form END ELSE word END AS recased, count(*) AS n FROM wrd JOIN f ON lower(word) = key WHERE regexp_full_match(word, '[A-Za-z]+') GROUP BY 1""")
def recased_words(t, spark):
    w = _words(t).filter(F.col("word").rlike("^[A-Za-z]+$"))
    counts = materialize(w.groupBy("word", (F.col("word_index") == 0).alias("opening")).agg(F.count("*").alias("n")), "counts")
    best = counts.groupBy(F.lower("word").alias("key"), "word").agg(F.sum("n").alias("n")).groupBy("key").agg(F.min_by("word", F.struct(-F.col("n"), "word")).alias("form"))
    return tx.recase(counts, "word", F.lower("word"), best).groupBy("recased").agg(F.sum("n").alias("n"))


@query("WITH p AS (SELECT o_custkey AS k, o_orderkey AS i, o_orderkey // 8 AS d, o_orderkey % 8 AS r FROM orders), s AS (SELECT *, lag(d) OVER (PARTITION BY k ORDER BY i) AS b FROM p) SELECT k, string_agg(CASE WHEN b = d THEN CAST(r AS VARCHAR) ELSE d || '.' || r END, ',' ORDER BY i) AS label FROM s GROUP BY k")
def place_labels(t, spark):
    k = F.col("o_orderkey")
    p = t("orders").select(F.col("o_custkey").alias("k"), k.alias("i"), F.floor(k / 8).alias("div"), (k % 8).cast("string").alias("ref"))
    return tx.format_places(p, "k", "i")


@query("SELECT o_orderkey, CASE WHEN r = a THEN 1 WHEN r LIKE a || '_' AND regexp_matches(r, '[a-z]$') THEN 2 WHEN r LIKE a || '%' THEN 3 WHEN r LIKE '%' || a || '%' THEN 4 END AS rank FROM (SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE '' END AS r, CAST(o_custkey % 40 AS VARCHAR) AS a FROM orders)")
def place_ranks(t, spark):
    ref = F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise(""))
    return t("orders").select("o_orderkey", tx.place_match(ref, (F.col("o_custkey") % 40).cast("string")).alias("rank"))


@query("SELECT p_partkey, regexp_replace(lower(p_type), '[ \\t]', '', 'g') AS section FROM part")
def section_keys(t, spark):
    return t("part").select("p_partkey", tx.section_key(F.concat(F.lit("§ "), "p_type")).alias("section"))


# ---- predicates over segments -------------------------------------------------------------------------------------------

_BARE = "bare AS (SELECT doc_id, seq, w, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, seq, list_filter(string_split(translate(content, '()[]', '    '), ' '), lambda x: x <> '') AS w FROM seg))"


@query(rf"""WITH {SEG}, {_BARE} SELECT doc_id, seq, CAST(i AS BIGINT) AS word_index, word FROM bare
WHERE i % 7 <> 3 AND NOT (i % 11 = 4 AND (i + 1) % 7 <> 3 AND i + 1 < len(w)) AND NOT (i % 11 = 5 AND (i - 1) % 7 <> 3) AND regexp_matches(word, '\p{{L}}')""")
def unbracketed_words(t, spark):
    """Every seventh word from the fourth on stands in round brackets and two neighbours of eleven in square ones: they go, and the
    others keep their numbers.  Brackets of the texts themselves are taken out first."""
    w = F.filter(F.split(F.regexp_replace("content", r"[()\[\]]", " "), " "), lambda x: x != "")
    lines = _segs(t).select("doc_id", "seq", w.alias("w"))
    last = F.size("w") - 1  # (of the column: the split itself would be made anew for the words that ask)
    wrap = lambda x, i: F.when(i % 7 == 3, F.concat(F.lit("("), x, F.lit(")"))).when((i % 11 == 4) & ((i + 1) % 7 != 3) & (i < last), F.concat(F.lit("["), x)).when((i % 11 == 5) & ((i - 1) % 7 != 3), F.concat(x, F.lit("]"))).otherwise(x)
    marked = lines.select("doc_id", "seq", F.array_join(F.transform("w", wrap), " ").alias("content"))
    return co.numbered_words(marked).select("doc_id", "seq", F.col("word_index").cast("long").alias("word_index"), "word")


@query("SELECT conv_id, turn FROM conversations WHERE role IS DISTINCT FROM 'system' AND turn > 0")
def body_turns(t, spark):
    c = t("conversations").select("conv_id", "turn", F.col("turn").alias("seq"), F.when(F.col("role") == "system", "punctuation").alias("kind"))
    return co.body(co.real_words(c)).select("conv_id", "turn")


@query("SELECT doc_id, quality FROM labels WHERE toxic IS DISTINCT FROM 1")
def listed_only(t, spark):
    return co.listed(t("labels"), "toxic").select("doc_id", "quality")


@query(f"WITH {SEG}, n AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1), k AS (SELECT n.doc_id FROM n JOIN (SELECT doc_id, quality * 4 + 1 AS m FROM labels) l ON n.doc_id = l.doc_id AND n.n = l.m) SELECT doc_id, seq FROM seg WHERE doc_id IN (SELECT doc_id FROM k)")
def gated_groups(t, spark):
    target = t("labels").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("quality") * 4).cast("int"))).alias("line"))
    return co.gate_groups(_segs(t).select("doc_id", "seq"), target, "doc_id")


@query(f"WITH {SEG}, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (seq % 5 = 4 AND length(content) % 7 = 0) AS misplaced FROM seg GROUP BY 1) SELECT n.doc_id, n, CASE WHEN quality IS NULL THEN NULL ELSE quality * 4 + 1 END AS target_n, misplaced, coalesce(n = quality * 4 + 1 AND misplaced = 0, false) AS kept FROM n LEFT JOIN labels USING (doc_id)")
def gate_reports(t, spark):
    target = t("labels").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("quality") * 4).cast("int"))).alias("line"))
    off = (F.col("seq") % 5 == 4) & (F.length("content") % 7 == 0)
    return co.gate_report(_segs(t), target, "doc_id", off)


@query(f"WITH {SEG}, h AS (SELECT doc_id, lang AS content, -1 AS seq FROM documents UNION ALL SELECT doc_id, content, seq FROM seg) SELECT doc_id, seq, length(content) AS chars FROM h")
def headed_segments(t, spark):
    heads = t("documents").select("doc_id", F.col("lang").alias("content"))
    return co.insert_headings(_segs(t).select("doc_id", "seq", "content"), heads).select("doc_id", "seq", F.length("content").alias("chars"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 7 WHEN o_custkey % 5 = 1 THEN o_custkey + 100 ELSE o_custkey END AS o_custkey FROM orders")
def rehomed(t, spark):
    o = t("orders").select("o_orderkey", "o_custkey")
    k = F.col("o_custkey")
    rules = o.select("o_custkey").distinct().filter(k % 5 < 2).select("o_custkey", F.when(k % 5 == 0, 7).cast("long").alias("to"), F.when(k % 5 == 1, 100).alias("shift"))
    return co.rehome(o, rules, "o_custkey").select("o_orderkey", "o_custkey")


@query(f"WITH {WRD} SELECT CASE word WHEN 'the' THEN 'THE' WHEN 'und' THEN 'UND' ELSE word END AS word, count(*) AS n FROM wrd GROUP BY 1")
def corrected_words(t, spark):
    puts = spark.createDataFrame([("the", "THE"), ("und", "UND")], "word string, put string")
    return co.correct_words(_words(t), puts).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {SEG} SELECT doc_id, seq, CASE WHEN seq = 0 AND strpos(content, 'a') > 0 THEN left(content, strpos(content, 'a') - 1) || '@' || substr(content, strpos(content, 'a') + 1) ELSE content END AS content FROM seg")
def fixed_segments(t, spark):
    fixes = t("documents").select("doc_id", F.lit(0).alias("seq"), F.lit("a").alias("find"), F.lit("@").alias("put"))
    return co.apply_fixes(_segs(t).select("doc_id", "seq", "content"), fixes, ["doc_id", "seq"])[0]


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations")
def numbered_backwards(t, spark):
    return t("conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("back"))
