"""The corpus model: texts -> segments -> words, and the segment operators over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import running


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, seq, content: the lines of every text, numbered from 0."""
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("seq", "content"))


def words(segs: DataFrame, keep: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """word_index (0-based blank-separated chunk) and word of every segment."""
    chunks = F.array_remove(F.split("content", " "), "")
    return segs.select(*keep, F.posexplode(chunks).alias("word_index", "word"))


def numbered_words(segs: DataFrame, keep: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """Chunks with a letter outside round or square brackets, under their number among all chunks of the line.  What is bracketed is
    blanked in place, blanks staying, so that both splits agree; a bracket that opens the line (a doubtful line) is kept."""
    mark = r"\([^)]*\)|\[[^\]]*\]"
    # the bracketed is put between two control characters, then every run without blanks between these becomes one; one pass over a line each
    blank = lambda c: F.regexp_replace(F.regexp_replace(F.translate(c, "\x02\x03", "\x01\x01"), mark, "\x02$0\x03"), "(\x02|(?!^)\\G +)[^ \x03]+", "$1\x01")
    head = F.regexp_extract("content", f"(?s)^.*?(?:{mark})", 0)
    kept = F.concat(head, blank(F.substr("content", F.length(head) + 1)))
    bare = F.when(F.ltrim("content").startswith("["), kept).otherwise(blank(F.col("content")))
    chunks = lambda c: F.array_remove(F.split(c, " "), "")
    both = segs.withColumn("__bare", bare).select(*keep, F.posexplode(F.arrays_zip(chunks("content").alias("word"), chunks("__bare").alias("kept"))).alias("word_index", "z"))
    return both.filter(F.col("z.kept").rlike(r"\p{L}")).select(*keep, "word_index", "z.word")


def sentences(segs: DataFrame, col: str = "content", key: tuple[str, ...] = ("doc_id", "seq"), min_letters: int = 6) -> DataFrame:
    """piece, text: cut after . ; ! ?; a scrap under min_letters letters joins the piece before it."""
    raw = segs.select(*key, F.posexplode(F.split(col, r"(?<=[.;·!?])\s+")).alias("i", "part"))
    w = Window.partitionBy(*key).orderBy("i")
    scrap = F.length(F.regexp_replace("part", r"[^\p{L}]", "")) < min_letters
    opened = raw.withColumn("piece", F.sum(F.when(scrap & (F.col("i") > 0), 0).otherwise(1)).over(w) - 1)
    return opened.groupBy(*key, "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), " ").alias("text"))


def listed(df: DataFrame, flag: str = "hidden") -> DataFrame:
    return df.filter(~F.col(flag).eqNullSafe(1))


def body(df: DataFrame) -> DataFrame:
    return df.filter("seq > 0")


def real_words(df: DataFrame, kind: str = "kind") -> DataFrame:
    return df.filter(~F.col(kind).eqNullSafe("punctuation"))


def drop_slipped_groups(df: DataFrame, group: list[str], bad: Column) -> DataFrame:
    """Groups with no bad row."""
    flagged = df.withColumn("__bad", F.bool_or(F.coalesce(bad, F.lit(False))).over(Window.partitionBy(*group)))
    return flagged.filter(~F.col("__bad")).drop("__bad")


def apply_fixes(segs: DataFrame, fixes: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """fixes: key, find, put.  A fix must meet one row; its first occurrence is replaced.  Others are errors."""
    met = segs.join(fixes, key).filter(F.instr("content", F.col("find")) > 0)
    counts = fixes.join(met.groupBy(*key, "find").agg(F.count("*").alias("hits")), [*key, "find"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    good = counts.filter("hits = 1").select(*key, "find", "put")
    at = F.expr("locate(find, content)")
    new = F.concat(F.expr("substring(content, 1, locate(find, content) - 1)"), F.col("put"), F.expr("substring(content, locate(find, content) + length(find))"))
    out = segs.join(good, key, "left").withColumn("content", F.when(F.col("find").isNotNull() & (at > 0), new).otherwise(F.col("content"))).drop("find", "put")
    return out, counts.filter("hits <> 1").select(*key, "find", "hits")


def correct_words(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections: word, put (one row per word)."""
    return df.join(corrections, "word", "left").withColumn("word", F.coalesce("put", "word")).drop("put")


def gate_report(df: DataFrame, target: DataFrame, group: str, misplaced: Column | None = None) -> DataFrame:
    """group, n, target_n, misplaced, kept: a group is kept if it has as many rows as the target's and no marker off its line."""
    off = F.lit(False) if misplaced is None else F.coalesce(misplaced, F.lit(False))
    ours = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(off).alias("misplaced"))
    met = ours.join(target.groupBy(group).agg(F.count("*").alias("target_n")), group, "left")
    return met.withColumn("kept", F.coalesce((F.col("n") == F.col("target_n")) & (F.col("misplaced") == 0), F.lit(False)))


def gate_groups(df: DataFrame, target: DataFrame, group: str, misplaced: Column | None = None) -> DataFrame:
    """The rows of the groups that gate_report() keeps."""
    return df.join(gate_report(df, target, group, misplaced).filter("kept").select(group), group, "left_semi")


def insert_headings(segs: DataFrame, headings: DataFrame) -> DataFrame:
    """headings: doc_id, content; they get seq -1."""
    return segs.unionByName(headings.withColumn("seq", F.lit(-1)), allowMissingColumns=True)


def division_headings(divisions: DataFrame, title: Column, overrides: DataFrame, lines: DataFrame) -> DataFrame:
    """divisions: text, div and what `title` needs; overrides: text, div, title (null or empty: the division has none); lines: text, k, line, read before a text.

    text, div, seq, content of the heading rows: a division's title at seq 0, its own in place of the usual one; a text's lines in order before its
    first division, the last of them at seq 0, or at -1 where that division has a title."""
    own = overrides.select("text", "div", F.col("title").alias("__own"), F.lit(True).alias("__has"))
    titled = divisions.withColumn("__title", title).join(own, ["text", "div"], "left")
    titled = titled.select("text", "div", F.nullif(F.when(F.col("__has"), F.col("__own")).otherwise(F.col("__title")), F.lit("")).alias("content"))
    titles = titled.filter("content IS NOT NULL").select("text", "div", F.lit(0).alias("seq"), "content")
    first = titled.groupBy("text").agg(F.min_by(F.struct("div", F.col("content").isNotNull().alias("titled")), "div").alias("f"))
    back = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("k")))
    before = lines.withColumn("__b", back).join(first, "text").select("text", F.col("f.div").alias("div"), (1 - F.col("__b") - F.col("f.titled").cast("int")).alias("seq"), F.col("line").alias("content"))
    return titles.unionByName(before)


def rehome_parts(verses: DataFrame, parts: DataFrame) -> DataFrame:
    """verses: source, chapter, pos (order in the source), verse, content; parts: k (order), source, to (a chapter for all of it; null: as it is), shift (added to its
    chapters; null: none), ref (how a verse is cited, with {v}; null: its number).

    A text put together from parts of several sources: chapter, seq (through the parts in order, from 1 within the chapter), ref, content.  A part that is
    listed first and placed into a chapter stands at its start with its own numbering.  Verses of no part are left out; a source in two parts comes twice."""
    placed = verses.join(F.broadcast(parts.select("k", "source", "to", "shift", F.col("ref").alias("__ref"))), "source")  # few parts: verses stay where they are
    chapter = F.coalesce("to", F.col("chapter") + F.coalesce("shift", F.lit(0)))
    ref = F.replace(F.coalesce("__ref", F.lit("{v}")), F.lit("{v}"), F.col("verse").cast("string"))
    rows = placed.select(chapter.alias("__c"), "k", "chapter", "pos", ref.alias("ref"), "content")
    # (a chapter may hold most verses: numbers run over ranges of them)
    return running(rows, ["__c"], ["k", "chapter", "pos"], {}).select(F.col("__c").alias("chapter"), F.col("i").cast("int").alias("seq"), "ref", "content")


def rehome(df: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """mapping: the column, to, shift.  Rows without a rule stay."""
    return df.join(mapping, col, "left").withColumn(col, F.coalesce("to", F.col(col) + F.col("shift"), F.col(col))).drop("to", "shift")


def segment_dialogue(turns: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """part: opened by a user's turn; para within the part; a repeated label gets its number."""
    w = Window.partitionBy(key).orderBy(order)
    part = turns.withColumn("part", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "part").orderBy(order)
    label = F.row_number().over(Window.partitionBy(key, role).orderBy(order))
    return part.withColumn("para", F.row_number().over(inside)).withColumn("label", F.concat(role, F.lit(" ("), label.cast("string"), F.lit(")")))


def stitch_continuations(segs: DataFrame, cont: str, key: str = "doc_id") -> DataFrame:
    """Lines that fit `cont` join the line before."""
    w = Window.partitionBy(key).orderBy("seq")
    g = segs.withColumn("line", F.sum(F.when(F.col("content").rlike(cont), 0).otherwise(1)).over(w))
    return g.groupBy(key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), " ").alias("content"))


def unanalysed_sentences(words: DataFrame, known: DataFrame, text: str, stop: str = "[.;·!?]") -> DataFrame:
    """words: text, seq, word_index, word; known: text, seq, word_index (analysed words).  Whole sentences, across segment borders, that hold a
    word without analysis: text, sentence, seq, word_index, token; a word's first token speaks for it.  A stop is a token and ends its sentence."""
    tokens = F.regexp_extract_all("word", F.lit(rf"[\p{{L}}\p{{M}}\p{{N}}]+|{stop}"), F.lit(0))
    ends = lambda x: x.rlike(f"^{stop}$")
    # both sides are dealt by text once: words and known places meet, sentences are counted and judged within the same partitions
    both = words.select(text, "seq", "word_index", "word").unionByName(known.select(text, "seq", "word_index", F.lit(None).cast("string").alias("word")).withColumn("__known", F.lit(True)), allowMissingColumns=True)
    at = Window.partitionBy(text, "seq", "word_index")
    rows = both.filter(F.col(text).isNotNull()).repartition(text).withColumn("__known", F.count("__known").over(at) > 0).filter("word IS NOT NULL").withColumn("__t", tokens)
    before = Window.partitionBy(text).orderBy("seq", "word_index")
    stops = F.size(F.filter("__t", ends)).cast("long")
    rows = rows.withColumn("__s", F.sum(stops).over(before.rowsBetween(Window.unboundedPreceding, 0)) - stops)
    # a word's tokens by sentence: the first of each speaks for it
    met = F.posexplode(F.split(F.array_join(F.transform("__t", lambda x: F.when(ends(x), "\x01").otherwise(F.concat(F.lit("\x02"), x))), ""), "\x01")).alias("__k", "__p")
    first = rows.select(text, "seq", "word_index", "__known", "__s", met).filter("__p <> ''")
    first = first.select(text, (F.col("__s") + F.col("__k")).alias("sentence"), "seq", "word_index", F.split("__p", "\x02")[1].alias("token"), "__known")
    open_ = F.bool_or(~F.col("__known")).over(Window.partitionBy(text, "sentence"))
    return first.withColumn("__open", open_).filter("__open").drop("__open", "__known")


def generic_segments(lines: DataFrame, text: str, main: str, gloss: str) -> DataFrame:
    """A special source (book, line, the text and a gloss) in the shape of all texts: text, div, seq, ref, content, gloss; rows numbered within
    their book, an empty gloss null."""
    seq = F.row_number().over(Window.partitionBy("book").orderBy("line"))
    return lines.select(F.lit(text).alias("text"), F.col("book").alias("div"), seq.alias("seq"), F.col("line").cast("string").alias("ref"), F.col(main).alias("content"), F.nullif(F.trim(gloss), F.lit("")).alias("gloss"))
