"""Served views as joins: the nested library, pages of a book, lexicon cards.

Everything is joined on a segment's or a text's key; what becomes an array is bounded by what it is: the books of a text, the texts of a category, the
pieces of a segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.linking import count_cover


def _listed(df: DataFrame, keys: list[str], order: list[str], fields: list[str], out: str) -> DataFrame:
    """An array of structs per key, in order."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)], *fields))).alias("x"))
    return rows.select(*keys, F.transform("x", lambda r: F.struct(*[r[c].alias(c) for c in fields])).alias(out))


def library_tree(categories: DataFrame, texts: DataFrame, books: DataFrame, downloads: DataFrame | None = None) -> DataFrame:
    """categories: name, sort; texts: slug, title, author, reader, category, collection (null: none), hidden, sort; books: text, n, label; downloads: text, n, size.

    A row per category, in order of `sort`: name, sort, entries; an entry is a collection with its texts, standing where its first text stands, or
    one text by itself (collection null).  A text has its books and downloads in order; hidden texts are left out, a category without texts has an empty
    array.  Ties of sort go by slug."""
    of = texts.filter(~F.coalesce("hidden", F.lit(False))).join(_listed(books, ["text"], ["n"], ["n", "label"], "books").withColumnRenamed("text", "slug"), "slug", "left")
    fields = ["slug", "title", "author", "reader", "books"]
    if downloads is not None:
        of = of.join(_listed(downloads, ["text"], ["n"], ["n", "size"], "downloads").withColumnRenamed("text", "slug"), "slug", "left")
        fields.append("downloads")
    of = of.withColumn("__entry", F.coalesce(F.concat(F.lit("c:"), "collection"), F.concat(F.lit("t:"), "slug")))
    entries = _listed(of, ["category", "__entry"], ["sort", "slug"], ["sort", *fields], "texts")
    entries = entries.withColumn("sort", F.col("texts")[0]["sort"]).withColumn("first", F.col("texts")[0]["slug"]).withColumn("collection", F.when(F.startswith("__entry", F.lit("c:")), F.substr("__entry", F.lit(3))))
    entries = entries.withColumn("texts", F.transform("texts", lambda t: F.struct(*[t[c].alias(c) for c in fields])))
    whole = _listed(entries, ["category"], ["sort", "first"], ["collection", "texts"], "entries").withColumnRenamed("category", "name")
    made = categories.select("name", "sort").join(whole, "name", "left")
    return made.withColumn("entries", F.coalesce("entries", F.array().cast(whole.schema["entries"].dataType)))


def lexicon_cards(words: DataFrame, lexicon: DataFrame, short: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    """words: strongs, lemma and gloss of the text's own (null: none) and further columns; lexicon: strongs, lemma, gloss, definition; short: lemma, definition.

    Without an own lemma a word has the lexicon's entry.  An own lemma and gloss stand before it, and the entry's number and definition stay only where both
    lemmas are the same word folded; the definition is then the entry's, else the short one of the own lemma, else the own gloss.  A card without any
    definition has its gloss there."""
    entry = lexicon.select("strongs", F.col("lemma").alias("__l"), F.col("gloss").alias("__g"), F.col("definition").alias("__d"))
    few = short.select("lemma", F.col("definition").alias("__short")).dropDuplicates(["lemma"])
    met = words.join(entry, "strongs", "left").join(few, "lemma", "left")
    own = F.col("lemma").isNotNull()
    same = ~own | (F.coalesce(fold(F.col("__l")) == fold(F.col("lemma")), F.lit(False)))
    gloss = F.when(own, F.col("gloss")).otherwise(F.col("__g"))
    definition = F.when(own, F.coalesce(F.when(same, F.col("__d")), "__short", "gloss")).otherwise(F.col("__d"))
    rest = [c for c in words.columns if c not in ("strongs", "lemma", "gloss")]
    return met.select(*rest, F.when(same, F.col("strongs")).alias("strongs"), F.coalesce("lemma", "__l").alias("lemma"), gloss.alias("gloss"), F.coalesce(definition, gloss).alias("definition"))


def page_segments(segments: DataFrame, keys: list[str], notes: DataFrame, translations: DataFrame, passages: DataFrame, timings: DataFrame) -> DataFrame:
    """segments: keys, seq, form and more; notes: keys, start, end (segments that a note covers); translations: keys, seq, lang, content; passages: keys, start, end,
    content; timings: keys, seq, piece, content, start, end (times).

    Every segment with notes (how many cover it; null for none), translations (map lang -> content), passages (those that end at it, in order of their starts), times
    (the first piece's, of verse) and parts (all pieces with their times, of any other form).  What a segment lacks is null."""
    at = [*keys, "seq"]
    counted = count_cover(segments.withColumn("pos", F.col("seq")), notes, keys).drop("pos").withColumn("notes", F.nullif("n_cover", F.lit(0))).drop("n_cover")
    spoken = translations.groupBy(*at).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "content")))).alias("translations"))
    ended = _listed(passages.withColumn("seq", F.col("end").cast(segments.schema["seq"].dataType)), at, ["start"], ["start", "content"], "passages")
    pieces = _listed(timings, at, ["piece"], ["content", "start", "end"], "__pieces")
    page = counted
    for df in (spoken, ended, pieces):
        page = page.join(df, at, "left")
    verse = F.col("form") == "verse"
    first = F.col("__pieces")[0]
    return page.withColumn("times", F.when(verse, F.struct(first["start"].alias("start"), first["end"].alias("end")))).withColumn("times", F.when(F.col("__pieces").isNotNull(), F.col("times"))).withColumn("parts", F.when(~verse, F.col("__pieces"))).drop("__pieces")


def page_heads(texts: DataFrame, keys: list[str], translations: DataFrame, passages: DataFrame, notes: DataFrame, recordings: DataFrame) -> DataFrame:
    """texts: keys, credit, credit_en, credit_el; recordings: keys, credit.  Per page: features (what it has, in a fixed order) and credits in the reader's order: the text's, the modern
    translation's where there is one, the English one's where there are verses or passages of it, the recording's."""
    have = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    page = texts
    for df, name in ((translations.filter("lang = 'el'"), "modern"), (translations.filter("lang = 'en'").select(*keys).unionByName(passages.select(*keys)), "translation"), (notes, "scholia"), (recordings, "audio")):
        page = page.join(have(df, name), keys, "left")
    heard = recordings.groupBy(*keys).agg(F.min("credit").alias("__heard"))
    page = page.join(heard, keys, "left")
    features = F.array_compact(F.array(*[F.when(F.col(x), F.lit(x)) for x in ("scholia", "audio", "translation", "modern")]))
    credits = F.array_compact(F.array("credit", F.when(F.col("modern"), F.col("credit_el")), F.when(F.col("translation"), F.col("credit_en")), F.col("__heard")))
    return page.select(*keys, features.alias("features"), credits.alias("credits"))
