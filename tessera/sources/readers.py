"""Readers that turn pages, marked-up text and lists into rows, by column expressions over whole tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.functions.markup import keyed_paragraphs, styled_runs
from tessera.functions.text import clean_wiki
from tessera.store import materialize


def extract_rows(pages: DataFrame, key: str, html: str, row_marker: str, fields: dict[str, str]) -> DataFrame:
    """The page is cut at row_marker; each field is what stands between the first ">" and "<" after its marker."""
    rows = pages.select(key, F.posexplode(F.slice(F.split(html, row_marker), 2, 1_000_000_000)).alias("row", "__r"))
    return rows.select(key, "row", *[F.regexp_extract("__r", rf"(?s){marker}[^>]*>([^<]*)<", 1).alias(name) for name, marker in fields.items()])


def xml_rows(df: DataFrame, col: str, tag: str, schema: StructType | str) -> DataFrame:
    """Elements `tag` of a column of XML texts, parsed by the schema."""
    parts = df.withColumn("__e", F.explode(F.regexp_extract_all(F.col(col), F.lit(rf"(?s)(<{tag}\b.*?</{tag}>)"), F.lit(1))))
    return parts.withColumn("element", F.from_xml("__e", schema)).drop("__e")


def flatten_notes(c: Column) -> Column:
    """Footnotes go with all they hold, quoted speech gets its marks."""
    bare = F.regexp_replace(c, r"(?s)<note\b[^>]*>.*?</note>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"<(?:q|quote|said)\b[^>]*>", "“"), r"</(?:q|quote|said)>", "”")


def milestone_passages(df: DataFrame, key: str, text: str, marker: str) -> DataFrame:
    """marker, passage: the text after every marker (its group 1) up to the next; what is before the first has marker null."""
    marks = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(marker), F.lit(1)))
    return df.select(key, F.posexplode(F.arrays_zip(marks.alias("marker"), F.split(text, marker).alias("passage"))).alias("i", "z")).select(key, "i", "z.marker", "z.passage")


def poem_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of <poem> blocks, numbered by counting; {{r|n}} markers are taken out and kept."""
    block = F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)<poem>(.*?)</poem>"), F.lit(1)))
    lines = df.select(key, block.alias("__n", "__b")).select(key, "__n", F.posexplode(F.split("__b", "\n")).alias("__i", "raw")).filter(F.trim("raw") != "")
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy(key).orderBy("__n", "__i")))
    return numbered.select(key, "line", F.trim(F.regexp_replace("raw", r"\{\{r\|\d+\}\}", "")).alias("content"), F.nullif(F.regexp_extract("raw", r"\{\{r\|(\d+)\}\}", 1), F.lit("")).alias("marker"))


def split_sections(df: DataFrame, key: str, text: str, heading: str = r"(?m)^== *(.+?) *==$") -> DataFrame:
    """section_no from 1 for headings that begin with a number, from 1000 for others; 0 for what is before the first."""
    parts = milestone_passages(df, key, text, heading)
    extra = F.coalesce(~F.col("marker").rlike(r"^\d"), F.lit(False))
    w = Window.partitionBy(key).orderBy("i")
    no = F.when(F.col("marker").isNull(), 0).when(extra, 999 + F.sum(extra.cast("int")).over(w)).otherwise(F.regexp_extract("marker", r"^(\d+)", 1).cast("int"))
    return parts.select(key, no.alias("section_no"), F.col("marker").alias("heading"), F.regexp_replace("passage", r"^\s+|\s+$", "").alias("body"))


def resolve_redirects(pages: DataFrame, key: str, text: str, doublings: int = 40) -> DataFrame:
    """page, target: where #REDIRECT [[x]] leads in the end.  Every step follows each page's pointer to the pointer it meets, so chains of
    2 ** k hops take k steps, each written to the shared folder.  A page in a circle, or that leads into one, has a null target."""
    to = F.regexp_extract(text, r"(?i)^#REDIRECT\s*\[\[([^\]|#]*)", 1)
    hops = materialize(pages.select(F.col(key).alias("page"), F.nullif(F.trim(to), F.lit("")).alias("next")), "hops")
    ends = hops.filter("next IS NULL").select(F.col("page").alias("end"))
    named = hops.filter("next IS NOT NULL").select("page", F.col("next").alias("target"))
    stay = hops.filter("next IS NULL").select("page", F.col("page").alias("target"))
    for _ in range(min(doublings, named.count().bit_length() + 1)):  # no chain is longer than the pages that lead on
        up = named.select(F.col("page").alias("target"), F.col("target").alias("above"))
        named = materialize(named.join(up, "target", "left").select("page", F.coalesce("above", "target").alias("target"), F.col("above").isNotNull().alias("moved")), "redirects")
        open_ = named.filter("moved").join(ends, F.col("target") == F.col("end"), "left_anti")
        if not open_.join(hops.select(F.col("page").alias("target")), "target", "left_semi").limit(1).count():
            return stay.unionByName(named.select("page", "target"))
        named = named.drop("moved")
    # what still moves after more hops than there are pages goes round
    settled = named.join(hops.filter("next IS NOT NULL").select(F.col("page").alias("again")), F.col("target") == F.col("again"), "left")
    return stay.unionByName(settled.select("page", F.when(F.col("again").isNull(), F.col("target")).alias("target")))


def read_lexicon(spark: SparkSession, path: str, sep: str = "\t", comment: str = "#") -> DataFrame:
    """key, value: the first definition of a key wins; comment lines and short rows are tolerated."""
    # a line's place: its file, and its offset order within the file's splits, which the reader's own row numbers follow
    lines = spark.read.text(path).select("value", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).alias("n"))
    rows = lines.filter(~F.col("value").startswith(comment) & (F.trim("value") != "")).withColumn("f", F.split("value", sep))
    return first_definitions(rows.select(F.trim(F.col("f")[0]).alias("key"), F.trim(F.coalesce(F.get("f", F.lit(1)), F.lit(""))).alias("value"), "n"), "key", "value", "n")


def first_definitions(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def read_vpl(spark: SparkSession, path: str) -> DataFrame:
    p = r"^(\w+) (\d+):(\d+) (.*)$"
    part = lambda k: F.regexp_extract("value", p, k)
    return spark.read.text(path).filter(F.col("value").rlike(p)).select(part(1).alias("book"), part(2).cast("int").alias("c"), part(3).cast("int").alias("v"), part(4).alias("text"))


def split_on_marks(df: DataFrame, key: str, text: str) -> DataFrame:
    """c, v, text of every inline c:v mark, up to the next."""
    both = F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(\d+:\d+\s.*?)(?=\d+:\d+\s|\z)"), F.lit(1)))
    part = lambda k: F.regexp_extract("__m", r"(?s)^(\d+):(\d+)\s+(.*?)\s*$", k)
    return df.select(key, both.alias("__m")).select(key, part(1).cast("int").alias("c"), part(2).cast("int").alias("v"), part(3).alias("text"))


def zip_by_position(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.join(df, "pos")
    return first


def slice_by_offsets(words: DataFrame, starts: DataFrame) -> DataFrame:
    """words: grp, pos, word; starts: grp, ref, start.  Every word with the ref whose start is the last at or before it."""
    both = words.select("grp", "pos", "word").withColumn("__k", F.lit(1)).unionByName(starts.select(F.col("start").alias("pos"), "ref", "grp").withColumn("__k", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("grp").orderBy("pos", "__k")
    return both.withColumn("ref", F.last("ref", ignorenulls=True).over(w)).filter("__k = 1").drop("__k")


def read_parse_cache(cache: DataFrame, segs: DataFrame, key: str, doc: str) -> DataFrame:
    """Cached parses {key: {text, words}} that still fit: the segment's content equals the cached text."""
    kind = "map<string,struct<text:string,words:map<string,string>>>"
    rows = cache.select(F.explode(F.from_json(doc, kind)).alias(key, "c"))
    fit = segs.join(rows, key).filter(F.col("content") == F.col("c.text"))
    return fit.select(key, F.explode("c.words").alias("word_index", "parse")).withColumn("word_index", F.col("word_index").cast("int"))


def numbered_notes(df: DataFrame, key: str, order: str, text: str, before: str = "") -> DataFrame:
    """An opening "5. " sets the line and goes from the text; the line then carries forward.  Paragraphs before the first number go to line 1, with the prefix
    `before`."""
    n = F.nullif(F.regexp_extract(text, r"^(\d+)\. ", 1), F.lit("")).cast("int")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    met = df.withColumn("__n", F.last(n, ignorenulls=True).over(w))
    bare = F.regexp_replace(text, r"^\d+\. ", "")
    return met.withColumn(text, F.when(F.col("__n").isNull(), F.concat(F.lit(before), F.col(text))).otherwise(bare)).withColumn("line", F.coalesce("__n", F.lit(1))).drop("__n")


def read_volume(lines: DataFrame, key: str, order: str, text: str, heading: str = r"^BOOK\b") -> DataFrame:
    """Plain-text volumes: key, book, line, content, printed.  A heading opens a book (what is before the first is left out), blank lines go, a line that
    begins with "[" goes on with the one before; lines are counted within their book, and a number printed at a line's end (each fifth has one) is
    taken off and kept."""
    w = Window.partitionBy(key).orderBy(order)
    head = F.col(text).rlike(heading)
    rows = lines.withColumn("book", F.sum(head.cast("int")).over(w)).filter(~head & (F.trim(text) != "") & (F.col("book") > 0))
    inside = Window.partitionBy(key, "book").orderBy(order)
    rows = rows.withColumn("line", F.sum(F.when(F.ltrim(text).startswith("["), 0).otherwise(1)).over(inside)).filter("line > 0")
    number = r"\s+(\d+)\s*$"
    rows = rows.withColumn("__p", F.nullif(F.regexp_extract(text, number, 1), F.lit("")).cast("int")).withColumn("__t", F.trim(F.regexp_replace(text, number, "")))
    whole = rows.groupBy(key, "book", "line").agg(F.array_sort(F.collect_list(F.struct(order, "__t"))).alias("x"), F.max("__p").alias("printed"))
    return whole.select(key, "book", "line", F.array_join(F.transform("x", lambda r: r["__t"]), " ").alias("content"), "printed")


def read_service(lines: DataFrame, key: str, order: str, text: str, heading: str = r"^== ", role: str = r"^([A-Z][A-Z]+): ") -> DataFrame:
    """Texts in parts, paragraphs and turns: key, order, part, label, para, speaker, content.  A heading opens a part and names it, and a name that has
    been used gets "(2)", "(3)"; a blank line ends a paragraph; a line that begins with a role has a speaker, the others none."""
    w = Window.partitionBy(key).orderBy(order)
    head, blank = F.col(text).rlike(heading), F.trim(text) == ""
    rows = lines.withColumn("part", F.sum(head.cast("int")).over(w)).withColumn("__head", head).withColumn("__blank", blank)
    names = rows.filter("__head").select(key, "part", F.trim(F.regexp_replace(text, heading, "")).alias("__name"))
    nth = F.row_number().over(Window.partitionBy(key, "__name").orderBy("part"))
    names = names.withColumn("__k", nth).select(key, "part", F.when(F.col("__k") > 1, F.concat("__name", F.lit(" ("), F.col("__k").cast("string"), F.lit(")"))).otherwise(F.col("__name")).alias("label"))
    inside = Window.partitionBy(key, "part").orderBy(order)
    # a paragraph begins at a line with text after a blank line or the part's heading
    opens = ~F.col("__blank") & ~F.col("__head") & F.coalesce(F.lag(F.col("__blank") | F.col("__head")).over(inside), F.lit(True))
    rows = rows.withColumn("para", F.sum(opens.cast("int")).over(inside)).filter("NOT __head AND NOT __blank")
    said = rows.withColumn("speaker", F.nullif(F.regexp_extract(text, role, 1), F.lit(""))).withColumn("content", F.regexp_replace(text, role, ""))
    return said.join(names, [key, "part"], "left").select(key, order, "part", "label", "para", "speaker", "content")


def numbered_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """file, line (from 1), value of every line of text files, whatever pieces Spark reads them in.  With `whole` the files under path are one text, in the
    order of their names, and file is null.

    A file's pieces are read apart and their lines counted; a line's number is its place in its piece and the lines of the pieces before it.  The lines
    are written once in between, so that both passes see the same pieces."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__piece"), "value", F.monotonically_increasing_id().alias("__at"))
    raw = materialize(raw, "lines")
    pieces = raw.groupBy("file", "__piece").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    by = (Window.orderBy("file", "__piece") if whole else Window.partitionBy("file").orderBy("__piece")).rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__n").over(by), F.lit(0))).drop("__n")
    return raw.join(pieces, ["file", "__piece"]).select((F.lit(None).cast("string") if whole else F.col("file")).alias("file"), (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("line"), "value")


def parallel_files(spark: SparkSession, columns: dict[str, str]) -> DataFrame:
    """columns: name -> text file, or a folder of files that follow each other by name.  line and a column per file: its text on that line, null past its
    end."""
    out = None
    for name, path in columns.items():
        one = numbered_lines(spark, path, True).select("line", F.col("value").alias(name))
        out = one if out is None else out.join(one, "line", "full")
    return out


#: Lines of a bucket of column files, where verses aren't longer.
_BUCKET = 1 << 16
#: Files that Spark reads whole, whatever the size of its pieces.
_WHOLE = (".gz", ".deflate", ".snappy", ".lz4", ".zst")
_PACKED = "bucket long, kind int, first long, size int, said binary"


def _squeezed(of: np.ndarray, kind: int, first: np.ndarray, said: pa.Array) -> pa.RecordBatch:
    """Rows of _PACKED: texts of many lines, compressed as one each (`_loosened`)."""
    said = [x.encode() for x in said.to_pylist()]
    cols = of, np.full(len(said), kind, np.int32), first, np.array([len(x) for x in said], np.int32)
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([pa.compress(x, "zstd", asbytes=True) for x in said], pa.binary())], names=["bucket", "kind", "first", "size", "said"])


def _loosened(size: int, said: bytes) -> str:
    return pa.decompress(said, size, "zstd", asbytes=True).decode()


def _pieces(spark: SparkSession, path: str) -> tuple[DataFrame, dict[int, tuple[int, int | None]]]:
    """The lines of text files that are one text in the order of their names: piece, at, value; and for every piece how many lines come before it, and the
    `at` of its first line.  Lines are written once so that both passes see the same pieces; compressed files are pieces as they are, whose first
    line is the one that a task meets first (None)."""
    raw = spark.read.text(path)
    whole = all(x.endswith(_WHOLE) for x in raw.inputFiles())
    # (functions, as columns of _metadata would be copied into every line's row)
    file, start = F.input_file_name(), F.input_file_block_start()
    piece = lambda file, start: F.xxhash64(file, start).alias("piece")
    if whole:
        lines = raw.select(piece(file, start), F.monotonically_increasing_id().alias("at"), "value")
        found = raw.select(file.alias("file"), start.alias("start")).groupBy("file", "start").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("first"))
    else:
        raw = materialize(raw.select(file.alias("file"), start.alias("start"), "value"), "lines")
        lines = raw.select(piece("file", "start"), F.col("_metadata.row_index").alias("at"), "value")
        found = raw.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("_metadata.row_index").alias("first"))
    found = found.select(piece("file", "start"), "file", "start", "n", "first").collect()  # a row per piece
    out, before = {}, 0
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        out[r.piece] = before, r.first
        before += r.n
    if len(out) < len(found):
        raise RuntimeError("two pieces of the files have one number")
    return lines, out


def _packed(spark: SparkSession, path: str, kind: int, edges: np.ndarray) -> DataFrame:
    """The lines of a column's files, those that follow each other within a bucket as one row: as _PACKED has it.  Bucket k begins at line edges[k]."""
    lines, pieces = _pieces(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[int, int] = {}
        for b in batches:
            piece, at = (b.column(k).to_numpy() for k in (0, 1))
            line = np.empty(len(at), np.int64)
            ends = [*(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            for lo, hi in zip([0, *ends], ends, strict=False):
                if lo < hi:
                    before, first = pieces[int(piece[lo])]
                    first = firsts.setdefault(int(piece[lo]), int(at[lo])) if first is None else first
                    line[lo:hi] = at[lo:hi] - first + before + 1
            of = np.searchsorted(edges, line, "right") - 1
            cut = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(line, prepend=-1) != 1))
            said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cut, len(line)), pa.int32()), b.column(2)), "\n")
            yield _squeezed(of[cut], kind, line[cut], said)

    return lines.mapInArrow(run, _PACKED)


def _packed_starts(listed: DataFrame, edges: np.ndarray) -> DataFrame:
    """start, seq and ref of verses, those of a bucket as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.searchsorted(edges, b.column(0).to_numpy(), "right") - 1
            order = np.argsort(of, kind="stable")
            rows = pc.binary_join_element_wise(b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), b.column(2), "\t").take(pa.array(order))
            cut = np.flatnonzero(np.diff(of[order], prepend=-1))
            said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cut, len(of)), pa.int32()), rows), "\n")
            yield _squeezed(of[order][cut], -1, np.zeros(len(cut), np.int64), said)

    return listed.select("start", "seq", "ref").mapInArrow(run, _PACKED)


def _verses_of(rows: list[tuple[int, int, str]], names: list[str]) -> pa.RecordBatch | None:
    """kind, first and said of a bucket's rows -> its verses with words: seq, ref, words."""
    starts = sorted((int(at), int(seq), ref) for kind, _, said in rows if kind < 0 for at, seq, ref in (x.split("\t", 2) for x in said.split("\n")))
    runs = [(kind, first, said.split("\n")) for kind, first, said in rows if kind >= 0]
    if not starts or not runs:
        return None
    base = min(first for _, first, _ in runs)
    n = max(first + len(x) for _, first, x in runs) - base
    columns: list[list[str | None]] = [[None] * n for _ in names]
    for kind, first, x in runs:
        columns[kind][first - base : first - base + len(x)] = x
    at = np.clip(np.array([*(x[0] for x in starts), base + n], np.int64) - base, 0, n)
    words = pa.StructArray.from_arrays([pa.array(np.arange(base, base + n)), *(pa.array(c, pa.string()) for c in columns)], names=["line", *names])
    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), words)
    made = pa.RecordBatch.from_arrays([pa.array([x[1] for x in starts], pa.int64()), pa.array([x[2] for x in starts], pa.string()), lists], names=["seq", "ref", "words"])
    return made.filter(pa.array(np.diff(at) > 0))


def column_verses(spark: SparkSession, columns: dict[str, str], starts: str, content: str) -> DataFrame:
    """columns: name -> file with a line per word; starts: a file of "ref<TAB>line", the line (from 1) of each verse's first word.  A verse ends where the
    next one starts, the last one with the files.

    seq (in the order of the starts), ref, content (the words of the column `content`, joined by blanks) and words: array<struct<line, columns>>.  The line
    axis is cut into buckets where verses begin; the lines of a bucket are shuffled as compressed texts of many lines, and its verses are made in one task, so that no file
    passes one task and no word is a row of its own in a shuffle; a verse's words become one row.  A verse without words, or words before the first
    verse, are left out."""
    parts = F.split("value", "\t")
    listed = numbered_lines(spark, starts, True).select(F.col("line").alias("seq"), F.trim(parts[0]).alias("ref"), F.get(parts, F.lit(1)).cast("long").alias("start")).filter("start IS NOT NULL")
    first = listed.groupBy(F.floor(F.col("start") / _BUCKET)).agg(F.min("start").alias("first")).collect()  # a row per bucket
    edges = np.array([-(1 << 62), *sorted(r["first"] for r in first)[1:]], np.int64)
    names = list(columns)
    rows = reduce(DataFrame.unionByName, (_packed(spark, path, k, edges) for k, path in enumerate(columns.values())), _packed_starts(listed, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for b in batches:
            for bucket, kind, line, size, said in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != of:
                    if (made := _verses_of(held, names)) is not None:
                        yield made
                    held, of = [], bucket
                held.append((kind, line, _loosened(size, said)))
        if (made := _verses_of(held, names)) is not None:
            yield made

    tasks = -(-len(edges) // 64)  # of about 2^22 lines at most
    n = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    word = StructType([StructField("line", LongType()), *(StructField(c, StringType()) for c in names)])
    made = rows.repartition(*n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, StructType([StructField("seq", LongType()), StructField("ref", StringType()), StructField("words", ArrayType(word))]))
    return made.select("seq", "ref", F.array_join(F.col(f"words.{content}"), " ").alias("content"), "words")


def wiki_lines(pages: DataFrame) -> DataFrame:
    """pages: name, body.  Lines of every page that isn't a redirect, cleaned, without empty ones: div, seq (of the line in the page), content."""
    lines = pages.filter(~F.col("body").rlike(r"(?i)^#REDIRECT")).select(F.col("name").alias("div"), F.posexplode(F.split("body", "\n")).alias("seq", "content"))
    return lines.withColumn("content", clean_wiki(F.col("content"))).filter("content <> ''")


def keyed_notes(df: DataFrame, ref: str, source_map: DataFrame) -> DataFrame:
    """ref "B.L-B.M" -> book, line, line_to (clipped to its book); volume -> source by a small map."""
    p = r"^(\d+)\.(\d+)(?:-(?:(\d+)\.)?(\d+))?$"
    g = lambda k: F.nullif(F.regexp_extract(ref, p, k), F.lit("")).cast("int")
    to = F.when(g(3).isNull() | (g(3) == g(1)), g(4)).otherwise(F.lit(None))
    return df.join(F.broadcast(source_map), "volume", "left").withColumn("book", g(1)).withColumn("line", g(2)).withColumn("line_to", F.greatest(g(2), F.coalesce(to, g(2))))


READERS = {}


def reader(kind: str):
    """Registers a reader(spark, entry) -> DataFrame for catalogue entries of a type."""

    def put(f):
        READERS[kind] = f
        return f

    return put


def build_corpus(spark: SparkSession, catalogue: list[dict]) -> DataFrame:
    """The union of every entry's segments, each read by its source's type.  Divisions that are numbers in one source and names in another are names."""
    parts = [READERS[entry["type"]](spark, entry).withColumn("text", F.lit(entry["slug"])) for entry in catalogue]
    if any(isinstance(p.schema["div"].dataType, StringType) for p in parts):
        parts = [p.withColumn("div", F.col("div").cast("string")) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@reader("vpl")
def _vpl(spark: SparkSession, entry: dict) -> DataFrame:
    return read_vpl(spark, entry["path"]).select(F.col("c").alias("div"), F.col("v").alias("seq"), F.col("text").alias("content"))


@reader("documents")
def _documents(spark: SparkSession, entry: dict) -> DataFrame:
    docs = spark.read.parquet(entry["path"])
    return docs.select(F.col("doc_id").alias("div"), F.posexplode(F.split("text", "\n")).alias("seq", "content"))


@reader("columns")
def _columns(spark: SparkSession, entry: dict) -> DataFrame:
    """Parallel column files with an offset table; a ref "chapter:verse" gives the division, any other is of division 1."""
    verses = column_verses(spark, entry["columns"], entry["starts"], entry["content"])
    chapter = F.nullif(F.regexp_extract("ref", r"^(\d+)[:.]", 1), F.lit("")).cast("long")
    return verses.select(F.coalesce(chapter, F.lit(1).cast("long")).alias("div"), "seq", "content")


@reader("wiki")
def _wiki(spark: SparkSession, entry: dict) -> DataFrame:
    pages = spark.read.parquet(entry["path"])
    return wiki_lines(pages.select(F.col(entry.get("name", "name")).alias("name"), F.col(entry.get("body", "body")).alias("body")))


@reader("paragraphs")
def _paragraphs(spark: SparkSession, entry: dict) -> DataFrame:
    """A row per paragraph of marked-up pages, as plain text."""
    pages = spark.read.parquet(entry["path"]).select(F.col(entry["key"]).alias("div"), F.col(entry["body"]).alias("body"))
    parts = keyed_paragraphs(pages, ["div"], "body", entry.get("paragraph", "p"))
    runs = styled_runs(parts, ["div", "para"], "inner", {"x": "^$"})
    return runs.select("div", F.col("para").alias("seq"), F.array_join("runs.text", "").alias("content")).filter("content <> ''")
