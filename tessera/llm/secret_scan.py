"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Each kind of secret is a pattern.  A match's place comes from the pieces between matches: the text is split by the
pattern, and a running sum over the lengths of pieces and matches gives starts and ends in code points.  The sum is a window over
a text's matches, so the work is linear in the text.

All found values are hashed and counted over the corpus: how many distinct repositories (here the documents) and owners (a column such
as the source) hold each.  A value of `example_owners` owners or more is a widely copied example, and so is one that several
owners hold in `example_repos` repositories or more in all; what one owner alone holds looks live, in however many repositories.
Base kinds (assign, access, hex) always stay among the spans; the method adds "generic" spans, long
tokens that mix letters and digits, where they overlap no base span and look live.

Nulls: a null text is empty; a null owner or document counts as one value of its own.  Rows that repeat a document
id and text get the same spans.  Equal starts are ordered by kind.  Texts of any length are scanned whole.  An empty table gives no
rows.  Only the named columns are read: further ones, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs that fail the least length can't hold one that passes, so the least length is in the pattern itself.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "generic")
PATTERNS = (ASSIGN, ACCESS, HEX, GENERIC)
_GENERIC = KINDS.index("generic")
SPAN = "struct<start:int,rank:int,end:int,live:boolean,owners:bigint,repos:bigint>"


def scan(docs: DataFrame, text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """row (a number per row), doc_id, text_hash, owner and the parts of every kind: what lies before each match, and the match."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(owner_col).cast("string").alias("owner"), text.alias("t"))
    kinds = list(enumerate(PATTERNS))
    hits = rows.withColumns({f"h{k}": F.regexp_extract_all("t", F.lit(p), F.lit(0)) for k, p in kinds})
    gaps = hits.withColumns({f"g{k}": F.when(F.size(f"h{k}") > 0, F.transform(F.split("t", p, -1), F.length)) for k, p in kinds})
    parts = [F.when(F.col(f"g{k}").isNotNull(), F.arrays_zip(F.slice(f"g{k}", F.lit(1), F.size(f"h{k}")).alias("gap"), F.col(f"h{k}").alias("hit"))).alias(KINDS[k]) for k, _ in kinds]
    # the number is written with the row: it stays what it is when a task is run again later
    return materialize(gaps.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "owner", *parts), "scanned")


def spans_of(scanned: DataFrame) -> DataFrame:
    """row, doc_id, owner, start, rank, end, value: base spans and the generic ones that overlap none."""
    some = scanned.filter(" OR ".join(f"{k} IS NOT NULL" for k in KINDS))
    kinds = F.array(*[F.struct(F.lit(k).alias("rank"), F.col(name).alias("parts")) for k, name in enumerate(KINDS)])
    each = some.select("row", "doc_id", "owner", F.explode(kinds).alias("k")).select("row", "doc_id", "owner", "k.rank", F.posexplode("k.parts").alias("i", "part"))
    w = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("part.gap") + F.length("part.hit")).over(w).cast("int")
    value = F.when(F.col("rank") == 0, F.regexp_extract("part.hit", ASSIGN, 2)).otherwise(F.col("part.hit"))
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("part.hit")).withColumn("value", value)
    mixed = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
    good = placed.filter(F.when(F.col("rank") == 0, F.length("value") >= 6).when(F.col("rank") == _GENERIC, mixed).otherwise(True))
    order = Window.partitionBy("row").orderBy("start", "rank")
    base = F.col("rank") < _GENERIC
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # backwards, as a frame up to the last row is computed anew for every row
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"))
    ahead = F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return good.withColumn("reach", reach).withColumn("ahead", ahead).filter(base | free).select("row", "doc_id", "owner", "start", "rank", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owner, repo) rows -> value_hash, owners, repos: distinct ones; every step is summed before its shuffle."""
    pairs = found.select("value_hash", "owner", "repo").distinct()
    per_repo = pairs.groupBy("value_hash", "repo").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("repos"))
    per_owner = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    return per_owner.join(per_repo, "value_hash")


def classify(spans: DataFrame, example_owners: int = 3, example_repos: int = 10, salts: int = 16) -> DataFrame:
    """spans of spans_of() with owners, repos and live; generic ones that don't look live go.

    A hot value is spread over `salts` keys on its way back to its spans; values of one repository (nearly all) don't travel.
    """
    found = spans.withColumn("value_hash", F.sha2("value", 256)).drop("value")
    shared = ownership(found.withColumn("repo", F.col("doc_id"))).filter("repos > 1 OR owners > 1")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = found.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(salts)).cast("int")).join(shared, ["value_hash", "salt"], "left")
    counted = joined.withColumn("owners", F.coalesce("owners", F.lit(1).cast("long"))).withColumn("repos", F.coalesce("repos", F.lit(1).cast("long")))
    copied = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repos") >= example_repos))
    return counted.withColumn("live", ~copied).filter((F.col("rank") < _GENERIC) | F.col("live")).select("row", "start", "rank", "end", "live", "owners", "repos")


def find_secrets(docs: DataFrame, text_col: str = "text", owner_col: str = "source", example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """doc_id, text_hash, base and spans (arrays by start and kind, with live, owners and repos), masks (start and end of what the spans
    cover, overlapping ones as one) of every row."""
    scanned = scan(docs, text_col, owner_col)
    spans = materialize(classify(spans_of(scanned), example_owners, example_repos), "spans")
    order = Window.partitionBy("row").orderBy("start", "rank")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") >= F.col("reach"), F.lit(True)).cast("int")
    cover = spans.withColumn("reach", reach).withColumn("g", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    masks = cover.groupBy("row", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("masks"))
    listed_ = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "live", "owners", "repos"))).alias("spans"))
    none = F.array().cast(f"array<{SPAN}>")
    out = scanned.select("row", "doc_id", "text_hash").join(listed_.join(masks, "row"), "row", "left")
    full = out.withColumn("spans", F.coalesce("spans", none)).withColumn("masks", F.coalesce("masks", F.array().cast("array<struct<start:int,end:int>>")))
    return full.select("doc_id", "text_hash", F.filter("spans", lambda s: s["rank"] < _GENERIC).alias("base"), "spans", "masks")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(spans: Column) -> Column:
    """start and end of what spans (by start) cover, overlapping ones as one.  Spans that are apart already, as find_secrets() gives its
    masks, are only looked through once."""
    bare = F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    laps = F.exists(F.transform(spans, lambda s, i: (i > 0) & (s["start"] < F.get(spans, i - 1)["end"])), lambda x: x)

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.coalesce(s["start"] < last["end"], F.lit(False)), longer).otherwise(F.concat(acc, F.array(s)))

    return F.when(laps, F.aggregate(bare, F.array().cast("array<struct<start:int,end:int>>"), step)).otherwise(bare)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span (by start) replaced; overlapping ones become one.  Pieces are cut from four-byte code points, each by its offset; lambdas'
    variables hold the coded text and the places, so that they are made once and not for every piece."""
    # a piece's first sign may be a byte order mark, which decoding takes away: so each gets one to lose
    piece = lambda wide, at, n: F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substr(wide, at * 4 + 1, n * 4)), "UTF-32")

    def cut(wide: Column, masks: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(masks, i - 1)["end"])
        last = F.element_at(masks, -1)["end"]
        gaps = F.transform(masks, lambda m, i: piece(wide, before(i), m["start"] - before(i)))
        return F.concat(F.array_join(gaps, mark), F.lit(mark), piece(wide, last, F.length(wide)))

    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    whole = once(F.encode(text, "UTF-32"), lambda wide: once(_apart(spans), lambda masks: cut(wide, masks)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
