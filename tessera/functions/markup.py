"""Nested markup as rows: a running depth for every kind of element, and texts as styled runs.

A text is cut into tokens (tags and what lies between them), each a row with its place.  Levels are running sums of +1 and -1 within a
text, one count per element name, so that elements of several names may cross, stay open or be closed without having been opened:
a closing tag belongs to the last open one of its name, one without goes unused, and an element that is never closed reaches to the
text's end.  Windows are keyed by text, and no array grows step by step: the work is that of sorting a text's tokens.

Nulls: a null text has no runs (an empty array).  Texts that repeat a key are one text to these functions: keys must be unique.  Comments count as
nothing.  Empty texts have an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import unescape_closed

RUNS = "array<struct<kind:string,text:string>>"
_TOKEN = r"<!--[\s\S]*?(?:-->|\z)|<[/A-Za-z][^<>]*>|[^<]+|<"
_NAME = r"^<(/?)([A-Za-z][^\s/>]*)"


def markup_tokens(df: DataFrame, keys: list[str], col: str, void: tuple[str, ...] = ("br", "hr", "img", "meta", "link", "input", "pb", "lb")) -> DataFrame:
    """keys, i, token, name (of a tag, small letters), step: 1 opens, -1 closes, 0 is neither."""
    rows = df.select(*keys, F.posexplode(F.regexp_extract_all(col, F.lit(f"({_TOKEN})"), F.lit(1))).alias("i", "token")).filter(~F.startswith("token", F.lit("<!--")))
    name = F.lower(F.nullif(F.regexp_extract("token", _NAME, 2), F.lit("")))
    alone = F.endswith("token", F.lit("/>")) | name.isin(*void)
    step = F.when(name.isNull() | alone, 0).when(F.startswith("token", F.lit("</")), -1).otherwise(1)
    return rows.select(*keys, "i", "token", name.alias("name"), step.alias("step"))


def matched(tags: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """tags: keys, i, name, step (1 or -1) -> with level (the depth of the element within its own name) and opened_at: for a closing tag the
    place of the one that it closes.  Closing tags without an open one are left out."""
    w = Window.partitionBy(*keys, name).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = tags.withColumn("__s", F.sum("step").over(w))
    floors = sums.withColumn("__low", F.least(F.lit(0), F.min("__s").over(w))).withColumn("__before", F.least(F.lit(0), F.min("__s").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    used = floors.filter((F.col("step") > 0) | (F.col("__s") >= F.coalesce("__before", F.lit(0))))
    used = used.withColumn("level", F.col("__s") - F.col("__low") + F.when(F.col("step") < 0, 1).otherwise(0))
    pair = Window.partitionBy(*keys, name, "level").orderBy("i")
    return used.withColumn("opened_at", F.when(F.col("step") < 0, F.lag("i").over(pair))).drop("__s", "__low", "__before")


def innermost(places: DataFrame, elements: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """places: keys, i; elements: keys, i, kind, step (matched) -> keys, i, kind: the kind of the element opened last among those that hold the place;
    null where none does."""
    asked = places.select(*keys, "i", F.explode(F.array(*map(F.lit, kinds))).alias("kind"), F.lit(0).alias("step"))
    w = Window.partitionBy(*keys, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    deep = elements.select(*keys, "i", "kind", "step").unionByName(asked).withColumn("__level", F.sum("step").over(w))
    at = Window.partitionBy(*keys, "kind", "__level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    seen = deep.withColumn("__open", F.max(F.when(F.col("step") > 0, F.col("i"))).over(at)).filter("step = 0")
    return seen.groupBy(*keys, "i").agg(F.max_by("kind", F.when(F.col("__level") > 0, F.col("__open"))).alias("kind"))


def styled_runs(df: DataFrame, keys: list[str], col: str, styles: dict[str, str], plain: str = "t", skip: str | None = None, signs: dict[str, tuple[str, str]] | None = None, converted: Column | None = None) -> DataFrame:
    """keys, runs (array<struct<kind,text>>) of every text.

    styles: kind -> pattern of the opening tags that give it; the innermost such element decides.  skip: pattern of opening tags whose content goes.
    signs: tag name -> what is written before and after its content, in the plain kind.  Texts of one kind in a row are one run, blanks within and between
    runs are one, and none stands at the ends.  Character references that end in a semicolon are decoded.  converted: a column over `text` and `kind` that rewrites a piece."""
    tokens = markup_tokens(df, keys, col)
    kind = F.lit(None).cast("string")
    for k, pattern in reversed([*styles.items(), *([("\x01skip", skip)] if skip else [])]):
        kind = F.when(F.col("token").rlike(f"(?i){pattern}"), F.lit(k)).otherwise(kind)
    tags = matched(tokens.filter("step <> 0"), keys)
    opened = tags.filter("step > 0").select(*keys, "i", kind.alias("kind"), F.lit(1).alias("step")).filter("kind IS NOT NULL")
    closed = tags.filter("step < 0").select(*keys, F.col("i").alias("__i"), F.col("opened_at").alias("i")).join(opened.drop("step"), [*keys, "i"]).select(*keys, F.col("__i").alias("i"), "kind", F.lit(-1).alias("step"))
    texts = tokens.filter("name IS NULL").select(*keys, "i", unescape_closed(F.col("token")).alias("text"))
    kinds = [*styles, *(["\x01skip"] if skip else [])]
    elements = opened.unionByName(closed)
    inside = innermost(texts, elements.filter(F.col("kind") != "\x01skip"), keys, list(styles))
    met = texts.join(inside, [*keys, "i"], "left").withColumn("kind", F.coalesce("kind", F.lit(plain)))
    if skip:
        gone = innermost(texts, elements.filter(F.col("kind") == "\x01skip"), keys, kinds[-1:]).filter("kind IS NOT NULL")
        met = met.join(gone.select(*keys, "i"), [*keys, "i"], "left_anti")
    if converted is not None:
        met = met.withColumn("text", converted)
    for name, (before, after) in (signs or {}).items():
        sign = F.when(F.col("step") > 0, before).otherwise(after)
        met = met.unionByName(tags.filter(F.col("name") == name).select(*keys, "i", sign.alias("text"), F.lit(plain).alias("kind")))
    order = Window.partitionBy(*keys).orderBy("i")
    flat = met.withColumn("text", F.regexp_replace("text", r"\s+", " ")).filter("text <> ''")
    new = F.coalesce((F.col("kind") != F.lag("kind").over(order)).cast("int"), F.lit(1))
    runs = flat.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order)).groupBy(*keys, "__run", "kind").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("x"))
    runs = runs.select(*keys, "__run", "kind", F.regexp_replace(F.array_join("x.text", ""), " +", " ").alias("text"))
    # a blank that two runs share stands at the end of the first
    by = Window.partitionBy(*keys).orderBy("__run")
    seam = F.coalesce(F.endswith(F.lag("text").over(by), F.lit(" ")), F.lit(True))
    runs = runs.withColumn("text", F.when(seam, F.ltrim("text")).otherwise(F.col("text")))
    runs = runs.withColumn("text", F.when(F.lead("kind").over(by).isNull(), F.rtrim("text")).otherwise(F.col("text"))).filter("text <> ''")
    made = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__run", "kind", "text"))).alias("x"))
    made = made.select(*keys, F.transform("x", lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text"))).alias("runs"))
    return df.select(*keys).join(made, keys, "left").withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))


def keyed_paragraphs(notes: DataFrame, keys: list[str], col: str, paragraph: str = "p") -> DataFrame:
    """keys, para (from 0), inner: a row for every outermost paragraph element of a note; a note without one is one paragraph."""
    tokens = markup_tokens(notes, keys, col)
    opens = matched(tokens.filter((F.col("step") != 0) & (F.col("name") == paragraph)), keys).filter("step > 0").select(*keys, "i", F.lit(1).alias("__opens"))
    order = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    dealt = tokens.join(opens, [*keys, "i"], "left").withColumn("__para", F.coalesce(F.sum("__opens").over(order), F.lit(0)))
    parts = dealt.filter(F.coalesce(F.col("name") != paragraph, F.lit(True))).groupBy(*keys, "__para").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("x"))
    parts = parts.select(*keys, "__para", F.array_join("x.token", "").alias("inner")).filter(F.trim(F.regexp_replace("inner", "<[^<>]*>", "")) != "")
    return parts.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("__para")) - 1).alias("para"), "inner")
