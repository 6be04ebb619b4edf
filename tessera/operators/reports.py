"""Aggregations, set operations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequence import running, tasks_of
from tessera.store import materialize


def class_counts(links: DataFrame, key: list[str], cls: str) -> DataFrame:
    return links.groupBy(cls).agg(F.countDistinct(F.struct(*key)).alias("n"))


def coverage(rows: DataFrame, by: list[str], matched: str, weight: str) -> DataFrame:
    """matched and total weight, whole numbers, and their share in percent, rounded down."""
    hit = F.sum(F.when(F.col(matched), F.col(weight)).otherwise(0))
    return rows.groupBy(*by).agg(hit.alias("hit"), F.sum(weight).alias("total")).withColumn("percent", F.floor(100 * F.col("hit") / F.col("total")).cast("long"))


def group_bounds(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(col).alias("low"), F.max(col).alias("high"), F.count("*").alias("n"))


def commonest_form(words: DataFrame, key: str, form: str, pos: str, fold: F.Column | None = None) -> DataFrame:
    """The most frequent form of every key; of equals, the one seen first.  With `fold`, an expression over the form, the key is made from
    distinct forms, not from every word; an empty key is left out."""
    if fold is None:
        n = words.groupBy(key, form).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    else:
        n = words.groupBy(form).agg(F.count("*").alias("n"), F.min(pos).alias("first")).withColumn(key, fold).filter(F.col(key) != "")
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", form)).alias("b")).select(key, F.col(f"b.{form}").alias(form), (-F.col("b.m")).alias("n"))


def score_links(ref: DataFrame, cand: DataFrame, key: list[str]) -> DataFrame:
    """tp, n_ref, n_cand and F1 in thousandths, rounded down; 0 where there is nothing."""
    a, b = ref.select(*key).distinct(), cand.select(*key).distinct()
    one = a.join(b, key).agg(F.count("*").alias("tp")).crossJoin(a.agg(F.count("*").alias("n_ref"))).crossJoin(b.agg(F.count("*").alias("n_cand")))  # three single rows
    return one.withColumn("f1", F.when(F.col("n_ref") + F.col("n_cand") > 0, F.floor(2000 * F.col("tp") / (F.col("n_ref") + F.col("n_cand")))).otherwise(0).cast("long"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(col, values).count().na.fill(0)


def exactly_once(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """key, problem: 'missing' or 'repeated'."""
    n = expected.select(key).distinct().join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    return n.select(key, F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("problem")).filter("problem IS NOT NULL")


def vote(df: DataFrame, by: list[str], a: F.Column, b: F.Column) -> DataFrame:
    n = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return df.groupBy(*by).agg(n(a).alias("votes_a"), n(b).alias("votes_b")).withColumn("winner", F.when(F.col("votes_a") >= F.col("votes_b"), "a").otherwise("b"))


def nest(df: DataFrame, parent: list[str], order: list[str], child: list[str], out: str) -> DataFrame:
    """Children as an ordered array of structs (bounded by a parent's children)."""
    return df.groupBy(*parent).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in child if c not in order]))).alias(out))


def first_seen_order(df: DataFrame, group: str, sort: str) -> DataFrame:
    return df.groupBy(group).agg(F.min(sort).alias("first_seen"), F.count("*").alias("n"))


def top_k(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values; ties to the greater value."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(by)).limit(k)


def preferred_first(df: DataFrame, group: list[str], prefer: F.Column, name: str) -> DataFrame:
    """The preferred row of every group, else the first by name; an aggregate, so a hot group is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in group]
    row = F.min_by(F.struct(*rest), F.struct(F.when(prefer, 0).otherwise(1).alias("__p"), F.col(name)))
    return df.groupBy(*group).agg(row.alias("__row")).select(*group, "__row.*")


def first_examples(rows: DataFrame, group: list[str], order: list[str], what: str, n: int = 6) -> DataFrame:
    """group, examples: the first `n` values of `what` by `order`, ties by the value; no more of a group than these are gathered, from every task."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order, what))
    few = rows.withColumn("__k", at).filter(F.col("__k") <= n)
    return few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("__k", what))).alias("x")).select(*group, F.col(f"x.{what}").alias("examples"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """A repeatable sample of n rows: those whose hashed keys come first."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def ordered_distinct(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows are only in a, only in b (as multisets), and whether the schemas agree."""
    only = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias(n))
    return only(a, b, "only_a").crossJoin(only(b, a, "only_b")).withColumn("same_schema", F.lit(a.schema == b.schema))  # two single rows


def _one_per_key(base: DataFrame, new: DataFrame, pk: list[str], order: list[str], first: bool) -> DataFrame:
    """base is loaded before new, and each in `order`; of the rows of a key the first or the last one stays.  The choice is an
    aggregate, so a hot key is reduced before it is shuffled."""
    side = lambda df, k: df.select(F.struct(*df.columns).alias("row"), *pk, F.struct(F.lit(k).alias("side"), *order).alias("at"))
    both = side(base, 0).unionByName(side(new.select(*base.columns), 1))
    pick = F.min_by if first else F.max_by
    return both.groupBy(*pk).agg(pick("row", "at").alias("row")).select("row.*")


def insert_ignore(base: DataFrame, new: DataFrame, pk: list[str], order: list[str]) -> DataFrame:
    """The first row of a key by load order wins."""
    return _one_per_key(base, new, pk, order, True)


def insert_replace(base: DataFrame, new: DataFrame, pk: list[str], order: list[str]) -> DataFrame:
    """The last row of a key by load order wins."""
    return _one_per_key(base, new, pk, order, False)


def evolve_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns that df lacks, as nulls of the given type."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in schema.items() if c not in have})


def content_version(df: DataFrame, cols: list[str]) -> DataFrame:
    """16 hex digits that don't depend on row order: the sorted per-bucket sums of row hashes, hashed."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sum(part).alias("s"), F.count("*").alias("n")).select(F.substring(F.sha2(F.concat_ws(":", F.col("s").cast("string"), F.col("n").cast("string")), 256), 1, 16).alias("version"), "n")


def compact(df: DataFrame, keys: list[str], dict_cols: list[str], order: list[str], derived: dict[str, Column] | None = None, chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of rows per key with coded columns, and the code table (kind, id, value); an id is the value's whole SHA-256, which two values
    don't share and Parquet's dictionaries make small.

    derived: column -> expression over the other columns; a value that it gives (null or not) is left out, any other is kept as it is, row by row; a column that
    it gives for every row is left out of the chunks.  chunk_rows: a key's rows are dealt in order to chunks of so many (column chunk, from 0), numbered
    over ranges of rows, so that no key becomes one row; without it keys are divisions of a text, bounded as these are."""
    dicts = None
    for c in dict_cols:
        ids = df.select(F.col(c).alias("value")).distinct().filter("value IS NOT NULL")
        ids = ids.select(F.lit(c).alias("kind"), F.sha2("value", 256).alias("id"), "value")
        dicts = ids if dicts is None else dicts.unionByName(ids)
    made = df
    for c, rule in (derived or {}).items():
        kept = F.when(~F.col(c).eqNullSafe(rule.cast(df.schema[c].dataType)), F.struct(F.col(c).alias("value")))
        made = made.withColumn(f"__kept_{c}", kept)
    made = made.drop(*(derived or {}))
    dicts = materialize(dicts, "codes") if dicts is not None else None
    if derived:
        made = materialize(made, "derived")
        have = made.agg(*[F.count(f"__kept_{c}").alias(c) for c in derived]).first()
        made = made.drop(*[f"__kept_{c}" for c in derived if not have[c]])
    coded = made.withColumns({c: F.sha2(c, 256) for c in dict_cols})
    whole = list(keys)
    if chunk_rows:
        own = {c: f"__own_{c}" for c in coded.columns}  # a column of the rows may be named i
        by = [own[c] for c in [*order, *[c for c in coded.columns if c not in keys and c not in order and not c.startswith("__kept_")]]]
        n = made.count()
        numbered = running(coded.withColumnsRenamed(own), [own[k] for k in keys], by, {}, rows=n)
        coded = numbered.withColumn("chunk", F.floor((F.col("i") - 1) / chunk_rows).cast("long")).drop("i").withColumnsRenamed({o: c for c, o in own.items()})
        whole.append("chunk")
        coded = coded.repartition(tasks_of(df.sparkSession, n), *whole)  # (codes shrink so well that tasks cut by size hold too many rows)
    rest = [c for c in coded.columns if c not in whole and c not in order]
    return coded.groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows")), dicts


def restore(chunks: DataFrame, dicts: DataFrame, keys: list[str], dict_cols: list[str], columns: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """The rows that `compact` was given: codes by the code table, left out values by their expressions."""
    out = chunks.select(*keys, F.inline("rows"))
    for c in dict_cols:
        table = dicts.filter(F.col("kind") == c).select(F.col("id").alias(c), F.col("value").alias(f"__{c}"))
        out = out.join(table, c, "left").withColumn(c, F.col(f"__{c}")).drop(f"__{c}")
    for c, rule in (derived or {}).items():
        kept = f"__kept_{c}"
        out = out.withColumn(c, F.when(F.col(kept).isNotNull(), F.col(f"{kept}.value")).otherwise(rule) if kept in out.columns else rule)
    return out.select(*columns)


def recording_report(units: DataFrame, key: list[str], speaker: Column, passed: Column, weak: float) -> DataFrame:
    """units: start, end, score.  Per recording: units, first, last, seconds, median score, weak ones (under `weak`), passed over, and of the
    speakers' names how many were heard (have a score) of how many."""
    n = lambda c: F.count_if(c)
    return units.groupBy(*key).agg(
        F.count("*").alias("units"), F.min("start").alias("first"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.median("score").alias("median_score"),
        n(F.col("score") < weak).alias("weak"), n(passed).alias("passed_over"), n(speaker & F.col("score").isNotNull()).alias("heard"), n(speaker).alias("speakers"))


def link_report(ref: DataFrame, cand: DataFrame, words: DataFrame, key: list[str], target: str) -> DataFrame:
    """ref, cand: key, target; words: key.  shared, precision and recall in thousandths (0 where there is nothing), how many words have the same set
    of targets on both sides, share at least one, and have any in ref.  One row."""
    # one table of marks (1: ref, 2: cand, 0: a word alone), dealt by key once in tasks of bounded rows; null targets equal none, null keys no key
    none = F.lit(None).cast(ref.schema[target].dataType).alias(target)
    side = lambda df, m: df.filter(F.array_position(F.array(*[F.col(k).isNull() for k in key]), True) == 0).select(*key, target, F.lit(m).alias("__m"))
    rows = words.select(*key, none, F.lit(0).alias("__m")).unionByName(side(ref, 1)).unionByName(side(cand, 2))
    rows = rows.repartition(tasks_of(rows.sparkSession, rows.count()), *key).withColumn("__n", F.when(F.col(target).isNull(), F.col("__m")).otherwise(-1))
    met = rows.groupBy(*key, target, "__n").agg(F.bit_or("__m").alias("m"))
    n = lambda m: F.count_if(F.col("m").bitwiseAND(m) == m)
    each = met.groupBy(*key).agg(n(1).alias("r"), n(2).alias("c"), n(3).alias("both"), F.bool_or(F.col("__n") == 0).alias("__word")).filter("__word")
    total = each.agg(F.sum("both").alias("shared"), F.sum("c").alias("n_cand"), F.sum("r").alias("n_ref"), F.count_if((F.col("r") == F.col("both")) & (F.col("c") == F.col("both"))).alias("same_set"), F.count_if(F.col("both") > 0).alias("any_shared"), F.count_if(F.col("r") > 0).alias("with_ref"))
    part = lambda n: F.when(F.col(n) > 0, F.floor(1000 * F.col("shared") / F.col(n))).otherwise(0).cast("long")
    return total.select("shared", part("n_cand").alias("precision"), part("n_ref").alias("recall"), "same_set", "any_shared", "with_ref")


def union_numbered(order: list[str], **sources: DataFrame) -> DataFrame:
    """Sources of one shape after another, in the order named: source, their columns, and pos over all, by source and `order` (total)."""
    from tessera.operators.sequence import running

    out = None
    for n, (name, df) in enumerate(sources.items()):
        one = df.withColumn("source", F.lit(name)).withColumn("__source", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return running(out, [], ["__source", *order], {}).withColumnRenamed("i", "pos").drop("__source")


def index_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: name, definition of indexes or columns: those only one side has, or that differ."""
    met = a.select("name", F.col("definition").alias("left")).join(b.select("name", F.col("definition").alias("right")), "name", "full")
    return met.filter(~F.col("left").eqNullSafe(F.col("right")))
