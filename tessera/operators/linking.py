"""Joins that link words, ranges and positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.alignment import _by_group, _spread
from tessera.store import materialize


def cascade(queries: DataFrame, entries: DataFrame, levels: list[tuple[str, Column]], aliases: DataFrame | None = None, tie: tuple[str, Column, Column] | None = None) -> DataFrame:
    """queries: word; entries: entry.  Distinct words go level by level: name of the level and the key both sides
    take there.  The first level is exact; a later one counts only where one entry has the key.  Adds entry, method.

    aliases: word, see; a word that has none of its own goes to the entry that its alias names ("alias", after exact).  tie: a level, a condition on a
    word and one on an entry (both over `word`): where several entries have the key, a word that meets the first goes to the one that meets the second, if
    it is the only one."""
    names = F.array(F.lit(levels[0][0]), F.lit("alias"), *[F.lit(name) for name, _ in levels[1:]])
    place = [0, *range(2, len(levels) + 1)]
    keyed = lambda df: df.select("word", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), key.alias("key")) for n, (_, key) in zip(place, levels, strict=True)])).alias("k")).select("word", "k.level", "k.key").filter(F.col("key") != "")
    todo = queries.select("word").distinct()
    asked = keyed(todo)
    if aliases is not None:
        seen = todo.join(aliases.select("word", "see"), "word").select("word", F.lit(1).alias("level"), F.col("see").alias("key"))
        asked = asked.unionByName(seen)
    # distinct words of either side with a key per level, in one table: what meets is found by one shuffle, whatever the number of levels
    own = keyed(entries.select(F.col("entry").alias("word")).distinct())
    own = own.unionByName(own.filter("level = 0").withColumn("level", F.lit(1))) if aliases is not None else own
    tied = F.lit(False) if tie is None else (F.col("level") == place[[n for n, _ in levels].index(tie[0])]) & tie[2]
    have = own.withColumn("fit", tied).groupBy("level", "key").agg(F.min("word").alias("entry"), F.count("*").alias("n"), F.min(F.when(F.col("fit"), F.col("word"))).alias("chosen"), F.count_if("fit").alias("n_fit"))
    met = asked.join(have, ["level", "key"])
    may = F.lit(False) if tie is None else tie[1]
    entry = F.when((F.col("level") < 2) | (F.col("n") == 1), F.col("entry")).when(may & (F.col("n_fit") == 1), F.col("chosen"))
    best = met.withColumn("entry", entry).filter("entry IS NOT NULL").groupBy("word").agg(F.min(F.struct("level", "entry")).alias("m"))
    out = todo.join(best, "word", "left")
    return out.select("word", F.col("m.entry").alias("entry"), F.coalesce(F.get(names, F.col("m.level")), F.lit("none")).alias("method"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """left, right: start, end (closed whole numbers) with the same equi keys; every overlapping pair, once.

    Each side is dealt to the axis buckets it touches, and a pair is taken in the bucket where the later of its two starts lies: so only
    neighbours meet, not all intervals of a key.  width: a bucket's length; without it the mean length of both sides' intervals, by a pass over both."""
    r = right.withColumnsRenamed({"start": "r_start", "end": "r_end"})
    if width is None:
        mean = left.select((F.col("end") - F.col("start")).alias("n")).unionByName(r.select((F.col("r_end") - F.col("r_start")).alias("n"))).agg(F.avg("n")).first()[0]
        width = max(1, int(mean or 0) + 1)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    deal = lambda df, a, b: df.filter(F.col(a) <= F.col(b)).withColumn("__b", F.explode(F.sequence(bucket(a), bucket(b))))
    met = deal(left, "start", "end").join(deal(r, "r_start", "r_end"), [*keys, "__b"])
    later = F.floor(F.greatest("start", "r_start") / width).cast("long")
    return met.filter((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("__b") == later)).drop("__b")


def count_cover(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """points: pos -> n_cover, how many ranges (start, end, closed whole numbers) lie over it.  Each range adds one at its start and takes it away after its
    end; a point has the sum of what comes before it, whatever the ranges' lengths."""
    plus = ranges.filter(F.col("start") <= F.col("end"))
    steps = plus.select(*keys, F.col("start").cast("long").alias("__at"), F.lit(1).cast("long").alias("__d")).unionByName(plus.select(*keys, (F.col("end") + 1).cast("long").alias("__at"), F.lit(-1).cast("long").alias("__d")))
    steps = steps.groupBy(*keys, "__at").agg(F.sum("__d").alias("__d"))
    both = points.withColumn("__at", F.col("pos").cast("long")).withColumn("__d", F.lit(0).cast("long")).withColumn("__point", F.lit(1)).unionByName(steps, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("n_cover", F.sum("__d").over(w)).filter("__point = 1").drop("__at", "__d", "__point")


def asof(events: DataFrame, units: DataFrame, keys: list[str], value: str, slack: float = 0) -> DataFrame:
    """events: at; units: at, value.  The last unit's value at or before every event, or at most `slack` after it; one window, no pairs."""
    both = events.withColumn("__kind", F.lit(1)).unionByName(units.select(*keys, (F.col("at") - slack if slack else F.col("at")).alias("at"), F.col(value).alias("__value")).withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(w)).filter("__kind = 1").drop("__kind", "__value")


def near_any(points: DataFrame, spans: DataFrame, before: float, after: float, keys: list[str]) -> DataFrame:
    """points: at -> near: it lies within [start - before, end + after] of a span.  Axis buckets keep the join equi."""
    width = 64.0 * (before + after + 1)
    bucket = lambda c: F.floor(c / width).cast("long")
    cut = spans.select(*keys, (F.col("start") - before).alias("lo"), (F.col("end") + after).alias("hi"))
    cut = cut.withColumn("b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    hits = points.withColumn("b", bucket(F.col("at"))).join(cut, [*keys, "b"]).filter((F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi")))
    found = hits.select(*keys, "at").distinct().withColumn("near", F.lit(True))
    return points.join(found, [*keys, "at"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def nearest(points: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """points: at, refs: at -> dist to the nearest ref of the key (null without refs)."""
    both = points.withColumn("__p", F.lit(True)).unionByName(refs.select(*keys, "at", F.col("at").alias("__r")), allowMissingColumns=True)
    # refs come first among rows of one place, in both directions: each then sees all refs at or before, at or after it
    seen = lambda order: F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order, F.col("__p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    prev, nxt = seen(F.asc("at")), seen(F.desc("at"))
    return both.withColumn("dist", F.least(F.col("at") - prev, nxt - F.col("at"))).filter("__p").drop("__p", "__r")


def coalesce_sources(rows: DataFrame, key: list[str], *sources: tuple[str, DataFrame]) -> DataFrame:
    """sources: (name, key + value).  The first source that has a value, and its name."""
    for k, (_, df) in enumerate(sources):
        rows = rows.join(df.select(*key, F.col("value").alias(f"v{k}")), key, "left")
    name = F.coalesce(*[F.when(F.col(f"v{k}").isNotNull(), F.lit(n)) for k, (n, _) in enumerate(sources)], F.lit("none"))
    return rows.withColumn("value", F.coalesce(*[f"v{k}" for k in range(len(sources))])).withColumn("from_source", name).drop(*[f"v{k}" for k in range(len(sources))])


def word_cards(places: DataFrame, key: list[str], treebank: DataFrame, gloss: DataFrame, own: DataFrame, auto: DataFrame, note: DataFrame) -> DataFrame:
    """Every word with the first of its sources (key, value): the treebank and then a gloss, both only where the text has no row of its own for the word; its own
    row; an automatic analysis; a note."""
    without = lambda df: df.join(own, key, "left_anti")
    return coalesce_sources(places, key, ("treebank", without(treebank)), ("gloss", without(gloss)), ("words", own), ("automatic", auto), ("note", note))


def with_parent(rows: DataFrame, group: str, ident: str, parent: str, value: str, out: str) -> DataFrame:
    """The parent's value: '' at a root (parent 0), null where the parent is unknown."""
    up = rows.select(F.col(group), F.col(ident).alias(parent), F.col(value).alias("__up"))
    return rows.join(up, [group, parent], "left").withColumn(out, F.when(F.col(parent) == 0, F.lit("")).otherwise(F.col("__up"))).drop("__up")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def compare_sets(ref: DataFrame, cand: DataFrame, keys: list[str], val: str) -> DataFrame:
    """Per key: both, only_ref, only_cand, equal."""
    a = ref.select(*keys, val).distinct().withColumn("r", F.lit(1))
    b = cand.select(*keys, val).distinct().withColumn("c", F.lit(1))
    n = lambda x: F.count(F.when(x, 1))
    both = a.join(b, [*keys, val], "full")
    out = both.groupBy(*keys).agg(n(F.col("r").isNotNull() & F.col("c").isNotNull()).alias("both"), n(F.col("c").isNull()).alias("only_ref"), n(F.col("r").isNull()).alias("only_cand"))
    return out.withColumn("equal", (F.col("only_ref") == 0) & (F.col("only_cand") == 0))


def uncovered_passages(passages: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """passages (start, end) unless every position is among the lines (pos)."""
    cells = passages.select(*keys, "start", "end", F.explode(F.sequence("start", "end")).alias("pos"))
    have = lines.select(*keys, "pos").distinct().withColumn("__have", F.lit(True))
    whole = cells.join(have, [*keys, "pos"], "left").groupBy(*keys, "start", "end").agg(F.bool_and(F.coalesce("__have", F.lit(False))).alias("split"))
    return whole.filter("NOT split").drop("split")


def match_occurrences(left: DataFrame, right: DataFrame, keys: list[str], word: str, order: str) -> DataFrame:
    """The nth occurrence of a word on one side with the nth on the other."""
    w = Window.partitionBy(*keys, word).orderBy(order)
    a = left.withColumn("nth", F.row_number().over(w)).withColumnRenamed(order, f"left_{order}")
    b = right.withColumn("nth", F.row_number().over(w)).withColumnRenamed(order, f"right_{order}")
    return a.join(b.select(*keys, word, "nth", f"right_{order}"), [*keys, word, "nth"])


def best_version(shared: DataFrame, item: str, version: str, score: str) -> DataFrame:
    """The version with the highest score; ties to the smaller name."""
    w = Window.partitionBy(item).orderBy(F.desc(score), version)
    return shared.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def place_notes(notes: DataFrame, segs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """notes: ref -> seq range of that ref; notes that have none are returned apart."""
    spans = segs.groupBy(*keys, "ref").agg(F.min("seq").alias("seq_from"), F.max("seq").alias("seq_to"))
    met = notes.join(spans, [*keys, "ref"], "left")
    return met.filter("seq_from IS NOT NULL"), met.filter("seq_from IS NULL").drop("seq_from", "seq_to")


def remap_refs(rows: DataFrame, moved: DataFrame, explicit: DataFrame) -> DataFrame:
    """rows: book, line.  explicit: book, line, to_book, to_line, drop; else moved runs: book, line_from, line_to, to_book, shift.
    An explicit reference wins; one marked drop goes; rows without a rule stay."""
    runs = moved.select("book", F.explode(F.sequence("line_from", "line_to")).alias("line"), F.col("to_book").alias("m_book"), "shift")
    met = rows.join(explicit, ["book", "line"], "left").join(runs, ["book", "line"], "left").filter("drop IS NULL OR NOT drop")
    out = met.withColumn("new_book", F.coalesce("to_book", "m_book", "book")).withColumn("new_line", F.coalesce("to_line", F.col("line") + F.col("shift"), "line"))
    return out.drop("to_book", "to_line", "drop", "m_book", "shift")


def spare_suffixes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: num, suffix.  A suffixed place is kept only if its plain number is not there."""
    plain = rows.filter("suffix = ''").select(*keys, "num").distinct()
    return rows.filter("suffix = ''").unionByName(rows.filter("suffix <> ''").join(plain, [*keys, "num"], "left_anti"))


def _rare_first(rows: DataFrame, counts: DataFrame, keys: list[str], row: list[str], least: int) -> DataFrame:
    """rows: keys, row, n, w (distinct words) -> keys, row, n, word: of each row as many of its rarest words as it takes for every row that is `least` alike
    (in thousandths of 2 x shared over all) to share one of these with it.

    With n words a partner has b >= n * t / (2 - t) of them and shares o >= t * (n + b) / 2, so one shared word is among the n - o + 1 rarest."""
    words = rows.select(*keys, *row, "n", F.explode("w").alias("word")).join(counts, [*keys, "word"], "left")
    in_order = words.groupBy(*keys, *row, "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "word"))).alias("x"))
    shared = F.expr(f"cast(ceil({least} * (n + ceil(n * {least} / (2000.0 - {least}) - 1e-9)) / 2000.0 - 1e-9) as int)")
    return in_order.withColumn("__k", F.greatest(F.lit(0), F.least(F.col("n"), F.col("n") - shared + 1)).cast("int")).select(*keys, *row, "n", F.explode(F.slice("x", F.lit(1), F.col("__k"))["word"]).alias("word"))


def pair_similar(left: DataFrame, right: DataFrame, keys: list[str], own: int = 600, least: int = 500, whole: int = 1 << 21) -> DataFrame:
    """left, right: num (whole numbers), words (arrays).  The right row of the same number if their similarity (2 x shared distinct words over all,
    in thousandths) is at least `own`; else the most similar one; if that has less than `own`, two rows of adjacent numbers joined may be more
    similar (joined: the first of them); `least` or more is needed.  Ties: single rows first, then the smaller number.

    Keys of up to `whole` words of both sides are done in one task's pass, after one shuffle of the rows (`_paired`); longer ones by joins over
    all tasks, with the same result."""
    kinds = {"l": left.schema["num"].dataType, "r": right.schema["num"].dataType}
    side = lambda df, n: df.filter(F.col("num").isNotNull() & F.col("words").isNotNull()).select(*keys, F.lit(n).cast("byte").alias("side"), "num", F.array_distinct(F.array_compact("words")).alias("words"))
    a, b = side(left, 0), side(right, 1)
    sizes = left.select(*keys, "words").unionByName(right.select(*keys, "words")).groupBy(*keys).agg(F.sum(F.size("words").cast("long")).alias("n"))
    long = materialize(sizes.filter(F.col("n") > whole).select(*keys), "long")
    if not long.limit(1).count():
        return _pair_short(a, b, keys, own, least, kinds)
    part = lambda how: [df.join(F.broadcast(long), keys, how) for df in (a, b)]  # a row per key of over `whole` words
    return _pair_short(*part("left_anti"), keys, own, least, kinds).unionByName(_pair_long(*part("left_semi"), keys, own, least))


def _pair_short(a: DataFrame, b: DataFrame, keys: list[str], own: int, least: int, kinds: dict) -> DataFrame:
    rows = a.withColumn("num", F.col("num").cast("long")).unionByName(b.withColumn("num", F.col("num").cast("long")))
    got = _by_group(rows, keys, ["side", "num"], lambda x: _paired(x, own, least), "l long, r long, score long, joined boolean", arrow=True)
    return got.select(*keys, *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], "score", "joined")


def _paired(x: dict[str, np.ndarray], own: int, least: int, cells: int = 1 << 22) -> dict[str, np.ndarray]:
    """Rows of whole keys (g, side, num in order, words, each once) -> the best partner of each row of side 0: `pair_similar`.  Shared words are counted
    in blocks of rows whose partners and common words are `cells` at most (or of one row)."""
    g, num = x["g"], x["num"]
    code = pc.dictionary_encode(x["words"].flatten()).indices.to_numpy().astype(np.int64)
    size = pc.list_value_length(x["words"]).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    mine, single = np.flatnonzero(x["side"] == 0), np.flatnonzero(x["side"] == 1)
    two = single[:-1][(g[single[1:]] == g[single[:-1]]) & (num[single[1:]] == num[single[:-1]] + 1)]
    # the other side's rows, then two of them joined, group by group; every word of a group with its rows
    row, joined = np.concatenate([single, two]), np.arange(len(single) + len(two)) >= len(single)
    order = np.argsort(g[row], kind="stable")
    row, joined = row[order], joined[order]
    wide, n = int(code.max(initial=0)) + 1, max(1, len(row))
    of, at = _spread(start[row], size[row])
    pair = np.flatnonzero(joined)
    more, next_at = _spread(start[row[pair] + 1], size[row[pair] + 1])
    of, at = np.concatenate([of, pair[more]]), np.concatenate([at, next_at])
    word, of = np.divmod(np.unique((g[row[of]] * wide + code[at]) * n + of), n)
    theirs = np.bincount(of, minlength=len(row))
    # what each row of side 0 meets: the rows of its group, and each of its words' rows
    own_of, own_at = _spread(start[mine], size[mine])
    asked = g[mine[own_of]] * wide + code[own_at]
    first = np.searchsorted(word, asked)
    shares = np.searchsorted(word, asked, "right") - first
    r0 = np.searchsorted(g[row], g[mine])
    room = np.searchsorted(g[row], g[mine], "right") - r0
    block = np.cumsum(room + np.bincount(own_of, weights=shares, minlength=len(mine)).astype(np.int64)) // cells
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(mine)]
    made = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        e0, e1 = np.searchsorted(own_of, [lo, hi])
        base = np.cumsum(room[lo:hi]) - room[lo:hi] - r0[lo:hi]
        e, met = _spread(first[e0:e1], shares[e0:e1])
        shared = np.bincount(base[own_of[e0:e1][e] - lo] + of[met], minlength=int(room[lo:hi].sum()))
        hit = np.flatnonzero(shared)
        a = np.repeat(np.arange(hi - lo), room[lo:hi])[hit]
        b = hit - base[a]
        score = 2000 * shared[hit] // (size[mine[lo:hi]][a] + theirs[b])
        same = ~joined[b] & (num[mine[lo:hi]][a] == num[row[b]]) & (score >= own)
        rank = np.where(same, 0, np.where(~joined[b] & (score >= own), 1, 2))
        keep = (score >= least) | same
        made.append(_first_of(*(v[keep] for v in (g[mine[lo:hi]][a], num[mine[lo:hi]][a], rank, -score, joined[b], num[row[b]]))))
    of_g, l, _, score, two_of, r = _first_of(*map(np.concatenate, zip(*made, strict=True)))
    return {"g": of_g, "l": l, "r": r, "score": -score, "joined": two_of}


def _first_of(g: np.ndarray, l: np.ndarray, *rest: np.ndarray) -> list[np.ndarray]:
    """The first row of each g and l in the order of the rest."""
    order = np.lexsort((*rest[::-1], l, g))
    g, l = g[order], l[order]
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (l[1:] != l[:-1])])[: len(g)])
    return [g[new], l[new], *(v[order][new] for v in rest)]


def _pair_long(left: DataFrame, right: DataFrame, keys: list[str], own: int, least: int) -> DataFrame:
    """Rows meet by their rarest words alone, as many as the least similarity asks for and only where sizes can be so alike; words that all have make no pairs."""
    bound = max(0, min(own, least))
    size = lambda df, n: df.select(*keys, F.col("num").alias(n), F.array_distinct("words").alias("w")).withColumn("n", F.size("w"))
    w = Window.partitionBy(*keys).orderBy("num")
    two = right.withColumn("__n", F.lead("num").over(w)).withColumn("__w", F.lead("words").over(w)).filter("__n = num + 1").select(*keys, "num", F.concat("words", "__w").alias("words"))
    a, b = size(left, "l"), size(right, "r").withColumn("joined", F.lit(False)).unionByName(size(two, "r").withColumn("joined", F.lit(True)))
    a, b = materialize(a, "left"), materialize(b, "right")
    counts = a.select(*keys, F.explode("w").alias("word")).unionByName(b.filter("NOT joined").select(*keys, F.explode("w").alias("word"))).groupBy(*keys, "word").agg(F.count("*").alias("c"))
    counts = materialize(counts, "counts")
    x = _rare_first(a, counts, keys, ["l"], bound).withColumnRenamed("n", "l_n")
    y = _rare_first(b, counts, keys, ["r", "joined"], bound).withColumnRenamed("n", "r_n")
    fits = 2000 * F.least("l_n", "r_n") >= bound * (F.col("l_n") + F.col("r_n"))
    met = x.join(y, [*keys, "word"]).filter(fits).select(*keys, "l", "r", "joined").distinct()
    full = met.join(a.select(*keys, "l", F.col("w").alias("__x")), [*keys, "l"]).join(b.select(*keys, "r", "joined", F.col("w").alias("__y")), [*keys, "r", "joined"])
    scored = full.select(*keys, "l", "r", "joined", F.floor(2000 * F.size(F.array_intersect("__x", "__y")) / (F.size("__x") + F.size("__y"))).cast("long").alias("score"))
    mine = ~F.col("joined") & (F.col("l") == F.col("r")) & (F.col("score") >= own)
    rank = F.when(mine, 0).when(~F.col("joined") & (F.col("score") >= own), 1).otherwise(2)
    best = scored.filter((F.col("score") >= least) | mine).groupBy(*keys, "l").agg(F.min(F.struct(rank.alias("rank"), (-F.col("score")).alias("s"), "joined", "r", "score")).alias("m"))
    return best.select(*keys, "l", "m.r", "m.score", "m.joined")


def linked(links: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Every link with its token's columns."""
    return links.join(tokens, keys)


def with_group_stat(rows: DataFrame, group: list[str], **stats: Column) -> DataFrame:
    """rows with statistics of their group, each an aggregate: summed before the shuffle and joined back, so a hot group isn't gathered."""
    return rows.join(rows.groupBy(*group).agg(*[c.alias(n) for n, c in stats.items()]), group, "left")


def has_any(base: DataFrame, keys: list[str], **sources: DataFrame) -> DataFrame:
    """base with a flag per source: does it hold a row of the key?"""
    flags = None
    for name, df in sources.items():
        one = df.select(*keys, *[F.lit(n == name).alias(n) for n in sources])
        flags = one if flags is None else flags.unionByName(one)
    seen = flags.groupBy(*keys).agg(*[F.bool_or(n).alias(n) for n in sources])
    return base.join(seen, keys, "left").na.fill(False, list(sources))
