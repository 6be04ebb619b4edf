"""Learned decision lists for document quality.

Statistics of every whole text come from one Arrow pass.  Sequential covering learns an ordered list of rules for
the class "poor": grow a conjunction of thresholds by FOIL gain on two thirds of the labelled rows, prune its last
conditions on the other third while precision does not fall, keep it while its precision on the pruning rows
stays above `least_precision`, remove what it covers, and go on.  The list is turned into one Spark conditional expression.

The fit takes at most `fit_rows` labelled rows (those with the smallest hashes of their ids) to the driver: the bound
is a parameter and the rows are numbers only.  Everything else runs over all documents.

A word is a run of bytes other than space and \\t..\\r.  Nulls: a null text has no words.  Without labels, or with one
class only, as with empty tables, the list is empty and keeps what the base rule keeps.  Rows whose doc_id repeats are judged each.
Equal gains go to the statistic named first.  Other columns are kept; those named as a statistic or a verdict are replaced.  A text of any
length is read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free, texts_of

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts, for the learned rules alone.
EXTRA = ("n_upper", "n_digits", "n_marks", "n_lines", "n_distinct", "n_chars_all")
_SPACES = " \t\n\v\f\r"
_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = str.maketrans("", "", "0123456789")
_MARKS = str.maketrans("", "", "!?|@=\"'()[]{}~^_/;:")


def repeated_words(words: list) -> int:
    """Words that lie in a window of three found at least twice in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    total, covered = 0, 0  # `covered`: first word not yet counted
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def text_stats(text: str) -> tuple[int, ...]:
    """BASE and EXTRA of one text."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    n = len(text)
    blank = sum(map(text.count, _SPACES))
    ascii_text = raw.decode("ascii", "ignore")
    return (len(words), n - blank, sum(map(text.count, SYMBOLS)), dup, repeated_words(words), len(ascii_text) - len(ascii_text.translate(_UPPER)), len(ascii_text) - len(ascii_text.translate(_DIGITS)), len(ascii_text) - len(ascii_text.translate(_MARKS)), lines, len(set(words)), n)


def with_stats(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the columns of BASE and EXTRA."""
    new = [*BASE, *EXTRA]
    keep = [f for f in docs.schema.fields if f.name not in new and (keep_text or f.name != text_col)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *(T.StructField(x, T.LongType()) for x in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, stats = b.column(b.num_columns - 1), []
            for lo in range(0, b.num_rows, 512):
                stats += [text_stats(t) for t in texts_of(text.slice(lo, 512))]
            cols = list(zip(*stats, strict=True)) if stats else [[] for _ in new]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in names), *(pa.array(c, pa.int64()) for c in cols)], names=[*names, *new])

    return docs.select(*[F.col(f"`{x}`") for x in names], F.col(f"`{text_col}`").cast("string").alias(free("__text", names))).mapInArrow(run, schema)


#: name -> (over, under): the measured shares that rules put thresholds on; all are num / max(1, den).
RATIOS = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def ratio(name: str) -> F.Column:
    num, den = RATIOS[name]
    top = F.col(num).cast("double")
    return top / F.greatest(F.lit(1.0), F.col(den).cast("double")) if den else top


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v > self.limit if self.above else v <= self.limit

    def column(self) -> F.Column:
        v = ratio(self.name)
        return v > F.lit(self.limit) if self.above else v <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass
class DecisionList:
    """Ordered rules for "poor"; a text that none fits is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def keep_column(self) -> F.Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            test = F.lit(True)
            for c in rule:
                test = test & c.column()
            out = F.when(test, F.lit(False)).otherwise(out)
        return out

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        keep = np.ones(len(x), bool)
        for rule in self.rules:
            keep &= ~np.logical_and.reduce([c.holds(x, names) for c in rule])
        return keep

    def __str__(self) -> str:
        return "\n".join([*("poor if " + " and ".join(map(str, r)) for r in self.rules), "else good"])


def _cuts(v: np.ndarray, most: int = 48) -> np.ndarray:
    u = np.unique(v)
    if len(u) < 2:
        return np.zeros(0)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most)))


def _grow(x: np.ndarray, poor: np.ndarray, names: list[str], most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (~poor[inside]).any():
        p0, n0 = poor[inside].sum(), (~poor[inside]).sum()
        best, best_gain = None, 1e-9
        for k, name in enumerate(names):
            v = x[inside, k]
            order = np.argsort(v, kind="stable")
            bad = np.concatenate([[0], np.cumsum(poor[inside][order])])
            cuts = _cuts(v)
            if not len(cuts):
                continue
            at = np.searchsorted(v[order], cuts, "right")
            for above in (False, True):
                p = bad[-1] - bad[at] if above else bad[at]
                n = (len(v) - at if above else at) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                g = int(np.argmax(gain))
                if gain[g] > best_gain:
                    best, best_gain = Condition(name, above, float(cuts[g])), gain[g]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return rule


def _precision(rule: list[Condition], x: np.ndarray, poor: np.ndarray, names: list[str]) -> tuple[float, int]:
    hit = np.logical_and.reduce([c.holds(x, names) for c in rule]) if rule else np.zeros(len(x), bool)
    p, n = int((hit & poor).sum()), int((hit & ~poor).sum())
    return (p + 1) / (p + n + 2), p


def learn(x: np.ndarray, good: np.ndarray, names: list[str], least_precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4) -> DecisionList:
    """Rows come in a fixed order; every third one prunes, the others grow."""
    out, poor = DecisionList(), ~good
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(out.rules) < most_rules and (poor & left & ~prune).sum() >= 3:
        rule = _grow(x[left & ~prune], poor[left & ~prune], names, most_conditions)
        if not rule:
            break
        xp, pp = x[left & prune], poor[left & prune]
        while len(rule) > 1 and _precision(rule[:-1], xp, pp, names)[0] >= _precision(rule, xp, pp, names)[0]:
            rule = rule[:-1]
        score, hits = _precision(rule, xp, pp, names)
        if score < least_precision * (hits + 1) / (hits + 2) or hits == 0:
            break
        out.rules.append(tuple(rule))
        left &= ~np.logical_and.reduce([c.holds(x, names) for c in rule])
    return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", fit_rows: int = 6000, **how) -> DecisionList:
    """A list from at most fit_rows labelled documents; ids labelled both good and poor are left out."""
    votes = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    chosen = votes.filter("lo = hi").select("doc_id", (F.col("lo") > 0).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # bounded by fit_rows
    names = list(RATIOS)
    got = with_stats(rows, keep_text=False).filter("n_words >= 50 AND 2 * n_repeat_words <= n_words").select("doc_id", "good", *[ratio(n).alias(n) for n in names]).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *names).limit(fit_rows).toPandas()
    if got.empty or got["good"].nunique() < 2:
        return DecisionList()
    return learn(got[names].to_numpy(float), got["good"].to_numpy(bool), names, **how)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with statistics, base_failed and kept."""
    return with_stats(docs, text_col, keep_text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.keep_column())
