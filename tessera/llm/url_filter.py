"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob over a canonical URL.  All globs lie side by side in the words of one Shift-And mask: bit i
stands for "the globs' symbols up to i have been read".  A star adds no bit; it lets the bit before it stay set over
the bytes that the star may take.  One pass over the bytes of a URL steps all globs at once, and numpy steps a whole
batch of URLs together.

Canonical URL: "." + host + path, the host with A-Z lower-cased.  In a glob "*" takes bytes other than "/", "**"
takes any bytes, "?" takes one byte; the whole canonical URL has to fit.  A host/path rule `example.com/en/` is the
glob `*.example.com/en/**`, so that it fits the host, its subdomains and every path that begins so.

Nulls: a null URL, or one without "://", has an empty host and path; no host rule fits it.  Ties between rules of
one length go to the rule listed first.  Repeated rows give repeated results.  An empty table gives no rows.  Other columns are kept;
those named host, path, rule, verdict or by_glob are replaced.  A URL of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bytes_of, free, slices

#: Words that mark hosts nobody wants in a training corpus: gambling, sham medicine, adult pages, link farms, pirated goods.
BLOCK_WORDS = (
    "casino", "jackpot", "sportsbook", "-betting", "betting-", "slots-", "-slots", "-pills", "pills-", "viagra", "cialis", "levitra", "spam-", "-spam", "porn", "xxx-",
    "-xxx", "escort-", "-escorts", "camgirl", "hentai", "payday-loan", "payday-loans", "replica-watch", "backlinks", "linkfarm", "link-farm", "clickbank-", "warez", "torrentz", "crackserial", "keygen",
)
#: Globs over the host part.
DEFAULT_BLOCK_GLOBS = tuple(f"*{w}*" + tail for w in BLOCK_WORDS for tail in ("", "/**"))


class GlobAutomaton:
    def __init__(self, globs: Sequence[str]):
        symbols, loops, starts, finals = [], [], [], []  # per bit: byte or None; self loop: 0 none, 1 "*", 2 "**"
        for g in globs:
            raw, i, first = g.encode(), 0, True
            starts.append(len(symbols))
            symbols.append(-2)  # the bit that stands for the empty prefix
            loops.append(0)
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    wide = raw[i : i + 2] == b"**"
                    loops[-1] = max(loops[-1], 2 if wide else 1)
                    i += 2 if wide else 1
                else:
                    symbols.append(-1 if raw[i : i + 1] == b"?" else raw[i])
                    loops.append(0)
                    i += 1
            finals.append(len(symbols) - 1)
        self.n_words = (len(symbols) + 63) // 64
        bit = lambda at: (at // 64, np.uint64(1) << np.uint64(at % 64))
        self.take = np.zeros((256, self.n_words), np.uint64)
        self.stay = np.zeros((256, self.n_words), np.uint64)
        self.init = np.zeros(self.n_words, np.uint64)
        for at, (s, loop) in enumerate(zip(symbols, loops, strict=True)):
            w, m = bit(at)
            if s == -1:
                self.take[:, w] |= m
            elif s >= 0:
                self.take[s, w] |= m
            if loop:
                self.stay[:, w] |= m
                if loop == 1:
                    self.stay[ord("/"), w] &= ~m
        for at in starts:
            w, m = bit(at)
            self.init[w] |= m
        self.finals = [bit(at) for at in finals]

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """bool [urls, globs].  URLs are stepped longest first, so that those still running are a prefix."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, ordered = offsets[:-1][order], lengths[order]
        state = np.repeat(self.init[None, :], len(order), 0)
        for step in range(int(ordered[0]) if len(ordered) else 0):
            live = int(np.searchsorted(-ordered, -step, "left"))
            byte, now = data[begin[:live] + step], state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.take[byte]) | (now & self.stay[byte])
        out = np.zeros((len(order), len(self.finals)), bool)
        for k, (w, m) in enumerate(self.finals):
            out[order, k] = (state[:, w] & m) != 0
        return out


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """host and path as columns; A-Z only are lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], block_globs: Sequence[str] = DEFAULT_BLOCK_GLOBS, url_col: str = "url") -> DataFrame:
    """rules: (verdict, host, path).  Adds host, path, rule, verdict, by_glob (the first block glob that fits)."""
    new = ("host", "path", "rule", "verdict", "by_glob")
    keep = [f for f in pages.schema.fields if f.name not in new]
    names = [f.name for f in keep]
    host_, path_, url_ = (free(x, names) for x in ("__host", "__path", "__url"))
    schema = T.StructType([*keep, *(T.StructField(x, T.StringType()) for x in new)])
    globs = [f"*.{host}{path}**" for _, host, path in rules] + list(block_globs)
    rank = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), k))
    labels = [host + path for _, host, path in rules]
    n_rules = len(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = GlobAutomaton(globs)
        for b in batches:
            data, offsets = bytes_of(b.column(b.schema.names.index(url_)))
            hits = np.zeros((b.num_rows, len(globs)), bool)
            for i, j in slices(offsets):
                hits[i:j] = auto.match(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            best = np.full(b.num_rows, -1)
            for k in reversed(rank):
                best[hits[:, k]] = k
            glob = np.where(hits[:, n_rules:].any(1), hits[:, n_rules:].argmax(1), -1) if len(globs) > n_rules else np.full(b.num_rows, -1)
            rule = [labels[k] if k >= 0 else None for k in best]
            verdict = [rules[k][0] if k >= 0 else "block" if g >= 0 else "allow" for k, g in zip(best, glob, strict=True)]
            by = [block_globs[g] if g >= 0 else None for g in glob]
            cols = [b.column(b.schema.names.index(x)) for x in [*names, host_, path_]]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.string()) for x in (rule, verdict, by))], names=[*names, *new])

    host, path = url_parts(F.col(f"`{url_col}`").cast("string"))
    canonical = F.concat(F.lit("."), F.col(host_), F.col(path_)).alias(url_)
    base = pages.select(*[F.col(f"`{x}`") for x in names], host.alias(host_), path.alias(path_))
    return base.select("*", canonical).mapInArrow(run, schema)
