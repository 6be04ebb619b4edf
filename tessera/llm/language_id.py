"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a word's UTF-8 bytes (lower-cased, between two border bytes) forwards and backwards and gives every
position a distribution over languages.  A document's probability is the mean over the positions of its words that
hold a letter.  States start anew at white space, so a word's summed distributions depend on the word alone: a
task works each distinct word out once and keeps it in a bounded table.  Words over `segment` bytes are read in segments.

Training is backpropagation through time in numpy on the driver, over at most `fit_docs` labelled documents (those
with the smallest hashes of their ids), whose words Spark counts by language; at most `fit_words` (language, word)
counts reach the driver.  Both bounds are parameters.

Nulls: a text that is null or has no letter (Unicode category L) gets "und" with score 0.  Without labelled rows, as in an empty table,
every text is "und".  Ties between languages go to the first in alphabetical order.  Rows that repeat an id are judged each, by their
text alone; columns named lang_pred or score are replaced, all further ones are kept, whatever their names.  A text of any length is read whole: its words'
sums are looked up and added, so its length costs a lookup a word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free, kept, texts_of

UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_PAD = 0


def has_letter(text: str) -> bool:
    """A character of the Unicode letter categories; the pattern also takes signs such as fractions and raised figures."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """E: byte embeddings; per direction W (input), U (state), b of the gates z, r, n; V, c: output."""

    def __init__(self, langs: list[str], hidden: int = 12, embed: int = 8, segment: int = 64, seed: int = 7):
        g = np.random.Generator(np.random.PCG64(seed))
        init = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.langs, self.hidden, self.segment = langs, hidden, segment
        self.p = {"E": init(256, embed) * 4, "V": init(2 * hidden, len(langs)), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(embed, 3 * hidden), f"U{d}": init(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def mark(self) -> str:
        return hashlib.sha256(b"".join(self.p[k].tobytes() for k in sorted(self.p))).hexdigest()

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """bytes [n, width] with a border (32) on both sides, and lengths with the borders."""
        length = np.array([len(w) + 2 for w in words])
        out = np.full((len(words), int(length.max())), _PAD, np.uint8)
        for i, w in enumerate(words):
            out[i, 0] = 32
            out[i, 1 : len(w) + 1] = np.frombuffer(w, np.uint8)
            out[i, len(w) + 1] = 32
        return out, length

    def _scan(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """x [t, n, 3h]: inputs times W; states [t, n, h].  A masked step keeps the state."""
        h = self.hidden
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        state = np.zeros((x.shape[1], h), np.float32)
        states, cache = np.zeros((*x.shape[:2], h), np.float32), {}
        for t in steps:
            u = state @ self.p[f"U{d}"]
            zr = _sigmoid(x[t, :, : 2 * h] + u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * u[:, 2 * h :])
            m = mask[t][:, None]
            new = state + m * (1 - z) * (n - state)
            if keep:
                cache[t] = (state, z, r, n, u[:, 2 * h :], m)
            state = states[t] = new
        return states, cache

    def forward(self, codes: np.ndarray, length: np.ndarray, keep: bool = False):
        c = codes.T
        mask = (np.arange(c.shape[0])[:, None] < length[None, :]).astype(np.float32)
        e = self.p["E"][c] if keep else None
        hf, cf = self._scan("f", (self.p["E"] @ self.p["Wf"] + self.p["bf"])[c], mask, keep)
        hb, cb = self._scan("b", (self.p["E"] @ self.p["Wb"] + self.p["bb"])[c], mask, keep)
        both = np.concatenate([hf, hb], 2)
        logit = both @ self.p["V"] + self.p["c"]
        logit -= logit.max(2, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(2, keepdims=True)
        return prob * mask[:, :, None], (c, e, mask, both, cf, cb)

    def _back(self, d: str, cache: dict, grad: np.ndarray, e: np.ndarray, out: dict) -> np.ndarray:
        h, u_mat = self.hidden, self.p[f"U{d}"]
        steps = range(len(grad) - 1, -1, -1) if d == "f" else range(len(grad))
        later = np.zeros(grad.shape[1:], np.float32)
        dx = np.zeros((*grad.shape[:2], 3 * h), np.float32)
        for t in steps:
            state, z, r, n, un, m = cache[t]
            g = grad[t] + later
            gm = g * m
            dn = gm * (1 - z) * (1 - n * n)
            dz = gm * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], 1)
            du = np.concatenate([dz, dr, dn * r], 1)
            out[f"U{d}"] += state.T @ du
            later = g * (1 - m) + gm * z + du @ u_mat.T
        flat = dx.reshape(-1, 3 * h)
        out[f"W{d}"] += e.reshape(-1, e.shape[2]).T @ flat
        out[f"b{d}"] += flat.sum(0)
        return dx @ self.p[f"W{d}"].T

    def gradients(self, codes: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over positions and its gradients."""
        prob, (c, e, mask, both, cf, cb) = self.forward(codes, length, True)
        total = mask.sum()
        pick = np.take_along_axis(prob, np.broadcast_to(y[None, :, None], (*prob.shape[:2], 1)), 2)[:, :, 0]
        loss = float(-(np.log(np.maximum(pick, 1e-12)) * mask).sum() / total)
        dl = prob.copy()
        dl[:, np.arange(len(y)), y] -= mask
        dl /= total
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = dl.reshape(-1, dl.shape[2])
        out["V"] += both.reshape(-1, both.shape[2]).T @ flat
        out["c"] += flat.sum(0)
        db = dl @ self.p["V"].T
        de = self._back("f", cf, db[:, :, : self.hidden], e, out) + self._back("b", cb, db[:, :, self.hidden :], e, out)
        np.add.at(out["E"], c.reshape(-1), de.reshape(-1, de.shape[2]))
        return loss, out

    def train(self, words: list[bytes], langs: np.ndarray, weights: np.ndarray, steps: int = 500, batch: int = 512, rate: float = 0.01, seed: int = 11) -> list[float]:
        """Adam over batches drawn by weight."""
        g = np.random.Generator(np.random.PCG64(seed))
        at, share = np.arange(len(words)), weights / weights.sum()
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = g.choice(at, min(batch, 4 * len(at)), p=share)
            codes, length = self.coded([words[i][: self.segment] for i in pick])
            loss, grad = self.gradients(codes, length, langs[pick])
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def word_sums(self, words: list[bytes], most: int = 1024) -> np.ndarray:
        """[n, langs + 1]: a word's distributions summed over its positions, and the number of positions."""
        out = np.zeros((len(words), len(self.langs) + 1))
        parts = [(i, w[k : k + self.segment]) for i, w in enumerate(words) for k in range(0, len(w), self.segment)]
        parts.sort(key=lambda x: len(x[1]))
        for lo in range(0, len(parts), most):
            some = parts[lo : lo + most]
            codes, length = self.coded([w for _, w in some])
            prob, _ = self.forward(codes, length)
            np.add.at(out, [i for i, _ in some], np.concatenate([prob.sum(0), length[:, None]], 1))
        return out


def labelled(docs: DataFrame) -> F.Column:
    """Rows that may be learned from: not held out, with text and lang."""
    return ~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = 2000, fit_words: int = 12000, steps: int = 500, **how) -> ByteGru | None:
    chosen = docs.filter(labelled(docs)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.filter(labelled(docs)).select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")  # bounded by fit_docs
    words = rows.select("lang", F.explode(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+")).alias("word")).filter(F.col("word").rlike(r"\p{L}") & (F.length("word") <= 64))
    counts = words.groupBy("lang", "word").count().orderBy(F.desc("count"), "lang", "word").limit(fit_words).collect()
    if not counts:
        return None
    langs = sorted({r["lang"] for r in counts})
    y = np.array([langs.index(r["lang"]) for r in counts])
    weight = np.array([r["count"] for r in counts], float)
    weight /= np.bincount(y, weight, len(langs))[y]  # every language weighs the same
    net = ByteGru(langs, **how)
    net.train([r["word"].encode() for r in counts], y, np.sqrt(weight), steps)
    return net


class Predictor:
    """Documents' languages by a bounded table of words already read."""

    def __init__(self, net: ByteGru, table_size: int = 250_000):
        self.net, self.size = net, table_size
        self.table: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 14, len(net.langs) + 1), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        sums = self.net.word_sums(new)
        sums[[i for i, w in enumerate(new) if not has_letter(w.decode())]] = 0
        n = len(self.table)
        while len(self.rows) < n + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(new)] = sums
        self.table.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        words = [t.lower().encode().split() if has_letter(t) else [] for t in texts]
        if len(self.table) > self.size:
            self.table.clear()
        table = self.table
        new = list({w for some in words for w in some if w not in table})
        if new:
            self._learn(sorted(new))
        out = []
        for some in words:
            if not some:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[np.fromiter(map(table.__getitem__, some), np.int64, len(some))].sum(0, dtype=np.float64)
            prob = total[:-1] / max(total[-1], 1)
            k = int(prob.argmax())
            out.append((self.net.langs[k], float(min(1.0, max(0.0, prob[k])))))
        return out


def predict(docs: DataFrame, net: ByteGru | None, text_col: str = "text", keep_text: bool = False, table_size: int = 250_000) -> DataFrame:
    """docs with lang_pred and score."""
    keep = [f for f in docs.schema.fields if f.name not in {"lang_pred", "score"} and (keep_text or f.name != text_col)]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if net is None:
        return docs.select(*[F.col(f"`{x}`") for x in names], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = kept("langs", (net.mark(), table_size), lambda: Predictor(net, table_size))
        for b in batches:
            text, got = b.column(b.num_columns - 1), []
            for lo in range(0, b.num_rows, 256):
                got += ask(texts_of(text.slice(lo, 256)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in names), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{x}`") for x in names], F.col(f"`{text_col}`").cast("string").alias(free("__text", names))).mapInArrow(run, schema)
