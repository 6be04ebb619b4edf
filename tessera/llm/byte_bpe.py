"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The encoding of a text is the one sequence of tokens in which each token's own bytes encode to it and each two neighbours' bytes encode to
just these two: merges inside such a sequence never cross a border, and no other sequence has this property.  So the last
token of every prefix follows from the last tokens of shorter prefixes, and a transducer can run over the bytes:

* A state knows the open starts (places from which some token may still reach beyond the bytes read) with the tokens between the last
  settled place and each of them, the bytes since the first open start, and the token before the settled place.
* A byte ends one token: of the open starts whose bytes now make a token, exactly one has a fitting neighbour before.  Starts
  that no token can reach beyond are closed.  What all open starts have in common is emitted: it can't change any more.
* States are kept by content and made lazily: a state that has been left by bytes without a transition `rare` times gets one for each such
  byte from then on; before, what remains of a short word is run through the undeterminised machine (the same rule, place by place), so
  that what is met once makes no states.  The machine is forgotten and begun anew at `most_states`; a text is read on from where it is.

The lookahead, the bytes between the last emitted token and the place read, is bounded by the vocabulary, not by the text
(`Transducer.lookahead` is the longest so far).  Distinct short words are kept in a bounded table per Python worker, since corpora repeat them.

Decoding is streamed: tokens' bytes go through an incremental UTF-8 state machine that holds an unfinished character over the border
of tokens and gives U+FFFD for what is no UTF-8, as Python's "replace" does.

Nulls: a null text is encoded as an empty one.  An empty text has no ids.  Repeated rows give repeated results; further columns are kept;
columns named as a result column are replaced.  An empty table gives no rows.  A text of any length is encoded whole, in pieces of bounded
size.  Ties don't arise: of equal pairs the leftmost is merged first, which the neighbour rule reproduces.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free, kept, texts_of

#: Words of up to so many characters are kept in the table, of up to so many bytes are run undeterminised.
SHORT = 48
#: Matches of a text are worked on so many at a time.
CHUNK = 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State(dict):
    """byte -> (next state, emitted ids), as far as it is determinised; missed counts bytes that had no transition yet."""

    __slots__ = ("tail", "before", "starts", "missed")

    def __init__(self, tail: bytes, before: int, starts: tuple[tuple[int, tuple[int, ...]], ...]):
        self.tail, self.before, self.starts, self.missed = tail, before, starts, 0


class Transducer:
    """encode(bytes) -> ids as native unsigned 32-bit integers; every single byte must be a token, and every token reachable by merges
    of ever higher rank."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 150_000, rare: int = 24):
        self.ranks, self.most, self.rare = ranks, most_states, rare
        self.bytes_of = {v: k for k, v in ranks.items()}
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("no byte-level BPE: single bytes are missing")
        #: bytes -> 2 * token + whether a longer token begins so; -1 for bytes that only begin one
        self.trie = dict.fromkeys((k[:n] for k in ranks for n in range(1, len(k))), -1)
        self.trie.update({k: 2 * v + (k in self.trie) for k, v in ranks.items()})
        self.one = [bytes([i]) for i in range(256)]
        self.halves = {v: self._halves(k) for k, v in ranks.items()}
        self.states: dict[tuple, _State] = {}
        self.known: dict[int, bool] = {}
        self.lookahead = 0
        self.start = self._state(b"", -1, ((0, ()),))

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's own bytes joins: the lowest rank first, the leftmost of equals."""
        rank = self.ranks.get
        ids = [rank(token[i : i + 1]) for i in range(len(token))]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or best <= max(ids[at], ids[at + 1]) and len(parts[at]) + len(parts[at + 1]) > 2:
                raise ValueError(f"no byte-level BPE: merges don't reach {token!r}")
            parts[at : at + 2], ids[at : at + 2] = [parts[at] + parts[at + 1]], [best]
        return tuple(ids) if len(parts) == 2 else None

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b encode to just a and b: no pair across the border may be joined while both its sides last.

        Merges of a rank are made before those of a higher one, so the pairs across the border are met backwards in time, undoing the
        later of the two sides' last merges; of equal ranks the left pair was first."""
        joined, parts, halves = self.ranks.get, self.bytes_of, self.halves
        end = (1 << 62, 0)  # when the older of both sides was used up by a merge of its own: rank, side
        while True:
            r = joined(parts[a] + parts[b])
            if r is not None and (r, 1) < end:
                return False
            x, y = halves[a], halves[b]
            if x is None and y is None:
                return True
            if y is None or (x is not None and a > b):
                end, a = (a, 0), x[1]
            else:
                end, b = (b, 2), y[0]

    def _state(self, tail: bytes, before: int, starts: tuple) -> _State:
        key = (tail, before, starts)
        got = self.states.get(key)
        if got is None:
            if len(self.states) >= self.most:
                self.forget()
            got = self.states[key] = _State(tail, before, starts)
        return got

    def forget(self) -> None:
        for s in self.states.values():
            s.clear()
        self.states.clear()
        self.start = self._state(b"", -1, ((0, ()),))

    def learn(self, state: _State, byte: int) -> tuple[_State, bytes]:
        tail, before = state.tail + self.one[byte], state.before
        size = len(tail) - 1
        trie, known = self.trie, self.known
        if len(known) > 8 * self.most:
            known.clear()
        starts, ended = [], None
        for n, tokens in state.starts:
            token = trie.get(tail[size - n :])
            if token is None:
                continue
            if token & 1:
                starts.append((n + 1, tokens))
            if ended is None and token >= 0:
                token >>= 1
                last = tokens[-1] if tokens else before
                if last < 0:
                    ended = (*tokens, token)
                else:
                    pair = last << 32 | token
                    fit = known.get(pair)
                    if fit is None:
                        fit = known[pair] = self.fits(last, token)
                    if fit:
                        ended = (*tokens, token)
        starts.append((0, ended))
        first, common = starts[0][1], 0
        while common < len(first):
            t = first[common]
            for _, tokens in starts:
                if len(tokens) <= common or tokens[common] != t:
                    break
            else:
                common += 1
                continue
            break
        if common:
            starts = [(n, tokens[common:]) for n, tokens in starts]
            before = first[common - 1]
        open_ = starts[0][0]
        if open_ > self.lookahead:
            self.lookahead = open_
        nxt = self._state(tail[size + 1 - open_ :], before, tuple(starts))
        made = state[byte] = (nxt, array("I", first[:common]).tobytes() if common else b"")
        return made

    def _finish(self, state: _State, rest: bytes) -> bytes:
        """The ids that the state and the rest of a short word end with, by the undeterminised machine."""
        data, size = state.tail + rest, len(state.tail)
        trie, known = self.trie, self.known
        opened = [size - n for n, _ in state.starts]
        kept = {size - n: tokens for n, tokens in state.starts}
        last = {p: tokens[-1] if tokens else state.before for p, tokens in kept.items()}
        back = {}
        for end in range(size + 1, len(data) + 1):
            still, found = [], False
            for p in opened:
                token = trie.get(data[p:end])
                if token is None:
                    continue
                if token & 1:
                    still.append(p)
                if not found and token >= 0:
                    token >>= 1
                    before = last[p]
                    pair = before << 32 | token
                    found = before < 0 or known.get(pair)
                    if found is None:
                        found = known[pair] = self.fits(before, token)
                    if found:
                        last[end], back[end] = token, p
            still.append(end)
            opened = still
        at, out = len(data), []
        while at in back:
            out.append(last[at])
            at = back[at]
        return array("I", [*kept[at], *reversed(out)]).tobytes()

    def encode(self, piece: bytes) -> bytes:
        state, got = self.start, []
        rare = self.rare if len(piece) <= SHORT else 0
        for k, byte in enumerate(piece):
            step = state.get(byte)
            if step is None:
                state.missed += 1
                if state.missed <= rare:
                    got.append(self._finish(state, piece[k:]))
                    return b"".join(got)
                step = self.learn(state, byte)
            state, out = step
            if out:
                got.append(out)
        got.append(array("I", state.starts[-1][1]).tobytes())
        return b"".join(got)


class Utf8Stream:
    """feed(bytes) gives the text known so far, close() the rest; what is no UTF-8 becomes U+FFFD."""

    #: State after a first byte: how many bytes must follow, and the range of the next one.
    _NEXT = {**dict.fromkeys(range(0xC2, 0xE0), (1, 0x80, 0xBF)), 0xE0: (2, 0xA0, 0xBF), **dict.fromkeys(range(0xE1, 0xF0), (2, 0x80, 0xBF)), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), **dict.fromkeys(range(0xF1, 0xF4), (3, 0x80, 0xBF)), 0xF4: (3, 0x80, 0x8F)}

    def __init__(self):
        self.held, self.state = b"", (0, 0, 0)

    def feed(self, chunk: bytes) -> str:
        """The machine runs to the first place where no character is open and again from the last one; between them lie whole characters."""
        out, at = [], 0
        while self.state[0] and at < len(chunk):
            need, low, high = self.state
            byte = chunk[at]
            if low <= byte <= high:
                self.held += chunk[at : at + 1]
                at += 1
                self.state = (need - 1, 0x80, 0xBF)
                if need == 1:
                    out.append(self.held.decode())
                    self.held = b""
            else:
                out.append("�")
                self.held, self.state = b"", (0, 0, 0)
        end = len(chunk)
        for k in range(1, min(3, end - at) + 1):  # a first byte whose character may reach beyond the chunk
            state = self._NEXT.get(chunk[end - k])
            if state is None:
                continue
            for byte in chunk[end - k + 1 :]:
                if not (state[0] and state[1] <= byte <= state[2]):
                    break
                state = (state[0] - 1, 0x80, 0xBF)
            else:
                if state[0]:
                    self.held, self.state, end = chunk[end - k :], state, end - k
            break
        out.append(chunk[at:end].decode("utf-8", "replace"))
        return "".join(out)

    def close(self) -> str:
        left, self.held, self.state = self.held, b"", (0, 0, 0)
        return "�" if left else ""


def _ranges(points: Iterable[int]) -> str:
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Splitter:
    """Matches of the word pattern with the letters and numbers that the rank library's Unicode version knows.

    Characters that this Python doesn't know yet, but the regex module does, are asked of the library one by one, once a worker;
    texts below U+0250, whose classes no version changes, are split by Python's own expressions."""

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        alone = {bytes([i]): i for i in range(256)}
        unknown = "".join(c for c in map(chr, range(0x250, 0x110000)) if unicodedata.category(c) == "Cn")
        text = pattern
        for kind in ("L", "N"):
            new = "".join(regex.findall(rf"\p{{{kind}}}+", unknown))
            met = tiktoken.Encoding("class", pat_str=rf"\p{{{kind}}}+", mergeable_ranks=alone, special_tokens={}).encode_ordinary(new)
            late = sorted(set(map(ord, new)) - set(map(ord, bytes(met).decode())))
            if late:
                text = text.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{_ranges(late)}]]")
        self.whole = regex.compile("(?V1)" + text)
        low = {kind: _ranges(p for p in range(0x250) if unicodedata.category(chr(p))[0] == kind) for kind in "LN"}
        blank = "\\t-\\r \\x85\\xa0"
        fast = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda _: f"[^{blank}{low['L']}{low['N']}]", pattern)
        for kind in "LN":
            fast = fast.replace(rf"\p{{{kind}}}", f"[{low[kind]}]")
        fast = fast.replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]")
        self.fast = None if r"\p" in fast else re.compile(fast)
        self.plain = re.compile("[\x00-ɏ]*")

    def __call__(self, text: str) -> Iterator[list[str]]:
        """The matches, a list of at most CHUNK at a time for long texts."""
        how = self.fast if self.fast is not None and (text.isascii() or self.plain.fullmatch(text)) else self.whole
        if len(text) <= 1 << 18:
            yield how.findall(text)
            return
        matches = (m.group() for m in how.finditer(text))
        while some := list(islice(matches, CHUNK)):
            yield some


class Codec:
    def __init__(self, path: str, pattern: str, table_size: int = 500_000, most_states: int = 150_000):
        self.machine, self.split = Transducer(read_ranks(path), most_states), Splitter(pattern)
        self.table, self.size = {}, table_size
        self.tokens = [self.machine.bytes_of.get(i, b"") for i in range(max(self.machine.bytes_of) + 1)]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as native unsigned 32-bit integers, a run of words at a time."""
        for words in self.split(text):
            try:
                yield b"".join([self.table[w] for w in words])
            except KeyError:
                yield b"".join([self._word(w) for w in words])

    def _word(self, word: str) -> bytes:
        got = self.table.get(word)
        if got is None:
            got = self.machine.encode(word.encode("utf-8", "surrogatepass"))
            if len(word) <= SHORT:
                if len(self.table) >= self.size:
                    self.table.clear()
                self.table[word] = got
        return got

    def decode(self, runs: Iterable[Iterable[int]]) -> Iterator[bytes]:
        tokens = self.tokens
        for ids in runs:
            yield b"".join([tokens[i] for i in ids])


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", with_text: bool = False, table_size: int = 500_000, most_states: int = 150_000) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, and with with_text also ids (array<int>) and decoded."""
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    more = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    keep = [f for f in docs.schema.fields if f.name not in made and f.name not in more and (with_text or f.name != text_col)]
    names = [f.name for f in keep]
    added = made | more if with_text else made
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in added.items())])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept("byte_bpe", (ranks, pattern, table_size, most_states), lambda: Codec(ranks, pattern, table_size, most_states))
        for b in batches:
            at = b.num_columns - 1
            cols: list[list] = [[] for _ in added]
            for lo in range(0, b.num_rows, 256):
                for text in texts_of(b.column(at).slice(lo, 256)):
                    n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
                    ids_held, stream, decoded = array("I"), Utf8Stream(), []
                    for part in codec.encode(text):
                        ids = array("I", part)
                        n += len(ids)
                        ids_sha.update(part)
                        for piece in codec.decode([ids]):
                            text_sha.update(piece)
                            if with_text:
                                decoded.append(stream.feed(piece))
                        if with_text:
                            ids_held.extend(ids)
                    row = [n, ids_sha.hexdigest(), text_sha.hexdigest(), ids_held.tolist(), "".join([*decoded, stream.close()])]
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
            made_cols = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in names), *made_cols], names=[*names, *added])

    return docs.select(*[F.col(f"`{x}`") for x in names], F.col(f"`{text_col}`").cast("string").alias(free("__text", names))).mapInArrow(run, schema)
