"""Packing: the placement rule by brute force, ids as the tokenizers library gives them, edges."""

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.common import tokenizer_path
from tessera.llm.queries import BYTES, RANKS


def by_hand(lengths, capacity):
    n = -(-sum(lengths) // capacity)
    room, cost, out = [capacity] * n, [0.0] * n, [[] for _ in lengths]
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        left = lengths[k]
        while left:
            fits = [s for s in range(n) if room[s] >= left] or [s for s in range(n) if room[s]]
            s = min(fits, key=lambda s: (cost[s], s))
            put = min(left, room[s])
            out[k].append((s, put))
            room[s], left = room[s] - put, left - put
            cost[s] += put + put * put / 1024
    return out


def test_lowest_cost_with_room():
    g = np.random.default_rng(4)
    for lengths in (g.integers(1, 1024, 400).tolist(), g.integers(1, 200, 300).tolist(), [500] * 50, [1] * 3000, [1023] * 9, [], [7]):
        got = packing.balance(lengths, 1024)
        assert got == by_hand(lengths, 1024)
        assert [sum(n for _, n in p) for p in got] == lengths


def test_whole_where_some_sequence_has_room():
    g = np.random.default_rng(9)
    lengths = g.integers(1, 1000, 400).tolist()
    cut = [k for k, p in enumerate(packing.balance(lengths, 1024)) if len(p) > 1]
    assert cut == [k for k, p in enumerate(by_hand(lengths, 1024)) if len(p) > 1]


TEXTS = ["plain words here", "ends <|endoftext|> inside <|endoftext|>", "<|endoftext|>", None, "", "é <|endoftext|>漢字", "a  b \n c", "same", "same", "x" * 5000, "word " * 30000]


def test_ids_sequences_and_edges(spark):
    tok = Tokenizer.from_file(tokenizer_path(BYTES))
    rows = [*enumerate(TEXTS), (7, "same"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("length", F.lit(1)).withColumn("sequence_id", F.lit(2))
    for ranks in (None, tokenizer_path(RANKS)):
        got = packing.pack(docs.repartition(2), tokenizer_path(BYTES), ranks, group_tokens=3000, with_ids=True).collect()
        pieces = defaultdict(list)
        for r in got:
            assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            pieces[r.doc_id].append(r)
        for i, t in [*enumerate(TEXTS), (None, "no id")]:
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
            some = sorted((r for r in pieces[i] if r.doc_tokens == len(ids)), key=lambda r: r.start)
            times = 2 if i == 7 else 1
            assert sum(r.length for r in some) == times * len(ids)
            if times == 1:
                assert [x for r in some for x in r.ids] == ids
        filled = defaultdict(int)
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled[r.sequence_id]
            filled[r.sequence_id] += r.length
        assert max(filled.values()) <= 1024
    assert 50256 in tok.encode(TEXTS[1], add_special_tokens=False).ids
    assert packing.pack(docs.limit(0), tokenizer_path(BYTES), tokenizer_path(RANKS)).count() == 0


def test_special_tokens_as_text(spark):
    tok = Tokenizer.from_file(tokenizer_path(BYTES))
    tok.encode_special_tokens = True
    docs = spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path(BYTES), tokenizer_path(RANKS), with_ids=True, special_as_text=True).first()
    assert got.ids == [*tok.encode(TEXTS[1], add_special_tokens=False).ids, 0]
