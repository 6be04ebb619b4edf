"""Byte-level BPE: ids as the rank library gives them, the transducer against plain merging, streaming decoding, edges."""

import hashlib
import random
from array import array

import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import byte_bpe as bb
from tessera.llm.common import tokenizer_path
from tessera.llm.packing import WORDS
from tessera.llm.queries import MULTI

PATH = tokenizer_path(MULTI)
ALPHABETS = ["abcdefghij", "aab", "éñüßабвгд漢字仮名한국어", "  \n\t\r\x0b\x1c\x85\xa0　", "0123٣४", "'stre!?.-_", "\U0001f600́‍️", "࢏\U000323b0౜\U00011de0՘￿"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=bb.read_ranks(PATH), special_tokens={})


def plain(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_as_the_library(library):
    codec, g = bb.Codec(PATH, WORDS, table_size=500, most_states=3000), random.Random(3)
    for _ in range(4000):
        text = "".join(g.choice(g.choice(ALPHABETS)) for _ in range(g.randint(0, 50)))
        assert array("I", b"".join(codec.encode(text))).tolist() == library.encode_ordinary(text), text


def test_whole_pieces_and_lookahead():
    """Long pieces without word borders, over the limit of states; the lookahead stays as it is however long they are."""
    ranks = bb.read_ranks(PATH)
    machine, g = bb.Transducer(ranks, most_states=2000), random.Random(5)
    for n in (1, 2, 3, 50, 400):
        for letters in ("a", "ab", "the rain ", "-", "\n", "ñé", "0", "eatinrs"):
            piece = "".join(g.choice(letters) for _ in range(n)).encode()
            assert array("I", machine.encode(piece)).tolist() == plain(piece, ranks)
    assert machine.lookahead < 2 * max(map(len, ranks))
    before = machine.lookahead
    machine.encode(b"a" * 300_000)
    assert machine.lookahead == max(before, machine.lookahead) < 2 * max(map(len, ranks))


def test_small_vocabularies():
    """Random vocabularies of few letters: a token joins two neighbours that plain merging leaves in some text; all texts against plain merging."""
    for seed in range(25):
        g = random.Random(seed)
        ranks = {bytes([i]): i for i in range(256)}
        ids = dict(enumerate(ranks))
        while len(ranks) < 256 + 5 + 2 * seed:
            left = [ids[t] for t in plain(bytes(g.choice(b"aabc") for _ in range(25)), ranks)]
            k = g.randrange(len(left) - 1) if len(left) > 1 else None
            if k is not None and left[k] + left[k + 1] not in ranks:
                ids[len(ranks)] = left[k] + left[k + 1]
                ranks[left[k] + left[k + 1]] = len(ranks)
        machine = bb.Transducer(ranks, most_states=g.choice([20, 10_000]), rare=g.choice([0, 1, 24]))
        for _ in range(200):
            piece = bytes(g.choice(b"aabc") for _ in range(g.randint(1, 90)))
            assert array("I", machine.encode(piece)).tolist() == plain(piece, ranks)


def test_no_byte_level_bpe():
    single = {bytes([i]): i for i in range(256)}
    for bad in ({b"a": 0}, single | {b"abcd": 256}):
        with pytest.raises(ValueError, match="no byte-level BPE"):
            bb.Transducer(bad)


def test_streaming_decoder():
    g = random.Random(8)
    good = [c.encode() for c in "aé漢\U0001f600́"]
    parts = [*good, b"\xff", b"\xc3", b"\xe6\xbc", b"\xf0\x9f", b"\xed\xa0\x80", b"\xf4\x90", b"\xc0\x80", b"\xe0\x80", b"\x80", b"plain words "]
    for _ in range(5000):
        whole = b"".join(g.choice(parts) for _ in range(g.randint(0, 12)))
        stream, out, at = bb.Utf8Stream(), [], 0
        while at < len(whole):
            to = at + g.randint(0, 4)
            out.append(stream.feed(whole[at:to]))
            at = to
        assert "".join([*out, stream.close()]) == whole.decode("utf-8", "replace")


def test_edges(spark, library):
    texts = ["plain words here", "", None, "same", "same", "汉字 x" * 3, "word " * 90_000, "x" * 300_000, " \n\n  a", "\x00\x1f"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (None, None)], "doc_id long, text string")
    docs = docs.withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("__state", F.lit(2)).withColumn("__text", F.lit("own"))
    for with_text in (False, True):
        got = sorted(bb.encode_decode(docs.repartition(3), PATH, WORDS, with_text=with_text).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
        assert len(got) == len(texts) + 2
        for r, t in zip(got, [*texts, None, "no id"], strict=True):
            ids = library.encode_ordinary(t or "")
            assert r["__state"] == 2 and r["__text"] == "own" and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
            if with_text:
                assert r.ids == ids and r.decoded == (t or "")
    assert bb.encode_decode(docs.limit(0), PATH, WORDS).count() == 0
