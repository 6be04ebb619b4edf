"""Chat windows: the budget in tokens, system turns, empty turns, loss text, read back by brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import chat_format as cf
from tessera.llm.common import tokenizer_path
from tessera.llm.queries import BYTES, RANKS

SCHEMA = "conv_id long, turn long, role string, text string"


def windows(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("window", F.lit("x")).withColumn("formatted", F.lit(1))
    return cf.format_windows(df, tokenizer=tokenizer_path(BYTES), ranks=tokenizer_path(RANKS), **how)


def test_many_empty_turns_make_many_windows(spark):
    got = windows(spark, [(1, k, None, None) for k in range(20000)], budget=256, history=32).collect()
    count = cf.token_counter(tokenizer_path(BYTES), tokenizer_path(RANKS))
    assert len(got) > 400 and max(count(r.formatted) for r in got) <= 256


def test_a_large_system_turn_is_bounded(spark):
    rows = [(1, 0, "system", "rule " * 3000), *((1, k, "user" if k % 2 else "assistant", f"short {k}") for k in range(1, 51))]
    w = windows(spark, rows, budget=50, history=10)
    got = sorted(w.collect(), key=lambda r: r.window)
    assert sum(len(r.formatted) for r in got) < 40_000 and all(r.formatted.startswith("### System:\nrule") for r in got)
    count = cf.token_counter(tokenizer_path(BYTES), tokenizer_path(RANKS))
    assert all(count(r.formatted) <= 50 for r in got[1:])
    assert cf.window_digests(w).first().n_turns == 51


def test_digests_by_brute_force(spark):
    g = random.Random(3)
    bits = ["hi ", r"\### Assistant: ", "</turn>", "\n", "é漢", "\\", "\\t", "\\#", "### ", "word " * 60, "</tu", "rn>"]
    rows = []
    for c in range(40):
        for t in range(g.randrange(1, 30)):
            role = "system" if t == 0 and c % 3 == 0 else g.choice(["user", "assistant", "tool\n:", None])
            rows.append((c, t, role, None if g.random() < 0.1 else "".join(g.choice(bits) for _ in range(g.randrange(9)))))
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (None, None, None, None), (60, 0, "assistant", "long " * 20000)]
    got = {r.conv_id: r for r in cf.window_digests(windows(spark, rows, budget=120, history=40)).collect()}
    assert len(got) == 43
    for c, r in got.items():
        mine = sorted(((t if t is not None else -1, role or "", text or "") for i, t, role, text in rows if i == c))
        turns = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert windows(spark, [], budget=10).count() == 0
