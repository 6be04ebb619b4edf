"""Language ID: held-out accuracy, gradients by finite differences, texts without letters, edges."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_id as li

WORDS = {"en": "the of and with that this is was from they have been", "de": "der die und das mit ist nicht ein von auch werden", "fr": "le la les des et dans pour que avec est sont"}


def test_held_out_accuracy(spark):
    g = np.random.default_rng(1)
    rows = [(k, " ".join(g.choice(WORDS[lang].split(), 12)), lang if k % 7 else None, lang) for k in range(600) for lang in [sorted(WORDS)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    net = li.fit(docs, steps=150)
    got = li.predict(docs, net, keep_text=True).withColumn("held", li.held_out()).filter("held").collect()
    assert len(got) > 60 and np.mean([r.lang_pred == r.truth for r in got]) >= 0.98


def test_gradients():
    net = li.ByteGru(["a", "b"], hidden=4, embed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    codes, length = net.coded([b"abc", b"z", b"hello"])
    y = np.array([0, 1, 0])
    _, grad = net.gradients(codes, length, y)
    g = np.random.default_rng(0)
    for name, value in net.p.items():
        for _ in range(6):
            at = tuple(g.integers(0, n) for n in value.shape) if name != "E" else (int(g.choice(codes[codes > 0])), int(g.integers(0, 3)))
            old, losses = value[at], []
            for step in (1e-3, -1e-3):
                value[at] = old + step
                losses.append(net.gradients(codes, length, y)[0])
            value[at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 2e-4, name


def test_no_letter_and_edges(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in ((WORDS["en"], "en"), (WORDS["de"], "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = li.fit(docs, steps=60)
    odd = ["½ ²", "Ⅷ ①", "12 _", None, "", "\n", "the ½", WORDS["de"] + " " + "und " * 50000, "the", "the"]
    asked = spark.createDataFrame([*enumerate(odd), (None, "the")], "doc_id long, text string").withColumn("lang_pred", F.lit(3)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in li.predict(asked, net).collect()}
    assert [got[k].lang_pred for k in range(6)] == ["und"] * 6 and all(got[k].score == 0 for k in range(6))
    assert [got[k].lang_pred for k in (6, 7, 8, 9)] == ["en", "de", "en", "en"] and got[8].score == got[9].score
    assert li.predict(asked.limit(0), net).count() == 0


def test_ties_go_to_the_first_language():
    net = li.ByteGru(["aa", "bb"])
    net.p["V"][:] = 0  # both languages alike at every position
    assert li.Predictor(net)(["some words"]) == [("aa", 0.5)]


def one_by_one(net, text):
    """A document's language by scalar steps: every byte of every word forwards and backwards, no tables, no batches."""
    import re

    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = net.hidden
    total, places = np.zeros(len(net.langs)), 0
    for word in re.split(r"[ \t\n\x0b\x0c\r]+", text.lower()):
        if not any(c.isalpha() for c in word):
            continue
        raw = word.encode()
        for lo in range(0, len(raw), net.segment):
            codes = [32, *raw[lo : lo + net.segment], 32]
            states = {}
            for d, order in (("f", range(len(codes))), ("b", range(len(codes) - 1, -1, -1))):
                state = np.zeros(h)
                for t in order:
                    x = p["E"][codes[t]] @ p[f"W{d}"] + p[f"b{d}"]
                    u = state @ p[f"U{d}"]
                    z, r = (1 / (1 + np.exp(-(x[k * h : (k + 1) * h] + u[k * h : (k + 1) * h]))) for k in (0, 1))
                    n = np.tanh(x[2 * h :] + r * u[2 * h :])
                    state = z * state + (1 - z) * n
                    states[d, t] = state
            for t in range(len(codes)):
                logit = np.concatenate([states["f", t], states["b", t]]) @ p["V"] + p["c"]
                e = np.exp(logit - logit.max())
                total += e / e.sum()
                places += 1
    if not places:
        return "und", 0.0
    k = int(total.argmax())
    return net.langs[k], float(total[k] / places)


def test_pooled_predictions_one_by_one(spark):
    g = np.random.default_rng(3)
    rows = [(k, " ".join(g.choice(WORDS[lang].split(), 12)), lang) for k in range(200) for lang in [sorted(WORDS)[k % 3]]]
    net = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=80)
    mixed = [" ".join(g.choice(" ".join(WORDS.values()).split(), n)) for n in (1, 2, 5, 30)]
    texts = [*mixed, "12 the 34", "ÉTÉ und\tThe\nwas", "x" * 150 + " avec", "½ der", "", "...", "漢字 the", "a\x0bb\x0cc"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), net, table_size=5).collect()}
    for k, text in enumerate(texts):
        lang, score = one_by_one(net, text)
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-4, text


def test_further_columns_stay(spark):
    rows = [(k, WORDS[lang], lang) for k in range(30) for lang in ("en", "de")]
    net = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=30)
    asked = spark.createDataFrame([(1, "the and")], "doc_id long, text string")
    for c in ("lang", "word", "table", "__text", "__TEXT_"):
        asked = asked.withColumn(c, F.lit(c))
    row = li.predict(asked, net).first()
    assert [row[c] for c in ("lang", "word", "table", "__text")] == ["lang", "word", "table", "__text"]
