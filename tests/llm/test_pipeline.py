"""Stages of the pipeline on repeated and missing ids."""

import corpus_pipeline


def words(first, n=60, changed=()):
    return " ".join(f"x{k}" if k in changed else f"{first}{k}" for k in range(n))


def near(spark, rows):
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)


def test_near_duplicates_by_text(spark):
    a, b, c, d = words("a"), words("b"), words("c"), words("d")
    late = words("b", changed=[59])
    nulls = [(None, a), (None, "other words"), (None, None)]
    # 5: its b is a copy of 3's, its a is its own; 7: two texts of its own, one of them repeated; 8: a near copy of 3's and c
    rows = [(3, b), (5, a), (5, b), (7, c), (7, c), (7, d), (8, late), (8, c), (9, ""), (9, None), (9, None), *nulls]
    want = [(3, b), (5, a), (7, c), (7, d), (9, ""), (9, None), *nulls]
    assert near(spark, rows) == sorted(want, key=repr)


def test_near_duplicates_keep_null_ids_without_repeats(spark):
    a, b = words("a"), words("b")
    rows = [(1, a), (2, a), (3, b), (None, a), (None, a)]
    assert near(spark, rows) == sorted([(1, a), (3, b), (None, a), (None, a)], key=repr)


def test_near_duplicates_of_one_id(spark):
    a, late = words("a"), words("a", changed=[59])
    got = near(spark, [(4, a), (4, late), (6, a), (6, words("z"))])
    assert len(got) == 2 and got[0][0] == 4 and got[1] == (6, words("z"))


def test_near_duplicates_at_five_words_and_80_percent(spark):
    a, b = words("a", 100), words("b", 100)
    rows = [(1, a), (2, words("a", 100, [30, 60])), (3, b), (4, words("b", 100, [30, 50, 70]))]  # 0.811 and 0.729 on five words
    assert near(spark, rows) == [rows[0], *rows[2:]]


def test_repeated_rows_keep_one_by_its_other_columns(spark):
    """Of rows with one id and text the same one stays in every order of the rows."""
    a = words("a")
    rows = [(1, a, "en", s, n) for s in ("s1", "s2", None) for n in (1, 2)] + [(2, words("b"), None, "s", None)] * 2
    kept = set()
    for k in range(3):
        docs = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        kept.add(tuple(sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)))
    assert len(kept) == 1 and len(next(iter(kept))) == 2


def test_stages_keep_very_long_texts_and_clashing_columns(spark):
    """A long text and columns named as the stages' own pass through near duplicates, secrets and packing whole."""
    long = " ".join(f"w{k}" for k in range(60_000)) + " password: hunter2secret " + "tail " * 5
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, words("c"), "en", "s", 9), (4, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("n_words", "score", "kept", "masks", "component_id"):
        docs = docs.withColumn(c, corpus_pipeline.F.lit(c))
    one = corpus_pipeline.near_duplicates(spark, docs, "")
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [1, 3, 4]
    two = corpus_pipeline.secrets(spark, one, "")
    got = {r.doc_id: r for r in two.collect()}
    assert two.columns == docs.columns and "hunter2secret" not in got[1].text and got[1].text.endswith("tail ") and got[1].n_chars == len(got[1].text)
    assert all(got[i][c] == c for i in got for c in ("n_words", "score", "kept", "masks", "component_id")) and got[4].text is None
    packed = corpus_pipeline.pack(spark, two, "").collect()
    assert {r.doc_id for r in packed} == {1, 3, 4} and sum(r.length for r in packed if r.doc_id == 4) == 1
