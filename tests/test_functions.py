"""Markup of any nesting and coded letters, by plain loops."""

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import letters as lt
from tessera.functions import markup as mk
from tessera.functions import text as tx


def values(spark, c, *texts):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").coalesce(1).select(c.alias("v")).collect()]


# ---- markup ----------------------------------------------------------------------------------------------------------

STYLES = {"l": r"^<lemma\b", "i": r"^<(?:emph|title)\b|^<foreign(?![^>]*greek)"}
SIGNS = {"quote": ("“", "”")}


def runs_by_hand(text, skip=None):
    """Open elements in the order of their opening; a closing tag takes the last one of its name."""
    open_, flat = [], []
    for m in re.finditer(r"<!--.*?(?:-->|\Z)|<[/A-Za-z][^<>]*>|[^<]+|<", text or "", re.S):
        t = m[0]
        if t.startswith("<!--"):
            continue
        tag = re.match(r"<(/?)([A-Za-z][^\s/>]*)", t)
        name = tag[2].lower() if tag else None
        alone = t.endswith("/>") or name in ("br", "hr", "img", "meta", "link", "input", "pb", "lb")
        if name and not alone:
            hit = None
            if tag[1]:
                at = [k for k, (n, _, _) in enumerate(open_) if n == name]
                hit = bool(at)
                if at:
                    del open_[at[-1]]
            else:
                kind = next((k for k, p in STYLES.items() if re.search(p, t, re.I)), None)
                open_.append((name, kind, bool(skip and re.search(skip, t, re.I))))
                hit = True
            if name in SIGNS and hit:
                flat.append(("t", SIGNS[name][1 if tag[1] else 0]))
        elif not name and not any(s for _, _, s in open_):
            flat.append((next((k for _, k, _ in reversed(open_) if k), "t"), html.unescape(t)))
    out = []
    for kind, x in flat:
        x = re.sub(r"[ \t\n\x0b\f\r]+", " ", x)
        if not x:
            continue
        if out and out[-1][0] == kind:
            out[-1] = (kind, re.sub(" +", " ", out[-1][1] + x))
        else:
            out.append((kind, x))
    before, made = " ", []
    for k, (kind, x) in enumerate(out):
        y = x.lstrip(" ") if before.endswith(" ") else x
        before = x
        y = y.rstrip(" ") if k == len(out) - 1 else y
        if y:
            made.append((kind, y))
    return made


def test_styled_runs_by_plain_loops(spark):
    g = random.Random(11)
    pieces = ["<lemma>", "</lemma>", "<emph>", "</emph>", "<foreign lang=\"greek\">", "<foreign lang=\"la\">", "</foreign>", "<quote>", "</quote>", "<p>", "</p>", "<note>", "</note>", "<br/>", "<lb>", "<!-- <emph> -->", "word ", " a", "b &amp; c", "\n", "<", "x < y"]
    texts = ["".join(g.choice(pieces) for _ in range(g.randrange(0, 30))) for _ in range(300)]
    texts += ["", None, "<emph>never closed", "closed</emph> only", "<lemma>a<emph>b</lemma>c</emph>d", "<emph>" * 300 + "deep" + "</emph>" * 300 + " out", "<note>gone<note>too</note>gone</note>stays"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string").repartition(3)
    for skip in (None, r"^<note\b"):
        got = {r.id: [tuple(x) for x in r.runs] for r in mk.styled_runs(df, ["id"], "body", STYLES, skip=skip, signs=SIGNS).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i] == runs_by_hand(t, skip), (t, skip)


def test_runs_convert_their_language(spark):
    df = spark.createDataFrame([(1, '<lemma>mh=nin</lemma>: <foreign lang="greek">*)axilh=os</foreign> of &lt;him&gt;')], "id int, body string")
    greek = F.when(F.col("kind").isin("l", "g"), lt.beta_code(F.col("text"))).otherwise(F.col("text"))
    row = mk.styled_runs(df, ["id"], "body", {"l": "^<lemma", "g": '^<foreign[^>]*greek'}, converted=greek).first()
    assert [tuple(x) for x in row.runs] == [("l", "μῆνιν"), ("t", ": "), ("g", "Ἀχιλῆος"), ("t", " of <him>")]


def test_cut_references_stay(spark):
    """A reference without its semicolon is text, as in the queries' SQL."""
    said = ["a &amp", "a &amp;&quo", "&copyright &ampquot; &#65 &#x41; &#65;", "&hellip;&nosuch;", None]
    assert values(spark, tx.unescape_closed(F.col("x")), *said) == ["a &amp", "a &&quo", "&copyright &ampquot; &#65 A A", "…&nosuch;", None]
    df = spark.createDataFrame([(1, "<b>R&amp;D &amp</b>")], "id int, body string")
    assert [tuple(x) for x in mk.styled_runs(df, ["id"], "body", {"b": "^<b"}).first().runs] == [("b", "R&D &amp")]


def test_paragraphs(spark):
    rows = [(1, "<p>one</p><p>two <emph>x</emph><p>three</p>"), (2, "no paragraph"), (3, "<p> </p><p>only</p>"), (4, None), (5, "before<p>in</p>")]
    got = sorted(tuple(r) for r in mk.keyed_paragraphs(spark.createDataFrame(rows, "id int, body string"), ["id"], "body").collect())
    assert got == [(1, 0, "one"), (1, 1, "two <emph>x</emph>"), (1, 2, "three"), (2, 0, "no paragraph"), (3, 0, "only"), (5, 0, "before"), (5, 1, "in")]


def test_templates_and_look_alikes_without_bounds(spark):
    deep = "a" + "{{x|" * 500 + "}}" * 500 + "b"
    assert values(spark, tx.clean_wiki(F.col("x")), deep, "{{a {{b}} c", "a }} {{b}}", "x {{{y}} z}}", None) == ["ab", "{{a c", "a }}", "x z}}", None]
    assert values(spark, tx.greek_letters(F.col("x")), "o" * 300 + "λ", "λ" + "uo" * 200, "out of", "Tύπoς", None) == ["ο" * 300 + "λ", "λ" + "υο" * 200, "out of", "Τύπος", None]
    assert values(spark, tx.tidy_punct(F.col("x")), "“afar.” “Forthwith", "“afar.”“Forth") == ["“afar. Forthwith", "“afar. Forth"]


# ---- letters ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("coded", "word"), [("mh=nin", "μῆνιν"), ("*)axilh=os", "Ἀχιλῆος"), ("*a", "Α"), ("sofo/s", "σοφός"), ("s1", "σ"), ("s2a", "ςα"), ("as3 b", "ας β".replace("ς", "σ")), ("tw=|", "τῷ"), ("tw|=", "τῷ"), ("a/)", "ἄ"), ("i+/", "ΐ"), ("*(/ellhn", "Ἕλλην"), ("a:b'#", "α·β’ʹ"), ("*", ""), ("*-x", "-χ"), ("jv", "jv"), ("MHNIS", "μηνις"), ("s,s", "ς,ς"), ("", ""), ("sσ", "σσ")])
def test_beta_code(spark, coded, word):
    assert values(spark, lt.beta_code(F.col("x")), coded) == [unicodedata.normalize("NFC", word)]


def test_romanize_once_per_word(spark):
    df = spark.createDataFrame([(1, "ἄγγελος"), (2, "ἄγγελος"), (3, "Χθὼν"), (4, "οὐρανός"), (5, "ψυχή, x1"), (6, None), (7, "")], "id int, w string")
    got = [(r.id, r.roman) for r in lt.once_per_word(df, "w", lt.romanize, "roman").orderBy("id").collect()]
    assert got == [(1, "angelos"), (2, "angelos"), (3, "chthon"), (4, "ouranos"), (5, "psychi, x1"), (6, None), (7, "")]
