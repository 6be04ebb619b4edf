"""HTML extraction: classes by brute force, pages that only the template can clean, layouts, edges."""

from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import html_extract as hx

SCHEMA = "page_id long, url string, html string"


def prose(k, n=40):
    return " ".join(f"w{k}x{(k * 7 + j * j) % 97}" for j in range(n))


def texts(spark, rows, **how):
    return {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def site(k, menu="<div class=x1><span>Home</span> <span>Prices</span> <span>Contact us</span></div>"):
    return f"<html><body><div class=top>Our shop since 1901</div>{menu}<div class=c2><p>{prose(k)}</p><p>{prose(k + 50)}</p><div class=z>Read it again tomorrow</div></div></body></html>"


def test_classes_equal_brute_force(spark):
    pages = [("h", 1, site(1)), ("h", 2, site(2)), ("h", 3, site(3, "")), ("g", 4, site(1)), ("g", 5, site(1)), ("g", 5, site(1)), ("g", 6, None)]
    got = defaultdict(set)
    for r in hx.occurrences(spark.createDataFrame(pages, "host string, page_key long, html string")).collect():
        got[(r.host, r.vector)].add((r.path, r.text))
    vectors = defaultdict(lambda: defaultdict(int))
    for i, (host, _, html) in enumerate(pages):
        for t in hx.page_tokens(html or ""):
            path, text, n = t.path, t.text, t.n
            vectors[(host, path, text)][i] += n
    want = defaultdict(set)
    for (host, path, text), v in vectors.items():
        want[(host, tuple(sorted(v.items())))].add((path, text))
    assert sorted(map(sorted, (map(str, c) for c in got.values()))) == sorted(map(sorted, (map(str, c) for c in want.values())))


def test_only_the_template_can_clean(spark):
    rows = [(k, f"http://h/{k}", site(k)) for k in range(6)]
    want = {k: f"{prose(k)} {prose(k + 50)}" for k in range(6)}
    assert texts(spark, rows) == want
    off = texts(spark, rows, least_pages=100)  # no class is ever valid
    assert all("Read it again tomorrow" in t for t in off.values())
    assert texts(spark, rows, sent_bytes=0) == want  # templates joined by a shuffle
    mixed = [(k, f"http://m/{k}", site(k, "" if k % 2 else f"<div class=x1><span>Home</span> <span>Prices</span></div><div class=y{k}>{prose(k + 20, 30)}</div>")) for k in range(6)]
    assert all("Home" not in t and "1901" not in t and prose(k) in t for k, t in texts(spark, mixed).items())


def test_menu_beside_two_slots(spark):
    page = lambda k: f"<body><div class=a>{''.join(f'<a href=/>{prose(k + j, 2)}</a>' for j in range(9))}</div><div class=lead>{prose(k)}</div><div class=rest><div>{prose(k + 9)}</div><div>{prose(k + 30)}</div></div></body>"
    got = texts(spark, [(k, f"http://h/{k}", page(k)) for k in range(4)] + [(9, "http://one/", page(9))])
    assert got == {k: f"{prose(k)} {prose(k + 9)} {prose(k + 30)}" for k in (0, 1, 2, 3, 9)}


def test_marked_containers_that_hold_the_article(spark):
    rows = []
    for i, box in enumerate(("div class='content-sidebar-wrap'", "div class='layout has-sidebar'", "section id='search-page'")):
        tag = box.split()[0]
        rows.append((i, f"http://a{i}/", f"<body><nav>menu</nav><{box}><article><p>{prose(i)}</p></article></{tag}><footer>f</footer></body>"))
        rows.append((i + 10, f"http://b{i}/", f"<body><{box}><div class=t><p>{prose(i)}</p></div></{tag}><div class='ad'>buy this</div></body>"))
    rows.append((20, "http://c/", f"<body><div class=ad>{prose(1, 60)}</div><article><p>short one</p></article><div class=comments>{prose(2)}</div></body>"))
    got = texts(spark, rows)
    assert got == {**{i: prose(i % 10) for i in (0, 1, 2, 10, 11, 12)}, 20: "short one"}


def test_copies_and_recurring_paragraphs_stay(spark):
    same = [(k, f"http://h/{k}", site(1)) for k in range(5)]  # nothing varies on the host: no template
    assert all(prose(1) in t and prose(51) in t for t in texts(spark, same).values())
    art = lambda k: f"<body><main><h1>T{k}</h1><p>{prose(k)}</p><p>Licensed under terms.</p><div class=b><p>Licensed again.</p></div></main></body>"
    got = texts(spark, [(k, f"http://h/{k}", art(k)) for k in range(5)])
    assert all("Licensed under terms." in t and t.startswith(f"T{k} {prose(k)}") for k, t in got.items())


def test_edges(spark):
    long = "<article>" + "".join(f"<p>a&amp;b {k}</p>" for k in range(30000)) + "</article>"
    rows = [(1, None, "<p>x <b>y</b>z</p>"), (2, "http://h/", None), (3, "http://h/", ""), (4, "http://l/", long), (4, "http://l/", long), (None, "http://q/", "<p>&nbsp;&eacute;&#x41;</p>"), (5, "u", "<div"), (6, "http://t/", "<ul><li><a href=/>only links</a></li></ul>"), (7, "http://e/", "<article></article><p>out</p>")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x")).withColumn("host", F.lit(2))
    got = sorted(((r.page_id or 0, r.text, r.n_chars, r.host) for r in hx.extract(df).collect()), key=str)
    body = " ".join(f"a&b {k}" for k in range(30000))
    want = [(0, "éA", 2, 2), (1, "x yz", 4, 2), (2, "", 0, 2), (3, "", 0, 2), (4, body, len(body), 2), (4, body, len(body), 2), (5, "", 0, 2), (6, "only links", 10, 2), (7, "out", 3, 2)]
    assert got == sorted(want, key=str)
    assert hx.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_nesting(spark):
    deep = "<div>" * 20000 + "<p>at the bottom</p>" + "</div>" * 20000 + "<p>after</p>"
    assert texts(spark, [(1, "http://d/", deep)]) == {1: "at the bottom after"}


def test_site_elements_at_any_depth(spark):
    rows = []
    for i, depth in enumerate((10, 63, 64, 65, 70, 5000)):
        site = "<nav>MENU</nav><aside>ASIDE</aside><script>x()</script><div class=advert>AD</div>"
        rows.append((i, f"http://d{i}/", "<div>" * depth + f"{site}<p>Real text here</p><footer>FOOT</footer>" + "</div>" * depth))
        rows.append((100 + i, f"http://e{i}/", "<body>" + "<div>" * depth + f"{site}<article><h1>Head</h1><p>{prose(i)}</p></article><footer>FOOT</footer>" + "</div>" * depth))
    got = texts(spark, rows)
    assert got == {**{i: "Real text here" for i in range(6)}, **{100 + i: f"Head {prose(i)}" for i in range(6)}}


def test_headline_beside_the_article(spark):
    page = lambda k: f"<body><h1>Site name</h1><main><header>top</header><h1>Headline {k}</h1><div class=share>share</div><article><p>{prose(k)}</p></article><aside>more</aside></main></body>"
    got = texts(spark, [(k, f"http://h{k % 2}/{k}", page(k)) for k in range(6)])
    assert got == {k: f"Headline {k} {prose(k)}" for k in range(6)}


def generated(k, n_pages):
    """A page without an article element and its text: menus of varying length, boxes in varying places, a container of its own for the text."""
    g = __import__("random").Random(k)
    name = "".join(g.choice("abcdefgh") for _ in range(12))
    menu = "<ul>" + "".join(f"<li><span>{w}</span></li>" for w in ["Home page", *(f"Topic {g.randrange(10**6)}" for _ in range(g.randrange(0, 3)))]) + "</ul>"
    boxes = ["<div class=brand>The example company since 1901</div>", "<div class=tail>All rights are reserved by us</div>"]
    parts = [prose(k + 1000 * j, g.randrange(30, 60)) for j in range(g.randrange(2, 5))]
    body = "".join(f"<p>{x}</p>" for x in parts)
    middle = f"<div class=wrap><div class={name}>{body}</div><div class=hint>Please read our rules first</div></div>"
    return f"<html><body>{boxes[0]}{menu}{middle}{boxes[1]}</body></html>", " ".join(parts)


def test_generated_hosts_by_their_known_texts(spark):
    """What the host shares goes, wherever it stands; what it doesn't share stays, however rare its containers: at every size of the host."""
    for n in (30, 101, 150):
        pages = {k: generated(k, n) for k in range(n)}
        got = texts(spark, [(k, f"http://host/{k}", html) for k, (html, _) in pages.items()])
        for k, (_, want) in pages.items():
            left = got[k].replace(want, "|")
            assert "|" in left and not any(x in left for x in ("example company", "rights are reserved", "read our rules", "Home page")), (n, k, left[:200])
        off = texts(spark, [(k, f"http://host/{k}", html) for k, (html, _) in pages.items()], least_pages=1000)
        assert sum("read our rules" in t for t in off.values()) == n


def test_lines_of_the_template_go_by_plain_vectors(spark):
    """The lines that go are those whose vector is an element's, found by plain loops over a host of any paths."""
    pages = {k: generated(k, 20)[0] for k in range(20)}
    counts = defaultdict(lambda: defaultdict(int))
    for k, html in pages.items():
        for t in hx.page_tokens(html):
            counts[(t.path, t.text)][k] += t.n
    vectors = {tok: tuple(sorted(v.items())) for tok, v in counts.items()}
    elements = {v for (_, text), v in vectors.items() if text is None and len(v) >= 3}
    want = {tok for tok, v in vectors.items() if tok[1] is not None and v in elements}
    df = spark.createDataFrame([("h", k, html) for k, html in pages.items()], "host string, page_key long, html string")
    flat = hx.deduce_templates(df).first().lines
    assert set(zip(flat[::2], flat[1::2], strict=True)) == want and len(want) >= 4


def test_ties_and_own_column_names(spark):
    half = "<body><div class=a>{}</div><div class=b>{}</div></body>".format(*["same length text"] * 2)
    rows = [(1, "http://t/1", half), (2, "http://t/2", half), (3, "http://t/3", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("main", "path", "lines", "page_key", "vector"):
        df = df.withColumn(c, F.lit(c))
    got = {r.page_id: (r.text, r.main, r.path, r.lines, r.page_key, r.vector) for r in hx.extract(df).collect()}
    kept = ("main", "path", "lines", "page_key", "vector")
    own = ("__host", "__html", "__key", "__cut", "__salt")
    for c in own:
        df = df.withColumn(c, F.lit(c))
    assert all(tuple(r[c] for c in own) == own for how in ({}, {"sent_bytes": 0}) for r in hx.extract(df, **how).collect())
    assert got == {1: ("same length text same length text", *kept), 2: ("same length text same length text", *kept), 3: ("", *kept)}
