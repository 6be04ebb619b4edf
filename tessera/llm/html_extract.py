"""Main text of web pages by a template deduced from equivalence classes of tokens.

Tokens of a page are its elements, told apart by their path (tags with classes), and its text runs, told apart by the
container they stand in and their text.  A token's occurrence vector says how often it comes on each page of the host; it is
folded into one sum of hashes (page, count).  Tokens of a host with equal vectors are an equivalence class.

1. A class holds tokens of any paths.  A text token in a class with elements comes just as often and just where these do: it belongs to the
   site's template and goes, wherever it stands.  Classes count from `least_pages` pages on; a path on fewer pages has its text counted
   with what holds it.
2. Classes nest as their elements do.  A container of whose text at least SHARE lies in such classes is fixed template, with all
   that it holds; the others are slots.
3. The main slot is the article or main element with the most text that varies.  Without one, the way leads down from the root to the
   slot that holds MOST of what varies outside links; containers in it with hardly any text outside links are menus.
4. A page's text is that of its host's main slot, without the fixed parts, menus and the site's own elements (nav, footer, aside,
   form, ...; class words such as "comments" or "advert" mark what tags don't, unless the container holds the article itself or
   most of the text).  A page without the main slot is cut by its own paths, as a host of one page is.

Order among neighbours plays no part: pages that show two boxes in another order still share them.  Where almost nothing
varies on a host (copies of one page) there is no telling template from text, and nothing counts as fixed.  An article is
never fixed, nor is what holds one, and a first heading (h1) beside the article in the main element that holds it is its headline.  Ties: of
equal slots the one of the greater path number.

Only token sums are shuffled for the template; templates are sent to all executors if they are small (SENT_BYTES, measured), else
pages meet them by (host, salt), so that a hot host is spread over `salts` keys.

Nulls: a null page is empty and has an empty text, a null address has the empty host.  Repeated rows give repeated results and leave classes
as they are.  An empty table gives no rows.  A page of any length is read whole.  Columns named text or n_chars are replaced.  Broken markup
(unclosed or unopened elements, a page that ends within a tag) is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import free, materialize
from tessera.llm.url_filter import url_parts

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
_LABELS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object", "canvas", "math"}
_CONTAINERS = {"html", "body", "head", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "dialog", "menu", "fieldset", "details", "button", "figure"}
_BLOCKS = _CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "address", "figcaption", "summary", "br", "hr", "option", "center", "hgroup", "legend"}
#: Elements that are the site's by their meaning.
_SITE = {"nav", "footer", "aside", "form", "head", "dialog", "menu", "button"}
#: Class, id and role words that mark what belongs to the site where neither tag nor template tells.
_SITE_WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Of a fixed container's text, this much is the same on all its pages; of a slot's text, this much lies in the slot that the way down takes.
SHARE, MOST = 0.9, 0.8
#: Templates of so many bytes in all are sent to every executor; larger ones are joined by a shuffle.
SENT_BYTES = 8 << 20


def _name(tag: str, attrs: str) -> str:
    """An element's name in paths: tag, classes (digits are one), and "!" if a word marks it as the site's."""
    labels = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _LABELS.finditer(attrs)} if attrs else {}
    words = {p.lower() for v in labels.values() for p in _PART.findall(v)}
    classes = re.sub(r"\d+", "0", "".join("." + c for c in sorted(labels.get("class", "").replace(">", "").replace("!", "").split())))
    return tag + classes + ("!" if tag not in ("html", "body", "article", "main") and not words.isdisjoint(_SITE_WORDS) else "")


#: The path of a page's root.
ROOT = 0


def _tag(name: str) -> str:
    return name.rstrip("!").partition(".")[0]


class Reader:
    """The runs of a page in order; counts element starts by path.

    A path is a number, the hash of its parent's number and its last name, so that depth costs nothing; `nodes` has each path's parent, name, and
    whether it lies in an article, in the order in which they were met."""

    def __init__(self, page: str):
        self.page, self.starts = page, {ROOT: 1}
        self.nodes: dict[int, tuple[int, str, bool]] = {ROOT: (ROOT, "", False)}
        self.known: dict[tuple[int, str], int] = {}

    def child(self, parent: int, name: str) -> int:
        path = self.known.get((parent, name))
        if path is None:
            raw = hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + name.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            path = self.known[(parent, name)] = int.from_bytes(raw, "little", signed=True) or 1
            self.nodes[path] = (parent, name, self.nodes[parent][2] or _tag(name) == "article")
        return path

    def runs(self) -> Iterator[tuple[int, int, bool, bool, str]]:
        """(container's path, block, within a link, within a first heading, raw text) of every text run."""
        page, find = self.page, _TOKEN.search
        stack: list[tuple[str, int]] = []  # tag, path
        path, block, link, head, at = ROOT, 0, 0, False, 0
        while True:
            m = find(page, at)
            if m is None:
                rest = page[at:]
                cut = re.search(r"<[a-zA-Z/!?][^>]*\Z", rest)  # ends within a tag
                rest = rest[: cut.start()] if cut else rest
                if rest:
                    yield path, block, link > 0, head, rest
                return
            if m.start() > at:
                yield path, block, link > 0, head, page[at : m.start()]
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag, closing = tag.lower(), m[1] == "/"
            if tag in _BLOCKS:
                block += 1
                head = tag == "h1" and not closing
            if tag in _RAW:
                if not closing and not m[3].endswith("/"):
                    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if tag == "a":
                link = max(0, link + (-1 if closing else 1))
            elif tag in _CONTAINERS:
                if closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            link = 0
                            break
                else:
                    stack.append((tag, self.child(path, _name(tag, m[3]))))
                    self.starts[stack[-1][1]] = self.starts.get(stack[-1][1], 0) + 1
                path = stack[-1][1] if stack else ROOT


def _by_meaning(name: str, in_article: bool) -> bool:
    """The element is the site's by its tag; in_article: what holds it is an article or lies in one."""
    tag = _tag(name)
    return tag in _SITE or (tag == "header" and not in_article)


def _is_article(name: str) -> bool:
    return _tag(name) in ("article", "main")


def text_hash(flat: str) -> int:
    return int.from_bytes(hashlib.blake2b(flat.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Token:
    """path's element (text None) or a text run in it: times on the page; characters outside links and within links, of the path's own runs and of all below
    without the site's own elements (for elements)."""

    path: int
    parent: int
    name: str
    in_article: bool
    text: int | None
    n: int
    chars: int
    linked: int
    below: int = 0
    below_linked: int = 0


def page_tokens(page: str) -> list[Token]:
    """Elements and text runs; text runs of the site's own elements and of articles are none, as neither can turn out fixed or not."""
    read, own, texts = Reader(page), {}, {}
    for path, _, linked, _, text in read.runs():
        flat = " ".join(text.split())
        if flat:
            own.setdefault(path, [0, 0])[linked] += len(flat)
            key = (path, text_hash(flat))
            n = texts.setdefault(key, [0, 0, 0])
            n[0] += 1
            n[1 + linked] += len(flat)
    silent: dict[int, bool] = {}
    below = {p: list(own.get(p, (0, 0))) for p in read.nodes}
    for p, (parent, name, _) in read.nodes.items():  # parents come first
        silent[p] = p != ROOT and (silent[parent] or _is_article(name) or _by_meaning(name, read.nodes[parent][2]))
    for p, (parent, name, _) in reversed(read.nodes.items()):
        if p != ROOT and not _by_meaning(name, read.nodes[parent][2]):
            below[parent][0] += below[p][0]
            below[parent][1] += below[p][1]
    out = [Token(p, read.nodes[p][0], read.nodes[p][1], read.nodes[read.nodes[p][0]][2], None, n, *own.get(p, (0, 0)), *below[p]) for p, n in read.starts.items()]
    return out + [Token(p, read.nodes[p][0], "", False, h, *n) for (p, h), n in texts.items() if not silent[p]]


@dataclass
class Template:
    """main: the main slot's path (None: no text); head: the path whose first heading belongs to it; fixed: paths that go with all they hold; lifted:
    marked paths that stay; lines: text runs (path, hash) that go."""

    main: int | None
    head: int | None
    fixed: frozenset[int]
    lifted: frozenset[int]
    lines: frozenset[tuple[int, int]] = frozenset()

    def site(self, path: int, name: str, in_article: bool) -> bool:
        return _by_meaning(name, in_article) or (name.endswith("!") and path not in self.lifted)


@dataclass
class Seen:
    """A path on a host: characters of all its pages, and how many of its own and of those below lie in classes."""

    parent: int
    name: str
    in_article: bool
    pages: int
    chars: int
    linked: int
    below: int
    below_linked: int
    const: int = 0
    below_const: int = 0


def template(own: dict[int, Seen], lines: Iterable[tuple[int, int]] = (), least_pages: int = 3) -> Template:
    """own: the paths of a host; a path whose parents aren't among them counts as part of the root."""
    depth: dict[int, int] = {}

    def place(p: int) -> int:
        way = []
        while p not in depth:
            way.append(p)
            if p == ROOT or p not in own or own[p].parent not in own:
                depth[p] = 0
            else:
                p = own[p].parent
        for q in reversed(way):
            depth.setdefault(q, 0 if q == ROOT or own[q].parent not in own else depth[own[q].parent] + 1)
        return 0

    for p in own:
        place(p)
    down = sorted(own, key=lambda p: (p != ROOT, depth[p]))  # outer paths first
    up = lambda p: own[p].parent if p != ROOT and own[p].parent in own else None
    meant: dict[int, bool] = {}
    for p in down:
        q = up(p)
        meant[p] = (q is not None and meant[q]) or (p != ROOT and _by_meaning(own[p].name, own[p].in_article))
        own[p].below_const = own[p].const
    for p in reversed(down):
        q = up(p)
        if q is not None and not _by_meaning(own[p].name, own[p].in_article):
            own[q].below_const += own[p].below_const
    articles = [p for p in own if p != ROOT and _is_article(own[p].name) and not meant[p]]
    holds: set[int] = set()
    marked: dict[int, bool] = {}
    for p in articles:
        q: int | None = p
        while q is not None and q not in holds:
            holds.add(q)
            q = up(q)
    for p in down:
        q = up(p)
        marked[p] = (q is not None and marked[q]) or own[p].name.endswith("!")
    clear = [p for p in articles if not marked[p]]
    whole = own[ROOT].below + own[ROOT].below_linked
    lifted = frozenset(p for p in own if own[p].name.endswith("!") and (p in holds or (not clear and 2 * (own[p].below + own[p].below_linked) > whole)))
    made = Template(None, None, frozenset(), lifted)
    site: dict[int, bool] = {}
    for p in down:
        q = up(p)
        site[p] = (q is not None and site[q]) or (p != ROOT and made.site(p, own[p].name, own[p].in_article))
    open_ = [p for p in own if not site[p]]
    moving = sum(own[p].chars + own[p].linked - own[p].const for p in open_)
    rare = whole - sum(own[p].chars + own[p].linked for p in own if not meant[p])  # of paths that are not among them: it varies
    moving += max(0, rare)
    varies = moving >= (1 - SHARE) * max(1, sum(own[p].chars + own[p].linked for p in open_) + max(0, rare))
    total = lambda p: own[p].below + own[p].below_linked
    fixed = {p for p in open_ if p != ROOT and varies and p not in holds and own[p].pages >= least_pages and total(p) and own[p].below_const >= SHARE * total(p) and 2 * (total(p) - own[p].below_const) <= moving}
    gone: dict[int, bool] = {}
    slot = {p: own[p].below for p in own}  # characters outside links in what is neither the site's nor fixed
    for p in down:
        q = up(p)
        gone[p] = (q is not None and gone[q]) or p in fixed or (p != ROOT and made.site(p, own[p].name, own[p].in_article))
        if gone[p] and q is not None and not gone[q] and not _by_meaning(own[p].name, own[p].in_article):
            x: int | None = q
            while x is not None:
                slot[x] -= own[p].below
                x = up(x)
    inner = [p for p in articles if not gone[p] and slot[p]]
    main = head = None

    def within(p: int, top: int) -> bool:
        q: int | None = p
        while q is not None and q != top:
            q = up(q)
        return q == top

    if inner:
        outmost = [p for p in inner if not any(x != p and within(p, x) for x in inner)]
        head = max(outmost, key=lambda p: (slot[p], p))
        deep = [p for p in inner if p != head and within(p, head) and slot[p] >= MOST * slot[head]]
        main = max(deep, key=lambda p: (depth[p], p)) if deep else head
    elif slot[ROOT] > 0 or own[ROOT].below_linked:
        main = ROOT
        children: dict[int, list[int]] = {}
        for p in own:
            if p != ROOT and up(p) is not None and not gone[p]:
                children.setdefault(up(p), []).append(p)
        while True:
            best = max(children.get(main, ()), key=lambda p: (slot[p], p), default=None)
            if best is None or not slot[best] or slot[best] < MOST * slot[main]:
                break
            main = best
        if slot[main]:  # menus beside the text
            fixed |= {p for p in own if p not in (main, ROOT) and total(p) and own[p].below_linked >= SHARE * total(p) and within(p, main)}
    return Template(main, head, frozenset(fixed), lifted, frozenset(lines) if varies else frozenset())


def own_template(page: str) -> Template:
    return template({t.path: Seen(t.parent, t.name, t.in_article, 1, t.chars, t.linked, t.below, t.below_linked) for t in page_tokens(page) if t.text is None})


def main_text(page: str, cut: Template | None) -> str:
    """Texts of the runs in the main slot, block by block."""
    cut = cut or own_template(page)
    kept: dict[int, tuple[bool, bool, bool]] = {ROOT: (cut.main == ROOT, False, cut.head == ROOT)}  # in the main slot, taken out, under head
    got: list[list[str]] = []
    last, seen = -1, False
    read = Reader(page)

    def state(path: int) -> tuple[bool, bool, bool]:
        way = []
        while path not in kept:
            way.append(path)
            path = read.nodes[path][0]
        for p in reversed(way):
            parent, name, _ = read.nodes[p]
            inside, out, under = kept[parent]
            gone = p in cut.fixed or cut.site(p, name, read.nodes[parent][2])
            # what holds the main slot isn't taken out
            kept[p] = (inside or p == cut.main, (out or gone) if inside else False, (under and not gone) or p == cut.head)
        return kept[way[0]] if way else kept[path]

    for path, block, _, head, text in read.runs():
        inside, out, under = state(path)
        seen |= inside
        if not ((inside and not out) or (head and under and not inside)):
            continue
        if cut.lines and inside:
            flat = " ".join(text.split())
            if flat and (path, text_hash(flat)) in cut.lines:
                continue
        if block != last:
            got.append([])
            last = block
        got[-1].append(_html.unescape(text) if "&" in text else text)
    if not seen and page:
        own = own_template(page)
        if own.main is not None and own.main != cut.main:
            return main_text(page, Template(own.main, own.head, own.fixed | cut.fixed, own.lifted | cut.lifted, cut.lines))
    return " ".join(t for t in (" ".join("".join(b).split()) for b in got) if t)


_TOKENS = "host string, page_key long, path long, parent long, name string, in_article boolean, text long, n long, chars long, linked long, below long, below_linked long"


def occurrences(pages: DataFrame) -> DataFrame:
    """pages: host, page_key, html -> a row per token of a host: host, path, text (null for elements), vector, pages, and what its path is and holds."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 6)
    names = [x.split()[0] for x in _TOKENS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = [(host, key, t.path, t.parent, t.name, t.in_article, t.text, t.n, t.chars, t.linked, t.below, t.below_linked) for host, key, page in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True) for t in page_tokens(page or "")]
                cols = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    tokens = pages.select("host", "page_key", "html").mapInArrow(run, _TOKENS)
    vector = F.sum(F.xxhash64("page_key", "n").cast("decimal(20,0)")).alias("vector")
    sums = [F.sum(c).alias(c) for c in ("chars", "linked", "below", "below_linked")]
    return tokens.groupBy("host", "path", "text").agg(vector, F.count("*").alias("pages"), *[F.first(c).alias(c) for c in ("parent", "name", "in_article")], *sums)


def deduce_templates(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """pages: host, page_key, html -> host, main, head, fixed, lifted, lines: the template of every host.

    A class is what has one vector on a host, whatever its paths.  Text tokens of a class that has elements too are the template's.  Paths that lie on
    fewer than `least_pages` pages (of a host with as many) can't be; their text counts with what holds them, so they needn't be sent."""
    element = F.col("text").isNull()
    seen = materialize(occurrences(pages).filter(element | (F.col("pages") >= least_pages)), "tokens")
    whole = seen.filter(element & (F.col("path") == ROOT)).select("host", F.col("pages").alias("all_pages"))
    with_elements = seen.filter(element & (F.col("pages") >= least_pages)).select("host", "vector").distinct()
    lines = seen.filter(~element).join(with_elements, ["host", "vector"], "left_semi").select("host", "path", "text", (F.col("chars") + F.col("linked")).alias("const"))
    consts = lines.groupBy("host", "path").agg(F.sum("const").alias("const"))
    frequent = seen.filter(element).join(whole, "host").filter(F.col("pages") >= F.least(F.lit(least_pages), F.col("all_pages")))
    paths = frequent.join(consts, ["host", "path"], "left")
    fields = ("parent", "name", "in_article", "pages", "chars", "linked", "below", "below_linked")
    held = paths.groupBy("host").agg(F.collect_list(F.struct("path", *fields, F.coalesce("const", F.lit(0)).alias("const"))).alias("rows"))
    held = held.join(lines.groupBy("host").agg(F.collect_list(F.struct("path", "text")).alias("lines")), "host", "left")
    names = ["host", "main", "head", "fixed", "lifted", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for rows, fixed_lines in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = {r["path"]: Seen(*(r[k] for k in fields), r["const"]) for r in rows}
                made.append(template(own, [(x["path"], x["text"]) for x in fixed_lines or []], least_pages))
            lists = [pa.array([sorted(getattr(t, k)) for t in made], pa.list_(pa.int64())) for k in ("fixed", "lifted")]
            flat = pa.array([[v for x in sorted(t.lines) for v in x] for t in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([getattr(t, k) for t in made], pa.int64()) for k in ("main", "head")), *lists, flat], names=names)

    return held.select("host", "rows", "lines").mapInArrow(run, "host string, main long, head long, fixed array<long>, lifted array<long>, lines array<long>")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 64, least_pages: int = 3, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """pages without the markup, with text and n_chars."""
    keep = [f for f in pages.schema.fields if f.name not in {"text", "n_chars", html_col}]
    names = [f.name for f in keep]
    host = url_parts(F.col(f"`{url_col}`").cast("string"))[0]
    page = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    key = F.xxhash64(*[F.col(f"`{x}`").cast("string") for x in names], F.length(page))
    cuts = materialize(deduce_templates(pages.select(host.alias("host"), key.alias("page_key"), page.alias("html")), least_pages), "templates")
    host_, html_, key_, cut_, salt_ = (free(x, names) for x in ("__host", "__html", "__key", "__cut", "__salt"))
    cuts = cuts.select(F.col("host").alias(host_), F.struct("main", "head", "fixed", "lifted", "lines").alias(cut_))
    numbers = F.size(f"{cut_}.fixed") + F.size(f"{cut_}.lifted") + F.size(f"{cut_}.lines")
    size = cuts.agg(F.sum(96 + F.octet_length(host_) + 8 * numbers)).first()[0] or 0
    rows = pages.select(*[F.col(f"`{x}`") for x in names], host.alias(host_), page.alias(html_), key.alias(key_))
    if size <= sent_bytes:
        joined = rows.join(F.broadcast(cuts), host_, "left")  # `size` bytes, as measured
    else:
        salted = cuts.withColumn(salt_, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn(salt_, F.pmod(key_, F.lit(salts)).cast("int")).join(salted.hint("shuffle_hash"), [host_, salt_], "left")
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Template] = {}
        for b in batches:
            texts = []
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                html, cut = (part.column(part.schema.names.index(x)).to_pylist() for x in (html_, cut_))
                for p, c in zip(html, cut, strict=True):
                    at = (c["main"], c["head"], tuple(c["fixed"]), tuple(c["lifted"]), tuple(c["lines"])) if c else None
                    if at is not None and at not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[at] = Template(at[0], at[1], frozenset(at[2]), frozenset(at[3]), frozenset(zip(at[4][::2], at[4][1::2], strict=True)))
                    texts.append(main_text(p, known[at] if at is not None else None))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(x)) for x in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return joined.select(*[F.col(f"`{x}`") for x in names], html_, cut_).mapInArrow(run, schema)
