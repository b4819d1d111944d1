"""Main text of web pages by template deduction over the pages of a host.

A token is an element's start tag in its role (the path of elements that lead to it, with their ids and classes), or the whole text
of the elements in one role. The occurrence vector of a token says how often it stands in each page of the host; tokens with the
same vector form an equivalence class. Vectors are never gathered: a page adds one hash of (page, count) to each of its tokens, and hashes
are folded with XOR in the map tasks, so a class is what shares (host, fold, pages) and a host with a third of all pages costs one row
per token and task. A text token has the vector of its element exactly where all pages with the element say the same in it, so its
smallest and largest hash stand for it.

A class is valid if it has ``SIZE`` tokens or more, stands in enough of the host's pages (``SUPPORT``), and its elements nest: the parent of
each is in the template too. Valid classes, nested by path, are the host's template. Where the text of a template element is in the
element's own class it is template text and goes, whatever it is called, also inside an article; ``CONTENTS`` pages of different
content must agree on it, since copies and near copies of a page agree on everything. What is left between are the slots: text that
varies, or that stands in a role shared with varying text. The main text are the slots below the template's article elements, or,
where it has none, below the deepest element that stands once in a page and holds every place outside boilerplate whose text varies from page
to page. Where no element holds them all, nothing but boilerplate and template text is dropped.

The contract's boilerplate is known by element or by words in id, class or role as well, since a host may have one page only: navigation,
headers, footers, side bars, notices, adverts, forms, scripts, styles, reader comments. Pages that lack the template's article, and
hosts without a valid class, are judged by these rules on their own elements.

Null and empty pages have empty text. Tags may be missing or unclosed; a comment or script without an end reaches to the end of the
page. Repeated pages get the same text; null urls share one host.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import keep
from feedops.llm.urls import host_of

SALTS = 32
#: A valid class stands in this share of a host's pages, and in two pages at least.
SUPPORT = 0.5
#: Tokens of a valid class: a single token that recurs is no template.
SIZE = 2
#: So many pages of different content must share a text before it is the template's; text blocks of ``LONG`` characters tell contents apart.
CONTENTS = 4
LONG = 100
#: Deeper paths are known by a hash of what is above, so that nesting without end costs no more.
LONGEST_PATH = 1000

# Fixed values of HTML and of common naming.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
ENDS_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body html article section div main".split())
BOILER_TAGS = frozenset("nav footer aside form script style noscript template head menu dialog button select textarea iframe svg object".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo related replies reply respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_TAGS = frozenset(("article", "main"))

RAW_END = {tag: re.compile(rf"</{tag}[\s>/]", re.IGNORECASE) for tag in "script style noscript template textarea iframe svg title".split()}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'])(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("tag", "path", "boiler", "main", "inner")

    def __init__(self, tag: str, path: str, boiler: bool, main: bool):
        self.tag, self.path, self.boiler, self.main = tag, path, boiler, main
        self.inner: dict[tuple[str, str], Element] = {}


def _opened(tag: str, attributes: str, parent: Element | None) -> Element:
    marks = {k.lower(): (a or b or c).lower() for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    words = set(SPLIT.split(f"{marks.get('id', '')} {marks.get('class', '')}")) - {""}
    role = marks.get("role", "")
    in_main = parent is not None and parent.main
    own = (
        tag in BOILER_TAGS or role in BOILER_ROLES
        or tag not in ("html", "body", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6") and not words.isdisjoint(BOILER_WORDS)
        or tag == "header" and not in_main
    )
    name = tag + "".join(f".{w}" for w in sorted(words) if not w.isdigit())
    boiler = own or parent is not None and parent.boiler
    main = not boiler and (in_main or tag in MAIN_TAGS or role == "main")
    above = parent.path if parent else ""
    if len(above) > LONGEST_PATH:
        above = f"#{xxhash.xxh64_hexdigest(above)}"
    return Element(tag, f"{above}/{name}" if above else name, boiler, main)


def walk(page: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open" or "void", element, "") for starts, ("close", element, "") for ends, and ("text", element it stands in, raw text)."""
    stack: list[Element] = []
    outer: dict[tuple[str, str], Element] = {}
    at = 0

    def closed(n: int) -> Iterator[tuple[str, Element, str]]:
        while len(stack) > n:
            yield "close", stack.pop(), ""

    while True:
        start = page.find("<", at)
        if start < 0:
            break
        hit = TAG.match(page, start)
        if hit is None and page[start + 1:start + 2] not in ("!", "?"):
            # a lone angle bracket is text
            yield "text", stack[-1] if stack else None, page[at:start + 1]
            at = start + 1
            continue
        if start > at:
            yield "text", stack[-1] if stack else None, page[at:start]
        if hit is None:
            comment = page.startswith("<!--", start)
            stop = page.find("-->" if comment else ">", start + (4 if comment else 2))
            at = len(page) if stop < 0 else stop + (3 if comment else 1)
            continue
        at = hit.end()
        shut, tag, attributes = hit.groups()
        tag = tag.lower()
        if shut:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    yield from closed(k)
                    break
            continue
        if tag in RAW_END:
            end = RAW_END[tag].search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = len(page) if stop < 0 else stop + 1
            continue
        if tag in CLOSES_P or tag in ENDS_SIBLING:
            ends = ENDS_SIBLING.get(tag, _NONE) | (_P if tag in CLOSES_P else _NONE)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    yield from closed(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        siblings = stack[-1].inner if stack else outer
        element = siblings.get((tag, attributes))
        if element is None:
            element = siblings[tag, attributes] = _opened(tag, attributes, stack[-1] if stack else None)
        if tag in VOID or attributes.endswith("/"):
            yield "void", element, ""
        else:
            yield "open", element, ""
            stack.append(element)
    if at < len(page):
        yield "text", stack[-1] if stack else None, page[at:]
    yield from closed(0)


_NONE, _P = frozenset(), frozenset("p")


class Token:
    """An element in its role, as a page has it."""

    __slots__ = ("times", "chars", "boiler", "main", "said", "whole")

    def __init__(self, boiler: bool, main: bool):
        self.times, self.chars, self.boiler, self.main = 0, 0, boiler, main
        #: hashes of the text right inside and of all text below; none without text
        self.said, self.whole = None, None


def _add(hashed: xxhash.xxh64 | None, part: bytes) -> xxhash.xxh64:
    hashed = hashed or xxhash.xxh64()
    hashed.update(part)
    return hashed


def tokens(page: str) -> tuple[dict[str, Token], int]:
    """The tokens of a page by path, and a hash of its content that copies share and near copies mostly.

    Text outside all elements has the empty path. ``main`` marks outermost articles.
    """
    found: dict[str, Token] = {}
    inside: set[str] = set()
    open_ones: list[list] = []
    long, short = [], []

    def text_of(inner: str) -> bytes:
        raw = f"{inner}\0".encode("utf-8", "surrogatepass")
        (long if len(inner) >= LONG else short).append(xxhash.xxh64_intdigest(raw))
        return raw

    for event, element, text in walk(page):
        if element is None:
            inner = text.strip()
            if inner:
                own = found.setdefault("", Token(False, False))
                own.times = 1
                own.chars += len(inner)
                own.said = own.whole = _add(own.said, text_of(inner))
            continue
        if event in ("open", "void"):
            own = found.get(element.path)
            if own is None:
                own = found[element.path] = Token(element.boiler, element.main and element.path.rpartition("/")[0] not in inside)
                if element.main:
                    inside.add(element.path)
            own.times += 1
            if event == "open":
                open_ones.append([own, None])
        elif event == "text":
            inner = text.strip()
            if inner and not element.boiler:
                own, raw = found[element.path], text_of(inner)
                own.chars += len(inner)
                own.said = _add(own.said, raw)
                open_ones[-1][1] = _add(open_ones[-1][1], raw)
        else:
            own, hashed = open_ones.pop()
            if hashed is not None and not own.boiler:
                own.whole = _add(own.whole, hashed.digest())
                if open_ones:
                    open_ones[-1][1] = _add(open_ones[-1][1], hashed.digest())
    return found, min(long) if long else xxhash.xxh64_intdigest(repr(short))


def blocks(page: str, roots: list[str], drops: list[str] = ()) -> list[str]:
    """Text blocks below the elements with a path in ``roots``; below all articles, or the body, if there is none.

    Elements with a path in ``drops`` are left out.
    """
    known, gone, dropped = set(roots), set(drops), 0
    found: dict[str, list[str]] = {"root": [], "main": [], "body": []}
    held: list[tuple[bool, bool, str]] = []
    inside = 0

    def flush() -> None:
        if len({(r, m) for r, m, _ in held}) == 1:
            text = _line(t for _, _, t in held)
            for name, fits in (("root", held[0][0]), ("main", held[0][1]), ("body", True)):
                if fits and text:
                    found[name].append(text)
        elif held:
            for name, parts in (("root", [t for r, _, t in held if r]), ("main", [t for _, m, t in held if m]), ("body", [t for *_, t in held])):
                text = _line(parts)
                if text:
                    found[name].append(text)
        held.clear()

    for event, element, text in walk(page):
        if event == "text":
            if not dropped and (element is None or not element.boiler):
                held.append((inside > 0, element is not None and element.main, text))
            continue
        if element.tag in BLOCKS:
            flush()
        elif element.tag == "br":
            held.append((inside > 0, element.main, " "))
        if event != "void":
            inside += (1 if event == "open" else -1) if element.path in known else 0
            dropped += (1 if event == "open" else -1) if element.path in gone else 0
    flush()
    return found["root"] or found["main"] or found["body"]


def _line(parts) -> str:
    return " ".join(markup.unescape("".join(parts)).split())


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, path, pages, fold, times, chars, boiler, main, varies, constant, contents): tokens with their folded occurrence vectors.

    ``varies``: the text right inside is not the same in all its pages. ``constant``: all text below is, so that this text has the
    element's vector. ``contents``: different contents among its pages, at most 63 and not above the true number.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, host, page in zip(*(c.to_pylist() for c in batch.columns)):
                found, content = tokens(page or "")
                for path, t in found.items():
                    fold = xxhash.xxh64_intdigest(f"{key}:{t.times}") - (1 << 63)
                    said, whole = (h.intdigest() if h else 0 for h in (t.said, t.whole))
                    rows.append((host, path, t.times, fold, t.chars, t.boiler, t.main, said - (1 << 63), whole - (1 << 63), 1 << content % 63))
            if rows:
                names = ["host", "path", "times", "fold", "chars", "boiler", "main", "said", "whole", "content"]
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=names)

    rows = pages.select(F.xxhash64("page_id", "url", F.length("html")).alias("key"), _host(), F.col("html").cast("string").alias("html"))
    single = rows.mapInArrow(
        run, "host string, path string, times long, fold long, chars long, boiler boolean, main boolean, said long, whole long, content long"
    )
    return single.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.bit_xor("fold").alias("fold"), F.max("times").alias("times"), F.sum("chars").alias("chars"), F.max("boiler").alias("boiler"), F.max("main").alias("main"),
        (F.min("said") != F.max("said")).alias("varies"), ((F.min("whole") == F.max("whole")) & (F.min("whole") > -(1 << 63))).alias("constant"),
        F.bit_count(F.bit_or("content")).alias("contents"),
    )


def _host():
    return F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")


def templates(pages: DataFrame) -> DataFrame:
    """(host, roots, drops): in each host's template the paths of the main slots and of the elements with template text."""
    found = keep(page_tokens(pages), "page-tokens")
    size = found.groupBy("host").agg(F.max("pages").alias("most"))
    # equivalence classes: same host, pages and folded vector; a constant text is a token beside its element
    classes = found.groupBy("host", "pages", "fold").agg((F.count("*") + F.count_if("constant")).alias("tokens"))
    members = found.join(classes, ["host", "pages", "fold"]).join(size, "host")
    valid = members.filter((F.col("tokens") >= SIZE) & (F.col("pages") >= 2) & (F.col("pages") >= SUPPORT * F.col("most")))
    parents = valid.select("host", F.col("path").alias("parent"))
    nested = (
        valid.withColumn("parent", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")))
        .join(parents.withColumn("has_parent", F.lit(True)), ["host", "parent"], "left").filter("parent IS NULL OR has_parent")
    )
    said = nested.filter(F.col("constant") & ~F.col("boiler") & ~F.col("main") & (F.col("path") != "") & (F.col("contents") >= CONTENTS))
    outer = said.select("host", F.col("path").alias("parent"))
    drops = said.join(outer, ["host", "parent"], "left_anti").groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("drops"))
    articles = nested.filter("main AND NOT boiler").groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("roots"))
    # without an article: places whose text varies, or that not all pages have, counted below each template element
    slots = found.join(size, "host").filter("NOT boiler AND chars > 0 AND (varies OR pages < most)").join(articles, "host", "left_anti")
    above = slots.select("host", F.explode(F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("path"))
    below = above.groupBy("host", "path").agg(F.count("*").alias("below"))
    every = slots.groupBy("host").agg(F.count("*").alias("slots"))
    holding = (
        nested.filter("NOT boiler AND times = 1 AND pages = most").join(below, ["host", "path"]).join(every, "host").filter("below = slots")
        .groupBy("host").agg(F.max_by("path", F.struct(F.size(F.split("path", "/")), F.col("path"))).alias("root"))
        .select("host", F.array("root").alias("roots"))
    )
    return articles.unionByName(holding).join(drops, "host", "full_outer").select("host", "roots", "drops")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html)."""
    made = keep(templates(pages), "templates").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host(),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(blocks(page, roots or [], drops or [])) if page else "" for page, roots, drops in zip(*(batch.column(c).to_pylist() for c in ("html", "roots", "drops")))]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    joined = rows.join(made, ["host", "salt"], "left").select("page_id", "url", "html", "roots", "drops")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
