"""Main text of web pages by union-free wrapper inference.

The pages of a host are aligned into one wrapper, an expression over their tags and texts
without alternatives.  Token streams are aligned on the path of signatures (tag and names)
that leads to an element: what two streams have on one path becomes one part, a part that
some pages lack becomes an optional group, one that follows itself on a page a repeated group,
and texts that differ become a slot.  An expression holds each path once, so an alignment
step is linear in the page, and wrappers merge like counts, in any order: tasks align the
pages they have, and an aggregate by host and path merges the rest.

Every page is read through its host's wrapper.  A container whose whole content is constant
where it stands (on three pages and three in ten of those with its path) is a template
block: menus, notices, offers and the like are left out wherever they stand, also inside a
semantic article and among optional parts.  Text in the flow of the main part is never left
out for being constant: a sub-heading or sentence may return on many pages.  A semantic
article tells where a page's main part is; elsewhere it is the deepest part that holds most
of the varying text of the host's pages with the same layout.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritflow.llm.common import small, small_batches, tidy, written

MAX_DEPTH = 400
TEMPLATE_PAGES = 3       # a template block stands on so many pages of its host at least,
TEMPLATE_SHARE = 0.3     # and on this share of those that have its path
MAIN_SHARE = 0.6         # the main part holds so much of the varying text
LAYOUT_SHARE = 0.01      # a layout of fewer of a host's pages is read by the host's main part

_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>"
    r"|(?P<raw>script|style|noscript|template|iframe|textarea|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<loose>[a-zA-Z][^\s/>]*)[^>]*>)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements and names by their role on a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
                   "table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("br td th img wbr".split()) - {"wbr"}
CLOSES_P = BLOCKS - {"html", "body", "option", "legend"}
CLOSED_BY_SELF = frozenset("li dt dd tr td th option p".split())
OUTSIDE = frozenset("head title nav footer aside form button select input menu dialog object audio video canvas label".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
                          "toolbar status".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer masthead topbar toolbar comment comments disqus "
    "reply replies respond discussion reactions related recommended recommendations share sharing social pagination pager login "
    "search copyright legal disclaimer".split())
HEADER_NAMES = frozenset("header head hero".split())
CONTAINERS = frozenset("address aside body center details dir div dl dialog fieldset figure footer form header hgroup html main "
                       "article menu nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    """An element of a page."""
    sig: str
    outside: bool = False
    main: bool = False
    items: list[Node | Text] = field(default_factory=list)


@dataclass
class Text:
    text: str
    size: int


def _names(value: str) -> set[str]:
    return {x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if x}


def _outside(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in OUTSIDE or (tag == "header" and not in_main):
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in OUTSIDE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    names = _names(f"{attrs.get('class', '')} {attrs.get('id', '')}")
    return bool(names & OUTSIDE_NAMES) or (not in_main and tag not in ("main", "article") and bool(names & HEADER_NAMES))


def parse(page: str | None) -> Node:
    """The element tree of a page; unclosed and stray tags are put up with."""
    root = Node("")
    stack, tags = [root], [""]
    deep: list[tuple[str, bool]] = []        # open elements below MAX_DEPTH, and whether in one outside the main text
    held: Counter[str] = Counter()           # how many of them by tag
    page = page or ""
    at = 0

    def text(raw: str) -> None:
        if deep and deep[-1][1]:
            return
        s = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        pad = bool(raw[:1].isspace()), bool(raw[-1:].isspace())
        if s:
            stack[-1].items.append(Text((" " if pad[0] else "") + s + (" " if pad[1] else ""), len(s)))
        elif raw:
            stack[-1].items.append(Text(" ", 0))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        end, tag = m["end"], m["tag"] or m["loose"]
        if end:
            end = end.lower()
            if held[end]:
                k = next(k for k in range(len(deep) - 1, -1, -1) if deep[k][0] == end)
                if end in BLOCKS or not any(t in BLOCKS for t, _ in deep[k + 1:]):
                    held.subtract(t for t, _ in deep[k:])
                    del deep[k:]
            elif end in tags[1:]:
                k = len(tags) - 1 - tags[::-1].index(end)
                # an inline end tag does not close the blocks around it
                if end in BLOCKS or not (any(t in BLOCKS for t in tags[k + 1:]) or any(t in BLOCKS for t, _ in deep)):
                    del stack[k:], tags[k:]
                    deep.clear()
                    held.clear()
        elif tag:
            tag = tag.lower()
            attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
            if deep:
                if tag in CLOSED_BY_SELF and deep[-1][0] == tag:
                    held[deep.pop()[0]] -= 1
            elif tag in CLOSES_P and "p" in tags:
                k = len(tags) - 1 - tags[::-1].index("p")
                if not any(t in BLOCKS for t in tags[k + 1:]):
                    del stack[k:], tags[k:]
            elif tag in CLOSED_BY_SELF and tags[-1] == tag:
                del stack[-1:], tags[-1:]
            names = sorted(_names(f"{attrs.get('class', '')} {attrs.get('id', '')}")) if attrs else []
            sig = ".".join([tag, *(x for x in names if not any(c.isdigit() for c in x))])
            main = tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
            node = Node(sig, _outside(tag, attrs, any(s.main for s in stack)), main)
            stack[-1].items.append(node)
            if tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
                if deep or len(stack) >= MAX_DEPTH:
                    held[tag] += 1
                    deep.append((tag, node.outside or bool(deep and deep[-1][1])))
                else:
                    stack.append(node)
                    tags.append(tag)
    if at < len(page):
        text(page[at:])
    return root


def _tag(node: Node) -> str:
    return node.sig.split(".", 1)[0]


# ------------------------------------------------------------------ alignment
def _hash(*parts: int | str) -> int:
    raw = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


ROOT = _hash("")


@dataclass
class Part:
    """A container with text on one page: its path and its content."""
    node: Node
    path: int
    content: int
    size: int            # characters outside links
    depth: int
    block: bool          # may be a template block


def parts(page: Node) -> list[Part]:
    """The containers of a page that have text, children before parents, the page itself last.

    Contents are digests of the texts and of the inner containers' digests, so the work is
    linear in the page.  Elements outside the main text by kind or name are passed over.
    """
    out: list[Part] = []

    def walk(node: Node, path: int, depth: int, linked: bool) -> tuple[list[int | str], int, bool]:
        said: list[int | str] = []
        size, only_heading = 0, True
        for x in node.items:
            if isinstance(x, Text):
                if x.size:
                    said.append(x.text.strip())
                    size += 0 if linked else x.size
                    only_heading &= _tag(node) in HEADINGS
            elif not x.outside or x.main:
                more, n, heading = walk(x, _hash(path, x.sig), depth + 1, linked or _tag(x) == "a")
                if more:
                    said += more
                    size += n
                    only_heading &= heading or _tag(x) in HEADINGS
        tag = _tag(node)
        if tag and (not said or tag not in CONTAINERS):
            return said, size, only_heading
        content = _hash(*said)
        # a page's frame is no block, and a heading in a box of its own is a heading
        block = not (node.main or tag in ("", "html", "body") or (only_heading and tag in ("div", "header", "hgroup")))
        out.append(Part(node, path, content, size, depth, block))
        return [content], size, only_heading

    walk(page, ROOT, 0, False)
    return out


@dataclass
class Slot:
    """One path of a wrapper: what the pages have there."""
    sig: str = ""
    pages: int = 0
    many: bool = False
    text: str | None = ""                 # None: a slot; "": no text of its own
    inner: dict[str, Slot] = field(default_factory=dict)


def align(wrapper: Slot, page: Node) -> None:
    """Align a page with the wrapper of the pages before it, element by element."""
    wrapper.pages += 1
    todo = [(wrapper, [page])]
    while todo:
        slot, nodes = todo.pop()
        texts = [x.text.strip() for n in nodes for x in n.items if isinstance(x, Text) and x.size]
        own = " ".join(texts)
        slot.text = own if slot.pages == 1 else (slot.text if slot.text == own else None)
        below: dict[str, list[Node]] = {}
        for n in nodes:
            here: Counter[str] = Counter()
            for x in n.items:
                if isinstance(x, Node):
                    below.setdefault(x.sig, []).append(x)
                    here[x.sig] += 1
            for sig, n_ in here.items():
                inner = slot.inner.setdefault(sig, Slot(sig))
                inner.many |= n_ > 1
        for sig, found in below.items():
            slot.inner[sig].pages += 1
            todo.append((slot.inner[sig], found))


def expression(slot: Slot, of: int | None = None) -> str:
    """The wrapper as a regular expression over tags, texts and #PCDATA slots, without alternatives."""
    own = "#PCDATA" if slot.text is None else re.escape(slot.text)
    inner = own + "".join(expression(x, slot.pages) for x in slot.inner.values())
    body = f"<{slot.sig}>{inner}</{slot.sig.split('.', 1)[0]}>" if slot.sig else inner
    optional = of is not None and slot.pages < of
    how = ("*" if slot.many else "?") if optional else ("+" if slot.many else "")
    return f"(?:{body}){how}" if how else body


@dataclass
class Wrapper:
    """What reading a page needs: marks of template blocks, and the main path by layout (0: all)."""
    template: set[int]
    main: dict[int, int]


def mark(part: Part) -> int:
    return _hash(part.path, part.content)


def layout(page: Node, template: set[int], found: list[Part]) -> int:
    """What a page is made of: the paths of its upper containers, without template blocks."""
    return _hash(*sorted({p.path for p in found if p.depth <= 4 and mark(p) not in template}))


def weights(found: list[Part], template: set[int]) -> list[tuple[int, int, int]]:
    """(path, depth, varying characters) of a page's containers: template blocks do not count."""
    at = {id(p.node): p for p in found}
    out = []

    def walk(node: Node) -> int:
        p = at.get(id(node))
        gone = p is not None and mark(p) in template
        lost = p.size if gone else sum(walk(x) for x in node.items if isinstance(x, Node) and (not x.outside or x.main))
        if p is not None and not gone:
            out.append((p.path, p.depth, p.size - lost))
        return lost

    walk(found[-1].node)
    return out


def lines(page: Node, main: Callable[[Node], bool], gone: Callable[[Node], bool]) -> list[tuple[str, bool]]:
    """The text of the main parts between block bounds, and whether it lies in a template block.

    ``main`` tells where a main part begins, ``gone`` which elements are template blocks.
    Elements outside the main text by kind or name are left out.
    """
    out: list[tuple[str, bool]] = []
    now: list[str] = []

    def flush(inside: bool, lost: bool) -> None:
        s = " ".join("".join(now).split())
        now.clear()
        if s and inside:
            out.append((s, lost))

    def walk(node: Node, inside: bool, lost: bool) -> None:
        tag = _tag(node)
        if node.outside and not (node.main and not inside):
            if tag in BLOCKS:
                flush(inside, lost)
            return
        begins = not inside and main(node)
        own = tag in BLOCKS or begins
        if own:
            flush(inside, lost)
        elif tag in SPACED:
            now.append(" ")
        here, less = inside or begins, lost or (own and gone(node))
        for x in node.items:
            if isinstance(x, Node):
                walk(x, here, less)
            else:
                now.append(x.text)
        if own:
            flush(here, less)
        elif tag in SPACED:
            now.append(" ")

    walk(page, False, False)
    flush(False, False)
    return out


def infer(pages: list[Node]) -> Wrapper:
    """The wrapper of a host from its different pages: ``wrappers`` on one machine."""
    found = [parts(p) for p in pages]
    stand = Counter(x for f in found for x in {(p.path, p.content) for p in f if p.block})
    paths = Counter(x for f in found for x in {p.path for p in f})
    template = {_hash(*x) for x, n in stand.items() if n >= TEMPLATE_PAGES and n >= TEMPLATE_SHARE * paths[x[0]]}
    total: Counter[tuple[int, int, int]] = Counter()
    for page, f in zip(pages, found, strict=True):
        if not _find_main(page):
            for path, depth, n in weights(f, template):
                total.update({(0, path, depth): n, (layout(page, template, f), path, depth): n})
    main = {}
    for key in {x[0] for x in total}:
        own = {x[1:]: n for x, n in total.items() if x[0] == key}
        big = [(depth, n, path) for (path, depth), n in own.items() if n >= MAIN_SHARE * max(own.values())]
        main[key] = max(big)[2]
    return Wrapper(template, main)


def read_page(page: Node, wrapper: Wrapper) -> str:
    """The main text: blocks in page order, one to a line."""
    found = parts(page)
    lost = {id(p.node) for p in found if mark(p) in wrapper.template}
    if _find_main(page):
        read = lines(page, lambda node: node.main, lambda node: id(node) in lost)
    else:
        here = wrapper.main.get(layout(page, wrapper.template, found), wrapper.main.get(0))
        at = {id(p.node) for p in found if p.path == here}
        read = lines(page, (lambda node: id(node) in at) if at else (lambda node: True), lambda node: id(node) in lost)
    kept = [text for text, less in read if not less]
    if sum(len(x) for x, _ in read) > 3 * sum(map(len, kept)):       # a copy of other pages, not a template
        kept = [text for text, _ in read]
    return "\n".join(kept)


def _find_main(node: Node, outside: bool = False) -> bool:
    outside = outside or (node.outside and not node.main)
    if node.main and not node.outside and not outside and _size(node):
        return True
    return any(_find_main(x, outside) for x in node.items if isinstance(x, Node))


def _size(node: Node) -> int:
    return sum(x.size if isinstance(x, Text) else (0 if x.outside else _size(x)) for x in node.items)


# ------------------------------------------------------------------ all hosts
def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host_key, copy, path, content) of every page's blocks, content 0 for the path alone, and
    path 0 for a page without a semantic main part."""
    for b in batches:
        rows: list[tuple[int, int, int, int]] = []
        for h, g, c in zip(*(b.column(i).to_pylist() for i in ("html", "host_key", "copy")), strict=True):
            page = parse(h)
            found = parts(page)
            rows.extend((g, c, path, content) for path, content in {(p.path, p.content) for p in found if p.block})
            rows.extend((g, c, path, 0) for path in {p.path for p in found if p.block})
            if not _find_main(page):
                rows.append((g, c, 0, 0))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                                             ["host_key", "copy", "path", "content"])
    tidy()


def _weight_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host_key, layout, path, depth, weight) of the pages without a semantic main part."""
    for b in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for h, g, t in zip(*(b.column(i).to_pylist() for i in ("html", "host_key", "template")), strict=True):
            page, template = parse(h), set(t or ())
            if not _find_main(page):
                found = parts(page)
                own = layout(page, template, found)
                rows.extend((g, key, path, depth, n) for path, depth, n in weights(found, template) for key in (0, own))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)],
                                             ["host_key", "layout", "path", "depth", "weight"])
    tidy()


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for h, t, m in zip(*(b.column(i).to_pylist() for i in ("html", "template", "main")), strict=True):
            texts.append(read_page(parse(h), Wrapper(set(t or ()), {x["layout"]: x["path"] for x in m or ()})))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                          pa.array(map(len, texts), pa.int64()), b.column("host")],
                                         ["page_id", "url", "text", "n_chars", "host"])
    tidy()


def wrappers(pages: DataFrame) -> DataFrame:
    """(host_key, template, main) of every host, from all its pages; ``pages``: html, host_key.

    Equal pages count once.  A path has few contents that stand on three in ten of its pages,
    and a host few layouts that hold one in a hundred, so a host's row is short.
    """
    rows = pages.where("html <> ''").select("html", "host_key", F.xxhash64("html").alias("copy"))
    seen = rows.mapInArrow(_part_rows, "host_key long, copy long, path long, content long")
    often = written(seen.groupBy("host_key", "path", "content").agg(F.countDistinct("copy").alias("n"))
                    .where((F.col("n") >= TEMPLATE_PAGES) | (F.col("path") == 0)), "parts")
    paths = often.where("content = 0").select("host_key", "path", F.col("n").alias("of"))
    block = often.where("content <> 0").join(paths, ["host_key", "path"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("of"))
    template = written(block.mapInArrow(_mark_rows, "host_key long, mark long").groupBy("host_key")
                       .agg(F.collect_set("mark").alias("template")), "template")
    open_ = often.where("path = 0").select("host_key").join(template, "host_key", "left")
    plain = pages.where("html <> ''").join(small(written(open_, "open"), 20_000), "host_key").select("html", "host_key", "template")
    held = plain.mapInArrow(_weight_rows, "host_key long, layout long, path long, depth long, weight long")
    total = written(held.groupBy("host_key", "layout", "path", "depth").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")), "weights")
    most = total.groupBy("host_key", "layout").agg(F.max("weight").alias("most"),
                                                      F.max(F.when(F.col("depth") == 0, F.col("n"))).alias("pages"))
    host = most.where("layout = 0").select("host_key", F.col("pages").alias("all_pages"))
    big = (total.join(most, ["host_key", "layout"]).join(host, "host_key")
           .where((F.col("weight") >= MAIN_SHARE * F.col("most")) & (F.col("pages") >= LAYOUT_SHARE * F.col("all_pages"))))
    main = (big.groupBy("host_key", "layout").agg(F.max(F.struct("depth", "weight", "path"))["path"].alias("path"))
            .groupBy("host_key").agg(F.collect_list(F.struct("layout", "path")).alias("main")))
    return template.join(main, "host_key", "full")


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = [_hash(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("host_key"), pa.array(marks, pa.int64())], ["host_key", "mark"])


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host: the main text of every page, one row per row.

    The wrapper of a host comes from all its pages; see ``wrappers``.  A null or empty page
    gives an empty text; pages without a host share one.  A host with one or two pages has no
    template blocks, and its pages are read by their elements alone.  Other columns of
    ``pages`` are not read; an empty table gives no rows.  Pages are read where they lie:
    wrappers are joined to them, as a broadcast where there are at most 20,000 hosts.
    """
    small_batches(pages.sparkSession)
    host = _host(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), F.xxhash64(host).alias("host_key"))
    found = written(wrappers(rows.select("html", "host_key")), "wrappers")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return (rows.join(small(found, 20_000), "host_key", "left").select("page_id", "url", "html", "host", "template", "main")
            .mapInArrow(_read_rows, f"page_id {kinds['page_id']}, url string, text string, n_chars long, host string"))
