"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is read as a sequence of tokens: block-level elements, named by their path of
tags and classes, and blocks of text at their paths. The pages of a host are
compared: tokens whose occurrence vectors over the pages are equal form an
equivalence class. A class is valid if its members occur equally often on a page
and hang on elements of their own class or of one other class, in whose slot they
are nested; members that hang elsewhere are a class of their own. A block of text in
a list or a row of paragraphs hangs on what holds the list. The class that is on
every page is the outermost; a host with several kinds of pages has a class for each
kind inside it. Blocks of text whose class has elements belong to the template and
go, as do those on nearly all pages of the elements they lie in; a block that shares
the pages of an element of some other slot by chance stays. Article slots are
elements, once on a page, that hold most of the page's running text on most pages of
their class; a page takes the one of the most deeply nested class that it has, and of
one depth the innermost element. Elements that by tag or name are menus, adverts,
comments and the like go as well; an element whose name says article, post or content
does not.

Vectors are compared by sums of page hashes, aggregated before and after the
shuffle, so that a host of any size is a few hundred small rows: only tokens on a
sixteenth of a host's pages are gathered for it. Pages that differ in menus, adverts
and the like only are copies and count once. If template blocks make much of an article's slot, the pages
are near copies of one article and the slot stays whole. Pages meet their host's
template in a join whose large sides are split.

Defined results: null html counts as empty and gives an empty text; pages with a
null or odd url share one host; equal rows give equal rows; of slots of equal depth,
by class and by element, the first on the page counts; a page of any length or depth is read in time proportional
to it; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose text is no text, elements that are never article, void elements, elements that begin a block.
RAW = frozenset("script style noscript template iframe svg textarea select object math canvas".split())
NEVER = frozenset("nav footer aside form menu dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head title body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary menu dialog center button hgroup".split())
#: Elements that a new one of the same kind closes.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "p"}, "option": {"option"}}
#: Elements that a head may hold; any other begins the body. Elements that are no container of an article.
HEAD = frozenset("html head title base link meta script style noscript template".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr tbody thead blockquote pre address figcaption".split())
#: Names (of class, id or role) by which an element is no article: alone or with a part before or after it; alone or with a part before it that names the page; and names that say article.
_OTHER = re.compile(r"(?:[a-z0-9]+[_-])*(?:ads?|advert\w*|sponsor\w*|promos?|promotion|banner|cookies?|consent|popup|modal|sidebar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|replies|disqus|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|copyright|complementary|contentinfo)(?:[_-][a-z0-9]+)*", re.I)
_OTHER_ALONE = re.compile(r"(?:(?:site|page|main|top|global|cookie|legal|privacy)[_-])?(?:header|side|notices?|alert|reply|tags?|legal|disclaimer)", re.I)
_ARTICLE = re.compile(r"(?:h-)?(?:articles?|post|entry|story|blog|news|page|main)(?:[_-](?:content|body|text|main|article|post|entry))?|(?:content|body|text)(?:[_-](?:article|main|body))?", re.I)


def no_article(tag: str, names: str) -> bool:
    """Is an element of these names, which lies outside an article's own tag, no part of an article?"""
    if tag in ("article", "main", "html", "body") or tag in LEAF and tag not in ("ul", "ol", "dl"):
        return False
    parts = names.split()
    return any(_OTHER.fullmatch(x) or _OTHER_ALONE.fullmatch(x) for x in parts) and not any(_ARTICLE.fullmatch(x) for x in parts)


@dataclass
class Page:
    """Elements in page order: path (a hash of the parent's path and the own step), parent's place, depth, tag, whether it is no article; and blocks: (element, text, text inside links)."""

    path: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    other: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _hash(x: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(x)
    return h - 2**64 if h >= 2**63 else h


def read_page(source: str) -> Page:
    """One pass over the source; unclosed and misnested elements are closed where browsers would."""
    page, stack, at, n = Page(), [0], 0, len(source)
    text: list[str] = []
    linked, link_depth, open_ = 0, 0, Counter()

    def flush() -> None:
        nonlocal linked
        if text:
            body = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if body:
                page.blocks.append((stack[-1], body, linked))
            text.clear()
        linked = 0

    def close(names: set[str], barrier: frozenset[str] = frozenset()) -> None:
        if not any(open_[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if page.tag[stack[k]] in names:
                flush()
                for i in stack[k:]:
                    open_[page.tag[i]] -= 1
                del stack[k:]
                return
            if page.tag[stack[k]] in barrier:
                return

    while at < n:
        m = _TOKEN.search(source, at)
        piece = source[at : m.start()] if m else source[at:]
        if piece:
            text.append(piece)
            linked += len(piece) if link_depth else 0
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                link_depth = 0
            elif tag in BLOCK:
                close({tag})
            elif tag in ("td", "th"):
                text.append(" ")
            continue
        if tag in RAW and not m.group(3).rstrip().endswith("/"):
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "a":
            link_depth = 1
        elif tag in ("td", "th"):
            text.append(" ")
        elif tag in BLOCK:
            flush()
            if open_["head"] and tag not in HEAD:
                close({"head"})
            if tag in CLOSES:
                close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table")) if tag != "p" else frozenset())
            elif page.tag[stack[-1]] == "p":
                close({"p"})
            named = " ".join(a or b or c for a, b, c in _NAMED.findall(m.group(3))).strip().lower() if tag not in ("html", "body") else ""
            up = stack[-1]
            other = page.other[up] or tag in NEVER or tag in ("head", "title") or (tag == "header" and not open_["article"] and not open_["main"]) or bool(named and no_article(tag, named))
            step = f"{tag}.{_SPACE.sub('.', _DIGITS.sub('#', named))}" if named else tag
            stack.append(len(page.path))
            page.path.append(_hash(f"{page.path[up]}/{step}"))
            page.parent.append(up)
            page.depth.append(page.depth[up] + 1)
            page.tag.append(tag)
            page.other.append(other)
            open_[tag] += 1
    flush()
    return page


_DIGITS = re.compile(r"[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>?", re.I) for tag in RAW}


def host_of(column: str = "url"):
    """Lower-cased host of a url; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def mark(path: int, text: str) -> int:
    """A hash of a block of text at its place."""
    return _hash(f"{path}\0{text}")


#: Least share of a page's running text that the article's element holds, and of its pages on which it does.
HOLDS, USUAL = 0.7, 0.6


def held(page: Page) -> list[bool]:
    """Whether each element holds most of the page's running text, links counted against it."""
    own = [0] * len(page.path)
    for i, text, linked in page.blocks:
        if not page.other[i]:
            own[i] += max(0, len(text) - 2 * linked)
    for i in range(len(own) - 1, 0, -1):
        own[page.parent[i]] += own[i]
    return [bool(own[0]) and x >= HOLDS * own[0] for x in own]


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, page, path, mark, parent, leaf, n, held: elements, and blocks with a mark. Path and mark 0 stand for the page, which its blocks name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                out: list[tuple] = []
                for host, source in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                    page = read_page(source)
                    holds, times = held(page), Counter(page.path)
                    key = _hash("\n".join(t for i, t, _ in page.blocks if not page.other[i]))
                    seen = set()
                    for i, p in enumerate(page.path):
                        if p not in seen:
                            seen.add(p)
                            out.append((host, key, p, 0, page.path[page.parent[i]] if i else 0, page.tag[i] in LEAF, times[p], holds[i]))
                    for i, t in {(page.path[x[0]], x[1]) for x in page.blocks if not page.other[x[0]]}:
                        out.append((host, key, i, mark(i, t) or 1, 0, True, 1, False))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], ["host", "page", "path", "mark", "parent", "leaf", "n", "held"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, page long, path long, mark long, parent long, leaf boolean, n int, held boolean")
    return rows.groupBy("host", "page", "path", "mark").agg(F.max("parent").alias("parent"), F.max("leaf").alias("leaf"), F.max("n").alias("n"), F.max("held").alias("held"))


#: Least share of the pages of its elements that a template block is on; least pages that tell a template from chance; a token's least share of a host's pages, as one in so many.
SHARE, EVIDENCE, RARE = 0.8, 3, 16
#: Bytes of templates up to which they are sent to all tasks; beyond, pages and templates are shuffled by host.
SENT = 32_000_000


@dataclass
class Class:
    """Tokens of one occurrence vector (elements by path, blocks by path and mark), and the class in whose slot they lie: its vector, its place in the list, and how many classes lie around."""

    vector: tuple[int, int]
    paths: list[int]
    inside: tuple[int, int] | None
    blocks: list[tuple[int, int]] = field(default_factory=list)
    outer: int | None = None
    level: int = 0


def nested_classes(elements: dict[int, tuple], blocks: list[tuple] = ()) -> list[Class]:
    """Valid classes of elements (path: parent, pages, vector, n) and blocks (path, mark, pages, vector): equal vectors, equal counts, one class around them."""
    classes: list[Class] = []
    number: dict[tuple, int] = {}
    of: dict[int, int] = {}

    def join(up: int, vector: tuple[int, int], n: int) -> int:
        # what holds a token holds its pages; a token whose parent is of another vector lies in that class's slot
        outer = of.get(up)
        if outer is not None and classes[outer].vector == vector:
            outer = classes[outer].outer
        c = number.setdefault((vector, n, outer), len(classes))
        if c == len(classes):
            around = None if outer is None else classes[outer]
            classes.append(Class(vector, [], around and around.vector, outer=outer, level=around.level + 1 if around else 0))
        return c

    for p in elements:
        line: dict[int, None] = {}
        while p in elements and p not in of and p not in line:
            line[p] = None
            p = elements[p][0]
        for q in reversed(line):
            parent, pages, vector, n = elements[q]
            of[q] = join(parent, (pages, vector), n)
            classes[of[q]].paths.append(q)
    once: dict[int, int] = {}
    for path, mark_, pages, vector in blocks:
        if path not in once:  # the innermost element around it that no page repeats
            p, seen = path, set()
            while p in elements and elements[p][3] > 1 and p not in seen and p not in once:
                seen.add(p)
                p = elements[p][0]
            once.update(dict.fromkeys([*seen, path], once.get(p, p)))
        classes[join(once[path], (pages, vector), 1)].blocks.append((path, mark_))
    return classes


def deduce(rows: list[tuple]) -> tuple[dict[int, int], list[int]]:
    """Paths of articles' elements with the depth of their class, and marks of template blocks, from (path, mark, parent, leaf, pages, vector, n, held) of one host."""
    facts = {r[0]: r for r in rows if r[1] == 0}
    pages = {r[1]: r[4] for r in rows if r[1] != 0}
    classes = nested_classes({p: (r[2], r[4], r[5], r[6]) for p, r in facts.items()}, [(r[0], r[1], r[4], r[5]) for r in rows if r[1] != 0 and r[4] >= EVIDENCE])
    # slots: in each class, elements that are once on its pages and hold most of their text on most of them
    mains = {p: c.level for c in classes for p in c.paths if p and facts[p][6] == 1 and not facts[p][3] and facts[p][7] >= USUAL * c.vector[0]}
    # blocks with elements of their own class, or alone on most pages of the element they are nested in
    constant = {m for c in classes for p, m in c.blocks if c.paths or p in facts and pages[m] >= SHARE * facts[p][4]}
    return mains, sorted(constant)


def templates(pages: DataFrame) -> DataFrame:
    """host, mains, levels, constant for every host of pages (host, html) that has more than one different page."""
    tokens = page_tokens(pages)
    mix = F.pmod(F.xxhash64("page", F.lit(1)), F.lit(2**31))
    summed = tokens.groupBy("host", "path", "mark").agg(
        F.max("parent").alias("parent"), F.max("leaf").alias("leaf"), F.count("*").alias("pages"), F.sum(mix * F.col("n")).alias("vector"), F.max("n").alias("n"), F.sum(F.col("held").cast("long")).alias("held")
    )
    # a token can only count on this many pages; the others stay before anything is dealt by host
    summed = summed.where(F.col("pages") >= F.when(F.col("mark") == 0, 2).otherwise(EVIDENCE))
    total = summed.where("path = 0 and mark = 0").select("host", F.col("pages").alias("every"))
    often = summed.join(total, "host").where(F.col("pages") * RARE >= F.col("every"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        mains, constant = deduce(list(zip(*(table[c].to_pylist() for c in ("path", "mark", "parent", "leaf", "pages", "vector", "n", "held")), strict=True)))
        at = sorted(mains)
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "mains": pa.array([at], pa.list_(pa.int64())), "levels": pa.array([[mains[p] for p in at]], pa.list_(pa.int32())), "constant": pa.array([constant], pa.list_(pa.int64()))})

    # at most sixteen times as many tokens as an average page has, whatever the host's size
    return often.groupBy("host").applyInArrow(run, "host string, mains array<long>, levels array<int>, constant array<long>")


#: Share of an article's slot above which template blocks are taken for those of near copies, if they are most of its blocks too.
COPIES = 0.4


def main_text(source: str, mains: dict[int, int], constant: frozenset[int]) -> str:
    """Blocks of the article's slot (mains: path, depth of its class); pages without one fall back on their own article or main, or on all blocks."""
    page = read_page(source)
    times = Counter(page.path)
    slot = max((i for i in range(1, len(page.path)) if page.path[i] in mains and times[page.path[i]] == 1 and not page.other[i]), key=lambda i: (mains[page.path[i]], page.depth[i], -i), default=0)
    if not slot:
        slot = next((i for i in range(1, len(page.path)) if page.tag[i] in ("article", "main") and not page.other[i]), 0)
    inside = [slot == 0] + [False] * (len(page.path) - 1)
    for i in range(1, len(inside)):
        inside[i] = i == slot or inside[page.parent[i]]
    good = [(page.path[i], t, inside[i]) for i, t, _ in page.blocks if not page.other[i]]
    chosen = [(p, t) for p, t, own in good if own] or [(p, t) for p, t, _ in good]
    kept = [t for p, t in chosen if not constant or (mark(p, t) or 1) not in constant]
    whole = sum(len(t) for _, t in chosen)
    copies = 2 * len(kept) < len(chosen) and sum(map(len, kept)) < (1 - COPIES) * whole if slot else not kept
    return "\n".join([t for _, t in chosen] if copies else kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), host_of().alias("host"))
    found = cut(templates(rows.select("host", "html")))
    size = found.agg(F.sum(F.length("host") + 12 * F.size("mains") + 8 * F.size("constant") + 32)).first()[0] or 0
    # pages stay where they are while all hosts' templates are small enough to be sent to them
    joined = rows.join(F.broadcast(found) if size <= SENT else found, "host", "left").select("page_id", "url", "html", "mains", "levels", "constant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                out = [main_text(s, dict(zip(m or (), d or (), strict=True)), frozenset(c or ())) for s, m, d, c in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
