"""Main text of web pages by a site style tree: same-host DOMs merge, and branches of low importance go."""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import Stage, arrow_map, broadcast_if_small

#: Pages (of different content) that a branch needs on a host before its entropies count, and composite importance below
#: which it goes. Content and presentation weigh alike.
LEAST_PAGES, LEAST_IMPORTANCE, CONTENT_WEIGHT = 8, 0.4, 0.5
#: What a branch has beforehand: in an article or main; by a class or id; in a menu; in another part that HTML sets apart
#: (footer, form); by what others wrote. All but the last are small enough that entropies settle either way: comments
#: can be as varied as articles.
MAIN_PRIOR, NAMED_PRIOR, MENU_PRIOR, FIXED_PRIOR, OTHERS_PRIOR = 0.3, -0.3, -0.2, -0.5, -0.8
#: Entropy of a branch on too few pages, and how much of its entropies a branch loses whose text is all in links.
UNKNOWN, LINK_WEIGHT = 0.5, 0.5
#: A form without an article beside it that has more than this share of a page's text wraps the page.
WRAPPING = 0.5

# HTML's elements by what they do to text, and names that mark parts around an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe".split())
#: Elements without text of the page; other elements can be inside, and an unclosed one ends with its parent.
EMPTY = frozenset("noscript template textarea iframe object svg math select button canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NOISE_TAGS = frozenset("head nav footer aside form dialog menu fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus respond related recommended "
    "share sharing social popup modal overlay login signup search toolbar masthead skip".split()
)
#: What others wrote or wrote elsewhere: an article in it isn't the page's.
OTHERS = frozenset("comment comments commentlist disqus respond related recommended widget widgets".split())
#: Parts of a name that only say which or where, as in site-footer and ad-slot; a name with any other part, as in
#: related-work, isn't a mark.
PLACES = frozenset(
    "site page main global primary secondary left right top bottom inner outer header head mobile desktop wp js google "
    "list section box area block wrap wrapper container body slot unit bar links link buttons button posts form panel item items row col group zone popup policy text".split()
)
#: Marks only outside an article: inside, a header holds its title.
OUTER_NAMES = frozenset("header head topbar top".split())
#: Unclosed elements without text that a block or one of their kind ends, as HTML has it; an article ends all of them.
UNCLOSED = frozenset("svg math select".split())
CLOSING = {"option": frozenset(), "button": frozenset(["button"]), "select": frozenset(["select"]), "article": EMPTY - {"noscript", "template"}, "main": EMPTY - {"noscript", "template"}}
#: Elements that a paragraph to be closed can't lie outside of, and that end an open head.
_HOLDERS = ("table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "blockquote")
_AFTER_HEAD = frozenset("body article main div p section nav footer h1 h2 table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARAGRAPH = ("p",)
_ENDED_BY = {tag: (*others, "p") for tag, others in CLOSED_BY.items()}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_ARTICLE = re.compile(r"<article\b|\brole\s*=\s*[\"']?article\b", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    """An open element: its branch in the style tree (a running hash), how its text is marked, whether it is part of an article."""

    __slots__ = ("branch", "children", "fixed", "main", "mark", "plain", "silent", "tag")

    def __init__(self, tag: str, branch: int, mark: int, fixed: bool, main: bool, silent: bool, children: list[int], plain: bool) -> None:
        self.tag, self.branch, self.mark, self.fixed, self.main, self.silent, self.children = tag, branch, mark, fixed, main, silent, children
        self.plain = plain  # not in a heading


class Block(NamedTuple):
    """A run of text: its branch, the branch it stands in, 1 in an article, how it is marked, its text, and how many
    characters of it are in links (none in a heading)."""

    branch: int
    parent: int
    main: bool
    mark: int
    text: str
    linked: int


#: Marks of a text, the stronger the higher: none, in a menu, by a name, by HTML (in a form: so that it can be told), by others.
CLEAR, MENU, NAMED, FORM, FIXED, OTHER = range(6)
PRIORS = (0.0, MENU_PRIOR, NAMED_PRIOR, FIXED_PRIOR, FIXED_PRIOR, OTHERS_PRIOR)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@lru_cache(1 << 14)
def _marked(name: str, names: frozenset[str]) -> bool:
    """Whether a class or id is one of the names, or consists of such, places and numbers (site-footer, ad-slot-2, but neither ad-free nor related-work)."""
    parts = _NAME.findall(name)
    return any(x in names for x in parts) and all(x in names or x in NOISE_NAMES or x in PLACES or x[:1].isdigit() for x in parts)


@lru_cache(1 << 15)
def _below(branch: int, tag: str, style: str) -> int:
    return _code(f"{branch}/{tag}.{'.'.join(sorted(_NAME.findall(style)))}")


def _child(parent: Node, tag: str, attributes: str, rescue: bool, forms: bool) -> Node:
    found: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(attributes) if attributes else ():
        found.setdefault(k.lower(), v.strip("\"'").lower())  # the first of a name counts
    names = f"{found.get('class', '')} {found.get('id', '')}".split() if found else ()
    role = found.get("role", "")
    whole = tag == "main" or role == "main" or found.get("itemprop") == "articlebody"
    own = whole or tag == "article" or role == "article"
    main = parent.main or own
    silent = parent.silent or "hidden" in found or found.get("aria-hidden") == "true" or tag == "head" or tag in EMPTY
    fixed = parent.fixed or silent or tag in ("nav", "footer")
    mark = CLEAR if (whole or (own and rescue)) and not parent.fixed else parent.mark
    if silent:
        mark = OTHER
    elif tag == "nav" or role in ("navigation", "menu", "menubar"):
        mark = max(mark, MENU)
    elif tag == "form" or role == "form":
        mark = max(mark, FORM) if forms else mark
    elif tag in NOISE_TAGS or (tag == "header" and not parent.main) or role in NOISE_ROLES:
        mark = max(mark, FIXED)
    if names and tag not in ("html", "body", "article", "main"):
        if any(_marked(x, OTHERS) for x in names):
            fixed, mark = True, OTHER
        elif any(_marked(x, NOISE_NAMES) or (not main and _marked(x, OUTER_NAMES)) for x in names):
            mark = max(mark, NAMED)
    plain = parent.plain and tag not in HEADINGS
    if tag not in BLOCKS:
        return Node(tag, parent.branch, mark, fixed, main, silent, parent.children, plain)
    branch = _below(parent.branch, tag, found.get("class", ""))
    parent.children.append(branch)
    return Node(tag, branch, mark, fixed, main, silent, [], plain)


class _Stack:
    """Open elements, with the positions of each tag and of blocks, so that no search walks the whole depth."""

    def __init__(self) -> None:
        self.nodes = [Node("", 0, CLEAR, False, False, False, [], True)]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> list[Node]:
        gone = self.nodes[to:]
        for n in gone:
            self.at[n.tag].pop()
        del self.nodes[to:]
        while self.blocks[-1] >= to:
            self.blocks.pop()
        return gone

    def first(self, tags: Iterable[str], after: int = 0) -> int:
        """The lowest position above ``after`` of one of the tags, or 0."""
        found = [p[i] for t in tags if (p := self.at.get(t)) and (i := bisect.bisect_right(p, after)) < len(p)]
        return min(found, default=0)

    def last(self, tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)


def page_blocks(page: str) -> list[tuple[int, bool, str]]:
    """(branch, whether in an article, text) of each block of a page that isn't marked as noise, in page order."""
    return [(b.branch, b.main, b.text) for b in page_tree(page)[0] if not b.mark]


def page_tree(page: str) -> tuple[list[Block], dict[int, int]]:
    """All blocks of a page in its order, marked ones too (not scripts, hidden parts and controls), and the shape of
    each branch: a hash of the block elements directly in it.

    A main element counts inside marked wrappers too, and so does an article if the page has none outside them. Without
    an article, a form that has most of a page's text is no mark: it wraps the page."""
    out = _tree(page, False, True)
    if any(b.main and not b.mark for b in out[0]):
        return out
    rescue = bool(_ARTICLE.search(page))
    if rescue:
        out = _tree(page, True, True)
    if not any(b.main and not b.mark for b in out[0]) and any(b.mark == FORM for b in out[0]):
        size = {True: 0, False: 0}
        for b in out[0]:
            if b.mark in (CLEAR, FORM):
                size[b.mark == FORM] += len(b.text) - b.linked
        if size[True] > WRAPPING * (size[True] + size[False]):
            out = _tree(page, rescue, False)
    return out


def _tree(page: str, rescue: bool, forms: bool) -> tuple[list[Block], dict[int, int]]:
    out: list[Block] = []
    shapes: dict[int, list[int]] = {}
    stack, at = _Stack(), 0
    parts: list[list[str]] = [[] for _ in PRIORS]  # text of the open block by its mark
    linked = [0] * len(PRIORS)  # characters of it in links
    last = page.rfind(">")  # no tag ends after it
    unended: set[str] = set()  # raw elements without an end tag in what is left

    def flush() -> None:
        for mark, run in enumerate(parts):
            if run:
                whole = "".join(run)
                run.clear()
                text = " ".join(entities.unescape(whole).split())
                if text:
                    i = stack.blocks[-1]
                    block, outer = stack.nodes[i], stack.nodes[stack.blocks[-2] if i else 0]
                    out.append(Block(block.branch, outer.branch, block.main, mark, text, len(text) * linked[mark] // len(whole)))
                linked[mark] = 0

    def say(text: str) -> None:
        n = stack.nodes[-1]
        if not n.silent:
            parts[n.mark].append(text)
            if n.plain and stack.at.get("a"):
                linked[n.mark] += len(text)

    def pop(to: int) -> None:
        if stack.blocks[-1] >= to:
            flush()
        for n in stack.cut(to):
            if n.tag in BLOCKS:
                shapes.setdefault(n.branch, []).extend([*n.children, 0])

    while True:
        m = _TAG.search(page, at) if at <= last else None
        if m is None and (c := page.find("<!--", at)) >= 0:
            say(page[at:c])  # an open comment takes the rest
            break
        say(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            continue
        if m.group(1) or m.group(4):
            if stack.at.get(tag):
                pop(stack.at[tag][-1])
            elif tag in BLOCKS:
                flush()
            continue
        attributes = m.group(3) or m.group(6) or ""
        if tag in RAW or tag in EMPTY:
            if attributes.rstrip().endswith("/") and tag in ("svg", "math", "iframe", "object"):
                continue
            say(" ")
        if tag in RAW:
            end = None if tag in unended else re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            if end is None:
                unended.add(tag)
            if end or tag in ("script", "style"):
                at = end.end() if end else len(page)
                continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                say(" ")
            continue
        ends = CLOSING.get(tag, UNCLOSED if tag in BLOCKS else frozenset())
        if stack.nodes[-1].fixed and (i := stack.first(ends)):
            pop(i)
        if tag in BLOCKS:
            if tag in _AFTER_HEAD and (i := stack.first(("head",))):
                pop(i)
            flush()
            ends = _ENDED_BY.get(tag, _PARAGRAPH)
            if any(stack.at.get(t) for t in ends) and (i := stack.first(ends, stack.last(_HOLDERS))):
                pop(i)
        stack.push(_child(stack.nodes[-1], tag, attributes, rescue, forms))
    flush()
    pop(1)
    root = stack.nodes[0]
    shapes[root.branch] = root.children
    return out, {b: _code(",".join(map(str, x))) for b, x in shapes.items()}


def _code(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 15)
def _node(branch: int, main: bool, mark: int) -> int:
    return _code(f"{branch} {main:d} {mark}")


def _branch(b: Block) -> int:
    """The style tree's node of a block: branches in and outside articles, and marked and clear ones, are judged apart."""
    return _node(b.branch, b.main, b.mark)


def prior(main: bool, mark: int) -> float:
    return MAIN_PRIOR if main and not mark else PRIORS[mark]


def importance(entropy: float, links: float, main: bool, mark: int) -> float:
    """Of a branch: its entropy, less what links take of it, and its prior."""
    return entropy * (1 - LINK_WEIGHT * links) + prior(main, mark)


def kept_alone(blocks: list[Block]) -> list[bool]:
    """Which blocks a page keeps without its host's other pages: branches have no entropy, but links and priors."""
    chars: dict[tuple, list[int]] = {}
    for b in blocks:
        own = chars.setdefault((b.branch, b.main, b.mark), [0, 0])
        own[0] += len(b.text)
        own[1] += b.linked
    stays = {(branch, main, mark): importance(UNKNOWN, linked / n, main, mark) >= LEAST_IMPORTANCE for (branch, main, mark), (n, linked) in chars.items()}
    return [stays[b.branch, b.main, b.mark] for b in blocks]


_OUTLINE = "page long, host string, content long, branch long, text long, main boolean, mark int, parent long, shape long, alone boolean, chars long, linked long"


def _outline(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of each page: the branches of its blocks with the codes of their texts, the branches they stand in and those's
    shapes, and whether the page alone keeps them."""
    for a in range(0, batch.num_rows, 256):
        part, out = batch.slice(a, 256), []
        for page, host, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            blocks, shapes = page_tree(text or "")
            content = _code(*[b.text for b in blocks if not b.mark])
            out += [
                (page, host, content, _branch(b), _code(b.text), b.main, b.mark, b.parent, shapes[b.parent], alone, len(b.text), b.linked)
                for b, alone in zip(blocks, kept_alone(blocks), strict=True)
            ]
        columns = list(zip(*out, strict=True)) or [[]] * 12
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        names = ["page", "host", "content", "branch", "text", "main", "mark", "parent", "shape", "alone", "chars", "linked"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _render(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, 256):
        part = batch.slice(a, 256)
        out = []
        for text, turned in zip(part.column("html").to_pylist(), part.column("turned").to_pylist(), strict=True):
            blocks, other = page_tree(text or "")[0], set(turned or ())
            kept = [b.text for b, alone in zip(blocks, kept_alone(blocks), strict=True) if alone != (bool(other) and _branch(b) in other)]
            out.append("\n".join(kept or [b.text for b in blocks if not b.mark]))
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def style_tree(outline: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, branch, mark, pages, content, presentation, importance) of the merged DOMs, from ``_OUTLINE`` rows.

    Pages of equal content count once. A text on k of a branch's m pages has content importance 1 - log k / log m; the
    branch has the mean over its texts. Presentation importance is the entropy, in base m, of what differs between the
    pages: the shape of the branch that it stands in, or the number of its own blocks, whichever is greater. The
    composite weighs the two, loses a part by the share of the branch's text that is in links, and adds the prior.
    Branches on fewer than ``least_pages`` pages are left out.
    """
    kept = [F.first(c).alias(c) for c in ("main", "mark")]
    per = outline.groupBy("host", "branch", "content", "text").agg(*kept, F.first("shape").alias("shape"), F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    sums = [F.sum(c).alias(c) for c in ("chars", "linked")]
    texts = per.groupBy("host", "branch", "text").agg(F.count(F.lit(1)).alias("k"), *kept, *sums)
    content = texts.groupBy("host", "branch").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("kl"), *kept, *sums)
    pages = per.groupBy("host", "branch", "content").agg(F.count(F.lit(1)).alias("blocks"), F.first("shape").alias("shape"))

    def entropy(by: str) -> DataFrame:
        counts = pages.groupBy("host", "branch", by).agg(F.count(F.lit(1)).alias("c"))
        found = counts.groupBy("host", "branch").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("cl")).where(F.col("m") >= max(2, least_pages))
        return found.select("host", "branch", "m", (1 - F.col("cl") / F.col("m") / F.log("m")).alias(by))

    joined = entropy("blocks").join(entropy("shape").drop("m"), ["host", "branch"]).join(content, ["host", "branch"])
    parts = joined.select(
        "host", "branch", "main", "mark", F.col("m").alias("pages"), (1 - F.col("kl") / F.col("n") / F.log("m")).alias("content"),
        F.greatest("blocks", "shape").alias("presentation"), (F.col("linked") / F.col("chars")).alias("links"),
    )
    before = F.when(F.col("main") & (F.col("mark") == CLEAR), MAIN_PRIOR).otherwise(F.get(F.array(*map(F.lit, PRIORS)), F.col("mark")))
    entropy_ = CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation")
    return parts.withColumn("importance", entropy_ * (1 - LINK_WEIGHT * F.col("links")) + before)


def extract_main_text(spark: SparkSession, pages: DataFrame, least_importance: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (blocks joined by line ends; "" if none).

    All blocks of a host's pages make its style tree, whose entropies, links and priors give each branch an importance;
    branches below ``least_importance`` go. A class or id that names an advert and so on lowers a branch's importance, and
    so does what HTML marks as menu, page header, footer, aside, form or dialog; an article or main raises it. Only
    reader comments, which vary as articles do, go whatever their entropies. Where a branch is on fewer than
    ``least_pages`` different pages, its links and prior alone decide. A page of which nothing is left keeps its unmarked blocks. Pages are parsed twice, so no text is stored on the way, and shuffled only
    if very many pages have a branch that the tree judges otherwise than its prior does.

    A null page is empty. A null URL is a host of its own. Broken markup is read as far as it goes: unclosed elements end
    with their parent, unclosed scripts and styles with the page. Time is linear in a page's length, whatever its depth.
    Null ids and repeated rows are kept. An empty table gives no rows. Other columns are ignored.
    """
    stage = Stage(spark, "html")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("page", F.xxhash64("url", "html"))
    outline = stage.cut(arrow_map(rows.select("page", host.alias("host"), "html"), _outline, _OUTLINE), "outline")
    judged = stage.cut(style_tree(outline, least_pages).select("host", "branch", (F.col("importance") >= least_importance).alias("stays")), "judged")
    own = outline.select("page", "host", "branch", "alone").distinct().join(judged, ["host", "branch"]).where("stays <> alone")
    on_page = own.groupBy("page").agg(F.collect_set("branch").alias("turned"))  # a page's own branches
    on_page = stage.cut(on_page, "turned-by-page")
    both = rows.join(broadcast_if_small(on_page, on_page.count(), 100_000), "page", "left")
    kind = rows.schema["page_id"].dataType.simpleString()
    out = arrow_map(both.select("page_id", "url", "html", "turned"), _render, f"page_id {kind}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")
