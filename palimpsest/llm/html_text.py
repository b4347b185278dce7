"""Main text of web pages: site templates are removed, then the article's blocks are written out.

1. A page is parsed into elements. Elements that are never main text go by their tag, role or a whole class
   name (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, comments). Class names
   say nothing about an inline element inside a paragraph, a heading or an item.
2. The main part is the page's articles, unless the main element holds more text outside of them; without articles the
   main elements, without any the whole page. An element that is unwanted by its role or class but holds the only
   article (or main) is entered.
3. Every block is hashed from its tag, its own text and the hashes of its children. Spark
   counts for each host on how many pages with different text a subtree recurs. A subtree that recurs on
   at least LEAST_PAGES such pages and on SHARE of them belongs to the site. It is deleted from all
   pages of that host where only such subtrees stand before it or after it, or where most of its text is links.
   A single heading, item, cell or inline element is no such subtree, nor is a paragraph inside an article, so
   what recurs between a page's own blocks stays.

Counting is a two-step aggregation with partial sums, so a host with a third of all pages is no
single task. Templates go to the pages by broadcast if there are at most MAX_BROADCAST of them, and
otherwise in a join whose hosts are dealt over SALTS keys. The result is the same.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import released, staged

LEAST_PAGES, SHARE = 5, 0.5
MAX_BROADCAST, SALTS = 100_000, 64

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("article aside body div footer header main nav section table td th ul ol dl blockquote form".split())
DROPPED = frozenset("nav footer aside form head script style textarea title iframe noembed noframes noscript template button select svg canvas dialog menu search object".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
# Whole class names and ids of what is never main text; of containers only; of reader comments.
JUNK = frozenset(
    "ad ads ad-box ad-slot ad-container ad-banner advert adverts advertisement advertising sponsor sponsored promo cookie cookies cookie-banner cookie-notice cookie-consent "
    "cookie-bar consent consent-banner gdpr notice notices site-notice notification notifications alert popup modal overlay sidebar side-bar navbar breadcrumb breadcrumbs "
    "site-header page-header site-footer page-footer site-nav main-nav main-menu site-menu nav-menu top-bar newsletter newsletter-signup newsletter-form subscribe subscribe-box "
    "share-buttons share-bar social-share social-links social-media related-posts related-articles related-links recommended recommendations pagination pager login-form search-form skip-link".split()
)
CONTAINER_JUNK = frozenset("nav menu navigation header footer masthead banner share sharing social related login search".split())
COMMENTS = frozenset("comment comments comment-list comment-section comment-form comments-area comments-section commentlist user-comments reader-comments disqus disqus_thread replies responses".split())
CONTAINERS = frozenset("div section aside nav header footer ul ol dl table form td".split())
ROOTS = frozenset(["html", "body", "main", "article"])
#: Blocks of running text: class names of inline elements inside them say nothing.
FLOW = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th blockquote figcaption caption pre summary address".split())
#: Subtrees that can be a site's: containers, and outside of articles paragraphs.
SITE_TAGS = frozenset("aside div dl details fieldset figure footer form header hgroup hr menu nav ol section table ul address center dir".split())
#: Share of a subtree's text that is links, from which it is one for finding the way.
LINKS = 0.5
# Whole class names of articles that only point to others.
TEASERS = frozenset("teaser teasers card preview related related-article promo sponsored ad advert".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: A tag that ends itself; a slash that belongs to an unquoted value doesn't.
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


WANTED, BY_NAME, NEVER = 0, 1, 2


class Element:
    """An element; parts are its texts and elements in page order.

    junk: WANTED; BY_NAME (unwanted by role or class, unless the only article is inside); NEVER. flow: inside running text.
    size, linked: characters of text below it, and of those inside links; set with the digest.
    """

    __slots__ = ("tag", "junk", "parts", "digest", "flow", "size", "linked")

    def __init__(self, tag: str, junk: int, flow: bool = False):
        self.tag, self.junk, self.parts, self.digest, self.flow, self.size, self.linked = tag, junk, [], None, flow, 0, 0


def junk_of(tag: str, attributes: str, in_article: bool, in_flow: bool = False) -> int:
    """Whether an element is never main text, by its tag, role, class or id. in_flow: it stands inside running text."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return NEVER
    if not attributes.strip():
        return WANTED
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = {*found.get("class", "").lower().split(), found.get("id", "").lower().strip()}
    if tag in ROOTS:
        return NEVER if tag == "article" and names & COMMENTS else BY_NAME if tag == "article" and names & TEASERS else WANTED
    if in_flow and tag not in BLOCK:
        return NEVER if "hidden" in found or found.get("aria-hidden", "").lower() == "true" else WANTED
    if names & COMMENTS or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return NEVER
    if found.get("role", "").lower() in DROPPED_ROLES or names & JUNK or (tag in CONTAINERS and not (in_article and tag == "div" and "header" in names) and names & CONTAINER_JUNK):
        return BY_NAME
    return WANTED


class _Stack:
    """Open elements, with the places of each tag and of those that hold others, so that no end tag searches the stack."""

    def __init__(self, root: Element):
        self.open = [root]
        self.places: dict[str, list[int]] = {}
        self.holders: list[int] = [0]
        self.tables: list[int] = [0]  # holders other than table cells

    def push(self, one: Element) -> None:
        k = len(self.open)
        self.open.append(one)
        self.places.setdefault(one.tag, []).append(k)
        if one.tag in HOLDS:
            self.holders.append(k)
            if one.tag not in ("td", "th"):
                self.tables.append(k)

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, -1 for none."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    def cut(self, k: int) -> None:
        """End the elements from place k on."""
        while len(self.open) > k:
            self.places[self.open.pop().tag].pop()
        while self.holders[-1] >= k:
            self.holders.pop()
        while self.tables[-1] >= k:
            self.tables.pop()


def parse(html: str) -> Element:
    """The page as a tree, in time linear in the page. Open elements end with their parent; end tags without a start are ignored."""
    root = Element("#page", WANTED)
    stack, at = _Stack(root), 0
    while True:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            stack.open[-1].parts.append(unescape(text))
        if not m:
            return root
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            k = stack.last(tag)
            # An end tag of a plain element doesn't reach over an element that holds others.
            if k > 0 and (tag in HOLDS or tag in ROOTS or k > stack.holders[-1]):
                stack.cut(k)
            continue
        attributes = m[3] or m[6] or ""
        if tag in BLOCK and (k := stack.last("p")) > stack.holders[-1]:  # a paragraph ends where a block begins
            stack.cut(k)
        if tag in CLOSES and (k := max(map(stack.last, CLOSES[tag]))) > stack.tables[-1]:
            stack.cut(k)
        flow = stack.open[-1].flow
        one = Element(tag, junk_of(tag, attributes, bool(stack.places.get("article")), flow), tag in FLOW if tag in BLOCK else flow)
        stack.open[-1].parts.append(one)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not CLOSED.search(attributes):
            stack.push(one)


def main_parts(root: Element) -> list[Element]:
    """The outermost articles, else the main elements, else the whole page; the main elements also where most of their text is outside of articles."""
    for most in (WANTED, BY_NAME):
        if found := outermost(root, "article", most):
            mains = outermost(root, "main", most)
            inside = {id(p) for m in mains for p in outermost(m, "article", most)}
            held = sum(len(written([p])) for p in found if id(p) in inside)
            return found if not inside or 2 * held >= sum(len(written([m])) for m in mains) else mains
        if written(outermost(root, "main", WANTED)):
            break
    for most in (WANTED, BY_NAME):
        if found := outermost(root, "main", most):
            return found
    return [root]


def outermost(root: Element, tag: str, most: int) -> list[Element]:
    """The outermost elements of a tag, in page order, outside of elements that are more unwanted than `most`."""
    found, todo = [], [root]
    while todo:
        one = todo.pop()
        if one.tag == tag:
            found.append(one)
        else:
            todo += [p for p in reversed(one.parts) if isinstance(p, Element) and p.junk <= most]
    return found


def hashed(root: Element) -> list[int]:
    """Sets digest, size and linked of every wanted element; gives the digests of the subtrees that can be a site's: they have text and hold no article."""
    out: list[int] = []
    holding: set[int] = set()  # articles, and elements with one inside
    todo = [(root, False, root.tag == "article")]
    while todo:
        one, done, in_article = todo.pop()
        children = [p for p in one.parts if isinstance(p, Element) and not p.junk]
        if not done:
            todo.append((one, True, in_article))
            todo += [(p, False, in_article or one.tag == "article") for p in children]
            continue
        h = blake2b(one.tag.encode(), digest_size=8)
        size = linked = 0
        for p in one.parts:
            if isinstance(p, str):
                if words := " ".join(p.split()):
                    h.update(b"\0" + words.encode("utf-8", "surrogatepass"))
                    size += len(words)
            elif not p.junk:
                h.update(b"\1" + p.digest.to_bytes(8, "little", signed=True))
                size, linked = size + p.size, linked + p.linked
        one.digest, one.size, one.linked = int.from_bytes(h.digest(), "little", signed=True), size, size if one.tag == "a" else linked
        if one.tag == "article" or not holding.isdisjoint(map(id, children)):
            holding.add(id(one))
        elif size and (one.tag in SITE_TAGS or (one.tag == "p" and not in_article)):
            out.append(one.digest)
    return out


def written(mains: list[Element], template: frozenset = frozenset()) -> str:
    """Blocks in page order, white space in a block as one space, joined by line ends.

    Blocks in subtrees of the template go before the first and after the last other block, and everywhere if the subtree is mostly links.
    """
    blocks: list[tuple[str, bool]] = []
    run: list[str] = []
    inside = 0  # open subtrees of the template

    def end():
        if block := " ".join("".join(run).split()):
            blocks.append((block, inside > 0))
        run.clear()

    todo: list = [(m, m.tag == "article") for m in reversed(mains)]
    while todo:
        one, in_article = todo.pop()
        if one is None:
            end()
            inside -= in_article
        elif isinstance(one, str):
            run.append(one)
        elif not one.junk or one in mains:
            if one.tag == "br":
                run.append(" ")
                continue
            block = one.tag in BLOCK or one.tag == "#page"
            if block:
                end()
                site = one.digest in template and one.size > 0 and (one.tag in SITE_TAGS or (one.tag == "p" and not in_article))
                if site and one.linked >= LINKS * one.size:
                    continue
                inside += site
                todo.append((None, site))
            todo += [(p, in_article or one.tag == "article") for p in reversed(one.parts)]
    end()
    own = [k for k, (_, site) in enumerate(blocks) if not site]
    return "\n".join(b for b, _ in blocks[own[0] : own[-1] + 1]) if own else ""


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def templates(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, digest) of the subtrees that are a host's template."""

    @F.arrow_udf("struct<main:bigint,subtrees:array<bigint>>")
    def subtrees(pages: pa.Array) -> pa.Array:
        mains, lists = [], []
        for page in pages:
            root = parse(page.as_py() or "")
            lists.append(list(dict.fromkeys(hashed(root))))
            whole = written(main_parts(root)).encode("utf-8", "surrogatepass")
            mains.append(int.from_bytes(blake2b(whole, digest_size=8).digest(), "little", signed=True))
        return pa.StructArray.from_arrays([pa.array(mains, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["main", "subtrees"])

    pages = df.select(_host(F.col(f"`{url}`")).alias("host"), subtrees(F.col(f"`{html}`")).alias("s")).select("host", "s.*")
    # Pages of equal text count once, so that copies of one text don't make its paragraphs a template.
    pages = staged(pages.dropDuplicates(["host", "main"]), "subtrees")
    totals = pages.groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    counts = pages.select("host", F.explode("subtrees").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    return counts.join(totals, "host").where(F.col("n") >= SHARE * F.col("n_pages")).select("host", "digest")


def main_text(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with text and n_chars: the main text of each whole page.

    A null page counts as empty and has the text ''. A null url, or one without a host, belongs to
    the host ''. Rows repeat as they come; columns called text or n_chars are replaced.
    """
    found = staged(templates(df, url, html), "templates")
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in ("text", "n_chars")]
    lists = found.groupBy("host").agg(F.collect_list("digest").alias("digests"))
    pages = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), _host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("page"))
    if found.count() <= MAX_BROADCAST:
        pages = pages.join(F.broadcast(lists), "host", "left")
    else:
        salted = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        pages = pages.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    @F.arrow_udf("string")
    def text_of(html: pa.Array, digests: pa.Array) -> pa.Array:
        out = []
        for page, own in zip(html, digests, strict=True):
            root = parse(page.as_py() or "")
            parts = main_parts(root)
            template = frozenset(own.as_py() or ())
            if template:
                hashed(root)
            out.append(written(parts, template))
        released()
        return pa.array(out, pa.string())

    made = pages.select("row", text_of("page", "digests").alias("text"))
    return made.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), "text", F.char_length("text").cast("long").alias("n_chars"))
