"""Main text of web pages by a site style tree.

Every page is parsed into blocks, each with its branch: the path of tags and presentation (class and id) from the body.
The pages of a host are merged into one tree of branches.  A node of it has a content importance, the entropy of its
texts over the pages that have it, and a presentation importance, the entropy of the child sequences it is shown with,
both divided by the logarithm of the number of pages.  What says the same on all pages is boilerplate: branches whose
importance is low are removed from each page of the host.

Statistics cannot judge a branch with few pages, nor boilerplate that varies, so elements whose role says that they are
no content (navigation, forms, scripts, adverts, comments and the like) are removed on every page.  A class or id says
so only as a whole: `sidebar` or `ad-banner`, not `with-sidebar` or `related-work`.  An article or main element is not
removed for the name of what it stands in, except an article in another article.

Everything else is judged, inside article elements and outside.  An article element is evidence of what a page is about:
articles may be copied, so pages whose text stands mostly in articles vote once for each distinct article text, and
copies lower no importance.  A branch that nothing judges low is kept, on pages with an article too.

Scale: pages are parsed where they are read.  Statistics are counts by (host, branch, text hash) that combine before
the shuffle, so a host with a third of all pages is no hot spot.  Verdicts, a few branches a host, are broadcast up to
VERDICTS rows; beyond that they are joined by host.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from inspectlake.llm.common import column, map_arrow

#: A branch is judged from so many different pages on, and removed where its importance is below LEAST.
PAGES = 3
LEAST = 0.3
VERDICTS = 200_000

#: Elements by their role.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rb", "rt", "rp", "nobr",
)
DROPPED = (
    "head", "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas", "nav", "header", "footer", "aside", "form", "button",
    "select", "option", "input", "textarea", "dialog", "menu", "noembed", "noframes", "title",
)
DROPPED_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar")
DROPPED_NAMES = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
    "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "sidebar",
    "aside", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "comment",
    "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "toolbar", "skip", "login", "search",
)
#: Words that say nothing on their own beside the words of DROPPED_NAMES.
NEUTRAL_NAMES = ("area", "bar", "block", "box", "container", "inner", "item", "items", "link", "links", "list", "outer", "site", "wrap", "wrapper")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that an opening tag of these kinds ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|([!?])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_KNOWN = frozenset(DROPPED_NAMES + NEUTRAL_NAMES)


@dataclass(slots=True)
class Node:
    tag: str
    branch: str
    dropped: bool  # by its role
    named: bool  # by its name
    article: bool  # in an article or main element
    inside: bool  # in an article element
    children: list[str] = field(default_factory=list)

    @property
    def gone(self) -> bool:
        return self.dropped or self.named


@dataclass(slots=True)
class Block:
    branches: tuple[str, ...]
    text: str
    article: bool


def _says_dropped(name: str) -> bool:
    """Whether all words of a class or id are names of what is no content, but for neutral ones."""
    words = {w.lower() for w in _NAMES.findall(_CAMEL.sub("-", name))}
    return not words.isdisjoint(DROPPED_NAMES) and words <= _KNOWN


def _opened(tag: str, attributes: str, parent: Node) -> Node:
    if parent.dropped:
        return Node(tag, f"{parent.branch}/{tag}", True, parent.named, parent.article, parent.inside)
    style, dropped, named, seen = tag, tag in DROPPED, parent.named, set()
    if tag == "main" or tag == "article" and not parent.inside:
        named = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in seen:
            continue
        seen.add(key)
        if key == "role":
            dropped = dropped or value.lower() in DROPPED_ROLES
        elif key == "hidden":
            dropped = True
        elif key == "class" or key == "id":
            style += f".{value}" if key == "class" else f"#{value}"
            # The id of a heading repeats its text.
            if tag not in ("body", "html", "article", "main") and not (key == "id" and tag in HEADINGS):
                named = named or any(map(_says_dropped, value.split()))
    # Numbers in class names and ids tell pages apart, not branches.
    branch = f"{parent.branch}/{re.sub(r'[0-9]+', '0', style)}"
    return Node(tag, branch, dropped, named, parent.article or tag in ("article", "main"), parent.inside or tag == "article")


def parse(source: str) -> tuple[list[Block], dict[str, tuple[str, ...]]]:
    """Blocks of a page outside dropped elements, and by branch the child sequence it is shown with."""
    root = Node("", "", False, False, False, False)
    stack, blocks, shown = [root], [], {}
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                top = stack[-1]
                blocks.append(Block(tuple(n.branch for n in stack[1:] if n.tag not in INLINE), text, top.article))

    def close(at: int) -> None:
        end_block()
        for node in stack[at:]:
            shown[node.branch] = tuple(node.children)
        del stack[at:]

    place = 0
    while place < len(source):
        m = _TAG.search(source, place)
        stop = m.start() if m else len(source)
        if stop > place and not stack[-1].gone:
            parts.append(source[place:stop])
        if not m:
            break
        place = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag == "br" or tag == "wbr":
            if tag == "br" and not stack[-1].gone:
                parts.append("\n")
        elif m[2]:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if tag in INLINE:
                # Wrongly nested inline elements end nothing but themselves.
                if at and all(n.tag in INLINE for n in stack[at:]):
                    for node in stack[at:]:
                        shown[node.branch] = tuple(node.children)
                    del stack[at:]
            elif at:
                close(at)
            elif tag == "p":
                end_block()
        else:
            if tag in INLINE:
                if tag not in VOID and not m[4].endswith("/"):
                    stack.append(_opened(tag, m[4], stack[-1]))
                continue
            end_block()
            if tag in _ENDS_P and (at := next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"), 0)):
                if all(n.tag in INLINE or n.tag == "p" for n in stack[at:]):
                    close(at)
            if tag in CLOSES and (at := next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in CLOSES[tag]), 0)):
                if not any(n.tag in ("ul", "ol", "dl", "table", "select") for n in stack[at:]):
                    close(at)
            if tag == "body" and (at := next((k for k in range(1, len(stack)) if stack[k].tag == "head"), 0)):
                close(at)
            if tag in VOID:
                continue
            node = _opened(tag, m[4], stack[-1])
            stack[-1].children.append(node.branch.rsplit("/", 1)[1])
            stack.append(node)
            if tag in RAW:
                end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, place)
                if not node.gone:
                    parts.append(source[place : end.start() if end else len(source)])
                place = end.end() if end else len(source)
                close(len(stack) - 1)
    close(1)
    return blocks, shown


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def subject(blocks: list[Block], source: str) -> str:
    """What makes a page a page of its own: its article text where that is at least half of its text, else its source."""
    articles = [b.text for b in blocks if b.article]
    return "\n".join(articles) if articles and 2 * sum(map(len, articles)) >= sum(len(b.text) for b in blocks) else source


def _votes(batch: pa.RecordBatch) -> dict:
    """For each branch of a page: hashes of what its page is about, its texts and its child sequence."""
    out: dict[str, list] = {k: [] for k in ("host", "branch", "page", "content", "shown")}
    for host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
        blocks, shown = parse(source or "")
        texts: dict[str, list[str]] = {}
        for block in blocks:
            for branch in dict.fromkeys(block.branches):
                texts.setdefault(branch, []).append(block.text)
        page = _hash(subject(blocks, source or ""))
        for branch, said in texts.items():
            for k, value in zip(out, (host, branch, page, _hash("\n".join(said)), _hash(" ".join(shown.get(branch, ()))))):
                out[k].append(value)
    return out


def verdicts(pages: DataFrame) -> DataFrame:
    """(host, branch) of branches of low importance; equal pages of a host, and pages of equal articles, count once.

    The importance of a node is its content entropy where texts differ at all; a node shown in as many ways as it has
    pages keeps at least half of its presentation entropy.
    """
    seen = map_arrow(pages, "host string, branch string, page long, content long, shown long", _votes)
    # One aggregate for both entropies: Spark parses and shuffles once.
    seen = seen.groupBy("host", "branch", "page").agg(F.min(F.struct("content", "shown")).alias("v")).select("host", "branch", "v.*")

    def entropy(what: str) -> DataFrame:
        counts = seen.groupBy("host", "branch", what).agg(F.count("*").alias("n"))
        total = counts.groupBy("host", "branch").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        # -sum p log p with p = n / m, over log m.
        return total.where(F.col("m") >= PAGES).select("host", "branch", ((F.log("m") - F.col("s") / F.col("m")) / F.log("m")).alias(f"{what}_importance"))

    both = entropy("content").join(entropy("shown"), ["host", "branch"])
    return both.where(F.greatest("content_importance", F.col("shown_importance") / 2) < LEAST).select("host", "branch")


def main_text(source: str, low: set[str]) -> str:
    blocks, _ = parse(source)
    return "\n\n".join(b.text for b in blocks if low.isdisjoint(b.branches))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    Null and empty html, and pages without content, give the empty text.  Pages with a null url share a host of their
    own.  A block is what stands between block-level tags; repeated rows give a row each.
    """
    own = pages.select(*[column(pages, c).alias(c) for c in ("page_id", "url", "html")])
    own = own.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    low = verdicts(own.select("host", "html"))
    few = low.limit(VERDICTS + 1).toPandas()
    schema = "page_id long, url string, text string, n_chars long"
    if len(few) <= VERDICTS:
        table: dict[str, set[str]] = {}
        for host, branch in zip(few["host"], few["branch"]):
            table.setdefault(host, set()).add(branch)
        shared = pages.sparkSession.sparkContext.broadcast(table)
        rows, lows = own, lambda batch: [shared.value.get(h, set()) for h in batch["host"].to_pylist()]
    else:
        by_host = low.groupBy("host").agg(F.collect_set("branch").alias("low"))
        rows, lows = own.join(by_host, "host", "left"), lambda batch: [set(x or ()) for x in batch["low"].to_pylist()]

    def work(batch: pa.RecordBatch) -> dict:
        texts = [main_text(source or "", drop) for source, drop in zip(batch["html"].to_pylist(), lows(batch))]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_arrow(rows, schema, work)
