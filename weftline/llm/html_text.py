"""HTML extraction by tag-path ratios.

The page is cut into blocks, each with its root-to-leaf path of block elements (name and first class). Text length and punctuation are aggregated for
each path over the page and divided by the path's number of blocks; both ratios are smoothed over the blocks in page order and fused. A path on which
an element names itself as something beside the main text (``evidence``) has a part of its fused ratio only, so names alone neither drop nor keep a block. Paths whose
fused ratio reaches ``THRESHOLD`` times that of the typical character of unnamed text are content paths, and every block on one is main text, wherever
it lies. With them come, however short, the unnamed blocks of the same section, or of an article or main element, and headings right before a block that is kept.
Blocks that are mostly links are kept only inside such a section.

Left out whatever their ratio is what HTML itself marks as no main text: head, nav, aside, footer, form, menu, dialog, controls, embedded media,
a header outside of an article, elements with such a role, and hidden ones.

Defined cases: a null or empty page, one without tags' text, or one that is boilerplate only gives an empty text; text without any tag is one block;
unclosed and stray tags are tolerated; null ids and urls are kept; repeated rows give repeated results; an empty table an empty result. Other columns
aren't read. Work and memory are linear in the page: paths are interned, an open element is found by its count, and a search that fails isn't repeated.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import slices, table

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
TAG_MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?。，…]")
COMMENT_END = re.compile(r"--!?>")
#: Elements whose content is no markup, and what ends them.
RAW = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.I) for name in "script style noscript iframe noframes textarea title".split()}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that HTML itself sets apart from running text; the second line's stand inside of lines.
DROPPED = frozenset("head nav aside footer form menu dialog fieldset "
                    "button select template svg math object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that make a section; the others' blocks belong to the section around them.
SECTIONS = frozenset("#root html body main article section div center".split())
PAGE = frozenset("#root html body".split())
#: Elements that an opening tag of these names closes, unless a fence is in between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
FENCES = frozenset("ul ol dl table menu".split())
SCOPED = FENCES.union(*CLOSES.values())
#: Words by which a class or id names what is no main text, surely or perhaps, and words that may stand beside them. A name with any other word says nothing.
SURELY = frozenset("nav navbar navigation menu sidebar footer masthead cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager comment comments respond disqus copyright".split())
PERHAPS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion promotions notice notices share sharing social search replies related recommended recommendations widget widgets toolbar".split())
BESIDE = frozenset("site page main top bottom left right primary secondary global list links link box bar item items container wrapper wrap block area section inner panel slot unit form icons buttons post posts text content body thread the".split())
HEADERS = frozenset("header site-header siteheader page-header main-header top-header global-header".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a path keeps of its ratio if an element on it names itself so: surely, perhaps, perhaps and a paragraph or heading.
NAMED, MAYBE, MAYBE_LEAF = 0.02, 0.1, 0.4
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote caption figcaption summary legend address".split())
THRESHOLD, SMOOTH = 0.3, (0.1, 0.35, 1.0, 0.35, 0.1)


class _Element:
    __slots__ = ("name", "path", "parent", "dropped", "article", "evidence", "section", "scope")

    def __init__(self, name, path, parent, dropped, evidence):
        self.name, self.path, self.parent, self.dropped = name, path, parent, dropped
        self.evidence = min(evidence, parent.evidence) if parent else evidence
        self.article = name in ("article", "main") or parent is not None and parent.article
        self.section = self if name in SECTIONS else parent.section
        self.scope = self if name in SCOPED or parent is None else parent.scope


def evidence_of(names: str, leaf: bool = False) -> float:
    """What a path keeps of its ratio for the class names or the id of an element."""
    least = 1.0
    for name in names.split():
        if name.lower() in HEADERS:
            least = min(least, NAMED)
            continue
        parts = [w.lower() for w in WORDS.findall(name.replace("side-bar", "sidebar").replace("pop-up", "popup").replace("sign-up", "signup"))]
        if parts and all(w in SURELY or w in PERHAPS or w in BESIDE for w in parts):
            if any(w in SURELY for w in parts):
                least = min(least, NAMED)
            elif any(w in PERHAPS for w in parts):
                least = min(least, MAYBE_LEAF if leaf else MAYBE)
    return least


def _described(name: str, attributes: str, article: bool) -> tuple[str, bool, float]:
    """The element's label, whether HTML itself says that it is no main text, and the evidence of its names."""
    label, dropped, evidence = name, name in DROPPED or name == "header" and not article, 1.0
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id") and value.strip():
            if key == "class":
                label = f"{name}.{value.split()[0]}"
            if name not in ("html", "body", "main"):
                evidence = min(evidence, evidence_of(value, name in LEAVES))
        elif key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true" or key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            dropped = True
    return label, dropped, evidence


def _tag_end(page: str, at: int, quotes: set) -> int:
    """Behind the bracket that ends the tag at ``at``, or -1. ``quotes`` loses those that no longer close, and all if one swallows every later bracket."""
    end = at
    while True:
        mark = TAG_MARK.search(page, end)
        if not mark:
            if not quotes:
                return -1
            quotes.clear()
            end = at
            continue
        end = mark.end()
        if mark.group() == ">":
            return end
        if mark.group() in quotes:
            close = page.find(mark.group(), end)
            if close < 0:
                quotes.discard(mark.group())
            else:
                end = close + 1


def tokens_of(page: str):
    """(text, None, False, "") for a piece of text, ("", name, closing, attributes) for a tag. Comments, declarations and raw content give nothing."""
    at, n, last = 0, len(page), 0
    quotes, unclosed = {'"', "'"}, set()
    while (at := page.find("<", at)) >= 0:
        tag = NAME.match(page, at)
        if tag:
            end = _tag_end(page, tag.end(), quotes)
            if end < 0:  # no tag ends any more
                break
        elif page.startswith(("<!-->", "<!--->"), at):
            end = page.index(">", at) + 1
        elif page.startswith("<!--", at):
            close = COMMENT_END.search(page, at + 4)
            end = close.end() if close else n
        elif page.startswith("<![CDATA[", at):
            close = page.find("]]>", at)
            end = n if close < 0 else close + 3
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at) + 1 or n
        else:
            at += 1
            continue
        if at > last:
            yield page[last:at], None, False, ""
        if not tag:
            if page.startswith("<![CDATA[", at):
                yield page[at + 9 : end].removesuffix("]]>").replace("&", "&amp;"), None, False, ""
            last = at = end
            continue
        name, closing, attributes = tag.group(1).lower(), page[at + 1] == "/", page[tag.end() : end - 1]
        last = at = end
        if name not in RAW:
            yield "", name, closing, attributes
        elif not closing and name not in unclosed:
            close = RAW[name].search(page, end)
            if close:
                last = at = close.end()
            elif name in ("script", "style"):
                last = at = n
            else:
                unclosed.add(name)
    if last < n:
        yield page[last:], None, False, ""


def blocks_of(page: str) -> list[tuple[_Element, str, int]]:
    """(element, text, characters in links) of each block of text that isn't dropped, in page order."""
    paths: dict[tuple, int] = {}
    at = _Element("#root", 0, None, False, 1.0)
    opened: dict[str, int] = defaultdict(int)
    found, held, linked, link = [], [], 0, 0
    inline: list[str] = []  # hidden elements inside of lines

    def close():
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text and not at.dropped:
            found.append((at, text, linked))
        held, linked = [], 0

    def leave():
        nonlocal at
        opened[at.name] -= 1
        at = at.parent

    for piece, name, closing, attributes in tokens_of(page):
        if name is None:
            if not at.dropped and not inline:
                piece = _html.unescape(piece) if "&" in piece else piece
                held.append(piece)
                if link:
                    linked += len(piece.strip())
        elif name == "br" or name == "hr":
            held.append(" ")
        elif name not in BLOCKS and name not in DROPPED:
            if name == "a":
                link = 0 if closing else 1
            elif name in ("span", "label", "ins", "font", "small"):
                if closing and inline and inline[-1] == name:
                    inline.pop()
                elif not closing and not attributes.endswith("/") and (inline and name == inline[-1] or name != "font" and _described(name, attributes, False)[1]):
                    inline.append(name)
        elif closing:
            if opened[name]:
                close()
                while at.name != name:
                    leave()
                leave()
                link = 0
                inline.clear()
        elif not (attributes.endswith("/") and name in DROPPED):
            close()
            inline.clear()
            if at.name == "p" and name in BLOCKS:  # a block ends an open paragraph
                leave()
            ends = CLOSES.get(name)
            if ends:
                node, last = at.scope, None
                while node is not None and node.name not in FENCES and node.name in SCOPED:
                    last = node if node.name in ends else last
                    node = node.parent.scope if node.parent else None
                if last is not None:
                    while at is not last:
                        leave()
                    leave()
                elif name == "body" and opened["head"]:
                    while at.name != "head":
                        leave()
                    leave()
            label, dropped, evidence = _described(name, attributes, at.article)
            path = paths.setdefault((at.path, label), len(paths) + 1)
            at = _Element(name, path, at, at.dropped or dropped, evidence)
            opened[name] += 1
    close()
    return found


def path_scores(blocks: list[tuple[_Element, str, int]]) -> dict[int, float]:
    """The fused ratio of each path: the geometric mean of smoothed text length and punctuation for each block, times the evidence of its names."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text, linked in blocks:
        length[node.path] += max(0, len(text) - linked)
        marks[node.path] += len(PUNCTUATION.findall(text))
        count[node.path] += 1
    ratios = [(length[n.path] / count[n.path], marks[n.path] / count[n.path]) for n, _, _ in blocks]
    fused = defaultdict(float)
    for k, (node, _, _) in enumerate(blocks):
        total = text = mark = 0.0
        for d, w in zip(range(-2, 3), SMOOTH):
            if 0 <= k + d < len(ratios):
                total, text, mark = total + w, text + w * ratios[k + d][0], mark + w * ratios[k + d][1]
        fused[node.path] += node.evidence * sqrt((text / total) * (1 + mark / total))
    return {p: v / count[p] for p, v in fused.items()}


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    scores = path_scores(blocks)
    plain = [(scores[n.path], len(text) - linked) for n, text, linked in blocks if n.evidence == 1.0 and len(text) > linked]
    if not plain:
        return ""
    half, typical = sum(n for _, n in plain) / 2, 0.0
    for score, n in sorted(plain, reverse=True):  # the ratio at which half of the unnamed text is reached
        typical, half = score, half - n
        if half <= 0:
            break
    chosen = [scores[n.path] >= THRESHOLD * typical and linked * 2 <= len(text) for n, text, linked in blocks]
    holds = {n.section for (n, text, linked), c in zip(blocks, chosen) if n.evidence == 1.0 and (c or n.article and len(text) > linked)}
    known: dict[_Element, int] = {}

    def place(section: _Element) -> int:
        """2: a section that holds main text, or lies in one; 1: the page itself if it does; 0: neither."""
        way, node = [], section
        while node is not None and node not in known:
            way.append(node)
            node = node.parent.section if node.parent else None
        value = known[node] if node is not None else 0
        for x in reversed(way):
            value = known[x] = (1 if x.name in PAGE else 2) if x in holds else 2 if value == 2 else 0
        return known[section]

    kept, follows = [], False
    for k in range(len(blocks) - 1, -1, -1):
        node, text, linked = blocks[k]
        beside = place(node.section) if node.evidence == 1.0 else 0
        keep = chosen[k] or beside == 2 or beside == 1 and linked * 2 <= len(text) or follows and node.evidence == 1.0 and node.name in HEADINGS
        follows = keep
        if keep:
            kept.append(text)
    return " ".join(reversed(kept))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``."""
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("text"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, 16 << 20):
                texts = [main_text(x) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
