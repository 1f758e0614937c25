"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose whole content is left out.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea option iframe "
                    "svg canvas object video audio map dialog menu input".split())
#: Those that stand within a sentence, which goes on behind them.
_WITHIN = frozenset("button select textarea svg canvas object video audio map input".split())
#: Elements that start a block of text of their own.
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 "
                   "h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = BLOCKS - frozenset(("body", "html"))
_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
         "th": ("table", "tr"), "option": ("select",)}
#: Points of an element marked as an aside that make it the article's container if they are over half of the page's.
RESCUED = 10
#: Words that mark what is not the article if they make up a whole name in a class, id or role, with words of place.
_PLACE = (r"(?:site|page|top|bottom|left|right|primary|secondary|global|box|bar|list|block|section|area|wrapper|container|"
          r"inner|links?|buttons?|items?|slot|unit|icons?|[0-9]+)")
_WORD = (
    r"(?:ads?|advert(?:s|isement|ising|orial)?|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|sidebar|side-bar|rail|"
    r"widget|footer|foot|header|masthead|topbar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|comments?|"
    r"discussion|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe|newsletter|"
    r"signup|login|share|sharing|social|related|recommended|recirc|outbrain|taboola|toolbar|skip|hidden|copyright|"
    r"disclaimer|complementary|contentinfo|search)")
_ASIDE = re.compile(rf"(?:^|(?<=\s))(?:{_PLACE}[_-]+)*{_WORD}(?:[_-]+(?:{_WORD}|{_PLACE}))*(?:$|(?=\s))", re.I)
_REPLIES = re.compile(r"(?:^|\s)(?:comments?|discussion|disqus|repl(?:y|ies)|respond)(?:$|[\s_-])", re.I)
#: Marks that take an inline element out of the sentence around it; other marks only take it where it stands alone.
_NEVER_TEXT = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising|orial)?|sponsor(?:ed|s)?|share|sharing|social|menu|nav|navbar|navigation|"
                         r"breadcrumbs?|pagination|pager|cookies?|consent|subscribe|newsletter|outbrain|taboola|hidden)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|text|body|page|blog)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


class _Node:
    """An element: parent, innermost block around it, whether it is left out, and what its text adds up to."""

    __slots__ = ("tag", "parent", "block", "out", "aside", "soft", "names", "link", "own", "near", "far", "chars", "linked", "paragraphs", "inside", "kept")

    def __init__(self, tag: str, parent: "_Node | None", names: str, out: bool, marked: bool = False):
        self.tag, self.parent, self.names, self.out = tag, parent, names, out
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.aside, self.soft = marked and tag in BLOCKS, (marked and tag not in BLOCKS) or (parent is not None and parent.soft and tag not in BLOCKS)
        self.own = self.near = self.far = self.chars = self.linked = self.paragraphs = self.inside = 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.kept = False

    def score(self) -> float:
        """Points given here in full, those of the level below in half, those further down in falling parts."""
        return self.own + self.near / 2 + self.far


_Block = tuple[_Node, str, int]


def _blocks(page: str) -> tuple[list[_Node], list[_Block]]:
    """The elements, each after the one around it, and (block element, text, characters in links) in page order.

    Closes what the markup leaves open. Each tag costs one step at any depth.
    """
    root = _Node("html", None, "", False)
    stack, nodes, out = [root], [root], []
    words: list[str] = []
    linked, hard = [0], [False]
    places: dict[str, list[int]] = defaultdict(list)  # where elements of a tag are open

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text and hard[0]:
            out.append((stack[-1].block, text, min(linked[0], len(text))))
        words.clear()
        linked[0], hard[0] = 0, False

    def close(to: int) -> None:
        if stack[-1].block is not stack[to - 1].block:
            flush()
        for n in stack[to:]:
            places[n.tag].pop()
        del stack[to:]

    def last(*tags: str) -> int:
        """Place of the innermost open element of these tags, 0 if none is open."""
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def add(text: str) -> None:
        above = stack[-1]
        if text and not above.out:
            text = html.unescape(text)
            words.append(text)
            bare = len(text.strip())
            if above.link:
                linked[0] += bare
            if bare and not above.soft:
                hard[0] = True

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        add(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, end = m[2].lower(), bool(m[1])
        if end:
            if found := last(tag):
                close(found)
            elif tag == "p":
                flush()
            continue
        if tag == "html" and len(stack) > 1:
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br" and not stack[-1].out:
                words.append(" ")
            continue
        if tag in _CLOSES_P and (found := last("p")):
            close(found)
        if tag in _SAME:
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if (found := last(*same)) > last(*_SAME[tag]):
                close(found)
        if tag in BLOCKS:
            flush()
        above = stack[-1]
        held: dict[str, str] = {}
        for name, value in _ATTRIBUTE.findall(m[3]):
            held.setdefault(name.lower(), value.strip("\"'"))
        names = " ".join(held[x] for x in ("class", "id", "role") if x in held)
        marked = tag not in ("html", "body", "article", "main") and bool(names) and bool(_ASIDE.search(names))
        aside = tag in DROPPED or (tag == "header" and not places["article"]) or (
            marked and bool((_REPLIES if tag in BLOCKS else _NEVER_TEXT).search(names))) or (
            tag == "article" and bool(re.search(r"(?:^|\s)(?:comment|reply)(?:$|[\s_-])", names, re.I))) or (
            "hidden" in held or held.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(held.get("style", ""))))
        if tag in _VOID:
            continue
        if tag in _RAW:
            done = _RAW[tag].search(page, at)
            at = done.end() if done else len(page)
            continue
        if aside and not above.out and tag in DROPPED and tag not in _WITHIN:
            flush()
        places[tag].append(len(stack))
        stack.append(_Node(tag, above, names, above.out or aside, marked))
        nodes.append(stack[-1])
    add(page[at:])
    flush()
    return nodes, out


def _points(node: _Node, text: str, linked: int) -> float:
    base = min(len(text) / 25, 1) if node.tag == "li" else 1  # short items are as likely a menu
    return (base + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def _without_asides(nodes: list[_Node], blocks: list[_Block]) -> list[_Block]:
    """The blocks outside elements marked as asides; such an element stays if most of a long page is in it."""
    for node, text, linked in blocks:
        node.inside += _points(node, text, linked)
    for n in reversed(nodes[1:]):
        n.parent.inside += n.inside
    total = nodes[0].inside
    for n in nodes:
        n.kept = (n.parent is None or n.parent.kept) and (not n.aside or (n.inside >= RESCUED and n.inside > total / 2))
    return [b for b in blocks if b[0].kept]


def _scored(nodes: list[_Node], blocks: list[_Block]) -> list[_Node]:
    """Add up the blocks from the leaves to the root; the elements around text, from the first block's outwards."""
    order, seen = [], set()
    for node, text, linked in blocks:
        paragraph = node.tag in ("p", "pre", "blockquote", "td", "li", "div", "section", "article", "main")
        node.chars += len(text)
        node.linked += linked
        node.paragraphs += paragraph and linked < 0.5 * len(text)
        if paragraph:
            holder = node.parent if node.tag in ("p", "pre", "blockquote", "td", "li") and node.parent else node
            holder.own += _points(node, text, linked)
        up = node
        while up is not None and id(up) not in seen:
            seen.add(id(up))
            order.append(up)
            up = up.parent
    for n in reversed(nodes[1:]):
        up = n.parent
        up.near += n.own
        up.far += n.near / 6 + n.far / 2
        up.chars += n.chars
        up.linked += n.linked
        up.paragraphs += n.paragraphs
    return order


def main_text(page: str) -> str:
    """The article's blocks, one per line.

    Each paragraph gives its points (one, one per comma, one per hundred
    characters up to three, less its share of link text; short list items less)
    to the element around it in full, to the next one in half, then in falling
    parts. The element of most points, discounted by its link density, is the
    article, with those siblings that also hold paragraphs that are not mostly
    links, and what stands between these (headings, lists). Articles next to
    each other all stay. Linear in the page at any depth.
    """
    nodes, blocks = _blocks(page)
    blocks = _without_asides(nodes, blocks)
    if not blocks:
        return ""

    def worth(n: _Node) -> float:
        bonus = 25 if n.tag in ("article", "main") else 5 if n.names and _GOOD.search(n.names) else 0
        return (n.score() + bonus * (n.score() > 0)) * (1 - n.linked / max(n.chars, 1))

    order = _scored(nodes, blocks)
    best = max(order, key=worth)  # the first of equals, nearest to the first paragraph
    up = best
    while up is not None:
        if up.tag == "article":
            best = up
            break
        up = up.parent
    # elements around text among the children of best's parent, in page order
    peers = [n for n in order if n.parent is best.parent] if best.parent is not None else [best]
    real = lambda n: n is best or (n.paragraphs > 0 and n.linked < 0.5 * n.chars)
    if best.tag == "article":
        kept = {id(n) for n in peers if n.tag == "article" and real(n)}
    else:
        chosen = [i for i, n in enumerate(peers) if real(n)]
        kept = {id(n) for n in peers[chosen[0]:chosen[-1] + 1] if real(n) or n.linked < 0.5 * n.chars}
    for n in nodes:
        n.kept = id(n) in kept or (n.parent is not None and n.parent.kept)
    return "\n".join(text for node, text, _ in blocks if node.kept)


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Main text of every whole page: (page_id, url, text, n_chars).

    Left out: scripts, styles, forms, menus, headers outside the article,
    footers, sidebars and what its class or id marks as such, adverts, notices
    and reader comments. Markup that is never closed or cut off is closed as a
    browser would. Buttons and pictures go from a sentence without cutting it;
    an inline element whose class only sounds like a notice stays in its
    sentence. A null, empty or text-less page has an empty text. Null and
    repeated ids stay; other columns are not looked at. One pass, no shuffle;
    a page is one row, so a task's memory is bounded by its longest page.
    """
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind, url = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return rows.mapInArrow(_extract, f"page_id {kind}, url {url}, text string, n_chars bigint")
