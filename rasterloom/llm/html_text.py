"""Main text of a web page by tree scoring.

A page is read into a tree. Each paragraph passes points (one, one per comma, one per hundred letters up to three) to its
parent, half to the grandparent and less further up; a container's points are raised or lowered by its tag and names and
discounted by its link density. The best container is kept with those siblings that score or read like it. Parts that are
no article (menus, forms, notices, adverts, reader comments, scripts, markup) are cut before scoring.

Null, empty and text-free pages give the empty string. White space inside a block becomes one space, blocks are joined by an
empty line, nothing is dropped for its length.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from rasterloom.llm.common import map_text

# Elements of the HTML standard by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
CUT = set(
    "script style noscript template textarea title xmp iframe noembed noframes head nav aside footer form button select option "
    "input label fieldset svg canvas object embed applet audio video map dialog menu".split()
)
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCK - set("caption legend option tbody td tfoot th thead tr body html".split())
#: Opening the key ends an open element of the value, not looking past a boundary.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOUNDARY = set("ul ol dl table div article section main body select menu".split())
TAG_POINTS = {"article": 30, "main": 25, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "th": -5}

#: Names (class, id, role) of parts that are no article.
UNLIKELY = re.compile(
    r"(?<![a-z])(ads?|advert\w*|advertisement|adsense|banner|sponsor\w*|promo\w*|outbrain|taboola|nav\w*|menu\w*|breadcrumbs?|"
    r"side-?bar\w*|widget\w*|comment\w*|disqus|respond|reply|replies|reader-?comments?|discussion|feedback|cookies?|consent|gdpr|notices?|"
    r"alert|toast|popup|modal|overlay|newsletter|subscri\w+|sign-?up|login|share\w*|sharing|social\w*|related\w*|recommend\w*|"
    r"read-?more|more-?(stories|links|news)|trending|popular|footer|foot|masthead|site-?header|page-?header|top-?bar|toolbar|"
    r"skip\w*|legal|copyright|disclaimer|pager|pagination|tags?|tag-?(list|cloud)|search\w*|hidden|navigation|complementary|"
    r"contentinfo|dialog)(?![a-z])",
    re.I,
)
LIKELY = re.compile(r"(?<![a-z])(article|body|content|entry|main|page|post|story|text|blog)(?![a-z])", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|_")

# A quoted value does not reach over the next "<", so an unclosed quote costs no second scan of the page.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Node:
    __slots__ = ("bits", "letters", "linked", "names", "points", "tag", "up")

    def __init__(self, tag: str, up: Node | None, names: str = ""):
        self.tag, self.up, self.names = tag, up, names
        self.bits: list[Node | str] = []
        self.points: float | None = None
        self.letters = self.linked = 0


def parse(page: str) -> Node:
    """The tree, with scripts and other parts that never are text left out."""
    root = Node("html", None)
    node, at, n = root, 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            text = page[at:end]
            node.bits.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            node = close(node, tag, root)
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            node.bits.append(" " if tag not in ("hr",) else Node("hr", node))
            continue
        if tag in ENDS_P:
            node = close(node, "p", root, soft=True)
        for old in ENDS_SAME.get(tag, ()):
            node = close(node, old, root, soft=True)
        new = Node(tag, node, names_of(m[3]) if m[3] else "")
        node.bits.append(new)
        if not m[3].endswith("/") or tag in BLOCK:
            node = new
    return root


def names_of(attributes: str) -> str:
    got = []
    for name, value in ATTR.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            got.append(CAMEL.sub("-", html.unescape(value)))
        elif name in ("hidden",) or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            got.append("hidden")
    return " ".join(got)


def close(node: Node, tag: str, root: Node, soft: bool = False) -> Node:
    """The node in whose content the page goes on once the nearest open ``tag`` ends; unchanged if none is open.

    soft: an end that another start implies; it does not reach past a boundary element.
    """
    at = node
    while at is not root and at is not None:
        if at.tag == tag:
            return at.up
        if soft and at.tag in BOUNDARY:
            return node
        if not soft and at.tag in ("article", "main", "body") and tag in ("b", "i", "em", "strong", "span", "a", "p", "li"):
            return node
        at = at.up
    return node


def unlikely(node: Node) -> bool:
    if node.tag in CUT:
        return True
    if node.tag == "header":
        up = node.up
        while up is not None:
            if up.tag in ("article", "main"):
                break
            up = up.up
        if up is None:
            return True
    if node.names and node.tag not in ("article", "main"):
        return bool(UNLIKELY.search(node.names)) and not ("hidden" not in node.names and re.search(r"(?<![a-z])(article|post|entry|story)-?(body|content|text)(?![a-z])", node.names, re.I))
    return False


def prune_and_measure(root: Node) -> None:
    """Cuts unlikely parts and fills letters and linked letters of each node."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.bits = [b for b in node.bits if isinstance(b, str) or not unlikely(b)]
        stack.extend(b for b in reversed(node.bits) if not isinstance(b, str))
    for node in reversed(order):
        own = sum([len(" ".join(b.split())) for b in node.bits if isinstance(b, str)])
        node.letters = own + sum([b.letters for b in node.bits if not isinstance(b, str)])
        node.linked = node.letters if node.tag == "a" else sum([b.linked for b in node.bits if not isinstance(b, str)])


def text_runs(root: Node) -> list[tuple[Node, str]]:
    """Texts between two block borders in page order, each with the innermost block element around it."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []
    around = [root]
    stack: list[Node | str | None] = list(reversed(root.bits))

    def end() -> None:
        if text := " ".join("".join(run).split()):
            out.append((around[-1], text))
        run.clear()

    while stack:
        b = stack.pop()
        if isinstance(b, str):
            run.append(b)
        elif b is None:
            end()
            around.pop()
        else:
            if b.tag in BLOCK:
                end()
                around.append(b)
                stack.append(None)
            stack.extend(reversed(b.bits))
    end()
    return out


def score(runs: list[tuple[Node, str]]) -> list[Node]:
    """Points passed up from paragraphs; the containers that got any."""
    got = []
    for node, text in runs:
        if node.tag in HEADING or node.tag in ("li", "ul", "ol", "hr"):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        # text that is not in a paragraph of its own counts for the container it stands in
        up, level = (node.up if node.tag in ("p", "pre", "blockquote", "td", "dd", "figcaption") else node), 0
        while up is not None and level < 5:
            if up.tag in BLOCK:
                if up.points is None:
                    up.points = start(up)
                    got.append(up)
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = up.up
    return got


def start(node: Node) -> float:
    return TAG_POINTS.get(node.tag, 0) + (25 if node.names and LIKELY.search(node.names) else 0)


def density(node: Node) -> float:
    return node.linked / node.letters if node.letters else 0.0


def chosen(root: Node, runs: list[tuple[Node, str]]) -> list[Node]:
    """The best container and the siblings that belong to it."""
    found = score(runs)
    if not found:
        return [root]
    value = {id(n): n.points * (1 - density(n)) for n in found}
    best = max(found, key=lambda n: value[id(n)])
    # an article's parts can outscore it one by one: go up while the parent is one article
    while best.up is not None and best.up.tag in ("article", "main") and best.tag not in ("article", "main"):
        best = best.up
    if best.up is None:
        return [best]
    least, kept = max(10.0, 0.2 * value.get(id(best), 0.0)), []
    for b in best.up.bits:
        if isinstance(b, str):
            continue
        if b is best or value.get(id(b), 0.0) + (0.2 * value.get(id(best), 0.0) if b.names and b.names == best.names else 0.0) >= least:
            kept.append(b)
        elif b.tag == "p" or b.tag in HEADING:
            d = density(b)
            if (b.letters > 80 and d < 0.25) or (0 < b.letters <= 80 and d == 0):
                kept.append(b)
    return kept


def inside(node: Node, kept: set[int], known: dict[int, bool]) -> bool:
    """Whether a block lies in a kept part and in no part that is mostly links."""
    path, at = [], node
    while at is not None and id(at) not in known and id(at) not in kept:
        path.append(at)
        at = at.up
    yes = at is not None and (id(at) in kept or known[id(at)])
    for n in reversed(path):
        yes = yes and not (n.tag in ("ul", "ol", "dl", "table", "div", "section", "p") and density(n) > 0.6)
        known[id(n)] = yes
    return yes


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune_and_measure(root)
    runs = text_runs(root)
    kept, known = {id(n) for n in chosen(root, runs)}, {}
    return "\n\n".join([text for node, text in runs if inside(node, kept, known)])


def _extract(pages: list[str | None]) -> list:
    texts = [main_text(p) for p in pages]
    return [texts, [len(t) for t in texts]]


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points). No shuffle."""
    return map_text(df, column, [("text", "string"), ("n_chars", "bigint")], _extract)
