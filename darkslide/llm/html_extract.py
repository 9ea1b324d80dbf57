"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Each block element of a page is a node with a hidden label: content, beside it, or around both. A node has a potential from its tag, the words
in its class, id and role, those of the elements that it is in, the length of its text and the share of it in links; an edge has one from the
labels of parent and child. Messages are passed upward and downward once (sum-product, exact on a
tree), which gives every node's marginal. Text belongs to its nearest block element and is kept if that
element's marginal of being content is over 1/2.

The potentials are counts over labelled pages: LABELLED below, and at most `max_pages` pages of the table
whose own elements tell the label (see `silver_label`). What is in scripts, styles, forms and the like is
never text; neither is what its page hides (`hidden`, `display: none`), nor an article inside an article that already has text, which HTML
means for comments. A heading such as "3 comments" or "Related stories" at the start of a section marks the section.

Pages are read in one pass from left to right, whatever is in them: tags and attributes by HTML's rules (quoted and unquoted
values, comments, raw text), unclosed and stray tags mended by look-ups of what is open. A quote that the page never closes
is part of an unquoted value; a tag that the page's end cuts off is no text.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.llm.textbuf import arrow_map

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
SKIPPED = frozenset("head script style title noscript template form button select option input textarea svg math canvas iframe object embed audio video map xmp noframes noembed".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em embed font i iframe img ins kbd label map mark math meter object option output picture progress q rp rt ruby s samp select small span strike strong sub sup svg time tt u var video wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of the named kinds, up to the nearest of the second kinds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: The end of raw text: its end tag up to the next >.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
SCOPE = frozenset("html body article aside main section div nav header footer table td th form blockquote figure li dd".split())

HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary".split())

BESIDE_TAGS = frozenset("aside footer form nav".split())
# Words of names by which layouts mark what is beside the content.
BESIDE = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright discussion discussions disqus feedback footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo recommended related replies respond responses share sharing sidebar signup skip social sponsor sponsored subscribe tags talkback thread toc toolbar widget alert rail login".split())
WITHIN = frozenset("article body content entry main post story text blog hentry".split())
# Words that stand beside those in names of parts of a layout (ad-slot, sitefooter).
PARTS = frozenset("area articles bar block bottom box button buttons card cell center col column container content cta field footer form frame grid group head heading holder icons inline inner item items label left level link links list main mid middle mobile module news note outer page pages pane panel posts right row section site slot slots small space stories stub sub text top unit units wrap wrapper zone".split())
_INNER = frozenset("area body box column container content inner main text wrap wrapper".split())
#: Headings of sections that stand beside the content.
TITLES = re.compile(
    r"(?:\d+ )?(?:(?:reader|user|visitor) )?(?:comments?|replies|responses)(?: ?\(?\d+\)?)?(?: on .*)?|(?:leave|post|add|write) (?:a|your) (?:comment|reply|response).*|join the (?:conversation|discussion).*"
    r"|(?:related|recommended|popular|latest|recent|more|other) (?:articles?|links|news|posts?|reading|stories)|(?:most read|read next|see also on .*|you (?:may|might) (?:also )?like|more from .*|advertisements?|sponsored.*|share this.*|newsletter|(?:sign|log) (?:up|in).*)",
    re.I,
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_FORM_END = re.compile(r"</form", re.I)
_WRAPS = re.compile(r"<(?:article|main|h1)[\s>]", re.I)

_NAME = re.compile(r"[^\s/>]*+")
#: The next attribute of a tag (name, value in one of three forms), or its end. A quote without an end is found out once for each
#: kind of quote in a page at most, since a later one would close it; then the value counts as unquoted.
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
_COMMENT_END = re.compile(r"--!?>")
#: Words that begin names of layouts which have a part, such as has-sidebar.
_HAVING = frozenset("has have with without no is not hide show".split())
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element: its parent's number, tag, names, mark (1: within the content, -1: beside it, by its names or those of
    the nearest element around it that has a mark), and text lengths (all, in links)."""

    __slots__ = ("length", "linked", "mark", "names", "parent", "role", "tag")

    def __init__(self, parent: int, tag: str, names: tuple[str, ...], mark: int, role: str):
        self.parent, self.tag, self.names, self.mark, self.role, self.length, self.linked = parent, tag, names, mark, role, 0, 0


@lru_cache(1 << 14)
def known(word: str) -> str:
    """The word of BESIDE or WITHIN that a name's word is or is made of with a layout's part (adslot: ad), else the word itself."""
    if word in BESIDE or word in WITHIN or word in PARTS:
        return word
    for k in range(2, min(len(word), 24) - 1):
        for one, other in ((word[:k], word[k:]), (word[k:], word[:k])):
            if one in BESIDE and other in PARTS:
                return one
        if word[:k] in WITHIN and word[k:] in _INNER:
            return word[:k]
        if word[:k] in _INNER and word[k:] in WITHIN:
            return word[k:]
    return word


def named(tag: str, names: str, above: int) -> tuple[tuple[str, ...], int]:
    """(known words in an element's class, id and role; its mark), given the mark of what it is in."""
    words: set[str] = set()
    within = beside = False
    for token in names.split():
        found = [known(w) for w in _WORDS.findall(token)]
        if not found or found[0] in _HAVING:
            continue
        bad = {w for w in found if w in BESIDE}
        if bad and above > 0:  # within the content a name counts for what it ends with: notice-board is none
            rest = [w for w in found if w not in PARTS and w not in WITHIN]
            if rest and rest[-1] not in BESIDE:
                bad = set()
        good = {w for w in found if w in WITHIN}
        if above > 0:  # the article's own header holds its title
            bad -= {"header"}
        words |= bad | good
        beside |= bool(bad)
        within |= bool(good) and not bad
    own = -1 if tag in BESIDE_TAGS else 1 if tag in ("article", "main") else 0
    if tag in ("article", "main") and not words & {"comment", "comments"}:  # its other names say what it is about
        beside = False
    if tag in ("html", "body"):
        return tuple(sorted(words)), above
    if beside != within:
        own = -1 if beside else (own or 1)
    # what stands beside the content isn't within it for a name like "comment-content"
    return tuple(sorted(words)), -1 if above < 0 else own or above


def read_tag(page: str, at: int) -> tuple[int, dict[str, str] | None]:
    """(place after the tag, its attributes) from the end of its name; None if the page ends before. Of
    attributes of one name the first counts."""
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        at = m.end()
        if m[1]:
            return at, found
        found.setdefault(m[2].lower(), m[3] if m[3] is not None else m[4] if m[4] is not None else m[5] or "")
    return len(page), None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes (a parent comes before its children) and text blocks (node, text) in page order, with
    references decoded and white space made one space. Unclosed and stray tags are mended. Time is linear in the page."""
    nodes = [Node(-1, "html", (), 0, "")]
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, node of its text, whether that is none
    places: dict[str, list[int]] = {"html": [0]}  # where in the stack each tag stands
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    linked = skipping = 0
    solid, scopes = [0], [0]  # places of block elements, and of those that a paragraph can't reach across
    at, end = 0, len(page)
    forms = 0
    filled: set[int] = set()  # nodes that have text in them, and that had it in what is closed

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
            held.clear()
            if text:
                node = stack[-1][1]
                blocks.append((node, text))
                n = nodes[node]
                n.length += len(text)
                above = nodes[n.parent]
                while above.tag in ("header", "hgroup"):
                    above = nodes[above.parent]
                if n.tag in HEADINGS and n.parent not in filled and above.tag not in ("html", "body", "article", "main") and len(text) < 80 and TITLES.fullmatch(text):
                    n.mark = above.mark = -1
                    above.names = tuple(sorted({*above.names, "titled"}))
                while node >= 0 and node not in filled:
                    filled.add(node)
                    node = nodes[node].parent

    def pop_to(k: int) -> None:
        nonlocal linked, skipping
        while len(stack) > k:
            tag, _, silent = stack[-1]
            if tag not in INLINE:
                flush()
                solid.pop()
            if tag in SCOPE:
                scopes.pop()
            places[tag].pop()
            stack.pop()
            linked -= tag == "a"
            skipping -= silent

    def last(tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def text(s: str) -> None:
        if s and not skipping:
            held.append(s)
            if linked:
                nodes[stack[-1][1]].linked += len(s)

    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        after = page[begin + 1 : begin + 2]
        closing = after == "/"
        first = page[begin + 2 : begin + 3] if closing else after
        if not (first.isascii() and first.isalpha()):
            if page.startswith("<!--", begin):
                text(page[at:begin])
                if page.startswith((">", "->"), begin + 4):
                    at = page.index(">", begin) + 1
                else:
                    m = _COMMENT_END.search(page, begin + 4)
                    at = m.end() if m else end
            elif after in ("!", "?") or (closing and first):
                text(page[at:begin])
                stop = page.find(">", begin)
                at = stop + 1 if stop >= 0 else end
            else:
                text(page[at : begin + 1])
                at = begin + 1
            continue
        text(page[at:begin])
        name = _NAME.match(page, begin + 1 + closing)
        tag = name[0].lower()
        at, attributes = read_tag(page, name.end())
        if attributes is None:
            break
        if closing:
            if tag in ("html", "body"):
                continue
            k = last((tag,))
            if k > 0 and (tag not in INLINE or k > solid[-1]):
                pop_to(k)
            continue
        if tag in CLOSES_P:
            k = last(("p",))
            if k > scopes[-1]:
                pop_to(k)
        if tag in ENDS:
            kinds, limits = ENDS[tag]
            k = last(kinds)
            if k > 0 and k > last(limits):
                pop_to(k)
        if tag == "body" and stack[-1][0] == "head":
            pop_to(len(stack) - 1)
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag == "html":
            continue
        node = stack[-1][1]
        if tag not in INLINE:
            flush()
            names, mark = named(tag, _CAMEL.sub("-", " ".join(attributes.get(x, "") for x in ("class", "id", "role"))).lower(), nodes[node].mark)
            if tag == "article" and (k := last(("article",))) > 0 and stack[k][1] in filled:
                mark = -1
            nodes.append(Node(node, tag, names, mark, attributes.get("data-label", "")))
            node = len(nodes) - 1
            solid.append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        silent = tag in SKIPPED or (tag != "body" and (attributes.get("hidden", "until-found").lower() != "until-found" or HIDDEN.search(attributes.get("style", "")) is not None))
        if tag == "form":
            forms += 1
            if forms == 1:  # some pages lie in a form whole
                close = _FORM_END.search(page, at)
                silent = _WRAPS.search(page, at, close.start() if close else end) is None
                if not silent:
                    nodes[node].tag, nodes[node].mark = "div", nodes[nodes[node].parent].mark
        stack.append((tag, node, silent))
        linked += tag == "a"
        skipping += silent
    pop_to(1)
    flush()
    return nodes, blocks


def features(n: Node, bare: bool = False) -> tuple[str, ...]:
    """What is seen of a node; bare: no element of its page is marked as content."""
    length = min(5, int(math.log(n.length + 1, 4))) if n.length else -1
    links = min(3, 4 * n.linked // max(1, n.length))
    shape = f"length {length} links {links}"
    return (f"tag {n.tag}{'' if n.length else ' empty'}", *((f"open {shape}", "mark open") if bare and not n.mark else (shape, f"mark {n.mark}")), *(f"name {w}" for w in n.names))


def is_bare(nodes: list[Node]) -> bool:
    return all(n.mark <= 0 for n in nodes)


#: Labels of a node: around both kinds, content, beside the content.
AROUND, CONTENT, ASIDE = LABELS = (0, 1, 2)
Potentials = tuple[float, ...]


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class TreeModel:
    """Log potentials of features by label, and of (parent label, child label)."""

    def __init__(self, unary: dict[str, Potentials], edge: list[list[float]]):
        self.unary, self.edge = unary, edge

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node. Upward: every node tells its parent how well each of the parent's
        labels goes with all below; downward: the parent's belief without the child's own message."""
        n = len(nodes)
        none = (0.0,) * len(LABELS)
        bare = is_bare(nodes)
        up = [[sum(self.unary.get(f, none)[y] for f in features(x, bare)) for y in LABELS] for x in nodes]
        told: list[list[float]] = [[]] * n
        for k in range(n - 1, 0, -1):
            told[k] = [_logsum([e + u for e, u in zip(row, up[k], strict=True)]) for row in self.edge]
            p = nodes[k].parent
            up[p] = [u + m for u, m in zip(up[p], told[k], strict=True)]
        belief = [list(u) for u in up]
        for k in range(1, n):
            rest = [b - m for b, m in zip(belief[nodes[k].parent], told[k], strict=True)]
            down = [_logsum([r + row[y] for r, row in zip(rest, self.edge, strict=True)]) for y in LABELS]
            top = max(u + d for u, d in zip(up[k], down, strict=True))  # keeps long chains in range
            belief[k] = [u + d - top for u, d in zip(up[k], down, strict=True)]
        return [math.exp(b[CONTENT] - _logsum(b)) for b in belief]


def close_around(nodes: list[Node], labels: list[int]) -> list[int]:
    """Elements that are neither content nor marked are around it if they hold content, else beside it."""
    holds = [y == CONTENT for y in labels]
    for k in range(len(nodes) - 1, 0, -1):
        holds[nodes[k].parent] |= holds[k]
    return [y if y != AROUND or h else ASIDE for y, h in zip(labels, holds, strict=True)]


def silver_label(nodes: list[Node]) -> list[int] | None:
    """Labels that a page's own elements give: in <article> or <main> content, unless in an element that is
    beside it by its tag or name; None if it has neither element."""
    if not any(n.tag in ("article", "main") for n in nodes):
        return None
    out: list[int] = []
    for n in nodes:
        above = out[n.parent] if n.parent >= 0 else AROUND
        if n.tag in BESIDE_TAGS or (n.tag == "header" and above != CONTENT) or n.mark < 0:
            out.append(ASIDE)
        else:
            out.append(CONTENT if above == AROUND and n.tag in ("article", "main") else above)
    return close_around(nodes, out)


def fit(labelled: list[tuple[list[Node], list[int]]]) -> TreeModel:
    """Potentials from counts, smoothed. Features are normalised for each label."""
    seen: Counter[tuple[str, int]] = Counter()
    size: Counter[int] = Counter()
    edge = [[0.1] * len(LABELS) for _ in LABELS]
    for nodes, labels in labelled:
        bare = is_bare(nodes)
        for n, y in zip(nodes, labels, strict=True):
            size[y] += 1
            for f in features(n, bare):
                seen[f, y] += 1
            if n.parent >= 0:
                edge[labels[n.parent]][y] += 1
    names = {f for f, _ in seen}
    unary = {f: tuple(math.log((seen[f, y] + 0.05) / (size[y] + 0.1)) for y in LABELS) for f in names}
    return TreeModel(unary, [[math.log(x / sum(row)) for x in row] for row in edge])


def labelled_layouts() -> list[tuple[list[Node], list[int]]]:
    """LABELLED, parsed; data-label on an element holds for all in it."""
    out = []
    for page in LABELLED:
        nodes, _ = parse(page)
        if page.startswith("<html data-label=content"):  # the root is there before its tag
            nodes[0].role = "content"
        labels: list[int] = []
        for n in nodes:
            labels.append((CONTENT if n.role == "content" else ASIDE) if n.role else labels[n.parent] if n.parent >= 0 else AROUND)
        out.append((nodes, close_around(nodes, labels)))
    return out


_P = "<p>" + "Some words of a story that goes on for quite a while. " * 6 + "</p><p>A short one.</p>"
_LI = "".join(f'<li><a href="/x">Item {i}</a></li>' for i in range(5))
_TALK = "".join(f'<div class="comment"><p>Reader {i} said</p><p>{"I think that this is so, and I have more to say about it, as readers do at length. " * n}</p></div>' for i, n in enumerate((1, 3, 8, 2, 5)))
#: Usual page layouts with the label of each part (data-label).
LABELLED = (
    f"<html><body><header data-label=other><h1>Site</h1><nav><ul>{_LI}</ul></nav></header><main data-label=content><article><h1>Title</h1>{_P}{_P}<ul><li>A point.</li><li>One more.</li></ul><aside data-label=other><h3>Related</h3><ul>{_LI}</ul></aside></article></main><footer data-label=other><p>All rights reserved.</p></footer></body></html>",
    f'<html><body><div class="navbar menu" data-label=other><ul>{_LI}</ul></div><div class="cookie notice" data-label=other><p>We use cookies.</p></div><div class="content" data-label=content><h1>Title</h1><h2>Under</h2>{_P}<blockquote><p>Said so.</p></blockquote>{_P}<div class="share social" data-label=other><a href="#">Share</a></div></div><div class="sidebar widget" data-label=other><h4>Latest</h4><ul>{_LI}</ul><p>Short text.</p></div><div id="comments" data-label=other><h3>Comments</h3><div class="comment"><p>I think that this is a long comment by a reader, with many words in it, as they often are.</p></div></div><div class="footer" data-label=other>Imprint</div></body></html>',
    f'<html><body><nav data-label=other><ul>{_LI}</ul></nav><div class="ad" data-label=other>Buy now.</div><article data-label=content><h1>Title</h1>{_P}{_P}</article><section class="related" data-label=other><h2>More</h2><ul>{_LI}</ul></section><section id="comments" class="comments" data-label=other><ol><li class="comment"><p>Well, said a reader at some length, and went on to say much more.</p></li></ol></section><footer data-label=other>Copyright of the site</footer></body></html>',
    f'<html><body><div id="header" class="masthead" data-label=other><p>The Paper</p></div><div class="post entry" data-label=content><h2>Title</h2>{_P}<table><tr><td>One</td><td>Two</td></tr></table><pre>code</pre>{_P}<p class="advert" data-label=other>An advert.</p>{_P}</div><div class="newsletter signup" data-label=other><p>Get our letter every week, with all that is new.</p></div><div class="pagination" data-label=other><a href="2">Next</a></div></body></html>',
    f'<html><body><div class="banner promo" data-label=other><p>Sale today.</p></div><main data-label=content><section><h2>Part</h2>{_P}</section><section><h2>Part</h2>{_P}<figure><figcaption>A picture.</figcaption></figure></section></main><aside data-label=other><div class="widget"><p>Other words beside the story.</p></div></aside></body></html>',
    f"<html><body><article data-label=content><header><h1>Title</h1><p>By line</p></header>{_P}<div>{_P}</div></article><div class=alert data-label=other>Notice of change.</div><div class=breadcrumb data-label=other><a href=/>Home</a></div></body></html>",
    f'<html><body><main data-label=content><p>A short text.</p></main><div class=comments data-label=other>{_TALK}{_TALK}</div></body></html>',
    f'<html><body><div class=top data-label=other><a href=/>Home</a></div><div class=story data-label=content>{_P}<div>{_P}</div></div><div id=discussion data-label=other><h3>Talk</h3>{_TALK}</div></body></html>',
    f'<html><body><div id=nav data-label=other><a href=/>Home</a> <a href=/b>News</a></div><div data-label=content><h2>Title</h2><p>Two lines.</p>{_P}</div><div id=disqus_thread class=responses data-label=other>{_TALK}</div><div id=bottom data-label=other>Imprint</div></body></html>',
    f'<html><body><article data-label=content><h1>Title</h1><p>One line of text only.</p></article><section id=comments data-label=other><h2>Replies</h2>{_TALK}</section><div class="related posts" data-label=other><p>{"More that you might like to read from this site. " * 4}</p></div></body></html>',
    f'<html><body><div><div><div data-label=content><div>{"Text without any paragraph in it, as old pages have it. " * 9}</div>{_P}</div></div><div data-label=other><ul>{_LI}</ul></div></div><div class="feedback" data-label=other>{_TALK}</div></body></html>',
    # pages without a layout
    "<p data-label=content>A short text, one line or two of it.</p>",
    f"<html><body><h1 data-label=content>Title</h1><div data-label=content>{_P}{_P}</div></body></html>",
    f"<html><body data-label=content><h1>Title</h1>{_P}<ul><li>A point.</li><li>One more.</li></ul>{_P}<pre>code</pre></body></html>",
    f'<html><body><div data-label=other><a href=/>Home</a> <a href=/b>News</a></div><div data-label=content><h1>Title</h1>{_P}{_P}</div><div data-label=other><a href=/c>Terms</a> <a href=/d>Imprint</a></div></body></html>',
    f'<html><body><table><tr><td data-label=other><a href=/>Home</a> <a href=/b>News</a> <a href=/c>Shop</a></td><td data-label=content><h2>Title</h2>{_P}{_P}</td></tr></table></body></html>',
    "<body data-label=content>Text that stands in the page itself, in no paragraph.</body>",
    "<html data-label=content>Text that stands in the page itself, in no element.",
    f'<html><body><div id=top class=nav data-label=other><ul>{_LI}</ul></div><div data-label=content>{_P}{_P}</div><div class=footer data-label=other>Imprint</div></body></html>',
    f'<html><body><div id=nav data-label=other><a href=/>Home</a></div><div><div data-label=content><h1>Title</h1>{_P}{_P}</div><div data-label=other><ul>{_LI}</ul></div></div><div class=footer data-label=other>Imprint</div></body></html>',
)
MAX_PAGES, MAX_PAGE_BYTES, CONTENT_AT = 200, 1 << 18, 0.5


def train(pages: DataFrame, page: str = "html", key: str = "page_id", max_pages: int = MAX_PAGES, max_bytes: int = MAX_PAGE_BYTES) -> TreeModel:
    """Fit on LABELLED and on a sample of at most max_pages pages of at most max_bytes, chosen by a hash of their key; of rows of
    one key the least page."""
    rows = pages.where(F.col(key).isNotNull() & (F.octet_length(page) <= max_bytes))
    ids = rows.select(key).distinct().orderBy(F.xxhash64(key)).limit(max_pages)
    some = rows.join(F.broadcast(ids), key, "left_semi").groupBy(key).agg(F.min(F.col(page).cast("string")).alias("page"))  # at most max_pages keys
    labelled = labelled_layouts()
    for r in some.orderBy(key).collect():
        nodes, _ = parse(r["page"])
        labels = silver_label(nodes)
        if labels:
            labelled.append((nodes, labels))
    return fit(labelled)


def main_text(model: TreeModel, page: str) -> str:
    nodes, blocks = parse(page)
    p = model.marginals(nodes)
    return "\n".join(t for n, t in blocks if p[n] > CONTENT_AT)


def extract(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", model: TreeModel | None = None) -> DataFrame:
    """key, url, text, n_chars of every row. Null and empty pages, and pages without content, have an
    empty text; repeated rows are each returned; an empty table gives no rows; other columns are left out. Pages of any length are
    read whole, in time linear in their length; a task holds one page and its nodes."""
    shared = spark.sparkContext.broadcast(model or train(pages, page, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(m, s) if (s := t.as_py()) else "" for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    kind, url_kind = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))
    return rows.transform(arrow_map, run, f"key {kind}, url {url_kind}, text string, n_chars bigint").withColumnsRenamed({"key": key, "url": url})
