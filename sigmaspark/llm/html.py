"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page is read into blocks: runs of text between block-level tags, each with its chain of open
elements. A classifier gives every block a cost of being called content and one of being called
boilerplate, from its container elements, the plain words in their class and id, its length,
sentence marks and share of link text. The costs become the capacities of a graph's terminal
edges. Neighbouring blocks, and blocks with the elements that hold them (and those with theirs),
are joined by smoothness edges, so that two nodes close by pay for different labels. The
minimum cut, found by maximum flow, is the cheapest labelling.

So a short line between paragraphs goes with them, and a lone sentence in a list of links goes
with the list, unless their own costs outweigh their surroundings. Names that tell where
something stands rather than what it is (sidebar, header, widget) say little about one block:
such an element is a node with a cost of its own, strongly tied to its blocks, and all of them
together decide whether it is what its name says or a wrapper of the page's text.

Nodes whose own cost outweighs all their edges have that label in every minimum cut; they are
fixed first, over and over, and the flow runs on what remains.

Scripts, styles, comments and the head's metadata are markup and never become blocks. The head
needs no end tag; of the elements that are skipped, only script, style, textarea and title reach
to the end of the page without one, others are then empty. Character references
are decoded, white space inside a block becomes one space, blocks are joined by a newline.

Defined results: a null or empty html, and a page without content, give an empty text; repeated
rows give the same result each; extra columns are not touched. Time is about linear in the
page's length and nothing is cut off.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The names of HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select title".split())
TO_END = frozenset("script style textarea title".split())  # without an end tag these reach to the end of the page
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr del".split())
BREAKS = frozenset("hr img".split())
AUTO_CLOSE = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
AUTO_STOP = frozenset("ul ol dl table tbody thead tfoot body div article section main".split())

#: The classifier's weights, in units of 1/1000 of a log odds; positive speaks for content.
TAG_WEIGHT = {"article": 4000, "main": 2500, "nav": -9000, "footer": -9000, "button": -6000, "dialog": -9000, "menu": -9000, "figcaption": -500}
WRAPS = {"header": -5000, "form": -9000, "fieldset": -9000, "aside": -9000}  # elements that may as well stand around the whole page
OWN_WEIGHT = {"p": 1000, "blockquote": 800, "pre": 800, "h1": 900, "h2": 600, "h3": 500, "td": -200, "li": -300}
BAD_NAME, GOOD_NAME = -9000, 1500
# Words of a class or id, whole or with the endings given; each is a part between white space, hyphens and underscores.
BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|ising|isement|isements|orial)?|adsense|adbox|adslot|sponsor(?:s|ed|ship)?|promos?|promotion(?:s|al)?|banners?|nav|navs|navbar|navigation|navlinks?|navlist|navmenu|menus?|menubar|menuitem|breadcrumbs?|footer|footers|foot|cookies?|consent|gdpr|popups?|modal|overlay|newsletters?|subscri(?:be|ption|ptions|bebox|beform)|signup|login|share|shares|sharebar|sharebox|sharebuttons|sharelinks|sharing|sharethis|social|socials|socialbar|socialicons|sociallinks|socialmedia|related(?![\s_-]works?(?:$|[\s_-]))|relatedposts|relatedlinks|recommend(?:ed|ation|ations)?|trending|pagination|pager|copyright|disclaimer|skip|skiplinks?|print-only|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
TALK = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|commentform|reply|replies|respond|disqus(?:thread)?)(?=$|[\s_-])", re.I)  # readers' words stay out however long they are
HIDES = re.compile(r"(?:is-|visually-|u-)?hidden|sr-only", re.I)  # as a whole class; overflow-hidden and the like say nothing
PLACE = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|sidebar\w*|side(?=$|\s|[_-](?:bar|col|column|nav|menu|panel|rail))|aside|rail|widget\w*|notices?|notification\w*|alert|toolbar|legal|search|searchbox|searchform|searchbar|form|tags|discussion)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content\w*|post|entry\w*|story\w*|body|main\w*|text|prose)(?=$|[\s_-])", re.I)
QUALIFIED = re.compile(r"(?:(?<=[\s_-])|^)(?:no|has|with|without|tag|category)[_-]\S*", re.I)  # says what a page has or is about, not what the element is
ROLE_BAD = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
NEAR, ACROSS, HOLDS, NESTS = 900, 200, 400, 200  # smoothness: neighbours in one element, in two, block and element, element and element
TIED = 6000  # a block and the element of a name of place that holds it
PLACE_COST = 4000  # of calling such an element content; half of what speaks for the page's text, if that is more
MOST = 0.75  # share of a page's prose from which an element is no mere box beside it
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())  # no containers: their place is not what they are

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^"'>]*+(?:"[^"]*"[^"'>]*+|'[^']*'[^"'>]*+)*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?)(noscript|template|iframe|object|svg|math|canvas|audio|video|select)(?=[\s/>])[^>]*>?", re.I | re.S)
SENTENCE = re.compile(r"[.!?…。！？](?=\s|$|[\"'»”)])")


class Element:
    """An open element; ``good`` and ``bad`` are the strongest weights of it and all that hold it, known after ``settle``.

    ``weight`` always counts; its contents may refute ``penalty``, what its class and id say, and ``wrap``, what its tag says.
    """

    __slots__ = ("name", "parent", "no", "weight", "penalty", "wrap", "talk", "place", "good", "bad", "inside")

    def __init__(self, name: str, weight: int, parent: "Element | None", no: int, penalty: int = 0, place: bool = False, talk: bool = False):
        self.name, self.parent, self.no, self.weight, self.penalty, self.talk = name, parent, no, weight, penalty + talk * BAD_NAME, talk
        self.wrap = 0 if name == "header" and parent is not None and parent.inside else WRAPS.get(name, 0)
        self.good = self.bad = 0
        self.place: Element | None = self if place else None  # the innermost element around with a name of place, once settled
        self.inside = name == "article" or (parent is not None and parent.inside)  # an article


def settle(elements: list[Element], found: list[tuple[str, "Element", int]]) -> None:
    """Work out ``good`` and ``bad`` of all elements, given in the order in which they open.

    The penalty of a class or id doesn't count for an element that holds the page's main element or
    all of its articles; that of a tag that may stand around a whole page, such as ``form``, neither
    there nor where the element holds most of the page's prose (sentences outside of links).
    Articles in others and those with a penalty themselves, such as comments and teasers, are no
    articles here.
    """
    articles, own = [], set()
    for e in elements:
        if e.name == "article" and not e.penalty and not e.talk and not e.place and (e.parent is None or not e.parent.inside):
            articles.append(e)
    held: Counter[int] = Counter()
    prose: Counter[int] = Counter()
    for e in elements:
        if e.name == "main":
            up = e.parent
            while up is not None and up.no not in own:
                own.add(up.no)
                up = up.parent
    for e in articles:
        held[e.no] += 1
    for text, e, links in found:
        if 3 * links < len(text) and SENTENCE.search(text):
            prose[e.no] += len(text)
    whole = sum(prose.values())
    for e in reversed(elements):  # those inside come first
        if e.parent is not None:
            held[e.parent.no] += held[e.no]
            prose[e.parent.no] += prose[e.no]
    for e in elements:
        wraps = bool(e.no in own or articles and e.name != "article" and held[e.no] == len(articles))
        most = whole > 0 and prose[e.no] >= MOST * whole
        if wraps:
            e.penalty, e.place = 0, None
        if most or wraps and e.name != "aside":  # an aside's teasers are articles too
            e.wrap = 0
        if e.place is None and e.parent is not None:
            e.place = e.parent.place if e.name not in ("article", "main") else None
        own_weight = e.weight + e.penalty + e.wrap
        e.good = max(own_weight, e.parent.good if e.parent else 0)
        e.bad = min(own_weight, e.parent.bad if e.parent else 0)


def _weight(name: str, attrs: str, in_article: bool) -> tuple[int, int, bool, bool]:
    """An element's weight, and apart from it the penalty of its class and id, whether they name a place, and whether readers' comments."""
    w = TAG_WEIGHT.get(name, 0)
    good = bad = 0
    place = talk = False
    if attrs and "=" in attrs or "hidden" in attrs:
        for m in NAMES.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "role":
                w += BAD_NAME if value.lower() in ROLE_BAD else GOOD_NAME if value.lower() in ("main", "article") else 0
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                w += BAD_NAME
            elif key in ("class", "id") and value:
                words = QUALIFIED.sub("", value).split()
                if name in ("body", "html", "main"):
                    wrong = placed = []
                else:
                    said = [x for x in words if TALK.search(x)]
                    wrong = [x for x in words if HIDES.fullmatch(x) or BAD.search(x)] + said
                    placed = [x for x in words if PLACE.search(x)] if not (in_article and name in TEXT) else []
                    talk = talk or bool(said)
                bad += len(wrong) > 0
                place = place or bool(placed)
                good += any(x not in wrong and x not in placed and GOOD.search(x) for x in words)
    if good:
        return w + good * GOOD_NAME, 0, False, False
    return w, 0 if talk else bad * BAD_NAME, place, talk


def _ends(html: str) -> dict[int, int]:
    """Where each closed element of RAW that may hold elements ends, by where it begins; unclosed ones are not in it."""
    ends: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    for m in SKIPPED.finditer(html):
        if m[3]:
            at = open_at.setdefault(m[3].lower(), [])
            if not m[2]:
                if not m[0].endswith("/>"):
                    at.append(m.start())
            elif at:
                ends[at.pop()] = m.end()
    return ends


def blocks(html: str) -> list[tuple[str, Element, int]]:
    """(text, innermost element, characters of link text) of each block."""
    root = Element("", 0, None, 0)
    stack, out, made, every = [root], [], 1, [root]
    parts: list[str] = []
    links = 0
    link_open = False
    text_to = 0
    size = len(html)
    tag = TAG
    opened: Counter[str] = Counter()
    ends: dict[int, int] | None = None

    def cut(k: int):
        """Close elements from the k-th on."""
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    def close():
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, stack[-1], links))
            parts, links = [], 0

    def say(a: int, b: int):
        nonlocal links
        if b > a:
            seg = html[a:b]
            if "&" in seg:
                seg = unescape(seg)
            parts.append(seg)
            if link_open:
                links += len(seg.strip())

    at = html.find("<")
    while at >= 0:
        nxt = html[at + 1 : at + 2]
        if nxt == "!" or nxt == "?":
            say(text_to, at)
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = size if end < 0 else end + 3
            else:
                end = html.find(">", at)
                end = size if end < 0 else end + 1
            text_to = end
            at = html.find("<", end)
            continue
        m = tag.match(html, at)
        if m is None and tag is TAG and (nxt.isalpha() or nxt == "/"):
            tag = LOOSE  # a quote that never closes: from here on a tag ends at the first >
            m = tag.match(html, at)
        if m is None:
            if nxt == "/" or nxt.isalpha():
                end = html.find(">", at)
                say(text_to, at)
                text_to = size if end < 0 else end + 1
                at = html.find("<", text_to)
            else:
                at = html.find("<", at + 1)
            continue
        say(text_to, at)
        text_to = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "a":
                link_open = False
            if name not in INLINE:
                close()
            if opened[name]:
                close()
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
                link_open = False
        elif name == "br":
            parts.append(" ")
        elif name in RAW:
            if name not in ("svg", "math", "canvas", "noscript", "script", "template"):
                close()
            if name in TO_END:
                if not m[3].endswith("/"):
                    e = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(html, text_to)
                    text_to = e.end() if e else size
            elif not m[3].endswith("/"):
                if ends is None:
                    ends = _ends(html)
                text_to = max(text_to, ends.get(at, text_to))  # unclosed: the tag alone
        elif name == "head":  # ends at the first thing that isn't metadata, whether closed or not
            close()
        elif name in VOID:
            if name in BREAKS:
                close()
        else:
            inline = name in INLINE
            if name == "a":
                link_open = True
            weight, penalty, place, talk = _weight(name, m[3], stack[-1].inside) if (m[3] or not inline) else (0, 0, False, False)
            if not inline or weight or penalty or place or talk:
                close()
                if not inline and stack[-1].name == "p":
                    cut(len(stack) - 1)
                shut = AUTO_CLOSE.get(name)
                if shut:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].name in shut:
                            cut(k)
                            break
                        if stack[k].name in AUTO_STOP:
                            break
                stack.append(Element(name, weight, stack[-1], made, penalty, place, talk))
                every.append(stack[-1])
                opened[name] += 1
                made += 1
        at = html.find("<", text_to)
    say(text_to, size)
    close()
    settle(every, out)
    return out


def score(text: str, holder: Element, links: int) -> int:
    """Log odds of a block being content, in thousandths."""
    n = len(text)
    s = -1200 + min(n, 400) * 8 + min(len(SENTENCE.findall(text)), 4) * 350
    s -= 5000 * min(links, n) // n
    s += OWN_WEIGHT.get(holder.name, 0)
    if text[0] in "©®" or text[:9].lower() == "copyright":
        s -= 3000
    return s + holder.good + holder.bad


def min_cut(own: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: content) that minimise the costs of ``own`` (log odds) and of cut edges."""
    n = len(own)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    s = list(own)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # nodes whose own cost outweighs their edges
        i = todo.popleft()
        if label[i] is None and abs(s[i]) > sum(near[i].values()):
            label[i] = s[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                s[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, x in zip(rest, _max_flow(s, near, rest)):
            label[i] = x
    return label  # type: ignore[return-value]


def _max_flow(s: list[int], near: list[dict[int, int]], rest: list[int]) -> list[bool]:
    """Dinic's maximum flow; True for the nodes on the source's side of the cut."""
    no = {x: k + 2 for k, x in enumerate(rest)}
    cap: list[dict[int, int]] = [{} for _ in range(len(rest) + 2)]
    for x, k in no.items():
        if s[x] > 0:
            cap[0][k], cap[k][0] = s[x], 0
        elif s[x] < 0:
            cap[k][1], cap[1][k] = -s[x], 0
        for y, w in near[x].items():
            cap[k][no[y]] = w
    while True:
        level = [-1] * len(cap)
        level[0] = 0
        todo = deque([0])
        while todo:
            x = todo.popleft()
            for y, c in cap[x].items():
                if c > 0 and level[y] < 0:
                    level[y] = level[x] + 1
                    todo.append(y)
        if level[1] < 0:
            return [level[no[x]] >= 0 for x in rest]
        turn = [iter(list(c)) for c in cap]
        path = [0]
        while path:
            x = path[-1]
            if x == 1:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] = cap[b].get(a, 0) + push
                cut = next(i for i, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] == 0)
                turn_from = path[cut]
                del path[cut + 1 :]
                turn[turn_from] = iter([y for y in cap[turn_from]])
                continue
            for y in turn[x]:
                if cap[x][y] > 0 and level[y] == level[x] + 1:
                    path.append(y)
                    break
            else:
                path.pop()
                if path:
                    level[x] = -2


def labels(found: list[tuple[str, Element, int]]) -> list[bool]:
    """Whether each of a page's blocks is content: the minimum cut of its graph."""
    own = [score(*b) for b in found]
    evidence = sum(x for x in own if x > 0)
    edges = [(i, i + 1, NEAR if found[i][1] is found[i + 1][1] or found[i][1].parent is found[i + 1][1].parent else ACROSS) for i in range(len(found) - 1)]
    hubs: dict[int, int] = {}

    def hub(e: Element) -> int:
        first = len(own)
        while e.no not in hubs:
            hubs[e.no] = len(own)
            own.append(0)
            if e.parent is None or e.parent.parent is None:
                break
            edges.append((len(own) - 1, hubs.get(e.parent.no, len(own)), NESTS))
            e = e.parent
        return first

    for i, (_, e, _) in enumerate(found):
        holder = e.parent if e.name in OWN_WEIGHT and e.parent is not None else e
        if holder.parent is not None and holder.name not in ("body", "html"):
            edges.append((i, hubs[holder.no] if holder.no in hubs else hub(holder), HOLDS))
    places: dict[int, int] = {}
    for i, (_, e, _) in enumerate(found):
        if e.place is not None:
            if e.place.no not in places:
                places[e.place.no] = len(own)
                own.append(-max(PLACE_COST, evidence // 2))
            edges.append((i, places[e.place.no], TIED))
    return min_cut(own, edges)[: len(found)]


def extract(html: str | None) -> str:
    """The main text of a page."""
    found = blocks(html) if html else []
    return "\n".join(text for (text, _, _), x in zip(found, labels(found)) if x)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for b in batches:
            text = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.add("text", "string", False).add("n_chars", "long", False)
    return small_batches(pages).select("page_id", "url", F.col(html)).mapInArrow(run, schema)
