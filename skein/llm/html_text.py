"""HTML extraction by tag-path ratios.

The text of a page is cut into blocks, each under its root-to-leaf path of block elements. Text length outside
links and punctuation are aggregated per path and divided by the path's blocks; both ratios are smoothed over
neighbouring blocks by the likeness of their paths and fused; the paths whose ratio is above a threshold are content.
Links and class words take part as factors of a path's ratio: the share of its text that is linked is taken off, and words
that name an aside (unless what they mark holds the page's content) take all of it.
The content nodes, the blocks of these paths, choose the part of the page that is its main text: from the root on
the way goes down to where the content is, and ends where it parts. What stands between content there (headings,
lists, tables) belongs to it; paths without a ratio at its ends, as lists of links, and comments under a heading that says so, don't.
Tags are used for what markup itself says (nav, footer, script, form, article).

Elements know their parent, and paths are steps of a tree, so time and memory are linear in the page's length and its depth.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import in_short_batches

#: Elements by their role in the markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
SKIPPED = set("head title nav footer aside form script style noscript template iframe svg canvas object button select textarea menu dialog".split())
IN_HEAD = set("head title meta link base style script noscript template".split())
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr li dt dd main nav ol p pre section table ul".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"article", "main"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark what is no part of an article.
ASIDE = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|navbar|navigation|nav|breadcrumbs?|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|comments?|commentlist|disqus|discussions?|responses?|respond|replies|feedback|footer|masthead|toolbar|pagination|pager|complementary|contentinfo|search", re.I)
#: Words that say where such a part is or what it is made of.
PLACES = set("site header main top bottom left right primary secondary list links box bar buttons form section area container wrapper widget block posts post article page entry item body inner outer user reader thread view region the count".split())
#: Headings under which readers comment.
COMMENTS = re.compile(r"\W*(?:\d+\W+)?(?:(?:reader|user|all|your|leave an?|post an?|add an?|join the|view|show)\W+)*(?:comments?|responses?|repl(?:y|ies)|discussion|kommentare?|commentaires?|comentarios?)(?:\W+\d*)?\W*", re.I)
#: Attributes of a tag: a value's quote opens after = and closes before a blank or the tag's end; any other quote is a character.
_ATTRIBUTES = r"(?:(?>=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>]))*+"
MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S | re.I)
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")
RIGHTS = re.compile(r"©|\(c\)|copyright\b", re.I)
#: Weight of a block k places away, before the likeness of its path.
NEAR = np.exp(-np.arange(3) ** 2 / 2.0)
#: Share of the deviation of the fused ratios that content must reach.
THRESHOLD = 0.25
#: Share of the content from which a part holds it all but for strays; share of links from which a list is a menu.
MOST, MENU = 0.8, 0.6


@dataclass(eq=False)
class Path:
    """A path from the root: its last step and the path before."""

    step: str
    up: Path | None
    depth: int
    longer: dict[str, Path] = field(default_factory=dict)

    def to(self, step: str) -> Path:
        if step not in self.longer:
            self.longer[step] = Path(step, self, self.depth + 1)
        return self.longer[step]

    def __str__(self) -> str:
        steps, at = [], self
        while at:
            steps.append(at.step)
            at = at.up
        return "/".join(reversed(steps))


def alike(one: Path, two: Path) -> float:
    """Steps that two paths share from the root on, by the steps of the longer one."""
    most = max(one.depth, two.depth) + 1
    while one is not two:
        if one.depth >= two.depth:
            one, same = one.up, two if one.depth > two.depth else two.up
            two = same
        else:
            two = two.up
    return (one.depth + 1) / most


@dataclass(eq=False)
class Element:
    tag: str
    up: Element | None
    path: Path
    aside: bool
    #: Its number in the page, and the last one inside it.
    n: int
    last: int = -1
    #: The innermost marked element, and the innermost article or main, that it is or is in.
    outer: Element | None = None
    box: Element | None = None
    children: list[Element] = field(default_factory=list)

    def holds(self, other: Element) -> bool:
        return self.n <= other.n <= self.last

    def around(self) -> Iterator[Element]:
        """The element and those around it, from the inside."""
        at = self
        while at:
            yield at
            at = at.up


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _marks_aside(marks: str) -> bool:
    """Whether a whole token says so: its words are ASIDE's, beside words of place. no-sidebar or search-result don't."""
    for token in marks.split():
        words = [w for w in re.findall(r"[^\W\d_]+", token.lower()) if len(w) > 1]
        named = [w for w in words if ASIDE.fullmatch(w)]
        if named and all(w in named or w in PLACES for w in words) or words == ["site", "header"]:
            return True
    return False


def _marks(attributes: str | None) -> str:
    return " ".join(x.strip("\"'") for x in MARKS.findall(attributes or ""))


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order, those without text left out.

    Elements that aren't closed end with the page or where their like begins; head ends where the body's elements begin.
    """
    root = Element("", None, Path("", None, 0), False, 0)
    stack, open_ = [root], Counter()
    out: list[Block] = []
    n, at, here, links, mute = 0, 0, None, False, []

    def end() -> str:
        e = stack.pop()
        e.last = n
        open_[e.tag] -= 1
        return e.tag

    def say(raw: str) -> None:
        nonlocal here
        if raw and not mute:
            if here is None:
                here = Block(stack[-1])
                out.append(here)
            here.parts.append(unescape(raw))
            here.linked += len(raw) * links

    for m in MARKUP.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag, closing = (m[3] or "").lower(), bool(m[2])
        if not tag:
            continue
        if tag in INLINE:
            if tag in ("br", "img") and here is not None:
                here.parts.append(" ")
            elif tag == "a":
                links = not closing
            if mute and mute[0] == tag:
                mute.pop() if closing else mute.append(tag)
            elif not mute and not closing and tag not in VOID and _marks_aside(_marks(m[4])):
                mute.append(tag)
            continue
        here, links, mute = None, False, []
        if closing:
            while open_[tag] and end() != tag:
                pass
            continue
        if tag not in IN_HEAD:
            while open_["head"] and end() != "head":
                pass
        if tag in ENDS_P and stack[-1].tag == "p":
            end()
        while stack[-1].tag in SAME_ENDS.get(tag, ()):
            end()
        if tag in VOID or (m[4] or "").endswith("/"):
            continue
        marks, up, n = _marks(m[4]), stack[-1], n + 1
        made = Element(tag, up, up.path.to(tag + (f".{marks.lower()}" if marks else "")), up.aside or tag in SKIPPED, n)
        made.outer = made if tag not in ("html", "body", *CONTAINERS) and _marks_aside(marks) else up.outer
        made.box = made if tag in CONTAINERS else up.box
        up.children.append(made)
        stack.append(made)
        open_[tag] += 1
    say(html[at:])
    while stack:
        end()
    return [b for b in out if b.text]


def path_ratios(found: list[Block]) -> np.ndarray:
    """Fused, smoothed ratio of each block's path, less the share of its text that is links; 0 under marks that count."""
    totals: dict[Path, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in found:
        t, own = totals[b.element.path], max(len(b.text) - b.linked, 0)
        t[0], t[1], t[2], t[3] = t[0] + own, t[1] + len(PUNCTUATION.findall(b.text)), t[2] + 1, t[3] + len(b.text)
    sums = [totals[b.element.path] for b in found]
    plain = np.array([t[0] / t[3] for t in sums])
    ratios = np.array([[t[0] / t[2], t[1] / t[2]] for t in sums])
    smooth, weight = ratios * NEAR[0], np.full(len(found), NEAR[0])
    for k in (1, 2):
        for i in range(len(found) - k):
            w = NEAR[k] * alike(found[i].element.path, found[i + k].element.path)
            for a, b in ((i, i + k), (i + k, i)):
                smooth[a], weight[a] = smooth[a] + w * ratios[b], weight[a] + w
    smooth /= weight[:, None]
    fused = plain * np.sqrt(smooth[:, 0] * (1 + smooth[:, 1]))
    return fused * ~_under_marks(found, fused)


def _under_marks(found: list[Block], fused: np.ndarray) -> np.ndarray:
    """The blocks under marked elements, but those that hold the content that there is without regard to marks."""
    if not any(b.element.outer for b in found):
        return np.zeros(len(found), bool)
    paths = content_paths(found, fused)
    stay = _staying([b for b in found if b.element.path in paths] or found)
    return np.array([any(e not in stay for e in _chain(b.element.outer, "outer")) for b in found])


def _chain(at: Element | None, name: str) -> Iterator[Element]:
    """A marked element and those that it is in, or a container and those that it is in."""
    while at:
        yield at
        at = getattr(at.up, name)


def content_paths(found: list[Block], fused: np.ndarray) -> set[Path]:
    """The paths whose ratio, the mean of their blocks', reaches the threshold."""
    of: dict[Path, list[float]] = defaultdict(list)
    for b, r in zip(found, fused, strict=True):
        of[b.element.path].append(r)
    least = THRESHOLD * fused.std() if len(found) else 0
    return {path for path, rs in of.items() if (mean := sum(rs) / len(rs)) >= least and mean > 0}


def _size(some: list[Block]) -> int:
    return sum(len(b.text) for b in some)


def _containers(some: list[Block]) -> set[Element]:
    """The articles and mains that the blocks are in."""
    out: set[Element] = set()
    for b in some:
        for e in _chain(b.element.box, "box"):
            if e in out:
                break
            out.add(e)
    return out


def _staying(content: list[Block]) -> set[Element]:
    """The marked elements that hold the page's content, whose marks therefore don't count.

    Such an element has over half of the content or, with an article or main in it, as much as all that isn't
    marked; and no article or main beside it has content that isn't marked.
    """
    plain = [b for b in content if not b.element.outer]
    inside: dict[Element, int] = Counter()
    for b in content:
        for e in _chain(b.element.outer, "outer"):
            inside[e] += len(b.text)
    whole, free = _size(content), _size(plain)
    others, own = _containers(plain), _containers([b for b in content if b.element.outer])
    stay = set()
    for e, size in inside.items():
        if 2 * size > whole or (size >= free and any(e is not c and e.holds(c) for c in own)):
            if all(c.holds(e) for c in others):
                stay.add(e)
    return stay


def _weights(content: list[Block]) -> dict[Element, int]:
    """Text of the content under each element."""
    own: dict[Element, int] = Counter()
    for b in content:
        own[b.element] += len(b.text)
    out, todo = Counter(own), set()
    for x in own:
        for e in x.around():
            if e in todo:
                break
            todo.add(e)
    # From the last element to the first: children are done when their parent has its turn.
    for e in sorted(todo, key=lambda e: -e.n):
        if e.up is not None:
            out[e.up] += out[e]
    return out


def _home(content: list[Block]) -> Element:
    """Where the content is: down from the root as long as one part has it, to an article or to where it parts.

    A part that has all but strays of it counts as the one, unless its like stands beside it. A title before the
    one part keeps the way from going further.
    """
    size = _weights(content)
    own = {b.element for b in content}
    at = next(e for e in content[0].element.around() if e.up is None)
    while at.tag != "article":
        parts = [e for e in at.children if size.get(e)]
        if not parts or at in own:
            break
        best = max(parts, key=lambda e: (size[e], -e.n))
        like = any(e is not best and e.path is best.path for e in parts)
        inner = best.tag in ("div", "section", "td", *CONTAINERS) or any(size.get(e) for e in best.children)
        if like or not inner or size[best] < MOST * sum(size[e] for e in parts) or best.tag in HEADINGS:
            break
        at = best
    return at


def _with_title(home: Element, found: list[Block]) -> Element:
    """The home, or what is around it, within the body, if all that comes before it there is a title or a header with one."""
    while home.up is not None and home.up.up is not None and home.tag not in CONTAINERS and home.up.tag not in ("html", "body"):
        around = home.up
        before = [b for b in found if around.holds(b.element) and b.element.n < home.n and not b.element.holds(home)]
        if not before or not all(b.element.tag in HEADINGS or any(e.tag == "header" for e in b.element.around()) for b in before):
            if around.tag not in CONTAINERS:
                break
        home = around
    return home


def _without_comments(kept: list[Block]) -> list[Block]:
    """The blocks but for those under a heading of comments: all that follow it in what is around the heading."""
    out, until = [], None
    for b in kept:
        if until is not None and until.holds(b.element):
            continue
        until = None
        if out and b.element.tag in HEADINGS and COMMENTS.fullmatch(b.text) and b.element.up is not None:
            until = b.element.up
            continue
        out.append(b)
    return out


def _trimmed(some: list[Block], gone: set[int], bare: set[int]) -> list[Block]:
    """The blocks but those that are gone, those at either end whose path has no ratio (bare), and headings that are left over them at the end."""
    loose = lambda b: id(b) in gone or (id(b) in bare and b.element.tag not in HEADINGS)
    first, last = 0, len(some)
    while first < last and loose(some[first]):
        first += 1
    while last > first and loose(some[last - 1]):
        last -= 1
    if last < len(some):
        while last - 1 > first and (some[last - 1].element.tag in HEADINGS or loose(some[last - 1])):
            last -= 1
    return [b for b in some[first:last] if id(b) not in gone]


def main_text(html: str | None, ratios: Callable[[list[Block]], np.ndarray] = path_ratios) -> str:
    """The main text of a page, its blocks joined by an empty line; empty if there is none."""
    found = [b for b in blocks(html or "") if not b.element.aside]
    if not found:
        return ""
    fused = ratios(found)
    paths = content_paths(found, fused)
    content = [b for b in found if b.element.path in paths]
    if not content:
        # Nothing but links and marks, or too little of all for a ratio: what has any, else what isn't marked.
        content = [b for b, r in zip(found, fused, strict=True) if r > 0] or [b for b in found if not b.element.outer]
        if not content:
            return ""
        paths = {b.element.path for b in content}
    bare = {id(b) for b, r in zip(found, fused, strict=True) if r <= 0 and b.element.path not in paths}
    home = _with_title(_home(content), found)
    sure, firsts = home.box is not None, [e.n for e in home.children]
    parts: dict[int, list[Block]] = defaultdict(list)
    tops: dict[int, Element] = {}
    for b in found:
        if home.holds(b.element) and not (b.element.outer and id(b) in bare):
            top = home.children[bisect_right(firsts, b.element.n) - 1] if b.element is not home else None
            key = top.n if top else -len(parts) - 1
            parts[key].append(b)
            if top:
                tops[key] = top
    some, gone = [], set()
    for key, part in parts.items():
        tag = tops[key].tag if key in tops else ""
        if not sure and not any(b.element.path in paths and not RIGHTS.match(b.text) for b in part) and tag not in HEADINGS:
            menu = sum(b.linked for b in part) > MENU * _size(part)
            if menu or RIGHTS.match(part[0].text) or (tag == "header" and home.tag in ("", "html", "body")):
                gone.update(map(id, part))
        some += part
    return "\n\n".join(b.text for b in _trimmed(_without_comments(some), gone, bare))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (empty if there is none) and n_chars, its code points.

    Null and empty pages, and pages of nothing but menus, have an empty text. Repeated rows are extracted as often
    as they occur; other columns are ignored. Character references are decoded, white space inside a block becomes
    one blank, and blocks are joined by an empty line.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(text=[main_text(h) for h in b["html"]])
            yield b.assign(n_chars=[len(t) for t in b["text"]])[["page_id", "url", "text", "n_chars"]]

    pages = in_short_batches(pages).select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInPandas(extract, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
