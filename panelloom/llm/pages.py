"""Main text of web pages by tree scoring.

A page becomes a tree. Every paragraph earns points for its length and its commas, less its
share of link text, and passes them to its container and, in falling parts, to the containers
above. The container with the most points, discounted by its own link density, is the
article; siblings that look like parts of it are kept too. Menus, forms, notices, comments and
the like are left out by element, role and name, whatever their size. Names of mere layout
(``sidebar``, ``overlay``) are left out too, unless the container with the most points stands
inside. If nothing else has text, named blocks count, those with layout names first. Menus at the article's start or end, which are lists of links, are left out as well.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from panelloom.llm.common import batch_rows, column

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*>|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACES = re.compile(r"\s+")
#: Fixed values of HTML: elements by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPH = frozenset("p pre li td th dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Elements, roles and names that hold no article text.
SKIPPED = frozenset(
    "script style noscript template textarea title nav aside footer form button select option "
    "input iframe svg canvas object audio video dialog menu head noembed noframes xmp".split()
)
SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
    "toolbar form".split()
)
SKIPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline "
    "comment comments commentlist consent cookie cookies disqus footer gdpr header hidden login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification "
    "notifications overlay pager pagination popup promo promoted promotion related replies reply "
    "respond rss share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "tags toolbar widget widgets".split()
)
#: Those among them that tell a place or a look, not what stands there.
LAYOUT_NAMES = frozenset(
    "header hidden masthead modal overlay popup sidebar toolbar widget widgets".split()
)
#: Parts that a skipped name may have besides: places and kinds of blocks, not their topics.
NEUTRAL_PARTS = frozenset(
    "area bar block bottom box button buttons container inner item items left link links list "
    "main outer page primary right secondary section site top wrap wrapper".split()
)
KEPT_ANYWAY = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: Why a node is left out: not, by a layout name, by another name, by what it is.
NOT, LAYOUT, NAMED, ALWAYS = range(4)


def _level(name: str) -> int:
    """Whether a name is a skipped one, or made of them and of neutral parts alone: with any
    other part (``share-price``, ``no-sidebar``, ``overflow-hidden``) it means something else."""
    parts = [p.lower() for p in NAME_PART.findall(name)]
    words = {p for p in parts if not p.isdigit()} - NEUTRAL_PARTS
    if name.lower() in SKIPPED_NAMES:
        words = {name.lower()}
    if not words or not words <= SKIPPED_NAMES:
        return NOT
    return LAYOUT if words <= LAYOUT_NAMES else NAMED


def _worth(text: str, share: float) -> float:
    """Points of a run of text with this share of links."""
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - share)


class Page:
    """Nodes in document order (a subtree is a range), and the runs of text between them."""

    def __init__(self, source: str) -> None:
        self.tags = ["#root"]
        self.parents = [0]
        self.ends = [0]
        self.skipped = [NOT]
        self.links = [False]
        self.containers = [0]  # the nearest block around a node
        self.within = [False]  # an article or the main part
        self.items: list[tuple[int, str | None]] = []  # (node, text), or None for a boundary
        self.named = [NOT]  # by the node's own name
        self._read(source)
        self._skip_named()

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        self.ends.append(0)
        self.links.append(self.links[parent] or tag == "a")
        self.containers.append(node if tag in BLOCK else self.containers[parent])
        level = self._judge(tag, attributes, parent)
        self.within.append(self.within[parent] or tag in ("article", "main"))
        self.named.append(level if level < ALWAYS else NOT)
        self.skipped.append(max(self.skipped[parent], level if level == ALWAYS else NOT))
        return node

    def _mark(self) -> None:
        for node in range(1, len(self.tags)):
            self.skipped[node] = max(self.skipped[node], self.skipped[self.parents[node]], self.named[node])

    def _skip_named(self) -> None:
        """Mark the subtrees of named nodes, but for layout names around the best container."""
        if not any(self.named):
            return
        always = list(self.skipped)
        self._mark()
        if LAYOUT in self.named:
            blocks = self.blocks(NAMED)
            at = best_of(_scores(self, blocks)[0]) if blocks else 0
            while at:
                if self.named[at] == LAYOUT:
                    self.named[at] = NOT
                at = self.parents[at]
            self.skipped = always
            self._mark()

    def _judge(self, tag: str, attributes: str, parent: int) -> int:
        if tag in SKIPPED:
            return ALWAYS
        if tag == "header":
            return NOT if self.within[parent] else ALWAYS
        if not attributes or tag in KEPT_ANYWAY:
            return NOT
        named = NOT
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id"):
                named = max([named, *map(_level, value.split())])
            elif name == "role" and value.lower() in SKIPPED_ROLES:
                return ALWAYS
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return ALWAYS
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                return ALWAYS
        return named

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        places: dict[str, list[int]] = {}  # depths at which a tag is open
        items = self.items

        def close_to(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                self.ends[node] = len(self.tags)
                places[self.tags[node]].pop()
                if self.tags[node] in BLOCK:
                    items.append((node, None))

        def deepest(tags: set[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def find(tags: set[str], barriers: set[str]) -> int:
            depth = deepest(tags)
            return depth if depth > deepest(barriers) else 0

        size = len(source)
        while at < size:
            match = TOKEN.match(source, at)
            at = match.end()
            tag = match[2]
            if tag is None:
                token = match[0]
                if token[0] != "<" or token == "<":
                    items.append((stack[-1], token))
                elif token.startswith("<![CDATA["):
                    items.append((stack[-1], html.escape(token[9:].removesuffix("]]>"))))
                continue
            tag = tag.lower()
            if match[1]:
                if tag in VOID and tag != "br":
                    continue
                if places.get(tag):
                    depth = find({tag}, set())
                    close_to(depth)
                elif tag in BLOCK:
                    items.append((stack[-1], None))
                continue
            if tag == "br":
                items.append((stack[-1], " "))
                continue
            if tag in BLOCK and tag not in ("html", "body") and places.get("p"):
                depth = find({"p"}, {"table", "td", "th", "button", "caption"})
                if depth:
                    close_to(depth)
            if tag in CLOSES:
                depth = find(*CLOSES[tag])
                if depth:
                    close_to(depth)
            if tag in VOID:
                if tag in BLOCK:
                    items.append((stack[-1], None))
                continue
            if tag in ("html", "body") and places.get(tag):
                continue
            if tag in BLOCK:
                items.append((stack[-1], None))
            node = self._open(tag, match[3], stack[-1])
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                self.ends[node] = len(self.tags)
                continue
            if not match[3].rstrip().endswith("/") or tag in BLOCK or tag == "a":
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
            else:
                self.ends[node] = len(self.tags)
        close_to(1)
        self.ends[0] = len(self.tags)

    def blocks(self, level: int) -> list[tuple[int, str, float]]:
        """Text runs outside nodes skipped at ``level`` or above: block, text, link share."""
        out: list[tuple[int, str, float]] = []
        run: list[str] = []
        linked = total = 0
        owner = -1

        def flush() -> None:
            nonlocal run, linked, total, owner
            if run:
                text = SPACES.sub(" ", html.unescape("".join(run))).strip()
                if text:
                    out.append((owner, text, linked / max(total, 1)))
            run, linked, total, owner = [], 0, 0, -1

        for node, text in self.items:
            if text is None:
                flush()
            elif self.skipped[node] < level:
                if owner < 0 or not run:
                    owner = self.containers[node]
                run.append(text)
                size = len(text.strip())
                total += size
                linked += size if self.links[node] else 0
        flush()
        return out


def _scores(page: Page, blocks: list[tuple[int, str, float]]) -> tuple[dict[int, float], list[int], list[int]]:
    """Points of every container, and text and link lengths of every subtree."""
    points: dict[int, float] = {}
    length, linked = [0] * len(page.tags), [0] * len(page.tags)
    for node, text, share in blocks:
        length[node] += len(text)
        linked[node] += int(len(text) * share)
        worth = _worth(text, share)
        at = page.parents[node] if page.tags[node] in PARAGRAPH else node
        for part in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            points[at] = points.get(at, 0) + worth * part
            if not at:
                break
            at = page.parents[at]
    for node in range(len(page.tags) - 1, 0, -1):
        length[page.parents[node]] += length[node]
        linked[page.parents[node]] += linked[node]
    for node in points:
        points[node] *= 1 - linked[node] / max(length[node], 1)
    return points, length, linked


def best_of(points: dict[int, float]) -> int:
    return max(points, key=lambda n: (points[n], -n))


def main_text(source: str | None) -> str:
    """The article's blocks, joined by blank lines; empty if the page has no text."""
    if not source:
        return ""
    page = Page(source)
    blocks = page.blocks(LAYOUT) or page.blocks(NAMED) or page.blocks(ALWAYS)
    if not blocks:
        return ""
    points, length, linked = _scores(page, blocks)
    best = best_of(points)
    whole = best
    while whole and page.tags[whole] not in ("article", "main"):
        whole = page.parents[whole]
    roots: set[int] = set()
    if whole:
        roots.add(whole)
    else:
        limit = max(2.0, 0.2 * points[best])
        parent = page.parents[best]
        for node in range(1, len(page.tags)):
            if page.parents[node] != parent or not best:
                continue
            density = linked[node] / max(length[node], 1)
            if (
                node == best
                or points.get(node, 0) >= limit
                or page.tags[node] in PARAGRAPH and length[node] > 0 and density < 0.25
            ):
                roots.add(node)
        if not best:
            roots.add(0)
    # Text that stands directly in the parent, between the parts, belongs to none of them.
    kept = _under(page, roots)
    inside = [b for b in blocks if kept[b[0]]]
    menus = _under(page, _menus(page, inside, _link_lists(page, length, linked)))
    return "\n\n".join(text for node, text, _ in inside if not menus[node])


def _menus(page: Page, inside: list[tuple[int, str, float]], lists: set[int]) -> set[int]:
    """Link lists before all prose, or after all of it without a heading of their own."""
    under = _under(page, lists)
    listed = [under[node] for node, _, _ in inside]
    heads = [page.tags[node] in HEADINGS for node, _, _ in inside]
    prose = [i for i, own in enumerate(listed) if not own and not heads[i]]
    if not prose:
        return set()
    # First and last block of every subtree.
    first, last = [len(inside)] * len(page.tags), [-1] * len(page.tags)
    for i, (node, _, _) in enumerate(inside):
        first[node], last[node] = min(first[node], i), i
    for node in range(len(page.tags) - 1, 0, -1):
        up = page.parents[node]
        first[up], last[up] = min(first[up], first[node]), max(last[up], last[node])
    menus = set()
    for top in lists:
        lo, hi = first[top], last[top]
        if hi >= 0 and (hi < prose[0] or lo > prose[-1] and not (heads[lo - 1] or heads[lo])):
            menus.add(top)
    return menus


def _link_lists(page: Page, length: list[int], linked: list[int]) -> set[int]:
    """Blocks that are mostly links: at least two thirds of their text, in two links or more."""
    links = [0] * len(page.tags)
    for node in range(len(page.tags) - 1, 0, -1):
        links[node] += page.tags[node] == "a"
        links[page.parents[node]] += links[node]
    return {
        n for n in range(1, len(page.tags))
        if page.tags[n] in ("ul", "div", "section")
        and links[n] > 1 and 3 * linked[n] > 2 * length[n]
    }


def _under(page: Page, marked: set[int]) -> list[bool]:
    """Whether each node is a marked one or below it."""
    out = [n in marked for n in range(len(page.tags))]
    for node in range(1, len(out)):
        out[node] = out[node] or out[page.parents[node]]
    return out


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` but ``html``, with ``text`` and ``n_chars`` (replaced if there
    already). Null and empty pages, and pages without text, have an empty text. Rows are
    independent of each other; repeated rows repeat their result."""
    batch_rows(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in ("html", "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s) for s in column(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[column(batch, f.name) for f in kept],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                [*[f.name for f in kept], "text", "n_chars"],
            )

    schema = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*[f.name for f in kept], F.col("html")).mapInArrow(run, schema)
