"""HTML main text by wrapper induction.

Pages of a host share a template. Some different pages of each host (SAMPLE, the smallest by a hash of their source) are
aligned by simple tree matching: nodes match if their signatures are equal, and the children of matched nodes are matched
in order so that most nodes match. The aligned trees grow into the host's wrapper. Block texts that are the same on nearly
all different pages of a host, or of the host's pages with one outline, are constant: template. All pages are counted for
this, each source once; a group of fewer than FEWEST pages has no constants, as nothing tells its template from its
content. Slots whose text varies are content; the wrapper's main slot is the one below which the varying running text lies,
with the varying headings that stand before it and the leads between. Every page of the host is then aligned with the
wrapper, and its main slot gives the text. A page that does not fit, or whose host has no wrapper, is judged by its own tree
in the same way. Article elements come first: all of them that do not lie in one another, in page order, with what headings
and paragraphs a main element has before them; then main elements.

Menus, adverts, forms and comments vary too. They are known by their elements; by names only where a whole name says so
("ad", "comment-list", not "search-results" or "related-work"), and never where such an element holds the page's only
first heading or nearly all of its running text.

Trees of any depth are read. Below DEEP levels of containers, trees are not aligned any more; their text is kept whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import materialize
from strataflow.llm.html_tree import BLOCKS, Element, parse

#: Pages aligned for each host, fewest for constant texts, the share that a constant text is on.
SAMPLE, FEWEST, CONSTANT = 24, 5, 0.9
#: A descendant slot must hold this share of the running text, and its parent no text of its own, to be taken instead.
HOLDS = 0.9
#: Levels of containers that are aligned.
DEEP = 100
# Elements and names (of class, id or role) that are never the article's text.
NEVER = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea label iframe object embed svg canvas "
    "audio video menu dialog title".split()
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs footer sidebar aside widget widgets cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments disqus reply replies respond related recommended recommendations share sharing "
    "social pagination pager toolbar masthead complementary contentinfo search".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
LEAVES = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "pre", "figcaption", "address", "legend", "summary"}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


# Words that say nothing of what an element is for: beside them, a name of NAMES is still the whole name.
PLAIN = frozenset(
    "area articles bar block body bottom box button buttons card col column container content div form group header icons inner item items left "
    "link links list main module outer panel popular posts right row section slot small stories title top unit wrap wrapper".split()
)


def is_named(node: Element) -> bool:
    """Whether a whole name of the element's says that it is boilerplate."""
    for key in ("class", "id", "role"):
        for name in node.attrs.get(key, "").split():
            words = [x.lower() for x in _NAME.findall(name)]
            if any(x in NAMES for x in words) and all(x in NAMES or x in PLAIN for x in words):
                return True
    return False


def _running(node: Element) -> tuple[int, int]:
    """Characters of text outside links and of elements that are never the article's, and the number of first headings."""
    total, first, todo = 0, 0, [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                total += len(child.strip())
            elif child.tag not in NEVER and child.tag != "a":
                first += child.tag == "h1"
                todo.append(child)
    return total, first


def _holds_the_page(node: Element) -> bool:
    """Whether a named element has nearly all of the page's running text, or its only first heading and half of the text."""
    top = node
    while top.parent is not None and top.tag != "body":
        top = top.parent
    (own, first), (whole, heads) = _running(node), _running(top)
    return own > 0 and (own >= HOLDS * whole or (first == heads == 1 and 2 * own >= whole))


def is_boilerplate(node: Element) -> bool:
    if node.drop is None:
        node.drop = _is_boilerplate(node)
    return node.drop


def _is_boilerplate(node: Element) -> bool:
    if node.tag in NEVER:
        return True
    attrs = node.attrs
    if attrs:
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
            return True
        if node.tag not in ("html", "body", "article", "main") and is_named(node) and not _holds_the_page(node):
            return True
    if node.tag == "header" or "header" in attrs.get("role", ""):
        # a page's header goes, an article's own stays
        up = node.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        return up is None
    return False


def blocks(node: Element, out: list[str], skip: bool = True) -> None:
    """The block texts below a node, in order, white space as one space, without boilerplate."""
    line: list[str] = []

    def close() -> None:
        if line:
            text = " ".join("".join(line).split())
            if text:
                out.append(text)
            line.clear()

    # Each open element's children still to come, and whether it ends a line when they are done.
    todo: list[tuple[Iterator[Element | str], bool]] = [(iter(node.children), True)]
    while todo:
        rest, ends = todo[-1]
        child = next(rest, None)
        if child is None:
            todo.pop()
            if ends:
                close()
        elif isinstance(child, str):
            line.append(child)
        elif skip and is_boilerplate(child):
            if child.tag in BLOCKS:
                close()
        elif child.tag == "br":
            line.append(" ")
        else:
            block = child.tag in BLOCKS
            if block:
                close()
            todo.append((iter(child.children), block))


class Slot:
    """A node of a page's outline or of a wrapper: an element with blocks below it, or a run of leaf blocks of one kind."""

    __slots__ = ("children", "count", "head", "id", "nodes", "own", "sign", "text")

    def __init__(self, sign: str, nodes: list[Element]) -> None:
        self.sign, self.nodes, self.children, self.id = sign, nodes, [], -1
        self.own = self.text = 0.0  # characters of running text outside links: here, and here and below
        self.count, self.head = 1, False  # head: a heading that varies


def _weigh(node: Element) -> float:
    """Characters of running text outside links, boilerplate and headings."""
    total, todo = 0, [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, str):
                total += len(child.strip())
            elif child.tag != "a" and child.tag not in HEADINGS and not is_boilerplate(child):
                todo.append(child)
    return total


def outline(node: Element, seen: Callable[[Element], bool] | None = None) -> Slot:
    """The tree of containers; neighbouring leaf blocks of one signature are one slot. Texts of leaves that seen() knows weigh nothing."""
    top = Slot(signature(node), [node])
    todo, made = [(top, node, 0)], []
    while todo:
        slot, here, depth = todo.pop()
        made.append(slot)
        for child in here.children:
            if isinstance(child, str):
                slot.own += len(child.strip())
            elif child.tag in ("script", "style", "head") or child.tag not in BLOCKS:
                if child.tag not in NEVER and child.tag != "a":
                    slot.own += _weigh(child)
            elif child.tag in LEAVES or depth == DEEP:
                sign = signature(child)
                if not slot.children or slot.children[-1].sign != sign or slot.children[-1].nodes[0].tag not in LEAVES:
                    slot.children.append(Slot(sign, []))
                last = slot.children[-1]
                last.nodes.append(child)
                if not is_boilerplate(child) and not (seen and seen(child)):
                    if child.tag in HEADINGS:
                        last.head = True
                    else:
                        last.own += _weigh(child)
            else:
                below = Slot(signature(child), [child])
                slot.children.append(below)
                if not is_boilerplate(child):
                    todo.append((below, child, depth + 1))
    for slot in reversed(made):  # a slot comes before those below it
        slot.text = slot.own + sum(c.text if c.children else c.own for c in slot.children)
    for slot in made:
        for c in slot.children:
            if not c.children:
                c.text = c.own
    return top


def signature(node: Element) -> str:
    kind = node.attrs.get("class", "").split()
    return node.tag + (f".{kind[0]}" if kind else "") + (f"#{node.attrs['id']}" if "id" in node.attrs and not any(c.isdigit() for c in node.attrs["id"]) else "")


def match(a: Slot, b: Slot, memo: dict[tuple[int, int], tuple[int, list[list[int]]]]) -> int:
    """Simple tree matching: the most nodes two ordered trees with equal roots have in common."""
    if a.sign != b.sign:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        m, n = len(a.children), len(b.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            row, over = best[i + 1], best[i]
            for j in range(n):
                w = match(a.children[i], b.children[j], memo)
                row[j + 1] = max(row[j], over[j + 1], over[j] + w)
        memo[key] = (best[m][n] + 1, best)
    return memo[key][0]


def matched(a: Slot, b: Slot, memo: dict[tuple[int, int], tuple[int, list[list[int]]]]) -> Iterator[tuple[Slot, Slot]]:
    """The matched pairs of nodes, parents first."""
    yield a, b
    best = memo[id(a), id(b)][1]
    i, j, pairs = len(a.children), len(b.children), []
    while i and j:
        x, y = a.children[i - 1], b.children[j - 1]
        if x.sign == y.sign and best[i][j] == best[i - 1][j - 1] + memo[id(x), id(y)][0]:
            pairs.append((x, y))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    for x, y in reversed(pairs):
        yield from matched(x, y, memo)


def _body(root: Element) -> Element:
    todo = [root]
    while todo:
        node = todo.pop(0)
        if node.tag == "body":
            return node
        if node.tag in ("", "html"):
            todo.extend(c for c in node.children if isinstance(c, Element))
    return root


def _leads(main: Element) -> list[Element]:
    """The headings and paragraphs of a main element before its first article."""
    found: list[Element] = []
    todo: list[Element] = [main]
    while todo:
        node = todo.pop()
        if node.tag == "article":
            return found
        if node is not main and node.tag in HEADINGS | {"p"}:
            found.append(node)
        else:
            todo.extend(c for c in reversed(node.children) if isinstance(c, Element) and not is_boilerplate(c))
    return found


def articles(body: Element) -> list[Element]:
    """All article elements that are outermost and not boilerplate, with what a main element has before them, in page order; else the main element."""
    found: dict[str, list[Element]] = {"main": [], "article": []}
    todo = [body]
    while todo:
        node = todo.pop()
        if node.tag in found:
            found[node.tag].append(node)
            if node.tag == "article":
                continue
        todo.extend(c for c in reversed(node.children) if isinstance(c, Element) and not is_boilerplate(c))
    inside = [x for x in found["article"] if _weigh(x)] or found["article"][:1]
    if not inside:
        return found["main"][:1]
    for main in found["main"]:
        up = inside[0].parent
        while up is not None and up is not main:
            up = up.parent
        if up is main:
            return _leads(main) + inside
    return inside


def _has_head(slot: Slot) -> bool:
    todo = [slot]
    while todo:
        here = todo.pop()
        if here.head:
            return True
        todo.extend(here.children)
    return False


def main_slots(root: Slot) -> list[Slot]:
    """From the root down to where the running text lies, as long as next to none is left behind; before it, headings that were passed and leads after them."""
    here, before = root, []
    while True:
        inner = [c for c in here.children if c.nodes and c.nodes[0].tag not in LEAVES]
        best = max(inner, key=lambda c: c.text, default=None)
        left = here.own + sum(c.text for c in here.children if c not in inner)
        if best is None or left or best.text < HOLDS * here.text or not best.text:
            return [*before, here]
        for c in here.children[: here.children.index(best)]:
            if c.head or (c.text and before) or (c in inner and c.text and _has_head(c)):
                before.append(c)
        here = best


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _text_crc(node: Element) -> int:
    lines: list[str] = []
    blocks(node, lines)
    return _crc(" ".join(lines))


def page_blocks(source: str) -> tuple[int, list[int]]:
    """A number for the page's outline near the root, and the crc32 of its block texts, each once."""
    body = _body(parse(source))
    lines: list[str] = []
    blocks(body, lines)
    near = [signature(c) for c in body.children if isinstance(c, Element) and c.tag in BLOCKS]
    return _crc(" ".join(sorted(set(near)))), sorted({_crc(x) for x in lines})


def induce(sources: list[str], constant: frozenset[int]) -> dict:
    """A host's wrapper: its outline, the place of the main slot, and the crc32 of its constant block texts."""
    pages = [outline(_body(parse(s)), lambda node: _text_crc(node) in constant) for s in sources]
    wrapper = pages[0]
    for page in pages[1:]:
        memo: dict = {}
        if match(wrapper, page, memo):
            grown = list(matched(wrapper, page, memo))
            for a, b in grown:
                a.count += 1
                a.text += b.text
                a.own += b.own
                a.head = a.head or b.head
            known = {id(b) for _, b in grown}
            for a, b in grown:  # what only this page has becomes optional
                names_here = {c.sign for c in a.children}
                for k, c in enumerate(b.children):
                    if id(c) not in known and c.sign not in names_here:
                        a.children.insert(min(k, len(a.children)), c)
                        names_here.add(c.sign)
    chosen = {id(x) for x in main_slots(wrapper)}
    place: list[int] = []

    def stored(slot: Slot) -> list:
        if id(slot) in chosen:
            place.append(count[0])
        count[0] += 1
        return [slot.sign, [stored(c) for c in slot.children]]

    count = [0]
    tree = stored(wrapper)
    return {"tree": tree, "main": place, "constant": sorted(constant)}


def _loaded(tree: list, count: list[int]) -> Slot:
    slot = Slot(tree[0], [])
    slot.id = count[0]
    count[0] += 1
    slot.children = [_loaded(c, count) for c in tree[1]]
    return slot


def load(raw: str) -> tuple[Slot, list[int], frozenset[int]]:
    found = json.loads(raw)
    return _loaded(found["tree"], [0]), found["main"], frozenset(found["constant"])


def extract(source: str, wrapper: tuple[Slot, list[int], frozenset[int]] | None) -> tuple[str, bool]:
    """The main text, and whether the wrapper gave it."""
    body = _body(parse(source))
    page = outline(body)
    slots, constant, fits = None, frozenset(), False
    if wrapper is not None:
        tree, main, constant = wrapper
        memo: dict = {}
        if match(tree, page, memo):
            found = {a.id: b for a, b in matched(tree, page, memo) if a.id in main}
            fits = main[-1] in found
            slots = [found[i] for i in main if i in found] if fits else None
    lines: list[str] = []
    for x in articles(body) or [n for slot in slots or main_slots(page) for n in slot.nodes]:
        if not (x.tag in LEAVES and is_boilerplate(x)):
            blocks(x, lines)
    kept = [x for x in lines if _crc(x) not in constant] if constant else lines
    return "\n".join(kept), fits


def host_of(url: Column) -> Column:
    """The host in lower case without user and port; '' where there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, by_wrapper of every row.

    A null or empty source has the text ''. Pages without a host form one host. Repeated rows give repeated rows, an empty
    table none; other columns are not looked at. The wrappers are a table joined by host: Spark sends it to every task while
    it is under its limit, and beyond it shuffles both sides and splits hosts that are too large.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")
    ).withColumn("host", host_of(F.col("url")))
    filled = rows.filter(F.length("html") > 0).select("host", "page_id", "html", F.xxhash64("html").alias("hash"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_blocks(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                names=["host", "hash", "kind", "crcs"],
            )

    # Copies of a source count once. A host may hold most pages, so its rows are combined before each shuffle.
    once = filled.select("host", "hash", "html").mapInArrow(counted, "host string, hash long, kind long, crcs array<long>").dropDuplicates(["host", "hash"])
    once = materialize(once, "page-blocks")
    groups = once.select("host", "crcs", F.explode(F.array(F.lit(None).cast("long"), "kind")).alias("kind"))
    sizes = groups.groupBy("host", "kind").agg(F.count("*").alias("pages")).filter(F.col("pages") >= FEWEST)
    shares = groups.select("host", "kind", F.explode("crcs").alias("crc")).groupBy("host", "kind", "crc").agg(F.count("*").alias("n"))
    same = (shares["host"] == sizes["host"]) & shares["kind"].eqNullSafe(sizes["kind"])
    constants = shares.join(sizes, same).filter(F.col("n") >= CONSTANT * F.col("pages")).groupBy(shares["host"]).agg(F.collect_set("crc").alias("constant"))
    constants = materialize(constants, "page-constants")
    # Each task keeps the smallest of its different sources only, before the shuffle and after.
    order = Window.partitionBy("host").orderBy("hash")
    first = once.select("host", "hash").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE).drop("n")
    picked = filled.join(materialize(first, "page-sample"), ["host", "hash"]).groupBy("host", "hash").agg(F.min("html").alias("html"))
    picked = picked.join(constants, "host", "left").select("host", "html", "constant")

    def induced(group: pa.Table) -> pa.Table:
        constant = frozenset(group.column("constant")[0].as_py() or ())
        found = induce(sorted(set(group.column("html").to_pylist())), constant)
        return pa.table({"host": pa.array([group.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(found)], pa.string())})

    wrappers = materialize(picked.groupBy("host").applyInArrow(induced, "host string, wrapper string"), "wrappers")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            out, fits = [], []
            for source, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if raw is not None and raw not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[raw] = load(raw)
                text, fit = extract(source, known[raw] if raw is not None else None)
                out.append(text)
                fits.append(fit)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(out, pa.string()),
                    pa.array([len(x) for x in out], pa.int64()),
                    pa.array(fits, pa.bool_()),
                ],
                names=["page_id", "url", "text", "n_chars", "by_wrapper"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, by_wrapper boolean")
