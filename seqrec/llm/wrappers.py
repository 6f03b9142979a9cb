"""Main text of web pages by union-free wrappers.

The pages of a host are aligned one after another with what has been inferred so far.  A wrapper is a regular expression without
unions over elements: every element and text of it occurs once, optionally, repeatedly or both, and a text is a constant or a slot.
Siblings that repeat, alone or in groups of two or three, fold into one repeated group; what has no partner in the other
page becomes optional; texts that differ become slots.  Alignment is associative enough to be summed like a count: each
partition folds its own pages by host, and the few wrappers left by host are folded again.

A page is read with its host's wrapper: constant texts are template, and the main text is what the slots
hold, without the elements that are menus, headers, footers, asides, forms, notices, adverts or comments by name.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm.ship import ship

# Element and class names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe template svg math select button".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
#: What an opening element closes, when it is open further in than the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}
APART = frozenset("nav footer aside form menu dialog head".split())
APART_NAMES = frozenset("""ad ads adslot advert adverts advertisement adsense banner sponsor sponsored promo promotion sidebar comment comments reply replies respond
disqus footer nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
subscription share sharing social related recommended widget widgets pagination pager login signup search copyright disclaimer toolbar""".split())
HEAD_NAMES = frozenset("header masthead topbar".split())
BODY_NAMES = ("article", "story", "post", "entry", "content", "main")

#: Elements nested deeper are read as part of the one above, block by block.
DEEPEST = 150

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|([^<]+|<(?![/a-zA-Z]))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Element:
    """tag, label (tag with class, id and role), names (their words), children: elements and texts (str, whether inside a link)."""

    __slots__ = ("tag", "label", "names", "children", "hidden")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.label, self.names, self.children, self.hidden = tag, tag, frozenset(), [], False
        if attributes and "=" in attributes or "hidden" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            marks = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            if marks.strip():
                self.names = frozenset(w.lower() for w in _NAME.findall(marks))
                self.label = f"{tag}.{' '.join(sorted(found.get('class', '').split()))}#{re.sub(r'[0-9]+', '0', found.get('id', ''))}"
            self.hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None


def parse(page: str) -> Element:
    """The block elements of a page as a tree; inline markup is dropped, its text stays with the block around it."""
    root = Element("", "")
    stack = [root]
    raw, linked, at, deep = "", False, 0, 0
    while at < len(page):
        if raw:
            end = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at, raw = end.end() if end else len(page), ""
            continue
        m = _TOKEN.match(page, at)
        if m is None:  # an attribute's quote never closes
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        at = m.end()
        if m[4] is not None:
            stack[-1].children.append((html.unescape(m[4]), linked))
            continue
        if m[2] is None or not page.endswith(">", 0, at):
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag in RAW:
                raw = "" if m[3].endswith("/") else tag
                stack[-1].children.append((" ", False))
            elif tag in VOID:
                stack[-1].children.append((" ", False))
            elif tag in BLOCKS:
                linked = False
                if len(stack) > DEEPEST:
                    deep += 1
                    stack[-1].children.append(Element("", ""))
                    continue
                if tag not in ("html", "body", "head") and stack[-1].tag == "p":
                    stack.pop()
                closes, until = CLOSES.get(tag, ((), ()))
                if closes:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in closes:
                            del stack[k:]
                            break
                        if stack[k].tag in until:
                            break
                new = Element(tag, m[3])
                stack[-1].children.append(new)
                stack.append(new)
            elif tag == "a":
                linked = True
        elif tag == "a":
            linked = False
        elif tag in BLOCKS and deep:
            deep -= 1
            stack[-1].children.append(Element("", ""))
        elif tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    linked = False
                    break
    return root


# A wrapper is [label, optional, repeated, pages, hash of a constant text or 0, children]; the label of a text is "#" and of a
# repeated group of several siblings "(" and their labels.

def _fold(children: list) -> list:
    """Neighbours that repeat, alone or as groups of two or three, become one repeated node."""
    for width in (1, 2, 3):
        out, k = [], 0
        while k < len(children):
            unit = children[k:k + width]
            labels = [c[0] for c in unit]
            n = 1
            while [c[0] for c in children[k + n * width:k + (n + 1) * width]] == labels and len(unit) == width:
                n += 1
            if n == 1 or "#" in labels and width == 1:
                out.append(children[k])
                k += 1
                continue
            if width == 1:
                node = unit[0]
                for other in children[k + 1:k + n]:
                    node = align(node, other, True)
                out.append([node[0], node[1], True, 1, node[4], node[5]])
            else:
                group = [f"({' '.join(labels)})", False, True, 1, 0, unit]
                for j in range(1, n):
                    group = align(group, [group[0], False, True, 1, 0, children[k + j * width:k + (j + 1) * width]], True)
                out.append([group[0], False, True, 1, 0, group[5]])
            k += n * width
        children = out
    return children


def wrapper_of(element: Element) -> list:
    """The wrapper that matches one page only."""
    children, text = [], []
    for child in [*element.children, None]:
        if isinstance(child, tuple):
            text.append(child[0])
            continue
        joined = " ".join("".join(text).split())
        text = []
        if joined:
            children.append(["#", False, False, 1, int.from_bytes(blake2b(joined.encode("utf-8", "replace"), digest_size=7).digest()) + 1, []])
        if child is not None:
            children.append(wrapper_of(child))
    return [element.label, False, False, 1, 0, _fold(children)]


def _partners(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of equal labels that go together, in order: a longest common subsequence, for lists of any length.

    Row i holds as bits where the length for left[i:] and right[j:] falls by one from j to j + 1, so a row is a few operations
    on whole numbers.  Every s-th row is kept and the s rows between are made again when the walk comes to them.
    """
    n, m = len(left), len(right)
    step, full = max(1, int(n ** 0.5)), (1 << m) - 1
    places: dict[str, list[int]] = {}
    for j, name in enumerate(right):
        places.setdefault(name, []).append(m - 1 - j)
    # bit m - 1 - j stands for place j: a list is read from its end
    where = {name: sum(1 << b for b in bits) if len(bits) < 64 else int("".join("1" if r == name else "0" for r in right), 2) for name, bits in places.items()}

    def above(row: int, name: str) -> int:
        common = row & where.get(name, 0)
        return ((row + common) | (row - common)) & full

    kept, row = {n: full}, full  # a 0 stands for a fall
    for i in range(n - 1, -1, -1):
        row = above(row, left[i])
        if i % step == 0:
            kept[i] = row
    out, i, j, rows, low = [], 0, 0, [], 0
    while i < n and j < m:
        if not rows or i >= low + len(rows) - 1:
            low = i
            top = min(n, (i // step + 1) * step)
            rows = [kept[top]]
            for k in range(top - 1, i - 1, -1):
                rows.append(above(rows[-1], left[k]))
            rows.reverse()
        if left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        here, below = rows[i - low], rows[i + 1 - low]
        if not here >> (m - 1 - j) & 1:  # nothing is lost below, as the next place of the right side is worse
            i += 1
            continue
        rest = (1 << (m - j)) - 1
        if (here & rest).bit_count() == (below & rest).bit_count():
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list, one_page: bool = False) -> list:
    """The wrapper of what either matches; both have the same label.

    Parts of one page count as one page, and different texts of them are a slot only when another page has others.
    """
    left, right = a[5], b[5]
    if [c[0] for c in left] == [c[0] for c in right]:
        children = [align(x, y, one_page) for x, y in zip(left, right)]
    else:
        children, i, j = [], 0, 0
        for x, y in [*_partners([c[0] for c in left], [c[0] for c in right]), (len(left), len(right))]:
            children += [[c[0], True, *c[2:]] for c in (*left[i:x], *right[j:y])]
            if x < len(left):
                children.append(align(left[x], right[y], one_page))
            i, j = x + 1, y + 1
    if one_page:
        mark = a[4] if a[4] == b[4] else int.from_bytes(blake2b(f"{a[4]} {b[4]}".encode(), digest_size=7).digest()) + 1
        return [a[0], a[1] or b[1], a[2] or b[2], max(a[3], b[3]), mark, children]
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], a[4] if a[4] == b[4] else 0, children]


def _varies(wrapper: list) -> bool:
    return wrapper[0] == "#" and not wrapper[4] or any(map(_varies, wrapper[5]))


def _apart(e: Element, inside: bool) -> bool:
    if e.hidden or e.tag in APART or (e.tag == "header" and not inside):
        return True
    if e.names & (APART_NAMES if inside else APART_NAMES | HEAD_NAMES):
        return e.tag not in ("body", "html") and not any(c.tag in ("article", "main") and not c.names & APART_NAMES for c in _below(e))
    return False


def _below(e: Element) -> Iterator[Element]:
    for c in e.children:
        if isinstance(c, Element):
            yield c
            yield from _below(c)


def _roots(e: Element) -> list[Element]:
    """The elements that hold the article, in page order: main or articles, else all named elements, else the page."""
    found: dict[str, list[Element]] = {"main": [], "article": [], "named": []}

    def visit(x: Element, kinds: tuple[str, ...]) -> None:
        for c in x.children:
            if not isinstance(c, Element) or _apart(c, False):
                continue
            kind = "main" if c.tag == "main" or "main" in c.names and c.tag == "div" and c.label.endswith("main") else c.tag if c.tag == "article" else "named" if c.names & {*BODY_NAMES} and c.tag not in ("body", "html") else ""
            if kind and kind not in kinds:
                found[kind].append(c)
            visit(c, (*kinds, kind) if kind else kinds)

    visit(e, ())
    if found["article"] or found["main"]:
        return found["article"] or found["main"]
    return found["named"] or [e]


def main_text(page: str, wrapper: list | None = None, least_pages: int = 5, most_linked: float = 0.6, least_share: float = 0.2) -> str:
    """Blocks of the article in page order, joined by an empty line.

    A text that the wrapper has as a constant of at least `least_pages` pages and `least_share` of all its pages is template, if
    anything in the wrapper varies; infer() counts pages with different articles.  In
    a page without elements named as the article, a list most of whose text is links counts as a menu.
    """
    tree = parse(page)
    roots = {id(r) for r in _roots(tree)}
    least = max(least_pages, least_share * wrapper[3]) if wrapper is not None else 0
    template = wrapper is not None and wrapper[3] >= least_pages and _varies(wrapper)
    blocks: list[str] = []

    def visit(e: Element, w: list | None, taking: bool, inside: bool) -> None:
        if id(e) in roots:
            taking, inside = True, True
        elif _apart(e, inside):
            return
        if id(tree) in roots and e.tag in ("ul", "ol", "table", "dl"):
            texts = [t for x in (e, *_below(e)) for t in x.children if isinstance(t, tuple)]
            whole = sum(len(t[0].strip()) for t in texts)
            if sum(t[1] for t in texts) > 2 and sum(len(t[0].strip()) for t in texts if t[1]) > most_linked * whole:
                return
        known = {}
        for c in w[5] if w else ():
            for x in c[5] if c[0].startswith("(") else (c,):
                known.setdefault(x[0], []).append(x)
        text: list[str] = []
        for child in [*e.children, None]:
            if isinstance(child, tuple):
                text.append(child[0])
                continue
            joined = " ".join("".join(text).split())
            text = []
            if joined and taking:
                mark = int.from_bytes(blake2b(joined.encode("utf-8", "replace"), digest_size=7).digest()) + 1 if template else -1
                if not any(x[4] == mark and x[3] >= least for x in known.get("#", ())):
                    blocks.append(joined)
            if child is not None:
                visit(child, next(iter(known.get(child.label, ())), None), taking, inside)

    visit(tree, wrapper, False, False)
    return "\n\n".join(blocks)


def _wrappers(batches):
    """Folds the pages of each host in a partition, a page at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = wrapper_of(parse(page or ""))
            held[host] = align(held[host], new) if host in held else new
            if len(held) >= 10_000:
                yield _rows(held)
                held = {}
    yield _rows(held)


def _rows(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])


def _joined(table: pa.Table) -> pa.Table:
    whole = None
    for text in sorted(table["wrapper"].to_pylist()):
        new = json.loads(text)
        whole = new if whole is None else align(whole, new)
    return pa.table({"host": table["host"][:1], "wrapper": pa.array([json.dumps(whole)])})


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", spread: int = 32) -> DataFrame:
    """(host, wrapper as JSON) from all pages; a page without a host belongs to host ''.

    Pages of a host with the same article (as element names alone tell it) are copies: the least of them stands for all.
    Partitions fold their own pages first; then `spread` groups of a host, then the host.
    """
    ship(pages.sparkSession)

    @F.arrow_udf("binary")
    def article(column: pa.Array) -> pa.Array:
        return pa.array([blake2b(main_text(page or "").encode("utf-8", "replace"), digest_size=16).digest() for page in column.to_pylist()], pa.binary())

    some = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    some = some.select("host", "html", article("html").alias("_article")).groupBy("host", "_article").agg(F.min("html").alias("html")).select("host", "html")
    parts = some.mapInArrow(_wrappers, "host string, wrapper string")
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(spread)).alias("_part")).applyInArrow(_joined, "host string, wrapper string")
    return parts.groupBy("host").applyInArrow(_joined, "host string, wrapper string")


def host_of(url_col: str):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col).cast("string")), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))


def extract(pages: DataFrame, wrappers: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without the html, with text (empty if there is none); an existing text column is replaced.

    A null html counts as empty.  A host without a wrapper is read by element names alone.
    """
    ship(pages.sparkSession)

    @F.arrow_udf("string")
    def judge(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str | None, list | None] = {None: None}
        for html_, wrapper in columns:
            out = []
            for page, text in zip(html_.to_pylist(), wrapper.to_pylist()):
                if text not in known:
                    if len(known) > 5000:
                        known = {None: None}
                    known[text] = json.loads(text)
                out.append(main_text(page or "", known[text]))
            yield pa.array(out, pa.string())

    rest = [c for c in pages.columns if c not in (html_col, "text")]
    packed = pages.select(F.struct(*rest).alias("_row"), F.col(html_col).cast("string").alias("_html"), host_of(url_col).alias("_host"))
    joined = packed.join(wrappers.select(F.col("host").alias("_h"), "wrapper"), F.col("_host") == F.col("_h"), "left")
    return joined.select("_row", judge("_html", "wrapper").alias("text")).select("_row.*", "text")
