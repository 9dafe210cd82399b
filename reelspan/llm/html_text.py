"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a tree of containers with text blocks between them. The pages of a host are aligned one
after another: equal neighbours fold into a repeated group, what some pages lack becomes optional,
text becomes a slot. Tasks infer wrappers of the pages they read, and wrappers align with each
other in the same way, so a host of any size never meets in one task. The wrapper tells which
texts belong to the template; all other text is kept, but for what its marks leave out.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import Scratch, map_arrow, slices

#: Fixed sets of element names.
CONTAINERS = frozenset("html body div section article main nav header footer aside form table thead tbody tfoot ul ol dl menu figure fieldset details dialog noscript template center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre address figcaption caption summary legend hr option optgroup label".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp svg select button canvas audio video".split())
VOID_BLOCKS = frozenset(("hr",))
#: Elements, roles and name parts that mark what is not the article.
ASIDE_TAGS = frozenset("nav footer aside form noscript template dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer sidebar notice notices cookie cookies consent gdpr banner alert popup modal comment comments disqus replies respond reply share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget".split())
HEADER_NAMES = frozenset(("header", "masthead", "topbar"))
#: Parts that say how a name's container is built, and such that say what a page is like, not what a container is.
BUILT = frozenset("area bar block body box buttons column col container content group holder icons inner item items left links list outer panel posts region right row section top bottom text title unit wrap wrapper zone".split())
STATES = frozenset("has have is no not with without hide hides show shows hidden enable enabled disable disabled can".split())
#: Elements that names don't mark: they are the page itself.
WHOLE = frozenset("html body main".split())

#: A task passes its wrappers on when it holds this many hosts.
HOSTS_HELD = 500
#: A text that all pages of a host have in one place outside an article element, while other texts
#: differ, is the template's; fewer pages than this are no evidence. Wrappers merged in one group.
TEMPLATE_PAGES, MERGE_SALT = 3, 16
#: Containers that are nested deeper become neighbours of each other, with the marks of those around
#: them; cells of the table of an alignment, beyond which labels are matched in order.
MOST_DEPTH, MOST_CELLS = 100, 1 << 20
#: Bytes of the table of hosts up to which it is broadcast; beyond, pages are joined by host.
BROADCAST_BYTES = 16 << 20

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"([^>\"'<]*+(?:\"[^\"<>]*+\"[^>\"'<]*+|'[^'<>]*+'[^>\"'<]*+)*+)>")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """A container: label, name, whether its marks say it is no article, children (nodes and texts)."""

    __slots__ = ("children", "deep", "header", "label", "name", "outside")

    def __init__(self, name: str, attributes: str = ""):
        names: list[str] = []
        role = ""
        for m in _ATTR.finditer(attributes) if attributes else ():
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                role = value.strip()
            else:
                names += value.split()
        self.name, self.children, self.deep = name, [], False
        self.label = ".".join([name, *sorted(re.sub(r"\d+", "0", n) for n in set(names))])
        self.outside = name in ASIDE_TAGS or role in ASIDE_ROLES or marks(name, names, ASIDE_NAMES)
        self.header = name == "header" or marks(name, names, HEADER_NAMES)

    def again(self) -> Node:
        """A container of the same label and marks, without children."""
        other = Node(self.name)
        other.label, other.outside, other.header, other.deep = self.label, self.outside, self.header, self.deep
        return other


def marks(element: str, names: list[str], known: frozenset[str]) -> bool:
    """Whether a name says that an element is one of ``known``: the whole name, its last part (``site-footer``),
    or its first where the rest tells how it is built (``comments-area``). Names of states (``has-sidebar``) and of other
    things (``social-post``) don't, nor any name of the page itself; an article is marked by whole names only."""
    if element in WHOLE:
        return False
    for name in names:
        parts = [p for p in re.split(r"[-_:.]+", re.sub(r"\d+", "", name)) if p]
        if not parts or parts[0] in STATES:
            continue
        if len(parts) == 1 or element == "article":
            found = len(parts) == 1 and parts[0] in known
        else:
            found = parts[-1] in known or parts[0] in known and all(p in BUILT or p in known for p in parts[1:])
        if found:
            return True
    return False


class Tags:
    """Finds the tags of a page in time that grows with its length alone."""

    def __init__(self, source: str):
        self.source, self.last, self.spent, self.missing = source, source.rfind(">"), 0, set()

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin at ``at``: at the first > outside quotes, or, where
        quotes don't close, at the first one of all. What is read in vain is counted, and after some
        times the page's length quotes are not looked at any more."""
        place = at
        while self.spent <= 8 * len(self.source) and (m := _MARK.search(self.source, place)):
            if m[0] == ">":
                return m.start()
            place = self.source.find(m[0], m.end()) + 1
            if not place:
                break
        self.spent += len(self.source) - at
        return self.source.find(">", at)

    def __iter__(self):
        """(start, end, name in lower case or empty, whether it closes, attributes) of each tag and comment.
        ``skip`` moves the end."""
        self.at = 0
        while m := _OPEN.search(self.source, self.at):
            if m[1]:
                stop = self.source.find("-->", m.end())
                self.at = stop + 3 if stop >= 0 else len(self.source)
                yield m.start(), self.at, "", False, ""
                continue
            if m.end() > self.last:
                return
            if m[2]:
                self.at = self.source.find(">", m.end()) + 1
                yield m.start(), self.at, "", False, ""
                continue
            rest = _REST.match(self.source, m.end())
            stop = rest.end() - 1 if rest else self.end(m.end())
            self.at = stop + 1
            yield m.start(), self.at, m[4].lower(), bool(m[3]), rest[1] if rest else self.source[m.end() : stop]

    def skip(self, name: str) -> bool:
        """Moves behind the end tag of a raw element, if there is one."""
        if name in self.missing:
            return False
        end = _RAW_ENDS[name].search(self.source, self.at)
        if end is None:
            self.missing.add(name)
            return False
        self.at = end.end()
        return True


_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def parse(source: str) -> Node:
    """The tree of a page. Forgiving: unknown ends are ignored, open elements end with their parent.
    Takes time in proportion to the page, whatever is nested or left open in it."""
    root, tags = Node("#root"), Tags(source)
    stack, held, at = [root], [], 0
    open_names: Counter = Counter()

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                node = stack[-1]
                if node.deep and stack[MOST_DEPTH].children[-1] is not node:  # a neighbour came in between
                    node = stack[-1] = node.again()
                    stack[MOST_DEPTH].children.append(node)
                node.children.append(text)

    for start, end, name, closing, attributes in tags:
        held.append(source[at:start])
        at = end
        if not name:
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                if tags.skip(name):
                    at = tags.at
                elif name in ("script", "style"):
                    at = tags.at = len(source)
        elif name in CONTAINERS:
            flush()
            if not closing:
                if attributes.endswith("/"):
                    continue
                node = Node(name, attributes)
                if len(stack) > MOST_DEPTH:
                    node.deep, above = True, stack[-1]
                    if above.deep and not is_article(node):
                        node.outside, node.header = node.outside or above.outside, node.header or above.header
                    stack[MOST_DEPTH].children.append(node)
                else:
                    stack[-1].children.append(node)
                stack.append(node)
                open_names[name] += 1
            elif open_names[name]:
                while True:
                    gone = stack.pop().name
                    open_names[gone] -= 1
                    if gone == name:
                        break
        elif name in BLOCKS or name == "head":
            flush()
        elif name == "br":
            held.append(" ")
    held.append(source[at:])
    flush()
    return root


def is_article(node: Node) -> bool:
    """Whether a container is marked as the article itself."""
    return node.name in ("article", "main")


def holds_article(node: Node) -> bool:
    """Whether an article lies below."""
    todo = [node]
    while todo:
        for child in todo.pop().children:
            if isinstance(child, Node):
                if is_article(child):
                    return True
                todo.append(child)
    return False


def left_out(node: Node, in_article: bool) -> bool:
    """Whether a container and all below is no part of an article."""
    return (node.outside or node.header and not in_article) and not (is_article(node) and node.name == "main") and not holds_article(node)


def text_hash(text: str) -> str:
    """A hash of a text, long enough that no two texts of a host share it."""
    return blake2b(text.encode(), digest_size=12).hexdigest()


def wrapper_of(node: Node, in_article: bool = False) -> dict:
    """The wrapper of one page's tree: l(abel), x (left out), a (an article lies below), c(hildren) as
    [wrapper or slot, optional, repeated]; both have n (pages) and h (hash of the text, of a wrapper
    that of all below, or None when it differs between pages)."""
    children, texts = [], []

    def slot() -> None:
        if texts:
            joined = "\n\n".join(texts)
            children.append([{"n": 1, "h": text_hash(joined)}, False, False])
            texts.clear()

    inside = in_article or is_article(node)
    for child in node.children:
        if isinstance(child, str):
            texts.append(child)
        else:
            slot()
            children.append([wrapper_of(child, inside), False, False])
    slot()
    below = any(c[0].get("a") or label(c).split(".")[0] in ("article", "main") for c in children)
    return {"l": node.label, "x": left_out(node, in_article), "a": below, "n": 1, "h": hash_below(children), "c": folded(children)}


def hash_below(children: list[list]) -> str:
    """The hash of a container's text, from those of its children."""
    return text_hash(" ".join(f"{label(c)} {c[0]['h']}" for c in children))


def hash_of(node: Node) -> str:
    """The same, from the tree."""
    children, texts = [], []
    for child in [*node.children, None]:
        if isinstance(child, str):
            texts.append(child)
            continue
        if texts:
            children.append([{"h": text_hash("\n\n".join(texts))}])
            texts = []
        if child:
            children.append([{"l": child.label, "h": hash_of(child)}])
    return hash_below(children)


def label(item: list) -> str:
    """What an item aligns by."""
    return item[0].get("l", "#")


def folded(items: list[list]) -> list[list]:
    """Folds neighbours that repeat: a b a b a becomes (a b)+ with the last part optional, as
    repeated items that follow each other."""
    out: list[list] = []
    for item in items:
        out.append(item)
        for size in range(1, 5):
            if len(out) >= 2 * size and all(label(out[-i - size]) == label(out[-i]) for i in range(1, size + 1)):
                for i in range(size, 0, -1):
                    out[-i - size] = [merged(out[-i - size][0], out[-i][0], same_page=True), out[-i - size][1] or out[-i][1], True]
                del out[-size:]
                break
    return out


def merged(a: dict, b: dict, same_page: bool = False) -> dict:
    """The wrapper that covers two wrappers of the same label."""
    both = {"n": a["n"] + (0 if same_page else b["n"]), "h": a["h"] if a["h"] == b["h"] and not same_page else None}
    if "l" not in a:
        return both
    return {"l": a["l"], "x": a["x"] and b["x"], "a": a["a"] or b["a"], "c": aligned(a["c"], b["c"])} | both


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Aligns two sequences on their longest common subsequence of labels; the rest is optional."""
    if [label(x) for x in a] == [label(x) for x in b]:
        pairs = [(i, i) for i in range(len(a))]
    elif len(a) * len(b) > MOST_CELLS:
        pairs, places, j = [], {}, 0
        for k, x in enumerate(b):
            places.setdefault(label(x), []).append(k)
        for i, x in enumerate(a):  # each with the next place of its label
            own = places.get(label(x), [])
            k = bisect_left(own, j)
            if k < len(own):
                pairs.append((i, own[k]))
                j = own[k] + 1
    else:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if label(a[i]) == label(b[j]) else max(best[i + 1][j], best[i][j + 1])
        pairs, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if label(a[i]) == label(b[j]):
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [[x[0], True, x[2]] for x in a[i:p]] + [[x[0], True, x[2]] for x in b[j:q]]
        if p < len(a):
            out.append([merged(a[p][0], b[q][0]), a[p][1] or b[q][1], a[p][2] or b[q][2]])
        i, j = p + 1, q + 1
    return folded_optional(out)


def folded_optional(items: list[list]) -> list[list]:
    """Folds neighbours of one label that the alignment left beside each other."""
    out: list[list] = []
    for item in items:
        if out and label(out[-1]) == label(item):
            out[-1] = [merged(out[-1][0], item[0]), out[-1][1] and item[1], True]
        else:
            out.append(item)
    return out


def template(w: dict) -> dict:
    """The template texts of a host's wrapper by their places: for each container on the way, and for
    the slot or container at the end, its number among the neighbours of its label and the label, with the
    hash of its text. A place counts if every page has it once and so has all of its label before it,
    so it is the same in each page of the host. Nothing inside an article element is template, nor
    is anything where no text differs between pages."""
    varied = False

    def walk(node: dict, sure: bool) -> dict:
        nonlocal varied
        out: dict = {}
        seen: Counter = Counter()
        unsure: set[str] = set()
        for item in node["c"]:
            (child, optional, repeated), name = item, label(item)
            place = f"{seen[name]}:{name}"
            seen[name] += 1
            if optional or repeated:
                unsure.add(name)
            here = sure and name not in unsure
            same = child["h"] is not None and child["n"] >= TEMPLATE_PAGES
            if "l" not in child:
                varied = varied or child["h"] is None
                if here and same:
                    out[place] = child["h"]
            elif child["x"]:
                continue
            elif here and same and not child["a"] and name.split(".")[0] not in ("article", "main"):
                out[place] = child["h"]
            elif below := walk(child, here and name.split(".")[0] != "article"):
                out[place] = below
        return out

    fixed = walk(w, True)
    return fixed if varied else {}


def main_text(source: str, fixed: dict | None) -> str:
    """The article of a page: its blocks without what is left out and what is its host's template.
    Of a container that is left out but for an article below, only the article counts."""
    out: list[str] = []

    def take(node: Node, inside: bool, shut: bool, fixed: dict) -> None:
        run: list[str] = []
        seen: Counter = Counter()

        def place(name: str):
            if not fixed:
                return None
            seen[name] += 1
            return fixed.get(f"{seen[name] - 1}:{name}")

        def close() -> None:
            if run:
                known = place("#")
                if not shut and not (known and known == text_hash("\n\n".join(run))):
                    out.extend(run)
                run.clear()

        shut = not is_article(node) and (shut or node.outside or node.header and not inside)
        inside = inside or is_article(node)
        for child in node.children:
            if isinstance(child, str):
                run.append(child)
            else:
                close()
                below = place(child.label)
                if not left_out(child, inside) and not (isinstance(below, str) and below == hash_of(child)):
                    take(child, inside, shut, below if isinstance(below, dict) else {})
        close()

    take(parse(source), False, False, fixed or {})
    return "\n\n".join(out)


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def infer(pages: DataFrame) -> DataFrame:
    """(host, place): what extraction needs of each host's wrapper. ``pages`` has host and html.

    Wrappers of the same host merge in two steps, the first over a fixed number of shares, so the
    task that finishes a host sees at most that many wrappers."""

    def fold(batches):
        held: dict[str, dict] = {}
        share = TaskContext.get().partitionId() % MERGE_SALT

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([share] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()])], names=["host", "share", "wrapper"])
            held.clear()
            return rows

        for batch in batches:
            for piece in slices(batch):
                for host, source in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    own = wrapper_of(parse(source))
                    held[host] = merged(held[host], own) if host in held else own
                if len(held) > HOSTS_HELD:
                    yield flush()
        if held:
            yield flush()

    def join(last: bool):
        def run(data: pa.Table) -> pa.Table:
            wrappers = sorted(data.column("wrapper").to_pylist())
            out = json.loads(wrappers[0])
            for w in wrappers[1:]:
                out = merged(out, json.loads(w))
            host = data.column("host").slice(0, 1)
            return pa.table({"host": host, "place": pa.array([json.dumps(template(out))])} if last else {"host": host, "wrapper": pa.array([json.dumps(out)])})

        return run

    parts = map_arrow(pages, fold, "host string, share int, wrapper string")
    some = parts.groupBy("host", "share").applyInArrow(join(False), "host string, wrapper string")
    return some.groupBy("host").applyInArrow(join(True), "host string, place string")


def extract(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row for each row of ``df``: key, url, text (the article's blocks joined by two line
    feeds, empty if none) and n_chars (its code points).

    A null page counts as empty; pages without a url share the wrapper of an empty host; a host's
    only page is its own wrapper; repeated rows give repeated rows; broken, unclosed or deeply nested
    markup is read forgivingly, in time that grows with the page. Other columns are not read.
    """
    picked = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("html"), F.col(url).cast("string").alias("url"), F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit("")).alias("host"))
    scratch = Scratch(df.sparkSession, "html-text")
    places = scratch.keep(infer(picked.select("host", "html")), "places")
    small = (places.agg(F.sum(F.octet_length("host") + F.octet_length("place") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    placed = picked.join(F.broadcast(places) if small else places.hint("merge"), "host", "left").select("key", "html", "url", "place")

    def run(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            for piece in slices(batch):
                texts = []
                for body, place in zip(piece.column(1).to_pylist(), piece.column(3).to_pylist(), strict=True):
                    if place not in known:
                        if len(known) > 5000:
                            known.clear()
                        known[place] = json.loads(place) if place else None
                    texts.append(main_text(body, known[place]))
                column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), column, pc.utf8_length(column).cast(pa.int64())], names=["key", "url", "text", "n_chars"])

    return map_arrow(placed, run, "key long, url string, text string, n_chars long").toDF(key, url, "text", "n_chars")
