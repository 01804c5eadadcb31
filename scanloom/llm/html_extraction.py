"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node with a hidden label: content, other, or mixed if it holds both. The words of its
class, id and role, whether there are none that the model knows, whether most of its text is links, and length and
sentence ends of the text of a block give node potentials. Edge potentials say how likely an
element of that name and label is below a parent of a label; inline elements have a table of their own. Both are learned
from labelled pages (``labelled_pages``). Sum-product messages go from the leaves to the root and back and give marginals;
text is dropped if its element is other with a chance of one half or more. Children of one name share one vote (their
messages are weighted), so that many short comments don't outvote what their container says.

Pages are read in Arrow batches; nothing is shuffled. Defined results: a null or empty page gives an empty text; unclosed
and stray tags are tolerated (an icon, a button or the like without an end tag ends with its parent or where a block
begins); rows that repeat are read each by itself; other columns are ignored; an empty table gives an empty result. A line
break is white space inside its block. A tag that isn't closed ends where the next one begins. A very long page is read
whole, in time and memory in proportion to its length. A chance of just one half (a tie) is other.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Container, Iterator
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.labelled_pages import PAGES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w:.-])([A-Za-z_:-][\w:.-]*+)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose contents are never text of the page: those that hold no elements, and those that do.
RAW = {"script", "style", "title", "textarea", "iframe"}
HIDDEN = {"noscript", "template", "svg", "object", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: Elements that end when one of the same set begins: what may end, and where the search for it stops.
ENDS = {
    "p": ({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "body"}), "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr"}), "th": ({"td", "th", "p"}, {"tr"}), "option": ({"option"}, {"select"}),
}
#: Blocks that end an open paragraph.
CLOSE_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "pre", "section", "table", "ul",
}
#: What ends an open hidden element that has no end tag.
BLOCKS = (CLOSE_P | ENDS.keys() | {"body"}) - {"option"}
WORD = re.compile(r"[a-z]+")
CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u00bb)]*(?:\s|\Z)")
#: Containers whose class, id and role would tell what they hold.
NAMED = {"div", "section", "table", "td", "ul", "ol"}
#: Texts of blocks are told apart below these lengths.
SHORT, MIDDLE = 25, 70
#: Labels. Text directly in a mixed element is kept.
OTHER, CONTENT, MIXED = range(3)
LABELS = 3
#: While learning, as many elements are added to each label that have features as usual, and so many edges of each kind.
PRIOR, EDGE_PRIOR = 0.3, 0.05
#: What holds the whole page is mixed.
WHOLE = ("#page", "html", "body")


class Node:
    __slots__ = ("name", "parent", "given", "links", "total", "known", "siblings", "hidden", "loose")

    def __init__(self, name: str, parent: int, given: str, known: int | None, hidden: bool = False, loose: bool = False):
        self.name, self.parent, self.given, self.known, self.hidden, self.loose = name, parent, given, known, hidden, loose
        self.links = self.total = 0
        self.siblings = 1


def _tags(html: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, name (empty for comments), whether an end tag, and attributes; ``RAW`` elements end before their end tags."""
    found, at, low, drawings = [], 0, None, 0
    while m := TAG.search(html, at):
        at = m.end()
        name, ends, given = (m[2] or m[5] or "").lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        empty = given.endswith("/")
        if name == "svg" and not (empty and not ends):
            drawings = max(0, drawings - 1) if ends else drawings + 1
        # Only within a drawing can a title, say, be empty by its slash.
        if name in RAW and not ends and not (empty and drawings):
            low = low if low is not None else html.lower()
            end = low.find(f"</{name}", at) if len(low) == len(html) else -1
            if end < 0:
                end = again.start() if (again := re.compile(f"</{name}", re.I).search(html, at)) else len(html)
            at = end
        found.append((m.start(), at, name, ends, given))
    return found


def _ended(tags: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """The hidden elements that have an end tag, by the places of their start tags."""
    ended, opened = set(), defaultdict(list)
    for start, _, name, ends, given in tags:
        if name not in HIDDEN:
            continue
        if not ends and not given.endswith("/"):
            opened[name].append(start)
        elif ends and opened[name]:
            ended.add(opened[name].pop())
    return ended


def parse(html: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """The elements, parents first, and the page's text in order: (element, text), or text None where a block ends.

    Text of hidden elements is left out. ``labelled``: whether the page says which elements are content (data-y).
    """
    nodes, pieces = [Node("#page", -1, "", None)], []
    open_nodes, at = [0], 0
    counts: dict[str, int] = defaultdict(int)  # open elements by name
    tags = _tags(html)
    ended = _ended(tags)

    def text(end: int) -> None:
        if end > at and not nodes[open_nodes[-1]].hidden and (found := unescape(html[at:end])):
            pieces.append((open_nodes[-1], found))

    def cut(i: int) -> None:
        for j in open_nodes[i:]:
            counts[nodes[j].name] -= 1
        del open_nodes[i:]

    def close(names: set[str], stop: set[str]) -> None:
        if not any(counts[n] for n in names):
            return
        for i in range(len(open_nodes) - 1, 0, -1):
            node = nodes[open_nodes[i]]
            if node.name in names:
                cut(i)
                return
            # What lies in a hidden element that has its end tag ends nothing outside.
            if node.name in stop or (node.name in HIDDEN and not node.loose and not names & HIDDEN):
                return

    def close_loose() -> None:
        for i in range(len(open_nodes) - 1, 0, -1):
            node = nodes[open_nodes[i]]
            if not node.hidden or (node.name in HIDDEN and not node.loose):
                return
            if node.loose:
                cut(i)

    for start, end, name, ends, attributes in tags:
        text(start)
        at = end
        if not name:
            continue
        if name not in INLINE:
            pieces.append((open_nodes[-1], " " if name in ("br", "wbr") else None))
        if ends:
            close({name}, set() if name != "p" else CLOSE_P)
            continue
        if name in VOID or name in RAW:
            continue
        if name in BLOCKS and nodes[open_nodes[-1]].hidden:
            close_loose()
        if name in ENDS:
            close(*ENDS[name])
        elif name in CLOSE_P:
            close({"p"}, {"td", "th", "li", "div", "section", "article", "blockquote", "body", "a"})
        if attributes.endswith("/") and name not in INLINE and name not in CLOSE_P:
            continue
        given, known = [], None
        for a in ATTRIBUTE.finditer(attributes):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("class", "id", "role"):
                given.append(CASE.sub(" ", value).lower())
            elif labelled and key == "data-y" and value in ("0", "1"):
                known = int(value)
        hidden = name in HIDDEN or nodes[open_nodes[-1]].hidden
        nodes.append(Node(name, open_nodes[-1], " ".join(given), known, hidden, name in HIDDEN and start not in ended))
        open_nodes.append(len(nodes) - 1)
        counts[name] += 1
    text(len(html))
    return nodes, pieces


def features(nodes: list[Node], pieces: list[tuple[int, str | None]], known: Container[str] | None = None) -> list[list[str]]:
    """What the model may see of each element; ``known`` are the words of names that it has seen (None: all)."""
    linked, block = [False] * len(nodes), [0] * len(nodes)
    for i, node in enumerate(nodes):
        linked[i] = node.name == "a" or (node.parent >= 0 and linked[node.parent])
        block[i] = block[node.parent] if node.name in INLINE and node.parent >= 0 else i
    own, sentences = [0] * len(nodes), [False] * len(nodes)
    for i, text in pieces:
        if text and (n := len(text.strip())):
            nodes[i].total += n
            nodes[i].links += n * linked[i]
            if not linked[i]:
                own[block[i]] += n
                sentences[block[i]] = sentences[block[i]] or SENTENCE_END.search(text) is not None
    groups: dict[tuple[int, str], int] = defaultdict(int)
    for node in nodes:
        groups[node.parent, node.name] += 1
    for node in reversed(nodes):
        node.siblings = groups[node.parent, node.name]
        if node.parent >= 0:
            nodes[node.parent].total += node.total
            nodes[node.parent].links += node.links
    found = []
    for i, node in enumerate(nodes):
        if node.name in INLINE or node.name in WHOLE or not node.total:
            found.append([])
            continue
        words = sorted({f"word={w}" for w in WORD.findall(node.given) if known is None or f"word={w}" in known})
        if not words and node.name in NAMED:
            words.append("unnamed")
        if node.links >= 0.7 * node.total:
            words.append("links")
        elif own[i]:
            size = "short" if own[i] < SHORT else "middle" if own[i] < MIDDLE else "long"
            words.append(f"text={size},{sentences[i]}")
        found.append(words)
    return found


def train(pages: tuple[str, ...] = PAGES) -> dict:
    """Node potentials, P(feature | label), and edge potentials, P(child's label and name | parent's label).

    An element that isn't content but holds some is mixed, whatever else it holds.
    """
    counts: dict[str, list[float]] = defaultdict(lambda: [0.0] * LABELS)
    labels = [0.0] * LABELS
    pairs: dict[str, list[list[float]]] = defaultdict(lambda: [[0.0] * LABELS for _ in range(LABELS)])
    read = [parse(page, labelled=True) for page in pages]
    # A word that is on this page alone would be unknown, were the page not learned from.
    on_pages: dict[str, int] = defaultdict(int)
    for nodes, _ in read:
        for w in {w for node in nodes for w in WORD.findall(node.given)}:
            on_pages[f"word={w}"] += 1
    elsewhere = {w for w, n in on_pages.items() if n > 1}
    for nodes, pieces in read:
        found = features(nodes, pieces)
        for node, seen_here in zip(nodes, found, strict=True):
            if node.name in NAMED and seen_here and "unnamed" not in seen_here and not elsewhere & set(seen_here):
                seen_here.append("unnamed")
        y = [OTHER] * len(nodes)
        for i, node in enumerate(nodes):
            y[i] = node.known if node.known is not None else y[node.parent] if node.parent >= 0 else OTHER
        for i in range(len(nodes) - 1, 0, -1):
            if y[i] != OTHER and y[nodes[i].parent] == OTHER:
                y[nodes[i].parent] = MIXED
        for i, node in enumerate(nodes):
            if node.total and node.name not in WHOLE:
                pairs["inline" if node.name in INLINE else node.name][y[node.parent]][y[i]] += 1
                labels[y[i]] += 1
                for f in found[i]:
                    counts[f][y[i]] += 1
    usual = {f: sum(row) / sum(labels) for f, row in counts.items()}
    seen = {f: [log((n + PRIOR * usual[f]) / (labels[k] + PRIOR)) for k, n in enumerate(row)] for f, row in counts.items()}
    return {"seen": seen, "edges": _edges(pairs)}


def _edges(pairs: dict) -> dict:
    """For each name a table by parent's and child's label. Names that were never seen count as an average block."""
    every, edges = range(LABELS), {}
    blocks = [n for n in pairs if n != "inline"]
    whole = [[sum(pairs[n][k][j] for n in blocks) + EDGE_PRIOR for j in every] for k in every]
    names = sum(map(sum, whole))
    for name in blocks:
        share = sum(map(sum, pairs[name])) / names
        # P(label | parent) P(name | label, parent), over the name's share so that names of any kind weigh alike.
        edges[name] = [
            [whole[k][j] / sum(whole[k]) * (pairs[name][k][j] + PRIOR * share) / (whole[k][j] + PRIOR) / share for j in every] for k in every
        ]
    edges["block"] = [[whole[k][j] / sum(whole[k]) for j in every] for k in every]
    inline = [[n + EDGE_PRIOR for n in row] for row in pairs["inline"]]
    edges["inline"] = [[n / sum(row) for n in row] for row in inline]
    return edges


def marginals(nodes: list[Node], found: list[list[str]], model: dict) -> list[list[float]]:
    """P(label) of each node, by messages from the leaves to the root and back."""
    seen, edges = model["seen"], model["edges"]
    n, every = len(nodes), range(LABELS)
    clamped = [float(k == MIXED) for k in every]
    up = [[1.0] * LABELS for _ in range(n)]  # node potential times the children's messages, scaled
    sent = [[1.0] * LABELS for _ in range(n)]  # message to the parent
    tables = [edges["inline"] if x.name in INLINE else edges.get(x.name, edges["block"]) for x in nodes]
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        if node.name in WHOLE:
            up[i] = clamped
        elif not node.total:
            continue
        rows = [seen[f] for f in found[i] if f in seen]
        points = [sum(r[k] for r in rows) for k in every]
        most = max(points)
        own = [up[i][k] * exp(points[k] - most) for k in every]
        total = sum(own)
        up[i] = own = [v / total for v in own]
        if node.name in WHOLE:
            continue
        # Children of one name share a vote.
        sent[i] = [max(sum(tables[i][k][j] * own[j] for j in every), 1e-9) ** (1.0 / node.siblings) for k in every]
        there = [up[node.parent][k] * sent[i][k] for k in every]
        total = sum(there)
        up[node.parent] = [v / total for v in there]
    believed = [clamped]
    for i in range(1, n):
        if nodes[i].name in WHOLE:
            believed.append(clamped)
            continue
        # What the parent believes without this child's message.
        rest = [b / m for b, m in zip(believed[nodes[i].parent], sent[i], strict=True)]
        own = [up[i][j] * sum(rest[k] * tables[i][k][j] for k in every) for j in every]
        total = sum(own)
        believed.append([v / total for v in own])
    return believed


def extract(html: str | None, model: dict) -> str:
    nodes, pieces = parse(html or "")
    believed = marginals(nodes, features(nodes, pieces, model["seen"]), model)
    blocks, block = [], []
    for i, text in [*pieces, (0, None)]:
        if text is None:
            if block and (line := " ".join("".join(block).split())):
                blocks.append(line)
            block = []
        elif believed[i][OTHER] < 0.5:
            block.append(text)
    return "\n".join(blocks)


def extract_text(
    pages: DataFrame, model: dict | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    learned = model or train()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), learned) for h in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
