"""HTML extraction by wrapper induction.

The DOM trees of the pages of a host are aligned by simple tree matching and merged into one tree,
the wrapper: a node whose text is the same on all its pages, with three articles or more among them, is template,
any other is a slot. A page's text is that of its slots, in its article or not. Pages whose articles have the same
longest block are copies of one article, and count once; of pages without an article element those of equal text.
Zones that are never content although they vary (menus, forms, comments and so on, by element and class) are left out.

Wrappers are merged inside tasks, then by (host, lane), then by host, so a host with a third of all
pages is never gathered; runs of equal siblings are one node with the texts of all, which keeps trees small.

Definitions for odd input: null and empty pages have an empty text; a page without host has none to
share with and is matched with pages of the empty host; unclosed and cut elements end with their parent,
a cut tag is dropped; repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import arrow_map, small, stored, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var wbr img br ins del".split())
#: Elements, roles and words of classes and ids of zones that are no content.
DROP = frozenset("head nav header footer aside form script style textarea title noscript iframe template button select option svg canvas object dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Elements of running text: one is a zone only if all words of its class or id are listed (a share price is none).
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figure figcaption article main body html".split())


class Element:
    __slots__ = ("tag", "label", "drop", "children", "parent")

    def __init__(self, tag: str, label: str, drop: bool, parent: Element | None):
        self.tag, self.label, self.drop, self.parent = tag, label, drop, parent
        self.children: list[Element | str] = []


def parse(source: str) -> Element:
    """The DOM tree, with texts decoded; contents of raw elements are left out."""
    root = node = Element("#", "#", False, None)
    at, n = 0, len(source)
    within: Counter[str] = Counter()  # open elements by tag, so that a search upwards always ends at one
    while at < n:
        m = _TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text:
            node.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if within[tag]:
                while node.tag != tag:
                    within[node.tag] -= 1
                    node = node.parent
                within[tag] -= 1
                node = node.parent
            elif tag == "p":
                node.children.append(Element("p", "p", False, node))
            continue
        if tag not in INLINE and tag not in RAW:  # a block ends an open paragraph, an item the item before it
            closes = ("p",) if tag not in ("li", "tr", "td", "th", "dt", "dd", "option") else ("p", tag)
            if any(within[x] for x in closes):
                up = node
                while up.parent is not None and up.tag not in closes and (up.tag in INLINE or up.tag == "p"):
                    up = up.parent
                if up.tag in closes:
                    while node is not up.parent:
                        within[node.tag] -= 1
                        node = node.parent
        words, drop = "", tag in DROP
        if m[3]:
            for name, *value in _ATTRIBUTE.findall(m[3]):
                value = "".join(value).lower()
                if name.lower() == "role":
                    drop |= value in ROLES
                else:
                    words += f".{value}" if name.lower() == "class" else "#" + re.sub(r"\d+", "", value)
                    said = [x for x in re.split(r"[\s_-]+", value) if x]
                    drop |= bool(said) and (all(x in WORDS for x in said) if tag in TEXTUAL else any(x in WORDS for x in said))
        child = Element(tag, tag + words, drop, node)
        node.children.append(child)
        if tag in RAW:
            within[tag] += 1
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(source, at)
            at = end.start() if end else n
            node = child
        elif tag not in VOID and not m[3].endswith("/"):
            within[tag] += 1
            node = child
    return root


#: Articles that must have a text for it to be template.
LEAST_ARTICLES = 3


def _own(node: Element) -> str:
    """Text of a node and of the inline elements in it. No function here calls itself: pages nest as deep as they like."""
    parts, todo = [], [x for x in reversed(node.children) if isinstance(x, str) or x.tag in INLINE]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.drop:
            todo += reversed(x.children)
    return _SPACE.sub(" ", "".join(parts)).strip()


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def _is_article(node: Element) -> bool:
    return node.tag in ("article", "main") or ".article" in node.label


def article_of(root: Element) -> int:
    """A hash that copies of one article share: of its longest block; without an article element, of all texts."""
    every, inside = [], []
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or _is_article(node)
        (inside if within else every).append(_own(node))
        todo += [(x, within) for x in reversed(node.children) if not isinstance(x, str) and not x.drop and x.tag not in INLINE]
    longest = max(inside, key=lambda x: (len(x), x), default="")
    return _hash(longest or "\n".join(every))


def skeleton(root: Element, article: int) -> list:
    """[label, hashes of own texts that all pages have, articles (the smallest few), children] with runs of equal siblings as one node that has the hashes of all."""
    def node(x: Element) -> list:
        return [x.label, [_hash(_own(x))], [article], []]

    top = node(root)
    path = [(top, iter(root.children))]
    while path:
        made, rest = path[-1]
        x = next((x for x in rest if not isinstance(x, str) and x.tag not in INLINE and not x.drop), None)
        if x is not None:
            path.append((node(x), iter(x.children)))
            continue
        path.pop()
        if path:
            siblings = path[-1][0][3]
            last = siblings[-1] if siblings else None
            if last is not None and last[0] == made[0] and not last[3] and not made[3]:  # leaves: nothing to match
                if made[1][0] not in last[1]:
                    last[1] = sorted({*last[1], *made[1]})
            elif last is not None and last[0] == made[0]:
                siblings[-1] = merge(last, made, True)
            else:
                siblings.append(made)
    return top


def _matching(a: list, b: list) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching: of a and b and all pairs of nodes below that are compared, the matched nodes and the
    matched children (order-keeping pairs of equal labels with most matched nodes). Each pair is computed once."""
    done: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) in done:
            todo.pop()
            continue
        u, v = x[3], y[3]
        alike = len(u) == len(v) and all(c[0] == d[0] for c, d in zip(u, v, strict=True))
        compared = list(zip(u, v, strict=True)) if alike else [(c, d) for c in u for d in v if c[0] == d[0]]
        if missing := [(c, d) for c, d in compared if (id(c), id(d)) not in done]:
            todo += missing
            continue
        todo.pop()
        if alike:
            pairs = [(i, i) for i in range(len(u))]
        else:
            best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
            for i in range(len(u) - 1, -1, -1):
                for j in range(len(v) - 1, -1, -1):
                    both = best[i + 1][j + 1] + done[id(u[i]), id(v[j])][0] if u[i][0] == v[j][0] else 0
                    best[i][j] = max(both, best[i + 1][j], best[i][j + 1])
            pairs, i, j = [], 0, 0
            while i < len(u) and j < len(v):
                if u[i][0] == v[j][0] and best[i][j] == best[i + 1][j + 1] + done[id(u[i]), id(v[j])][0]:
                    pairs.append((i, j))
                    i, j = i + 1, j + 1
                elif best[i][j] == best[i + 1][j]:
                    i += 1
                else:
                    j += 1
        done[id(x), id(y)] = (1 + sum(done[id(u[i]), id(v[j])][0] for i, j in pairs), pairs)
    return done


def matched(a: list, b: list) -> int:
    """Nodes that simple tree matching pairs up."""
    return _matching(a, b)[id(a), id(b)][0]


def merge(a: list, b: list, siblings: bool = False) -> list:
    """The wrapper of two wrappers with equal labels, or one node of two siblings of a page."""
    done = _matching(a, b)

    def node(x: list, y: list) -> list:
        own = sorted({*x[1], *y[1]}) if siblings else sorted({*x[1]} & {*y[1]})
        return [x[0], own, sorted({*x[2], *y[2]})[:LEAST_ARTICLES], []]

    out = node(a, b)
    todo = [(a, b, out)]
    while todo:
        x, y, made = todo.pop()
        i0 = j0 = 0
        for i, j in done[id(x), id(y)][1]:
            made[3] += x[3][i0:i] + y[3][j0:j]
            made[3].append(node(x[3][i], y[3][j]))
            todo.append((x[3][i], y[3][j], made[3][-1]))
            i0, j0 = i + 1, j + 1
        made[3] += x[3][i0:] + y[3][j0:]
    return out


def packed(tree: list) -> str:
    """A wrapper as text: its nodes in order with their depths."""
    rows, todo = [], [(0, tree)]
    while todo:
        depth, (label, own, articles, children) = todo.pop()
        rows.append((depth, label, own, articles))
        todo += [(depth + 1, x) for x in reversed(children)]
    return json.dumps(rows)


def unpacked(text: str) -> list:
    path: list = []
    for depth, label, own, articles in json.loads(text):
        node = [label, own, articles, []]
        del path[depth:]
        if path:
            path[-1][3].append(node)
        path.append(node)
    return path[0]


def _host(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].lower().rpartition("@")[2] if m else ""


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one merged tree a host, as JSON."""

    def part(batches):
        lane = TaskContext.get().partitionId()
        for batch in batches:
            found: dict[str, list] = {}
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(source or "")
                host, tree = _host(url), skeleton(root, article_of(root))
                found[host] = merge(found[host], tree) if host in found else tree
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([lane] * len(found), pa.int32()), pa.array([packed(x) for x in found.values()], pa.string())], names=["host", "lane", "wrapper"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = None
        for x in sorted(pdf["wrapper"]):
            tree = unpacked(x) if tree is None else merge(tree, unpacked(x))
        return pd.DataFrame({"host": [pdf["host"].iat[0]], "wrapper": [packed(tree)]})

    lanes = F.pmod("lane", F.lit(32))
    parts = pages.select("url", "html").mapInArrow(part, "host string, lane int, wrapper string")
    by_lane = parts.groupBy("host", lanes.alias("lane")).applyInPandas(join, "host string, wrapper string")
    return by_lane.groupBy("host").applyInPandas(join, "host string, wrapper string")


def extract(source: str, wrapper: list | None) -> str:
    root = parse(source)
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        if text:
            blocks.append(text)
        buffer.clear()

    def entered(node: Element, slot: list | None) -> list:
        """[rest of the children, are texts shown, slots of the children, next slot, is it a block]"""
        # template: an own text that all of several articles of the host have here
        shown = slot is None or len(slot[2]) < LEAST_ARTICLES or _hash(_own(node)) not in slot[1]
        return [iter(node.children), shown, slot[3] if slot is not None else [], 0, True]

    path = [entered(root, wrapper)]
    while path:
        rest, shown, slots, at, block = path[-1]
        x = next(rest, None)
        if x is None:
            path.pop()
            if block:
                flush()
        elif isinstance(x, str):
            if shown:
                buffer.append(x)
        elif x.drop:
            if x.tag not in INLINE:
                flush()
        elif x.tag in INLINE:
            if x.tag == "br":
                buffer.append(" ")
            elif shown:
                path.append([*entered(x, None)[:4], False])
        else:
            flush()
            here = next((k for k in range(max(at - 1, 0), len(slots)) if slots[k][0] == x.label), None)
            path[-1][3] = at if here is None else here + 1
            path.append(entered(x, None if here is None else slots[here]))
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), "^.*@", "")), F.lit(""))


def extract_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of pages."""
    found, _ = stored(wrappers(pages), "wrappers")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host")).join(small(found, 5_000), "host", "left")

    def of(batch: pa.RecordBatch):
        seen: dict[str, list] = {}
        out = []
        for source, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if wrapper is not None and wrapper not in seen:
                seen[wrapper] = unpacked(wrapper)
            out.append(extract(source or "", seen.get(wrapper)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(pages.dtypes)
    return arrow_map(rows.select("page_id", "url", "html", "wrapper"), of, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
