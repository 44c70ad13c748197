"""HTML extraction with a site style tree.

Pages of one host are merged: every element is a node named by its path of tags
and classes. A node's presentation importance is the entropy of the child
sequences that the pages show there; its content importance is one minus the
mean entropy of its texts over the pages that have the node (a menu entry that
stands on all pages weighs 0, a paragraph of one page 1). With l different
child sequences both are combined as (1 - GAMMA^l) * presentation + GAMMA^l *
content. Blocks whose node weighs less than ``LEAST`` are removed.

Entropy says nothing on hosts with few pages, so nodes carry a prior by name:
elements and classes that name page furniture weigh 0 (``names_furniture``; never on
``html``, ``body``, ``article`` and ``main``), and a page that has an
``article`` or ``main`` holds its main text there. A ``main`` counts in whatever class it
lies, an ``article`` within a class of furniture only on a page that has no other text. Nodes in there weigh 1 while
fewer than ``SEVERAL`` different pages of the host have them; from there on, and
everywhere else, the tree decides. A page that the tree leaves nothing of its
``article`` or ``main`` is read as one without.

Pages of a host whose blocks (without furniture by name) are equal count once:
copies say nothing about furniture. The tree is built by aggregations per (host,
page), then per (host, node, feature), combined in each task first, so neither a
page of many copies nor a host with most of the pages is a hot group. Pages meet the
few removed nodes of their host in a join, broadcast while their bytes (counted) are few,
beyond it by host with skewed hosts split, then are parsed once more.

Results in odd cases: null or empty html gives the empty text; a null or odd
address belongs to the host ""; broken markup (open tags, stray ends, cut
files) is read as far as it goes; repeated pages each get a row; a host with
one different page has all weights 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.llm.arrow import slices
from vectable.llm.registry import written
from vectable.llm.words import text_hash

GAMMA = 0.9
LEAST = 0.3
SEVERAL = 5  # different pages from which the tree judges nodes inside article and main
FEATURES = "array<struct<path: string, prior: int, kind: string, feature: bigint>>"
BROADCAST_BYTES = 16 * 1024 * 1024

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption dd dt head html legend li option select tbody td tfoot th thead tr".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": set(),
}
SCOPES = frozenset("ul ol dl table select article section div body nav aside main".split())
FURNITURE_TAGS = frozenset(
    "nav aside footer header form button select option textarea script style noscript template iframe object embed "
    "head title menu dialog svg math canvas audio video".split()
)
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar topbar widget".split()
)
#: Names that say furniture at the front of a class too; words behind a name that change nothing; words that turn it around.
FRONT_NAMES = frozenset("ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments disqus masthead nav navbar sidebar".split())
HOLDERS = frozenset("area bar block body box container content inner item items list outer panel section slot wrap wrapper".split())
STATES = frozenset("closed disabled enabled free hidden less off on open".split())
DENIALS = frozenset("has hide no not with without".split())
MAIN = frozenset({"article", "main"})
UNNAMED = MAIN | {"html", "body"}
_NAME = re.compile(r"[a-z]+")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_OPEN = re.compile(r"<[a-z/!?]", re.IGNORECASE)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_HOST = re.compile(r"\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.IGNORECASE)
UNDECIDED, MAINLY, FURNITURE, HIDDEN = 0, 1, 2, 3


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def names_furniture(name: str) -> bool:
    """Whether a class, id or role names page furniture: as a whole, by its end, or by a front that says nothing else."""
    words = _NAME.findall(name)
    if not words or len(words) > 1 and words[0] in DENIALS:
        return False
    front = words[0] in FRONT_NAMES and not (len(words) > 1 and words[1] in STATES)
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return front or words[-1] in FURNITURE_NAMES


class Node:
    """An open element: its path, its prior, whether a class alone made it furniture, and the child elements seen."""

    __slots__ = ("tag", "path", "prior", "named", "children")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        names = []
        if attrs:
            for m in _ATTR.finditer(attrs):
                names += (m[2] or m[3] or m[4] or "").lower().split()
        label = ".".join([tag, *sorted(re.sub(r"\d+", "#", n) for n in names)])
        self.tag, self.path, self.children = tag, f"{parent.path}>{label}" if parent else label, []
        before = parent.prior if parent else UNDECIDED
        named = tag not in UNNAMED and any(map(names_furniture, names))
        self.named = tag not in FURNITURE_TAGS and (named if before != FURNITURE else parent.named)
        if before == FURNITURE and parent.named and tag in MAIN:
            self.prior = MAINLY if tag == "main" else HIDDEN
        elif before == FURNITURE or tag in FURNITURE_TAGS or named:
            self.prior = FURNITURE
        elif before == HIDDEN:
            self.prior = HIDDEN
        else:
            self.prior = MAINLY if before == MAINLY or tag in MAIN or "main" in names and tag != "body" else UNDECIDED
        if parent:
            parent.children.append(label)


def blocks(html: str) -> tuple[list[tuple[str, int, str]], dict[str, list]]:
    """Text blocks (path, prior, text) in page order, and the child sequences of each path."""
    root = Node("#", "", None)
    stack, found, held, seen = [root], [], [], {"#": [root.children]}

    def flush():
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                node = next(n for n in reversed(stack) if n.tag in BLOCK or n is root)
                found.append((node.path, stack[-1].prior if stack[-1].prior == FURNITURE else node.prior, text))
            held.clear()

    def close(count: int):
        if any(n.tag in BLOCK or n.prior == FURNITURE for n in stack[count:]):
            flush()
        del stack[count:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            else:
                if tag in BLOCK:
                    flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            goes = SIBLINGS.get(tag)
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if open_tag == "p" and tag in CLOSES_P or goes and open_tag in goes:
                    close(i)
                elif open_tag in SCOPES or open_tag in BLOCK and not goes:
                    break
        if tag in VOID:
            continue
        node = Node(tag, m["attrs"], stack[-1])
        if node.prior == FURNITURE and stack[-1].prior != FURNITURE:
            flush()
        if not m["attrs"].endswith("/") or tag in BLOCK:
            stack.append(node)
            seen.setdefault(node.path, []).append(node.children)
    cut = _OPEN.search(html, at)  # a tag that the end of the file cuts is no text
    held.append(html[at : cut.start() if cut else len(html)])
    flush()
    return found, seen


def main_text(html: str | None, removed: frozenset | set = frozenset()) -> str:
    """Blocks that stay, one a line; ``removed`` are the host's low nodes."""
    found, _ = blocks(html or "")
    inside = [text for path, prior, text in found if prior == MAINLY and path not in removed]
    if inside:
        return "\n".join(inside)
    plain = [text for path, prior, text in found if prior == UNDECIDED and path not in removed]
    return "\n".join(plain or [text for _, prior, text in found if prior == HIDDEN])


def site_style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, prior, pages, presentation, content, importance) of every node of every host's merged tree.

    ``pages`` counts different pages.
    """
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    features = rows.mapInArrow(_features, f"host string, page bigint, features {FEATURES}")
    distinct = features.groupBy("host", "page").agg(F.min("features").alias("features"))
    features = distinct.select("host", F.inline("features"))
    counted = features.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"), F.max("prior").alias("prior"))
    style, n = F.col("kind") == "style", F.col("n").cast("double")
    nodes = counted.groupBy("host", "path").agg(
        F.max("prior").alias("prior"),
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, n * F.log(n))).alias("style_log"),
        F.count(F.when(~style, 1)).alias("texts"),
        F.sum(F.when(~style, F.log(n))).alias("text_log"),
    )
    m = F.log(F.col("pages").cast("double"))
    several = F.col("pages") > 1
    presentation = F.when(several, 1 - F.col("style_log") / F.col("pages") / m).otherwise(1.0)
    content = F.when(several & (F.col("texts") > 0), 1 - F.col("text_log") / F.col("texts") / m).otherwise(1.0)
    part = F.pow(F.lit(GAMMA), F.col("styles"))
    return nodes.select(
        "host", "path", "prior", "pages", presentation.alias("presentation"), content.alias("content"),
        F.when(several, (1 - part) * presentation + part * content).otherwise(1.0).alias("importance"),
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, features) of each different page of a slice; ``page`` is a hash of the blocks that are no furniture by name."""
    kinds = {"path": pa.string(), "prior": pa.int32(), "kind": pa.string(), "feature": pa.int64()}
    for batch in batches:
        for part in slices(batch, 1):
            held: dict[tuple[str, int], list[tuple]] = {}
            for url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found, seen = blocks(html or "")
                prior = {path: p for path, p, _ in found}
                mine = []
                for path, sequences in seen.items():
                    shown = "|".join(sorted({" ".join(dict.fromkeys(s)) for s in sequences}))
                    mine.append((path, prior.get(path, 0), "style", text_hash(shown)))
                mine += [(path, p, "text", text_hash(text)) for path, p, text in set(found)]
                mine.sort()
                page = text_hash("\0".join(f"{path}\1{text}" for path, p, text in found if p != FURNITURE))
                key = host_of(url), page
                held[key] = min(held.get(key, mine), mine)
            columns = list(zip(*(f for mine in held.values() for f in mine), strict=True)) or [()] * 4
            items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
            offsets = pa.array(list(accumulate((len(mine) for mine in held.values()), initial=0)), pa.int32())
            hosts, pages = pa.array([h for h, _ in held], pa.string()), pa.array([p for _, p in held], pa.int64())
            yield pa.RecordBatch.from_arrays([hosts, pages, pa.ListArray.from_arrays(offsets, items)], ["host", "page", "features"])


def extract(pages: DataFrame, url: str = "url", html: str = "html", least: float = LEAST, text: str = "text") -> DataFrame:
    """``pages`` with their main text instead of the html."""
    tree = site_style_tree(pages, url, html)
    judged = (F.col("prior") == UNDECIDED) | (F.col("prior") == MAINLY) & (F.col("pages") >= SEVERAL)
    low = tree.filter(judged & (F.col("importance") < least))
    low = written(low.groupBy("host").agg(F.collect_set("path").alias("_removed")), "removed-nodes")
    listed = low.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("_removed", "")))).first()[0] or 0
    low = F.broadcast(low) if listed <= BROADCAST_BYTES else low.hint("merge")
    rows = pages.drop(text).withColumn("_host", _host(F.col(url)))
    joined = rows.join(low.withColumnRenamed("host", "_host"), "_host", "left").drop("_host")
    kept = [f for f in joined.schema.fields if f.name not in (html, "_removed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(html)):
                removed = [frozenset(r or ()) for r in part.column("_removed").to_pylist()]
                texts = map(main_text, part.column(html).to_pylist(), removed)
                columns = {f.name: part.column(f.name) for f in kept}
                yield pa.RecordBatch.from_pydict(columns | {text: pa.array(list(texts), pa.string())})

    return joined.mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType())]))


def _host(url):
    """``host_of`` as a column."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
