"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word ``GRAM``-grams (64-bit hashes); equal sets are one node.
Each node has a signature of ``HASHES`` MinHash values of one byte. Nodes that
agree in a whole band of ``ROWS`` values are candidates: at a similarity of 0.8
a pair shares none of the ``BANDS`` bands with probability 3e-7, and less above.

Candidates form groups: the connected parts of the band buckets, or, where
such a part has more than ``PART`` nodes, the buckets themselves (a pair is then
taken in the first band it shares). Either way exactly the pairs that share a band are
candidates. A group is cut into cells of two chunks of
about ``CHUNK`` nodes, so no task gets a whole hot group and no pair is a row.
Within a cell signatures are compared step by step; after m values with k
matches the posterior of the similarity is Beta(k + 1, m - k + 1), and a pair is
dropped when the chance of reaching the threshold is below ``TOLERANCE``. The
rest is verified on the n-gram sets exactly: inverse counts for few pairs, products of
incidence matrices for many. A cell returns links per node and a spanning star
of each linked part; classes are the connected components.

Results in odd cases: texts of fewer words than ``GRAM`` are one gram of all
their words; null texts and texts without words link to nothing and are classes
of their own, named by their id; repeated rows are copies; a null id is kept and
names no class while its group has another id. Rows are told apart by a hash of
id and text (``row_of``), so ids may be null or stand on several texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectable.llm.arrow import slices
from vectable.llm.components import components
from vectable.llm.registry import written
from vectable.llm.words import grams, mix, words_of
from vectable.session import broadcast_checked

GRAM = 5  # fixed values: words of a gram and least similarity
SIMILARITY = 0.8
ROWS, BANDS = 6, 50
HASHES = ROWS * BANDS
STEP = 30
TOLERANCE = 1e-9
CHUNK = 512
PART = 20_000
BROADCAST_ROWS = 1_000_000
_TOP = np.iinfo(np.uint64).max


def gram_sets(texts: list[bytes | None], gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct gram hashes of each text."""
    words = words_of(texts)
    every = grams(words.hashes, gram)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= gram:
            out.append(np.unique(every[a : b - gram + 1]))
        else:
            out.append(grams(words.hashes[a:b], b - a) if b > a else every[:0])
    return out


@lru_cache(2)
def _multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    state = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64))
    return (state[:hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (state[hashes:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """One byte of the minimum of each hash function, per (non-empty) set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), hashes), np.uint8)
    held = np.empty_like(x)
    for j, (a, b) in enumerate(zip(*_multipliers(hashes), strict=True)):
        np.bitwise_xor(x, b, out=held)
        np.multiply(held, a, out=held)
        low = np.minimum.reduceat(held, first)
        out[:, j] = (low * np.uint32(2654435761)) >> np.uint32(24)
    return out


def node_of(grams_: np.ndarray) -> int:
    """Name of a set: a sum of mixed hashes, the same in any order."""
    return int(mix(grams_ * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            sets = gram_sets([None if t is None else t.encode() for t in part.column(1).to_pylist()])
            held = [s for s in sets if len(s)]
            signed = iter(signatures(held)) if held else iter(())
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column(0),
                    "row": part.column(2),
                    "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "signature": pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )


@lru_cache(8)
def least_matches(hashes: int, similarity: float, tolerance: float) -> tuple[int, ...]:
    """For each m: the fewest matches of m values that keep a pair.

    The posterior chance that the similarity reaches the threshold is the chance
    that a binomial of m + 1 trials gives at most k; one-byte values agree by
    chance in one of 256.
    """
    p = similarity + (1 - similarity) / 256
    out = [0]
    for m in range(1, hashes + 1):
        total, k = 0.0, -1
        while total < tolerance:
            k += 1
            log = math.lgamma(m + 2) - math.lgamma(k + 1) - math.lgamma(m + 2 - k)
            total += math.exp(log + k * math.log(p) + (m + 1 - k) * math.log(1 - p))
        out.append(k)
    return tuple(out)


def surviving_pairs(a: np.ndarray, b: np.ndarray, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that no step of the comparison drops."""
    need = least_matches(a.shape[1], similarity, TOLERANCE)
    count = np.zeros((len(a), len(b)), np.uint16)
    for j in range(STEP):
        count += a[:, j, None] == b[None, :, j]
    alive = count >= need[STEP]
    if same:
        alive &= np.tri(len(a), k=-1, dtype=bool).T
    i, j = np.nonzero(alive)
    held = count[i, j].astype(np.int64)
    for m in range(STEP, a.shape[1], STEP):
        if not len(i):
            break
        kept = np.empty(len(i), bool)
        for s in range(0, len(i), 65536):
            p, q = i[s : s + 65536], j[s : s + 65536]
            held[s : s + 65536] += (a[p, m : m + STEP] == b[q, m : m + STEP]).sum(axis=1)
            kept[s : s + 65536] = held[s : s + 65536] >= need[min(m + STEP, a.shape[1])]
        i, j, held = i[kept], j[kept], held[kept]
    return i, j


def sharing(signature: np.ndarray, i: np.ndarray, j: np.ndarray, band: int) -> np.ndarray:
    """Which pairs share a band; in the bucket of ``band``, which share this one first (-1: any)."""
    keys = np.ascontiguousarray(signature).view(np.dtype((np.void, ROWS))).reshape(len(signature), -1)
    keys = np.stack([np.unique(column, return_inverse=True)[1] for column in keys.T], axis=1).astype(np.int32)
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 65536):
        equal = keys[i[at : at + 65536]] == keys[j[at : at + 65536]]
        first = equal.any(axis=1)
        out[at : at + 65536] = first if band < 0 else first & (equal.argmax(axis=1) == band)
    return out


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``sets[i]`` and ``sets[j]``."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    col = column[at]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    total = np.zeros(len(i), np.int64)
    for low in range(0, len(shared), 4096):
        a, b = np.searchsorted(col, [low, low + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[a:b], col[a:b] - low] = 1
        total += (block @ block.T)[i, j].astype(np.int64)
    return total


def _cell(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("part_a")[0].as_py(), rows.column("part_b")[0].as_py()
        band = rows.column("band")[0].as_py()
        chunk = np.array(rows.column("chunk").to_pylist())
        nodes = np.array(rows.column("node").to_pylist(), np.int64)
        signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(len(nodes), -1)
        raw = rows.column("grams").to_pylist()
        left, right = np.flatnonzero(chunk == group[0]), np.flatnonzero(chunk == group[1])
        same = group[0] == group[1]
        i, j = surviving_pairs(signature[left], signature[right], same, similarity)
        i, j = left[i], right[j]
        mine = sharing(signature, i, j, band)
        i, j = i[mine], j[mine]
        used, both = np.unique(np.concatenate([i, j]), return_inverse=True)
        sets = [np.frombuffer(raw[u], np.uint64) for u in used]
        i, j = both[: len(i)], both[len(i) :]
        size = np.array([len(s) for s in sets], np.int64)
        if len(i):
            common = common_counts(sets, i, j)
            near = common >= similarity * (size[i] + size[j] - common) - 1e-9
            i, j = i[near], j[near]
        links = np.bincount(np.concatenate([i, j]), minlength=len(used))
        root = np.arange(len(used))
        while len(i):
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            low = low[low]
            if (low == root).all():
                break
            root = low
        linked = np.flatnonzero(links)
        return pa.table(
            {
                "node": pa.array(nodes[used][linked]),
                "links": pa.array(links[linked].astype(np.int64)),
                "root": pa.array(nodes[used][root[linked]]),
            }
        )

    return run


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            sets = gram_sets([None if t is None else t.encode() for t in part.column(1).to_pylist()])
            # a text of another node under the same row hash is left out
            own = [(n, s.tobytes()) for n, s in zip(part.column(0).to_pylist(), sets, strict=True) if len(s) and node_of(s) == n]
            columns = {"node": pa.array([n for n, _ in own], pa.int64()), "grams": pa.array([g for _, g in own], pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)


def row_of(doc_id: Column, text: Column) -> Column:
    """A hash by which rows of one id and other texts, and rows without an id, are told apart."""
    return F.xxhash64(doc_id, text)


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row.

    ``class_id`` is the smallest id of the connected class, ``n_links`` the number of different texts (gram
    sets) whose similarity to this one reaches the threshold, ``n_copies`` the
    number of rows with the same gram set, this one included.
    """
    return joined_rows(docs, doc_id, text, similarity).drop("_row", "_heads")


def joined_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``jaccard_join`` with _row (``row_of`` id and text) and _heads: whether the row is the one that its class is kept by.

    That is the row of the smallest id of the class, of these the one of the least hash; repeated rows are alike.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), row_of(F.col(doc_id), F.col(text)).alias("row"))
    kind = source.schema["id"].dataType.simpleString()
    sketch = written(source.mapInArrow(_sketch, f"id {kind}, row bigint, node bigint, n bigint, signature binary"), "sketch")
    held = sketch.filter("node is not null").groupBy("node")
    head = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    nodes = written(held.agg(F.first("signature").alias("signature"), F.min(head).alias("head"), F.count("*").alias("copies")), "nodes")
    groups = written(_groups(nodes), "groups")
    cells = _cells(groups)
    asked = groups.select("node").distinct().join(nodes.select("node", F.col("head.row").alias("row"), "signature"), "node")
    asked = written(asked, "asked")
    texts = source.join(broadcast_checked(asked.select("node", "row"), BROADCAST_ROWS), "row").select("node", "text")
    sets = texts.mapInArrow(_gram_rows, "node bigint, grams binary")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    full = cells.join(asked.select("node", "signature").join(sets, "node"), "node")
    found = written(
        full.groupBy("group", "part_a", "part_b").applyInArrow(_cell(similarity), "node bigint, links bigint, root bigint"), "links"
    )
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "head", "copies").join(links, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("head").alias("first"))
    named = named.join(classes, "root").select("node", "first", "n_links", "copies")
    out = sketch.select("id", "row", "node").join(named, "node", "left")
    first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.row") == F.col("row"))
    return out.select(
        F.col("id").alias(doc_id),
        F.coalesce("first.id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.col("row").alias("_row"),
        (F.col("node").isNull() | first).alias("_heads"),
    )


def _groups(nodes: DataFrame) -> DataFrame:
    """(group, band, node, size): candidate groups; band is -1 for connected parts."""
    slots = [F.struct(F.lit(b).alias("band"), F.substring("signature", b * ROWS + 1, ROWS).alias("key")) for b in range(BANDS)]
    banded = nodes.select("node", F.explode(F.array(*slots)).alias("s"))
    keyed = banded.select("node", F.col("s.band").alias("band"), F.xxhash64("s.band", "s.key").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    members = written(keyed.join(buckets, "key"), "members")
    edges = members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    parts = components(edges)
    sizes = parts.groupBy("root").agg(F.count("*").alias("size"))
    parts = parts.join(sizes, "root")
    small = parts.filter(F.col("size") <= PART).select(F.col("root").alias("group"), F.lit(-1).alias("band"), "node", "size")
    large = members.join(parts.filter(F.col("size") > PART).select("node"), "node")
    large = large.select(F.col("key").alias("group"), "band", "node", F.col("members").alias("size"))
    return small.unionByName(large)


def _cells(groups: DataFrame) -> DataFrame:
    """(group, band, part_a, part_b, chunk, node): every node in each cell of its chunk."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", "group"), chunks).cast("int")
    cut = groups.select("group", "band", "node", chunks.alias("chunks"), own.alias("chunk"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut.select(
        "group", "band", "node", "chunk", F.least("chunk", "other").alias("part_a"), F.greatest("chunk", "other").alias("part_b")
    )
