"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Every token before a word is a context with a restaurant of its own; all share
one parent restaurant, whose base is uniform over the training words and one
unknown word. Customers of a context are the training tokens that follow it; its tables send
one customer each to the parent. The seating is sampled by Gibbs: the tables of
a dish, given all others, are drawn from their conditional, by generalized
Stirling numbers for up to ``EXACT`` customers and by those numbers scaled for more. Dishes are
drawn side by side against the table counts of the round before. After ``BURN``
of ``ROUNDS`` rounds each round is a sample; a token's probability is the mean
of its predictive probabilities under the samples. Discounts follow from the numbers of types seen once and
twice; the strength is ``STRENGTH``.

On Spark: contexts are dealt to buckets of about ``BUCKET_BYTES`` of text, each a packed row
of all its word pairs, counted in the tasks before; contexts with more tokens
than a bucket are dealt by word pair, and their table counts added up. Words
are dealt to chunks, each a part of the parent. Between the two go only tables per
word and, back, the parent's counts: of the ``FREQUENT`` most frequent words as one
array of fixed size, of all others bucket by bucket through a shuffle. For the scores
texts are cut again, their pairs meet the bucket's counts, and sums per text
return to their block. Pairs with more tokens than a bucket are scored where
they are read. Draws depend on words and round only, so results do not depend on partitions.

Results in odd cases: a null text is the empty text, which is one end token;
rows of null id are learned from; rows that repeat count each; without training
rows every probability is 1 (one unknown word); an empty table has no rows; columns other than id and
text are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.llm.arrow import slices
from vectable.llm.packed import SCHEMA, Row, batches_of, by_kind, distinct, each, grouped, pack, rows_of, runs, stable_order, summed, unpack
from vectable.llm.registry import written
from vectable.llm.words import VALUE, mix, prefix_sums, span_hashes

ROUNDS, BURN = 3, 1
STRENGTH = 1.0
EXACT = 512
POINTS = 512
FREQUENT = 1 << 19
BUCKET_BYTES = 1 << 24
APART = 1000  # least tokens of what is treated apart from its bucket
BLOCK_TOKENS = 1_000_000
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BINS = 16  # bins of word counts per power of two


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 0 when divided by 10; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, ends included; first token of each text)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edges = np.zeros(len(raw) + 2, np.int8)
    edges[1:-1] = ~_WHITE[raw]
    turn = np.diff(edges)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    hashes = mix(span_hashes(prefix_sums(VALUE[raw]), starts, ends) ^ (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    out = np.full(len(hashes) + len(texts), END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), np.diff(first))] = hashes
    return out, first[:-1] + np.arange(len(texts))


@dataclass
class Block:
    """Tokens of some rows; ``first`` is the first token of each."""

    tokens: np.ndarray
    first: np.ndarray
    rows: pa.Table  # id, held

    def trained(self) -> np.ndarray:
        held = self.rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
        return np.repeat(~held, self.sizes())

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.tokens)))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Rows (id, held, text) of a task in blocks of about ``BLOCK_TOKENS`` tokens."""
    tokens, first, rows, n = [], [], [], 0

    def flushed() -> Block:
        return Block(np.concatenate(tokens), np.concatenate(first), pa.Table.from_batches(rows))

    for batch in batches:
        for part in slices(batch, 2):
            found, at = tokens_of([(t or "").encode() for t in part.column(2).to_pylist()])
            tokens.append(found)
            first.append(at + n)
            rows.append(pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["id", "held"]))
            n += len(found)
            if n >= BLOCK_TOKENS:
                yield flushed()
                tokens, first, rows, n = [], [], [], 0
    if n:
        yield flushed()


@dataclass
class Corpus:
    """What is known of the training tokens as a whole, and how the work is dealt out."""

    buckets: int
    chunks: int
    tokens: int = 0
    words: int = 0
    docs: int = 0
    root_discount: float = 0.5
    discount: float = 0.5
    limit: int = 1  # tokens of a context, or of a pair, from which it is treated apart
    frequent: np.ndarray = None  # hashes, sorted
    counts: np.ndarray = None
    heavy: np.ndarray = None  # contexts that are dealt by pair, sorted, and their customers
    customers: np.ndarray = None
    totals: np.ndarray = None  # their tables

    def bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        h = mix(u ^ _STEP)
        apart, _ = found_in(self.heavy, u)
        h[apart] = mix(h[apart] + w[apart])
        return ((h >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def chunk(self, w: np.ndarray) -> np.ndarray:
        return (mix(w + _STEP) % np.uint64(self.chunks)).astype(np.int64)

    def code(self, name: str, words: np.ndarray) -> dict[str, np.ndarray]:
        """Words as places among the frequent ones, and the hashes of the others."""
        known, at = found_in(self.frequent, words)
        return {name: np.where(known, at, len(self.frequent)).astype(np.int32), f"{name}_rare": words[~known]}

    def words_in(self, arrays: dict[str, np.ndarray], name: str) -> np.ndarray:
        code, rare = arrays[name], arrays[f"{name}_rare"]
        out = np.append(self.frequent, np.uint64(0))[code]
        out[code == len(self.frequent)] = rare
        return out


def found_in(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether it is there, where) of ``asked`` in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked, at


# ---- seating ---------------------------------------------------------------


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key, the same wherever it is drawn."""
    shift = np.uint64((salt + 1) * int(_STEP) % 2**64)
    return ((mix(keys + shift) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


@lru_cache(8)
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers [customers, tables] up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0
    k = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - k * discount, 0)))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series at x + 8."""
    shift = sum(np.log(x + j) for j in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def drawn_tables(customers: np.ndarray, strength: np.ndarray, base: np.ndarray, discount: float, keys: np.ndarray, turn: int) -> np.ndarray:
    """Tables of each dish, given ``strength`` (with the discount of all other tables of the restaurant) and the parent's ``base``."""
    out = np.minimum(customers, 1)
    logs = stirling(discount)
    draw = uniform(keys, turn)
    order = np.argsort(customers, kind="stable")
    sizes = customers[order]
    for c in np.unique(sizes[(sizes > 1) & (sizes <= EXACT)]).tolist():
        low, high = np.searchsorted(sizes, [c, c + 1])
        for at in range(low, high, 200_000 // c + 1):
            mine = order[at : min(high, at + 200_000 // c + 1)]
            k = np.arange(c)
            weight = np.cumsum(np.log(strength[mine, None] + discount * k) + np.log(base[mine, None]), axis=1) + logs[c, 1 : c + 1]
            out[mine] = 1 + picked(weight, draw[mine])
    large = order[np.searchsorted(sizes, EXACT + 1) :]
    for at in range(0, len(large), 256):
        mine = large[at : at + 256]
        out[mine] = scaled_tables(customers[mine], strength[mine], base[mine], discount, draw[mine])
    return out


def picked(weight: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A column of each row of log weights, by a uniform draw."""
    share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return (share[:, :-1] < draw[:, None] * share[:, -1:]).sum(axis=1)


def scaled_tables(customers: np.ndarray, strength: np.ndarray, base: np.ndarray, discount: float, draw: np.ndarray) -> np.ndarray:
    """Tables of dishes of more than ``EXACT`` customers.

    Given the tables, their sizes are independent with a tail of power ``discount``, so that the chance
    of c customers at t tables is that of c / x at t / x^discount; the exact numbers are read there.
    The weights are laid on points spread by ratio first, then on those around the greatest.
    """
    k = np.arange(1, EXACT + 1)
    known = stirling(discount)[EXACT, 1:] + log_gamma(k + 1.0) + k * np.log(discount)
    shrink = (EXACT / customers) ** discount
    most = np.minimum(customers, EXACT / shrink)

    def weight(t: np.ndarray) -> np.ndarray:
        at = t * shrink[:, None]
        sizes = np.where(at < 1, known[0] + np.log(np.minimum(at, 1)), np.interp(at, k, known))
        r = strength[:, None] / discount
        return log_gamma(r + t) - log_gamma(t + 1) + t * np.log(base)[:, None] + sizes

    step = np.linspace(0, 1, POINTS)
    t = np.exp(step * np.log(most)[:, None])
    rough = weight(t)
    held = rough > rough.max(axis=1, keepdims=True) - 30
    first, last = np.maximum(held.argmax(axis=1) - 1, 0), np.minimum(POINTS - held[:, ::-1].argmax(axis=1), POINTS - 1)
    rows = np.arange(len(t))
    low, high = np.floor(t[rows, first]), np.ceil(np.maximum(t[rows, last], t[rows, first] + 1))
    t = low[:, None] + step * (high - low)[:, None]
    whole = high - low < POINTS  # few enough to take each number of tables
    t[whole] = low[whole, None] + np.arange(POINTS)
    fine = np.where(t <= most[:, None], weight(np.minimum(t, most[:, None])), -np.inf)
    return np.clip(np.round(t[rows, picked(fine, draw)]), 1, customers).astype(customers.dtype)


# ---- the training words ----------------------------------------------------


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id)).alias("held"), F.col(text).alias("text"))


def _bins(n: np.ndarray) -> np.ndarray:
    return np.where(n < 3, n, 3 + np.floor(_BINS * np.log2(np.maximum(n, 1)))).astype(np.int64)


def count_words(source: DataFrame, corpus: Corpus) -> tuple[DataFrame, Corpus]:
    """(packed rows of the training words by chunk, corpus with totals and frequent words)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            for block in blocks(batches):
                words, n = np.unique(block.tokens[block.trained()], return_counts=True)
                chunk = corpus.chunk(words)
                for c, at in split(chunk):
                    yield c, "count", 0, pack(w=words[at], n=n[at])

        yield from batches_of(rows())

    def merged(key: int, kinds: dict[str, list[Row]]) -> Iterator[Row]:
        parts = [unpack(row[3]) for row in kinds["count"]]
        words, n = summed(np.concatenate([p["w"] for p in parts]), np.concatenate([p["n"] for p in parts]))
        bins, at = np.unique(_bins(n), return_inverse=True)
        yield key, "words", 0, pack(w=words, n=n)
        yield len(words), "total", int(n.sum()), pack(bin=bins, n=np.bincount(at), docs=n[words == END])

    found = by_kind(grouped(source.mapInArrow(counted, SCHEMA), merged), "lm-words")
    bins: dict[int, int] = {}
    tokens = words = docs = 0
    for row in found["total"].collect():
        words, tokens = words + row.key, tokens + row.at
        part = unpack(row.data)
        docs += int(part["docs"].sum())
        for b, n in zip(part["bin"].tolist(), part["n"].tolist(), strict=True):
            bins[b] = bins.get(b, 0) + n
    held, least = 0, 1 << 40
    for b in sorted(bins, reverse=True):
        if (held := held + bins[b]) > FREQUENT:
            break
        least = b

    def common(row: Row) -> Iterator[Row]:
        part = unpack(row[3])
        at = _bins(part["n"]) >= least
        yield 0, "frequent", 0, pack(w=part["w"][at], n=part["n"][at])

    parts = [unpack(row.data) for row in each(found["words"], common).collect()]
    frequent = np.concatenate([np.empty(0, np.uint64), *(p["w"] for p in parts)])
    order = np.argsort(frequent)
    counts = np.concatenate([np.empty(0, np.int64), *(p["n"] for p in parts)])[order]
    frequent = frequent[order]
    limit = max(APART, tokens // corpus.buckets, int(counts.min()) if len(counts) < words else 0)  # all words so frequent are at hand
    apart = (counts >= limit) & (frequent != END)
    heavy, customers = frequent[apart], counts[apart]
    if docs >= limit:
        heavy, customers = np.append(heavy, START), np.append(customers, docs)
    order = np.argsort(heavy)
    return found["words"], replace(
        corpus, tokens=tokens, words=words, docs=docs, limit=limit, root_discount=discount_of(bins.get(1, 0), bins.get(2, 0)),
        frequent=frequent, counts=counts, heavy=heavy[order], customers=customers[order], totals=np.zeros(len(heavy), np.int64),
    )


def discount_of(once: int, twice: int) -> float:
    """The discount that the numbers of types seen once and twice suggest."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once else 0.5


def split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places of it in order) of each key."""
    order = stable_order(keys, int(keys.max(initial=0)))
    first = runs(keys[order])
    for a, b in zip(first, np.append(first, len(keys))[1:], strict=True):
        yield int(keys[order[a]]), order[a:b]


# ---- pairs of a bucket -----------------------------------------------------


@dataclass
class Pairs:
    """Distinct pairs in order of context and word: words, context and word as places in them, customers."""

    words: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray

    def first(self) -> np.ndarray:
        return runs(self.u)

    def keys(self) -> np.ndarray:
        """A hash of each pair, for draws."""
        return mix(mix(self.words[self.u]) + self.words[self.w])

    def packed(self, corpus: Corpus, at: np.ndarray, **more: np.ndarray) -> bytes:
        first = runs(self.u[at])
        sizes = np.diff(np.append(first, len(at)))
        held = np.concatenate([self.u[at][first], self.w[at]])
        if len(self.words) < 32 * len(held):  # few enough to mark those that are used
            marks = np.zeros(len(self.words), bool)
            marks[held] = True
            used, place = np.flatnonzero(marks), (np.cumsum(marks, dtype=np.int32) - 1)[held]
        else:
            used, place = np.unique(held, return_inverse=True)
        place = place.astype(np.int32, copy=False)
        return pack(**corpus.code("words", self.words[used]), u=place[: len(first)], size=sizes.astype(np.int32), w=place[len(first) :], **more)


def pairs_of(corpus: Corpus, rows: list[dict[str, np.ndarray]], *values: str) -> tuple[Pairs, list[np.ndarray]]:
    """The pairs of some packed rows, their ``values`` summed; and the place of each row's pairs among them."""
    held = [corpus.words_in(r, "words") for r in rows]
    words = distinct(np.concatenate([np.empty(0, np.uint64), *held]))
    keys, n = [], np.int64(max(1, len(words)))
    for r, own in zip(rows, held, strict=True):
        at = np.searchsorted(words, own)
        keys.append(np.repeat(at[r["u"]], r["size"]) * n + at[r["w"]])
    every = np.concatenate([np.empty(0, np.int64), *keys])
    found = summed(every, *(np.concatenate([np.empty(0, np.int64), *(r[v] for r in rows)]) for v in values))
    return Pairs(words, found[0] // n, found[0] % n, found[1] if values else None), [np.searchsorted(found[0], k) for k in keys]


def block_pairs(block: Block) -> tuple[Pairs, np.ndarray, np.ndarray]:
    """(distinct pairs of a block without counts, tokens in order of their pairs, first of each pair in that order)."""
    words, at = np.unique(np.append(block.tokens, START), return_inverse=True)
    w = at[:-1]
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[block.first] = at[-1]
    key = u * len(words) + w
    order = stable_order(key, len(words) ** 2)
    first = runs(key[order])
    return Pairs(words, u[order[first]], w[order[first]], None), order, first


def count_pairs(source: DataFrame, corpus: Corpus) -> dict[str, DataFrame]:
    """Packed rows of all pairs by bucket, with what they ask of the parent and send to it, each with one table."""
    sent = source.sparkSession.sparkContext.broadcast(corpus)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            for block in blocks(batches):
                pairs, order, first = block_pairs(block)
                n = np.add.reduceat(block.trained()[order].astype(np.int64), first)
                bucket = sent.value.bucket(pairs.words[pairs.u], pairs.words[pairs.w])
                for b, at in split(bucket):
                    yield b, "counted", 0, pairs.packed(sent.value, at, c=n[at])

        yield from batches_of(rows())

    def merged(key: int, kinds: dict[str, list[Row]]) -> Iterator[Row]:
        known = sent.value
        pairs, _ = pairs_of(known, [unpack(row[3]) for row in kinds["counted"]], "c")
        c, u, w = pairs.c, pairs.u, pairs.w
        every, many = np.arange(len(c)), np.flatnonzero(c > 1)
        yield key, "pairs", 0, pairs.packed(known, every, c=c)
        first = pairs.first()
        context = u[first]
        apart, at = found_in(known.heavy, pairs.words[context])
        singles, customers = np.add.reduceat((c == 1).astype(np.int64), first), np.add.reduceat(c, first)
        used = np.zeros(len(pairs.words), bool)
        used[u[many]] = True
        yield key, "multi", 0, pairs.packed(known, many, c=c[many], singles=singles[used[context]])
        for row in up(known, key, pairs.words[w], (c == 1).astype(np.int64)):
            yield row[0], "fixed", row[2], row[3]
        yield from up(known, key, pairs.words[w], (c > 1).astype(np.int64))
        yield from asked(known, key, "ask", pairs.words[distinct(w)])
        yield from asked(known, key, "ask_many", pairs.words[distinct(w[many])])
        yield int((c == 1).sum()), "ones", int((c == 2).sum()), None
        for h, t in zip(at[apart].tolist(), np.add.reduceat((c > 0).astype(np.int64), first)[apart].tolist(), strict=True):
            yield h, "heavy", t, None

    return by_kind(grouped(source.mapInArrow(counted, SCHEMA), merged), "lm-pairs")


def up(corpus: Corpus, bucket: int, words: np.ndarray, tables: np.ndarray) -> Iterator[Row]:
    """Tables per word, as customers for the chunks of the parent."""
    held = tables > 0
    words, n = summed(words[held], tables[held])
    for chunk, at in split(corpus.chunk(words)):
        yield chunk, "up", bucket, pack(**corpus.code("w", words[at]), n=n[at])


def asked(corpus: Corpus, bucket: int, kind: str, words: np.ndarray) -> Iterator[Row]:
    """Words that are not frequent, whose counts the bucket asks of the chunks."""
    rare = np.sort(words[~found_in(corpus.frequent, words)[0]])
    for chunk, at in split(corpus.chunk(rare)):
        yield chunk, kind, bucket, pack(w=rare[at])


# ---- the parent ------------------------------------------------------------


@dataclass
class Parent:
    """The parent's counts after a round: of all words, and one by one of the frequent ones."""

    customers: int
    tables: int
    c: np.ndarray
    t: np.ndarray

    def chance(self, corpus: Corpus, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Predictive probability of words with c customers at t tables."""
        d, total = corpus.root_discount, STRENGTH + self.customers
        return (np.maximum(c - d * t, 0) + (STRENGTH + d * self.tables) / (corpus.words + 1)) / total


def seat_parent(words: DataFrame, fixed: DataFrame, sent_up: DataFrame, before: DataFrame | None, corpus: Corpus, tables: int, turn: int) -> tuple[DataFrame, Parent]:
    """(packed rows of customers and tables by chunk, the parent) after the customers changed."""
    sent = words.sparkSession.sparkContext.broadcast(corpus)

    def seated(key: int, kinds: dict[str, list[Row]]) -> Iterator[Row]:
        known = sent.value
        words = unpack(kinds["words"][0][3])["w"]
        c = np.zeros(len(words), np.int64)
        for row in [*kinds.get("fixed", []), *kinds.get("up", [])]:
            part = unpack(row[3])
            c[np.searchsorted(words, known.words_in(part, "w"))] += part["n"]
        t = unpack(kinds["parent"][0][3])["t"] if "parent" in kinds else np.ones(len(words), np.int64)
        strength = STRENGTH + known.root_discount * np.maximum(tables - t, 0)
        t = drawn_tables(c, strength, np.full(len(words), 1 / (known.words + 1)), known.root_discount, words, turn)
        yield key, "parent", turn, pack(c=c, t=t)
        there, at = found_in(known.frequent, words)
        yield int(c.sum()), "frequent", int(t.sum()), pack(at=at[there], c=c[there], t=t[there])

    rows = words.unionByName(fixed).unionByName(sent_up)
    rows = rows if before is None else rows.unionByName(before)
    found = by_kind(grouped(rows, seated), "lm-parent")
    parent = Parent(0, 0, np.zeros(len(corpus.frequent), np.int64), np.zeros(len(corpus.frequent), np.int64))
    for row in found["frequent"].collect():
        part = unpack(row.data)
        parent.c[part["at"]], parent.t[part["at"]] = part["c"], part["t"]
        parent.customers, parent.tables = parent.customers + row.key, parent.tables + row.at
    return found["parent"], parent


def answers(asks: DataFrame, words: DataFrame, parents: list[DataFrame]) -> DataFrame:
    """To each bucket the counts of its rare words: training tokens, and customers and tables in each of ``parents``."""

    def answered(key: int, kinds: dict[str, list[Row]]) -> Iterator[Row]:
        own = unpack(kinds["words"][0][3]) if "words" in kinds else {"w": np.empty(0, np.uint64), "n": np.empty(0, np.int64)}
        held = [unpack(row[3]) for row in kinds.get("parent", [])]
        for row in [*kinds.get("ask", []), *kinds.get("ask_many", [])]:
            words = unpack(row[3])["w"]
            there, at = found_in(own["w"], words)
            at = at[there]
            if not len(at):
                continue
            more = {f"{name}{i}": p[name][at] for i, p in enumerate(held) for name in ("c", "t")}
            yield row[2], "answer", key, pack(w=words[there], n=own["n"][at], **more)

    rows = asks.unionByName(words)
    for parent in parents:
        rows = rows.unionByName(parent)
    return grouped(rows, answered)


def counts_of(corpus: Corpus, words: np.ndarray, replies: list[Row], parents: list[Parent]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(training tokens, predictive probability under each of ``parents``) of sorted words."""
    n, c, t = np.zeros(len(words), np.int64), np.zeros((len(parents), len(words)), np.int64), np.zeros((len(parents), len(words)), np.int64)
    there, at = found_in(corpus.frequent, words)
    n[there] = corpus.counts[at[there]]
    for i, parent in enumerate(parents):
        c[i, there], t[i, there] = parent.c[at[there]], parent.t[at[there]]
    for row in replies:
        part = unpack(row[3])
        there, at = found_in(words, part["w"])
        n[at[there]] = part["n"][there]
        for i in range(len(parents)):
            c[i, at[there]], t[i, at[there]] = part[f"c{i}"][there], part[f"t{i}"][there]
    return n, [p.chance(corpus, c[i], t[i]) for i, p in enumerate(parents)]


# ---- rounds ----------------------------------------------------------------


def seat_contexts(multi: DataFrame, before: DataFrame | None, replies: DataFrame, corpus: Corpus, parent: Parent, turn: int) -> dict[str, DataFrame]:
    """Packed rows of the tables of all pairs with several customers, and what they send up, given the parent."""
    sent = multi.sparkSession.sparkContext.broadcast((corpus, parent))

    def seated(key: int, kinds: dict[str, list[Row]]) -> Iterator[Row]:
        known, above = sent.value
        if "multi" not in kinds:
            return
        row = unpack(kinds["multi"][0][3])
        pairs, _ = pairs_of(known, [row], "c")
        if not len(pairs.c):
            return
        t = unpack(kinds["seats"][0][3])["t"] if "seats" in kinds else np.ones(len(pairs.c), np.int64)
        first = pairs.first()
        size = np.diff(np.append(first, len(t)))
        apart, at = found_in(known.heavy, pairs.words[pairs.u[first]])
        tables = row["singles"] + np.add.reduceat(t, first)
        tables[apart] = known.totals[at[apart]]
        _, (base,) = counts_of(known, pairs.words, kinds.get("answer", []), [above])
        strength = STRENGTH + known.discount * np.maximum(np.repeat(tables, size) - t, 0)
        t = drawn_tables(pairs.c, strength, base[pairs.w], known.discount, pairs.keys(), turn)
        yield key, "seats", turn, pack(t=t)
        yield from up(known, key, pairs.words[pairs.w], t)
        mine = (row["singles"] + np.add.reduceat(t, first))[apart]
        for h, n in zip(at[apart].tolist(), mine.tolist(), strict=True):
            yield h, "heavy", n, None
        hot = np.flatnonzero(pairs.c >= known.limit)
        if len(hot):
            yield key, "hot", turn, pack(u=pairs.words[pairs.u[hot]], w=pairs.words[pairs.w[hot]], c=pairs.c[hot], t=t[hot])

    rows = multi.unionByName(replies)
    return by_kind(grouped(rows if before is None else rows.unionByName(before), seated), "lm-seats")


def heavy_totals(rows: DataFrame, corpus: Corpus) -> np.ndarray:
    out = np.zeros(len(corpus.heavy), np.int64)
    for row in rows.groupBy("key").agg(F.sum("at").alias("n")).collect():
        out[row.key] = row.n
    return out


@dataclass
class Sample:
    """The seating after one round; heavy totals and the frequent words' part of the parent are at hand."""

    seats: DataFrame
    parent_rows: DataFrame
    parent: Parent
    totals: np.ndarray
    hot: list[dict[str, np.ndarray]]


@dataclass
class Model:
    """Samples of the seating over all training pairs, as tables in the shared folder."""

    corpus: Corpus
    words: DataFrame
    pairs: dict[str, DataFrame]
    samples: list[Sample]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, burn: int = BURN) -> Model:
    """The model of the training rows; pairs of the other rows are kept too, without customers."""
    source = _source(docs, doc_id, text)
    size = source.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    width = source.sparkSession.sparkContext.defaultParallelism
    buckets = max(width, size // BUCKET_BYTES)
    words, corpus = count_words(source, Corpus(buckets, chunks=buckets))
    pairs = count_pairs(source, corpus)
    ones = pairs["ones"].agg(F.sum("key"), F.sum("at")).first()
    corpus = replace(corpus, discount=discount_of(ones[0] or 0, ones[1] or 0), totals=heavy_totals(pairs["heavy"], corpus))
    rows, parent = seat_parent(words, pairs["fixed"], pairs["up"], None, corpus, corpus.words, 0)
    seats, samples = None, []
    for turn in range(1, rounds + 1):
        replies = answers(pairs["ask_many"], words, [rows])
        found = seat_contexts(pairs["multi"], seats, replies, corpus, parent, 2 * turn)
        seats = found["seats"]
        corpus = replace(corpus, totals=heavy_totals(found["heavy"], corpus))
        rows, parent = seat_parent(words, pairs["fixed"], found["up"], rows, corpus, parent.tables, 2 * turn + 1)
        if turn > burn:
            hot = [unpack(row.data) for row in found["hot"].collect()]
            samples.append(Sample(seats, rows, parent, corpus.totals, hot))
    return Model(corpus, words, pairs, samples)


# ---- scores ----------------------------------------------------------------


def predictive(corpus: Corpus, c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Probability of a word with c customers at t tables in a restaurant, given the parent's."""
    d = corpus.discount
    inner = (np.maximum(c - d * t, 0) + (STRENGTH + d * tables) * base) / (STRENGTH + customers)
    return np.where(customers > 0, inner, base)


def hot_scores(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hash, log10 probability) of the pairs with more tokens than a bucket."""
    corpus, mean = model.corpus, {}
    for s in model.samples:
        for part in s.hot:
            _, (base,) = counts_of(corpus, part["w"], [], [s.parent])
            at = found_in(corpus.heavy, part["u"])[1]
            p = predictive(corpus, part["c"], part["t"], corpus.customers[at], s.totals[at], base)
            for key, x in zip(mix(mix(part["u"]) + part["w"]).tolist(), p.tolist(), strict=True):
                mean[key] = mean.get(key, 0) + x / len(model.samples)
    keys = np.array(sorted(mean), np.uint64)
    return keys, np.log10([mean[k] for k in keys.tolist()]) if mean else np.empty(0)


def _cut(source: DataFrame, model: Model, base_of) -> DataFrame:
    """Packed rows of the pairs of all texts by bucket, each with its texts, and of each block's texts."""
    sent = source.sparkSession.sparkContext.broadcast((model.corpus, *hot_scores(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, hot, hot_log = sent.value

        def rows() -> Iterator[Row]:
            for number, block in enumerate(blocks(batches)):
                name = TaskContext.get().partitionId() << 24 | number
                pairs, order, first = block_pairs(block)
                text = np.repeat(np.arange(len(block.first)), block.sizes())
                at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
                key = at * len(block.first) + text[order]
                begin = runs(key)
                n = np.diff(np.append(begin, len(key)))
                pair, doc = at[begin], text[order[begin]]
                there, place = found_in(hot, pairs.keys() if len(hot) else np.empty(len(first), np.uint64))
                inside = there[pair] if len(hot) else np.zeros(len(pair), bool)
                score = np.bincount(doc[inside], n[inside] * hot_log[place[pair[inside]]], len(block.first)) if inside.any() else np.zeros(len(block.first))
                known, where = found_in(corpus.frequent, block.tokens)
                count = np.where(known, corpus.counts[where] if len(corpus.counts) else 0, 0)
                # words that are not frequent are added where their counts are known
                base = np.add.reduceat(np.where(known, base_of(corpus, count), 0.0), block.first)
                info = pa.RecordBatch.from_arrays(
                    [
                        block.rows.column("id").combine_chunks(), block.rows.column("held").combine_chunks(),
                        pa.array(block.sizes()), pa.array(np.add.reduceat(known.astype(np.int64), block.first)), pa.array(base), pa.array(score),
                    ],
                    names=["id", "held", "tokens", "known", "base", "score"],
                )
                yield name % corpus.buckets, "home", name, to_ipc(info)
                bucket = corpus.bucket(pairs.words[pairs.u], pairs.words[pairs.w])
                pair, doc, n = pair[~inside], doc[~inside], n[~inside]
                texts = np.bincount(pair, minlength=len(first))
                edge = np.concatenate([[0], np.cumsum(texts)])
                for b, mine in split(bucket):
                    mine = mine[texts[mine] > 0]
                    if len(mine):
                        rows_ = np.repeat(edge[mine] - np.concatenate([[0], np.cumsum(texts[mine])[:-1]]), texts[mine]) + np.arange(texts[mine].sum())
                        yield b, "texts", name, pairs.packed(corpus, mine, texts=texts[mine].astype(np.int32), doc=doc[rows_].astype(np.int32), n=n[rows_].astype(np.int32))

        yield from batches_of(rows())

    return source.mapInArrow(run, SCHEMA)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def base_log(corpus: Corpus, count: np.ndarray) -> np.ndarray:
    """log10 of the smoothed share of a word with ``count`` training tokens."""
    return np.log10((count + 0.1) / (corpus.tokens + 0.1 * (corpus.words + 1)))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of the table given to ``train``."""
    source = _source(docs, doc_id, text)
    corpus, parents = model.corpus, [s.parent for s in model.samples]
    context = source.sparkSession.sparkContext
    sent = context.broadcast((corpus, parents, [s.totals for s in model.samples]))
    rows = _cut(source, model, base_log).unionByName(model.pairs["pairs"])
    rows = rows.unionByName(answers(model.pairs["ask"], model.words, [s.parent_rows for s in model.samples]))
    for s in model.samples:
        rows = rows.unionByName(s.seats)

    def scored(key: int, kinds: dict[str, list[Row]]) -> Iterator[Row]:
        known, above, totals = sent.value
        for row in kinds.get("home", []):
            yield row[2], "home", -1, row[3]
        if "texts" not in kinds:
            return
        parts = [unpack(row[3]) for row in kinds["texts"]]
        own = unpack(kinds["pairs"][0][3]) if "pairs" in kinds else None
        for part in parts:
            part["c"] = np.zeros(len(part["w"]), np.int64)
        pairs, places = pairs_of(known, ([own] if own else []) + parts, "c")
        places = places[1:] if own else places
        first = pairs.first()
        size = np.diff(np.append(first, len(pairs.c)))
        apart, at = found_in(known.heavy, pairs.words[pairs.u[first]])
        customers = np.add.reduceat(pairs.c, first)
        customers[apart] = known.customers[at[apart]]
        count, bases = counts_of(known, pairs.words, kinds.get("answer", []), above)
        many = pairs.c > 1
        seats = sorted(kinds.get("seats", []), key=lambda row: row[2])
        mean = np.zeros(len(pairs.c))
        for i, base in enumerate(bases):
            t = np.minimum(pairs.c, 1)
            if many.any():
                t[many] = unpack(seats[i][3])["t"]
            tables = np.add.reduceat(t, first)
            tables[apart] = totals[i][at[apart]]
            mean += predictive(known, pairs.c, t, np.repeat(customers, size), np.repeat(tables, size), base[pairs.w]) / len(bases)
        log = np.log10(mean)
        rare = ~found_in(known.frequent, pairs.words)[0]
        share = np.where(rare, base_log(known, count), 0.0)
        seen = (rare & (count > 0)).astype(np.int64)
        for row, part, place in zip(kinds["texts"], parts, places, strict=True):
            pair = np.repeat(place, part["texts"])
            w = pairs.w[pair]
            doc = np.flatnonzero(np.bincount(part["doc"]))
            sums = [np.bincount(part["doc"], part["n"] * x)[doc] for x in (log[pair], share[w], seen[w])]
            yield row[2], "part", key, pack(doc=doc.astype(np.int32), score=sums[0], base=sums[1], known=sums[2].astype(np.int64))

    kind = docs.schema[doc_id].dataType
    schema = T.StructType(
        [T.StructField(doc_id, kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )

    def gathered(table: pa.Table) -> pa.Table:
        rows = sorted(rows_of(table), key=lambda row: row[2])
        info = pa.ipc.open_stream(rows[0][3]).read_all()
        sums = {name: info.column(name).to_numpy().copy() for name in ("score", "base", "known")}
        for row in rows[1:]:
            part = unpack(row[3])
            for name, values in sums.items():
                values[part["doc"]] += part[name]
        n = info.num_rows
        columns = [info.column("id"), info.column("held"), info.column("tokens"), pa.array(sums["known"]), pa.array(np.full(n, sent.value[0].tokens)), pa.array(sums["base"]), pa.array(sums["score"])]
        return pa.table(columns, names=[f.name for f in schema])

    return grouped(rows, scored).groupBy("key").applyInArrow(gathered, schema)


def perplexity(scored: DataFrame) -> DataFrame:
    """(held_out, n_tokens, perplexity, base_perplexity) of the rows that were learned from and of the others."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), power("score").alias("perplexity"), power("base_score").alias("base_perplexity"))
