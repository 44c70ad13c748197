"""MinHash signatures, band buckets, near-duplicate texts and banded search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectable import session
from vectable.functions.text import one_per_row, shingles, tokens
from vectable.operators.search import search, top_ranked

BANDS = 8  # fixed value: declared parameter
NUM_HASH = 32
PRIME = 2**31 - 1
HOT_PAIRS = 65536
HOT_MEMBERS = 256
_GROWTH = 16


def hash_parameters(num_hash: int) -> list[tuple[int, int]]:
    """(a, b) of the i-th hash (a * h + b) mod PRIME, drawn from a scrambled counter."""

    def drawn(n: int) -> int:
        x = (n + 1) * 0x9E3779B97F4A7C15 % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor % 2**64
        return x ^ (x >> 31)

    return [(1 + drawn(2 * i) % (PRIME - 1), drawn(2 * i + 1) % PRIME) for i in range(num_hash)]


def minhash(df: DataFrame, num_hash: int = NUM_HASH) -> DataFrame:
    """(id, signature) of rows (id, shingles); rows without shingles have none.

    All minima are one hash aggregation; each task combines the shingles of its
    own texts before the shuffle.
    """
    prefix = F.substring(F.md5(F.col("s").cast("binary")), 1, 7)
    return _signatures(
        one_per_row(df, "shingles", "id", name="s").select(
            "id", F.conv(prefix, 16, 10).cast("bigint").alias("h")
        ),
        num_hash,
    )


def _signatures(hashed: DataFrame, num_hash: int) -> DataFrame:
    """Signatures of (id, h) rows, h below 2^28."""
    minima = [
        F.min((F.lit(a) * F.col("h") + F.lit(b)) % F.lit(PRIME)).alias(f"m{i}")
        for i, (a, b) in enumerate(hash_parameters(num_hash))
    ]
    lowest = hashed.groupBy("id").agg(*minima)
    return lowest.select("id", F.array(*[F.col(f"m{i}") for i in range(num_hash)]).alias("signature"))


def band_keys(sig: DataFrame, num_hash: int = NUM_HASH, bands: int = BANDS) -> DataFrame:
    """(id, band, key): one row per band of every signature."""
    if num_hash % bands:
        raise ValueError("bands must divide the number of hashes")
    rows = num_hash // bands
    parts = [F.slice("signature", b * rows + 1, rows) for b in range(bands)]
    others = [c for c in sig.columns if c != "signature"]
    return sig.select(*others, F.posexplode(F.array(*parts)).alias("band", "key"))


def _buckets(banded: DataFrame) -> DataFrame:
    """(band, key, first, n) of the buckets with more than one member."""
    return (
        banded.groupBy("band", "key")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )


def lsh_candidates(sig: DataFrame, num_hash: int = NUM_HASH, bands: int = BANDS) -> DataFrame:
    """(band, first_id, id): every row linked to the smallest id of each bucket it is in.

    A bucket is named by its band and its smallest id, which is in one bucket of
    a band only: two rows share a bucket exactly when they share band and
    first_id (or one is the other's). So the links say what all pairs would
    say, in at most ``bands`` rows per signature.
    """
    banded = session.stored(band_keys(sig, num_hash, bands), "bands")  # read for the buckets and for their members
    links = banded.join(_buckets(banded), ["band", "key"]).filter(F.col("id") != F.col("first"))
    return links.select("band", F.col("first").alias("first_id"), "id").distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct-element arrays, rounded."""
    both = F.size(F.array_intersect(a, b))
    return F.round(both / (F.size(a) + F.size(b) - both), 6)


def near_duplicates(
    df: DataFrame,
    threshold: float,
    n: int = 3,
    num_hash: int = NUM_HASH,
    bands: int = BANDS,
) -> DataFrame:
    """(id, first_id, jaccard): each text that repeats an earlier one, with the earliest.

    ``df`` has ``id`` and ``text``. A text of fewer than n words is one shingle;
    null texts and texts without a word repeat nothing.
    ``first_id`` is the smallest id that shares a band and has at least the
    threshold's Jaccard similarity. Texts with the same shingles are folded into
    their smallest id first. Inside a bucket the members are compared with its
    smallest ids, then with the next ones, and only as long as an unseen smaller
    id could still be the answer; nothing is left out and no bucket is gathered
    in one task. Buckets of more than ``HOT_MEMBERS`` are first cut, without
    loss, into the texts that share a rare shingle.
    """
    texts = session.spread(df.select("id", "text").filter(F.size(tokens(F.coalesce("text", F.lit("")))) > 0))
    grams = shingles(texts, "text", n)
    whole = F.array(F.array_join(tokens("text"), " "))
    grams = grams.withColumn("shingles", F.when(F.size("shingles") > 0, F.col("shingles")).otherwise(whole))
    # A shingle is kept as the first 60 bits of its md5; the top 28 feed the signature.
    as_number = F.transform(
        "shingles", lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 15), 16, 10).cast("bigint")
    )
    sets = session.stored(grams.select("id", F.sort_array(as_number).alias("shingles")), "shingles")
    # Two hashes from different starts: 128 bits tell the sets apart.
    marks = [F.xxhash64(F.lit(start), "shingles").alias(f"mark{start}") for start in (1, 2)]
    marked = sets.select("id", *marks)
    folded = marked.groupBy("mark1", "mark2").agg(F.min("id").alias("rep"))
    copies = session.stored(marked.join(folded, ["mark1", "mark2"]).select("id", "rep"), "copies")
    own = sets.join(copies.filter(F.col("id") == F.col("rep")).select("id"), "id", "left_semi")
    own = session.stored(own, "own")
    hashed = one_per_row(own, "shingles", "id", name="s").select("id", F.shiftright("s", 32).alias("h"))
    signed = _signatures(hashed, num_hash).join(own.select("id", F.size("shingles").alias("size")), "id")
    banded = session.stored(band_keys(signed, num_hash, bands), "bands")
    members = banded.join(_buckets(banded).select("band", "key", "n"), ["band", "key"])
    members = session.stored(members.select("band", "key", "id", "size", "n"), "members")
    # Every round below deals the sets by id: only those of texts that share a bucket are needed.
    own = session.stored(own.join(members.select("id").distinct(), "id", "left_semi"), "own")
    if not members.filter(F.col("n") > HOT_MEMBERS).isEmpty():
        members = session.stored(_cut_buckets(own, members, threshold), "members")
    best = _earliest(own, members, threshold)
    # A folded text repeats its representative, unless that one has an earlier match.
    return (
        copies.join(best.withColumnRenamed("id", "rep"), "rep", "left")
        .select(
            "id",
            F.when(F.col("first_id").isNotNull(), F.col("first_id"))
            .when(F.col("id") != F.col("rep"), F.col("rep")).alias("first_id"),
            F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"),
        )
        .filter(F.col("first_id").isNotNull())
    )


def _cut_buckets(own: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """``members`` with each bucket of more than ``HOT_MEMBERS`` cut by rare shingles.

    Two sets that reach the threshold share at least ceil(threshold * size)
    shingles of either, so with the shingles of each in one order, they share one
    of the first size - ceil(threshold * size) + 1. The order is by the number of
    rows in the bucket that have the shingle, rarest first: texts that have
    little in common meet in few of the smaller buckets, whose key is the old
    one and the shingle. The rows grow with the shingles, not with the pairs.
    """
    hot = members.filter(F.col("n") > HOT_MEMBERS).select("band", "key", "id", "size")
    held = one_per_row(hot.join(own, "id"), "shingles", "band", "key", "id", "size", name="s")
    often = held.groupBy("band", "key", "s").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("band", "key", "id").orderBy("rows", "s")
    needed = F.col("size") - F.ceil(F.col("size") * F.lit(threshold - 1e-6)) + 1
    first = (
        held.join(often, ["band", "key", "s"])
        .withColumn("place", F.row_number().over(order))
        .filter((F.col("place") <= needed) & (F.col("rows") > 1))
        .select("band", F.concat("key", F.array("s")).alias("key"), "id", "size")
    )
    first = session.stored(first, "cut")
    sizes = first.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return members.filter(F.col("n") <= HOT_MEMBERS).unionByName(first.join(sizes, ["band", "key"]))


def _earliest(own: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(id, first_id, jaccard) of the earliest match of each row in its buckets."""
    best, pending, seen, size = None, members, 0, 1
    rank = F.row_number().over(Window.partitionBy("band", "key").orderBy("id"))
    while True:
        open_buckets = pending.select("band", "key").distinct()
        heads = session.cut(
            members.join(open_buckets, ["band", "key"], "left_semi")
            .select("band", "key", F.col("id").alias("first_id"), F.col("size").alias("their_size"), rank.alias("rn"))
            .filter(F.col("rn") <= size)
        )
        anchors = heads.filter(F.col("rn") > seen).drop("rn")
        # Sets of too unequal size cannot reach the threshold.
        likely = F.least("size", "their_size") >= F.lit(threshold - 1e-6) * F.greatest("size", "their_size")
        pairs = pending.join(anchors, ["band", "key"]).filter((F.col("first_id") < F.col("id")) & likely)
        if best is not None:
            pairs = pairs.filter(F.col("best").isNull() | (F.col("first_id") < F.col("best")))
        pairs = pairs.select("id", "first_id").distinct()
        earlier = own.select(F.col("id").alias("first_id"), F.col("shingles").alias("theirs"))
        found = (
            pairs.join(own, "id").join(earlier, "first_id")
            .withColumn("jaccard", jaccard(F.col("shingles"), F.col("theirs")))
            .filter(F.col("jaccard") >= threshold)
            .select("id", "first_id", "jaccard")
        )
        both = found if best is None else best.unionByName(found)
        best = session.cut(
            both.groupBy("id")
            .agg(F.min(F.struct("first_id", "jaccard")).alias("b"))
            .select("id", "b.first_id", "b.jaccard")
        )
        last = heads.filter(F.col("rn") == size).select("band", "key", F.col("first_id").alias("last"))
        known = best.select("id", F.col("first_id").alias("best"))
        pending = session.cut(
            pending.select("band", "key", "id", "size", "n")
            .filter(F.col("n") > size + 1)
            .join(last, ["band", "key"])
            .join(known, "id", "left")
            .filter(F.col("last") < F.least("id", "best"))
            .select("band", "key", "id", "size", "n", "best")
        )
        if pending.isEmpty():
            return best
        seen, size = size, size * _GROWTH


def lsh_search(
    sig: DataFrame,
    query_sig: DataFrame,
    k: int,
    num_hash: int = NUM_HASH,
    bands: int = BANDS,
    **options,
) -> DataFrame:
    """k best rows by share of equal hashes, among rows that share a band with the query.

    Equal signatures score alike: each is joined once, and stands for its k
    smallest ids. A bucket that would give many pairs is searched in cells that
    keep k rows per query; the others are joined.
    """
    smallest = F.row_number().over(Window.partitionBy("signature").orderBy("id"))
    stored = sig.withColumn("place", smallest).filter(F.col("place") <= k)
    heads = stored.filter(F.col("place") == 1).select("id", "signature")
    asked = query_sig.groupBy("signature").agg(F.min("query_id").alias("id"))
    left, right = (
        session.stored(band_keys(side.withColumn("vector", F.col("signature")), num_hash, bands), name)
        for side, name in ((heads, "heads"), (asked, "asked"))
    )
    bucket = ["band", "key"]
    sizes = left.groupBy(*bucket).agg(F.count("*").alias("nl")).join(
        right.groupBy(*bucket).agg(F.count("*").alias("nr")), bucket
    )
    hot = session.cut(sizes.filter(F.col("nl") * F.col("nr") > HOT_PAIRS).select(*bucket))
    hot_keys = session.broadcast_checked(hot, 100_000)
    pairs = (
        left.join(hot_keys, bucket, "left_anti").select(*bucket, F.col("id").alias("head"), F.col("vector").alias("theirs"))
        .join(right.select(*bucket, F.col("id").alias("asker"), F.col("vector").alias("ours")), bucket)
        .groupBy("asker", "head")
        .agg(F.first("theirs").alias("theirs"), F.first("ours").alias("ours"))
    )
    equal = F.aggregate(
        F.zip_with("theirs", "ours", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x
    )
    scored = pairs.select(
        F.col("asker").alias("query_id"),
        F.col("head").alias("id"),
        F.round(equal / F.lit(float(num_hash)), 6).alias("score"),
    )
    if not hot.isEmpty():
        name = F.concat_ws("-", F.col("band").cast("string"), F.col("key").cast("array<string>"))
        base = left.join(hot_keys, bucket, "left_semi").select("id", "vector", name.alias("key"))
        queries = (
            right.join(hot_keys, bucket, "left_semi")
            .groupBy(F.col("id").alias("query_id"))
            .agg(F.first("vector").alias("vector"), F.collect_list(name).alias("keys"))
        )
        found = search(base, queries, k, "AGREEMENT", keyed=True, repeated=True, **options)
        scored = scored.unionByName(found.select("query_id", "id", "score")).distinct()
    signature_of = asked.select(F.col("id").alias("asker"), "signature")
    groups = top_ranked(scored, k, "AGREEMENT").select(
        F.col("query_id").alias("asker"), F.col("id").alias("head"), "score"
    )
    group_of = heads.select(F.col("id").alias("head"), "signature")
    listed = stored.select("signature", "id").join(group_of, "signature").select("head", "id")
    per_asker = top_ranked(
        groups.join(listed, "head").select(F.col("asker").alias("query_id"), "id", "score"), k, "AGREEMENT"
    )
    queries = query_sig.join(signature_of, "signature").select("query_id", "asker")
    return queries.join(per_asker.withColumnRenamed("query_id", "asker"), "asker").select(
        "query_id", "id", "score", "rank"
    )
