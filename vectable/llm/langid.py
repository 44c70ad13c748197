"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased text with every run
of other than letters as one space; each is hashed to a row of an embedding
table. A text is the mean of its rows, a linear layer and a softmax give the
classes. Embeddings and layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows (``SAMPLE_ROWS`` per label,
``SAMPLE_TOTAL`` in all, of at most ``SAMPLE_BYTES`` each, by a hash of the id). A temperature is
fitted on a part of the sample that takes no steps. With a level ``MARGIN`` of the
way from chance (one in the number of labels) to certainty, the rejection threshold is the
highest score at which the accuracy of that part, made monotone in the score, is
below the level; and at least the level itself, as scores are calibrated, as far as
that takes no more than ``SPARED`` of the right answers, less those that guesses get right. No share of rows bounds it;
fewer than ``EVIDENCE`` held-back rows set none.

Prediction reads whole texts. Since the layer is linear, tasks get the product
of table and layer: one short row of class scores per bucket, of fixed size.

Results in odd cases: null texts, and texts without a letter, are ``und`` with
score 0 and rejected; equal scores go to the smaller label; with no labelled row
every text is ``und``; with one label no score tells texts apart and only texts
without letters go; labels that are null are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.llm.arrow import slices
from vectable.session import broadcast_checked

SAMPLE_ROWS = 1000
SAMPLE_TOTAL = 6000
SAMPLE_BYTES = 16384
MOST_LABELS = 10_000
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 16
EPOCHS = 6
RATE = 0.5
MARGIN = 0.5  # of the way from chance to certainty: answers less sure than that are rejected
EVIDENCE = 20  # held-back rows without which nothing is known of the scores and no threshold is set
SPARED = 0.005  # share of the right held-back answers that the level alone may reject
UNKNOWN = "und"
_ORDERS = (2, 3, 4)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def buckets_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: (bucket of every subword, first subword of each text and the end)."""
    joined = np.frombuffer(b"".join([b" " + t + b" " for t in texts]), np.uint8)
    folded = _FOLD[joined]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (owner[1:] != owner[:-1])
    folded, owner = folded[keep].astype(np.uint32), owner[keep]
    code, out = folded, []
    for n in range(2, max(_ORDERS) + 1):
        code = code[:-1] * np.uint32(257) + folded[n - 1 :]
        if n in _ORDERS:
            mixed = (code + np.uint32(n)) * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
            inside = owner[n - 1 :] == owner[: len(code)]
            of = owner[: len(code)][inside]
            out.append(((mixed >> np.uint32(32 - BUCKET_BITS))[inside], np.searchsorted(of, np.arange(len(texts) + 1))))
    return out


def _bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of each text."""
    orders = buckets_of(texts)
    return [np.unique(np.concatenate([b[f[n] : f[n + 1]] for b, f in orders]), return_counts=True) for n in range(len(texts))]


@dataclass
class Model:
    """Class scores per bucket (embedding times layer), bias, temperature and rejection threshold."""

    labels: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out, count = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for bucket, first in buckets_of(texts):
            held = np.flatnonzero(np.diff(first) > 0)
            if len(held):
                out[held] += np.add.reduceat(self.scores[bucket], first[held], axis=0)
            count += np.diff(first)
        return out / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sample(rows: DataFrame, per_label: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, total: int = SAMPLE_TOTAL) -> DataFrame:
    """(text, lang) of at most ``per_label`` rows of (id, text, lang) per label, and about ``total`` in all.

    Labels are counted first, so that tasks send about twice the wanted rows
    whatever the size of the table.
    """
    held = rows.filter("lang is not null and text is not null").filter(F.octet_length("text") <= most_bytes)
    counts = held.groupBy("lang").agg(F.count("*").alias("n_rows"))
    per_label = max(1, min(per_label, total // max(1, counts.count())))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(1 << 30)
    drawn = held.join(broadcast_checked(counts, MOST_LABELS), "lang").filter(draw * F.col("n_rows") < 2 * per_label)
    order = Window.partitionBy("lang").orderBy(draw, "id", F.xxhash64("text"))
    return drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_label).select("text", "lang")


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model of (text, lang) rows; every fifth row only calibrates."""
    rows = sorted(set(rows))
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    texts = [rows[i][0].encode() for i in order]
    target = np.array([labels.index(rows[i][1]) for i in order])
    bags = [bag for at in range(0, len(texts), 64) for bag in _bags(texts[at : at + 64])]
    table = random.normal(0, 0.1, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    learn = [n for n in range(len(texts)) if n % 5 and len(bags[n][0])]
    steps = max(1, EPOCHS * len(learn))
    done = 0
    for _ in range(EPOCHS):
        for n in random.permutation(learn):
            rate = RATE * (1 - done / steps)
            done += 1
            mine, count = bags[n]
            share = count / count.sum()
            mean = share @ table[mine]
            p = softmax(mean @ layer + bias)
            p[target[n]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            table[mine] -= (rate * len(mine) ** 0.5) * np.outer(share, back)
    model = Model(labels, (table @ layer).astype(np.float32), bias)
    return calibrated(model, [t for n, t in enumerate(texts) if n % 5 == 0], target[::5])


def calibrated(model: Model, texts: list[bytes], target: np.ndarray) -> Model:
    """Temperature of least log loss, then the rejection threshold, on held-back rows."""
    if not len(target):
        return model
    z = np.concatenate([model.logits(texts[at : at + 64]) for at in range(0, len(texts), 64)])
    doubt = 1 / (len(target) + 2)  # that no row was wrong does not prove that none will be

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(z / t), 1e-300))
        hit = p[np.arange(len(target)), target]
        return -((1 - doubt) * hit + doubt * p.mean(axis=1)).mean()

    model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
    p = softmax(z / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == target
    if len(target) < EVIDENCE:
        return model
    level = 1 / len(model.labels) + MARGIN * (1 - 1 / len(model.labels))
    order = np.argsort(score, kind="stable")
    below = int((score < level).sum())
    # of guesses one in the number of labels is right: these are no loss
    lost = np.cumsum(np.where(right[order], 1.0, -1.0 / max(1, len(model.labels) - 1)))[:below]
    spared = int(np.max(np.flatnonzero(lost <= SPARED * right.sum()) + 1, initial=0))
    model.threshold = level if spared == below else float(score[order[spared]])
    poor = np.flatnonzero(monotone(right[order]) < level)
    if len(poor):
        model.threshold = max(model.threshold, float(np.nextafter(score[order[poor[-1]]], 1)))
    return model


def monotone(right: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to ``right``: neighbouring blocks are pooled while the first has the higher mean."""
    blocks: list[list[float]] = []
    for x in right.astype(float):
        blocks.append([x, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += n
    return np.repeat([total / n for total, n in blocks], [int(n) for _, n in blocks])


def has_letter(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"\p{L}")


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (calibrated probability) and rejected."""
    df = df.drop("lang_pred", "score", "rejected")
    kept = df.schema.fields
    schema = T.StructType(
        [*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    sent = df.sparkSession.sparkContext.broadcast(model)
    lettered = "_lettered"
    while lettered in df.columns:
        lettered += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text)):
                texts = part.column(text).to_pylist()
                letters = part.column(lettered).to_pylist()
                langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                asked = [n for n, ok in enumerate(letters) if ok] if known else []
                if asked:
                    p = known.probabilities([texts[n].encode() for n in asked])
                    for n, best, score in zip(asked, p.argmax(axis=1), p.max(axis=1), strict=True):
                        langs[n], scores[n] = known.labels[best], min(1.0, float(score))
                low = [lang == UNKNOWN or bool(s < known.threshold) for lang, s in zip(langs, scores, strict=True)]
                columns = {f.name: part.column(f.name) for f in kept}
                yield pa.RecordBatch.from_pydict(
                    columns | {"lang_pred": pa.array(langs), "score": pa.array(scores), "rejected": pa.array(low)}
                )

    return df.withColumn(lettered, has_letter(F.col(text))).mapInArrow(run, schema)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the rows that are not held out."""
    rows = docs.filter(~held_out(F.col(doc_id))).select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    return train([(r.text, r.lang) for r in sample(rows).collect()])


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
