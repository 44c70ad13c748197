"""Fill-in-middle transformation by displacement scatter.

A text of n code points is cut twice; prefix, middle and suffix are put out in
the order prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``),
each behind its sentinel, or the text stays as it is (``plain``). Where to cut
and which form to take is drawn from a hash of seed and id by column functions.

The bytes are moved in numpy for many texts at once: one scan finds the bytes
at which characters start, so that cuts become byte positions; a difference
array holds, at each cut, by how much the shift to the output changes; its
cumulative sum is the shift of every byte, and one scatter builds all outputs.
``restore`` finds the sentinels in the output, lays the same difference array
over the text to be rebuilt and gathers.

Results in odd cases: a null text is the empty text; an empty text, and one that
holds a sentinel, is plain; prefix, middle or suffix may be empty; a null id
draws as the empty id; rows that repeat give the same output; columns of the
input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectable.llm.arrow import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values
PLAIN_FROM = 90  # of 100 draws, those from here on stay plain
SPM_BELOW = 20  # of 100 draws, those below put the suffix first
#: Bytes whose shifts are held at a time.
WINDOW = 1 << 20
_MARK = len(PREFIX)
_CODE = {"plain": 0, "psm": 1, "spm": 2}


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * g + 1, 8), 16, 10).cast("bigint") for g in range(4)]


def transform(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, output: str = "output", restored: str | None = None
) -> DataFrame:
    """``df`` with n (code points), form, prefix_chars, middle_chars (null if plain) and the output text.

    With ``restored`` the text rebuilt from output and form is a column of that name, made in the same pass.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", output, *([restored] if restored else [])]
    kept = [c for c in df.columns if c not in made or c == text]
    quoted = [F.col(f"`{c}`") for c in kept if c != text]
    given = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    n = F.length(given).cast("bigint")
    a, b = F.pmod(h1, n + 1), F.pmod(h2, n + 1)
    marked = given.contains(PREFIX) | given.contains(SUFFIX) | given.contains(MIDDLE)
    plain = (n == 0) | marked | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    drawn = df.select(F.struct(*quoted).alias("_row"), F.col(text).alias("_text"), n.alias("n"), form.alias("form"), F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    drawn = drawn.withColumns(
        {
            "prefix_chars": F.when(F.col("form") != "plain", F.col("_a")),
            "middle_chars": F.when(F.col("form") != "plain", F.col("_b") - F.col("_a")),
        }
    )
    row = drawn.schema["_row"]
    texts = [T.StructField(c, T.StringType()) for c in (output, restored) if c]
    schema = T.StructType([row, drawn.schema["_text"], *(drawn.schema[c] for c in ("n", "form", "prefix_chars", "middle_chars")), *texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("_text")):
                raw, ends = joined(part.column("_text"))
                forms = codes(part.column("form"))
                out, out_ends = scattered(raw, ends, forms, numbers(part.column("prefix_chars")), numbers(part.column("middle_chars")))
                columns = {name: part.column(name) for name in ("_row", "_text", "n", "form", "prefix_chars", "middle_chars")}
                columns[output] = as_texts(out, out_ends)
                if restored:
                    columns[restored] = as_texts(*gathered(out, out_ends, forms))
                yield pa.RecordBatch.from_pydict(columns)

    found = drawn.mapInArrow(run, schema)
    held = [F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in kept if c not in made]
    return found.select(*held, *made)


def restore(df: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``df`` with the text that ``transform`` was given, from its output and form; null for a null output or form."""
    kept = [f for f in df.schema.fields if f.name != restored]
    schema = T.StructType([*kept, T.StructField(restored, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(output)):
                out, ends = joined(part.column(output))
                unknown = [a is None or b is None for a, b in zip(part.column(output).to_pylist(), part.column(form).to_pylist(), strict=True)]
                texts = as_texts(*gathered(out, ends, np.where(unknown, 0, codes(part.column(form)))))
                texts = pa.array([None if u else t for u, t in zip(unknown, texts.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict({f.name: part.column(f.name) for f in kept} | {restored: texts})

    return df.mapInArrow(run, schema)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each text and the end); null is empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def as_texts(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)]
    return pa.StringArray.from_buffers(len(ends) - 1, buffers[1], buffers[2])


def codes(forms: pa.Array) -> np.ndarray:
    return np.array([_CODE.get(f, 0) for f in forms.to_pylist()], np.int64)


def numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def shifts(ends: np.ndarray, cuts: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, shift of each byte) of windows over the texts' bytes.

    The segments of text i start at its first byte and at ``cuts[:, i]``; ``moves[:, i]`` are their shifts.
    """
    size = int(ends[-1])
    at = np.concatenate([ends[:-1], cuts[0], cuts[1]])
    last = np.concatenate([[0], moves[2][:-1]])
    change = np.concatenate([moves[0] - last, moves[1] - moves[0], moves[2] - moves[1]])
    order = np.argsort(at, kind="stable")
    at, change = at[order], change[order]
    carried = 0
    for first in range(0, size, WINDOW):
        end = min(first + WINDOW, size)
        held = np.zeros(end - first, np.int64)
        low, high = np.searchsorted(at, [first, end])
        np.add.at(held, at[low:high] - first, change[low:high])
        held[0] += carried
        np.cumsum(held, out=held)
        carried = int(held[-1])
        yield first, end, held


def layout(starts: np.ndarray, forms: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: (place of prefix, middle, suffix in the output, 3 rows; place of their sentinels, 3 rows), from its first output byte."""
    psm, spm = forms == 1, forms == 2
    p = starts + np.where(psm, _MARK, np.where(spm, 2 * _MARK + suffix, 0))
    s = starts + np.where(psm, 2 * _MARK + prefix, np.where(spm, _MARK, prefix + middle))
    m = starts + np.where(psm | spm, 3 * _MARK + prefix + suffix, prefix)
    return np.stack([p, m, s]), np.stack([p, m, s]) - _MARK


def scattered(raw: np.ndarray, ends: np.ndarray, forms: np.ndarray, prefix_chars: np.ndarray, middle_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all outputs, first byte of each and the end) of texts cut at code points."""
    firsts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    before = np.searchsorted(firsts, ends[:-1])
    cuts = np.stack([firsts[before + prefix_chars], firsts[before + prefix_chars + middle_chars]])
    prefix, middle, suffix = cuts[0] - ends[:-1], cuts[1] - cuts[0], ends[1:] - cuts[1]
    out_ends = np.concatenate([[0], np.cumsum(np.diff(ends) + np.where(forms > 0, 3 * _MARK, 0))])
    places, marks = layout(out_ends[:-1], forms, prefix, middle, suffix)
    moves = places - np.stack([ends[:-1], cuts[0], cuts[1]])
    out = np.empty(out_ends[-1], np.uint8)
    for first, end, shift in shifts(ends, cuts, moves):
        out[np.arange(first, end) + shift] = raw[first:end]
    cut = np.flatnonzero(forms > 0)
    for mark, place in zip((PREFIX, MIDDLE, SUFFIX), marks, strict=True):
        for k, byte in enumerate(mark.encode()):
            out[place[cut] + k] = byte
    return out, out_ends


def gathered(out: np.ndarray, out_ends: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte of each and the end), from the outputs and their forms alone."""
    cut = forms > 0
    size = np.diff(out_ends) - np.where(cut, 3 * _MARK, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    letter = np.isin(out[1:-1], np.frombuffer(b"PSM", np.uint8)) if len(out) > 2 else np.empty(0, bool)
    marks = np.flatnonzero((out[:-2] == ord("<")) & letter & (out[2:] == ord(">"))) if len(out) > 2 else np.empty(0, np.int64)
    # texts with a sentinel of their own are plain, so a cut output holds its three and no more
    first = np.minimum(np.searchsorted(marks, out_ends[:-1]), max(0, len(marks) - 3))
    marks = np.append(marks, [0, 0, 0])
    one = np.where(cut, marks[first + 1] - out_ends[:-1] - _MARK, 0)
    two = np.where(cut, marks[first + 2] - marks[first + 1] - _MARK, 0)
    prefix, suffix = np.where(forms == 2, two, one), np.where(forms == 2, one, two)
    middle = size - prefix - suffix
    cuts = np.stack([ends[:-1] + prefix, ends[:-1] + prefix + middle])
    places, _ = layout(out_ends[:-1], forms, prefix, middle, suffix)
    moves = places - np.stack([ends[:-1], cuts[0], cuts[1]])
    text = np.empty(ends[-1], np.uint8)
    for begin, end, shift in shifts(ends, cuts, moves):
        text[begin:end] = out[np.arange(begin, end) + shift]
    return text, ends
