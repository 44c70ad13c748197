"""Fill in the middle: equal to plain slicing, exact restoring, odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents
from pyspark.sql import functions as F

from vectable.llm import middle


def plain_form(doc_id, text, seed=1):
    """(n, form, prefix_chars, middle_chars, output) by slicing."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[g : g + 8], 16) for g in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def odd_texts():
    random.seed(5)
    pool = ["a", "é", "漢", "😀", "<", ">", "P", "S", "M", "<P", "S>", "\n", "\0", "é"]
    texts = [None, "", "x", "😀", "<P>", "a<M>b", "<<S", "<", "P>", "<S>" * 3]
    return texts + ["".join(random.choices(pool, k=random.randint(1, 40))) for _ in range(300)]


def test_rows_equal_slicing(spark):
    rows = [*enumerate(odd_texts()), (None, "text of no id"), (7, None), (3, "x"), (3, "x")]
    found = middle.transform(documents(spark, rows), restored="restored")
    got = sorted((tuple(r) for r in found.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()), key=repr)
    assert got == sorted(((i, t, *plain_form(i, t), t or "") for i, t in rows), key=repr)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    again = middle.restore(found.drop("restored"))
    assert all(r.restored == (r.text or "") for r in again.collect())


@pytest.mark.parametrize("window", [1, 7, 64])
def test_windows_of_any_size_give_the_same_bytes(monkeypatch, window):
    texts = [t or "" for t in odd_texts()]
    raw, ends = middle.joined(pa.array(texts))
    random.seed(9)
    forms = np.array([0 if not t or any(m in t for m in ("<P>", "<S>", "<M>")) else random.randint(0, 2) for t in texts])
    a = np.array([random.randint(0, len(t)) for t in texts])
    b = np.array([random.randint(0, len(t) - x) for t, x in zip(texts, a, strict=True)])
    a, b = np.where(forms > 0, a, 0), np.where(forms > 0, b, 0)
    want = middle.scattered(raw, ends, forms, a, b)
    monkeypatch.setattr(middle, "WINDOW", window)
    got = middle.scattered(raw, ends, forms, a, b)
    assert got[0].tobytes() == want[0].tobytes()
    back, back_ends = middle.gathered(*got, forms)
    assert middle.as_texts(back, back_ends).to_pylist() == texts


def test_long_text_and_empty_table(spark):
    long = "añ😀" * 700_000
    (row,) = middle.transform(documents(spark, [(1, long)]), restored="restored").collect()
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == plain_form(1, long)
    assert row.restored == long
    assert middle.transform(documents(spark, [])).count() == 0


def test_clashing_columns_and_null_outputs(spark):
    given = documents(spark, [(1, "some text"), (2, None)]).withColumns(
        {"form": F.lit("mine"), "output": F.lit(1), "_row": F.lit("kept"), "_text": F.lit("kept too"), "a.b": F.lit(5)}
    )
    rows = {r.doc_id: r for r in middle.transform(given).collect()}
    assert rows[1].output == plain_form(1, "some text")[4] and rows[1]["_row"] == "kept" and rows[1]["_text"] == "kept too" and rows[1]["a.b"] == 5
    assert rows[2].form == "plain" and rows[2].text is None
    lost = spark.createDataFrame([(None, "psm"), ("<P>a<S>b<M>", None)], "output string, form string")
    assert [r.restored for r in middle.restore(lost).collect()] == [None, None]
