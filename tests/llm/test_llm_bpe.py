"""BPE: equal to the tokenizers library, exact round trips, odd rows."""

from __future__ import annotations

import random

import pytest
from helpers import by_id, documents

from vectable.llm import bpe, edits
from vectable.llm.queries import op10

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def odd_texts():
    random.seed(11)
    pool = [chr(c) for c in range(0x600) if not 0xD800 <= c < 0xE000] + ["<|endoftext|>", "'re", "  ", "\n\n", "\x85", "漢", "😀", "é"] * 30
    return ["", " ", "<|endoftext|>", "x" * 5000, "a" * 300 + " b" * 300] + [
        "".join(random.choices(pool, k=random.randint(1, 60))) for _ in range(500)
    ]


def test_ids_and_text_equal_the_library(reference):
    known = bpe.vocabulary()
    for text in odd_texts():
        ids = known.encode(text).tolist()
        assert ids == reference.encode(text, add_special_tokens=False).ids
        assert known.decode(ids) == reference.decode(ids, skip_special_tokens=False) == text


def test_decoding_bytes_that_are_no_text(reference):
    known = bpe.vocabulary()
    ids = [known.of_byte[b] for b in (0xE6, 0x41, 0xFF)]
    assert known.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_short_and_long_words_merge_alike():
    known = bpe.vocabulary()
    random.seed(3)
    for _ in range(200):
        raw = "".join(random.choices("abcdeghinorstu ", k=random.randint(2, 200))).encode()
        ids, bounds = known.encode_short(raw)
        assert ids == known.encode_long(raw)
        assert [known.table[i] for i in ids] == [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def test_memory_of_words_may_start_anew(monkeypatch):
    known = bpe.Vocabulary(bpe.default_vocabulary())
    want = known.encode("the quick brown fox jumps over the lazy dog").tolist()
    monkeypatch.setattr(bpe, "MEMO_WORDS", 2)
    known.memo.clear()
    assert known.encode("the quick brown fox jumps over the lazy dog").tolist() == want


def test_frames_with_odd_rows(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "to be"), (3, "to be"), (None, "or " * 5000)])
    clash = docs.selectExpr("*", "1 as ids", "2 as decoded")
    got = bpe.decode(bpe.encode(clash)).collect()
    assert len(got) == 5
    for r in got:
        assert r.decoded == (r.text or "") and (len(r.ids) > 0) == bool(r.text)
    assert bpe.encode(docs.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded is None


def test_query_digests(spark, sf_dir, reference):
    import hashlib

    docs = by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = op10(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edited_counts_equal_fresh_counts(monkeypatch):
    monkeypatch.setattr(edits, "BLOCK", 4)
    known = bpe.vocabulary()
    random.seed(5)
    pool = [*"abc  \n'stre12,.!é漢\t", "  ", "'re", "'ll", "the ", " of"]
    for _ in range(600):
        text = "".join(random.choices(pool, k=random.randint(0, 120)))
        tree = edits.TokenTree(text, *edits.leaves_of(known, text))
        for _ in range(5):
            at, removed = random.randint(-1, len(text) + 2), random.choice([0, 0, 1, 3, 50])
            inserted = "".join(random.choices(pool, k=random.choice([0, 1, 2, 8])))
            tree.edit(known, at, removed, inserted)
            at = min(max(at, 0), len(text))
            text = text[:at] + inserted + text[at + removed :]
            chars, tokens = edits.leaves_of(known, text)
            assert tree.text == text and tree.n_tokens == tokens.sum()
            assert [x.tolist() for x in tree.leaves()] == [chars.tolist(), tokens.tolist()]


def test_edits_encode_only_near_the_edit(spark):
    text = "the lazy dog " * 4000
    docs = spark.createDataFrame([(1, text, [(26000, 3, "cat")]), (2, None, None), (3, "", [(0, 0, "new text"), (None, None, None)])], f"id long, text string, edits {edits.EDITS}")
    got = by_id(edits.apply_edits(edits.token_trees(docs.selectExpr("*", "5 as n_tokens"))), "id")
    assert got[1].text == text[:26000] + "cat" + text[26003:] and 0 < got[1].n_encoded < 10
    assert (got[2].text, got[2].n_tokens, got[2].n_encoded) == ("", 0, 0)
    assert got[3].text == "new text" and got[3].n_tokens == len(bpe.vocabulary().encode("new text"))
    assert edits.apply_edits(edits.token_trees(docs.limit(0))).count() == 0
    again = edits.apply_edits(edits.apply_edits(edits.token_trees(docs)).drop("n_encoded"))
    assert by_id(again, "id")[1].n_tokens > 0


def test_edit_query_equals_fresh_encoding(spark, sf_dir):
    from vectable.llm.queries import op5

    known = bpe.vocabulary()
    docs = by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for r in op5(spark, sf_dir).collect():
        d = docs[r.doc_id]
        text, n = d.text, len(d.text)
        plain = lambda t: sum(len(known.memo[w]) // 4 for w in bpe.words_in(t))
        assert r.n_before == plain(text)
        for at, removed, inserted in ((n // 3, 5, d.lang), (2 * n // 3, 0, d.text[:20]), (max(n - 10, 0), n, d.source)):
            at = min(at, len(text))
            text = text[:at] + inserted + text[at + removed :]
        assert r.n_after == plain(text) and r.n_pretokens == len(bpe.words_in(text))
