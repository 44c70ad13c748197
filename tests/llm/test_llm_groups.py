"""The Jaccard join gives one answer whether groups are connected parts or buckets."""

from __future__ import annotations

import random

import numpy as np
from helpers import documents

from vectable.llm import jaccard


def test_pairs_do_not_depend_on_the_size_of_their_group(spark, monkeypatch):
    random.seed(15)
    words = [f"w{i}" for i in range(60)]
    base = [random.choices(words, k=60) for _ in range(6)]
    texts = []
    for i in range(160):
        text = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            text[random.randrange(60)] = random.choice(words)
        texts.append((i, " ".join(text)))
    docs = documents(spark, texts)
    found = []
    for part, chunk in ((20_000, 512), (0, 16), (10, 64)):
        monkeypatch.setattr(jaccard, "PART", part)
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        found.append(sorted(map(tuple, jaccard.jaccard_join(docs).collect())))
    assert found[0] == found[1] == found[2]
    assert any(r[2] > 3 for r in found[0])


def test_shared_bands_of_pairs():
    signature = np.zeros((3, jaccard.HASHES), np.uint8)
    signature[1] = 1
    signature[2] = 2
    signature[1, jaccard.ROWS : 2 * jaccard.ROWS] = 0
    signature[2, 2 * jaccard.ROWS : 4 * jaccard.ROWS] = 1
    i, j = np.array([0, 0, 1]), np.array([1, 2, 2])
    assert jaccard.sharing(signature, i, j, -1).tolist() == [True, False, True]
    assert jaccard.sharing(signature, i, j, 1).tolist() == [True, False, False]
    assert jaccard.sharing(signature, i, j, 3).tolist() == [False, False, False]
    assert jaccard.sharing(signature, i, j, 2).tolist() == [False, False, True]
