"""Counts of shared elements, and documents that share most of their words without being near copies."""

import random

import numpy as np

from haloscape.llm import near_dup


def test_overlaps_equal_set_intersections(monkeypatch):
    rng = np.random.default_rng(1)
    for few, columns in ((32, 1024), (3, 8)):
        monkeypatch.setattr(near_dup, "FEW", few)
        monkeypatch.setattr(near_dup, "COLUMNS", columns)
        for n, top in ((2, 5), (7, 40), (90, 60), (90, 5000)):
            sets = [np.unique(rng.integers(0, top, rng.integers(0, 60), np.uint64)) for _ in range(n)]
            both = near_dup.overlaps(sets, n)
            assert all(both[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(n) for j in range(n) if i != j)


def test_pairs_among_documents_of_one_template(spark):
    """600 documents share 165 of 207 words (0.66 alike); each pair that shares the rest as well, but for a word, is linked, and no other."""
    rng = random.Random(2)
    template = [f"t{i}" for i in range(165)]
    rows = []
    for i in range(300):
        own = [f"o{rng.randrange(10**7)}" for _ in range(42)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join([*template, *own[:-1], "x"]))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 600 and all(r.component_id == r.doc_id // 2 * 2 for r in found)
