"""Pairs that parts of crowded regions have cut: all rows lie in one region of one tree."""

import random

from haloscape.llm import near_dup, paragraphs


def pairs(count: int, k: int) -> list[tuple[int, list[str]]]:
    """Texts that share most words: each two (2i, 2i + 1) are 0.81 alike, all others under 0.7."""
    rng, rows = random.Random(4), []
    for i in range(count):
        words = [f"s{j}" for j in range(220)] + [f"p{i}_{j}" for j in range(50)]
        other = list(words)
        for n in range(28 // k):
            other[5 + 35 * n + rng.randrange(10)] = f"x{i}_{n}"
        rows += [(2 * i, words), (2 * i + 1, other)]
    return rows


def test_pairs_cut_apart_are_linked(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CROWD", 8)
    monkeypatch.setattr(near_dup, "HUBS", 0)
    rows = [(i, " ".join(words)) for i, words in pairs(100, 4)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), forest=near_dup.Forest(trees=1, depth=0)).collect()
    assert len(got) == 200 and [(r.doc_id, r.component_id) for r in got if r.component_id != r.doc_id // 2 * 2] == []

def test_lines_cut_apart_are_linked(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CROWD", 8)
    monkeypatch.setattr(near_dup, "HUBS", 0)
    rows = [(i, " ".join(words)) for i, words in pairs(60, 5)]
    monkeypatch.setattr(paragraphs, "LINES", near_dup.Forest(k=5, labels=39, trees=1, depth=0, least=0.5))
    source = paragraphs.source_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = paragraphs.repeated_lines(source, paragraphs.materialize(paragraphs.units(source), "units")).select("doc", "first_doc").collect()
    assert sorted((r.doc, r.first_doc) for r in got) == [(i, i // 2 * 2) for i in range(120)]
