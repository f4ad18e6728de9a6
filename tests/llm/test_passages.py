"""Passages: word hashes, anchors and the recall of near copies inside longer texts."""

import collections
import random
import re

import numpy as np

from haloscape.llm import paragraphs

TOKEN = re.compile(rb"[^\x20\x09-\x0d]+|\n")


def test_words_are_hashed_alike_in_any_block(monkeypatch):
    """Equal words have equal hashes, others have others, and lines start where the text's breaks are, wherever blocks end."""
    monkeypatch.setattr(paragraphs, "BLOCK", 32)
    rng = np.random.default_rng(3)
    hash_of, word_of = {}, {}
    for n in (0, 1, 3, 60, 700):
        for _ in range(20):
            text = "".join(rng.choice(list("ab AB\n \té"), n)) if n else ""
            hashes, lines = paragraphs.hashed_lines(text)
            words, starts = [], [0]
            for token in TOKEN.findall(text.encode().translate(paragraphs.LOWERED)):
                if token == b"\n":
                    starts.append(len(words))
                else:
                    words.append(token)
            assert lines.tolist() == [*starts, len(words)] and len(hashes) == len(words)
            for h, w in zip(hashes.tolist(), words, strict=True):
                assert hash_of.setdefault(w, h) == h and word_of.setdefault(h, w) == w
    assert len(hash_of) > 200


def test_anchors_equal_their_definition():
    """Of each ``reach`` starts in a row the last of the smallest, ties included."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 19, 20, 21, 22, 200):
        for values in (2, 5, 40, 2**62):
            h = rng.integers(0, values, n, np.uint64)
            rows = [(i, h[i : i + 20]) for i in range(max(1, n - 19))] if n else []
            assert paragraphs.anchors(h, 1, 20).tolist() == sorted({i + max(k for k, v in enumerate(row) if v == row.min()) for i, row in rows})


def test_near_passages_are_found(spark):
    """Of 100 passages of each size that stand in two longer lines, once with the word in their middle changed, at least 0.9 are found in both.  A
    window that differs in its first or last word only is still alike, as is one
    that starts a word further in its own text, so a span may reach a word, seldom two, beyond its passage."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(10**6)}"
    sizes, rows, at = (51, 60, 90), [], {}
    for i in range(300):
        size = sizes[i % 3]
        passage = [word() for _ in range(size)]
        for doc in (2 * i, 2 * i + 1):
            before = [word() for _ in range(rng.randrange(60, 90))]
            at[doc] = (len(before), len(before) + size)
            rows.append((doc, " ".join([*before, *passage, *[word() for _ in range(rng.randrange(60, 90))]])))
            passage[size // 2] = "changed"
    found = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("kind = 'passage'").collect()
    beyond = collections.Counter(max(0, at[r.doc_id][0] - r.start, r.start + r.n_words - at[r.doc_id][1]) for r in found)
    assert max(beyond) <= 2 and beyond[0] > 0.9 * len(found)
    pairs = {r.doc_id // 2 for r in found if r.removed and r.first_doc == r.doc_id - 1}
    counts = [sum(p % 3 == k for p in pairs) for k in range(3)]
    assert min(counts) >= 90
