"""What is computed for many sets or parts together equals what each one gives alone."""

import numpy as np

from haloscape.llm import near_dup


def test_labels_of_runs():
    """A run's labels are those of its hashes alone, whatever lies between runs, and no label is above another hash's."""
    rng, factors = np.random.default_rng(1), near_dup.label_factors(39)
    hashes = rng.integers(0, 2**63, 500, np.uint64)
    firsts, counts = np.array([0, 40, 41, 300]), np.array([37, 1, 200, 200])
    got = near_dup.min_labels(hashes, firsts, counts, factors)
    for row, a, n in zip(got, firsts, counts, strict=True):
        low = (hashes[a : a + n] ^ (hashes[a : a + n] >> np.uint64(32))).astype(np.uint32)
        least = (low[:, None] * factors[None, :]).min(0)
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        assert row.tolist() == (least >> np.uint32(16)).tolist()
    assert near_dup.min_labels(hashes, firsts[:0], counts[:0], factors).shape == (0, 39)


def test_pairs_of_many_parts(monkeypatch):
    """Small and large parts together: likely pairs, those that meet here first, and hubs, against one pair at a time."""
    monkeypatch.setattr(near_dup, "SMALL", 5)
    monkeypatch.setattr(near_dup, "PAIRS", 7)
    rng, forest, parts = np.random.default_rng(2), near_dup.Forest(labels=12, trees=6, depth=2, least=0.5), []
    for p in range(60):
        n = int(rng.integers(2, 9))
        signed = [r.astype(">u2").tobytes() for r in rng.integers(0, 2, (n, 12))]
        runs = [None if p % 2 else rng.integers(0, 2, 6).tolist() for _ in range(n)]
        parts.append(((p % 6, p, int(rng.integers(-1, 2))), [list(range(n)), signed, runs, rng.integers(0, 4, n).tolist(), (rng.random(n) < 0.3).tolist()]))
    got = near_dup.Pairs(parts, forest)
    found = set(zip(got.part_of[got.i].tolist(), (got.i - got.begin[got.part_of[got.i]]).tolist(), (got.j - got.begin[got.part_of[got.j]]).tolist(), got.near.tolist(), got.first.tolist(), strict=True))
    expected, agreed = set(), []
    for p, ((tree, _, part), (reps, signed, runs, comps, marks)) in enumerate(parts):
        rows, sums = [np.frombuffer(s, ">u2") for s in signed], [0] * len(reps)
        for i in reps:
            for j in reps[i + 1 :]:
                near = int((rows[i] == rows[j]).sum())
                if near < 6:
                    continue
                met = part >= 0 and any((rows[i][2 * t : 2 * t + 2] == rows[j][2 * t : 2 * t + 2]).all() and (runs[i] is None or runs[i][t] == runs[j][t]) for t in range(tree))
                expected.add((p, i, j, near, bool(comps[i] != comps[j] and not met and not (part > 0 and any(marks) and marks[i] == marks[j]))))
                sums[i], sums[j] = sums[i] + near, sums[j] + near
        agreed.append(sums)
    assert found == expected and len(found) > 100 and 20 < sum(f for *_, f in found) < len(found)
    assert (got.hub - got.begin).tolist() == [s.index(max(s)) for s in agreed]


def test_sets_in_one_process():
    """``shingle_set`` meets as the stored hashes' sets do."""
    texts = ["", " \t", "a b", "A b", "a b c d e f g", "a b c d e f h", "x a b c d e f g", "a a a a a a a a"]
    for k in (1, 4, 5):
        for a in texts:
            for b in texts:
                assert len(near_dup.shingle_set(a, k) & near_dup.shingle_set(b, k)) == len(np.intersect1d(near_dup.shingle_hashes(a, k), near_dup.shingle_hashes(b, k)))
