"""Prefix trie, spelling variants and line dedup on small tables with nulls, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haloscape.llm import line_dedup, prefix_trie, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0d]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST = -(1 << 63)


def brute_trie(rows):
    said = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, r or "", x or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(said.get(c - int(np.fmod(c, 20)), [])[:h] + said[c][h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in members if p), collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(SPACE_WORD.findall(p[-1][1])) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if whole[c] == p).encode()).hexdigest()
    return collections.Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def trie(df):
    out = prefix_trie.prefix_trie(df, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    return collections.Counter(tuple(r)[1:] for r in out.collect())


@pytest.mark.parametrize("hot", [10_000, 10])
def test_prefix_trie(spark, monkeypatch, hot):
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    random.seed(hot)
    turns = {(random.randrange(-50, 300), random.choice([None, 0, 1, 2, 3])): (random.choice(["u", "a", None]), random.choice(["x", "y z", "", None])) for _ in range(800)}
    rows = [(*k, *v) for k, v in turns.items()] + [(None, 0, "u", "no id")]
    rows += [(1000 + i, t, "u", "same words") for i in range(150) for t in range(3)]  # a common conversation
    rows += [(2000, t, "u", f"turn {t}") for t in range(200)]  # a deep one
    rows += [(40, 0, "u", "x")] * 2 if (40, 0) not in turns else []  # repeated rows are repeated turns
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, base string")
    assert trie(df) == brute_trie(rows)


def test_prefix_trie_of_little(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert not trie(empty)
    got = trie(empty.union(spark.createDataFrame([(1, 5, None, None)], empty.schema)))  # crc32 of 1 is 3 modulo 4 and there is no base: left without turns
    assert got == brute_trie([(1, 5, None, None)])
    whole = prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, "u", "a b"), (2, 0, "u", "a b"), (2, 1, "a", "c")], empty.schema)).collect()
    assert sorted((r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in whole) == [(0, 2, 1, 2), (1, 2, 1, 2), (2, 1, 1, 0)]


def brute_variants(rows):
    n = collections.Counter()
    for i, t in rows:
        for w in LETTERS.findall(t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    v = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters, out, form = sorted({c for w in v for c in w}), set(), {}
    near = lambda w: ({w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + s :] for i in range(len(w) + 1) for a in letters for s in (0, 1)}) & v.keys() - {w}
    for w in v:
        best = min(near(w), key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 2 * v[w] else None
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, v[w], len(near(w)), form[w], v.get(form[w]), root))
    return out


def test_spelling_variants(spark):
    random.seed(3)
    rows = [(i, " ".join("".join(random.choice("abÀ") for _ in range(random.randrange(4, 8))) * 1 + random.choice([" ", "1", "-"]) for _ in range(120))) for i in range(60)]
    rows += [(None, None), (7, ""), (None, "Straße Straße STRASSE straße"), (8, "abcde " * 40 + "abcdf " * 20 + "abcd " * 9 + "abcdeé " * 10 + "abxde " * 5 + "bxde " * 3 + "bbxde " * 3)]
    rows += [rows[0], (9, "a" * 20000)]  # a repeated row, a very long word once
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, w string, word int")
    got = [tuple(r) for r in spelling.variants(spelling.vocabulary(df, word=spelling.with_deletions("doc_id"))).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(rows)
    assert any(r[3] != r[5] for r in got if r[3])  # a chain of forms
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spelling.vocabulary(df), ratio=1)


def brute_lines(rows, min_chars=40, least=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    n, last = collections.Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                n[k] += 1
                last[k] = max(last.get(k, LEAST), LEAST if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [k for k, x in enumerate(lines) if n[key(x)] >= least and last[key(x)] != (LEAST if i is None else i)]
        out[i, len(lines), tuple(gone), "\n".join(x for k, x in enumerate(lines) if k not in set(gone))] += 1
    return out


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_line_dedup(spark, monkeypatch, most):
    """With arrays that are sent, and with shards that documents' keys are shuffled to."""
    if not most:
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 10)
        monkeypatch.setattr(line_dedup, "HOT", 8)
    monkeypatch.setattr(line_dedup, "MAX_SENT", most)
    random.seed(5)
    line = lambda k: f"line {k:03d} " + "É is upper, A to Z are not " * (k % 3) + "x" * 32
    rows = [(i, "\n".join(random.choice([str.upper, str.lower, str])(line(int(random.paretovariate(0.4)) % 90)) + random.choice(["", " ", "\t\r"]) for _ in range(random.randrange(12)))) for i in range(150)]
    rows += [(None, None), (None, line(1)), (3, ""), (3, "\n\n"), (149, line(1) + "\n" + line(1)), (149, line(1)), (1 << 40, "x" * 40), (200, "\n".join(line(k) for k in range(600)))]
    rows += [(300 + i, "only nulls hold it, so all of them keep it"[:40]) for i in range(1)] + [(None, "held by rows without an id and no others at all")] * 6
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, n_lines string, `ha` int")
    out = line_dedup.drop_common_lines(df)
    assert sorted(out.columns) == ["doc_id", "dropped_lines", "ha", "kept_text", "n_dropped", "n_lines", "text"]
    got = collections.Counter((r.doc_id, r.n_lines, tuple(r.dropped_lines), r.kept_text) for r in out.collect())
    assert got == brute_lines(rows)
    assert sum(len(k[2]) for k in got) > 100
    assert line_dedup.drop_common_lines(df.limit(0)).count() == 0


def test_perfect_hash():
    random.seed(1)
    a, b = (np.array([random.getrandbits(64) for _ in range(5000)], np.uint64) for _ in range(2))
    a[:2] = a[0]  # equal in one half only
    found = line_dedup.PerfectHash.build(a, b)
    assert sorted(found.numbers(a, b)) == list(range(5000))
    assert len(found.bits) * 64 < 5000 * 5
    none = line_dedup.PerfectHash.build(a[:0], b[:0])
    assert list(none.numbers(a[:3], b[:3])) == [-1, -1, -1]
