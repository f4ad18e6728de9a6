"""Very long texts: results stay whole, and cost grows with their length."""

import random

from haloscape.llm import contamination, secrets


def test_many_secrets_in_one_text(spark):
    random.seed(2)
    n = 10_000
    keys = [f"{random.getrandbits(128):032x}" for _ in range(n)]
    text = "".join(f"é{i}{random.choice([' ', ' // ', chr(10)])}{k} " for i, k in enumerate(keys))
    touching = 'password = "' + "ab12" * 5000 + '" token: ' + "AKIA" + "A" * 40
    df = spark.createDataFrame([(1, text), (2, touching), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    want, at = [], 0
    for k in keys:
        begin = text.index(k, at)
        want += [text[at:begin], "[SECRET]"]
        at = begin + len(k)
    assert len(got[1].spans) == n and got[1].redacted == "".join(want) + text[at:]
    runs, done, last = [], "", 0
    for s in sorted(got[2].spans):
        if runs and s.start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s.end)
        else:
            runs.append([s.start, s.end])
    for a, b in runs:
        done, last = done + touching[last:a] + "[SECRET]", b
    assert got[2].redacted == done + touching[last:] and len(got[2].redacted) < 100
    assert not got[3].spans and got[3].redacted is None and got[4].redacted == ""


def test_long_texts_of_benchmark_words(spark):
    n = 20_000
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([("a", item), ("b", "same " * 12), ("c", "lone")], "item_id string, text string")
    rows = [(1, "same " * n), (2, f"{item} " * (n // 10)), (3, "one " * n), (4, "x " * n + item + " y" * n), (5, "one two " * n + "three lone")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: (n, n, ["b"]), 2: (n, n, ["a"]), 3: (n, 0, []), 4: (2 * n + 10, 10, ["a"]), 5: (2 * n + 2, 1, ["c"])}
