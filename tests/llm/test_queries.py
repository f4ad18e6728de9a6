"""Every registered query on the driver's smallest tables: DuckDB's rows where SQL can express it, else plain Python's."""

import collections
import hashlib
import os
import zlib

import pytest

from haloscape.llm import queries

from .test_llm import brute_lines

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    columns, found = want.columns, want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, found)


def test_sharding(spark, documents):
    got = queries.op2_sharding(spark, SF).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in documents)
    slots, loads = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    # no better than a largest-first greedy can do by more than one document
    assert max(loads.values()) - min(loads.values()) <= max(size(t) for _, t in documents)


def test_bpe(spark, documents):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    lib.no_padding()
    lib.no_truncation()
    got = {r.doc_id: r for r in queries.op5_bpe(spark, SF).collect()}
    for i, t in documents:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_substring_dedup(spark, documents):
    got = queries.op6_substring_dedup(spark, SF).where("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.place, r.first_doc, r.removed) for r in got} == {(d, k, f, (d, k) != (f, g)) for d, k, f, g in brute_lines(documents)}
