import zlib
from collections import Counter

import numpy as np

from sievewright.llm.sharding import op2_vector_sharding, pack, shard_documents


def check(rows, got, shards):
    sizes = [0] * shards
    slots = {}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    return sizes


def test_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    got = shard_documents(make_docs(odd_rows), 5).collect()
    check(rows, got, 5)
    assert shard_documents(make_docs([])).count() == 0


def test_balance_and_groups(spark, sf_dir, make_docs):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op2_vector_sharding(spark, sf_dir).collect()
    sizes = check(rows, got, 40)
    largest = max(len(t.encode()) for _, t in rows) + 16
    assert max(sizes) <= max(largest, 1.3 * sum(sizes) / 40)
    copies = [(i, f"text number {i} of some length " * (1 + i % 7)) for i in range(400)] + [(1000 + i, "copied") for i in range(200)] + [(2000 + i, "twice " * 20) for i in range(2)]
    got = shard_documents(make_docs(copies), 8).collect()
    sizes = check(copies, got, 8)
    assert max(sizes) < 1.05 * min(sizes)
    assert len({r["shard"] for r in got if r["doc_id"] in (2000, 2001)}) == 1
    # A group of a third of all rows is in every shard.
    assert len(Counter(r["shard"] for r in got if 1000 <= r["doc_id"] < 1200)) == 8


def test_pack_takes_the_best_room():
    room = np.array([[0.5, 0.1, 0.1], [0.1, 0.5, 0.5]])
    assert pack(np.array([[0.1, 0.0, 0.0], [0.0, 0.1, 0.1]]), room).tolist() == [0, 1]
