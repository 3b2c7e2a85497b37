import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm import mixing, topk
from lockstep.llm.queries import op2_hamming_top_k, op3_source_mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, capped, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        total = sum(weight[s] for s in rest)
        target |= {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            capped.add(s)
        if len(capped) == len(names):
            return target


def check_mix(rows, docs):
    sizes, by_source = defaultdict(int), {}
    for d in docs:
        sizes[d.source] += len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want = reshared(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert r.taken <= 2 * r.size
        by_source.setdefault(r.source, []).append(r)
    for rs in by_source.values():
        rate = rs[0].target / rs[0].source_size if rs[0].source_size else 0
        p = rate - int(rate)
        deviation = (p * (1 - p) * sum(r.size**2 for r in rs)) ** 0.5
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 4 * deviation + 1e-6


def test_op3(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()
    source = {d.doc_id: d.source for d in docs}
    frame = op3_source_mixing(spark, "/root/testdata/sf0.01")
    rows = frame.withColumn("source", F.create_map([F.lit(x) for kv in source.items() for x in kv])[F.col("doc_id")]).collect()
    check_mix(rows, docs)
    assert sorted(map(tuple, op3_source_mixing(spark, "/root/testdata/sf0.01").collect())) == sorted(map(tuple, frame.collect()))


def test_mix_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs)
    rows = mixed.withColumn("taken", F.col("size") * F.col("copies")).collect()
    assert len(rows) == odd_docs.count()
    check_mix(rows, odd_docs.collect())
    assert mixing.emit(mixed).count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0


def plain_top_k(items, queries, k):
    out = []
    for q, code in set(queries):
        far = sorted({(sum(a != b for a, b in zip(code, c, strict=True)), i) for i, c in set(items) if i != q and len(c) == len(code)})
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(far[:k])]
    return sorted(out)


def test_op2(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    items = [(r.vec_id, "".join("1" if x > 0 else "0" for x in r.embedding)) for r in rows]
    assert sorted(map(tuple, op2_hamming_top_k(spark, sf).collect())) == plain_top_k(items, [x for x in items if x[0] % 100 == 0], 10)


def test_top_k_odd_rows_in_many_blocks(spark):
    items = [(i, format(i * 2654435761 % 4096, "012b")) for i in range(300)] + [(300 + i, "0" * 12) for i in range(50)]
    items += [(7, items[7][1]), (900, "01"), (901, "011"), (902, "10")]
    frame = spark.createDataFrame([(*x, "t") for x in items] + [(None, "01", "t"), (950, None, "t")], "id long, code string, ids string")
    queries = [x for x in items if x[0] % 10 == 0 or x[0] > 899]
    got = topk.hamming_top_k(frame, frame.where("id % 10 = 0 or id > 899"), 7, block=50, query_block=10)
    assert sorted(map(tuple, got.collect())) == plain_top_k(items, queries, 7)
    assert topk.hamming_top_k(frame.limit(0), frame.limit(0), 3).count() == 0
    assert spark.createDataFrame([([],), (None,), ([0.5, -1.0, 0.0],)], "e array<double>").select(topk.sign_code(F.col("e")).alias("c")).collect()[2].c == "100"


def test_top_k_over_twenty_blocks(spark):
    items = [(i, format(i * 2654435761 % (1 << 20), "020b")) for i in range(800)] + [(800 + i, "0" * 20) for i in range(30)]
    frame = spark.createDataFrame(items, "id long, code string")
    queries = [x for x in items if x[0] % 25 == 0]
    assert sorted(map(tuple, topk.hamming_top_k(frame, frame.where("id % 25 = 0"), 5, block=40).collect())) == plain_top_k(items, queries, 5)


def test_a_search_meets_a_small_part_of_a_block():
    rng = np.random.default_rng(12)
    bits = rng.integers(0, 2, (1 << 15, 64)).astype(np.uint8)
    index = topk.MultiIndex(bits)
    for query in rng.integers(0, 2, (20, 64)).astype(np.uint8):
        far = (bits != query).sum(axis=1)
        at, found = index.search(query, 11)
        assert sorted(at.tolist()) == np.flatnonzero(far <= np.sort(far)[10]).tolist() and (far[at] == found).all()
    assert index.verified / 20 < 0.15 * len(bits)
