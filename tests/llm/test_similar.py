import random
from itertools import combinations

import numpy as np
import xxhash

import corpus_pipeline
from lockstep.llm import similar

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_kept(rows):
    """Smallest ids of the groups that all pairs link: 5-word shingles at 0.8 or more, or fingerprints within 3 bits."""
    sets, prints, root = {}, {}, {}
    for d, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        ones = (np.array([[h >> b & 1 for b in range(64)] for h in set(hashes)]) * np.array([hashes.count(h) for h in set(hashes)])[:, None]).sum(axis=0) if hashes else [0] * 64
        sets[d], prints[d], root[d] = set(grams), sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes)), d

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    far = []
    for a, b in combinations(sets, 2):
        alike = 10 * min(len(sets[a]), len(sets[b])) >= 8 * max(len(sets[a]), len(sets[b])) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and sets[a]
        near = (prints[a] ^ prints[b]).bit_count() <= 3
        far += [(a, b)] if alike and not near else []
        if alike or near:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {find(d) for d in sets}, far


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS).repartition(4)
    return {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()}


def test_stage_against_all_pairs(spark):
    rng, rows = random.Random(7), []
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    for n in range(30):
        words = [word() for _ in range(rng.randrange(60, 200))]
        for changes in (0, 0, 1, 1, 2, 6, 12):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(50))) for k in range(40)]
    want, far = plain_kept(rows)
    assert len(far) > 50
    assert kept(spark, rows) == want and {d for d, _ in rows[-40:]} <= want


def test_stage_on_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows) == plain_kept(rows)[0]


def test_odd_rows(spark, odd_docs, no_docs):
    out = similar.keep_first(odd_docs)
    assert out.columns == odd_docs.columns and out.where("doc_id = 2").count() == 0 and out.where("doc_id = 1").count() == 1
    assert out.where("doc_id is null").count() == 1 and similar.keep_first(no_docs).count() == 0


def test_search_equals_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64)) for _ in range(6)]
    for _ in range(150):
        base = sets[rng.integers(0, len(sets))].copy()
        base[rng.integers(0, len(base), int(rng.integers(0, 6)))] = rng.integers(0, 1 << 62)
        sets.append(np.unique(base))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = dict(similar.spanning_pairs(sets))
    assert [got.get(i, i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]
