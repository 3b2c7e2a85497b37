import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lockstep.llm import collocations, fmindex, gridjoin, spelling
from lockstep.llm.queries import op11_phrase_collocations, op12_embedding_near_dedup, op13_spelling_variants

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_collocations(rows, least=10, share=50, most=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found, n = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, sum(a for p, a in counts.items() if len(p) == 1)
        inside = {q for p, b in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * b >= share * counts[q]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op11(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()
    assert rows_of(op11_phrase_collocations(spark, sf)) == sorted(plain_collocations(docs), key=str)


def test_collocations_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("lang", "text").collect()
    assert rows_of(collocations.collocations(odd_docs, 2)) == sorted(plain_collocations(rows, 2), key=str)
    assert rows_of(collocations.collocations(odd_docs, 2, most=3)) == sorted(plain_collocations(rows, 2, most=3), key=str)
    assert collocations.collocations(no_docs).count() == 0


def test_shards_add_up(spark, monkeypatch):
    """Small shards, in the worker too: the bound travels in the closure's module only, so it is set where the shard is cut."""
    rng = np.random.default_rng(3)
    rows = [("en" if i % 3 else None, " ".join(rng.choice(["a", "b", "c", "é", "d."], 30))) for i in range(200)]
    monkeypatch.setattr(collocations, "SHARD_BYTES", 500)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    counts = Counter()
    shards = list(collocations._shards(iter([batch])))
    for lang, shard in shards:
        index = fmindex.ShardIndex(shard.text, left=1, right=2)
        two = index.left(index.one)
        three = index.right(two)
        for found in (index.one, two, three):
            for p, n in zip(shard.phrases(found).to_pylist(), found.counts.tolist(), strict=True):
                counts[lang, p.decode()] += n
    want = Counter()
    for lang, text in rows:
        for piece in text.split("."):
            words = piece.split()
            want.update((lang or "und", " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert counts == want and len(shards) > 10


@pytest.mark.parametrize("symbols,n", [(3, 500), (40, 3000)])
def test_intervals_of_both_directions(symbols, n):
    rng = np.random.default_rng(n)
    text = np.r_[rng.integers(0, symbols, n), 0].astype(np.int32)
    index = fmindex.ShardIndex(text, left=3, right=3)
    found = index.right(index.left(index.one, then_left=True), then_right=True)
    for grown in (index.left(index.right(index.left(index.one, then_left=True))), index.right(found)):
        want = Counter(tuple(text[i : i + 4]) for i in range(n - 3) if text[i : i + 4].all())
        assert dict(zip(map(tuple, grown.words), grown.counts, strict=True)) == want
    wide = fmindex.sorted_places(text, 1 << 40, 3)  # ranks by doubling, since the symbols don't fit one number
    at = [tuple(np.roll(text, -i)[:3]) for i in wide]
    assert at == sorted(at)


def plain_links(rows, least=0.98):
    sound = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = np.array(v, float) / np.abs(v).max()
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sound.items():
        for j, b in sound.items():
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                n[i] += 1
                root[find(i)] = find(j)
    least_id = {}
    for i, (vec_id, *_) in enumerate(rows):
        r = find(i)
        least_id[r] = min((x for x in (least_id.get(r), vec_id) if x is not None), default=None)
    return sorted(((vec_id, n[i], c := least_id[find(i)], vec_id == c) for i, (vec_id, *_) in enumerate(rows)), key=str)


def test_op12(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(op12_embedding_near_dedup(spark, sf)) == plain_links(rows)


def test_vectors_in_chains_groups_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        v = rng.normal(size=12)
        for i in range(60):
            rows.append((1000 * g + i, [float(x) for x in v], g % 2))
            v = v + rng.normal(size=12) * 0.1  # chains: neighbours are near, ends are far
    dense = rng.normal(size=12)
    rows += [(9000 + i, [float(x) for x in dense + rng.normal(size=12) * 0.03], 1) for i in range(150)]
    rows += [(8000 + i, rows[0][1], 0) for i in range(20)] + [(8100, [2 * x for x in rows[0][1]], 0), (8200, rows[0][1], None), (8300, rows[0][1], 1)]
    rows += [(7000, None, 0), (7001, [], 0), (7002, [0.0] * 12, 0), (7003, [float("nan")] * 12, 0), (7004, [float("inf")] + [1.0] * 11, 0), (7005, [None] + [1.0] * 11, 0)]
    rows += [(7006, [1.0, 2.0], 0), (7007, [1.0, 2.01], 0), (7008, [1e200, 2e200], 0), (7009, [-0.0, 1.0], 0), (7010, [0.0, 1.0], 0), (None, [1.0, 2.0], 0), (7010, [0.0, 1.0], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, copies string").repartition(5)
    want = plain_links(rows)
    assert rows_of(gridjoin.near_vectors(frame)) == want
    assert rows_of(gridjoin.near_vectors(frame, block_rows=7, dims=3)) == want
    assert rows_of(gridjoin.near_vectors(frame.where("vec_id < 0"))) == []
    assert rows_of(gridjoin.near_vectors(frame.where("label is null"))) == [(8200, 0, 8200, True)]


def plain_variants(rows, least=7, least_n=2, times=10):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            n[w] += len(w) >= least
    n = {w: k for w, k in n.items() if k >= least_n}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in n:
                holes[w, "-"].add(cut)
                holes[cut, "+"].add(w)
    near = defaultdict(set)
    for w in n:
        near[w] |= holes[w, "-"] | holes[w, "+"]
        for i in range(len(w)):
            near[w] |= holes[w[:i] + "*" + w[i + 1 :]] - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def test_op13(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(op13_spelling_variants(spark, sf)) == plain_variants(docs)


def test_spelling_of_odd_rows(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(6, 10))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(300)] + [(None, "x" * 40000 + " " + "x" * 40001 + " abcdeab abcdeab"), (7, "y" * 300 + "z " + "y" * 301 + "! " + "x" * 40000), (8, "y" * 300 + "z " + "y" * 301 + " " + "x" * 40001)]
    rows += [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n string").repartition(3)
    assert rows_of(spelling.spelling_variants(frame)) == plain_variants(rows)
    assert spelling.spelling_variants(no_docs).count() == 0
    counted = spelling.stored(spelling.count_words(frame).where("n >= 2"))
    whole = {r[0]: r[1] for r in spelling.near_words(counted).collect()}
    assert {r[0]: r[1] for r in spelling.near_words(counted, most=20).collect()} == whole
    assert whole == {w: k for w, _, _, _, k, _ in plain_variants(rows) if k}
