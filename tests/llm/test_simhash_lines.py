import numpy as np
import xxhash

from lockstep.llm import linededup, simhash
from lockstep.llm.components import connected_components
from lockstep.llm.queries import op9_line_dedup, op10_simhash_near_dedup


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """Smallest id reachable, for (id, fingerprint) rows."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        r = find(f)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if (least.get(r), d) != (None, None) else None
    return [(d, format(f, "016x"), least[find(f)]) for d, f in pairs]


def key(rows):
    return sorted(rows, key=str)


def test_op10(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = key(map(tuple, op10_simhash_near_dedup(spark, sf).collect()))
    assert got == key(plain_components([(d, plain_fingerprint(t)) for d, t in docs]))


def test_simhash_odd_rows(odd_docs, no_docs):
    got = key(map(tuple, simhash.near_duplicates(odd_docs).collect()))
    assert got == key(plain_components([(d, plain_fingerprint(t)) for d, t in odd_docs.select("doc_id", "text").collect()]))
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 1").count() == 1
    assert kept.where("doc_id is null").count() == 1


def test_links_span_dense_and_chained_groups(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(30):
        f = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(2, 60))):
            fps.add(f)
            for _ in range(int(rng.integers(1, 4))):
                f ^= 1 << int(rng.integers(0, 64))
    pairs = [(i, f) for i, f in enumerate(fps)]
    want = {f: c for _, f, c in plain_components(pairs)}
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = dict(connected_components(simhash.fingerprint_links(nodes)).collect())
    groups = {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(roots.get(s, s), set()).add(want[format(f, "016x")])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}


def plain_dedup(rows):
    seen, out = {}, []
    for d, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, linededup._signed(xxhash.xxh64_intdigest((x[1] or "").encode(), 42)))):
        lines, kept = linededup.lines_of((t or "").encode()), []
        for n, (a, b) in enumerate(linededup.chunks_of(lines)):
            raw = b"".join(lines[a:b])
            if b - a > 1 and len(raw.strip()) >= 40:
                if raw.strip() in seen:
                    continue
                seen[raw.strip()] = (d, n)
            kept.append(raw)
        out.append((d, t if t is None else b"".join(kept).decode()))
    return dict(((d, t), new) for (d, t), new in zip(sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, linededup._signed(xxhash.xxh64_intdigest((x[1] or "").encode(), 42)))), [x[1] for x in out], strict=True))


def test_op9(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_dedup(docs)
    got = {r.doc_id: r.text for r in op9_line_dedup(spark, sf).collect()}
    assert got == {d: want[d, t] for d, t in docs}


def test_line_dedup_odd_rows(odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    want = plain_dedup(rows)
    out = linededup.dedup_lines(odd_docs)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted(((d, want[d, t]) for d, t in rows), key=str)
    assert linededup.dedup_lines(no_docs).count() == 0
    assert [r.text for r in out.where("doc_id = 2").collect()] == ["", ""]


def test_chunks_resist_shifts():
    lines = [f"Sentence number {i} of this text. ".encode() for i in range(200)]
    whole = {b"".join(lines[a:b]) for a, b in linededup.chunks_of(lines)}
    shifted = [b"New one. ", *lines[:90], b"Another. ", *lines[90:]]
    again = {b"".join(shifted[a:b]) for a, b in linededup.chunks_of(shifted)}
    assert len(whole & again) >= len(whole) - 4
    assert b"".join(linededup.lines_of(b"a. b\n\nc d! e")) == b"a. b\n\nc d! e"
    for text in (b"", b"\n\n", b"a.  b.   c! d? \n\n e.f. ", b". . . \n. "):
        assert b"".join(linededup.lines_of(text)) == text
    assert linededup.lines_of(b"a. b\n\n\nc! \nd") == [b"a. ", b"b\n\n\n", b"c! \n", b"d"]


def test_chunks_against_a_plain_loop():
    rng = np.random.default_rng(4)
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    for _ in range(200):
        pool = [rng.bytes(int(rng.integers(0, 40))).replace(b"\xff", b"") for _ in range(6)]
        lines = [pool[i] for i in rng.integers(0, 6, int(rng.integers(0, 120)))] + [b"x y"] * int(rng.integers(0, 90))
        want, start = [], 0
        hashes = [xxhash.xxh64_intdigest(x.strip(), 11) for x in lines]
        for i, h in enumerate(hashes):
            r = (h + (hashes[i - 1] * base if i else 0)) & mask
            good = ((((r ^ (r >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> 33) % 3 == 0
            if i + 1 - start >= 2 and len(b"".join(lines[start : i + 1])) >= 40 and (good or i + 1 - start >= 32):
                want.append((start, i + 1))
                start = i + 1
        if start < len(lines):
            if want and len(lines) - start < 2:
                want[-1] = (want[-1][0], len(lines))
            else:
                want.append((start, len(lines)))
        assert linededup.chunks_of(lines) == want
