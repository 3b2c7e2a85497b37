import hashlib
import re
import zlib

import pytest

from lockstep.llm import licenses, media
from lockstep.llm.queries import op4_media_columns, op5_license_scan


def padded(text):
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))


def check_media(rows, docs):
    want = []
    for d, t in docs:
        n, p = padded(t)
        form = b"P5\n24 %d\n255\n" % (len(p) // 24) + p
        want.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(form), hashlib.sha256(form).hexdigest(), media.sample_features(p)))
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert sorted((tuple(r[x] for x in names) for r in rows), key=str) == sorted(want, key=str)


def test_op4(spark, sf):
    check_media(op4_media_columns(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def test_media_odd_rows(odd_docs, no_docs):
    rows = media.document_media(odd_docs).collect()
    check_media(rows, odd_docs.select("doc_id", "text").collect())
    assert all(r.caption == f"document {r.doc_id}" or r.doc_id is None for r in rows)
    assert media.document_media(no_docs).count() == 0


def test_interleaving(spark):
    digest = "0" * 64
    page = f"<p>One <b>two</b></p><script>x<p></script><figure><img src='sha256:{digest}' alt='no'><figcaption>A &amp; b</figcaption></figure>three<img src='u' title=t>four<br>five"
    frame = spark.createDataFrame([(1, page, "i"), (2, None, "i"), (3, "<p", "i"), (4, "", "i")], "page_id long, html string, items string")
    got = {r.page_id: [(i.position, i.kind, i.text, i.ref, i.caption) for i in r["items"]] for r in media.interleaved(frame).collect()}
    assert got[1] == [(0, "text", "One two", None, None), (1, "media", None, f"sha256:{digest}", "A & b"), (2, "text", "three", None, None), (3, "media", None, "u", "t"), (4, "text", "four", None, None), (5, "text", "five", None, None)]
    assert got[2] == got[4] == []
    known = spark.createDataFrame([(digest, "payload")], "digest string, bytes string")
    rows = sorted((r.position, r.bytes) for r in media.resolve(media.interleaved(frame), known, "page_id").where("page_id = 1").collect())
    assert rows == [(0, None), (1, "payload"), (2, None), (3, None), (4, None), (5, None)]


def captions(page):
    return [(i["ref"], i["caption"]) if i["kind"] == "media" else i["text"] for i in media.parse_sequence(page)]


def test_captions_stay_with_their_figures():
    assert captions("<figure><figcaption>first</figcaption><img src=a></figure>") == [("a", "first")]
    assert captions("<figure><img src=a></figure><p>t</p><figcaption>stray</figcaption><img src=b alt=own>") == [("a", None), "t", "stray", ("b", "own")]
    nested = "<figure><img src=a><figure><img src=b><figcaption>inner</figcaption></figure><img src=c><figcaption>outer</figcaption></figure><img src=d>"
    assert captions(nested) == [("a", "outer"), ("b", "inner"), ("c", "outer"), ("d", None)]
    assert captions("<noscript><img src=x></noscript><template><figure><img src=y><figcaption>no</figcaption></figure></template><img src=z>") == [("z", None)]
    assert captions("<figure><img src=a><figcaption>one<br>two <b>three</b>") == [("a", "one two three")]
    assert captions("<figure><img src=a alt=kept><figcaption> </figcaption></figure></figure></figcaption>after") == [("a", "kept"), "after"]
    assert captions("<p>x</p>" * 3 + "y" * 200_000) == ["x"] * 3 + ["y" * 200_000]


def test_a_digest_that_repeats_multiplies_nothing(spark):
    frame = spark.createDataFrame([(1, f"<img src='sha256:{'1' * 64}'><img src='sha256:{'1' * 64}'>")], "page_id long, html string")
    known = spark.createDataFrame([("1" * 64, "same")] * 3, "digest string, bytes string")
    assert [r.bytes for r in media.resolve(media.interleaved(frame), known, "page_id").collect()] == ["same", "same"]


def plain_feature(samples):
    """Mean, deviation, edges and the block hash, number after number."""
    n = len(samples)
    mean = sum(samples) / n
    sd = max(0.0, sum(v * v for v in samples) / n - mean * mean) ** 0.5
    edge = sum(abs(a - b) for a, b in zip(samples, samples[1:], strict=False)) / max(1, n - 1)
    blocks = [sum(samples[k * n // 64 : (k + 1) * n // 64]) for k in range(64)]
    median = (sorted(blocks)[31] + sorted(blocks)[32]) / 2
    bits = int("".join("1" if b > median else "0" for b in blocks), 2)
    return f"mean={mean:.4f};sd={sd:.4f};edge={edge:.4f};hash={bits:016x}"


def test_features_against_a_loop():
    for text in ("", "a", "some words here " * 70, "é" * 500, "x" * 5000):
        samples = padded(text)[1]
        assert media.sample_features(samples) == plain_feature(samples)


def test_interleaving_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = media.interleaved(pages).collect()
    assert len(rows) == pages.count() and all([i.position for i in r["items"]] == list(range(len(r["items"]))) for r in rows)
    assert any(r["items"] for r in rows)


def check_scan(rows, docs):
    want = []
    for d, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        starts = [i for i, _ in places]
        want.append((d, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_op5(spark):
    sf = "/root/testdata/sf0.01"
    rows = op5_license_scan(spark, sf).collect()
    check_scan(rows, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert {"notice:mit", "notice:gpl", "notice:cc", "notice:apache"} <= {x for r in rows for x in r.labels.split(",")}


def test_scan_odd_rows(odd_docs, no_docs):
    check_scan(licenses.scan_licenses(odd_docs).collect(), odd_docs.select("doc_id", "text").collect())
    assert licenses.scan_licenses(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "ends"),
    [("red fox runs", [3]), ("red quick fox runs", [4]), ("red a b fox runs far", [5, 6]), ("red a b c fox runs", []), ("the red fox runs", [4]), ("fox runs", []), ("red fox", [])],
)
def test_automaton_against_expansion(text, ends):
    scanner = licenses.Scanner({}, {"t": "[[the]] red {{2}} fox runs [[far]]"})
    found = scanner.matches(text.encode().split())
    assert ({e for s, e, _ in found if s == 0} == {max(ends)}) if ends else not [f for f in found if f[0] == 0]


def test_templates_need_fixed_words():
    for bad in ("[[a]]", "{{3}} a", "[[a b"):
        with pytest.raises(ValueError):
            licenses.compile_template("x", bad)


def expansions(template, fill):
    """All word lists that a template stands for, replaceable regions empty or full, and for each word whether it is mandatory."""
    tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{\d+\}\})\S)+", template)

    def parse(at, depth):
        out = [[]]
        while at < len(tokens) and tokens[at] != "]]":
            token = tokens[at]
            if token == "[[":
                at, inner = parse(at + 1, depth + 1)
                inner = [[], *inner]
            elif token.startswith("{{"):
                inner = [[], [(fill, False)] * int(token[2:-2])]
            else:
                inner = [[(w.decode(), not depth) for w in licenses.words_of(token.encode())]]
            out = [a + b for a in out for b in inner][:256]
            at += 1
        return at, out

    return parse(0, 0)[1]


@pytest.mark.parametrize("template", ["red [[quick [[brown]] old]] fox", "Red-Fox [[, {{2}} ]] (runs) [[a [[b [[c]]]]]]", *licenses.TEMPLATES.values()])
def test_templates_accept_their_expansions_and_no_changed_wording(template):
    scanner = licenses.Scanner({}, {"t": template})
    for words in expansions(template, "zzz"):
        texts = [w.encode() for w, _ in words]
        assert scanner.matches(texts)[:1] == [(0, len(texts), "t")]
        places = [k for k, (_, needed) in enumerate(words) if needed]
        for k in places[:: max(1, len(places) // 8)]:
            changed = [*texts[:k], b"qqq", *texts[k + 1 :]]
            assert all(e - s < len(texts) or s > 0 for s, e, _ in scanner.matches(changed)) and scanner.matches(changed) == []


def test_one_notice_counts_once():
    scanner = licenses.Scanner({}, licenses.TEMPLATES)
    words = b"this work is licensed under the gnu general public license version 2".split()
    assert [x for x in scanner.matches(words) if x[2] == "notice:gpl"] == [(0, 12, "notice:gpl")]
    twice = [*words, b"and", *words]
    spans = [x[:2] for x in scanner.matches(twice) if x[2] == "notice:gpl"]
    assert len(spans) == 2 and spans[0][0] == 0 and spans[0][1] <= spans[1][0] and spans[1][1] == 25


def test_labels_and_score_of_whole_texts(spark):
    rows = [(k, " ".join(w for w, _ in expansions(t, "Someone")[-1]) + " and more.") for k, t in enumerate(licenses.TEMPLATES.values())]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in enumerate(licenses.TEMPLATES):
        assert label in got[k].labels.split(",") and got[k].score == 1 - 2.0 ** -(got[k].n_base + 2 * len(got[k].matches))


def test_common_notices_and_versions(spark):
    texts = {
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": {"header:gpl"},
        "GNU General Public License, version 2, or GNU Lesser General Public License (LGPL) version 2.1": {"notice:gpl-2.0", "notice:lgpl-2.1"},
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": {"header:mpl-2.0", "notice:mpl-2.0"},
        "// SPDX-License-Identifier: Apache-2.0": {"notice:spdx"},
        "It is licensed under the terms of the MIT license.": {"notice:mit-terms"},
        "This is free and unencumbered software released into the public domain by nobody.": set(),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan_licenses(docs).collect()}
    for i, want in enumerate(texts.values()):
        assert want <= found[i] and (want or not found[i])
