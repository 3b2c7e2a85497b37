import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lockstep.llm import langid, quality
from lockstep.llm.common import stored
from lockstep.llm.queries import op7_quality_rules, op8_language_centroids

SF = "/root/testdata/sf0.01"


def test_op7_held_out(spark):
    rows = {r.doc_id: r for r in op7_quality_rules(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95


def test_rules_as_columns_equal_numpy(spark, odd_docs, no_docs):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    model = quality.fit_rules(x, ((x[:, 4] > 0.5) & (x[:, 9] < 0.7)).astype(int))
    assert model.rules
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = np.array([r[0] for r in frame.select(model.score()).collect()])
    z = np.array([model.bias + sum(w for rule, w in model.rules if all((r[k] > at) == above for k, above, at in rule)) for r in x[:50]])
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == ((x[:50, 4] > 0.5) & (x[:50, 9] < 0.7))).mean() > 0.9
    scores = quality.score_quality(odd_docs.drop("score"), model, "doc_id").collect()
    assert len(scores) == odd_docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score_quality(no_docs.drop("score"), model, "doc_id").count() == 0


def test_fit_quality_without_labels(spark, odd_docs):
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit_quality(odd_docs, none)
    assert not model.rules and model.bias == 0


def test_op8_held_out(spark):
    rows = {r.doc_id: r for r in op8_language_centroids(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]) > 0.97


def test_language_odd_rows(odd_docs, no_docs):
    model = langid.fit_languages(odd_docs)
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    for d in (3, 4, 5, 9):
        assert got[d].lang_near == "und" and got[d].score == 0 and not got[d].accepted
    assert got[6].lang_near in {"en", "fr", "de"} and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(no_docs, langid.fit_languages(no_docs)).count() == 0
    assert {r.lang_near for r in langid.identify(odd_docs, langid.fit_languages(no_docs)).collect()} == {"und"}


def test_long_text_counts_match_one_block():
    text = "Ein été " * 300_000
    raw = np.frombuffer(text.lower().encode().translate(langid._LETTERS), np.uint8).astype(np.uint32)
    two = raw[:-1] << 8 | raw[1:]
    three = two[:-1] << 8 | raw[2:]
    want = sum(np.bincount((g * np.uint32(2654435761)) >> np.uint32(20), minlength=langid.DIMS) for g in (two, three))
    assert (langid.gram_counts(text) == want).all()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen.append((name, before.count(), docs.count()))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    by = {n: (a, b) for n, a, b in seen}
    assert by["line_dedup"][0] > by["line_dedup"][1] and by["near_dedup"][1] < by["near_dedup"][0] and by["quality"][1] < by["quality"][0]
    words = before.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words and docs.agg(F.sum("length")).first()[0] > words
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert re.match("quality", seen[0][0])


def test_pipeline_odd_rows(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0


CLASH = ("size", "rate", "target", "score", "n_words", "removed", "_source", "_rest", "_kept", "copies", "key", "_size", "_at", "_version")


def test_every_stage_on_odd_rows_empty_tables_and_clashing_names(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for c in CLASH:
            docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
        columns, empty = docs.columns, docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
            if name == "packing":
                break
            assert docs.columns == columns and docs.isEmpty() == empty
            wrong = " or ".join(f"`{c}` is null or `{c}` <> concat('{c} of ', coalesce(string(doc_id), 'null'))" for c in CLASH)
            assert docs.where(wrong).count() == 0
        assert docs.isEmpty() == empty


def plain_statistics(text):
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, w, m = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    share = lambda chars: sum(c in chars for c in text) / n
    symbols = b"!#$%&*+/<=>@[\\]^_`{|}~"
    return (
        len(text), len(words), sum(map(len, words)) / w, max(map(len, words), default=0),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b".,;:?'\"-()"), share(symbols), share(b" \t"), share(b"\n"), sum(c > 127 for c in text) / n,
        len(set(words)) / w, max(map(words.count, words), default=0) / w, len(set(lines)) / m if lines else 0, len(words) / m,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m, sum(x.isupper() and len(x) > 1 for x in words) / w, sum(x[-1] in symbols for x in words) / w,
    )


def test_statistics_against_a_loop():
    for text in ("", " \n", "One TWO two! #x\nÉté 12, (a) b? \n\nEND.", "a" * 50 + "\t{} ~"):
        assert np.allclose(quality.text_statistics(text.encode()), plain_statistics(text.encode()))


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(3)
    z = (rng.random((500, 8)) < 0.4).astype(float)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    bias, w = quality.lasso_logistic(z, y, 0.02, steps=4000)
    scale = z.std(axis=0)
    error = 1 / (1 + np.exp(-(z @ w + bias))) - y
    gradient = ((z - z.mean(axis=0)) / scale).T @ error / len(y)
    on = np.abs(w) > 1e-9
    assert abs(error.mean()) < 1e-6 and on[:2].all() and not on.all()
    assert np.allclose(gradient[on], -0.02 * np.sign(w[on]), atol=1e-5) and (np.abs(gradient[~on]) <= 0.02 + 1e-5).all()


def plain_grams(text):
    """Counts of 2- and 3-byte grams by hash, one gram after the other."""
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    out = {}
    for n in (2, 3):
        for i in range(len(raw) - n + 1):
            bucket = (int.from_bytes(raw[i : i + n], "big") * 2654435761 % 2**32) >> 20
            out[bucket] = out.get(bucket, 0) + 1
    return out


def test_languages_against_a_loop(spark):
    """Weights, cosines, the nearest centroid and the rejection, number after number."""
    rng = np.random.default_rng(2)
    words = {"en": ["the", "of", "and", "thing"], "fr": ["le", "été", "que", "dans"], "xx": ["zzq", "qqz", "zqz"]}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i, lang in enumerate(rng.choice(["en", "fr"], 300).tolist())]
    rows += [(900 + i, t, None) for i, t in enumerate(("the été zzq", "zzq qqz zqz qzz", "of", "12 34", "", None, "the " * 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit_languages(docs)
    learned = [(t, lang) for d, t, lang in rows if lang and zlib.crc32(str(d).encode()) % 4 != 2]
    counts = [plain_grams(t) for t, _ in learned]
    df = [sum(k in c for c in counts) for k in range(langid.DIMS)]
    idf = [np.log((1 + len(counts)) / (1 + n)) + 1 for n in df]
    assert np.allclose(model.idf, idf, rtol=1e-5)

    def vector(c):
        v = np.zeros(langid.DIMS)
        for k, n in c.items():
            v[k] = n**0.5 * idf[k]
        return v / max(1e-12, sum(x * x for x in v) ** 0.5)

    for lang in ("en", "fr"):  # each centroid is the mean direction of the rows that are nearest to it
        own = [vector(c) for c, (_, own) in zip(counts, learned, strict=True) if own == lang]
        centers = model.centers[[i for i, x in enumerate(model.langs) if x == lang]]
        nearest = [int(np.argmax(centers @ v)) for v in own]
        for j, c in enumerate(centers):
            if mine := [v for v, k in zip(own, nearest, strict=True) if k == j]:
                mean = np.mean(mine, axis=0)
                assert np.dot(mean / np.linalg.norm(mean), c) > 0.999
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for d, t, _ in rows:
        letters = bool(re.search(r"[^\W\d_]", t or ""))
        cosines = [float(np.dot(vector(plain_grams(t or "")), c)) for c in model.centers]
        at = int(np.argmax(cosines))
        if letters:
            assert got[d].lang_near == model.langs[at] and abs(got[d].score - cosines[at]) < 1e-5
            assert got[d].accepted == (cosines[at] >= model.least[at]) or abs(cosines[at] - model.least[at]) < 1e-5
            assert got[d].lang == (got[d].lang_near if got[d].accepted else "und")
        else:
            assert (got[d].lang_near, got[d].score, got[d].accepted) == ("und", 0.0, False)
    assert not got[901].accepted and got[900].lang_near in ("en", "fr")


def test_repeated_ids_use_no_places(spark):
    rows = [(1, f"the text of number {i}", "en") for i in range(3000)] + [(i, "the thing of", "en") for i in range(2, 40)] + [(i, "le été dans", "fr") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen, fitted = [], langid.fit_centroids
    try:
        langid.fit_centroids = lambda counts, langs, per_lang: seen.append(list(langs)) or fitted(counts, langs, per_lang)
        model = langid.fit_languages(docs, rows_per_lang=30)
    finally:
        langid.fit_centroids = fitted
    assert len(seen[0]) <= 60 and seen[0].count("en") <= 30 and set(model.langs) == {"en", "fr"}
    assert langid.fit_languages(docs, rows_per_lang=30).langs == model.langs
    try:
        langid.fit_languages(docs, most_langs=1)
        raise AssertionError("two languages fit a bound of one")
    except ValueError:
        pass


def best_split(x, y, rows, columns, least):
    """The split of least Gini impurity over thresholds at quantiles, by trying every one."""
    best = None
    for k in columns:
        for at in sorted({float(np.quantile(x[rows, k], q, method="lower")) for q in np.linspace(0.02, 0.98, 25)}):
            sides = [[r for r in rows if (x[r, k] > at) == above] for above in (False, True)]
            if min(map(len, sides)) >= least:
                gini = lambda s: (p := sum(y[r] for r in s) / len(s)) * (1 - p)
                gain = gini(rows) - sum(len(s) * gini(s) for s in sides) / len(rows)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, k, at)
    return best


def test_a_tree_by_enumeration():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    y = ((x[:, 1] > 0.2) & (x[:, 3] < 0.5) | (rng.random(120) < 0.05)).astype(int)
    want = []

    def grow(rows, path):
        if len(path) >= 2 or len(rows) < 16 or len({y[r] for r in rows}) < 2:
            return
        best = best_split(x, y, rows, range(4), 8)
        if best is None or best[0] < 1e-6:
            return
        for above in (False, True):
            want.append((*path, (best[1], above, best[2])))
            grow([r for r in rows if (x[r, best[1]] > best[2]) == above], want[-1])

    grow(list(range(120)), ())
    assert quality.tree_rules(x, y, 2, np.arange(4)) == want and len(want) >= 4


def test_pipeline_quality_keeps_what_the_rules_score(spark):
    """The stage against the rules applied to plain statistics, one document after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = set()
    for r in docs.collect():
        s = plain_statistics((r.text or "").encode())
        total = model.bias + sum(w for rule, w in model.rules if all((s[k] > at) == above for k, above, at in rule))
        if 1 / (1 + np.exp(-total)) >= 0.3:
            want.add(r.doc_id)
    assert kept == want
