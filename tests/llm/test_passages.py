import random

import corpus_pipeline
from lockstep.llm import linededup

WORDS = 51


def plain_passages(rows):
    """Each (id, text) less the words that lie in a run of 51 words that stands at an earlier place; a loop over all runs."""
    first, out = {}, {}
    for d, text in sorted(rows):
        words, gone = text.split(), set()
        for at in range(len(words) - WORDS + 1):
            where = first.setdefault(tuple(words[at : at + WORDS]), (d, at))
            if where[0] != d or at - where[1] >= WORDS:
                gone.update(range(at, at + WORDS))
        out[d] = [w for i, w in enumerate(words) if i not in gone]
    return out


def prose(rng, lines, per_line):
    return "".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(per_line)) + rng.choice((". ", ".\n", " ")) for _ in range(lines))


def planted(seed=3):
    """Passages of 1 to 10 lines, each in three hosts of other lines, and texts without any."""
    rng, rows = random.Random(seed), []
    for lines in range(1, 11):
        passage = prose(rng, lines, max(52 // lines + 1, 9))
        rows += [(len(rows) + k, prose(rng, 3, 9) + passage + prose(rng, 2, 11)) for k in range(3)]
    rows.append((len(rows), "one word more " * 90))
    rows += [(len(rows) + k, prose(rng, 12, 10)) for k in range(10)]
    return rows


def test_whole_passages_go_from_any_host(spark):
    rows = planted()
    got = dict(linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert {d: t.split() for d, t in got.items()} == plain_passages(rows)
    assert all(len(got[d].split()) == 27 + 22 for d in range(30) if d % 3)
    assert all(got[d] == t for d, t in rows if d < 30 and d % 3 == 0 or d > 30)


def test_passages_of_the_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = dict(linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {d: t.split() for d, t in got.items()} == plain_passages(rows)


def test_passages_without_spaces_and_odd_rows(spark, odd_docs, no_docs):
    rng = random.Random(1)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    passage, hosts = han(60), [han(20) for _ in range(4)]
    rows = [(1, hosts[0] + passage + hosts[1]), (2, hosts[2] + passage + hosts[3])]
    assert dict(linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == {1: rows[0][1], 2: hosts[2] + hosts[3]}
    out = linededup.dedup_passages(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert out.where("text is null").count() == 1 and linededup.dedup_passages(no_docs).count() == 0


def test_line_dedup_stage_takes_whole_passages(spark):
    rows = [(d, t, "en", "s", len(t)) for d, t in planted(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert all(len(got[d].text.split()) == 27 + 22 for d in range(30) if d % 3) and all(r.n_chars == len(r.text) for r in got.values())
