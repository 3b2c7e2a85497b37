"""The queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, gridjoin, langid, licenses, linededup, media, mixing, packing, quality, records, simhash, spelling, topk
from .common import work_dir

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; a null or empty text is one piece with the end id alone, repeated rows are packed as often."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every vector with an id divisible by 100; ties go to the smaller id, null and empty vectors are neither found nor searched."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    return topk.hamming_top_k(codes, codes.where("id % 100 = 0"), 10)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of sources and what the mix takes of each document; a null source is one of its own, a null text has size 0, repeated rows are decided alike."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored picture, read back; a null text counts as empty, equal texts have equal values, repeated rows come as often."""
    found = media.document_media(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and templates in every whole text; null and empty texts have none, repeated rows come as often."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ids with their index written beside them, read back; a null text is empty, rows of one doc_id are ordered by a hash of the text."""
    path = work_dir(spark)
    records.write_records(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return records.global_starts(records.write_index(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text; null and empty texts are scored by their statistics, a null doc_id isn't held out, repeated rows come as often."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return quality.score_quality(docs, model, "doc_id").select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; one that is null or without a letter is und, a null doc_id isn't held out, repeated rows come as often."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_languages(docs))
    held_out = F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, F.col("lang_near").alias("lang_pred"), "score", "accepted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text less the chunks of lines that stand in an earlier one; a null text stays null, rows that agree in doc_id and text stay alike."""
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of fingerprints within 3 bits; null and empty texts have fingerprint 0, a null doc_id is larger than any other, repeated rows come as often."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language; a null lang is und, null and empty texts have no words, repeated rows count as often."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label within a cosine of 0.98; those that are null, zero or not finite, and null labels, link with nothing, repeated rows are copies."""
    return gridjoin.near_vectors(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents one edit apart; null and empty texts have no words, a null doc_id reads null, repeated rows count as often."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py; what each does with odd rows stands there."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    ops = (
        op1_best_fit_packing, op2_hamming_top_k, op3_source_mixing, op4_media_columns, op5_license_scan,
        op6_token_records, op7_quality_rules, op8_language_centroids, op9_line_dedup, op10_simhash_near_dedup,
        op11_phrase_collocations, op12_embedding_near_dedup, op13_spelling_variants, pipeline,
    )
    return {f.__name__: f for f in ops}


OP2_SQL = """
WITH codes AS (
    SELECT DISTINCT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code
    FROM embeddings WHERE len(embedding) > 0 AND vec_id IS NOT NULL
), pairs AS (
    SELECT q.id AS query_id, i.id AS id, CAST(hamming(q.code, i.code) AS INTEGER) AS distance
    FROM codes q JOIN codes i ON q.id % 100 = 0 AND i.id <> q.id AND length(i.code) = length(q.code)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM pairs
)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""

OP3_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM sizes
), levels AS (
    SELECT *, 2.0::DOUBLE * source_size / weight AS level_at FROM weighed
), run AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(2.0::DOUBLE * sum(source_size) OVER before, 0) AS left_over,
        sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
    FROM levels WINDOW before AS (ORDER BY level_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT *, max(left_over / weight_left) OVER () AS level FROM run
), targets AS (
    SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight)::DOUBLE AS target FROM level
), rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS uniform
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
    size * (CAST(floor(rate) AS BIGINT) + CASE WHEN uniform < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""

OP11_SQL = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), one AS (
    SELECT lang, p, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS p FROM words) GROUP BY lang, p
), two AS (
    SELECT lang, a, b, count(*)::HUGEINT AS f FROM (
        SELECT lang, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM words WHERE len(w) >= 2) GROUP BY lang, a, b HAVING count(*) >= 10
), three AS (
    SELECT lang, a, b, c, count(*)::HUGEINT AS f FROM (
        SELECT lang, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM words WHERE len(w) >= 3) GROUP BY lang, a, b, c HAVING count(*) >= 10
), cuts AS (
    SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
    FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.a JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
    UNION ALL
    SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 2, x.f, y.f
    FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN one y ON y.lang = t.lang AND y.p = t.c
    UNION ALL
    SELECT t.lang, t.a || ' ' || t.b, t.f, 1, x.f, y.f
    FROM two t JOIN one x ON x.lang = t.lang AND x.p = t.a JOIN one y ON y.lang = t.lang AND y.p = t.b
    WHERE NOT EXISTS (SELECT 1 FROM three u WHERE u.lang = t.lang AND 100 * u.f >= 50 * t.f AND (u.a = t.a AND u.b = t.b OR u.b = t.a AND u.c = t.b))
), scored AS (
    SELECT *, (1000000::HUGEINT * a * a) // (l * r) AS score FROM cuts
), best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE cut = 1
), sizes AS (
    SELECT lang, sum(f) AS n FROM one GROUP BY lang
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

OP12_SQL = """
WITH RECURSIVE vectors AS (
    SELECT row_number() OVER () AS nr, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), sound AS (
    SELECT nr, vec_id, label, v FROM vectors
    WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.nr AS src, b.nr AS dst FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.nr <> b.nr
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
    SELECT src, dst FROM links UNION SELECT r.src, l.dst FROM reached r JOIN links l ON r.dst = l.src
), smallest AS (
    SELECT r.src, min(v.vec_id) AS low FROM reached r JOIN vectors v ON v.nr = r.dst GROUP BY r.src
), counts AS (
    SELECT src, count(*) AS n FROM links GROUP BY src
)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(low, vec_id), vec_id) AS component_id, coalesce(least(low, vec_id), vec_id) = vec_id AS kept
FROM vectors LEFT JOIN smallest ON smallest.src = nr LEFT JOIN counts ON counts.src = nr
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_hamming_top_k": OP2_SQL, "op3_source_mixing": OP3_SQL, "op11_phrase_collocations": OP11_SQL, "op12_embedding_near_dedup": OP12_SQL}
