"""A training corpus in five stages: quality, line dedup, near-dedup, mixing, packing.

Every stage keeps the user's columns, whatever their names: those that it doesn't read travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fit on the labels outside fold 0, scores at 0.3 or more.

    Null and empty texts are scored like any others; repeated rows and ties are decided alike; a null doc_id has no
    label; without labels the score is 0.5 and all stay; an empty table gives no rows.
    """
    from lockstep.llm import quality
    from lockstep.llm.common import packed, unpacked

    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(packed(docs, "doc_id", "text"), model, "doc_id", "text", "_rest")
    return unpacked(scored.where("score >= 0.3"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of over 50 words and the chunks of lines that stand in an earlier one; those go of which nothing is left.

    n_chars follows the text. A null text stays null, and an empty one empty, since nothing is cut from them; rows that
    agree in doc_id and text stay alike; places are ordered by doc_id (null first) and hash of the text; an empty table gives no rows.
    """
    from lockstep.llm import linededup
    from lockstep.llm.common import freed, packed, stored, unpacked

    passages = stored(linededup.dedup_passages(packed(docs, "doc_id", "text").withColumn("_size", F.octet_length("text"))), "zstd")
    freed(spark)
    cut = F.octet_length("text") < F.col("_size")
    out = linededup.dedup_lines(passages).where(~F.coalesce(cut, F.lit(False)) | (F.trim("text") != ""))
    if "n_chars" not in docs.columns:
        return unpacked(out, docs.columns)
    size = F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest.n_chars"))
    return unpacked(out.withColumn("_rest", F.col("_rest").withField("n_chars", size)), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates on 5-word shingles (SimHash within 3 bits, or a Jaccard similarity of 0.8 or more), the document with the smallest doc_id.

    Texts without a word, null or empty, are one group; of repeated rows of a doc_id one stays; rows without a doc_id
    all stay; an empty table gives no rows.
    """
    from lockstep.llm import similar
    from lockstep.llm.common import packed, unpacked

    return unpacked(similar.keep_first(packed(docs, "doc_id", "text"), shingle=5), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it.

    A null source is a source of its own; a null or empty text has size 0 and follows its source's rate; repeated rows are
    decided alike, as their doc_id is; an empty table gives no rows.
    """
    from lockstep.llm import mixing
    from lockstep.llm.common import packed, unpacked

    return unpacked(mixing.emit(mixing.mix(packed(docs, "doc_id", "text", "source"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids.

    A null text counts as empty: one piece that holds the end id alone. Repeated rows are packed as often; a null doc_id stays
    null; an empty table gives no rows.
    """
    from lockstep.llm import packing
    from lockstep.llm.queries import tokenizer_path

    pieces = packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Tokenizers, SimHash and a fitted model are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read back as the next one's input."""
    from lockstep.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
