"""The corpus pipeline: documents -> token ids of what is worth training on.

Each stage works on all that the stage before it kept, is written as Parquet
and read again; all but the last return the columns of ``documents``.

1. language ID: a document whose language is unknown, or known with less than
   LEAD times chance among the learned languages, goes;
2. exact dedup: of equal texts the longest original (then the smallest id) stays;
3. SimHash near-dedup: of each component the document of the smallest id stays;
4. benchmark decontamination: contaminated documents go;
5. SentencePiece encoding and decoding: token ids, and digests of the ids and of the decoded text.

Rows with a null id are one document in the stages that decide by id; rows
that repeat id and text become one row in stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.chunk_dedup import exact_groups
from ferrule.llm.common import keep_rows
from ferrule.llm.decontam import decontaminate
from ferrule.llm.langid import keep_identified
from ferrule.llm.simhash import near_groups
from ferrule.llm.sp_codec import encode_documents
from ferrule.operators.spread import materialize
from ferrule.session import table

LEAD = 1.2  # times chance: 0.6 of two learned languages, 0.3 of four, 0.06 of twenty


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, LEAD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = materialize(exact_groups(docs).where("kept").select("doc_id"), "kept")
    rows = keep_rows(docs, kept)
    if not kept.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "text"])
    return rows


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_groups(docs, shingle=4, radius=4)
    return keep_rows(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]
ORACLE_SQL = None  # language ID and encoding have no SQL twin; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
