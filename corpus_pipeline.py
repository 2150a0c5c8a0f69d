"""A corpus pipeline from the text operators.

``run(spark, sf_dir)`` applies STAGES to the table documents; each stage's result
is written as Parquet in the shared folder and read again as the next one's docs.

Every stage keeps all columns but the last, whatever their names. A null text is an
empty one. Rows without an id are documents of their own. Rows that repeat an id and
a text are copies of one document, of which near_dedup keeps one row; rows that share
an id alone count as one document where documents are counted or linked. Each stage
of an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm._frames import materialize, name
from pointweave.llm.decontaminate import find_contamination
from pointweave.llm.line_dedup import drop_repeated_lines
from pointweave.llm.near_dup import near_duplicates
from pointweave.llm.packing import pack_documents
from pointweave.llm.queries import byte_bpe_path
from pointweave.llm.toxicity import judged_labels, score_toxicity, train_chain


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with columns besides id and text under names that no operator adds."""
    kept = ("doc_id", "text")
    return docs.select(*[F.col(name(c)).alias(c if c in kept else f"_pw_{k}") for k, c in enumerate(docs.columns)])


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` from what was made of ``_apart(like)``."""
    kept = ("doc_id", "text")
    return df.select(*[F.col(c if c in kept else f"_pw_{k}").alias(c) for k, c in enumerate(like.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go.

    The chain is fitted on labelled documents among ``docs``; without any, none goes. A null or
    empty text is judged by the chain's bias. Repeated rows are judged alike.
    """
    labels = judged_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    chain = train_chain(docs, labels, ["low_quality", "toxic"])
    return _columns(score_toxicity(_apart(docs), chain).filter(~F.col("toxic")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go; the documents stay, with their new lengths.

    A null text comes back as the empty text; a document may lose all of its lines.
    """
    out = _columns(drop_repeated_lines(_apart(docs), min_docs=10, min_chars=1), docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without words, and rows without an id, are linked with nothing and stay. Of rows
    that repeat an id and a text one stays.
    """
    out = near_duplicates(docs, size=5, share=0.75).filter("kept")
    kept = out.groupBy(F.col("doc_id").alias("_pw_kept")).agg(F.count(F.lit(1)).alias("_pw_rows"))
    kept = materialize(kept)
    here = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_pw_kept")), "left_semi")
    several = kept.filter("_pw_kept IS NOT NULL AND _pw_rows > 1").select("_pw_kept")
    if several.isEmpty():
        return here
    repeated = here.join(several, F.col("doc_id") == F.col("_pw_kept"), "left_semi")
    alone = here.join(several, F.col("doc_id").eqNullSafe(F.col("_pw_kept")), "left_anti")
    return alone.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go; those without words stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _columns(find_contamination(_apart(docs), benchmark, window=13, share=0.05).filter(~F.col("contaminated")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of at most 1024 tokens; an empty one is one piece."""
    return pack_documents(docs, byte_bpe_path(), capacity=1024, end_id=0, digest=True)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs


#: SQL cannot express the classifier or the packing; tests compare with a plain version.
ORACLE_SQL = None
