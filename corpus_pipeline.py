"""From documents to packed token windows: toxicity, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents.

Defined results: those of the four operators. A null or empty text is scored, is a copy of
other such texts, has size 0 in the mix, and is packed as its closing id if the mix takes it;
rows with null ids take part in every stage; of rows that repeat id and text one stays; a very
long text goes through whole; an empty table gives no rows; other columns of any name are kept
up to the last stage, which gives the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorvia.llm.common import cut, table
from quorvia.llm.minhash import keep_one
from quorvia.llm.mixing import mixed
from quorvia.llm.packing import pack_documents
from quorvia.llm.queries import tokenizer_path
from quorvia.llm.toxicity import drop_toxic
from quorvia.sources.stored import freed, tables


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on the labelled ones, rejects."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids."""
    pieces = pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: A fitted classifier and signatures are not SQL; a test runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written to the shared folder.

    Once a stage is written, what it built on is removed; the last one's input stays.
    """
    docs = table(spark, sf_dir, "documents")
    before = set(tables(spark))
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        *used, _ = (t for t in tables(spark) if t not in before)
        freed(spark, used)
    return STAGES[-1][1](spark, docs, sf_dir)
