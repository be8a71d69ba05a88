"""A training-data pipeline of five stages over ``documents``.

Quality classifier (what it rejects goes), line dedup, MinHash near-dedup (one document of each
group stays), secret scan (spans are replaced by a mark) and packing. Each stage gets the rows
that the one before kept, as a Parquet table in the shared folder; all but the last return the
columns of documents. Rows that repeat an id are one document for the near-dedup: they stay or go
together, and of rows equal in id and text one stays. A document whose lines all stand elsewhere is a
copy and goes with the line dedup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import lines, minhash, packing, quality, secrets, tokens
from marram.llm.common import materialise
from marram.llm.queries import tokenizer_path

#: A document whose score is under this is rejected.
QUALITY = 0.7


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no name of theirs meets an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_m_rest"))


def _wide(rows: DataFrame, docs: DataFrame, changed: str | None = None) -> DataFrame:
    """The columns of ``docs`` again; n_chars is counted anew where the column ``changed`` holds."""
    columns = []
    for c in docs.columns:
        column = F.col("text") if c == "text" else F.col("_m_rest")[c]
        if c == "n_chars" and changed:
            column = F.when(F.expr(changed), F.length("text").cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return rows.select(*columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    machine = quality.train(docs, labels.where((F.crc32(F.col("doc_id").cast("string")) % 4) != 2), metadata=["n_chars"])
    return _wide(quality.score(_narrow(docs), machine, metadata=["_m_rest.n_chars"]).where(F.col("score") >= QUALITY), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = lines.dedup(_narrow(docs))
    return _wide(done.where("not (chunks_removed > 0 and text = '')"), docs, changed="chunks_removed > 0")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).where("kept and doc_id is not null").select(F.col("doc_id").alias("_m_id")).distinct()
    rows = _narrow(docs)
    one = rows.join(kept, F.col("doc_id") == F.col("_m_id"), "left_semi").withColumn("_m_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_m_text"]).drop("_m_text")
    return _wide(one.unionByName(rows.where("doc_id is null")), docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(_narrow(docs))
    some = F.size("found") > 0
    return _wide(found.withColumn("text", F.when(some, secrets.redact(F.col("text"), F.col("found"))).otherwise(F.col("text"))), docs, changed="size(found) > 0")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = tokens.lengths(docs, tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(sized, budget=16384, buckets=16, length="n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secret_redaction),
    ("packing", pack),
]

#: A fitted classifier and Arrow-side chunking are beyond SQL; a test holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
