"""The domain's tables as views of generic ones.

A document is a reference of its source (the guideline) and language (the group). Its hierarchy has a
level for the language, one for its length and one for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.ranking import positions
from marram.operators.textindex import TextIndex
from marram.operators.vectorindex import VectorIndex
from marram.plans.scratch import exists, scratch_path

#: Shortest keyword, in characters.
KEYWORD_LENGTH = 6

HIERARCHY = (
    "array(named_struct('title', lang, 'heading_level', 1, 'heading_number', '1', 'order', 0L),"
    " named_struct('title', concat('B', bucket), 'heading_level', 2, 'heading_number', concat('1.', bucket), 'order', bucket),"
    " named_struct('title', '', 'heading_level', 3, 'heading_number', '', 'order', doc_id))"
)


#: Tables whose rows cost much work each.
TEXTS = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has hardly more splits than there are cores: a small file can be one
    row group, which one task would tokenise alone. A large scan stays as it is; filters and columns still
    reach it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= 2 * cores else df


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reference_id, guideline_id, reference_group_id, type, text, bucket, hierarchy."""
    documents = table(spark, sf_dir, "documents").withColumn("bucket", F.expr("least(n_chars div 1000, 5L)"))
    return documents.select(
        F.col("doc_id").alias("reference_id"), F.col("source").alias("guideline_id"), F.col("lang").alias("reference_group_id"), F.lit("text").alias("type"), "text", "n_chars", "bucket", F.expr(HIERARCHY).alias("hierarchy")
    )


def keyword_lists(refs: DataFrame) -> DataFrame:
    """reference_id, keywords: distinct lower-case words of the whole text with at least KEYWORD_LENGTH characters."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= KEYWORD_LENGTH))
    return refs.select("reference_id", words.alias("keywords"))


def keywords(refs: DataFrame) -> DataFrame:
    """reference_id, keyword: a row for each of them. For a plain explode Spark would cut every text into words a second time, in a filter on empty lists."""
    return keyword_lists(refs).select("reference_id", F.explode_outer("keywords").alias("keyword")).where("keyword is not null")


def placed(refs: DataFrame) -> DataFrame:
    """references with pos: the place in their guideline by graph order."""
    return positions(refs, "guideline_id", ["bucket", "reference_id"])


def seeds(refs: DataFrame) -> DataFrame:
    """The stated query set: references whose id is divisible by 50, all of one expansion per guideline."""
    return refs.where("reference_id % 50 = 0").select(F.col("guideline_id").alias("query_id"), "reference_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Indexes of this application, by application and folder of tables.
_indexes: dict[tuple[str, str], str] = {}
_balls: dict[tuple[str, str], VectorIndex] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of ``references``, made by the first query of an application that searches them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes or not exists(spark, f"{_indexes[key]}/sizes"):
        path = scratch_path(spark, "text-index")
        TextIndex(spark, path).append(references(spark, sf_dir))
        _indexes[key] = path
    return TextIndex(spark, _indexes[key])


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored balls of ``vectors``, made likewise."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _balls or not exists(spark, _balls[key].path):
        _balls[key] = VectorIndex.build(vectors(spark, sf_dir), scratch_path(spark, "vector-index"))
    return _balls[key]
