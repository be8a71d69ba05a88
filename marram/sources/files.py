"""CSV questions, prompts, snapshots (SRC5 to SRC10, A5)."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.functions.text import strip
from marram.operators.tables import runs

# Column names of the exchange format.
QUESTION_COLUMNS = (
    "Question ID", "Question group", "Question supercategory", "Question subcategory", "Question", "Correct Answer", "Answer Guideline Source", "Answer Guideline Title",
    "Answer Bounding Boxes", "Answer Reference Type", "Retrieval Text", "Comment",
)
SNIPPET = T.StructType([T.StructField(n, T.StringType()) for n in ("guideline_source", "guideline_title", "bounding_boxes", "reference_type", "retrieval_text")])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header; a byte order mark in front is dropped, quoted line breaks stay (SRC5)."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.replace("﻿", "") for c in df.columns])


def questions(rows: DataFrame, order: str) -> DataFrame:
    """Question entries from CSV rows: consecutive rows of one question, category, answer and comment are one
    entry with a snippet per row; rows without question or category are skipped and break no entry (A5)."""
    text = lambda c: strip(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    named = rows.select(
        F.col(order).alias("_order"), F.lit(0).alias("_all"), text("Question").alias("question"), text("Question supercategory").alias("super_class"), text("Question subcategory").alias("sub_class"), text("Correct Answer").alias("answer"),
        text("Comment").alias("note"), F.struct(*[text(c).alias(n.name) for c, n in zip(QUESTION_COLUMNS[6:11], SNIPPET.fields, strict=True)]).alias("snippet"),
    ).where("question <> '' and super_class <> '' and sub_class <> ''")
    key = ["question", "super_class", "sub_class", "answer", "note"]
    marked = runs(named, "_all", ["_order"], key)
    filled = F.filter(F.sort_array(F.collect_list(F.struct("_order", "snippet"))), lambda s: (s["snippet"]["retrieval_text"] != "") | (s["snippet"]["bounding_boxes"] != ""))
    return marked.groupBy("run", *key).agg(F.transform(filled, lambda s: s["snippet"]).alias("expected_retrieval"))


def export(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the exchange format: one per snippet, one for a question without (SRC6, J3)."""
    named = entries.join(groups.select(F.col("group_id").alias("question_group_id"), F.col("name").alias("group_name")), "question_group_id", "left")
    flat = named.withColumn("s", F.explode_outer("expected_retrieval"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    values: list[Column] = [
        F.col("question_id").cast("string"), F.col("group_name"), F.col("super_class"), F.col("sub_class"), F.col("question"), F.col("answer"), F.col("s.guideline_source"), F.col("s.guideline_title"),
        F.col("s.bounding_boxes"), F.col("s.reference_type"), F.col("s.retrieval_text"), F.col("note"),
    ]
    return flat.select(*[blank(v).alias(n) for v, n in zip(values, QUESTION_COLUMNS, strict=True)])


def prompts(folder: str) -> dict[str, str]:
    """Markdown prompts by the name of their directory, each name once (SRC10)."""
    found: dict[str, str] = {}
    for path in sorted(Path(folder).rglob("*.md")):
        name = path.parent.name
        if name in found:
            raise ValueError(f"two prompts are named {name}")
        found[name] = path.read_text(encoding="utf-8")
    return found


def save_snapshot(df: DataFrame, path: str) -> None:
    """Replace a stored table (SRC7): the new one is written beside the old and takes its name when it is whole.
    A job that fails leaves the old one as it is."""
    spark = df.sparkSession
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old, target = (to_path(f"{path.rstrip('/')}{suffix}") for suffix in (f".{uuid.uuid4().hex}.new", f".{uuid.uuid4().hex}.old", ""))
    df.write.parquet(str(new))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(new, target)
    fs.delete(old, True)
