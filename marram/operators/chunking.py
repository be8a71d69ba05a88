"""Chunks of references."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.ranking import positions
from marram.functions.references import chunk_order
from marram.functions.text import paragraphs, sentences, strip

_ENDS = re.compile(r"^\s+|\s+$")


def fixed_pieces(text: str, n: int) -> list[str]:
    """Pieces of at most n characters that don't cut words where a space allows it: each ends before
    the white space that follows its n-th character, or else at the last space in them, or else after
    n characters (X1). Positions move through the text, so nothing is copied but the pieces."""
    end = len(text)
    while end and text[end - 1].isspace():
        end -= 1
    at = 0
    while at < end and text[at].isspace():
        at += 1
    pieces = []
    while end - at > n:
        cut = at + n if text[at + n].isspace() else text.rfind(" ", at, at + n)
        if cut <= at:
            cut = at + n
        pieces.append(text[at:cut].strip())
        at = cut
        while at < end and text[at].isspace():
            at += 1
    if at < end:
        pieces.append(text[at:end])
    return pieces or [text]


def fixed(refs: DataFrame, n: int, key: str = "reference_id", text: str = "text") -> DataFrame:
    """``key``, chunk_index, chunk for every reference (null texts count as empty)."""

    def run(batches):
        for batch in batches:
            cut = [fixed_pieces(t or "", n) for t in batch.column(1).to_pylist()]
            rows = pa.array([k for k, pieces in enumerate(cut) for _ in pieces], pa.int32())
            index = pa.array([i for pieces in cut for i in range(len(pieces))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), index, pa.array([p for pieces in cut for p in pieces], pa.string())], names=[key, "chunk_index", "chunk"])

    kind = refs.select(key).dtypes[0][1]
    return refs.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_index int, chunk string")


def split(refs: DataFrame, strategy: str, n: int | None = None, key: str = "reference_id", text: str = "text") -> DataFrame:
    """``key``, chunk_index, chunk by "fixed_characters", "sentence" or "paragraph"."""
    if strategy == "fixed_characters":
        if not n or n < 1:
            raise ValueError("fixed_characters needs a length of at least 1")
        return fixed(refs, n, key, text)
    if strategy not in ("sentence", "paragraph"):
        raise ValueError(f"unknown strategy {strategy}")
    pieces = (sentences if strategy == "sentence" else paragraphs)(F.coalesce(F.col(text), F.lit("")))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.coalesce(F.col(text), F.lit(""))))
    return refs.select(key, F.posexplode(pieces).alias("chunk_index", "chunk"))


def local_index(rows: DataFrame, group: str, order: list[Column | str], name: str = "chunk_index") -> DataFrame:
    """Index from 0 inside ``group`` of the rows that are there."""
    return positions(rows, group, order, name)


def reindex(refs: DataFrame, boxes: str = "bboxs", text: str = "text") -> DataFrame:
    """``refs`` with the last hierarchy level's order counted from 0 among siblings: rows whose parent
    path, depth and last level are equal (W3). Siblings may be any share of the table: see positions()."""
    h = F.col("hierarchy")
    siblings = F.sha2(F.to_json(F.struct(F.expr("slice(hierarchy, 1, greatest(size(hierarchy) - 1, 0))").alias("parents"), F.size(h).alias("depth"), F.try_element_at(h, F.lit(-1))["heading_level"].alias("level"))), 256)
    last = F.element_at(h, -1)
    renumbered = F.struct(last["title"].alias("title"), last["heading_level"].alias("heading_level"), last["heading_number"].alias("heading_number"), F.col("_order").alias("order"))
    order = [*chunk_order(h, F.col(boxes), F.col(text)), F.col("reference_id")]
    numbered = positions(refs.withColumn("_siblings", siblings), "_siblings", order, "_order").drop("_siblings")
    return numbered.withColumn("hierarchy", F.when(F.size(h) > 0, F.concat(F.expr("slice(hierarchy, 1, size(hierarchy) - 1)"), F.array(renumbered))).otherwise(h)).drop("_order")


def chunked_copy(refs: DataFrame, target_group: str, strategy: str, n: int | None = None) -> DataFrame:
    """A chunked group: texts are split and keep the columns of their reference, other types are copied.

    New ids are <reference_id>:<chunk_index>."""
    texts = refs.where("type = 'text'")
    pieces = split(texts.where(strip(F.coalesce("contained_text", F.lit(""))) != ""), strategy, n, "reference_id", "contained_text")
    cut = texts.drop("contained_text").join(pieces, "reference_id").withColumnRenamed("chunk", "contained_text")
    rest = refs.where("type <> 'text'").withColumn("chunk_index", F.lit(0))
    both = cut.select(*refs.columns, "chunk_index").unionByName(rest.select(*refs.columns, "chunk_index"))
    return both.withColumn("source_reference_id", F.col("reference_id")).withColumn("reference_id", F.concat_ws(":", F.col("reference_id").cast("string"), "chunk_index")).withColumn("reference_group_id", F.lit(target_group))


def refresh(existing: DataFrame, chunks: DataFrame, guideline_id: str) -> DataFrame:
    """``existing`` with one guideline's rows replaced by ``chunks``."""
    return existing.where(F.col("guideline_id") != guideline_id).unionByName(chunks.where(F.col("guideline_id") == guideline_id))


def group_name(base: str, strategy: str, n: int | None, taken: list[str]) -> str:
    """<base>_<strategy>[_n], with the next free number where it is taken."""
    name = "_".join([base, strategy, *([str(n)] if n else [])])
    number, free = 1, name
    while free in taken:
        number += 1
        free = f"{name}_{number}"
    return free


def counts(chunks: DataFrame, source: str = "reference_id") -> DataFrame:
    """source, created, chunked: references, chunks, references with more than one."""
    each = chunks.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("source"), F.sum("n").alias("created"), F.count_if(F.col("n") > 1).alias("chunked"))
