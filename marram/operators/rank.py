"""Relevance filters, dedup, merging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.ranking import firsts, positions
from marram.functions.text import keyword_key
from marram.operators.search import at_least


def decide(items: DataFrame, minimum: float | None = None, top: int | None = None, sort_by_score: bool = True) -> DataFrame:
    """items (query_id, idx, score, kept, reason) with the final ``kept`` and ``reason``, and ``place`` of
    the kept ones (T8): the minimum score lets null pass; best score first, null last, then index;
    beyond ``top`` an item is dropped with a note."""
    passing = F.col("kept") & at_least("score", minimum)
    marked = items.withColumn("_pass", passing)
    score = [F.col("score").isNull().cast("int"), -F.col("score").cast("double")] if sort_by_score else []
    placed = positions(marked, "query_id", [(~F.col("_pass")).cast("int"), *score, F.col("idx")], "_at").withColumn("_place", F.col("_at") + 1).drop("_at")
    keep = F.col("_pass") & (F.col("_place") <= top if top is not None else F.lit(True))
    reason = F.when(F.col("_pass") & ~keep, F.concat(F.coalesce("reason", F.lit("")), F.lit(" Cut by top-k."))).otherwise(F.col("reason"))
    return placed.withColumn("kept", keep).withColumn("reason", reason).withColumn("place", F.when(F.col("kept"), F.col("_place"))).drop("_pass", "_place")


def dedup(items: DataFrame, text: Column, keep: str = "highest_score", normalise: bool = True) -> DataFrame:
    """items (query_id, idx, score, ...) with ``kept``: one of each text stays, the best score (null last,
    lowest index of equals) or the first (D3). The choice is a partial aggregation; no text is sorted."""
    key = F.xxhash64(keyword_key(text) if normalise else text)
    full = keyword_key(text) if normalise else text
    best = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))) if keep == "highest_score" else F.lit(0.0)
    rows = items.withColumn("_h", key).withColumn("_t", full)
    chosen = rows.groupBy("query_id", "_h", "_t").agg(F.max(F.struct(best.alias("s"), (-F.col("idx")).alias("i"))).alias("b")).select("query_id", (-F.col("b.i")).alias("idx"), F.lit(True).alias("_k"))
    return items.join(chosen, ["query_id", "idx"], "left").withColumn("kept", F.coalesce("_k", F.lit(False))).drop("_k")


def ordered_dedup(items: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return firsts(items, keys, order)


def merge(results: DataFrame, limit: int | None = None, deduplicate: bool = True) -> DataFrame:
    """results (query_id, seq, items: array<struct<id,...>>, latency) merged per query (D2, A10, C7):
    ``latency`` (values that are no numbers are skipped), ``received`` items and the ``items`` in order,
    each id once, at most ``limit``."""
    sums = results.groupBy("query_id").agg(F.sum(F.col("latency").try_cast("double")).alias("latency"), F.sum(F.greatest(F.size("items"), F.lit(0))).alias("received"))
    flat = results.select("query_id", "seq", F.posexplode("items").alias("i", "item"))
    kept = firsts(flat.withColumn("_id", F.col("item.id")), ["query_id", "_id"], ["seq", "i"]) if deduplicate else flat
    lists = kept.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "i", "item"))), lambda x: x["item"]).alias("items"))
    if limit is not None:
        lists = lists.withColumn("items", F.slice("items", 1, limit))
    return sums.join(lists, "query_id", "left")


def added(result: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """What the result has beyond the seeds."""
    return result.join(seeds.select(*keys), keys, "left_anti")


def distinct_strings(values: Column) -> Column:
    """Each string once, whatever its case; the first spelling stays."""
    return F.aggregate(
        values, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when((F.trim(x) == "") | F.exists(acc, lambda y: F.lower(y) == F.lower(F.trim(x))), acc).otherwise(F.concat(acc, F.array(F.trim(x))))
    )


def score_with(items: DataFrame, scorer, text: str = "text", query: str = "query") -> DataFrame:
    """items with ``score`` from a scorer: a function from a list of (query, text) pairs to scores."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(score=[float(s) for s in scorer(list(zip(pdf[query], pdf[text], strict=True)))])

    ddl = ", ".join(f"`{n}` {t}" for n, t in items.drop("score").dtypes)
    return items.drop("score").mapInPandas(run, f"{ddl}, score double")
