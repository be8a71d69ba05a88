"""Packing into optimal length buckets.

All lengths go into one global histogram. Dynamic programming over it chooses the bucket lengths
that make the sum of padded lengths smallest: with buckets ending at cells j, the best cost for k
buckets up to j is min over i of cost(k-1, i) + top(j) * rows(i..j]; as top grows with j and the
row count with i, the minimum over i is a lower envelope of lines, so a bucket costs one sweep.
Each document is padded to its bucket's length; batches inside a bucket hold as many documents as
the token budget allows, every one full but a bucket's last.

The histogram has a count for each length that occurs. Lengths that all differ add up, so n tokens have at
most sqrt(2 n) of them: a few million for any corpus, and some ten thousand for most. That, and the
choices of the dynamic programme (4 bytes per length and bucket), is all that the driver holds. Lengths
are counted once, into a table that the histogram, the parts and the ranks read.
Ranks inside a bucket are made in parts of bounded size with offsets from the parts' counts; rows are dealt to them by a number of their own,
so that rows of one id and length are spread like others.

Defined cases: null and empty texts have length 0; a text over the budget has a batch of its own
(never cut); equal rows have each their slot; a null id is placed like any other; an empty table
gives no rows; columns other than the id, and text or length, are not read.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marram.llm.common import materialise

#: Documents in one part of a bucket that is ranked by itself.
PART = 1024


def words(text: Column) -> Column:
    """Number of words of a text: runs of characters other than space and 0x09-0x0D."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def optimal_buckets(histogram: dict[int, int], most: int) -> list[int]:
    """Bucket lengths (ascending, at most ``most``) with the least padded total."""
    tops = sorted(histogram)
    if not tops:
        return []
    before = [0]
    for top in tops:
        before.append(before[-1] + histogram[top])
    n = len(tops)
    cost = [0] + [tops[j] * before[j + 1] for j in range(n)]
    choice = [array("i", [0]) * (n + 1)]
    best = (cost[n], 1)
    for k in range(2, min(most, n) + 1):
        # Lines y = cost[i] - before[i] * x, slopes falling with i, asked at rising x.
        new, picks = [0] * (n + 1), array("i", [0]) * (n + 1)
        hull: list[int] = []
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) - head >= 2:
                a, b = hull[-2], hull[-1]
                if (cost[i] - cost[a]) * (before[b] - before[a]) <= (cost[b] - cost[a]) * (before[i] - before[a]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = tops[j - 1]
            head = min(head, len(hull) - 1)
            while len(hull) - head >= 2 and cost[hull[head + 1]] - before[hull[head + 1]] * x <= cost[hull[head]] - before[hull[head]] * x:
                head += 1
            i = hull[head]
            new[j], picks[j] = cost[i] + x * (before[j] - before[i]), i
        cost = new
        choice.append(picks)
        if cost[n] < best[0]:
            best = (cost[n], k)
    ends, j = [], n
    for k in range(best[1] - 1, -1, -1):
        ends.append(tops[j - 1])
        j = choice[k][j]
    return sorted(ends)


def pack(docs: DataFrame, budget: int = 16384, buckets: int = 16, length: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, padding, batch (from 0 inside its bucket), slot.

    ``length`` names an integer column with token counts; without it words are counted.
    """
    size = F.col(length).cast("long") if length else words(F.col("text"))
    sized = materialise(docs.select("doc_id", F.greatest(F.lit(0), F.coalesce(size, F.lit(0))).cast("long").alias("n_tokens")).withColumn("row", F.monotonically_increasing_id()), "lengths")
    histogram = dict(sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().itertuples(index=False, name=None))
    tops = optimal_buckets(histogram, buckets) or [0]

    inside = np.zeros(len(tops), dtype=np.int64)
    np.add.at(inside, np.searchsorted(tops, list(histogram)), list(histogram.values()))
    bucket, top, parts = F.lit(len(tops) - 1), F.lit(tops[-1]).cast("long"), F.lit(1).cast("long")
    for k in range(len(tops) - 1, -1, -1):
        fits = F.col("n_tokens") <= tops[k]
        bucket, top = F.when(fits, k).otherwise(bucket), F.when(fits, F.lit(tops[k]).cast("long")).otherwise(top)
        parts = F.when(fits, F.lit(-(-int(inside[k]) // PART)).cast("long")).otherwise(parts)
    placed = sized.select("row", "doc_id", "n_tokens", bucket.alias("bucket"), top.alias("bucket_length"), parts.alias("parts"))
    placed = placed.withColumn("part", F.expr("pmod(xxhash64(row), greatest(parts, 1))")).drop("parts")

    counts = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("bucket", "part", F.coalesce(offset, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "n_tokens", "row")) - 1
    ranked = placed.withColumn("rank", rank).join(counts, ["bucket", "part"]).withColumn("rank", F.col("rank") + F.col("offset"))
    capacity = F.greatest(F.lit(1), F.expr(f"{int(budget)}L div greatest(bucket_length, 1L)"))
    ranked = ranked.withColumn("capacity", capacity)
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", (F.col("bucket_length") - F.col("n_tokens")).alias("padding"), F.expr("rank div capacity").alias("batch"), F.expr("cast(rank % capacity as int)").alias("slot")
    )
