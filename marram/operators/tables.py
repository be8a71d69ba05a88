"""Tables as DataFrames: scans with optional predicates, keyed changes, lookups (SRC, F, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.ranking import positions, running_sum, with_previous
from marram.functions.text import strip


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows that equal all given values; None asks for nothing (F1, SRC1)."""
    return reduce(lambda out, kv: out.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in values.items() if v is not None), df)


def matches(column: str, pattern: str) -> Column:
    """Case-insensitive regular expression (F2)."""
    return F.col(column).rlike(f"(?i){pattern}")


def contains(column: str, text: str) -> Column:
    """Case-insensitive literal substring."""
    return F.lower(column).contains(text.lower())


def resolve(keys: DataFrame, df: DataFrame, columns: list[str], newest: str) -> DataFrame:
    """keys (key) with the row of ``df`` of which any of ``columns`` equals it, newest first (SRC4, J4).
    One equi join per column instead of an OR condition, which would be a nested loop."""
    found = reduce(DataFrame.unionByName, [keys.join(df.withColumn("key", F.col(c).cast("string")), "key") for c in columns])
    row = F.struct(*[F.col(c) for c in df.columns])
    return found.groupBy("key").agg(F.max_by(row, newest).alias("_row")).select("key", "_row.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows of ``changes`` in place of those with the same keys (SRC12)."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


def delete(table: DataFrame, doomed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rest, deleted keys) (SRC13)."""
    return table.join(doomed.select(*keys), keys, "left_anti"), table.join(doomed.select(*keys), keys, "left_semi").select(*keys)


def newest(df: DataFrame, key: str, by: str) -> DataFrame:
    """The latest row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != key]), by).alias("_row")).select(key, "_row.*")


def runs(df: DataFrame, partition: str, order: list[str], key: list[str]) -> DataFrame:
    """Consecutive rows of equal key (A5): ``run`` counts from 1 inside the partition, which may be the whole table."""
    laid = with_previous(df, partition, order, key, "_at")
    changed = reduce(lambda a, b: a | b, [~F.col(f"previous_{k}").eqNullSafe(F.col(k)) for k in key])
    marked = laid.withColumn("_new", F.when((F.col("_at") == 0) | changed, 1).otherwise(0)).drop(*[f"previous_{k}" for k in key])
    return running_sum(marked, partition, "_at", "_new", "run").drop("_new", "_at")


def history(df: DataFrame, partition: str, order: str, last: int) -> DataFrame:
    """The last n rows of each partition."""
    latest = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(order)))
    return df.withColumn("_r", latest).where(F.col("_r") <= last).drop("_r")


def batches(df: DataFrame, order: list[Column | str], size: int, per: str) -> DataFrame:
    """Index and batch of each row inside ``per``."""
    return positions(df, per, order, "item_index").withColumn("batch", F.expr(f"item_index div {int(size)}"))


def long_enough(column: str, least: int) -> Column:
    """Texts of at least so many characters, ends stripped."""
    return F.length(strip(F.coalesce(F.col(column), F.lit("")))) >= least


def item_at(values: Column, index: Column | int) -> Column:
    """The item at an index from 0, null where there is none."""
    return F.get(values, index if isinstance(index, Column) else F.lit(index))


def required(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all ``columns`` hold something."""
    return reduce(lambda out, c: out.where(F.col(c).isNotNull() & (strip(F.col(c).cast("string")) != "")), columns, df)


def present(keys: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """keys with ``present``: whether ``table`` has a row of that key."""
    there = table.select(column).distinct().withColumn("_there", F.lit(True))
    return keys.join(there, column, "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def listing(df: DataFrame, by: str, tie: str, newest_first: bool = True, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows in the order of a listing, or a page of it."""
    out = df.orderBy(F.desc_nulls_last(by) if newest_first else F.asc_nulls_last(by), tie).offset(skip)
    return out if limit is None else out.limit(limit)


def reading_order(title: Column, page: Column, locale: str | None = None) -> list[Column]:
    """Order of references in a reader (T10): orders of the hierarchy, level by level, a shorter path first; then
    the page, missing ones last; then the title, by the collation of a ``locale`` ("de", "sv", ...) or else by its bytes."""
    return [F.transform("hierarchy", lambda h: h["order"]), F.coalesce(page.cast("long"), F.lit(2**62)), title if locale is None else locale_key(title, locale)]


def locale_key(text: Column, locale: str) -> Column:
    """``text`` with a collation: comparisons, sorts, groups and joins on it follow the locale."""
    return F.collate(text, locale)


def columns_of(df: DataFrame, keep: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Some columns, or all but some."""
    return df.select(*[c for c in df.columns if (keep is None or c in keep) and c not in (without or [])])


def capped(values: Column, most: int | None) -> Column:
    """At most so many items of a list."""
    return values if most is None else F.slice(values, 1, most)
