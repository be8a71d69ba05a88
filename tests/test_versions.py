from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from marram.sources.versions import Conflict, VersionedTable

TASK = "task_id long, status string, claimed_by string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_are_whole_and_stay(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t").create(spark.createDataFrame([(i, "open", None) for i in range(40)] + [(None, "open", "x")], TASK), ["task_id"], buckets=4)
    assert table.upsert(spark.createDataFrame([(3, "done", "a"), (99, "new", "b"), (None, "null key", None)], TASK)) == 1
    assert table.delete(spark.createDataFrame([(5,), (7,), (1234,)], "task_id long")) == 2
    want = {i: (i, "open", None) for i in range(40)} | {None: (None, "null key", None), 3: (3, "done", "a"), 99: (99, "new", "b")}
    del want[5], want[7]
    assert rows(table.read()) == sorted(want.values(), key=str)
    assert table.read(0).count() == 41 and table.read(1).count() == 42 and table.latest() == 2
    with pytest.raises(ValueError, match="twice"):
        table.upsert(spark.createDataFrame([(1, "a", None), (1, "b", None)], TASK))
    with pytest.raises(Conflict):
        table.create(spark.createDataFrame([(1, "a", None)], TASK), ["task_id"])


def test_a_change_touches_its_buckets_only(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t").create(spark.createDataFrame([(i, "open", None) for i in range(100)], TASK), ["task_id"], buckets=8)
    before = table.state()["folders"]
    table.upsert(spark.createDataFrame([(3, "done", None)], TASK))
    after = table.state()["folders"]
    assert sum(after[b] != before[b] for b in before) == 1


def test_of_two_claims_at_once_one_wins(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t").create(spark.createDataFrame([(i, "open", None) for i in range(6)], TASK), ["task_id"], buckets=2)

    def claim(user):
        own = VersionedTable(spark, table.path)
        return own.upsert(spark.createDataFrame([(i, "claimed", user) for i in range(6)], TASK), when="old.status = 'open'")

    users = ["ann", "bob", "cy"]
    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(claim, users))
    # Each made a version of its own, and the first of them has all tasks: the others found none open.
    assert sorted(made) == [1, 2, 3]
    found = {r.claimed_by for r in table.read().collect()}
    assert len(found) == 1 and found == {r.claimed_by for r in table.read(1).collect()}


def test_a_lost_race_is_run_again_on_what_won(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t").create(spark.createDataFrame([(1, "0", None)], TASK), ["task_id"], buckets=1)
    key = spark.createDataFrame([(1,)], "task_id long")
    calls = []

    def count(old):
        calls.append(1)
        if len(calls) == 1:  # another writer comes between
            VersionedTable(spark, table.path).change(key, lambda r: r.withColumn("status", (F.col("status").cast("int") + 1).cast("string")))
        return old.withColumn("status", (F.col("status").cast("int") + 1).cast("string"))

    assert table.change(key, count) == 2 and len(calls) == 2
    assert table.read().first().status == "2"


def test_a_torn_write_is_not_seen(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t").create(spark.createDataFrame([(1, "open", None)], TASK), ["task_id"])
    with pytest.raises(Exception, match="torn"):
        table.change(spark.createDataFrame([(1,)], "task_id long"), lambda r: r.withColumn("status", F.raise_error(F.lit("torn")).cast("string")))
    assert rows(table.read()) == [(1, "open", None)] and table.latest() == 0
