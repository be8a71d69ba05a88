"""A keyed table with whole versions and optimistic changes (SRC12, SRC13, E7).

The table lies in buckets by a hash of its keys. A version is one file of the log: the folder of each bucket. A change reads the
buckets of the keys that it touches, writes new folders for these, and appends the next version, which only one of
several writers can do: the file takes its name in one step that fails where the name is taken (a hard link on a local disk, a
rename without overwriting elsewhere; a store without one of the two is not for this). Who loses does the change again on
the version that won, so that a condition in it is looked at anew. A reader takes the newest version, whose folders nobody writes to.

Defined cases: a null key is a key; rows of a change that repeat a key are refused; a table without rows has no folders; a change that
leaves all rows as they are still makes a version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer was first, as often as was tried."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, attempts: int = 10):
        self.spark, self.path, self.attempts = spark, path.rstrip("/"), attempts
        self._to_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._to_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ the log

    def _entry(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def latest(self) -> int:
        """The newest version's number; -1 before the first."""
        folder = self._to_path(f"{self.path}/log")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=-1)

    def state(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        return json.loads("\n".join(r.value for r in self.spark.read.text(self._entry(version)).collect()))

    def _append(self, version: int, state: dict) -> bool:
        """Whether this writer made the version."""
        beside = self._to_path(f"{self.path}/log/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                local = [jvm.java.io.File(jvm.java.net.URI(f"file://{self._to_path(p).toUri().getPath()}")).toPath() for p in (self._entry(version), beside.toString())]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(beside, self._to_path(self._entry(version)), none)
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        finally:
            self._fs.delete(beside, False)
        return True

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._rows(self.state(version))

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = sorted({f for b, f in state["folders"].items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], state["schema"])
        wanted = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(state["schema"]).parquet(*wanted)

    # ------------------------------------------------------------ changing

    @staticmethod
    def _bucket(state: dict):
        return F.pmod(F.xxhash64(*state["keys"]), F.lit(state["buckets"])).cast("int")

    def _write(self, rows: DataFrame, state: dict) -> dict[str, str]:
        """New folders for the buckets of ``rows``."""
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket(state)).write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        base = self._to_path(f"{self.path}/data/{name}")
        names = [s.getPath().getName() for s in self._fs.listStatus(base)] if self._fs.exists(base) else []
        return {n.split("=")[1]: f"{name}/{n}" for n in names if n.startswith("_bucket=")}

    def create(self, rows: DataFrame, keys: list[str], buckets: int = 16) -> VersionedTable:
        """The first version. ``buckets`` follows the table's size: a change rewrites those it touches whole."""
        state = {"keys": keys, "buckets": buckets, "schema": ", ".join(f"`{n}` {t}" for n, t in rows.dtypes), "folders": {}}
        self._fs.mkdirs(self._to_path(f"{self.path}/log"))
        state["folders"] = self._write(rows, state)
        if not self._append(0, state):
            raise Conflict(f"{self.path} is there already")
        return self

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """A new version in which the buckets of the keys ``touched`` hold what ``make`` gives for their rows; its number.

        ``make`` is called again with newer rows where another writer was first, so what it looks at holds in the version it makes. It may
        change, add and drop rows of the touched keys only."""
        for _ in range(self.attempts):
            before = self.latest()
            state = self.state(before)
            buckets = [r.b for r in touched.select(self._bucket(state).alias("b")).distinct().collect()]  # at most `buckets` numbers
            folders = {b: f for b, f in state["folders"].items() if int(b) not in buckets}
            folders |= self._write(make(self._rows(state, buckets)), state)
            if self._append(before + 1, state | {"folders": folders}):
                return before + 1
        raise Conflict(f"{self.path}: {self.attempts} attempts")

    def _once(self, changes: DataFrame) -> None:
        keys = self.state()["keys"]
        if changes.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError("a change has a key twice")

    def _match(self, keys: list[str], left: str, right: str):
        match = F.lit(True)
        for k in keys:
            match = match & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
        return match

    def upsert(self, changes: DataFrame, when: str | None = None) -> int:
        """Rows of ``changes`` in place of those with the same keys, new ones beside them. ``when`` is a condition on the old row (old.*) and the
        new one (new.*): where an old row doesn't meet it, it stays."""
        self._once(changes)

        def make(rows: DataFrame) -> DataFrame:
            keys = self.state()["keys"]
            allowed = changes.alias("new")
            if when:
                refused = rows.alias("old").join(changes.alias("new"), self._match(keys, "old", "new")).where(f"not coalesce({when}, false)").select(*[F.col(f"new.{k}").alias(k) for k in keys])
                allowed = changes.alias("new").join(refused.alias("no"), self._match(keys, "new", "no"), "left_anti")
            kept = rows.alias("old").join(allowed.alias("new"), self._match(keys, "old", "new"), "left_anti")
            return kept.select(*rows.columns).unionByName(allowed.select(*[F.col(c) for c in rows.columns]))

        return self.change(changes, make)

    def delete(self, doomed: DataFrame) -> int:
        """Without the rows of the keys in ``doomed``."""
        keys = self.state()["keys"]
        return self.change(doomed, lambda rows: rows.alias("old").join(doomed.alias("no"), self._match(keys, "old", "no"), "left_anti"))
