"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A blob is a text addressed by its SHA-256. The ledger has a row for each scan of a blob: the
rule versions that were run and what they found. An update hashes every version of every path,
keeps one text per blob, takes away the (blob, rule version) pairs that the ledger has, scans the
rest and appends. Findings then join back to all paths of a blob, so a text that a third of all
paths hold is scanned once, and a new rule version scans each blob for that rule alone.

A row of the ledger is written with its findings in one append: after a crash either both are
there or neither, and the update can run again.

Defined cases: a null text is the empty text; a null id keeps its row; repeated rows each get the
findings; very long texts are scanned whole; columns other than the id and the text pass through, but for one named found, which is replaced.
Spans count code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.llm.common import scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and not overlapping; one is dropped if its
    ``group`` has fewer than ``least`` characters. Another version is another rule."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of the class that is too short for {n,} can't hold a longer one, so these two find what
# the open-ended pattern finds after short matches are dropped. "assign" is not of that kind.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hosted", r"(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9-]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Spans of a text that are put together one by one; longer lists are lists of such lists.
CHUNK = 128

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("rule", T.StringType())])
ENTRY = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("found", T.ArrayType(SPAN))])


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _bound(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once."""
    return F.transform(F.array(value), f)[0]


def _chunks(items: Column) -> Column:
    """``items`` in arrays of CHUNK: what is built element by element stays short, so long lists take linear time."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))


def _running(values: Column, step) -> Column:
    """0 and the running ``step`` of an array of longs: one element more than ``values``."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<SPAN> of the rule's matches. What lies between matches comes from split(), the
    matches from regexp_extract_all(); their lengths give the positions."""
    pattern = F.lit(rule.pattern)
    size = lambda c: F.transform(c, F.length)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.struct(size(F.split(text, rule.pattern, -1)).alias("gaps"), size(hits).alias("hits"), size(F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else F.array().cast("array<string>")).alias("cores"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        core = x["core"] if rule.group else x["hit"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.id).alias("rule"))
        out = F.when(core >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    def within(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(T.ArrayType(SPAN)).alias("out")), step, lambda acc: acc["out"])

    def located(p: Column) -> Column:
        each = F.arrays_zip(F.slice(p["gaps"], 1, F.size(p["hits"])).alias("gap"), p["hits"].alias("hit"), p["cores"].alias("core"))

        def joined(chunks: Column) -> Column:
            sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["hit"]))
            return F.flatten(F.zip_with(chunks, F.slice(_running(sums, lambda a, v: a + v), 1, F.size(chunks)), within))

        return _bound(_bound(each, _chunks), joined)

    return F.when(text.rlike(rule.pattern), _bound(parts, located)).otherwise(F.array().cast(T.ArrayType(SPAN)))


class Ledger:
    """The ledger at ``path``, a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        self.spark, self.path, self.rules = spark, path, rules

    def entries(self) -> DataFrame:
        """All rows so far. An empty append makes the folder on first use."""
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop_path):
            self.spark.createDataFrame([], ENTRY).write.mode("append").parquet(self.path)
        return self.spark.read.schema(ENTRY).parquet(self.path)

    def unseen(self, versions: DataFrame) -> DataFrame:
        """(blob, text, todo): one text per blob with the rule versions it has not been scanned for."""
        ids = F.array(*[F.lit(r.id) for r in self.rules])
        # Copies combine where they are read, so that of a text that many paths hold one row is moved.
        blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        done = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = F.when(F.col("done").isNull(), ids).otherwise(F.array_except(ids, "done"))
        return blobs.join(done, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)

    def update(self, versions: DataFrame) -> None:
        """Scan what ``versions`` (with a column text) adds and append it."""
        found = [F.when(F.array_contains("todo", r.id), spans(F.col("text"), r, k)).otherwise(F.array().cast(T.ArrayType(SPAN))) for k, r in enumerate(self.rules)]
        self.unseen(versions).select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("found")).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """(blob, found): the spans of the current rules, by start and then rule order, for blobs that have any."""
        current = [r.id for r in self.rules]
        one = self.entries().where(F.size("found") > 0).select("blob", F.explode("found").alias("s")).where(F.col("s.rule").isin(current)).distinct()
        return one.groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("found"))

    def join_back(self, paths: DataFrame) -> DataFrame:
        """``paths`` (with a column text) with ``found``, empty where nothing was."""
        found = self.findings().select(F.col("blob").alias("_m_blob"), F.col("found").alias("_m_found"))
        out = paths.drop("found").withColumn("_m_blob", blob_id(F.col("text"))).join(found, "_m_blob", "left").drop("_m_blob")
        return out.withColumn("found", F.coalesce("_m_found", F.array().cast(T.ArrayType(SPAN)))).drop("_m_found")


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Update a ledger (a new one in the shared folder where no path is given) with ``docs`` and join back."""
    spark = docs.sparkSession
    ledger = Ledger(spark, ledger_path or scratch_path(spark, "ledger"), rules)
    ledger.update(docs.select("text"))
    return ledger.join_back(docs)


def digest(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the spans of ``rules``, comma-joined."""
    kept = F.filter(found, lambda s: s["rule"].isin([r.id for r in rules]))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.substring_index(s["rule"], "@", 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, rule: Rule) -> Column:
    return F.size(F.filter(found, lambda s: s["rule"] == rule.id)).cast("long")


def redact(text: Column, found: Column) -> Column:
    """``text`` with each span (overlapping ones merged) replaced by [secret]. ``found`` is sorted by start."""
    cut = lambda t, a, n: F.substring(t, (a + 1).cast("int"), n.cast("int"))

    def within(chunk: Column, region: Column) -> Column:
        """What stays of a chunk's part of the text, and the marks."""

        def step(acc: Column, s: Column) -> Column:
            kept = F.concat(acc["out"], F.array(cut(region["text"], acc["at"] - region["from"], s["start"] - acc["at"]), F.lit("[secret]")))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(region["from"].alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.array_join(acc["out"], ""))

    def joined(p: Column) -> Column:
        def over(q: Column) -> Column:
            ends, chunks = q["ends"], q["chunks"]
            regions = F.zip_with(F.slice(ends, 1, F.size(chunks)), F.slice(ends, 2, F.size(chunks)), lambda a, b: F.struct(a.alias("from"), cut(p["text"], a, b - a).alias("text")))
            return F.concat(F.array_join(F.zip_with(chunks, regions, within), ""), cut(p["text"], F.element_at(ends, -1), F.length(p["text"]) - F.element_at(ends, -1)))

        ends = lambda chunks: _running(F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"]))), F.greatest)
        return _bound(_bound(_chunks(p["found"]), lambda chunks: F.struct(chunks.alias("chunks"), ends(chunks).alias("ends"))), over)

    return _bound(F.struct(F.coalesce(text, F.lit("")).alias("text"), found.alias("found")), joined)
