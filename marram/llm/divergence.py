"""How far the words of each source are from those of the other sources of its language.

Terms are runs of ASCII letters (A-Z lowered) and non-ASCII characters. Rows of (lang, source, term) with
counts are made where the texts are read, then dealt by a hash of (lang, term) into shards. In a shard DuckDB
runs vectorised SQL over in-memory tables: first it sums counts and keeps the terms of a language that enough
of its documents hold; in a second pass, when Spark has summed the sizes of all groups, it gives each shard's
part of every pair's divergence and the shard's best terms of each group. Spark adds the parts up and ranks.

A group's share of a term is p = 1 + floor(1e9 * (count + 2) / (N + 2 V)), with N the group's occurrences of kept terms
and V the language's number of kept terms; the divergence of p and q is floor((p - q)^2 / (p + q)). All is integers. For a
pair of sources a shard only goes through the terms that one of them has, which it counts: what neither has is the same
value for every such term, and is added once, times their number.

What a task holds: while it reads, about ``HELD`` distinct (group, term) counts; in a shard, its rows,
of which a (lang, term) has one per source after the first sum (and one per reading task before it), so that a
word of a third of all tokens is a few rows. The groups' sizes go to the shards in portions of at most ``GROUPS`` rows.

Defined cases: null text, lang and source are ''; every (lang, source) that occurs is a group, with texts or
without; rows that repeat are documents of their own; a language without kept terms has pairs of value 0 and no
terms; a language of one source has no pairs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.ranking import top_k
from marram.llm.common import bounded_batches, materialise, slices

#: Distinct (group, term) counts that a reading task holds before it hands them on.
HELD = 400_000
#: Groups whose sizes are sent to the shards at once.
GROUPS = 50_000

_WORDS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split()


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) of what a task read."""

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows():
            for (lang, source), (all_, docs) in held.items():
                n = len(all_)
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(n, dtype=np.int32))) for x in (lang, source)]
                numbers = [pa.array(np.fromiter(x, dtype=np.int64, count=n)) for x in (all_.values(), map(docs.__getitem__, all_))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(all_), pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in slices(batches):
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = terms(text)
                if words:
                    all_, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    all_.update(words)
                    docs.update(set(words))
            if sum(len(all_) for all_, _ in held.values()) > HELD:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


#: The counts of a shard: one row per (lang, source, term) of kept terms, with the language's count; ``head`` marks one row per term.
COUNT_SQL = """
WITH g AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM shard GROUP BY ALL),
k AS (SELECT *, sum(docs) OVER t AS lang_docs, (sum(n) OVER t)::BIGINT AS lang_n, source = min(source) OVER t AS head FROM g WINDOW t AS (PARTITION BY lang, term))
SELECT lang, source, term, n, lang_n, head FROM k WHERE lang_docs >= {least}
"""
_P = "(1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {v}))::BIGINT"
_F = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
#: Each row with its group's and its language's share.
SHARES_SQL = f"""
CREATE TEMP TABLE shares AS SELECT s.lang, s.source, s.term, {_P.format(n="s.n", total="g.total", v="g.v")} AS p, {_P.format(n="s.lang_n", total="g.lang_total", v="g.v")} AS q
FROM shard s JOIN owners g ON s.lang = g.lang AND s.source = g.source
"""
#: Parts of pairs a < b by terms that at least one of them has in this shard: the other's share is that of a count of 0 where it lacks the term.
PAIRS_SQL = f"""
WITH r AS (SELECT s.lang, s.term, s.source, g.source AS other, s.p AS p, coalesce(o.p, g.p0) AS q FROM shares s JOIN others g ON s.lang = g.lang AND s.source <> g.source
  LEFT JOIN shares o ON o.lang = s.lang AND o.term = s.term AND o.source = g.source WHERE o.p IS NULL OR s.source < g.source)
SELECT lang, least(source, other) AS a, greatest(source, other) AS b, sum({_F.format(p="p", q="q")})::BIGINT AS value, count(*)::BIGINT AS n FROM r GROUP BY ALL
"""
TERMS_SQL = f"""
SELECT lang, source, term AS item, {_F.format(p="p", q="q")} AS value FROM shares WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {{top}}
"""


def _database():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


def _tables(con, sql: str, schema: pa.Schema):
    """The rows of ``sql`` as batches of ``schema``."""
    return con.sql(sql).to_arrow_table().select(schema.names).cast(schema).to_batches(max_chunksize=65536)


def _shard_counts(counted: DataFrame, least: int) -> DataFrame:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64()), ("head", pa.bool_())])

    def run(batches):
        con = _database()
        con.execute("CREATE TEMP TABLE shard (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            part = pa.Table.from_batches([batch])  # noqa: F841
            con.execute("INSERT INTO shard SELECT lang, source, term, n, docs FROM part")
        yield from _tables(con, COUNT_SQL.format(least=least), schema)
        con.close()

    return counted.repartition("lang", "term").mapInArrow(run, "lang string, source string, term string, n long, lang_n long, head boolean")


def _shard_parts(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """part, lang, a, b, value, n: parts of pairs (``pair``: a, b are sources) and best terms (``term``: of source a, b is the term)."""
    spark = kept.sparkSession
    owned = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", "total", "lang_total", "v").repartition("lang", "term")
    n = groups.count()
    portions = max(1, -(-n // GROUPS))
    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64()), ("n", pa.int64())])
    out = None
    for portion in range(portions):
        # Part of the groups, as the other side of the pairs; a pair's part is counted from the portion that holds the other side.
        sent = groups.where(F.pmod(F.xxhash64("lang", "source"), F.lit(portions)) == portion).select("lang", "source", "total", "v").toArrow()
        others = spark.sparkContext.broadcast(sent)

        def run(batches, others=others, first=portion == 0):
            con = _database()
            con.execute("CREATE TEMP TABLE shard (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, lang_n BIGINT)")
            con.execute("CREATE TEMP TABLE owned (lang VARCHAR, source VARCHAR, total BIGINT, lang_total BIGINT, v BIGINT)")
            for batch in batches:
                part = pa.Table.from_batches([batch])  # noqa: F841
                con.execute("INSERT INTO shard SELECT lang, source, term, n, lang_n FROM part")
                con.execute("INSERT INTO owned SELECT DISTINCT lang, source, total, lang_total, v FROM part")
            con.execute("CREATE TEMP TABLE owners AS SELECT DISTINCT * FROM owned")
            sizes = others.value  # noqa: F841
            con.execute(f"CREATE TEMP TABLE others AS SELECT lang, source, {_P.format(n='0', total='total', v='v')} AS p0 FROM sizes WHERE v > 0")
            con.execute(SHARES_SQL)

            def named(sql, kind):
                for b in _tables(con, sql, schema):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * b.num_rows, pa.string()), *b.columns], names=["part", *schema.names])

            yield from named(PAIRS_SQL, "pair")
            if first:
                yield from named(f"SELECT lang, source AS a, item AS b, value, 1 AS n FROM ({TERMS_SQL.format(top=top)})", "term")
            con.close()

        found = owned.mapInArrow(run, "part string, lang string, a string, b string, value long, n long")
        out = found if out is None else out.unionByName(found)
    return out


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank for ``docs`` (text, lang, source).

    Part ``pair``: each other source of the language with the divergence of the two over all kept terms, all
    ranks. Part ``term``: the ``top`` terms that the source has and holds oftener than its language, by divergence from the language.
    A term is kept where at least ``least`` documents of its language hold it. There are as many shards as the session has
    shuffle partitions; adaptive execution puts small ones together.
    """
    bounded_batches(docs.sparkSession)
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    kept = materialise(_shard_counts(_counted(named), least), "kept-terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("v"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["total", "v"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("lang_v"))
    groups = materialise(groups.drop("v").join(langs, "lang").select("lang", "source", "total", "lang_total", F.col("lang_v").alias("v")), "groups")

    parts = materialise(_shard_parts(kept, groups, top), "divergence-parts")
    p0 = F.expr("case when v > 0 then 1 + 2000000000L div (total + 2 * v) end")
    sides = groups.select("lang", "source", "v", p0.alias("p0"))
    a, b = sides.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa"), "v"), sides.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb"))
    summed = parts.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    order = [F.desc("value"), F.col("item")]
    # All pairs of sources of a language: they are the result.
    pairs = a.join(b, "lang").where("a < b").join(summed, ["lang", "a", "b"], "left").na.fill(0, ["value", "n"])
    neither = F.expr("coalesce((v - n) * (((pa - pb) * (pa - pb)) div (pa + pb)), 0L)")
    pairs = pairs.select("lang", "a", "b", (F.col("value") + neither).alias("value"))
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    best = parts.where("part = 'term'").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    # Each shard gave its best; of these the best of each 64th of the terms are found before those of a group meet.
    best = top_k(best.withColumn("lot", F.pmod(F.xxhash64("item"), F.lit(64))), top, order, ["lang", "source", "lot"]).drop("lot", "rank")
    ranks = top_k(best.withColumn("part", F.lit("term")), top, order, ["lang", "source"]).unionByName(
        both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).withColumn("part", F.lit("pair"))
    )
    return ranks.select("lang", "source", "part", "item", "value", "rank")


def oracle(least: int = 10, top: int = 10) -> str:
    """The query's rows by plain SQL over all groups and kept terms."""
    p = _P
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= {least}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM k GROUP BY 1),
g AS (SELECT lang, source, coalesce(total, 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) USING (lang, source)),
s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {p.format(n="coalesce(n, 0)", total="total", v="v")} AS p, {p.format(n="lang_n", total="lang_total", v="v")} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS xs, y.source AS ys, sum({_F.format(p="x.p", q="y.p")}) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z ON z.lang = a.lang AND xs = a.source AND ys = b.source),
best AS (SELECT lang, source, term AS item, {_F.format(p="p", q="q")} AS value FROM s WHERE n > 0 AND p > q),
every AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term', * FROM best),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {top}
"""
