"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits (A-Z lowered) and of non-ASCII characters. A benchmark item is
known by its windows of ``window`` consecutive words; one with fewer words is a single window. Of a text's k-grams
of words winnowing keeps, in each run of ``window - k + 1`` neighbours, the one of the smallest hash (the last of
equal ones). A span of ``window`` words that a document and an item share is such a run on both sides, so both keep the same
k-gram of it: no shared span of that length is missed.

Fingerprints of documents meet those of items first in a filter: a bit field of checked size that Spark makes from all
items' fingerprints, so that nothing of a document leaves its task that no item can have. What passes is extended to
the windows around it, which meet the items' windows in a second such filter, and those that pass meet them in an equi
join on 128 bits of hash. The filters only save work; the join decides. Items under ``window`` words have no full
run; their one window of m words is looked for among all runs of m words, by filter and join likewise.

Windows of the same set of items are one class, so that a passage that many items share is not multiplied with the documents that
hold it: documents meet classes, and the items of a class come in at the end.

Defined cases: null and empty texts have no words and no hits; an item without words has no window; rows of
documents that repeat are reported each; items that repeat an id are one item in the counts; an item without an id
marks words but is in no list; empty tables give no rows, or documents without hits; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bit_filter, bounded_batches, hash_words, materialise, mix64, passes, slices

_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Item windows that go to all executors at once in the join (some 40 bytes each); more are shuffled.
BROADCAST_WINDOWS = 200_000
_SALTS = (1, 0x2545F4914F6CDD1D)


def runs(words: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    total = np.full(n, salt, dtype=_U)
    for i in range(k):
        total += mix64(words[i : i + n] + _U((_GOLD * (salt + 2 * i)) & (2**64 - 1)))
    return mix64(total)


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the kept hashes: of each ``width`` neighbours the smallest, the last of equal ones. Ascending; none
    where there are fewer than ``width``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for i in range(1, width):
        other = hashes[i : i + n]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + i
    return np.unique(at)


def texts_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after the other, and the number of words of each."""
    return hash_words([(t or "").encode("utf-8", "replace").translate(_WORDS) for t in texts])


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype()), kind) for parts, kind in columns.values()], names=list(columns))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """m, a, b, item_id for every window of an item; kind "print" rows carry its fingerprints in ``a``."""

    def run(batches):
        for batch in slices(batches):
            words, counts = texts_words(batch.column(1).to_pylist())
            rows: list[tuple] = []
            at = 0
            for item, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                own = words[at : at + n]
                at += n
                m = min(n, window)
                if not n:
                    continue
                for a, b in zip(_signed(runs(own, m, _SALTS[0])).tolist(), _signed(runs(own, m, _SALTS[1])).tolist(), strict=True):
                    rows.append((m, a, b, item, False))
                if n >= window:
                    grams = runs(own, k, 3)
                    rows += [(k, h, 0, item, True) for h in _signed(grams[winnow(grams, window - k + 1)]).tolist()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["m", "a", "b", "item_id", "print"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "m int, a long, b long, item_id long, print boolean").distinct()


def _candidates(docs: DataFrame, fields: dict, window: int, k: int, shorter: list[int]) -> DataFrame:
    """row, doc_id, n_words and the windows of a document that pass the filters, for each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(fields)

    def run(batches):
        for batch in slices(batches):
            words, counts = texts_words(batch.column(1).to_pylist())
            ends = np.cumsum(counts)
            found: list[tuple[np.ndarray, ...]] = []
            # Runs of the whole batch; those that cross a text's end are left out by their place.
            owner = np.repeat(np.arange(len(counts)), counts)

            def whole(at, m, owner=owner, total=len(words)):
                at = at[at + m <= total]
                return at[owner[at] == owner[at + m - 1]]

            def keep(at, m, words=words, owner=owner):
                if len(at):
                    cut = words[at[:, None] + np.arange(m)[None]]
                    a, b = (_rows(cut, salt) for salt in _SALTS)
                    ok = passes(sent.value[m], a)
                    found.append((owner[at[ok]], at[ok], np.full(ok.sum(), m, dtype=np.int32), _signed(a[ok]), _signed(b[ok])))

            if window in sent.value and len(words) >= window:
                grams = runs(words, k, 3)
                width = window - k + 1
                # Runs across a text's end get no place of their own, as the largest hash; a run of neighbours inside a text has none.
                inside = owner[: len(grams)] == owner[k - 1 :]
                at = winnow(grams, width) if len(counts) == 1 else _winnow_inside(grams, inside, width)
                at = at[passes(sent.value["print"], grams[at])]
                starts = np.unique((at[:, None] - np.arange(width)[None]).ravel())
                keep(whole(starts[starts >= 0], window), window)
            for m in shorter:
                if len(words) >= m:
                    at = whole(np.flatnonzero(passes(sent.value[m], runs(words, m, _SALTS[0]))), m)
                    keep(at, m)
            doc = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
            order = np.argsort(doc, kind="stable")
            at, m, a, b = (np.concatenate([f[i] for f in found])[order] if found else np.zeros(0, dtype=np.int64) for i in range(1, 5))
            at = at - (ends - counts)[doc[order]]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))])
            parts = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(m.astype(np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["at", "m", "a", "b"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)], names=["doc_id", "n_words", "windows"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "doc_id long, n_words long, windows array<struct<at:int,m:int,a:long,b:long>>").withColumn("row", F.monotonically_increasing_id())


def _rows(cut: np.ndarray, salt: int) -> np.ndarray:
    """The hash of runs() for each row of words."""
    total = np.full(len(cut), salt, dtype=_U)
    for i in range(cut.shape[1]):
        total += mix64(cut[:, i] + _U((_GOLD * (salt + 2 * i)) & (2**64 - 1)))
    return mix64(total)


def _winnow_inside(grams: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """winnow() of texts that lie one after the other: only of neighbours that are all inside a text."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    clean = gaps[width : width + n] == gaps[:n]
    best, at = grams[:n].copy(), np.arange(n)
    for i in range(1, width):
        other = grams[i : i + n]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + i
    return np.unique(at[clean])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids, ascending as strings) and spans (first word, end) for every row of ``docs`` (doc_id, text).

    A word is hit where it lies inside an occurrence of a window of ``items`` (item_id, text).
    """
    bounded_batches(docs.sparkSession)
    windows = materialise(_item_windows(items, window, k), "item-windows")
    real = windows.where("not print")
    lengths = [r.m for r in real.select("m").distinct().collect()]  # at most `window` numbers
    fields: dict = {m: bit_filter(real.where(F.col("m") == m).select("a").distinct()) for m in lengths}
    fields["print"] = bit_filter(windows.where("print").select("a").distinct())
    base = materialise(_candidates(docs, fields, window, k, sorted(m for m in lengths if m < window)), "candidates")

    # Windows by the set of items that have them; two sets are one where count, sum and parity of their ids' hashes are equal.
    ids = F.xxhash64(F.coalesce("item_id", F.lit(-1)), F.col("item_id").isNull())
    sums = F.count(F.lit(1)).alias("c"), F.sum(ids.cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"), F.bit_xor(ids).alias("x")
    key = ["m", "a", "b"]
    classed = materialise(real.groupBy(*key).agg(*sums).withColumn("class", F.xxhash64("c", "s", "x")), "classes")
    first = classed.groupBy("class").agg(F.min(F.struct(*key)).alias("w")).select("class", "w.*")
    members = real.join(first, key).where("item_id is not null").select("class", "item_id")

    small = classed.count() <= BROADCAST_WINDOWS
    known = classed.select(*key, "class")
    placed = base.where("size(windows) > 0").select("row", F.explode("windows").alias("w")).select("row", "w.*")
    hits = materialise(placed.join(F.broadcast(known) if small else known, key).select("row", "at", "m", "class"), "hits")

    # The union of a document's windows: longest by start, then runs by the furthest end so far.
    ends = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("m")).alias("to")))).alias("w"))
    spans = ends.mapInArrow(_unions, "row long, n_hit long, spans array<struct<at:int,to:int>>")
    listed = hits.select("row", "class").distinct().join(members, "class").select("row", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = base.select("row", "doc_id", "n_words").join(spans, "row", "left").join(listed, "row", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<at:int,to:int>>")).alias("spans"))


def _unions(batches):
    for batch in batches:
        counts, spans = [], []
        for windows in batch.column(1).to_pylist():
            own: list[list[int]] = []
            for w in windows:
                if own and w["at"] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], w["to"])
                else:
                    own.append([w["at"], w["to"]])
            counts.append(sum(b - a for a, b in own))
            spans.append([{"at": a, "to": b} for a, b in own])
        kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=["row", "n_hit", "spans"])


def clean(docs: DataFrame, items: DataFrame, mark: str = " ", window: int = 10, k: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the documents that hold a window; those of null ids stay where their text has none.
    Rows that repeat an id go together."""
    found = contamination(docs, items, window, k).where("n_hit > 0")
    return docs.join(found.select(F.col("doc_id").alias("_m_id")).distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_m_id")), "left_anti")


def oracle(window: int = 10) -> str:
    """The query's rows in SQL: windows of documents of every length that an item window has, joined as strings."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark), d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT *, least(len(w), {window}) AS m FROM i WHERE len(w) > 0))),
dw AS (SELECT r, m, s, array_to_string(w[s : s + m - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS s FROM d JOIN (SELECT DISTINCT m FROM iw) ON m <= len(w))),
h AS (SELECT r, m, s, item_id FROM dw JOIN iw USING (m, x)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM h) GROUP BY 1),
l AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)
"""
