"""Line dedup by content-defined line chunks.

The lines with words of a text are cut into chunks. A chunk ends after a line where a rolling hash over the last ``window`` line
hashes says so, and a line of ``anchor_words`` words or more is a chunk by itself, and so ends the one before: boundaries depend on
content alone, and with a window of one line (the default) on the line itself, so that what is inserted or removed
elsewhere leaves them where they are, up to a passage's first and last line.

Of all chunks in the corpus with the same bytes the first (smallest id, then position) stays. Each other one is compared with it
as bytes, and then grows: line by line to both sides, as long as the lines there equal those beside the chunk that stays, up to the ends of the
chunks beside (a chunk beside that is equal as a whole is a repeated one itself). What has grown to ``least_lines`` lines, or has
``least_words`` words, goes; a single short line that stands elsewhere stays. So all that goes begins at a chunk, and
for each line that goes an equal one stands at a smaller place: the first place of a line is never taken out.

A passage that repeats as a whole goes where a chunk lies within it. That is sure where one of its lines has ``anchor_words`` words, so
for up to four lines of more than 50 words in all; p shorter lines are left where no chunk begins and ends among them, which has the
probability (p + 2) / 2^(p + 1) at the default divisor.

Hashes only choose what is compared. Numbers of all chunks are shuffled, bytes only of those that can go and of those they are compared with: a
bit field of bounded size says to a second scan of the texts which these are, and the joins after it decide. Blank lines are in no chunk: those between
two lines that go go with them.

Defined cases: null and empty texts have no chunks and stay as they are; a text without a removed
chunk stays the same to the byte; a text all of whose lines with words go is empty; rows that repeat both id
and text are one document and get the same result; a null id is an id, before all others; further
columns are kept, but for those named like the three new ones, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bit_filter, bounded_batches, hash_lines, materialise, mix64, passes, release, slices

_U = np.uint64
#: How many values a chunk's hash has; tests make them few.
CHUNK_HASHES = 2**63


def chunk_starts(hashes: np.ndarray, words: np.ndarray, window: int, divisor: int, anchor_words: int) -> np.ndarray:
    """Index of the first line of each chunk, for lines with words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    rolled = np.zeros(n, dtype=_U)
    for i in range(min(window, n)):
        rolled[i:] += mix64(hashes[: n - i] * _U(2 * i + 3))
    anchor = words >= anchor_words
    ends = (mix64(rolled) % _U(divisor) == 0) | anchor
    ends[:-1] |= anchor[1:]
    return np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])


def _cut(texts: list[bytes | None], parameters: dict) -> list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text all its lines, then of those with words: their numbers, hashes, words and the first of each chunk."""
    split = [t.split(b"\n") if t else [] for t in texts]
    counts = [np.array([len(line.split()) for line in lines], dtype=np.int64) for lines in split]
    full = [np.flatnonzero(c) for c in counts]
    hashes = hash_lines([lines[i] for lines, at in zip(split, full, strict=True) for i in at.tolist()])
    out, at = [], 0
    for lines, c, f in zip(split, counts, full, strict=True):
        own = hashes[at : at + len(f)]
        at += len(f)
        out.append((lines, f, own, c[f], chunk_starts(own, c[f], **parameters)))
    return out


def _chunks(own: np.ndarray, starts: np.ndarray, values: int) -> list[tuple[int, int, int, int]]:
    """First line, end line (among lines with words) and two hashes of each chunk."""
    if not len(starts):
        return []
    ends = [*starts[1:].tolist(), len(own)]
    place = (np.arange(len(own)) - np.repeat(starts, np.diff([*starts, len(own)]))).astype(_U)
    hashes = [(np.add.reduceat(mix64(own * _U(odd) + place * _U(0x9E3779B97F4A7C15)), starts) % _U(values)).view(np.int64).tolist() for odd in (1, 0xD6E8FEB86659FD93)]
    return list(zip(starts.tolist(), ends, *hashes, strict=True))


def _place_keys(doc_id: int | None, row_hash: int, begins: np.ndarray) -> np.ndarray:
    """A number for each place of a document, the same in every scan."""
    seed = (0 if doc_id is None else (doc_id * 2 + 1) * 0x9E3779B97F4A7C15 + row_hash) & (2**64 - 1)
    return mix64(mix64(begins.astype(_U) + _U(1)) + _U(seed)) & _U(2**63 - 1)


#: Added to a place's number where the chunk before or after it is wanted as well.
BEFORE, AFTER = 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D
HEADS = "doc_id long, row_hash long, begin int, end int, chunk_hash long, chunk_check long, words int, line_before long, line_after long, key long"


def _heads(docs: DataFrame, parameters: dict) -> DataFrame:
    """The chunks of docs (doc_id, row_hash, text), with the hashes of the lines beside them (null at a text's ends)."""
    values = CHUNK_HASHES

    def run(batches):
        for batch in slices(batches):
            texts = [t.encode("utf-8", "replace") if t else None for t in batch.column(2).to_pylist()]
            rows = []
            for k, (doc_id, row_hash, (_, _, own, words, starts)) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _cut(texts, parameters), strict=True)):
                lines, sums = own.view(np.int64).tolist(), np.concatenate([[0], np.cumsum(words)]).tolist()
                keys = _place_keys(doc_id, row_hash, starts).view(np.int64).tolist()
                rows += [(k, a, b, h, c, sums[b] - sums[a], lines[a - 1] if a else None, lines[b] if b < len(lines) else None, key) for (a, b, h, c), key in zip(_chunks(own, starts, values), keys, strict=True)]
            at = pa.array([r[0] for r in rows], pa.int32())
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=[x.split()[0] for x in HEADS.split(", ")])

    return docs.mapInArrow(run, HEADS)


KEY = ["chunk_hash", "chunk_check"]
BODIES = "before binary, body binary, after binary"


def _bodies(docs: DataFrame, wanted: np.ndarray, parameters: dict) -> DataFrame:
    """The bytes of the chunks of docs (doc_id, row_hash, text) whose places the filter ``wanted`` lets pass, and of the chunks beside them where it
    lets these pass. Texts stay where they are read."""
    sent, values = docs.sparkSession.sparkContext.broadcast(wanted), CHUNK_HASHES

    def run(batches):
        for batch in slices(batches):
            texts = [t.encode("utf-8", "replace") if t else None for t in batch.column(2).to_pylist()]
            rows = []
            for k, (doc_id, row_hash, (lines, full, own, _, starts)) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _cut(texts, parameters), strict=True)):
                if not len(starts):
                    continue
                keys = _place_keys(doc_id, row_hash, starts)
                some = np.flatnonzero(passes(sent.value, keys))
                if not len(some):
                    continue
                chunks, edges = _chunks(own, starts, values), [*starts.tolist(), len(own)]
                sides = [passes(sent.value, keys ^ _U(x)) for x in (BEFORE, AFTER)]
                joined = lambda a, b, lines=lines, full=full: b"\n".join(lines[i] for i in full[a:b].tolist())
                for i in some.tolist():
                    before = joined(edges[i - 1], edges[i]) if i and sides[0][i] else None
                    after = joined(edges[i + 1], edges[i + 2]) if i + 2 < len(edges) and sides[1][i] else None
                    rows.append((k, *chunks[i], before, joined(edges[i], edges[i + 1]), after))
            at = pa.array([r[0] for r in rows], pa.int32())
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names=["doc_id", "row_hash", "begin", "end", *KEY, "before", "body", "after"])

    return docs.mapInArrow(run, f"doc_id long, row_hash long, begin int, end int, chunk_hash long, chunk_check long, {BODIES}")


def grown(before: bytes | None, body: bytes, after: bytes | None, kept_before: bytes | None, kept_after: bytes | None) -> tuple[int, int, list[bytes]]:
    """Lines by which a chunk grows to the left and to the right, and all its lines then."""
    left, right = ([], []) if before is None or kept_before is None else (before.split(b"\n"), kept_before.split(b"\n"))
    m = 0
    while m < min(len(left), len(right)) and left[-1 - m] == right[-1 - m]:
        m += 1
    more, other = ([], []) if after is None or kept_after is None else (after.split(b"\n"), kept_after.split(b"\n"))
    n = 0
    while n < min(len(more), len(other)) and more[n] == other[n]:
        n += 1
    return m, n, [*left[len(left) - m :], *body.split(b"\n"), *more[:n]]


PAIRED = ["doc_id", "row_hash", "begin", "end", "before", "body", "after", "kept_before", "kept_body", "kept_after"]


def _compared(pairs: DataFrame, least_lines: int, least_words: int) -> DataFrame:
    """pairs (PAIRED) -> doc_id, row_hash, begin, end of what goes: chunks with the bytes of the one that stays, grown, where that is enough."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for k, (begin, end, before, body, after, kept_before, kept, kept_after) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 10)), strict=True)):
                if body == kept:
                    m, n, own = grown(before, body, after, kept_before, kept_after)
                    if len(own) >= least_lines or sum(len(x.split()) for x in own) >= least_words:
                        rows.append((k, begin - m, end + n))
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2)]], names=["doc_id", "row_hash", "begin", "end"])

    return pairs.select(*PAIRED).mapInArrow(run, "doc_id long, row_hash long, begin int, end int")


def _with_lists(docs: DataFrame, units: DataFrame, columns: list[str], name: str, how: str) -> DataFrame:
    """docs (doc_id, _m_hash, ...) with the ``columns`` of their units as the array ``name``."""
    lists = units.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct(*columns)).alias(name)).select(F.col("doc_id").alias("_m_id"), F.col("row_hash").alias("_m_row"), name)
    return docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_m_id")) & F.col("_m_hash").eqNullSafe(F.col("_m_row")), how).drop("_m_id", "_m_row")


def _without(docs: DataFrame, parameters: dict) -> DataFrame:
    """docs (doc_id, text, _m_gone: array of begin and end among lines with words, ...) with these and what is between them taken out."""

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts, gone = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("_m_gone")).to_pylist()
            some = [k for k, g in enumerate(gone) if g]
            chunks_gone, lines_gone, words_gone = ([0] * len(texts) for _ in range(3))
            encoded = [(texts[k] or "").encode("utf-8", "replace") for k in some]
            for k, (lines, full, _, words, starts) in zip(some, _cut(encoded, parameters), strict=True):
                drop = sorted({i for g in gone[k] for i in range(g["begin"], g["end"])})
                out = {i for g in gone[k] for i in range(int(full[g["begin"]]), int(full[g["end"] - 1]) + 1)}
                chunks_gone[k] = len(set(np.searchsorted(starts, drop, side="right").tolist()))
                lines_gone[k], words_gone[k] = len(out), int(words[drop].sum())
                left = b"\n".join(line for i, line in enumerate(lines) if i not in out)
                texts[k] = left.decode("utf-8") if left.strip() else ""
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chunks_gone, pa.int32()), pa.array(lines_gone, pa.int32()), pa.array(words_gone, pa.int64())], names=[*batch.schema.names, "chunks_removed", "lines_removed", "words_removed"])

    ddl = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return docs.mapInArrow(run, ddl + ", chunks_removed int, lines_removed int, words_removed long")


def dedup(docs: DataFrame, window: int = 1, divisor: int = 2, anchor_words: int = 13, least_lines: int = 2, least_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, ...) with what repeats removed from ``text``, and the new columns
    chunks_removed (those that lost lines), lines_removed and words_removed. Lowers the session's Arrow batch size (see ``bounded_batches``)."""
    bounded_batches(docs.sparkSession)
    parameters = {"window": window, "divisor": divisor, "anchor_words": anchor_words}
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long")).drop("chunks_removed", "lines_removed", "words_removed").withColumn("_m_hash", F.xxhash64("text"))
    narrow = keyed.select("doc_id", "_m_hash", "text")

    heads = materialise(_heads(narrow, parameters), "chunks")
    place = F.struct("doc_id", "row_hash", "begin")
    beside = F.struct("line_before", "line_after", "key")
    # Tables of their own: a chunk that very many documents have can then be split over tasks in the joins.
    repeated = heads.groupBy(*KEY).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min_by(beside, place).alias("at")).where("first <> last").select(*KEY, "first", "at")
    repeated = materialise(repeated, "repeated")
    # What can go: with its first place before it, and large enough or with an equal line beside it to grow to.
    same = [F.coalesce(F.col(c) == F.col(f"at.{c}"), F.lit(False)) for c in ("line_before", "line_after")]
    able = (F.col("end") - F.col("begin") >= least_lines) | (F.col("words") >= least_words) | same[0] | same[1]
    places = heads.join(repeated, KEY).where(~place.eqNullSafe(F.col("first")) & able).select(*KEY, "first", "key", F.col("at.key").alias("first_key"), same[0].alias("grows_before"), same[1].alias("grows_after"))
    places = materialise(places, "places")
    release(heads)
    release(repeated)
    kept = places.groupBy(*KEY).agg(F.first("first").alias("first"), F.first("first_key").alias("key"), F.bool_or("grows_before").alias("grows_before"), F.bool_or("grows_after").alias("grows_after"))
    kept = materialise(kept, "kept")
    asked = F.array_compact(F.array("key", F.when(F.col("grows_before"), F.col("key").bitwiseXOR(F.lit(BEFORE))), F.when(F.col("grows_after"), F.col("key").bitwiseXOR(F.lit(AFTER)))))
    wanted = bit_filter(places.select(F.explode(asked).alias("a")).unionByName(kept.select(F.explode(asked).alias("a"))))
    release(places)
    bodies = materialise(_bodies(narrow, wanted, parameters), "bodies")

    stay = bodies.join(kept.select(*KEY, "first"), KEY).where(place.eqNullSafe(F.col("first"))).dropDuplicates(KEY)
    stay = stay.select(*KEY, "first", F.col("before").alias("kept_before"), F.col("body").alias("kept_body"), F.col("after").alias("kept_after"))
    stay = materialise(stay, "stay")
    gone = materialise(_compared(bodies.join(stay, KEY).where(~place.eqNullSafe(F.col("first"))), least_lines, least_words), "gone")
    for table in (bodies, kept, stay):
        release(table)
    joined = _with_lists(keyed, gone, ["begin", "end"], "_m_gone", "left").drop("_m_hash")
    return _without(joined, parameters).drop("_m_gone")
