"""Token ids in fixed-width bit-packed shards.

Every id takes the fewest bits that hold the vocabulary. A shard is one byte string:

    magic "MBP1" | bits u32 | ids per block u32 | documents u32 | ids u64
    | block byte offsets u64 x (blocks + 1) | first id of each document u64 x documents | blocks

all little-endian, each block padded to a byte. Block k holds ids k*B to (k+1)*B - 1; the offsets
lead to any block, and id i starts at bit (i mod B) * bits of its block, so numpy unpacks a range
without reading the rest. Shards lie in a Parquet table (part, seq, doc ids, shard), in ascending
order of doc_id over (part, seq): any store that Spark writes to will do, parts of the table can be
read by themselves, and a lost task writes its part again. :func:`export` puts plain files beside.

Encoding is what the tokenizers library gives with add_special_tokens=False and nothing else set, so the
string of an added token in a text is that token's id (``ordinary``: it is ordinary text). A byte-level tokenizer whose pattern starts a new piece at a space before a non-space
never joins ids across such a space, so a text is cut there and each distinct unit goes through
the library once per worker while the (bounded) memory of units lasts. A text that holds the string
of an added token goes to the library whole.

Defined cases: null and empty texts have the end id alone; a null id sorts first; rows that repeat
an id are ordered by a hash of their text; long texts are whole, in one shard; columns other than the id and
the text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marram.llm.common import bounded_batches, slices

MAGIC = b"MBP1"
HEAD = struct.Struct("<4sIIIQ")
BLOCK_IDS = 4096
#: A shard is closed once it holds so many ids.
SHARD_IDS = 1 << 20
#: Units, and pieces of units, remembered by a worker; beyond that the memory starts anew.
MEMORY = 700_000
#: Texts encoded at once, whose units are looked up once each.
ROWS = 2048


# ---------------------------------------------------------------- bit packing


def bits_for(vocabulary: int) -> int:
    """Fewest bits for ids 0 to vocabulary - 1."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids, ``bits`` wide each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first``-th on."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", offset=first * bits // 8, count=count).astype(np.uint32)
    low, high = first * bits, (first + count) * bits
    raw = np.frombuffer(data, dtype=np.uint8, offset=low // 8, count=-(-high // 8) - low // 8)
    spread = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + count * bits].reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_shard(documents: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    sizes = np.array([len(d) for d in documents], dtype=np.uint64)
    ids = np.concatenate(documents) if documents else np.zeros(0, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack_bits(ids[at : at + block], bits) for at in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    firsts = (np.cumsum(sizes) - sizes).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, bits, block, len(documents), len(ids)), offsets.tobytes(), firsts.tobytes(), *blocks])


class Shard:
    """Random access to a shard's bytes (or a memory map of them)."""

    def __init__(self, data: bytes | memoryview) -> None:
        magic, self.bits, self.block, self.documents, self.ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.data = memoryview(data)
        blocks = -(-self.ids // self.block)
        self.offsets = np.frombuffer(data, dtype="<u8", offset=HEAD.size, count=blocks + 1)
        self.firsts = np.frombuffer(data, dtype="<u8", offset=HEAD.size + 8 * (blocks + 1), count=self.documents)
        self.body = HEAD.size + 8 * (blocks + 1 + self.documents)

    def read(self, first: int, count: int) -> np.ndarray:
        """ids ``first`` to ``first + count - 1``, from the blocks that hold them."""
        count = max(0, min(count, self.ids - first))
        parts = [np.zeros(0, dtype=np.uint32)]
        while count > 0:
            number, inside = divmod(first, self.block)
            n = min(count, self.block - inside)
            low, high = int(self.offsets[number]), int(self.offsets[number + 1])
            parts.append(unpack_bits(self.data[self.body + low : self.body + high], self.bits, inside, n))
            first, count = first + n, count - n
        return np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        first = int(self.firsts[k])
        last = int(self.firsts[k + 1]) if k + 1 < self.documents else self.ids
        return self.read(first, last - first)


# ---------------------------------------------------------------- encoding

_CUT = re.compile(r" (?=\S)")
_LOOSE = re.compile(r" (?:\s|$)")
# Fixed value: the pattern by which byte-level tokenizers of this family cut a text before merging.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words that go to the tokenizer as one text.
_TOGETHER = 256
#: What ends a word so often that it isn't looked for by the pattern.
_MARKS = frozenset(".,;:!?")


class Encoder:
    """ids of whole texts by the tokenizers library, as little-endian integers of ``kind``.

    New units are cut into pieces by the tokenizer's own pattern, which never merges across them; new
    words of letters go to the library many at a time, as one text, and each id that begins with a space
    begins a word.
    """

    def __init__(self, path: str, ordinary: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        #: Finds the strings that are tokens before the text is cut; None where there are none.
        self.added = re.compile("|".join(re.escape(t.content) for t in added), 0 if not any(t.normalized for t in added) else re.IGNORECASE) if added else None
        self.vocabulary: int = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        #: Whether an id's text begins with a space: letters after a space hold none but the first.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.vocabulary)])
        #: Units without their leading space; a piece that is a space and letters is the unit of those letters.
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        #: Whether the pattern is the tokenizer's; another kind of tokenizer gets whole units.
        before = self.tokenizer.pre_tokenizer
        probe = " It's 12 odd,  words...\n\n x"
        self.cuts = before is not None and [probe[a:b] for _, (a, b) in before.pre_tokenize_str(probe)] == _PIECES.findall(probe)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.kind).tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Units of letters only, many at a time."""
        size = np.dtype(self.kind).itemsize
        groups = [words[at : at + _TOGETHER] for at in range(0, len(words), _TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        for group, got in zip(groups, encoded, strict=True):
            ids = np.array(got.ids, dtype=self.kind)
            starts = np.flatnonzero(self.opens[ids]) * size
            if len(starts) == len(group):
                data, cuts = ids.tobytes(), [*starts.tolist(), len(ids) * size]
                self.units.update(zip(group, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:
                self._learn_each(self.units, group, " ")

    def _learn_each(self, known: dict[str, bytes], new: list[str], lead: str) -> None:
        for p, got in zip(new, self.tokenizer.encode_batch_fast([lead + p for p in new], add_special_tokens=False), strict=True):
            known[p] = self._bytes(got.ids)

    def _learn(self, new: set[str]) -> None:
        """Units that are not known yet."""
        if not self.cuts:
            self._learn_each(self.units, list(new), " ")
            return
        units, pieces = self.units, self.pieces
        words, ended, composed = [], [], []
        for u in new:
            if u.isalpha():
                words.append(u)
            elif u[-1:] in _MARKS and u[:-1].isalpha():
                ended.append(u)
            else:
                first, *rest = _PIECES.findall(f" {u}")
                composed.append((u, first[1:], rest) if first[1:].isalpha() else (u, "", [first, *rest]))
        firsts = [u[:-1] for u in ended]
        marks = {p for _, _, rest in composed for p in rest} | {u[-1] for u in ended}
        words += {w for w in [*firsts, *(first for _, first, _ in composed)] if w and w not in units and w not in new}
        self._learn_words(words)
        marks.difference_update(pieces)
        if marks:
            self._learn_each(pieces, list(marks), "")
        units.update(zip(ended, [units[w] + pieces[u[-1]] for w, u in zip(firsts, ended, strict=True)], strict=True))
        for u, first, rest in composed:
            units[u] = b"".join([units[first] if first else b"", *map(pieces.__getitem__, rest)])

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [k for k, text in enumerate(texts) if self.added.search(text)] if self.added else []
        if whole:
            apart = dict(zip(whole, self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True))
            others = iter(self._encode([text for k, text in enumerate(texts) if k not in apart]))
            return [self._bytes(apart[k].ids) if k in apart else next(others) for k in range(len(texts))]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # Texts that are cut at every space first; then those that aren't.
        loose = np.array([_LOOSE.search(text) is not None for text in texts])
        order = np.argsort(loose, kind="stable")
        plain = pc.split_pattern(pa.array([texts[k] for k in order[: len(texts) - loose.sum()]], pa.string()), " ")
        others = [_CUT.split(texts[k]) for k in order[len(plain) :]]
        counts = np.concatenate([pc.list_value_length(plain).to_numpy(zero_copy_only=False), np.array([len(units) for units in others], dtype=np.int64)])
        each = pa.concat_arrays([plain.flatten(), pa.array([u for units in others for u in units], pa.string())]).dictionary_encode()
        # Each unit of these texts once; the first of a text has no space before it, and is a unit by itself.
        units, code = each.dictionary.to_numpy(zero_copy_only=False).tolist(), each.indices.to_numpy().astype(np.int64)
        first = np.cumsum(counts) - counts
        heads = [units[c] for c in code[first]]
        code[first] = len(units) + np.arange(len(texts))
        inside = np.zeros(len(units) + len(texts), dtype=bool)
        inside[code] = True

        if len(self.units) > MEMORY:
            self.units.clear()
        if len(self.pieces) > MEMORY:
            self.pieces.clear()
        got = [self.units.get(u) if use else b"" for u, use in zip(units, inside.tolist(), strict=False)]
        new = [i for i, ids in enumerate(got) if ids is None]
        if new:
            self._learn({units[i] for i in new})
            for i in new:
                got[i] = self.units[units[i]]
        got += [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)]

        # The ids of all units side by side, from which those of the texts are taken.
        ids = np.frombuffer(b"".join(got), dtype=self.kind)
        sizes = np.array(list(map(len, got)), dtype=np.int64) // ids.itemsize
        at, n = (np.cumsum(sizes) - sizes)[code], sizes[code]
        ends = np.cumsum(n)
        taken = ids[np.repeat(at - ends + n, n) + np.arange(ends[-1])]
        lasts = ends[first + counts - 1].tolist()
        out: list[bytes] = [b""] * len(texts)
        for k, begin, end in zip(order.tolist(), [0, *lasts], lasts, strict=False):
            out[k] = taken[begin:end].tobytes()
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = Encoder(path, ordinary)
    return _encoders[path, ordinary]


def lengths(docs: DataFrame, tokenizer: str, ordinary: bool = False) -> DataFrame:
    """doc_id and n_tokens, with the end id, of each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in slices(batches, ROWS):
            known = encoder(tokenizer, ordinary)
            size = np.dtype(known.kind).itemsize
            counts = [len(ids) // size + 1 for ids in known.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(run, "doc_id long, n_tokens long")


# ---------------------------------------------------------------- the table of shards

SHARDS = "part int, seq int, n_ids long, doc_ids array<long>, shard binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, ordinary: bool = False) -> None:
    """Encode ``docs`` (doc_id, text), end each document with ``end_id`` and write shards to ``path``."""
    bounded_batches(docs.sparkSession)
    known = encoder(tokenizer, ordinary)
    bits, kind = bits_for(known.vocabulary), known.kind
    end = np.array([end_id], dtype=kind).tobytes()
    # Ranges by id, then by a hash of the text and the row, so that an id of very many rows is split; rows that are equal in all may lie in any order.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text")).withColumn("_r", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "_h", "_r").sortWithinPartitions("doc_id", "_h", "text").drop("_h", "_r")

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        documents: list[np.ndarray] = []
        total = 0

        def shard() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([write_shard(documents, bits)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_ids", "doc_ids", "shard"])

        for batch in slices(batches, ROWS):
            encoded = encoder(tokenizer, ordinary).encode(batch.column(1).to_pylist())
            for doc_id, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids.append(doc_id)
                documents.append(np.frombuffer(data + end, dtype=kind))
                total += len(documents[-1])
                if total >= SHARD_IDS:
                    yield shard()
                    seq, ids, documents, total = seq + 1, [], [], 0
        if ids:
            yield shard()

    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, base): ids of all shards before it. Sums of parts first, then inside each part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("part", "seq", F.coalesce(inside, F.lit(0)).alias("inside")).join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("inside")).alias("base"))


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored shards."""
    bounded_batches(shards.sparkSession)

    def run(batches):
        for batch in slices(batches):
            for part, seq, ids, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                shard = Shard(data)
                sizes = np.diff([*shard.firsts.tolist(), shard.ids])
                sums = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(shard.documents)]
                n = len(ids)
                columns = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(shard.firsts.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "first", "n_tokens", "ids_crc32"])

    each = shards.select("part", "seq", "doc_ids", "shard").mapInArrow(run, "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return each.join(shard_starts(shards.select("part", "seq", "n_ids")), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_range(shards: DataFrame, first: int, count: int) -> DataFrame:
    """(start, ids): the ids ``first`` to ``first + count - 1`` of the whole corpus, as one run per shard that holds
    some. Other shards' bytes are not read where the store prunes rows, and of a shard only the blocks wanted are unpacked."""
    base = shard_starts(shards.select("part", "seq", "n_ids"))
    wanted = base.join(shards.select("part", "seq", "n_ids"), ["part", "seq"]).where((F.col("base") < first + count) & (F.col("base") + F.col("n_ids") > first))
    rows = wanted.select("part", "seq", "base").join(shards.select("part", "seq", "shard"), ["part", "seq"]).select("base", "shard")

    def run(batches):
        for batch in slices(batches):
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(data)
                low, high = max(0, first - start), min(shard.ids, first + count - start)
                yield pa.RecordBatch.from_arrays([pa.array([start + low], pa.int64()), pa.array([shard.read(low, high - low).astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    return rows.mapInArrow(run, "start long, ids array<long>")


def export(shards: DataFrame, folder: str) -> int:
    """Write each shard as <part>-<seq>.mbp under ``folder`` of this machine, one at a time; returns how many."""
    n = 0
    for row in shards.select("part", "seq", "shard").toLocalIterator():
        with open(f"{folder}/{row.part:06d}-{row.seq:06d}.mbp", "wb") as out:
            out.write(row.shard)
        n += 1
    return n
