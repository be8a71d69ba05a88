"""Encoding and decoding with a SentencePiece BPE model, by its merge-type prefix table.

Merging the best pair until none is left gives each text one result, and the result of a prefix
ends in one token only: so a table of the last token of every prefix is the whole answer, read from
the end backwards. A piece t that ends at position i is that token if it covers the prefix, or if
the last token before t may stand beside t. An Aho-Corasick automaton lists the pieces that end at
each position; whether two tokens may stand side by side is asked by undoing merges at their
boundary, latest first, and looking for a merge across it that would have come earlier; answers
are remembered.

No piece of such a model holds a space mark after another character (checked when the model is
loaded), so nothing merges into a word from the left and words are encoded once each per worker
while the (bounded) memory lasts. Words with several space marks, whose pieces tie in score, are
merged step by step instead.

Defined cases: null and empty texts have the end id alone and decode to the empty text; characters
that the model lacks become byte pieces; every row of repeated rows has its own result.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import bounded_batches, slices

SPACE = "▁"
#: Words, and pairs of tokens, remembered by a worker.
MEMORY = 400_000
PAIRS = 1_000_000
#: Characters of a word that is remembered.
LONGEST = 64
MARKS = ".,;:!?"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PrefixTable:
    """The model's pieces, with the rank of the merge that makes each; lower ranks merge first."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        self.ids, scores = {}, {}
        self.bytes = [0] * 256
        for i in range(p.get_piece_size()):
            if p.is_byte(i):
                self.bytes[int(p.id_to_piece(i)[3:-1], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                self.ids[p.id_to_piece(i)] = i
                scores[p.id_to_piece(i)] = p.get_score(i)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.rank = {piece: -score for piece, score in scores.items() if len(piece) > 1}
        if not {c for piece in self.ids for c in piece} <= self.ids.keys():
            raise ValueError("a character of a piece is no piece")
        #: The two tokens that a piece's last merge joins, of all pieces that merging makes whole.
        self.halves: dict[str, tuple[str, str]] = {}
        for piece in self.rank:
            if SPACE not in piece[1:]:
                self.merged(piece)
        self.piece = {i: piece for piece, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or piece in self.halves:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.holds_line_ends = any("\n" in piece for piece in self.ids)
        self.line_end = (self.bytes[10],), str(self.bytes[10])
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str]] = {}

    def merged(self, text: str) -> list[str]:
        """Step-by-step merging: best rank first, leftmost of equals."""
        parts, rank, n = list(text), self.rank, len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[a + b], k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        heapify(agenda)
        while agenda:
            _, k, piece = heappop(agenda)
            k2 = after[k]
            if not parts[k] or k2 >= n or parts[k] + parts[k2] != piece:
                continue  # one of the two has merged with another meanwhile
            if len(piece) == n:
                self.halves[piece] = (parts[k], parts[k2])
            parts[k], parts[k2] = piece, ""
            after[k] = after[k2]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n and (longer := parts[i] + parts[after[i]]) in rank:
                    heappush(agenda, (rank[longer], i, longer))
        return [p for p in parts if p]

    def beside(self, left: int, right: int) -> bool:
        """Whether merging can leave the tokens ``left`` and ``right`` as neighbours."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._beside(self.piece[left], self.piece[right])
        return known

    def _beside(self, left: str, right: str) -> bool:
        rank = self.rank
        never = float("inf")
        # The merge across the boundary must not come before the one that ended its chance:
        # that which made left (it wins a tie, being further left) or right (it loses one).
        limit, ties = never, False
        while True:
            across = rank.get(left + right, never)
            if across < limit or (ties and across == limit):
                return False
            made_left, made_right = rank.get(left, -never), rank.get(right, -never)
            if made_left == made_right == -never:
                return True
            # The later of the two is undone; of equals the right one was made later.
            if made_left > made_right:
                left, limit, ties = self.halves[left][1], made_left, False
            else:
                right, limit, ties = self.halves[right][0], made_right, True

    def table(self, word: str) -> list[int]:
        """The last token of every prefix of ``word``; -1 for a character that the model lacks."""
        pairs, last, filled = self.pairs, [-1] * len(word), -1
        for end, (token, n) in self.automaton.iter(word):
            if end == filled:
                continue
            if n <= end:
                before = last[end - n]
                if before >= 0:
                    fits = pairs.get(before << 32 | token)
                    if fits is None:
                        fits = self.beside(before, token)
                    if not fits:
                        continue
            last[end] = token
            filled = end
        return last

    def word(self, word: str) -> tuple[tuple[int, ...], str]:
        """ids of a word, and the same in decimal, joined by spaces."""
        ids: list[int] = []
        if SPACE in word[1:]:
            for token in self.merged(word):
                i = self.ids.get(token)
                ids += [i] if i is not None else [self.bytes[b] for b in token.encode("utf-8")]
        else:
            last, at, piece = self.table(word), len(word), self.piece
            while at:
                token = last[at - 1]
                if token < 0:
                    ids += [self.bytes[b] for b in reversed(word[at - 1].encode("utf-8"))]
                    at -= 1
                else:
                    ids.append(token)
                    at -= len(piece[token])
            ids.reverse()
        return tuple(ids), " ".join(map(str, ids))

    def encode(self, text: str) -> tuple[list[tuple[int, ...]], list[str]]:
        """ids of ``text`` word by word, and their decimal forms. Words are known without their space mark."""
        normal = self.processor.normalize(text)
        if not normal:
            return [], []
        if len(self.words) > MEMORY:  # the words of the last stretch stay known, older ones go
            self.older, self.words = self.words, {}
        if normal[0] == SPACE and SPACE + SPACE not in normal:
            words = normal.split(SPACE)
            del words[0]
            got = list(map(self.words.get, words))
            if None in got:
                got = [self._known(w, SPACE + w) if g is None else g for w, g in zip(words, got, strict=True)]
        else:
            got = [self.word(w) for w in _WORDS.findall(normal)]
        return [g[0] for g in got], [g[1] for g in got]

    def _known(self, key: str, word: str) -> tuple[tuple[int, ...], str]:
        """ids of ``word``, from ``self.words`` or worked out and put there under ``key``."""
        found = self.words.get(key) or self.older.get(key) or self._extended(key, word) or self.word(word)
        if len(word) <= LONGEST:
            self.words[key] = found
        return found

    def _extended(self, key: str, word: str) -> tuple[tuple[int, ...], str] | None:
        """ids of a word that is a known one and more: after a line end, which no piece holds, a new word
        begins; a mark that may stand beside the last token of what is before it is the last token. Of a run
        of marks only the word before it and the whole are remembered."""
        if "\n" in word and not self.holds_line_ends:
            head, *rest = word.split("\n")
            parts = [self._known(head[1:], head) if head else ((), "")]
            for line in rest:
                parts += [self.line_end, self._known(SPACE + line, line) if line else ((), "")]  # no other key holds a space mark
            return tuple(chain.from_iterable(p[0] for p in parts)), " ".join(p[1] for p in parts if p[1])
        plain = len(word.rstrip(MARKS))
        if 2 <= plain < len(word):
            found, decimal = self._known(key[: plain - len(word)], word[:plain])
            ids = list(found)
            for mark in map(self.ids.get, word[plain:]):
                last = ids[-1]
                if mark is None or last in self.piece and not (known if (known := self.pairs.get(last << 32 | mark)) is not None else self.beside(last, mark)):
                    return None
                ids.append(mark)
            return tuple(ids), " ".join([decimal, *map(str, ids[len(found) :])])
        return None


_tables: dict[str, PrefixTable] = {}


def prefix_table(path: str) -> PrefixTable:
    """This worker's table for a model file."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (with the end id) for each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        table = prefix_table(model)
        end = table.processor.eos_id()
        for batch in slices(batches):
            ids = [[*chain.from_iterable(table.encode(t or "")[0]), end] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text for each row of ``encoded`` (doc_id, ids)."""
    bounded_batches(encoded.sparkSession)

    def run(batches):
        processor = prefix_table(model).processor
        for batch in slices(batches):
            texts = processor.decode([i or [] for i in batch.column(1).to_pylist()], num_threads=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, and decodes those ids, in one pass."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        table = prefix_table(model)
        processor, end = table.processor, table.processor.eos_id()
        for batch in slices(batches):
            counts, ids_sha, all_ids = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decimal = table.encode(text or "")
                flat = [*chain.from_iterable(ids), end]
                decimal.append(str(end))
                counts.append(len(flat))
                ids_sha.append(hashlib.sha256(" ".join(decimal).encode()).hexdigest())
                all_ids.append(flat)
            decoded = processor.decode(all_ids, num_threads=1) if all_ids else []
            text_sha = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
