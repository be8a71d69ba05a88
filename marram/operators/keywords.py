"""Keywords: candidate statistics, ranking, sub-phrases, expansion."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.functions.ranking import top_k
from marram.functions.text import collapse, dash_key, json_array, strip, term_key
from marram.operators.rank import distinct_strings

#: Texts whose words are counted at once.
TEXTS = 256
#: Bytes of texts whose words a task counts.
TEXT_BYTES = 4 << 20
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*", re.UNICODE)
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\r\f\v]+|\n+")


def requested(least: int | None, most: int | None, headroom: int = 5) -> int:
    """How many candidates are asked for: the counts size the request and don't cap the result."""
    return min(200, max(10, max(10, least or 0, most or 0) + headroom))


def statistics(text: str, n: int = 3, top: int = 20, similarity: float = 0.9, stop: frozenset[str] = frozenset()) -> list[tuple[str, float]]:
    """(phrase, score), best (lowest) first, by the published single-document statistics: casing, position,
    frequency, relatedness to different neighbours and spread over sentences; phrases of up to n words
    that don't begin or end in a stop word. Near repeats of a better phrase are left out. For single short texts; a corpus
    is for extract()."""
    split = [[m.group() for m in _WORD.finditer(s)] for s in _SENTENCE.split(text) if s.strip()]
    split = [s for s in split if s]
    if not split:
        return []
    known = lambda w: w.lower() not in stop and len(w) > 2 and not w.isdigit()
    tf, upper, capital, where, left, right = Counter(), Counter(), Counter(), {}, {}, {}
    for i, words in enumerate(split):
        for j, word in enumerate(words):
            key = word.lower()
            tf[key] += 1
            upper[key] += word.isupper() and len(word) > 1
            capital[key] += j > 0 and word[0].isupper()
            where.setdefault(key, []).append(i)
            if j:
                left.setdefault(key, Counter())[words[j - 1].lower()] += 1
                right.setdefault(words[j - 1].lower(), Counter())[key] += 1
    counts = [c for w, c in tf.items() if known(w)] or list(tf.values())
    mean = sum(counts) / len(counts)
    deviation = math.sqrt(sum((c - mean) ** 2 for c in counts) / len(counts))
    most = max(tf.values())
    weight = {}
    for w, c in tf.items():
        case = max(upper[w], capital[w]) / (1 + math.log(c))
        spots = sorted(set(where[w]))
        middle = spots[len(spots) // 2] if len(spots) % 2 else (spots[len(spots) // 2 - 1] + spots[len(spots) // 2]) / 2
        place = math.log(math.log(3 + middle))
        frequency = c / (mean + deviation)
        spread = len(spots) / len(split)
        sides = left.get(w, Counter()), right.get(w, Counter())
        related = 1 + sum(len(s) / max(1, s.total()) for s in sides) * c / most
        weight[w] = place * related / (case + frequency / related + spread / related)
    found: dict[str, list] = {}
    for words in split:
        for at in range(len(words)):
            for size in range(1, n + 1):
                phrase = words[at : at + size]
                if len(phrase) == size and known(phrase[0]) and known(phrase[-1]):
                    entry = found.setdefault(" ".join(phrase).lower(), [" ".join(phrase), 0, [w.lower() for w in phrase]])
                    entry[1] += 1
    scored = []
    for entry in found.values():
        shown, count, words = entry
        product, total = 1.0, 0.0
        for k, w in enumerate(words):
            if w in stop:  # a stop word inside counts by how often it joins its neighbours
                joint = right.get(words[k - 1], Counter())[w] / tf[words[k - 1]] * (right.get(w, Counter())[words[k + 1]] / tf[w])
                product *= 1 + (1 - joint)
                total -= 1 - joint
            else:
                product *= weight[w]
                total += weight[w]
        scored.append((product / (count * (1 + total)) if 1 + total > 0 else product / count, shown))
    return distinct(sorted(scored, key=lambda x: (round(x[0], 12), x[1])), top, similarity)


def distinct(scored: Iterable[tuple[float, str]], top: int, similarity: float) -> list[tuple[str, float]]:
    """The first ``top`` phrases (in the given order) that are no near repeats of an earlier one."""
    out: list[tuple[str, float]] = []
    kept: list[SequenceMatcher] = []
    for score, phrase in scored:
        low = phrase.lower()
        # Two texts are at most as similar as their lengths allow.
        if all(2.0 * min(len(low), len(m.b)) / (len(low) + len(m.b)) <= similarity or _ratio(m, low) <= similarity for m in kept):
            out.append((phrase, score))
            if len(out) == top:
                break
            kept.append(SequenceMatcher(None, "", low))
    return out


def _ratio(kept: SequenceMatcher, text: str) -> float:
    kept.set_seq1(text)
    return kept.ratio()


def sentences(texts: DataFrame, stop: frozenset[str] = frozenset()) -> DataFrame:
    """texts (id, text) -> id, sizes: words of each sentence; and of each word of a text: words, keys (lower case), upper, capital (its first letter), good
    (usable), stop. Hyphens and apostrophes inside words are set apart first, so that the pattern of a word is one class of characters, which needs no stack."""
    letter = r"[\p{L}\p{N}]"
    text = F.translate(F.coalesce("text", F.lit("")), "\ue000\ue001", "  ")
    for mark, sign in (("-", "\ue000"), ("'", "\ue001")):
        text = F.regexp_replace(text, f"(?<={letter}){mark}(?={letter})", sign)
    split = F.transform(F.split(text, r"(?<=[.!?])[ \t\n\r\f\x0B]+|\n+"), lambda p: F.transform(F.regexp_extract_all(p, F.lit("[\\p{L}\\p{N}\ue000\ue001]+"), F.lit(0)), lambda w: F.translate(w, "\ue000\ue001", "-'")))
    each = texts.select("id", split.alias("sentences"))
    each = each.select("id", F.transform("sentences", F.size).alias("sizes"), F.flatten("sentences").alias("words"))
    each = each.select("*", F.transform("words", F.lower).alias("keys"))
    cased = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    upper, capital = F.transform("words", lambda w: cased(w) & (F.length(w) > 1)), F.transform("words", lambda w: cased(F.substring(w, 1, 1)))
    held = F.transform("keys", lambda w: w.isin(*sorted(stop)) if stop else F.lit(False))
    return each.select("*", upper.alias("upper"), capital.alias("capital"), F.transform("keys", lambda w: usable(w, stop)).alias("good"), held.alias("stop"))


def usable(key: Column, stop: frozenset[str]) -> Column:
    """Words that a phrase may begin and end with: no stop words, short words or numbers."""
    good = (F.length(key) > 2) & ~key.rlike(r"^\p{N}+$")
    return good & ~key.isin(*sorted(stop)) if stop else good


class Words:
    """The words of a batch of texts (rows of sentences()) and their aggregates over (text, word), for all texts at once: tf, weight, and ``pairs``, the count of each
    word with the one before it in its sentence. Casing, spread, frequency and left and right co-occurrence are counts, position is the median sentence."""

    def __init__(self, batch: pa.RecordBatch):
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        ends = lambda name: np.cumsum(pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False))
        sizes, texts = flat("sizes"), batch.num_rows
        text_of = np.searchsorted(ends("sizes"), np.arange(len(sizes)), side="right")
        sizes, text_of = sizes[sizes > 0], text_of[sizes > 0]
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        n = len(sentence)
        #: Of each word: its text, its place in the sentence, the words that follow there with itself.
        self.text, begins = text_of[sentence], np.cumsum(sizes) - sizes
        self.place = np.arange(n) - begins[sentence]
        self.left = sizes[sentence] - self.place
        keys = batch.column("keys").flatten().dictionary_encode()
        #: Of each word: the number of its (text, key).
        cells, at, self.cell = np.unique(self.text * (len(keys.dictionary) + 1) + keys.indices.to_numpy(), return_index=True, return_inverse=True)
        self.good, self.stop = flat("good").astype(bool), flat("stop").astype(bool)
        owner, m = self.text[at], len(cells)
        self.tf = np.bincount(self.cell, minlength=m)
        upper = np.bincount(self.cell, flat("upper").astype(float), m)
        capital = np.bincount(self.cell, flat("capital").astype(bool) & (self.place > 0), m)

        count = np.bincount(text_of, minlength=texts)
        # Sentences of each word, each once and in order; the median from the two in the middle.
        spots = np.unique(self.cell * (len(sizes) + 1) + sentence)
        spread = np.bincount(spots // (len(sizes) + 1), minlength=m)
        spot = spots % (len(sizes) + 1) - (np.cumsum(count) - count)[owner[spots // (len(sizes) + 1)]]
        first = np.cumsum(spread) - spread
        middle = (spot[first + (spread - 1) // 2] + spot[first + spread // 2]) / 2

        beside = np.flatnonzero(self.place > 0)
        pairs, number, times = np.unique(self.cell[beside - 1] * (m + 1) + self.cell[beside], return_inverse=True, return_counts=True)
        self.pairs = np.zeros(n, dtype=np.int64)
        self.pairs[beside] = times[number]
        side = lambda key: np.divide(np.bincount(key, minlength=m), np.bincount(key, times, m), out=np.zeros(m), where=np.bincount(key, minlength=m) > 0)
        related = side(pairs % (m + 1)) + side(pairs // (m + 1))

        known = self.good[at]
        known = known | ~(np.bincount(owner, known, texts) > 0)[owner]
        total = np.bincount(owner, known, texts)[owner]
        mean = np.bincount(owner, known * self.tf, texts)[owner] / total
        deviation = np.sqrt(np.bincount(owner, known * (self.tf - mean) ** 2, texts)[owner] / total)
        most = np.zeros(texts)
        np.maximum.at(most, owner, self.tf)
        related = 1 + related * self.tf / most[owner]
        case, frequency = np.maximum(upper, capital) / (1 + np.log(self.tf)), self.tf / (mean + deviation)
        self.weight = np.log(np.log(3 + middle)) * related / (case + frequency / related + spread / count[owner] / related)

    def scored(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, first word, words, score of each candidate, a run of up to ``n`` words of a sentence; by text and score, rounded to twelve places."""
        found = []
        for size in range(1, n + 1):
            at = np.flatnonzero(self.good & (self.left >= size))
            at = at[self.good[at + size - 1]]
            phrase = self.cell[at]
            for k in range(1, size):
                phrase = np.unique(phrase * (len(self.tf) + 1) + self.cell[at + k], return_inverse=True)[1]
            _, first, count = np.unique(phrase, return_index=True, return_counts=True)
            at, product, total = at[first], 1.0, 1.0
            for k in range(size):
                weight = self.weight[self.cell[at + k]]
                factor, term = weight, weight
                if 0 < k < size - 1:  # a stop word inside counts by how often it joins its neighbours
                    joint = self.pairs[at + k] / self.tf[self.cell[at + k - 1]] * (self.pairs[at + k + 1] / self.tf[self.cell[at + k]])
                    factor, term = np.where(self.stop[at + k], 2 - joint, weight), np.where(self.stop[at + k], joint - 1, weight)
                product, total = product * factor, total + term
            found.append((self.text[at], at, np.full(len(at), size), product / (count * np.where(total > 0, total, 1.0))))
        text, at, size, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((np.round(score, 12), text))
        return text[order], at[order], size[order], score[order]


def extract(texts: DataFrame, n: int = 3, least: int | None = None, most: int | None = None, similarity: float = 0.9, stop: frozenset[str] = frozenset()) -> DataFrame:
    """texts (id, text) -> id, seq, phrase, score (X6): the statistics of statistics(), a candidate of up to ``n`` words. Spark cuts texts into words; as the statistics of a
    text need no other text, the aggregates over words and phrases are taken where it is read, for a batch of texts at once, and nothing is shuffled.
    Only the near repeats are looked for text by text, among its best scored phrases."""
    top, kind = requested(least, most), dict(texts.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXTS):
                own = batch.slice(begin, TEXTS)
                words = own.column("words").flatten()
                text, at, size, score = Words(own).scored(n)
                shown = lambda i: " ".join(words.slice(int(at[i]), int(size[i])).to_pylist())  # noqa: B023, E731
                ends = np.searchsorted(text, np.arange(own.num_rows + 1))
                rows = [(i, k, p, s) for i in range(own.num_rows) for k, (p, s) in enumerate(distinct(in_order(score, ends[i], ends[i + 1], shown), top, similarity))]
                which, seq, phrase, value = zip(*rows, strict=True) if rows else ([], [], [], [])
                columns = [own.column("id").take(pa.array(which, pa.int64())), pa.array(seq, pa.int32()), pa.array(phrase, pa.string()), pa.array(value, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "seq", "phrase", "score"])

    return sentences(texts, stop).mapInArrow(run, f"id {kind}, seq int, phrase string, score double")


def in_order(score: np.ndarray, begin: int, end: int, shown: Callable[[int], str]) -> Iterator[tuple[float, str]]:
    """(score, phrase) of the candidates ``begin`` to ``end``, which lie by rounded score; equal ones by their letters."""
    rounded = np.round(score[begin:end], 12)
    cuts = [0, *(np.flatnonzero(np.diff(rounded)) + 1).tolist(), len(rounded)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield from ((float(score[i]), p) for p, i in sorted((shown(i), i) for i in range(begin + low, begin + high)))


def dealt(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` (id, ``text``, ...) by id over as many tasks as their texts need, TEXT_BYTES each. What is then taken apart and counted by id and phrase, and ranked by
    id, lies where it is needed: texts are shuffled, and not their words, and what a task holds doesn't grow with the table."""
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES)), "id")


def ranked(candidates: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """candidates (id, phrase) -> id, phrase, frequency, place (A8, F8): normalised, noise out, the most
    frequent first, then the longest, then by letters."""
    normal = candidates.select("id", dash_key(F.col("phrase")).alias("phrase")).where("phrase <> ''")
    if noise:
        normal = normal.where(~F.col("phrase").isin(noise))
    counted = normal.groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("frequency"))
    order = Window.partitionBy("id").orderBy(F.desc("frequency"), F.desc(F.length("phrase")), "phrase")
    return counted.withColumn("place", F.row_number().over(order))


def inner_phrases(phrase: Column) -> Column:
    """All shorter pieces of a phrase that begin and end at word boundaries."""
    parts = F.regexp_extract_all(phrase, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    word = lambda k: F.get(parts, k - 1).rlike(r"(?U)^\w")
    n = F.size(parts)

    def from_(i: Column) -> Column:
        piece = lambda j: F.when(((i > 1) | word(i)) & ((j < n) | word(j)) & ((i > 1) | (j < n)), F.array_join(F.slice(parts, i, j - i + 1), ""))
        return F.transform(F.sequence(i, n), piece)

    return F.when(n > 0, F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(1), n), from_)))))


def without_subphrases(phrases: DataFrame) -> DataFrame:
    """phrases (id, phrase, ...) without those that stand as whole words inside a longer one of the same id.

    A phrase that holds a dropped one is itself kept or inside a kept one, so no order is needed. Each phrase
    gives the pieces that it holds, and a phrase that is one of them goes: an anti join on (id, phrase).
    """
    inside = phrases.select(F.col("id").alias("_id"), F.explode(inner_phrases(F.col("phrase"))).alias("_piece")).distinct()
    return phrases.join(inside, (F.col("id") == F.col("_id")) & (F.col("phrase") == F.col("_piece")), "left_anti")


@F.pandas_udf(T.ArrayType(T.StringType()))
def without_near_repeats(documents: pd.Series, threshold: pd.Series) -> pd.Series:
    """Each text that is not too like one kept before it."""
    out = []
    for texts, limit in zip(documents, threshold, strict=True):
        kept: list[str] = []
        for t in texts if texts is not None else []:
            if all(SequenceMatcher(None, t, k).ratio() <= limit for k in kept):
                kept.append(t)
        out.append(kept)
    return pd.Series(out)


def union_and_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Sorted union and intersection."""
    return F.array_sort(F.array_union(a, b)), F.array_sort(F.array_intersect(a, b))


def merged(old: Column, new: Column, replace: bool) -> Column:
    """New keywords in place of the old, or after them, each once."""
    new = F.coalesce(new, F.array().cast("array<string>"))
    return distinct_strings(new if replace else F.concat(F.coalesce(old, F.array().cast("array<string>")), new))


def synonyms(terms: DataFrame, language: str) -> DataFrame:
    """terms (concept_id, display, designations: array<struct<language, use, value>>) -> concept_id, synonyms:
    the display first, then synonym designations of the language (a prefix match), case ignored (X10)."""
    own = F.filter("designations", lambda d: (F.lower(d["use"]) == "synonym") & F.lower(d["language"]).startswith(language.lower()))
    values = F.concat(F.array("display"), F.transform(F.coalesce(own, F.expr("slice(designations, 1, 0)")), lambda d: d["value"]))
    return terms.select("concept_id", distinct_strings(F.filter(values, lambda v: v.isNotNull())).alias("synonyms"))


def expanded(keywords: DataFrame, terminology: DataFrame, language: str, fallback: str) -> DataFrame:
    """keywords (id, keyword) with terms of ``terminology`` (term, language, synonyms) in a language, or else
    in the fallback language (J21)."""
    by = lambda lang, name: terminology.where(F.col("language") == lang).select(F.col("term").alias("keyword"), F.col("synonyms").alias(name))
    both = keywords.join(by(language, "_a"), "keyword", "left").join(by(fallback, "_b"), "keyword", "left")
    return both.withColumn("synonyms", F.when(F.size("_a") > 0, F.col("_a")).when(F.size("_b") > 0, F.col("_b")).otherwise(F.array().cast("array<string>"))).drop("_a", "_b")


def from_answers(answers: DataFrame, noise: list[str] | None = None, most: int | None = None) -> DataFrame:
    """answers (id, answer: a model's text with a JSON array) -> id, phrase, frequency, place (X7): normalised,
    noise out, ranked, at most ``most``."""
    phrases = dealt(answers, "answer").select("id", F.explode(json_array(F.col("answer"), "array<string>")).alias("phrase")).where("phrase is not null")
    found = ranked(phrases, noise)
    return found if most is None else found.where(F.col("place") <= most)


def enriched(refs: DataFrame, found: DataFrame, expansions: DataFrame | None = None, replace: bool = False) -> DataFrame:
    """refs (reference_id, content, keywords) with keywords found for them (reference_id, keywords).

    ``expansions`` (keyword, synonyms) are put in after their keyword. A reference without content or without
    found keywords is skipped and keeps its own.
    """
    if expansions is not None:
        each = found.select("reference_id", F.posexplode("keywords").alias("i", "keyword")).join(expansions, "keyword", "left")
        terms = F.concat(F.array("keyword"), F.coalesce("synonyms", F.array().cast("array<string>")))
        lists = each.groupBy("reference_id").agg(F.sort_array(F.collect_list(F.struct("i", terms.alias("terms")))).alias("l"))
        found = lists.select("reference_id", distinct_strings(F.flatten(F.transform("l", lambda x: x["terms"]))).alias("keywords"))
    rows = refs.join(found.withColumnRenamed("keywords", "_found"), "reference_id", "left")
    skipped = (strip(F.coalesce("content", F.lit(""))) == "") | F.coalesce(F.size("_found") == 0, F.lit(True))
    return rows.withColumn("skipped", skipped).withColumn("keywords", F.when(skipped, F.col("keywords")).otherwise(merged(F.col("keywords"), F.col("_found"), replace))).drop("_found")


def medical(answers: DataFrame, terminology: DataFrame, most: int = 20) -> DataFrame:
    """answers (id, answer) -> id, seq, keyword, canonical_form, concept_id (X9): keywords without end marks, each
    once, the first ``most``; the canonical form is the display of the terminology's term."""
    listed = answers.select("id", F.posexplode(json_array(F.col("answer"), "array<string>")).alias("seq", "k"))
    cleaned = listed.select("id", "seq", collapse(F.regexp_replace(strip(F.col("k")), "[.,;:]+$", "")).alias("keyword")).where("keyword <> ''").withColumn("term", term_key(F.col("keyword")))
    once = cleaned.groupBy("id", "term").agg(F.min(F.struct("seq", "keyword")).alias("f")).select("id", "term", "f.*")
    first = top_k(once, most, [F.col("seq")], ["id"])
    known = terminology.select(term_key(F.col("term")).alias("term"), F.col("display").alias("canonical_form"), "concept_id").dropDuplicates(["term"])
    return first.join(known, "term", "left").select("id", "seq", "keyword", "canonical_form", "concept_id")


CONCEPT = "struct<expansion:struct<contains:array<struct<code:string,display:string,designation:array<struct<language:string,use:struct<display:string>,value:string>>>>>>"


def terminology_answers(responses: DataFrame) -> DataFrame:
    """responses (term, json) of a terminology server's value set expansion -> term, concept_id, display,
    designations (language, use, value) of the first concept, as synonyms() takes them (SRC9)."""
    first = F.get(F.from_json("json", CONCEPT)["expansion"]["contains"], F.lit(0))
    designations = F.transform(first["designation"], lambda d: F.struct(d["language"].alias("language"), d["use"]["display"].alias("use"), d["value"].alias("value")))
    return responses.select("term", first["code"].alias("concept_id"), first["display"].alias("display"), designations.alias("designations")).where("concept_id is not null")
