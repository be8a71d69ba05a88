from __future__ import annotations

import random
import time
from difflib import SequenceMatcher


from marram.functions import matching
from marram.operators import evaluation


def texts(rng):
    alphabet = rng.choice(["ab", "abc ", "abcdefgh", "the quick brown fox", "äöüß漢字 xyz"])
    a = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 7, 40, 199, 200, 260])))
    b = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 9, 60, 199, 200, 230])))
    if a and rng.random() < 0.5:  # common passages
        i, j = sorted(rng.randrange(len(a) + 1) for _ in range(2))
        at = rng.randrange(len(b) + 1)
        b = b[:at] + a[i:j] + b[at:]
    return a, b


def test_common_parts_equal_difflib():
    rng = random.Random(99)
    for _ in range(10_000):
        a, b = texts(rng)
        found = SequenceMatcher(None, a, b).find_longest_match()
        assert matching.common(a, b, matching.popular(b)) == (found.a, found.b, found.size)


def test_similarity_equals_difflib():
    rng = random.Random(7)
    for _ in range(1500):
        a, b = texts(rng)
        assert matching.similarity(a, b) == SequenceMatcher(None, a, b).ratio()


def test_time_follows_the_length():
    rng = random.Random(1)
    took = []
    for n in (25_000, 100_000):
        a, b = ("".join(rng.choice("ab") for _ in range(n)) for _ in range(2))
        began = time.process_time()
        matching.common(a, b, frozenset())
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5  # four times the characters


def test_sequence_ratio_of_a_column(spark):
    rows = [("", ""), ("abc", ""), ("abcd", "bcde"), ("x" * 300 + "tail", "y" + "x" * 300 + "tail")]
    df = spark.createDataFrame(rows, "e string, a string").select("e", "a", evaluation.sequence_ratio("e", "a").alias("r"))
    assert all(r.r == (SequenceMatcher(None, r.e, r.a).ratio() if r.e or r.a else 0.0) for r in df.collect())


def test_retrieval_scores_by_hand(spark):
    """The query's metric on benchmark passages and found texts, with difflib's search in place of the automaton."""

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    samples = []
    for i in range(60):
        words = [word() for _ in range(30)]
        expected = [" ".join(words[rng.randrange(0, 10) : rng.randrange(12, 30)]) for _ in range(rng.randrange(0, 3))]
        actual = [" ".join(words[rng.randrange(0, 15) : rng.randrange(16, 30)] + [word()] * rng.randrange(0, 2)) for _ in range(rng.randrange(0, 4))]
        samples.append((i, expected, actual))
    found = {r.id: (r.precision, r.recall, r.f1) for r in evaluation.retrieval(spark.createDataFrame(samples, "id long, expected array<string>, actual array<string>")).collect()}

    def part_of(a, b):
        m = SequenceMatcher(None, a, b).find_longest_match()
        part = a[m.a : m.a + m.size]
        return "" if part.isspace() else part

    keep, evaluation.common_part = evaluation.common_part, part_of
    try:
        want = {i: evaluation.retrieval_scores(e, a) or (None, None, None) for i, e, a in samples}
    finally:
        evaluation.common_part = keep
    rounded = lambda t: tuple(None if x is None else round(x, 6) for x in t)
    assert {i: rounded(t) for i, t in found.items()} == {i: rounded(t) for i, t in want.items()}
