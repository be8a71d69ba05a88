"""Longest common parts of two texts in linear time, by a suffix automaton.

A character of the second text is popular where that text has 200 characters or more and holds it more than once in a hundred
characters (and once more); a common part begins as a run of characters that are not popular, the longest one, the first in the first text and
then in the second, and is then lengthened to both sides by whatever characters agree. These are the rules by which the scores
of sequence comparison are defined; here they are stated, and every text's automaton is built once for a search.
"""

from __future__ import annotations

from collections import Counter

#: From this length on a text has popular characters.
LONG = 200


def popular(text: str) -> frozenset[str]:
    if len(text) < LONG:
        return frozenset()
    most = len(text) // 100 + 1
    return frozenset(c for c, n in Counter(text).items() if n > most)


class Automaton:
    """All runs of a text as paths; each state knows where the first of its runs ends. Popular characters are on no path that a search takes."""

    def __init__(self, text: str, skip: frozenset[str] = frozenset()) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for at, c in enumerate(text):
            c = "" if c in skip else c
            state = self._add({}, self.size[last] + 1, at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p < 0:
                self.link[state] = 0
            else:
                q = self.next[p][c]
                if self.size[q] != self.size[p] + 1:
                    copy = self._add(dict(self.next[q]), self.size[p] + 1, self.end[q])
                    self.link[copy], self.link[q] = self.link[q], copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    q = copy
                self.link[state] = q
            last = state

    def _add(self, edges: dict[str, int], size: int, end: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def longest(self, text: str) -> tuple[int, int, int]:
        """Begin in ``text``, begin in the automaton's text and length of the longest common run; the first one."""
        best, state, n = (0, 0, 0), 0, 0
        for at, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            if n > best[2]:
                best = at - n + 1, self.end[state] - n + 1, n
        return best


def common(a: str, b: str, skip: frozenset[str]) -> tuple[int, int, int]:
    """Begin in ``a``, begin in ``b`` and length of their common part; ``skip`` are the popular characters."""
    i, j, n = Automaton(b, skip).longest(a)
    left = 0
    while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
        left += 1
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return i - left, j - left, n + left


def similarity(a: str, b: str) -> float:
    """Twice the characters in common parts over all characters: the longest part, then those of what is left and right of it in both."""
    if not a and not b:
        return 1.0
    skip, total, todo = popular(b), 0, [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        own, other = a[a0:a1], b[b0:b1]
        if own == other:
            total += len(own)
            continue
        i, j, n = common(own, other, skip)
        if n:
            total += n
            todo += [w for w in ((a0, a0 + i, b0, b0 + j), (a0 + i + n, a1, b0 + j + n, b1)) if w[0] < w[1] and w[2] < w[3]]
    return 2 * total / (len(a) + len(b))
