"""Word segmentation of scripts without blanks: a lexicon, the cheapest path through the graph of its words, and a hidden Markov
model for what the lexicon does not know. Lexicons are learned by operators/segmentation.py, or given."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs that are cut into words. The pattern is the same to Java and to Python.
HAN = "[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]+"
#: Costs are whole numbers, so that ties are ties everywhere: millionths of a natural logarithm.
UNIT = 1_000_000
#: Places of a character in a word: begin, middle, end, single.
TAGS = "BMES"
#: Tags that may follow a tag.
_AFTER = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


@dataclass(frozen=True)
class Hmm:
    """Negative logarithms. start: of a run's first tag; moves: of a tag after a tag; emissions: of a character by its tag, with
    what an unknown character costs under the empty string."""

    start: dict[str, float]
    moves: dict[str, float]
    emissions: dict[str, dict[str, float]]

    @classmethod
    def of(cls, tags: dict[tuple[str, str], int], moves: dict[tuple[str, str], int], starts: dict[str, int]) -> Hmm:
        """From counts of (tag, character), (tag, next tag) and first tags, one added to each that is possible."""
        characters = len({c for _, c in tags}) + 1

        def logs(counts: dict, total: float) -> dict:
            return {k: math.log(total) - math.log(v) for k, v in counts.items()}

        first = {t: starts.get(t, 0) + 1 for t in "BS"}
        step = {}
        for a, after in _AFTER.items():
            own = {a + b: moves.get((a, b), 0) + 1 for b in after}
            step |= logs(own, sum(own.values()))
        emissions = {}
        for t in TAGS:
            own = {c: n + 1 for (tag, c), n in tags.items() if tag == t}
            total = sum(own.values()) + characters - len(own)
            emissions[t] = logs(own, total) | {"": math.log(total)}
        return cls(logs(first, sum(first.values())), step, emissions)

    def tags(self, run: str) -> str:
        """The most likely tags of a run (Viterbi); of equally likely ones those whose last tags come first in BMES."""
        cost = {t: self.start[t] + self._emit(t, run[0]) if t in self.start else math.inf for t in TAGS}
        back: list[dict[str, str]] = []
        for c in run[1:]:
            best = {b: min((cost[a] + self.moves.get(a + b, math.inf), i) for i, a in enumerate(TAGS)) for b in TAGS}
            back.append({b: TAGS[i] for b, (_, i) in best.items()})
            cost = {b: best[b][0] + self._emit(b, c) for b in TAGS}
        out = [min("ES", key=lambda t: (cost[t], TAGS.index(t)))]
        for step in reversed(back):
            out.append(step[out[-1]])
        return "".join(reversed(out))

    def _emit(self, tag: str, c: str) -> float:
        own = self.emissions[tag]
        return own.get(c, own[""])

    def words(self, run: str) -> list[str]:
        out, start = [], 0
        for i, t in enumerate(self.tags(run)):
            if t in "ES":
                out.append(run[start : i + 1])
                start = i + 1
        return out


@dataclass(frozen=True)
class Lexicon:
    """costs: of each word, -log of its share of all occurrences, in UNITs; floor: of a character that is no word; hmm: for runs of
    characters that stand alone, if there is one. pattern: the runs that are segmented."""

    costs: dict[str, int]
    floor: int
    hmm: Hmm | None = None
    pattern: str = HAN
    prefixes: frozenset[str] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "prefixes", frozenset(w[:i] for w in self.costs for i in range(1, len(w))))

    @classmethod
    def of(cls, counts: dict[str, int], hmm: Hmm | None = None, pattern: str = HAN) -> Lexicon:
        """Words with how often they occur; those without an occurrence are none."""
        counts = {w: n for w, n in counts.items() if w and n > 0}
        total = max(1, sum(counts.values()))
        cost = lambda n: round((math.log(total) - math.log(n)) * UNIT)
        return cls({w: cost(n) for w, n in counts.items()}, cost(1), hmm, pattern)

    def path(self, run: str) -> list[str]:
        """The segmentation of least cost into words and single characters; of equal ones, the last word is the longest, then the
        one before it. Words are looked up from each place as long as some word goes on: time grows with the run."""
        n = len(run)
        best, start = [0] + [-1] * n, [0] * (n + 1)
        for i in range(n):
            base = best[i]
            c = run[i]
            # a character alone is always possible, so every place is reached
            cost = base + self.costs.get(c, self.floor)
            if best[i + 1] < 0 or cost < best[i + 1]:
                best[i + 1], start[i + 1] = cost, i
            j = i + 1
            while c in self.prefixes and j < n:
                j += 1
                c = run[i:j]
                own = self.costs.get(c)
                if own is not None and (best[j] < 0 or base + own < best[j]):
                    best[j], start[j] = base + own, i
        out = []
        while n:
            out.append(run[start[n] : n])
            n = start[n]
        return out[::-1]

    def words(self, run: str) -> list[str]:
        """The path; its characters that stand alone, two or more in a row, are decided by the hidden Markov model."""
        path = self.path(run)
        if not self.hmm:
            return path
        out: list[str] = []
        alone = ""
        for w in [*path, ""]:
            if len(w) == 1:
                alone += w
                continue
            if alone:
                out += self.hmm.words(alone) if len(alone) > 1 else [alone]
                alone = ""
            if w:
                out.append(w)
        return out

    def tokens(self, text: str, others: str = r"[^\W_]+") -> list[str]:
        """Words of the runs, and what `others` finds between them, in order."""
        out: list[str] = []
        at = 0
        for m in re.finditer(self.pattern, text):
            out += re.findall(others, text[at : m.start()])
            out += self.words(m[0])
            at = m.end()
        out += re.findall(others, text[at:])
        return out


def applied(text: Column, lexicon: Lexicon, work: Callable[[Lexicon, str], list[str]] = Lexicon.tokens) -> Column:
    """array<string> of each text, by Arrow batches; null for null. A lexicon is of bounded size."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: work(lexicon, t) if isinstance(t, str) else None)

    return run(text)


def tokenizer(lexicon: Lexicon) -> Callable[[Column], Column]:
    """What an index or the BM25 functions take for a pattern."""
    return lambda text: applied(text, lexicon)
