"""License scans by ordered signature rules.

A rule is a regular expression over lower-cased text with a label and a priority; `license_rules` has them. Its keywords are
read off the expression: words without white space that no match can lack. An Aho-Corasick automaton over all keywords reads a
text once, and only rules whose keywords all occur are run. Detections compete in order of priority, then length, then place:
one that lies inside an interval granted to another is suppressed.

Besides, base phrases are looked up as runs of whole words; their labels hold whatever the rules say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from re import _constants as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, text_chunks
from .license_rules import RULES
from .texthash import ALNUM, LOWER, word_bounds

#: Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: No letter or digit on either side; what a blank of a rule stands for.
EDGE = r"(?<![0-9a-z\x80-\U0010ffff])", r"(?![0-9a-z\x80-\U0010ffff])"
BLANK = r"[\s*#]+"
#: Letters that a keyword has at least, and keywords of a rule.
LETTERS, KEYWORDS = 2, 3


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str


def rules(lines: str = RULES) -> list[Rule]:
    """Rules written one a line: label, priority, expression; lines that begin with # are remarks."""
    out = []
    for line in lines.strip().splitlines():
        if not line.startswith("#"):
            label, priority, text = line.split(" ", 2)
            text = re.sub(r" (?![^\[\]]*\])(\?|)", lambda m: BLANK if not m[1] else r"[\s*#]*", text)  # but not within a class
            text = re.sub(r"\[- \]", r"(?:-|" + BLANK.replace("\\", "\\\\") + ")", text)
            out.append(Rule(label, int(priority), EDGE[0] + f"(?:{text})" + EDGE[1]))
    return out


def necessary(tree, now: str = "") -> list[frozenset[str]]:
    """Sets of words of a parsed expression behind the letters `now`: a match holds one of each set, whatever stands between."""
    out: list[frozenset[str]] = []
    for op, x in [*tree, (None, None)]:
        if op is sre.LITERAL and not chr(x).isspace():
            now += chr(x)
            continue
        before, now = now, ""
        if before:
            out.append(frozenset([before]))
        if op is sre.SUBPATTERN:
            out += necessary(x[-1], before)
        elif op is sre.MAX_REPEAT and x[0]:
            out += necessary(x[2])
        elif op is sre.BRANCH:
            best = [max(necessary(y, before), key=_worth, default=None) for y in x[1]]
            if all(best):
                out.append(frozenset().union(*best))
    return [s for s in out if _worth(s) >= LETTERS]


def _worth(words: frozenset[str]) -> int:
    return min(map(len, words))


def keywords(pattern: str) -> list[frozenset[str]]:
    """The most telling of the necessary words of a rule."""
    found = dict.fromkeys(necessary(re._parser.parse(pattern)))
    return sorted(found, key=lambda s: (-_worth(s), len(s), sorted(s)))[:KEYWORDS]


class Scanner:
    def __init__(self, given: list[Rule] | None = None):
        import ahocorasick

        self.rules = [(r, re.compile(r.pattern)) for r in (rules() if given is None else given)]
        self.automaton, keys = ahocorasick.Automaton(), {}
        self.need: list[list[int]] = []
        for r, _ in self.rules:
            self.need.append([])
            for group in keywords(r.pattern):
                bits = 0
                for word in sorted(group):
                    bits |= 1 << keys.setdefault(word, len(keys))
                self.need[-1].append(bits)
        for word, bit in keys.items():
            self.automaton.add_word(word, 1 << bit)
        self.automaton.make_automaton()
        #: rules to run, by the keywords seen
        self.gate: dict[int, list[int]] = {}

    def matching(self, seen: int) -> list[int]:
        if seen not in self.gate:
            if len(self.gate) > 50_000:
                self.gate.clear()
            self.gate[seen] = [i for i, groups in enumerate(self.need) if all(seen & g for g in groups)]
        return self.gate[seen]

    def seen(self, text: str) -> int:
        return reduce(or_, {bit for _, bit in self.automaton.iter(text)}, 0)

    def scan(self, text: str) -> list[tuple[int, int, str, int]]:
        """Granted detections (start, end, label, priority) of lower-cased text, by start."""
        found = [(m.start(), m.end(), i) for i in self.matching(self.seen(text)) for m in self.rules[i][1].finditer(text)]
        return [(a, b, self.rules[i][0].label, self.rules[i][0].priority) for a, b, i in self.granted(found)]

    def granted(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections (start, end, rule) that lie in none which goes before them: of higher priority, else longer, else of an earlier rule.

        One that lies in a suppressed detection lies in what suppressed that, so all that go before count alike. Two
        sweeps for each priority: over ends of higher ones by start, and over its own.
        """
        if len(found) < 2:
            return found
        start, end, rule = np.array(found, np.int64).T
        priority = np.array([r.priority for r, _ in self.rules])[rule]
        keep = np.ones(len(start), bool)
        starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of higher priorities, by start; ends are the furthest so far
        for p in np.unique(priority)[::-1]:
            own = np.flatnonzero(priority == p)
            own = own[np.lexsort((rule[own], -end[own], start[own]))]
            furthest = np.maximum.accumulate(end[own])
            keep[own[1:]] = furthest[:-1] < end[own[1:]]
            if len(starts):
                at = np.searchsorted(starts, start[own], "right") - 1
                keep[own] &= np.where(at >= 0, ends[at], -1) < end[own]
            starts, ends = np.concatenate([starts, start[own]]), np.concatenate([ends, furthest])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], np.maximum.accumulate(ends[order])
        return sorted((found[k] for k in np.flatnonzero(keep).tolist()))


GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
PHRASES = [
    (label, re.compile(rb"(?<![0-9a-z\x80-\xff])" + GAP.join(w.encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])"))
    for phrase, label in BASE.items()
]


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
    for rows, offsets, data in text_chunks(batches):
        low = LOWER[data]
        starts, _, doc = word_bounds(low, offsets, ALNUM)
        n_words = np.bincount(doc, minlength=len(offsets) - 1)
        first = np.searchsorted(starts, offsets)
        whole, out = low.tobytes(), []
        for k, doc_id in enumerate(rows.column(0).to_pylist()):
            text = whole[offsets[k] : offsets[k + 1]]
            places: list[int] = []
            base = set()
            for label, pattern in PHRASES:
                for m in pattern.finditer(text):
                    places.append(int(np.searchsorted(starts, offsets[k] + m.start())) - int(first[k]))
                    base.add(label)
            granted = scanner.scan(text.decode())
            labels = base | {x[2] for x in granted}
            score = max([90.0 * bool(base), *(float(x[3]) for x in granted)]) / 100
            out.append((doc_id, int(n_words[k]), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, len(granted)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Texts are read whole, of any length; null and empty ones have no words, no labels and score 0. score is the best granted
    priority over 100, 0.9 for a base phrase. Null and repeated doc_ids are scanned as any row; other columns are ignored,
    and an empty table gives no row.
    """
    return docs.select("doc_id", "text").mapInArrow(
        scan_batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
