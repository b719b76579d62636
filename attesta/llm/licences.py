"""Licence scans: a generalised suffix automaton of licence texts, matching statistics, chains.

All templates and phrases are words of one suffix automaton. A text streams through it once: at
every word the automaton holds the longest match that ends there, and from its state the places
in the templates where that match, or a suffix of it that other templates share, cannot be
continued. These matches are chained in reading order per template; a chain that covers enough
of its template is a span with the template's label. Where spans overlap, the one that covers
more words stays.

A phrase is found wherever its words stand one after another: the state knows which phrases end
in it. Words are runs of ASCII letters and digits and of everything beyond ASCII, with A-Z in
lower case, so punctuation and line breaks inside a notice make no difference.

Defined results: a null text counts as empty; a text without words has zero counts, null places,
empty labels and a score of 0. The score is the covered share of the best span (0 without one).
Repeated rows give repeated results, no text is cut, other columns are not looked at. Time grows
with the words of a text; the automaton grows with the templates alone and is built in each task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import aside
from attesta.llm.licence_texts import PHRASES, TEMPLATES

#: Shortest match, in words, that takes part in a chain.
MIN_MATCH = 4
#: Words that may lie between two matches of a chain, in the text and in the template.
MAX_GAP = 24
#: Share of a template's words that a chain must cover.
MIN_SHARE = 0.9

#: Everything that is no word character as a space, A-Z in lower case. Bytes beyond ASCII stay.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
             else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPAN = ("array<struct<label:string,first:long,last:long,template_first:int,template_last:int,"
        "covered:int,share:double>>")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


class Automaton:
    """A generalised suffix automaton over word numbers; 0 stands for any unknown word."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]],
                 min_match: int = MIN_MATCH):
        self.number: dict[bytes, int] = {}
        self.min_match = min_match
        self.labels = [label for label, _ in templates]
        self.texts = [self._numbers(text) for _, text in templates]
        self.phrases = [(label, len(words_of(text))) for label, text in phrases]
        phrase_words = [self._numbers(text) for _, text in phrases]
        if any(len(t) < min_match for t in self.texts) or not all(phrase_words):
            raise ValueError(f"a template needs {min_match} words, a phrase at least one")
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, place) whose prefix it is
        for t, words in enumerate(self.texts):
            last = 0
            for place, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].append((t, place))
        for words in phrase_words:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._settle(phrase_words)

    def _numbers(self, text: str) -> list[int]:
        return [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]

    def _new(self, step: dict[int, int], longest: int, link: int) -> int:
        self.step.append(step)
        self.longest.append(longest)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of the longest string of p followed by w, parted off where it must be."""
        q = self.step[p][w]
        if self.longest[q] == self.longest[p] + 1:
            return q
        part = self._new(dict(self.step[q]), self.longest[p] + 1, self.link[q])
        self.link[q] = part
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int) -> int:
        if w in self.step[last]:
            return self._split(last, w)
        new = self._new({}, self.longest[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _settle(self, phrase_words: list[list[int]]) -> None:
        """Per state: template places that end in it, and the phrases that do."""
        n = len(self.step)
        by_length = sorted(range(1, n), key=self.longest.__getitem__)
        own: list[list[tuple[int, int]]] = [list(e) for e in self.ends]
        for v in reversed(by_length):
            if self.longest[self.link[v]] >= self.min_match:
                own[self.link[v]].extend(own[v])
        # (template, place, longest shared length or None for the whole match, next word)
        self.places: list[list[tuple[int, int, int | None, int]]] = [[] for _ in range(n)]
        self.phrase_ends: list[list[int]] = [[] for _ in range(n)]
        of_state: dict[int, list[int]] = {}
        for k, words in enumerate(phrase_words):
            v = 0
            for w in words:
                v = self.step[v][w]
            of_state.setdefault(v, []).append(k)
        for v in by_length:
            up = self.link[v]
            self.phrase_ends[v] = self.phrase_ends[up] + of_state.get(v, [])
            if self.longest[v] >= self.min_match:
                seen = set(own[v])
                self.places[v] = [(t, e, None, self._after(t, e)) for t, e in sorted(seen)]
                self.places[v] += [(t, e, cap if cap is not None else self.longest[up], after)
                                   for t, e, cap, after in self.places[up] if (t, e) not in seen]

    def _after(self, t: int, place: int) -> int:
        return self.texts[t][place + 1] if place + 1 < len(self.texts[t]) else -1

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[list[tuple]]]:
        """Phrase places (start, phrase) and, per template, matches in the order of their ends.

        A match is (first word, last word, first template word, last template word).
        """
        get, step, link, longest = self.number.get, self.step, self.link, self.longest
        places, phrase_ends, need = self.places, self.phrase_ends, self.min_match
        found: list[tuple[int, int]] = []
        matches: list[list[tuple]] = [[] for _ in self.texts]
        ids = [get(w, 0) for w in words]
        ids.append(0)
        state = length = 0
        for i, w in enumerate(ids):
            if not w:
                if length:
                    state = length = 0
                continue
            while state and w not in step[state]:
                state = link[state]
                length = longest[state]
            state = step[state].get(w, 0)
            length = length + 1 if state else 0
            if phrase_ends[state]:
                for k in phrase_ends[state]:
                    if self.phrases[k][1] <= length:
                        found.append((i - self.phrases[k][1] + 1, k))
            if length >= need:
                coming = ids[i + 1]
                for t, e, cap, after in places[state]:
                    if after != coming:
                        n = min(length if cap is None else cap, length)
                        if n >= need:
                            matches[t].append((i - n + 1, i, e - n + 1, e))
        return found, matches

    def chains(self, t: int, matches: list[tuple], max_gap: int,
               min_share: float) -> list[tuple[float, int, int, int, int, int, int]]:
        """Chains of one template that cover enough: (share, covered, t, span, template span)."""
        size = len(self.texts[t])
        best: list[tuple[int, int, int]] = []  # covered, first word, first template word
        continued = [False] * len(matches)
        start = 0
        for j, (a, b, c, d) in enumerate(matches):
            while matches[start][1] + max_gap + size < a:
                start += 1
            top, from_ = (b - a + 1, a, c), -1
            for i in range(start, j):
                _, y, _, z = matches[i]
                if y < b and z < d and a - y - 1 <= max_gap and c - z - 1 <= max_gap:
                    gained = min(b - max(a - 1, y), d - max(c - 1, z))
                    if best[i][0] + gained > top[0]:
                        top, from_ = (best[i][0] + gained, best[i][1], best[i][2]), i
            best.append(top)
            if from_ >= 0:
                continued[from_] = True
        return [(covered / size, covered, t, first, matches[j][1], tfirst, matches[j][3])
                for j, (covered, first, tfirst) in enumerate(best)
                if not continued[j] and covered >= min_share * size]

    def scan(self, text: str | None, max_gap: int, min_share: float) -> tuple:
        words = words_of(text)
        found, matches = self.stream(words)
        chains = [c for t, m in enumerate(matches) if m
                  for c in self.chains(t, m, max_gap, min_share)]
        # The more words first, then the greater share, then reading order.
        chains.sort(key=lambda c: (-c[1], -c[0], c[3], c[4], self.labels[c[2]], c[2]))
        taken: list[tuple[int, int]] = []
        spans = []
        for share, covered, t, first, last, tfirst, tlast in chains:
            k = bisect_left(taken, (first, -1))
            if (k < len(taken) and taken[k][0] <= last) or (k and taken[k - 1][1] >= first):
                continue
            insort(taken, (first, last))
            spans.append({"label": self.labels[t], "first": first, "last": last,
                          "template_first": tfirst, "template_last": tlast,
                          "covered": covered, "share": share})
        spans.sort(key=lambda s: s["first"])
        starts = [s for s, _ in found]
        base = sorted({self.phrases[k][0] for _, k in found})
        labels = sorted({*base, *(s["label"] for s in spans)})
        return (len(words), len(found), min(starts, default=None), max(starts, default=None),
                ",".join(base), ",".join(labels), max((s["share"] for s in spans), default=0.0),
                spans)


OUTPUT = (f"n_words long, n_base long, first_word long, last_word long, base_labels string, "
          f"labels string, score double, spans {SPAN}")
NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
         pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                             ("template_first", pa.int32()), ("template_last", pa.int32()),
                             ("covered", pa.int32()), ("share", pa.float64())])))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
         phrases: list[tuple[str, str]] = PHRASES, text: str = "text",
         keep: tuple[str, ...] = ("doc_id",), min_match: int = MIN_MATCH,
         max_gap: int = MAX_GAP, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per input row: the kept columns, counts and places of phrases, labels and spans.

    Templates and phrases are (label, text). Places are word numbers from 0, ends included.
    """
    if clash := {k.lower() for k in keep} & set(NAMES):
        raise ValueError(f"columns named twice: {sorted(clash)}")
    kept, plain, types, back = aside(docs, keep)
    n = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, phrases, min_match)
        for batch in batches:
            done = [automaton.scan(value.as_py(), max_gap, min_share) for value in batch.column(n)]
            columns = zip(*done) if done else [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)]
                + [pa.array(list(c), type=kind) for c, kind in zip(columns, TYPES)],
                names=[*plain, *NAMES])

    found = docs.select(*kept, F.col(f"`{text}`").alias("text")).mapInArrow(work, types + OUTPUT)
    return found.select(*back, *NAMES)
