"""License scans by matching statistics over a generalised suffix automaton of licence words.

The automaton holds all notices and phrases. A text is streamed through it word by word; after each word the state and
the match length are the longest run of words, ending there, that stands anywhere in a notice, and the state's suffix
links give the longest run for every other notice. Runs that cannot be extended within their notice and are long enough are
chained, notice by notice, into spans: in order in both the text and the notice,
with few words between. A span that covers enough of its notice gives its label. Phrases are read off the same
states: a phrase ends at a word if its state is the current one or one of its suffix links.

Words are lower-cased over A-Z only. Null and empty texts have no words, no labels and score 0. Repeated rows give
repeated results; extra columns are not read; an empty table gives an empty one. Score is the largest covered share
of any notice or phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, text_or_empty
from tieout.llm.license_texts import NOTICES, PHRASES

#: Over UTF-8 bytes: all bytes beyond ASCII are of words.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of the shortest run that is chained, or a whole shorter notice.
LEAST_RUN = 4
#: Words that may stand in the text between two runs of a span.
MOST_GAP = 8
#: Share of a notice that a span must cover.
LEAST_COVER = 0.6
BATCH = 512


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for k, words in enumerate(sequences):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, []).append(at)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for k, places in self.ends[v].items():
                self.ends[self.link[v]].setdefault(k, []).extend(places)
        for own in self.ends:
            for places in own.values():
                places.sort()

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state of the strings of q that are p's longest and word."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def state_of(self, words: list[bytes]) -> int:
        v = 0
        for w in words:
            v = self.next[v][w]
        return v


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...], least_run: int, most_gap: int, least_cover: float):
        self.labels = [x for x, _ in notices]
        self.notices = [words_of(x) for _, x in notices]
        self.phrases = [(words_of(x), label) for x, label in phrases]
        self.least_run, self.most_gap, self.least_cover = least_run, most_gap, least_cover
        self.shortest = min([least_run, *map(len, self.notices)])
        self.automaton = a = Automaton(self.notices + [w for w, _ in self.phrases])
        own: dict[int, list[int]] = {}
        for k, (words, _) in enumerate(self.phrases):
            own.setdefault(a.state_of(words), []).append(k)
        #: Phrases that end in each state, as (words, phrase).
        self.ending: dict[int, list[tuple[int, int]]] = {}
        for v in range(len(a.link)):
            found, u = [], v
            while u > 0:
                found += [(len(self.phrases[k][0]), k) for k in own.get(u, [])]
                u = a.link[u]
            if found:
                self.ending[v] = found
        #: For each state the notices that stand there or along its suffix links: (notice, longest suffix, the state of it).
        self.by_notice: list[list[tuple[int, int, int]]] = []
        for v in range(len(a.link)):
            own_notices, u = {}, v
            while u > 0:
                for k in a.ends[u]:
                    if k < len(self.notices) and a.length[u] >= self.least(k):
                        own_notices.setdefault(k, (a.length[u], u))
                u = a.link[u]
            self.by_notice.append([(k, n, u) for k, (n, u) in own_notices.items()])

    def least(self, notice: int) -> int:
        """Words of a run of a notice."""
        return min(self.least_run, len(self.notices[notice]))

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
        """Runs that cannot be extended within their notice, as (last word, length, notice, state), and phrases as (first word, phrase)."""
        move, link, length, ending = self.automaton.next, self.automaton.link, self.automaton.length, self.ending
        root, shortest, by_notice = move[0], self.shortest, self.by_notice
        runs, found, state, n = [], [], 0, 0
        before: dict[int, tuple[int, int]] = {}  # notice: length and state of its run up to the last word

        def follow(i: int) -> None:
            """Runs up to word i; those up to the word before that do not go on have ended."""
            nonlocal before
            now = {k: (min(n, most), u) for k, most, u in by_notice[state] if min(n, most) >= self.least(k)} if n >= shortest else {}
            for k, (size, u) in before.items():
                if k not in now or now[k][0] <= size:
                    runs.append((i - 1, size, k, u))
            before = now

        for i, w in enumerate(words):
            if not state:
                state = root.get(w, 0)
                n = 1 if state else 0
            else:
                to = move[state].get(w)
                if to is None:
                    while state and w not in move[state]:
                        state = link[state]
                    n, to = length[state], move[state].get(w, 0)
                    if not to:
                        n = -1
                state, n = to, n + 1
            if before or n >= shortest:
                follow(i)
            if state in ending:
                found += [(i - size + 1, k) for size, k in ending[state] if n >= size]
        state, n = 0, 0
        follow(len(words))
        return runs, found

    def spans(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered share) of the spans that cover enough."""
        chains: dict[int, list[int]] = {}  # notice: first and last word in the text, last in the notice, covered
        spans = []

        def close(k: int) -> None:
            first, last, _, covered = chains.pop(k)
            if covered >= self.least_cover * len(self.notices[k]):
                spans.append((self.labels[k], first, last, covered / len(self.notices[k])))

        for last, n, k, state in runs:
            places = self.automaton.ends[state][k]
            if k in chains:
                chain = chains[k]
                # what the runs share, in the text or in the notice, counts once
                at = next((p for p in places if p > chain[2]), None)
                new = 0 if at is None else min(n, at - chain[2], last - chain[1])
                if new > 0 and last - n - chain[1] <= self.most_gap:
                    chains[k] = [chain[0], last, at, chain[3] + new]
                    continue
                close(k)
            chains[k] = [last - n + 1, last, places[0], n]
        for k in list(chains):
            close(k)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        runs, found = self.runs(words)
        spans = self.spans(runs)
        base = {self.phrases[k][1] for _, k in found}
        return {
            "n_words": len(words),
            "n_base": len(found),
            "first_word": min((p for p, _ in found), default=None),
            "last_word": max((p for p, _ in found), default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[0] for s in spans})),
            "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
            "spans": [dict(zip(("label", "first", "last", "cover"), s)) for s in spans],
        }


@cache
def scanner(*parameters) -> Scanner:
    return Scanner(*parameters)


RESULT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))),
    ]
)
RESULT_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first: long, last: long, cover: double>>"
)


def _scan_batches(batches: Iterator[pa.RecordBatch], parameters: tuple) -> Iterator[pa.RecordBatch]:
    own = scanner(*parameters)
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            found = pa.RecordBatch.from_pylist([own.scan(t) for t in batch.column("text").to_pylist()], RESULT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found.columns], ["doc_id", *RESULT.names])


def scan(
    docs: DataFrame,
    notices: list[tuple[str, str]] = NOTICES,
    phrases: dict[str, str] = PHRASES,
    least_run: int = LEAST_RUN,
    most_gap: int = MOST_GAP,
    least_cover: float = LEAST_COVER,
) -> DataFrame:
    """Rows (doc_id, counts, labels, score, spans) of documents (doc_id, text); one pass, no shuffle."""
    parameters = (tuple(notices), tuple(phrases.items()), least_run, most_gap, least_cover)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return bounded_batches(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(
        partial(_scan_batches, parameters=parameters), f"doc_id {id_type}, {RESULT_DDL}"
    )


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.to_json("spans").alias("spans")
    )
