"""Evaluation texts inside a corpus, by a generalised suffix automaton."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
WORDS = 12
#: Words of test items in one automaton (about 760 bytes each in a Python worker); more items make further passes.
BLOCK_WORDS = 250_000
#: A span is removed if it is at least so many words long, or with the document's others covers this share of an item.
SPAN_WORDS, COVERAGE = WORDS, 0.5


#: Runs of Unicode letters and decimal digits; for plain ASCII a pattern that is quicker to match.
WORD = regex.compile(r"[\p{L}\p{Nd}]+")
ASCII_WORD = re.compile(r"[0-9a-z]+")


def words_of(text: str | None) -> list[str]:
    """The words of ``text`` in lower case."""
    if not text:
        return []
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return [w.lower() for w in WORD.findall(text)]


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``next`` maps a state and word id to a state; ``link`` and ``length`` are
    the suffix links and longest lengths. ``top[s]`` is the state on the
    suffix path of ``s`` that stands for its last ``words`` words (or -1), and
    ``items[t]`` the items in which the words of ``t`` occur. Items of fewer
    words are kept beside it, by length and words, if ``short``.
    """

    def __init__(self, sequences: Iterable[tuple[str, list[str]]], words: int = WORDS, short: bool = False):
        self.words = words
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.sizes: dict[str, int] = {}
        self.short: dict[int, dict[tuple[str, ...], set[str]]] = {}
        ends: list[tuple[int, str]] = []
        for item, sequence in sequences:
            last = 0
            self.sizes[item] = max(len(sequence), self.sizes.get(item, 0))
            if len(sequence) < words:
                if short and sequence:
                    self.short.setdefault(len(sequence), {}).setdefault(tuple(sequence), set()).add(item)
                continue
            for w in sequence:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                ends.append((last, item))
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.top = [-1] * len(order)
        for s in order:  # a suffix link has a smaller length, so it comes first
            up = self.link[s]
            if up >= 0:
                self.top[s] = self.top[up] if self.top[up] >= 0 else (s if self.length[s] >= words else -1)
        self.items: dict[int, set[str]] = {}
        for s, item in ends:
            if self.top[s] >= 0:
                self.items.setdefault(self.top[s], set()).add(item)

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # the sequences before have it
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._add(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        twin = self._add(self.length[p] + 1)
        self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position, longest matching length, top state) where the last ``self.words`` words up to there occur in an item.

        Words that no item has set the automaton back, so only runs of known
        words of at least that length are walked.
        """
        get = self.vocabulary.get
        ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        stops = np.flatnonzero(ids == 0)
        starts, ends = np.concatenate([[0], stops + 1]), np.concatenate([stops, [len(ids)]])
        long = np.flatnonzero(ends - starts >= self.words)
        nexts, link, length, top, least = self.next, self.link, self.length, self.top, self.words
        for i in long.tolist():
            state, n, at = 0, 0, int(starts[i])
            for w in ids[starts[i] : ends[i]].tolist():
                while state and w not in nexts[state]:
                    state = link[state]
                    n = length[state]
                if w in nexts[state]:
                    state, n = nexts[state][w], n + 1
                if n >= least:
                    # the state holds n words or more, its suffix path all shorter ones
                    yield at, n, top[state]
                at += 1

    def found(self, words: list[str]) -> dict[str, int]:
        """item -> the longest run of ``words`` each ``self.words`` of which it has."""
        out: dict[str, int] = {}
        runs: dict[str, tuple[int, int]] = {}
        for at, _, t in self.matches(words):
            for item in self.items.get(t, ()):
                before, size = runs.get(item, (-2, 0))
                size = size + 1 if before == at - 1 else self.words
                runs[item] = (at, size)
                out[item] = max(out.get(item, 0), size)
        for n, known in self.short.items():
            for run in set(zip(*(words[i:] for i in range(n)))) & known.keys():
                for item in known[run]:
                    out[item] = max(out.get(item, 0), n)
        return out


def _blocks(items: DataFrame, item: str, text: str, words: int) -> Iterator[list[tuple[str, str]]]:
    """(id, text) of the items in blocks of about BLOCK_WORDS words, items of fewer than ``words`` left out."""
    part, n = [], 0
    rows = items.select(F.col(item).cast("string"), text).filter(F.col(text).isNotNull()).distinct().orderBy(item, text)
    for name, t in rows.toLocalIterator():
        size = len(words_of(t))
        if size < words:
            continue
        part.append((name, t))
        n += size
        if n >= BLOCK_WORDS:
            yield part
            part, n = [], 0
    if part:
        yield part


_built: tuple[str, Automaton] | None = None


def _automaton(block: str, part: list[tuple[str, str]], words: int) -> Automaton:
    """The automaton of a block; a Python worker builds it once and holds one at a time."""
    global _built
    if _built is None or _built[0] != block:
        _built = None  # the former goes before the next is built
        _built = block, Automaton(((name, words_of(t)) for name, t in part), words, True)
    return _built[1]


def _shared(items: DataFrame, item: str, text: str, words: int, least: int) -> Iterator[tuple[str, Broadcast]]:
    """A name and the broadcast items of each block. The driver holds their texts, never an automaton."""
    for part in _blocks(items, item, text, least):
        yield f"{uuid.uuid4().hex}/{words}", items.sparkSession.sparkContext.broadcast(part)


def leaks(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, words: int = WORDS, short: bool = False
) -> DataFrame:
    """``key``, item_id, n_words, coverage: documents and the items of which they have ``words`` consecutive words.

    n_words is the longest shared run, coverage its share of the item's words.
    Words are runs of Unicode letters and digits in lower case. With ``short``
    items of fewer words are found as well, where a document has them whole;
    else they and null texts share none. Items with one id and several texts
    count under that id; repeated documents give rows each; no corpus shuffle.
    Items are broadcast in blocks of BLOCK_WORDS, of which each Python worker
    builds one automaton at a time; every block is a pass over the corpus.
    """
    kind = dict(corpus.dtypes)[key]
    rows = corpus.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("length(text) > 0")
    schema = f"key {kind}, item_id string, n_words int, coverage double"
    out = None
    for block, shared in _shared(items, item, item_text, words, 1 if short else words):

        def run(batches: Iterator[pa.RecordBatch], block=block, shared=shared) -> Iterator[pa.RecordBatch]:
            a = _automaton(block, shared.value, words)
            for batch in batches:
                at, ids, longest = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for name, n in sorted(a.found(words_of(t)).items()):
                        at.append(i)
                        ids.append(name)
                        longest.append(n)
                cover = [min(1.0, n / a.sizes[x]) for n, x in zip(longest, ids)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.string()), pa.array(longest, pa.int32()), pa.array(cover, pa.float64())],
                    names=["key", "item_id", "n_words", "coverage"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = corpus.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("key", key)


def cleaned(corpus: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, words: int = SPAN_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """``key``, n_spans, n_chars and the text without leaked spans, for the documents that have some.

    A span is a maximal run of words that an item shares; it goes if it has at
    least ``words`` words, or at least WORDS and its item's spans cover
    ``coverage`` of it. Blocks of items are applied one after the other, so
    each document is read once per block of BLOCK_WORDS.
    """
    kind = dict(corpus.dtypes)[key]
    rows = corpus.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, text string, n_spans int, n_chars long"
    rows = rows.filter("length(text) > 0").withColumn("n_spans", F.lit(0)).withColumn("n_chars", F.lit(0).cast("long"))
    for block, shared in _shared(items, item, item_text, min(words, WORDS), min(words, WORDS)):

        def run(batches: Iterator[pa.RecordBatch], block=block, shared=shared) -> Iterator[pa.RecordBatch]:
            a = _automaton(block, shared.value, min(words, WORDS))
            for batch in batches:
                got = [_without_spans(a, *r, words, coverage) for r in zip(*(c.to_pylist() for c in batch.columns[1:]))]
                texts, spans, chars = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.int32()), pa.array(chars, pa.int64())],
                    names=["key", "text", "n_spans", "n_chars"],
                )

        rows = rows.select("key", "text", "n_spans", "n_chars").mapInArrow(run, schema)
    out = rows.filter("n_spans > 0").select("key", "n_spans", "n_chars", "text")
    return out.withColumnRenamed("key", key).withColumnRenamed("text", text)


def _without_spans(a: Automaton, text: str, spans: int, chars: int, words: int, coverage: float) -> tuple[str, int, int]:
    places = [m.span() for m in WORD.finditer(text)]
    runs: list[list] = []  # first and last word, items
    for at, _, t in a.matches([text[x:y].lower() for x, y in places]):
        if runs and runs[-1][1] >= at - 1:
            runs[-1][1] = at
            runs[-1][2] |= a.items.get(t, set())
        else:
            runs.append([at - a.words + 1, at, set(a.items.get(t, ()))])
    cover: dict[str, int] = {}
    for first, last, names in runs:
        for x in names:
            cover[x] = cover.get(x, 0) + last - first + 1
    keep, at = [], 0
    for first, last, names in runs:
        if last - first + 1 >= words or any(cover[x] >= coverage * a.sizes[x] for x in names):
            keep.append(text[at : places[first][0]])
            at = places[last][1]
            spans, chars = spans + 1, chars + at - places[first][0]
    return "".join(keep) + text[at:] if keep else text, spans, chars


def longest_runs(found: DataFrame, key: str) -> DataFrame:
    """item_id, n_docs, max_words: in how many documents each item leaked, and its longest run."""
    return found.groupBy("item_id").agg(F.countDistinct(key).alias("n_docs"), F.max("n_words").alias("max_words"))
