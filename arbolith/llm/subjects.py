"""Subject areas of documents: classifier chains over term, source and structure features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.storage import materialize

#: At most so many labelled documents are fitted on, the first by a hash of their id.
MAX_LABELLED = 20_000
#: and at most so many characters of them all, which is what the driver holds.
MAX_CHARS = 100_000_000
#: A term belongs to a subject if, over at least DOCS documents, the lower bound of the share of its documents
#: with that subject reaches SHARE, and the odds of that share are LIFT times those of the subject's own share.
SHARE, LIFT, DOCS = 0.3, 4.0, 3
FOLDS, BEAM, RIDGE = 4, 8, 1.0  # parts to cross-fit by, width of the search, weight of the penalty
#: Sources and languages with a feature of their own: the most frequent ones of the labelled documents.
CATEGORIES = 12

#: Parts of names and words, and what ends a place: a line, a statement or a block.
TOKEN = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|[\n;{}]")
ENDS = dict.fromkeys("\n;{}", -1)


def terms_of(text: str | None) -> set[str]:
    """The distinct terms of ``text`` in lower case: camel case, snake case and prose alike."""
    return {w.lower() for w in TOKEN.findall(text or "")} - ENDS.keys()


#: Columns of :func:`evidence`.
EVIDENCE = 7


def evidence(text: str | None, lexicon: dict[str, int], subject: np.ndarray, n: int) -> np.ndarray:
    """For every subject: distinct terms, places, occurrences, share of the commonest term, share of all; and tokens, places.

    ``lexicon`` gives a term's number from 1, ``subject`` the subject (below ``n``) of each number.
    """
    out = np.zeros((n, 5))
    words = TOKEN.findall(text or "")
    ids = np.fromiter(map(lexicon.get, map(str.lower, words), repeat(0)), np.int32, len(words))
    ends = ids == -1
    at = np.flatnonzero(ids > 0)
    size = np.array([np.log1p(len(ids) - ends.sum()), np.log1p(ends.sum())])
    if not len(at):
        return np.hstack([out, np.tile(size, (n, 1))])
    place = np.cumsum(ends)[at]
    term, count = np.unique(ids[at], return_counts=True)
    s = subject[term]
    distinct, total = np.bincount(s, minlength=n), np.bincount(s, count, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, s, count)
    pairs = np.unique(subject[ids[at]].astype(np.int64) * (int(place[-1]) + 1) + place)
    places = np.bincount(pairs // (int(place[-1]) + 1), minlength=n)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(distinct), np.log1p(places), np.log1p(total)
    out[:, 3] = top / np.maximum(total, 1)
    out[:, 4] = total / total.sum()
    return np.hstack([out, np.tile(size, (n, 1))])


def _lexicon(docs: np.ndarray, per: np.ndarray, having: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, their subjects), by the lower end of the 95 % interval of a term's documents' share with a subject.

    ``docs`` counts documents by term, ``per`` by term and subject, ``having`` by subject.
    """
    s = per.argmax(axis=1)
    k = np.maximum(docs, 1)
    p, z = per[np.arange(len(s)), s] / k, 1.96
    low = (p + z * z / (2 * k) - z * np.sqrt(p * (1 - p) / k + z * z / (4 * k * k))) / (1 + z * z / k)
    base = having[s] / max(1, n)
    good = np.flatnonzero((docs >= DOCS) & (low >= SHARE) & (p * (1 - base) >= LIFT * base * (1 - p)))
    return good, s[good]


def _newton(rows, target, width: int, columns, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Weights of logistic regressions that share columns: block i has the columns ``columns[i]`` of all ``width``."""
    w = np.zeros(width)
    for _ in range(rounds):
        grad, h = ridge * w, ridge * np.eye(width)
        for x, y, c in zip(rows, target, columns):
            p = 1 / (1 + np.exp(-np.clip(x @ w[c], -30, 30)))
            grad[c] += x.T @ (p - y)
            h[np.ix_(c, c)] += (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared weights, constants, links) of the chain's classifiers; ``x`` documents x subjects x features."""
    n, k, width = x.shape
    at = width + k + np.concatenate([[0], np.cumsum(np.arange(k))])
    columns = [np.r_[0:width, width + j, at[j] : at[j + 1]].astype(int) for j in range(k)]
    rows = [np.hstack([x[:, j], np.ones((n, 1)), y[:, :j]]) for j in range(k)]
    w = _newton(rows, list(y.T), int(at[-1]), columns)
    links = np.zeros((k, k))
    for j in range(k):
        links[j, :j] = w[at[j] : at[j + 1]]
    return w[:width], w[width : width + k], links


@dataclass
class SubjectModel:
    subjects: list[str]
    lexicon: dict[str, int]
    term_subject: np.ndarray
    categories: dict[str, int]
    weights: np.ndarray
    constants: np.ndarray
    links: np.ndarray
    scale: tuple[float, float]

    def features(self, text: str | None, source: str | None, lang: str | None) -> np.ndarray:
        return _features(text, source, lang, self.lexicon, self.term_subject, self.categories, len(self.subjects))

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Documents x subjects, without what the labels before add."""
        return x @ self.weights + self.constants

    def decode(self, logits: np.ndarray) -> np.ndarray:
        """Documents x subjects (bool): the best label combination by beam search along the chain."""
        n, k = logits.shape
        a, b = self.scale
        labels = np.zeros((n, 1, k))
        score = np.zeros((n, 1))
        for j in range(k):
            z = a * (logits[:, None, j] + labels @ self.links[j]) + b
            no, yes = -np.logaddexp(0, z), -np.logaddexp(0, -z)
            with_j = labels.copy()
            with_j[:, :, j] = 1
            labels = np.concatenate([labels, with_j], axis=1)
            score = np.concatenate([score + no, score + yes], axis=1)
            if score.shape[1] > BEAM:
                best = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
                labels = np.take_along_axis(labels, best[:, :, None], axis=1)
                score = np.take_along_axis(score, best, axis=1)
        first = score.argmax(axis=1)
        return labels[np.arange(n), first] > 0


def _features(text, source, lang, lexicon, term_subject, categories, k) -> np.ndarray:
    own = np.zeros((k, EVIDENCE))
    got = evidence(text, lexicon, term_subject, k)
    own[: len(got)] = got
    has = np.zeros(len(categories))
    for key in (f"source={source}", f"lang={(lang or '').lower()}"):
        if key in categories:
            has[categories[key]] = 1
    return np.hstack([own, np.tile(has, (k, 1))])


def fit(rows: Sequence[tuple[str | None, str | None, str | None, Sequence[str]]], subjects: Sequence[str]) -> SubjectModel:
    """Fit on (text, source, lang, subjects) of labelled documents.

    The chain goes from the most frequent subject to the rarest. All its
    classifiers share the weights of the evidence; each has a constant and
    weights of the labels before it, which is the co-occurrence. Features are
    made with a lexicon of the other folds, and the scores are calibrated on
    decisions about documents that took no part in the fit.
    """
    frequent = Counter(s for *_, labels in rows for s in labels)
    order = sorted(subjects, key=lambda s: (-frequent[s], s))
    number = {s: i for i, s in enumerate(order)}
    n, k = len(rows), len(order)
    fold = np.arange(n) % FOLDS
    y = np.zeros((n, k))
    for i, (*_, labels) in enumerate(rows):
        y[i, [number[s] for s in labels]] = 1
    df = Counter(t for text, *_ in rows for t in terms_of(text))
    names = sorted(t for t, c in df.items() if c >= DOCS)
    at = {t: i for i, t in enumerate(names)}
    docs, per = np.zeros((FOLDS, len(names))), np.zeros((FOLDS, len(names), k))
    for i, (text, *_) in enumerate(rows):
        own = [at[t] for t in terms_of(text) if t in at]
        docs[fold[i], own] += 1
        for s in np.flatnonzero(y[i]):
            per[fold[i], own, s] += 1

    def without(f: int) -> tuple[dict[str, int], np.ndarray]:
        """The lexicon of all folds but ``f``: term numbers from 1, and the subject of each number."""
        use = np.arange(FOLDS) != f
        mine = np.isin(fold, np.flatnonzero(use))
        terms, of = _lexicon(docs[use].sum(axis=0), per[use].sum(axis=0), y[mine].sum(axis=0), int(mine.sum()))
        return {names[t]: i + 1 for i, t in enumerate(terms)} | ENDS, np.concatenate([[0], of]).astype(int)

    seen = Counter(f"source={r[1]}" for r in rows).most_common(CATEGORIES)
    seen += Counter(f"lang={(r[2] or '').lower()}" for r in rows).most_common(CATEGORIES)
    categories = {c: i for i, (c, _) in enumerate(seen)}
    lexicon, term_subject = without(-1)
    model = SubjectModel(order, lexicon, term_subject, categories, np.zeros(EVIDENCE + len(categories)), np.full(k, -10.0), np.zeros((k, k)), (1.0, 0.0))
    if n < 2 * FOLDS or not y.any() or len(term_subject) < 2:
        return model  # nothing to learn from: no subjects
    lexicons = [without(f) for f in range(FOLDS)]
    x = np.array([_features(*r[:3], *lexicons[fold[i]], categories, k) for i, r in enumerate(rows)])
    part = fold != 0
    weights, constants, links = _chain(x[part], y[part])
    z = (x[~part] @ weights + constants + y[~part] @ links.T).ravel()
    a, b = _newton([np.stack([z, np.ones_like(z)], axis=1)], [y[~part].ravel()], 2, [np.arange(2)], 1e-2)
    if a > 0:
        model.scale = (float(a), float(b))
    model.weights, model.constants, model.links = _chain(x, y)
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: Sequence[str], limit: int = MAX_LABELLED, chars: int = MAX_CHARS) -> list[tuple]:
    """(text, source, lang, subjects) of at most ``limit`` labelled documents of at most ``chars`` characters in all.

    Labels are matched to ``subjects`` without case and outer white space;
    others are ignored, repeated rows count once, and null means none. The
    documents come in the order of a hash of their id until a bound is met.
    """
    known = {s.strip().lower(): s for s in subjects}
    name = F.lower(F.trim(F.col("subject")))
    per = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(name.isin(list(known)), name))).alias("names"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    per = per.orderBy(*order).limit(limit)  # at most ``limit`` rows of at most all subjects, so a broadcast is bounded
    got = documents.select("doc_id", "text", "source", "lang").join(F.broadcast(per), "doc_id")
    got = materialize(got.withColumn("at", F.xxhash64("doc_id")), "labelled")
    sizes = [(r[0], r[1] or 0) for r in got.select("at", F.length("text")).orderBy("at", "doc_id").collect()]
    total = np.cumsum([n for _, n in sizes])
    if len(total) and total[-1] > chars:
        got = got.filter(F.col("at") < sizes[int(np.searchsorted(total, chars, side="right"))][0])
    rows = got.orderBy("at", "doc_id").select("text", "source", "lang", "names").collect()
    return [(r[0], r[1], r[2], [known[x] for x in r[3]]) for r in rows]


def classify(documents: DataFrame, model: SubjectModel, key: str = "doc_id") -> DataFrame:
    """``key`` and ``subject``, a row per document and subject; no shuffle, one pass in Arrow batches.

    Documents without subject, and null or empty texts, give no row.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts, sources, langs = (c.to_pylist() for c in batch.columns)
            z = np.array([m.logits(m.features(*r)) for r in zip(texts, sources, langs)])
            z[[not (t or "").strip() for t in texts]] = -1e3
            doc, sub = np.nonzero(m.decode(z))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array([m.subjects[i] for i in sub], pa.string())], names=["key", "subject"]
            )

    kind = dict(documents.dtypes)[key]
    rows = documents.select(F.col(key).alias("key"), "text", "source", "lang")
    return rows.mapInArrow(run, f"key {kind}, subject string").withColumnRenamed("key", key)
