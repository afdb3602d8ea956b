"""Toxicity by the nearest labelled examples: exact TF-IDF cosine on a block-max inverted index.

Terms are lower-case words and their beginnings of four and six bytes (which catch inflected and compounded forms).
The vocabulary is every term of the labelled sample; nothing is left out of it.  Document frequencies
are counted over all documents, once each.  An example or a document is the vector of ``(1 + ln tf) * idf ** POWER`` over
the vocabulary's terms, of unit length.

Examples lie in blocks of ``BLOCK``, like next to like (by their nearest pivot, then by their number of terms).  Postings of
rare terms are summed for all examples.  For each of the ``DENSE`` most frequent terms and each block the index has the
largest weight, so the sum so far plus these maxima bounds the similarity to every example of a block.  The blocks of the
largest bounds are summed first; of the others only those whose bound reaches the k-th similarity found are.  The k
nearest are therefore exact; how terms and blocks are split changes no result.  Similarities are
rounded to five decimals, and of equal ones the example with the smaller doc_id is nearer.

The k nearest examples vote with weights ``1 / (distance + 0.1)``; votes are turned into probabilities by isotonic regression on
leave-one-out votes of the sample.  Documents with no term of the vocabulary get the share of toxic ones
among the sample's documents without any, or in the sample if there are none.  The evidence of a document are its
``EVIDENCE`` nearest examples.

The index is made in one task from ``sample`` labelled documents at most and lies in one file in the shared folder; the driver holds
the distinct terms of the sample and their frequencies only.  A null text has no terms.  A null doc_id is scored like any
other row; rows that repeat are scored each.  Very long texts are read whole, a slice of rows at a time.  Without toxic examples, or with an empty table, nothing
is found.  A score equal to the cut counts as toxic.  Other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.labelled import labelled_sample
from marlstone.llm.store import shared_dir, trimmed, written

SAMPLE = 6_000
DENSE = 2048
BLOCK = 32
BATCH = 64
PIVOTS = 48
SLICE = 1 << 20
NEIGHBOURS = 120
POWER = 1.5
EVIDENCE = 10
CUT = 0.5
STEMS = (4, 6)


class Shared:
    """A value in a file in the shared folder; a process reads it once and holds the last one read."""

    held: dict = {}

    def __init__(self, folder: str, value=None, url: str | None = None):
        self.url = url or f"{folder}/toxicity-{uuid.uuid4().hex}"
        if url:
            return
        where, path = fs.FileSystem.from_uri(self.url)
        with where.open_output_stream(path) as f:
            pickle.dump(value, f, 5)

    @property
    def value(self):
        from marlstone.llm.toxicity import Shared as kept  # the class of the process, whatever was unpickled

        if self.url not in kept.held:
            kept.held.clear()
            where, path = fs.FileSystem.from_uri(self.url)
            with where.open_input_file(path) as f:
                kept.held[self.url] = pickle.load(f)
        return kept.held[self.url]


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word, and of the beginning of longer words."""
    w = tx.Words(raw, offsets, split=True)
    length = w.end - w.start
    h, r = [w.hashes()], [w.row]
    for n in STEMS:
        at = np.flatnonzero(length > n)
        h.append(tx.mix(w.hashes(w.start[at], w.start[at] + n) + np.uint64(n)))
        r.append(w.row[at])
    return np.concatenate(r), np.concatenate(h)


class Vocabulary:
    """Numbers of known hashes, found through a small filter first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.hashes >> np.uint64(42)] = True

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, frequency) sorted by row and term."""
        row, h = terms(raw, offsets)
        near = self.filter[h >> np.uint64(42)]
        row, h = row[near], h[near]
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        key, n = np.unique(row[hit] * len(self.hashes) + at[hit], return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), n


def batch_counts(column: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, row from the first on, term, frequency) of each slice of a text column."""
    raw, offsets = tx.text_buffers(column)
    for i, j in tx.slices(offsets, SLICE):
        yield i, j, *vocabulary.counts(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


@dataclass
class Index:
    """Examples by term: those of term t are ``who[first[t] : first[t + 1]]``, with their weights; ``column`` numbers the frequent terms (-1: none).

    ``edges`` are the first examples of the blocks; ``most`` has the largest weight of each frequent term in each block.
    """

    first: np.ndarray
    who: np.ndarray
    weight: np.ndarray
    column: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    edges: np.ndarray
    made: tuple | None = None

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """For each block its (frequent term, example) weights, and (frequent term, block) maxima; made once in each process."""
        if self.made is None:
            at = np.flatnonzero(self.column >= 0)
            size = int(self.edges[1]) if len(self.edges) > 1 else len(self.ids)
            table = np.zeros((len(self.edges), len(at), size), np.float32)
            for t in at:
                part = slice(self.first[t], self.first[t + 1])
                block, place = np.divmod(self.who[part], size)
                table[block, self.column[t], place] = self.weight[part]
            self.made = table, np.ascontiguousarray(table.max(2).T)
        return self.made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}


def tfidf(row: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of unit length for each row; entries come sorted by row."""
    w = (1 + np.log(n)) * idf[term]
    if not len(w):
        return w
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    norm = np.sqrt(np.add.reduceat(w * w, edge))
    return w / np.repeat(norm, np.diff(np.append(edge, len(w))))


def _neighbourly(row: np.ndarray, term: np.ndarray, weight: np.ndarray, column: np.ndarray, top: int, ids: np.ndarray) -> np.ndarray:
    """An order of the examples that puts like ones together."""
    n = len(ids)
    pivots = np.unique(np.linspace(0, n - 1, PIVOTS).astype(int))
    place = np.full(n, -1)
    place[pivots] = np.arange(len(pivots))
    hit = column[term] >= 0
    row, col, w = row[hit], column[term[hit]], weight[hit]
    own = place[row] >= 0
    table = np.zeros((top, len(pivots)), np.float32)
    table[col[own], place[row[own]]] = w[own]
    near = np.zeros((n, len(pivots)), np.float32)
    for a in range(0, n, 1024):
        i, j = np.searchsorted(row, [a, a + 1024])
        part = np.zeros((min(1024, n - a), top), np.float32)
        part[row[i:j] - a, col[i:j]] = w[i:j]
        near[a : a + 1024] = part @ table
    return np.lexsort((ids, np.bincount(row, minlength=n), near.argmax(1)))


def build(row: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, toxic: np.ndarray, size: int, dense: int = DENSE, block: int = BLOCK) -> Index:
    """Rows are numbered from 0 and come sorted; at most ``dense`` terms are held as a table."""
    df = np.bincount(term, minlength=size)
    column = np.full(size, -1, np.int32)
    top = np.argsort(-df, kind="stable")[:dense]
    top = top[df[top] > 0]
    column[top] = np.arange(len(top))
    order = _neighbourly(row, term, weight, column, len(top), ids)
    new = np.empty(len(ids), np.int32)
    new[order] = np.arange(len(ids))
    by_term = np.argsort(term, kind="stable")
    return Index(np.concatenate([[0], np.cumsum(df)]), new[row[by_term]], weight[by_term].astype(np.float32), column, ids[order], toxic[order], np.arange(0, len(ids), block))


def nearest(index: Index, row: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, example numbers, similarities) of the k nearest examples, exactly; -1 where there are fewer.

    Entries come sorted by row.  ``skip`` has an example's number to leave out for each query, or -1.
    ``seen`` gets the share of (query, block) pairs that were summed.
    """
    queries, begin = np.unique(row, return_index=True)
    finish = np.append(begin[1:], len(row))
    n, examples = len(queries), len(index.ids)
    best = np.zeros((n, k), np.float32)
    who = np.full((n, k), -1, np.int64)
    if not n or not examples:
        return queries, who, best
    table, most = index.dense()
    edges = np.append(index.edges, examples)
    number, column, weight = np.repeat(np.arange(n), finish - begin), index.column[term], weight.astype(np.float32)
    ahead = min(2 * -(-k // max(int(edges[1]), 1)), len(edges) - 1)
    for a in range(0, n, BATCH):
        z = min(a + BATCH, n)
        part = slice(begin[a], finish[z - 1])
        q, c, w, t = number[part] - a, column[part], weight[part], term[part]
        front = np.zeros((z - a, len(most)), np.float32)
        front[q[c >= 0], c[c >= 0]] = w[c >= 0]
        q, w, t = q[c < 0], w[c < 0], t[c < 0]
        size = index.first[t + 1] - index.first[t]
        at = np.repeat(index.first[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rare = np.bincount(np.repeat(q * examples, size) + index.who[at], np.repeat(w, size) * index.weight[at], (z - a) * examples).reshape(z - a, examples)
        bound = (front @ most + np.maximum.reduceat(rare, index.edges, 1)) * (1 + 1e-5) + 1e-5
        sims = np.full((z - a, examples), -1.0, np.float32)
        todo = np.zeros(bound.shape, bool)
        np.put_along_axis(todo, np.argpartition(-bound, ahead - 1, 1)[:, :ahead], True, 1)
        for wave in range(2):
            for b in np.flatnonzero(todo.any(0)):
                own, cut = np.flatnonzero(todo[:, b]), slice(edges[b], edges[b + 1])
                sims[own, cut] = np.round(rare[own, cut] + (front if len(own) == z - a else front[own]) @ table[b][:, : edges[b + 1] - edges[b]], 5)
            if skip is not None:
                out = np.flatnonzero(skip[a:z] >= 0)
                sims[out, skip[a:z][out]] = -1
            least = np.maximum(np.partition(sims, examples - k, 1)[:, examples - k], 0) if examples > k else np.zeros(z - a)
            if not wave:
                done, todo = todo, (bound >= least[:, None]) & ~todo
        if seen is not None:
            seen.append((done | todo).mean())
        for r in range(z - a):
            found = np.flatnonzero((sims[r] >= least[r]) & (sims[r] > 0))
            found = found[np.lexsort((index.ids[found], -sims[r][found]))[:k]]
            best[a + r, : len(found)], who[a + r, : len(found)] = sims[r][found], found
    return queries, who, best


def votes(index: Index, who: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Distance-weighted share of toxic neighbours."""
    w = np.where(who >= 0, 1 / (np.maximum(1 - sims.astype(float), 0) + 0.1), 0.0)
    return np.minimum((w * index.toxic[who]).sum(1) / np.maximum(w.sum(1), 1e-9), 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from x on, value) of the non-decreasing least-squares fit; pools adjacent violators."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []  # start, sum, count
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        steps.append([a, b, 1])
        while len(steps) > 1 and (steps[-2][0] == steps[-1][0] or steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]):
            last = steps.pop()
            steps[-1][1] += last[1]
            steps[-1][2] += last[2]
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.5) / (s[2] + 1) for s in steps])


def calibrated(curve: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    return curve[1][np.clip(np.searchsorted(curve[0], x, "right") - 1, 0, None)]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each slice."""
    for batch in batches:
        raw, offsets = tx.text_buffers(batch.column(1))
        for i, j in tx.slices(offsets, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(terms(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1]).astype(np.int64))], names=["term"])


def _frequencies(sent: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, docs = Vocabulary(sent.value), 0
        df = np.zeros(len(sent.value), np.int32)
        for batch in batches:
            for _, _, _, term, _ in batch_counts(batch.column(0), vocabulary):
                np.add.at(df, term, 1)
            docs += batch.num_rows
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], docs).astype(np.int64))], names=["term", "df"])

    return run


@dataclass
class Model:
    hashes: np.ndarray
    idf: np.ndarray
    index: Index


def _indexed(known: Shared, folder: str):
    """Make the index of all examples, which come in one task, write it, and return where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, idf = known.value
        vocabulary, found, ids, toxic, base = Vocabulary(hashes), [], [], [], 0
        for batch in batches:
            for i, _, row, term, n in batch_counts(batch.column(1), vocabulary):
                found.append(((row + (base + i)).astype(np.int32), term.astype(np.int32), tfidf(row, term, n, idf).astype(np.float32)))
            ids.append(batch.column(0).to_numpy().astype(np.int64))
            toxic.append(batch.column(2).to_numpy().astype(float))
            base += batch.num_rows
        if not base:
            return
        row, term, weight = (np.concatenate([f[c] for f in found]) for c in range(3))
        del found
        ids, toxic = np.concatenate(ids), np.concatenate(toxic)
        model = Model(hashes, idf, build(row, term, weight, ids, toxic, len(hashes)))
        yield pa.RecordBatch.from_arrays([pa.array([Shared(folder, model).url])], names=["url"])

    return run


def _left_out(sent: Shared):
    """The votes for examples, each without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        vocabulary, place = Vocabulary(model.hashes), {d: i for i, d in enumerate(model.index.ids.tolist())}
        for batch in batches:
            ids, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, _, row, term, n in batch_counts(batch.column(1), vocabulary):
                skip = np.array([place[d] for d in ids[i + np.unique(row)].tolist()], np.int64)
                queries, who, sims = nearest(model.index, row, term, tfidf(row, term, n, model.idf), NEIGHBOURS, skip)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + queries]), pa.array(votes(model.index, who, sims)), pa.array(y[i + queries].astype(float))], names=["doc_id", "vote", "y"])

    return run


@dataclass
class Fitted:
    model: Shared
    curve: tuple[np.ndarray, np.ndarray]
    rest: float


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted | None:
    """Index and calibration from the sample, IDF from all documents; None without toxic examples."""
    lower, folder = docs.select("doc_id", F.lower("text").alias("text")), shared_dir(docs.sparkSession)
    own = written(labelled_sample(lower, labels, "toxic", sample), "examples")
    if own.where("y = 1").isEmpty():
        return None
    hashes = np.sort(own.mapInArrow(_distinct, "term long").distinct().toArrow()["term"].to_numpy().view(np.uint64))  # the terms of ``sample`` rows
    counted = lower.select("text").mapInArrow(_frequencies(Shared(folder, hashes)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most one row a term
    df = np.zeros(len(hashes) + 1, np.int64)  # the last is the number of documents
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    del counted
    idf = ((np.log((1 + df[-1]) / (1 + df[:-1])) + 1) ** POWER).astype(np.float32)
    url = own.repartition(1).mapInArrow(trimmed(_indexed(Shared(folder, (hashes, idf)), folder)), "url string").first()["url"]
    model = Shared(folder, url=url)
    voted = own.mapInArrow(_left_out(model), "doc_id long, vote double, y double").toPandas().sort_values("doc_id")  # ``sample`` rows
    curve = isotonic(voted["vote"].to_numpy(), voted["y"].to_numpy()) if len(voted) else (np.zeros(1), np.zeros(1))
    bare = own.count() - len(voted)
    share = own.agg(F.avg("y")).first()[0]
    without = (own.where("y = 1").count() - voted["y"].sum() + share) / (bare + 1)
    return Fitted(model, curve, float(without))


FOUND = "doc_id long, score double, evidence array<string>"


def _score(fitted: Fitted, cut: float):
    sent, curve, rest = fitted.model, fitted.curve, fitted.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        vocabulary, ids, toxic = Vocabulary(model.hashes), model.index.ids, model.index.toxic
        for batch in batches:
            for i, j, row, term, n in batch_counts(batch.column(1), vocabulary):
                score, evidence = np.full(j - i, rest), {}
                queries, who, sims = nearest(model.index, row, term, tfidf(row, term, n, model.idf), NEIGHBOURS)
                if len(queries):
                    score[queries] = calibrated(curve, votes(model.index, who, sims))
                hit = np.flatnonzero(score >= cut)
                at = np.searchsorted(queries, hit)
                for r, q in zip(hit.tolist(), at.tolist()):  # the neighbours as id:similarity:label, nearest first
                    if q < len(queries) and queries[q] == r:
                        evidence[r] = [f"{ids[e]}:{s:.4f}:{int(toxic[e])}" for e, s in zip(who[q, :EVIDENCE], sims[q, :EVIDENCE]) if e >= 0]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + hit)), pa.array(score[hit]), pa.array([evidence.get(r, []) for r in hit.tolist()], pa.list_(pa.string()))], names=["doc_id", "score", "evidence"])

    return run


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """(doc_id, score, evidence) of the documents whose probability of being toxic is at least ``cut``."""
    fitted = fit(docs, labels, sample)
    if fitted is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(trimmed(_score(fitted, cut)), FOUND)
