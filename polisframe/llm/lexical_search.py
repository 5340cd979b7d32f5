"""Ranked lexical search with pair-bound MaxScore.

The index is a table of segments, one row each: the documents of a piece of a partition (at most ``DOCS`` documents and about
``POSTINGS`` postings), for every term of the queries the documents that hold it with their impacts, the term's greatest impact,
and for pairs of terms that stand side by side in a query the intersection of their lists with the greatest joint impact.
Building it takes two passes: one over the texts for occurrences, lengths and counts, one over the first pass's rows once the
counts of the whole table are known. Nothing is shuffled but sums and results.

A query cuts its terms into disjoint pairs and single terms, the pairs that save most first. A pair is bounded by its joint
maximum or the greater of its two own maxima, which is less than their sum. Parts are added in falling order of their bounds until
the parts left can't lift an unseen document to the worst of the best ``k`` so far; then only documents that can still get there go on.
For those the intersection lists tell which of the pair's bounds holds, and the few that pass are looked up in the lists
left. The threshold is carried from one segment of a task to the next.

Queries come in blocks of at most ``QUERY_BYTES`` of text (one query at least) and ``QUERIES`` queries, whose terms are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polisframe.llm._shared import starts_of, stored, text_column, text_slices

TOP = 20
DOCS, POSTINGS = 8192, 1 << 20
QUERY_BYTES, QUERIES = 1 << 20, 4096

#: Bytes as terms see them: A-Z lower-cased, digits, letters and all beyond ASCII kept, others are gaps.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_FIRST = "segment bigint, n_docs bigint, n_terms bigint, doc_ids array<bigint>, lengths array<int>, terms array<int>, df array<int>, docs array<int>, tf array<int>"
_INDEX = ("segment bigint, doc_ids array<bigint>, terms array<int>, starts array<int>, docs array<int>, impacts array<int>, maxima array<int>, "
          "pairs array<int>, pair_starts array<int>, pair_docs array<int>, joint array<bigint>")


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


@dataclass
class Queries:
    """A block of queries: their numbers' ids, the terms in order of first use, each query's (terms, repeats) and pairs."""

    ids: list[int | None]
    terms: dict[bytes, int]
    wanted: list[tuple[np.ndarray, np.ndarray]]
    #: pairs as (smaller term, larger term), and of each query the numbers of its pairs
    pairs: np.ndarray
    beside: list[list[int]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Queries:
        terms: dict[bytes, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        wanted, beside = [], []
        for _, text in rows:
            numbers = [terms.setdefault(t, len(terms)) for t in terms_of(text)]
            counted = Counter(numbers)
            wanted.append((np.array(list(counted), np.int32), np.array(list(counted.values()), np.int64)))
            near = {(min(a, b), max(a, b)) for a, b in zip(numbers, numbers[1:], strict=False) if a != b}
            beside.append([pairs.setdefault(p, len(pairs)) for p in sorted(near)])
        return cls([i for i, _ in rows], terms, wanted, np.array(list(pairs), np.int32).reshape(-1, 2), beside)


def _lists(row: dict[str, pa.Array], name: str, i: int) -> np.ndarray:
    return row[name][i].values.to_numpy(zero_copy_only=False)


def _list_array(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _segments(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """First pass: occurrences of the wanted terms, segment by segment."""
    part, count = TaskContext.get().partitionId(), 0
    ids: list[pa.Array] = []
    lengths: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    often: list[np.ndarray] = []
    docs = held = 0

    def flush() -> pa.RecordBatch:
        key, tf, length = np.concatenate(keys), np.concatenate(often), np.concatenate(lengths)
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        term = key >> 32
        starts = starts_of(term)
        arrays = [pa.array([part << 32 | count]), pa.array([int((length > 0).sum())]), pa.array([int(length.sum(dtype=np.int64))]),
                  _list_array(pa.concat_arrays(ids), pa.int64()), _list_array(length, pa.int32()), _list_array(term[starts], pa.int32()),
                  _list_array(np.diff(np.append(starts, len(term))), pa.int32()), _list_array(key & 0xFFFFFFFF, pa.int32()), _list_array(tf, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["segment", "n_docs", "n_terms", "doc_ids", "lengths", "terms", "df", "docs", "tf"])

    for batch in text_slices(batches):
        for a in range(0, batch.num_rows, DOCS):
            piece = batch.slice(a, DOCS)
            numbers, size = [], np.zeros(piece.num_rows, np.int32)
            for i, text in enumerate(piece.column("text").to_pylist()):
                words = terms_of(text)
                size[i] = len(words)
                numbers.append(np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words)))
            term = np.concatenate(numbers)
            doc = np.repeat(np.arange(docs, docs + piece.num_rows), size)
            key, n = np.unique((term[term >= 0] << 32) | doc[term >= 0], return_counts=True)
            ids.append(piece.column("doc_id"))
            lengths.append(size)
            keys.append(key)
            often.append(n)
            docs, held = docs + piece.num_rows, held + len(key)
            if docs >= DOCS or held >= POSTINGS:
                yield flush()
                count, docs, held = count + 1, 0, 0
                ids, lengths, keys, often = [], [], [], []
    if docs:
        yield flush()


@dataclass
class Corpus:
    """What scores need of the whole table: documents and terms, and the weight of each wanted term."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def lengths_factor(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 25 + (25 * lengths.astype(np.int64) * self.n_docs) // max(self.n_terms, 1)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _finished(batches: Iterator[pa.RecordBatch], corpus: Corpus, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Second pass: impacts, their maxima, and the intersection lists of the pairs."""
    for batch in batches:
        row = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            terms, df, docs, tf = (_lists(row, n, i) for n in ("terms", "df", "docs", "tf"))
            starts = np.append(0, np.cumsum(df)).astype(np.int64)
            tf = tf.astype(np.int64)
            impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * corpus.lengths_factor(_lists(row, "lengths", i))[docs])
            maxima = np.maximum.reduceat(impacts, starts[:-1]) if len(terms) else np.zeros(0, np.int64)
            place = np.full(len(corpus.weights), -1, np.int64)
            place[terms] = np.arange(len(terms))
            both = np.flatnonzero((place[pairs] >= 0).all(axis=1)) if len(terms) else np.zeros(0, np.int64)
            kept, met, joint = [], [], []
            at = np.full(len(row["doc_ids"][i]), -1, np.int64)
            last = -1
            for p in both[np.argsort(pairs[both, 0], kind="stable")].tolist():
                a, b = place[pairs[p]]
                if a != last:
                    at.fill(-1)
                    at[docs[starts[a]:starts[a + 1]]] = np.arange(starts[a], starts[a + 1])
                    last = a
                other = np.arange(starts[b], starts[b + 1])
                mine = at[docs[other]]
                found = mine >= 0
                if not found.any():
                    joint.append(0)
                else:
                    x, y = corpus.weights[pairs[p]]
                    joint.append(int((x * impacts[mine[found]] + y * impacts[other[found]]).max()))
                kept.append(p)
                met.append(docs[other[found]])
            pair_starts = np.append(0, np.cumsum([len(m) for m in met])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                row["segment"].slice(i, 1), row["doc_ids"].slice(i, 1), _list_array(terms, pa.int32()), _list_array(starts, pa.int32()),
                _list_array(docs, pa.int32()), _list_array(impacts, pa.int32()), _list_array(maxima, pa.int32()), _list_array(np.array(kept, np.int64), pa.int32()),
                _list_array(pair_starts, pa.int32()), _list_array(np.concatenate(met) if met else np.zeros(0, np.int32), pa.int32()),
                _list_array(np.array(joint, np.int64), pa.int64())],
                ["segment", "doc_ids", "terms", "starts", "docs", "impacts", "maxima", "pairs", "pair_starts", "pair_docs", "joint"])


class Segment:
    """One row of the index, ready for queries."""

    def __init__(self, row: dict[str, pa.Array], i: int, queries: Queries, weights: np.ndarray):
        self.n = len(row["doc_ids"][i])
        self.starts, self.docs, self.impacts, self.maxima, self.pair_starts, self.pair_docs, self.joint = (
            _lists(row, n, i) for n in ("starts", "docs", "impacts", "maxima", "pair_starts", "pair_docs", "joint"))
        self.place = np.full(len(weights), -1, np.int64)
        terms = _lists(row, "terms", i)
        self.place[terms] = np.arange(len(terms))
        self.pair_place = np.full(len(queries.pairs), -1, np.int64)
        pairs = _lists(row, "pairs", i)
        self.pair_place[pairs] = np.arange(len(pairs))
        self.queries, self.weights = queries, weights

    def parts(self, q: int) -> list[tuple[int, list[tuple[int, int]], int, int]]:
        """(bound, [(list, weight)], pair list or -1, bound outside the pair list) of a query's disjoint parts, greatest bound first."""
        terms, times = self.queries.wanted[q]
        own = {int(t): (int(p), int(w), int(w) * int(self.maxima[p])) for t, p, w in
               zip(terms, self.place[terms], self.weights[terms] * times, strict=True) if p >= 0 and w > 0}
        repeats = dict(zip(terms.tolist(), times.tolist(), strict=True))
        saved = []
        for number in self.queries.beside[q]:
            a, b = self.queries.pairs[number].tolist()
            p = int(self.pair_place[number])
            if p >= 0 and a in own and b in own:
                alone = max(own[a][2], own[b][2])
                bound = max(alone, min(int(self.joint[p]) * max(repeats[a], repeats[b]), own[a][2] + own[b][2]))
                saved.append((own[a][2] + own[b][2] - bound, a, b, p, bound, alone))
        out = []
        for gain, a, b, p, bound, alone in sorted(saved, reverse=True):
            if gain > 0 and a in own and b in own:
                out.append((bound, [own.pop(a)[:2], own.pop(b)[:2]], p, alone))
        out += [(top, [(p, w)], -1, top) for p, w, top in own.values()]
        return sorted(out, key=lambda part: -part[0])

    def best(self, q: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all whose score is above zero and at least ``least`` and the k-th best here, and maybe some more."""
        parts = self.parts(q)
        left = np.append(np.cumsum([p[0] for p in parts][::-1])[::-1], 0)
        if not parts or left[0] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.zeros(self.n, np.int64)
        done = 0
        for _, lists, _, _ in parts:
            for p, w in lists:
                a, b = self.starts[p], self.starts[p + 1]
                total[self.docs[a:b]] += w * self.impacts[a:b].astype(np.int64)
            done += 1
            if self.n > k and done < len(parts):
                if left[done] <= total.max():
                    least = max(least, int(np.partition(total, self.n - k)[self.n - k]))
                if left[done] < least:  # a document not seen so far gets no more than the bounds that are left
                    break
        least = max(least, 1)
        docs = np.flatnonzero(total + left[done] >= least)
        if done < len(parts):
            top = total[docs]
            for bound, _, p, alone in parts[done:]:
                top += bound if p < 0 else np.where(_holds(self.pair_docs[self.pair_starts[p]:self.pair_starts[p + 1]], docs), bound, alone)
            docs = docs[top >= least]
            for _, lists, _, _ in parts[done:]:
                for p, w in lists:
                    held = self.docs[self.starts[p]:self.starts[p + 1]]
                    found = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                    hit = held[found] == docs
                    total[docs[hit]] += w * self.impacts[self.starts[p] + found[hit]].astype(np.int64)
            docs = docs[total[docs] >= least]
        return docs, total[docs]


def _holds(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(wanted), bool)
    return ordered[np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)] == wanted


def _searched(batches: Iterator[pa.RecordBatch], queries: Queries, weights: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The task's best documents of each query; null ids come after all others of the same score."""
    nothing = np.zeros(0, np.int64)
    best = {q: (nothing, nothing, np.zeros(0, bool)) for q in range(len(queries.ids))}
    for batch in batches:
        row = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            segment = Segment(row, i, queries, weights)
            ids = row["doc_ids"][i].values
            absent = ids.is_null().to_numpy(zero_copy_only=False)
            number = ids.fill_null(0).to_numpy()
            for q, (scores, docs, none) in best.items():
                least = int(scores[k - 1]) if len(scores) >= k else 0
                found, got = segment.best(q, k, least)
                if len(found):
                    scores, docs, none = np.append(scores, got), np.append(docs, number[found]), np.append(none, absent[found])
                    order = np.lexsort([docs, none, -scores])[:k]
                    best[q] = scores[order], docs[order], none[order]
    for q, (scores, docs, none) in best.items():
        if len(scores):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array(docs, mask=none), pa.array(scores)], ["query", "doc_id", "score"])


def build_index(docs: DataFrame, queries: Queries) -> tuple[DataFrame, Corpus]:
    """The stored index of the queries' terms over all rows of ``docs`` (doc_id, text), and the table's figures."""
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(queries.terms)
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    first = stored(wanted.mapInArrow(lambda batches: _segments(batches, terms.value), _FIRST))
    n_docs, n_terms = first.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    held = first.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).collect()  # one row a term of the block
    weights = np.zeros(len(queries.terms), np.int64)
    for term, df in held:
        weights[term] = weight(n_docs, df)
    corpus = Corpus(n_docs or 0, n_terms or 0, weights)
    known = spark.sparkContext.broadcast((corpus, queries.pairs))
    return stored(first.mapInArrow(lambda batches: _finished(batches, *known.value), _INDEX)), corpus


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), text_column().alias("text")).distinct().orderBy("item_id", "text")
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        if block and (size + len(text) > QUERY_BYTES or len(block) >= QUERIES):
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of ``items`` (item_id, text) its ``k`` best rows of ``docs`` (doc_id, text).

    Rows without a common term have no score and aren't returned; equal scores go by doc_id, null ids last. Null texts hold no terms;
    repeated rows of ``docs`` are documents of their own; items that agree in id and text are one item, items of one id with
    different texts each get their ranks; other columns are ignored; without rows on either side there are none.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in _blocks(items):
        queries = Queries.of(block)
        index, corpus = build_index(docs, queries)
        asked = spark.sparkContext.broadcast((queries, corpus.weights))
        found = index.mapInArrow(lambda batches: _searched(batches, *asked.value, k), "query int, doc_id bigint, score bigint")  # noqa: B023
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(pa.table({"query": pa.array(range(len(block)), pa.int32()), "item_id": pa.array(queries.ids, pa.int64())}))
        out = out.unionByName(stored(ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")))
    return out
