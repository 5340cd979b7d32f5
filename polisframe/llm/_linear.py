"""Sparse text features, their selection and vectors, for the linear models fitted on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import starts_of, text_column, text_slices

#: Labelled documents that a model is fitted on, about; labels beyond it are left out by a hash of the id.
LABELLED = 10_000
#: Features that a model keeps.
FEATURES = 4096
#: Words whose features a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Measures of a text's shape.
SHAPE = 8


def word_features(word: str) -> list[int]:
    """64-bit keys of a lower-case word and its beginnings of 4 to 6 letters."""
    n = len(word)
    kept = (word, word[:4], word[:5], word[:6])[:1 + (n > 4) + (n > 5) + (n > 6)]
    return [xxhash.xxh64_intdigest(w, 7) for w in kept]


_UPPER, _DIGIT, _ALPHA, _SPACE = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shape(text: str, words: int, distinct: int) -> list[float]:
    """Shares of capitals, digits and signs, word length, repetition and length."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n, m = max(1, len(raw)), max(1, words)
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    upper, digit, alpha, space = (int(counts[c].sum()) for c in (_UPPER, _DIGIT, _ALPHA, _SPACE))
    return [upper / n, digit / n, (n - alpha - digit - space) / n, min(m, n) / n, distinct / m, np.log1p(m),
            counts[33] / n, counts[124] / n]


def labelled(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(text, y): documents with a label, about ``bound`` of them. ``labels``: (doc_id, y); of several for one id the largest."""
    one = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    n = one.count()
    share = 1_000_000 if n <= bound else int(1_000_000 * bound / n)
    some = one.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    return texts.join(F.broadcast(some), "doc_id").select("text", "y")  # at most about ``bound`` short rows


def _counted(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        keys, of = [], []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            own = {f for w in set(text.lower().split()) for f in word_features(w)}
            keys.append(np.fromiter(own, np.uint64, len(own)))
            of.append(np.full(len(own), y, np.int64))
        key, y = np.concatenate(keys), np.concatenate(of)
        order = np.argsort(key, kind="stable")
        key, y = key[order], y[order]
        first = starts_of(key)
        sums = [np.add.reduceat((y == c).astype(np.int64), first) if len(first) else first for c in range(classes)]
        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), *map(pa.array, sums)],
                                         ["feature", *(f"c{c}" for c in range(classes))])


def select_features(sample: DataFrame, sizes: list[int], most: int = FEATURES) -> np.ndarray:
    """Keys of the features that tell one class from the others best, sorted.

    The measure is the root of the likelihood ratio (G) of feature and class, for the best class; a feature needs 3, or up to 5 if
    others have much more, and at least two documents.
    """
    classes = range(len(sizes))
    counts = sample.mapInArrow(lambda b: _counted(b, len(sizes)), "feature bigint, " + ", ".join(f"c{c} bigint" for c in classes))
    counts = counts.groupBy("feature").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in classes])
    total = float(sum(sizes))
    seen = sum((F.col(f"c{c}") for c in classes), F.lit(0))

    def term(found, expected):
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    scores = []
    for c in classes:
        own, other, size, rest = F.col(f"c{c}"), seen - F.col(f"c{c}"), float(sizes[c]), total - sizes[c]
        if size and rest:
            g = term(own, seen * (size / total)) + term(other, seen * (rest / total))
            g = g + term(size - own, (total - seen) * (size / total)) + term(rest - other, (total - seen) * (rest / total))
            scores.append(F.sqrt(F.greatest(2 * g, F.lit(0.0))))
    best = counts.where((seen >= 2) & (seen < total)).withColumn("score", F.greatest(*scores) if len(scores) > 1 else scores[0])
    rows = best.where("score >= 3").orderBy(F.desc("score"), "feature").limit(most).select("feature", "score").collect()  # at most ``most``
    enough = min(5.0, max(3.0, 0.3 * rows[0]["score"])) if rows else 0.0
    return np.sort(np.array([r["feature"] for r in rows if r["score"] >= enough], np.int64).view(np.uint64))


class Vectors:
    """Selected features and shape of texts; remembers which words have any."""

    def __init__(self, keys: np.ndarray):
        self.index = {k: i for i, k in enumerate(keys.tolist())}
        self.without: set[str] = set()
        self.having: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        for w in words:
            found = [self.index[f] for f in word_features(w) if f in self.index]
            if found:
                self.having[w] = found
            else:
                self.without.add(w)

    def __call__(self, text: str) -> tuple[list[int], list[float], int]:
        """(numbers of the features it has, its shape, its words)."""
        words = text.lower().split()
        distinct = set(words)
        if len(self.without) + len(self.having) > REMEMBERED:
            self.without.clear()
            self.having.clear()
        left = distinct - self.without
        self.learn([w for w in left if w not in self.having])
        found = {f for w in left for f in self.having.get(w, ())}
        return sorted(found), shape(text, len(words), len(distinct)), len(words)


def sample_vectors(sample: DataFrame, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(features, shapes, y) of the bounded sample, in a fixed order, at the driver."""

    def rows(batches):
        vectors = Vectors(keys)
        for batch in text_slices(batches):
            got = [vectors(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int32())),
                                              pa.array([g[1] for g in got], pa.list_(pa.float64())), batch.column("y")],
                                             ["active", "shape", "y"])

    got = sample.mapInArrow(rows, "active array<int>, shape array<double>, y int").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["y"][i].as_py(), got["shape"][i].as_py(), got["active"][i].as_py()))
    got = got.take(pa.array(order, pa.int64()))
    shapes = np.array(got["shape"].to_pylist(), np.float64).reshape(-1, SHAPE)
    return [np.array(a, np.int64) for a in got["active"].to_pylist()], shapes, np.array(got["y"].to_pylist(), np.int64)


def sparse_rows(active: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every active feature."""
    sizes = [len(a) for a in active]
    cols = np.concatenate(active) if sum(sizes) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(active)), sizes), cols.astype(np.int64)


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Adam with a falling step; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        _, g = loss(x)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        x -= 0.1 / (1 + 3 * t / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def with_columns(docs: DataFrame, names: dict[str, str], compute: Callable[[list[str], list], list[list]], keep=None) -> DataFrame:
    """``docs`` with columns computed from (texts, ids) in Arrow batches; all its own columns pass through unchanged.

    ``names``: new column -> type, at the end. ``keep``: (texts, ids) -> rows to keep instead of new columns.
    """
    own = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(own))])  # own names may repeat or clash with the new ones
    position = {c.lower(): i for i, c in reversed(list(enumerate(own)))}
    inner = inner.withColumns({"_text": text_column(f"c{position['text']}"), "_id": F.col(f"c{position['doc_id']}").cast("bigint")})
    fields = [f"`{c}` {t.simpleString()}" for c, t in ((f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields))]

    def run(batches):
        for batch in text_slices(batches, "_text"):
            texts, ids = batch.column("_text").to_pylist(), batch.column("_id").to_pylist()
            held = batch.select([f"c{i}" for i in range(len(own))])
            if keep is not None:
                yield held.filter(pa.array(keep(texts, ids), pa.bool_()))
                continue
            new = compute(texts, ids)
            yield pa.RecordBatch.from_arrays([*held.columns, *map(pa.array, new)],
                                             [*held.schema.names, *(f"n{i}" for i in range(len(new)))])

    more = [f"n{i} {t}" for i, t in enumerate(names.values())]
    out = inner.mapInArrow(run, ", ".join(fields + more))
    return out.toDF(*own, *names)
