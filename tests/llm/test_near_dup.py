"""SimHash and vector near-duplicates against all-pairs comparison."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from polisframe.llm.near_texts import near_texts
from polisframe.llm.near_vectors import buckets, hadamard, near_vectors, tables_for
from polisframe.llm.simhash_tree import BKTree, forest_links, near_duplicates
from tests.llm.conftest import prose


def classes(n, pairs):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def simhash(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in low.translate({c: " " for c in b"\t\n\r\x0b\x0c"}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_documents(corpus, rows_of):
    got = near_duplicates(corpus).collect()
    bits = [simhash(t) for _, t in rows_of]
    label = classes(len(bits), [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3])
    least = {}
    for (doc, _), c in zip(rows_of, label, strict=True):
        least[c] = min((x for x in (least.get(c), doc) if x is not None), default=None)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((d, b, least[c]) for (d, _), b, c in zip(rows_of, bits, label, strict=True)), key=key)
    assert sorted(((r["doc_id"], r["bits"] % 2**64, r["component_id"]) for r in got), key=key) == want


def test_no_documents(none):
    assert near_duplicates(none).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3))
def test_tree_and_forest(seed, band):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 4, dtype=np.uint64)) for _ in range(20)]))
    found = {(int(a), int(b)) for q, n in BKTree(points).within(points, 3) for a, b in zip(q, n, strict=True)}
    assert found == {(i, j) for i in range(len(points)) for j in range(len(points)) if (int(points[i]) ^ int(points[j])).bit_count() <= 3}
    links = np.concatenate([forest_links(points, None, 3, b, 4) for b in range(4)])
    place = {int(p): i for i, p in enumerate(points)}
    assert classes(len(points), [(place[int(a)], place[int(b)]) for a, b in links]) == classes(len(points), found)


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=64)
        rows += [(centre + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.25])).tolist() for _ in range(rng.integers(1, 12))]
    rows += [rows[0], rows[0], rows[5], [0.0] * 64, None, [float("nan")] * 64, [None, *[1.0] * 63], [], [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v, "x", 1) for i, v in enumerate(rows)] + [(0, rows[0], "x", 1), (None, rows[1], "x", 1)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, least string, copies int").repartition(4)
    got = near_vectors(df, block=block).collect()
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, *_ in table]
    n = len(table)

    def cosine(a, b):
        return np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) if len(a) == len(b) else 0.0

    pairs = [(i, j) for i in range(n) for j in range(i) if ok[i] and ok[j] and cosine(table[i][1], table[j][1]) >= 0.95]
    links = np.bincount(np.array(pairs).ravel(), minlength=n)
    label = classes(n, pairs)
    least = {}
    for (v, *_), c in zip(table, label, strict=True):
        least[c] = min((x for x in (least.get(c), v) if x is not None), default=None)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((t[0], int(k), least[c], t[0] is not None and t[0] == least[c]) for t, k, c in zip(table, links, label, strict=True)), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_lengths_do_not_meet(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in (33, 48, 64, 64):  # all are padded to 64
        for _ in range(60):
            v = np.pad(rng.normal(size=33), (0, n - 33), constant_values=0)
            rows += [v.tolist(), (v + 0.02 * rng.normal(size=n)).tolist()]
    rows += [[*rows[i][:33], *[0.0] * 15] for i in range(120)]  # the same keys as vectors of 33 but for the length
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>").repartition(4)
    unit = {n: [(i, np.array(v) / np.linalg.norm(v)) for i, v in enumerate(rows) if len(v) == n] for n in (33, 48, 64)}
    pairs = [(i, j) for same in unit.values() for i, v in same for j, w in same if j < i and v @ w >= 0.95]
    want = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    label = classes(len(rows), pairs)
    assert sorted(tuple(r)[:3] for r in near_vectors(df).collect()) == [(i, want[i], label[i]) for i in range(len(rows))]


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_hashing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    e = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1)[:, None]
    e -= (e * x).sum(axis=1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * e
    a, b = buckets(x, 8, 2, 2), buckets(y, 8, 2, 2)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.999
    assert all(len(set(r)) == len(r) for r in a.tolist())


@pytest.mark.parametrize("hashes", [2, 3, 4, 5])
def test_misses_do_not_grow(hashes):
    rng = np.random.default_rng(7)
    x, e = rng.normal(size=(2, 5000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e -= (e * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * e / np.linalg.norm(e, axis=1)[:, None]
    a, b = (buckets(v, 6, hashes, hashes).reshape(5000, 6, hashes) for v in (x, y))
    missed = 1 - (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean()  # of one table
    assert missed ** tables_for(hashes) < 1.5e-4


def planted(rng):
    """Texts with copies that have some words replaced, a chain of copies of copies, and unlike ones with a common passage."""
    texts, passage = [], prose(rng, 30)
    for i in range(30):
        words = prose(rng, rng.choice([6, 12, 40, 90, 300])).split()
        for _ in range(6):
            texts.append(" ".join(words))
            words = [w if rng.random() > 0.02 else prose(rng, 1) for w in words] + ["end"] * rng.randint(0, 1)
        texts.append(passage + " " + prose(rng, 30))
    return texts + texts[:5] + [texts[1].upper(), "one", "ONE", "one two", "", None, " "]


def five_word_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0]
    return classes(len(texts), pairs), pairs


@pytest.mark.parametrize("block", [1024, 8])
def test_near_texts(spark, block):
    texts = planted(random.Random(4))
    label, pairs = five_word_classes(texts)
    assert sum(3 < (simhash(texts[i] or "") ^ simhash(texts[j] or "")).bit_count() for i, j in pairs) > 50  # op7's radius leaves them out
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id int, text string, tag string, size int").repartition(4)
    got = near_texts(df, block=block).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == list(enumerate(label))


def test_tree_with_a_radius_of_each_query():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    points = np.unique(np.concatenate([base ^ rng.integers(0, 2**20, 3, dtype=np.uint64) for _ in range(30)]))
    radius = rng.choice([0, 3, 25, 64], len(points))
    found = [(int(a), int(b)) for q, n in BKTree(points).near(points, radius) for a, b in zip(q, n, strict=True)]
    assert sorted(found) == [(i, j) for i in range(len(points)) for j in range(len(points)) if (int(points[i]) ^ int(points[j])).bit_count() <= radius[i]]


@pytest.mark.parametrize("split", [200, 80])
def test_blocks_are_searched_in_trees(monkeypatch, split):
    """The candidates of a block are all pairs that fit, found in a BK-tree of its SimHashes."""
    from polisframe.llm import near_texts as nt

    built = []

    class Seen(BKTree):
        def __init__(self, points):
            built.append(len(points))
            super().__init__(points)

    monkeypatch.setattr(nt, "BKTree", Seen)
    rng = np.random.default_rng(8)
    n, key = 200, 50
    size = rng.choice([1, 5, 60, 62, 66, 75, 78, 90, 200], n)
    bits = rng.integers(0, 2**63, 20, dtype=np.uint64)[rng.integers(0, 20, n)] ^ rng.integers(0, 2**rng.integers(1, 40, n), dtype=np.uint64)
    minima = [sorted({key, *rng.integers(0, 2000, 2).tolist()}) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([
        pa.array([key] * n), pa.array(size, pa.int32()), pa.array(bits.view(np.int64)), pa.array(minima, pa.list_(pa.int64())), pa.array([i >= split for i in range(n)])],
        ["key", "size", "bits", "minima", "second"])
    got = [(i, j) for i, found in nt._pairs(batch, 0, n, 0.8) for j in found.tolist()]
    fits = lambda i, j: (min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and not {x for x in minima[i] if x < key} & set(minima[j])
                         and (min(size[i], size[j]) < nt.SCREENED or (int(bits[i]) ^ int(bits[j])).bit_count() <= nt.RADIUS))
    assert got == [(i, j) for i in range(split) for j in range(i + 1 if split == n else split, n) if fits(i, j)]
    assert sum(built) == len(np.unique(bits if split == n else bits[split:]))


def test_stage_drops_near_copies(spark):
    import corpus_pipeline as c

    texts = planted(random.Random(9))
    label, _ = five_word_classes(texts)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(4)
    got = c.dedup(spark, df, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, texts[i]) for i in set(label))
    assert c.dedup(spark, df.where("false"), "").collect() == []


def test_repeated_ids_keep_a_row_of_each_group(spark):
    import corpus_pipeline as c

    rng = random.Random(2)
    one, other, third = (prose(rng, 40) for _ in range(3))
    rows = [(1, one + " z"), (1, one + " b"), (1, other), (2, one), (2, third), (0, third + " x"), (3, "b a"), (3, "a b"), (3, "a b"), (None, one), (None, one)]
    want = [(0, third + " x"), (1, min(one + " z", one + " b")), (1, other), (3, "a b"), (3, "b a"), (None, one), (None, one)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)
        assert sorted((tuple(r) for r in c.dedup(spark, df, "").collect()), key=key) == sorted(want, key=key)
