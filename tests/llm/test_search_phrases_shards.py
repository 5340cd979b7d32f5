"""Lexical search, phrases and balanced shards against plain versions."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from polisframe.llm.balanced_shards import balanced_shards, levelled, propagated, shard_texts, shares, thresholds
from polisframe.llm.double_array import build
from polisframe.llm.lexical_search import Queries, search
from polisframe.llm.phrases import phrases
from polisframe.llm.phrases_sql import PHRASES_SQL
from polisframe.llm.search_sql import SEARCH_SQL
from tests.llm.conftest import WORDS, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    split = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(1 for s in split if s), sum(map(len, split))
    tf = [collections.Counter(s) for s in split]
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for item, text in sorted(set(items), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
        scores = []
        for (doc, _), c, s in zip(docs, tf, split, strict=True):
            if s:
                m = 75 + 25 * len(s) * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                            for t in TERM.findall((text or "").translate(LOWER)) if t in c)
                if score:
                    scores.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -score) for i, (score, none, doc) in enumerate(sorted(scores)[:k])]
    return out


def by_item(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], -r[3], r[2] is None, r[2] or 0))


def test_search(spark, corpus, rows_of, none):
    items = [(1, "The River river; stone"), (2, None), (3, ""), (4, "zzz unheard"), (5, "日本語 é x b"), (5, "harbour Silent"), (None, "of and to in law"),
             (6, "the of and to in law river stone cloud field winter green silent harbour engine paper market garden ing")]
    frame = spark.createDataFrame([*items, items[0]], "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    got = search(corpus, frame, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_item(map(tuple, got.collect())) == by_item(plain_search(rows_of, items, 7))
    assert search(none, frame).collect() == [] and search(corpus, frame.where("false")).collect() == []


def test_search_skips_without_loss(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(3000)]
    docs += [(3000 + i, docs[7][1]) for i in range(50)]  # ties
    items = [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(30)] + [(30, docs[7][1])]
    got = search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id bigint, text string"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(plain_search(docs, items, 10))


def test_queries_hold_pairs_once():
    q = Queries.of([(1, "a b a"), (2, "b a c")])
    assert q.terms == {b"a": 0, b"b": 1, b"c": 2}
    assert q.pairs.tolist() == [[0, 1], [0, 2]] and q.beside == [[0], [0, 1]]
    assert q.wanted[0][1].tolist() == [2, 1]


def test_double_array():
    rng = np.random.default_rng(4)
    for depth, top, digits in ((1, 3, 1), (2, 40, 1), (3, 700, 2), (4, 6, 1), (2, 70_000, 3)):
        rows = rng.integers(0, top, (2000, depth))
        trie = build(rows, digits)
        run = rng.integers(-1, min(top, 60), 5000).astype(np.int32)
        run[1000:1000 + depth] = rows[0]
        at, row = trie.walk(run)
        known = {tuple(r) for r in rows.tolist()}
        want = {i: tuple(run[i:i + depth].tolist()) for i in range(len(run) - depth + 1) if tuple(run[i:i + depth].tolist()) in known}
        assert {i: tuple(trie.phrases[r].tolist()) for i, r in zip(at.tolist(), row.tolist(), strict=True)} == want


def plain_phrases(rows, least, longest, top):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in counts.items():
        total = sum(a for p, a in c.items() if len(p) == 1)
        frequent = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + n] for p, a in frequent.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if frequent[p[i:i + n]] == a}
        rows = []
        for p, a in frequent.items():
            if p not in inside:
                score, k = min((1000 * a * total // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"buckets": 2048, "shard": 1500, "at_once": 40}])
def test_phrases(spark, corpus, rows_of, none, sizes):
    frame = corpus.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 2 == 0, "en").otherwise("xx")).withColumn("phrase", F.lit(0)).withColumn("a", F.lit(""))
    texts = [(r["lang"], r["text"]) for r in frame.collect()]
    got = phrases(frame, 3, 4, 50, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_phrases(texts, 3, 4, 50)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert phrases(none.withColumn("lang", F.lit("en"))).collect() == [] and phrases(frame).count() < 2000


def test_phrases_within_pieces(spark):
    rows = [("en", "New\tYork  city, New York; city\x0bNEW York\x1fcity new york city"), ("en", "x" * 300_000), (None, "A b. a B"), ("und", "a b\na b"), ("en", None), ("en", "")] * 2
    got = phrases(spark.createDataFrame(rows, "lang string, text string"), 4, 5, 9)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 4, 5, 9)


def test_sql(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS[:6]) for _ in range(300)) + ". " + prose(rng, 30), rng.choice(["en", "fr", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(i, prose(rng, 9)) for i in range(9)], "item_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    assert sorted(con.execute(PHRASES_SQL).fetchall()) == sorted(map(tuple, phrases(docs).collect()))
    assert sorted(con.execute(SEARCH_SQL).fetchall()) == sorted(map(tuple, search(docs, items).collect()))


def check_shards(got, rows, shards, near):
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = got.collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r[0], r[1], r[2]) for r in found), key=order) == sorted(((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in rows), key=order)
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in found:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(sums.values()) / shards
    assert all(abs(sums[s] - share) <= near * share for s in range(shards))
    held = collections.defaultdict(set)
    for r in found:
        held[r["size"], r["text_crc32"]].add(r["shard"])
    return held


def test_shards_keep_copies(spark, none):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(900)]
    texts += [t for t in texts[:60] for _ in range(rng.randint(1, 5))] + [None, None, ""]
    rows = [*enumerate(texts), (5, texts[5]), (None, "without id"), (None, None)]
    docs = spark.createDataFrame([(d, t, 3, "s") for d, t in rows], "doc_id bigint, text string, shard int, slot string").repartition(3)
    held = check_shards(shard_texts(docs), [(d, t or "") for d, t in rows], 8, 0.01)
    assert all(len(s) == 1 for s in held.values())
    assert shard_texts(none).collect() == []


def test_shards_with_a_hot_group(spark, corpus, rows_of):
    rng = random.Random(3)
    rows = [(i, "one text that half of the rows hold") for i in range(1500)] + [(2000 + i, prose(rng, 6)) for i in range(1500)]
    held = check_shards(shard_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)), rows, 8, 0.01)
    most = max(held.values(), key=len)
    assert len(most) <= 6 and sum(len(s) > 1 for s in held.values()) <= 3


def test_shards_with_one_large_text(spark, corpus, rows_of):
    """A text larger than a share has a shard of its own; the others are even."""
    assert shares(100, 4, [50, 5, 5, 5]) == [50, 16, 17, 17] and shares(10, 3, [9, 9, 9]) == [3, 3, 4] and shares(0, 2, [0, 0]) == [0, 0]
    found = shard_texts(corpus, 3)
    check_shards(found, rows_of, 3, 9.0)
    sums = sorted(r[1] for r in found.groupBy("shard").agg(F.sum("size")).collect())
    largest = max(len(t.encode()) + 1 for _, t in rows_of)
    assert sums[2] == largest > sum(sums) / 3 and sums[1] - sums[0] < 0.1 * sums[1]


def test_propagation_on_a_graph(spark):
    """Edges are links of two rows; communities end in fewer shards, and no shard is over its quota."""
    rng = random.Random(7)
    edges = [(16 * c + a, 16 * c + b) for c in range(40) for a in range(16) for b in range(a) if rng.random() < 0.5]
    edges += [(rng.randrange(640), rng.randrange(640)) for _ in range(150)]
    rows = spark.range(640).select(F.col("id").alias("row"), F.lit(10).cast("bigint").alias("size"))
    links = spark.createDataFrame([(r, i, 1) for i, e in enumerate(edges) for r in set(e)], "row bigint, link bigint, weight bigint")
    cut = lambda shard: sum(shard[a] != shard[b] for a, b in edges)
    before = {r["row"]: r["shard"] for r in propagated(rows, links, 800, 8, 0).collect()}
    placed = {r["row"]: r["shard"] for r in balanced_shards(rows, links).collect()}
    assert cut(placed) < 0.5 * cut(before)
    assert set(collections.Counter(placed.values()).values()) == {80}


def test_thresholds(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.choice([rng.randrange(1 << 60), 5, 1 << 59]), rng.randint(1, 9)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "bucket int, key bigint, size bigint")
    limits = {0: [0, 100, 3000], 1: [1, 10**6], 2: [777]}
    for b, ends in thresholds(frame, limits, 0).items():
        for limit, end in zip(limits[b], ends, strict=True):
            own = sorted((k, s) for c, k, s in rows if c == b)
            assert sum(s for k, s in own if k < end) <= limit
            after = [k for k, _ in own if k >= end]
            assert not after or sum(s for k, s in own if k <= after[0]) > limit


def test_levelled_moves_small_losses_first(spark):
    rows = spark.range(1000).select(F.col("id").alias("row"), F.lit(1).cast("bigint").alias("size"), F.lit(0).alias("shard"), F.when(F.col("id") < 400, 3).otherwise(0).alias("loss"))
    found = levelled(rows, 2).collect()
    assert sum(r["shard"] == 1 for r in found) == 500 and not any(r["shard"] == 1 and r["loss"] for r in found)
