"""Fingerprints, token counts, packing, license scan and language model scores against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polisframe.llm._shared import mix64
from polisframe.llm.license_scan import scan
from polisframe.llm.license_sql import SCAN_SQL
from polisframe.llm.order_minhash import KMER, chained, edited_text, hex_of, sketch
from polisframe.llm.packing import differencing, pack, windows_of
from polisframe.llm.pitman_yor import CONTEXTS, Totals, head_of, learn, score_texts, tokens_of, train
from polisframe.llm.seating import Seats, log_stirling
from polisframe.llm.token_count import count_tokens
from tests.llm.conftest import WORDS


def test_token_counts(corpus, rows_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = [(d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for d, t in rows_of]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in count_tokens(corpus, path).collect()), key=key) == sorted(want, key=key)


def test_packing(corpus, rows_of):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = pack(corpus, path).toPandas()
    ids = collections.Counter()
    for d, t in rows_of:
        x = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        ids[d, len(x), zlib.crc32(x[:1024].tobytes()) if len(x) >= 1024 else None] += 1
        rows = got[got.doc_id.isna() if d is None else got.doc_id == d]
        for start, length, crc, total in zip(rows.start, rows.length, rows.ids_crc32, rows.doc_tokens, strict=True):
            if total == len(x):
                assert zlib.crc32(x[start:start + length].tobytes()) == crc or d is None
    assert got.length.sum() == sum(n * k for (_, n, _), k in ids.items())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert got.length.sum() / (got.sequence_id.nunique() * 1024) > 0.9


def test_differencing():
    slots, most = differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for s in slots for i in s) == [0, 1, 2, 3, 4] and most == 16
    assert differencing([], 3) == ([], 0)
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 257, 500).tolist()
    slots = windows_of(sizes, 1024)
    assert sorted(i for s in slots for i in s) == list(range(500))
    assert max(sum(sizes[i] for i in s) for s in slots) <= 1024 and len(slots) <= -(-sum(sizes) // 1024) + 1
    assert len(windows_of([600, 600, 600], 1024)) == 3  # two would hold the total, but not these


def test_fingerprints(corpus, rows_of):
    got = chained(corpus).collect()
    assert len(got) == len(rows_of)
    order = sorted(rows_of, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        e = edited_text(t, following)
        a, b, c = sketch(t), sketch(e), sketch(following)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), hex_of(a), hex_of(b), float((a == b).mean()), float((a == c).mean())))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_sketch_is_order_min_hash():
    from polisframe.llm._shared import mix64
    from polisframe.llm.order_minhash import _ADD, _TIMES, numbered_kmers

    text = "abcabcabc the order of parts counts, the order of parts counts"
    h = numbered_kmers(text)
    assert len(h) == len(text) - KMER + 1 == len(set(h.tolist()))  # occurrences make all k-mers distinct
    for s in (0, 7, 31):
        rank = [((int(x) ^ int(_ADD[s])) * int(_TIMES[s])) % 2**64 for x in h]
        a, b = sorted(sorted(range(len(h)), key=rank.__getitem__)[:2])
        assert int(sketch(text)[s]) == int(mix64(mix64(h[a:a + 1]) + h[b:b + 1])[0]) >> 32
    x, y = "first half of it " * 20, "another side now " * 20
    assert (sketch(x + y) == sketch(y + x)).mean() < 1 and (sketch(x + y) == sketch(x + y + ".")).mean() > 0.8


def test_one_document(spark):
    row = chained(spark.createDataFrame([(5, "abcdef")], "doc_id int, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_licenses(spark, corpus):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"x y {notice} z"), (2, notice.upper().replace(" ", "\n")), (3, f"{notice} again {notice}"), (4, "Licensed under the Apache License"),
            (5, "Released under the MIT License"), (None, "Licensed under CC BY-NC 4.0."), (6, None), (7, ""), (1, "Released under the MIT license"),
            (8, "You may not use this file except in compliance with the new License text"),
            (9, "a this program is free software: you may redistribute it and/or modify it under the terms of the GNU General Public License b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'n' AS band", "1 AS size")
    got = scan(df).toPandas()
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(SCAN_SQL).fetchall()
    whole = lambda i: None if i is None or i != i else int(i)  # noqa: E731  pandas holds ids with nulls as floats
    assert sorted(str((whole(r[0]), *r[1:])) for r in want) == sorted(str((whole(r[0]), *r[1:])) for r in got.itertuples(index=False))
    assert len(want) >= 6
    assert scan(df.where("false")).collect() == []


def test_short_notices(spark):
    rows = [(1, "x y All rights reserved."), (2, "ALL\nrights  reserved, all rights reserved"), (3, "all rights"), (4, "all the rights reserved"), (5, "Fair use"),
            (6, "all rights reserved. Released under the MIT License. Copyright"), (None, "(c) all rights reserved"), (7, None), (8, "this is fair use of it")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in scan(df).collect()), key=str)
    assert got == sorted([(1, "all-rights-reserved", 1, 1.0, 2), (2, "all-rights-reserved", 2, 1.0, 0), (6, "all-rights-reserved", 1, 1.0, 0),
                          (6, "mit", 1, 1.0, 3), (None, "all-rights-reserved", 1, 1.0, 1)], key=str)
    few = scan(df, (("fair", "Fair use."), ("one", "Copyright"), ("four", "the MIT license copyright"), ("none", "...")))
    assert sorted(tuple(r) for r in few.collect()) == [(5, "fair", 1, 1.0, 0), (6, "four", 1, 1.0, 5), (6, "one", 1, 1.0, 8), (8, "fair", 1, 1.0, 2)]


def test_scores(spark, corpus, rows_of):
    got = score_texts(corpus).collect()
    assert len(got) == len(rows_of)
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: [*t.encode().lower().split(), b""]
    seen = collections.Counter(w for d, t in rows_of if not out(d) for w in words(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((d is None, d or 0, out(d), len(words(t)), sum(seen[w] > 0 for w in words(t)), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words(t)), 6))
                  for d, t in rows_of)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    tail = {(r["doc_id"], r["n_tokens"]): r["score"] for r in score_texts(corpus, head=3).collect()}  # by the shuffle instead of the matrix
    for r in got:
        assert tail[r["doc_id"], r["n_tokens"]] == pytest.approx(r["score"], rel=1e-5)


def test_contexts_help(spark):
    cycle = "salt pepper sugar flour butter".split()
    rows = [(i, " ".join(cycle[(i + j) % 5] for j in range(20 + i % 7))) for i in range(120)]
    got = score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held)  # logarithms: a much higher probability


def test_probabilities_sum_to_one(corpus):
    seated, totals = train(corpus.select("doc_id", "text").fillna("", "text"))
    head, _ = head_of(seated, totals)
    rows = seated.collect()
    guests, parents = (np.array(x) for x in ([sum(r["tables"]) for r in rows], [r["parent_tables"] for r in rows]))
    unknown = totals.parent(np.zeros(1), np.zeros(1))[0]
    unigram = totals.parent(guests, parents)
    assert unigram.sum() + unknown == pytest.approx(1, abs=1e-6)
    for k in range(CONTEXTS):
        n, t = np.zeros(len(rows)), np.zeros(len(rows))
        for i, r in enumerate(rows):
            if k in r["context"]:
                n[i], t[i] = r["n"][r["context"].index(k)], r["tables"][r["context"].index(k)]
        assert totals.predict(n, t, k, unigram).sum() + totals.predict(0, 0, k, unknown) == pytest.approx(1, abs=1e-6)


def test_stirling():
    s = log_stirling(0.5, 8)
    assert np.exp(s[3, 1:4]) == pytest.approx([0.75, 1.5, 1.0])  # S(3, 1) = (1 - d)(2 - d), S(3, 2) = 3 (1 - d)
    assert isinstance(Totals(1, 1, np.ones(1), np.ones(1), 1.0, 0.5, 0.5).open(), np.ndarray)


@pytest.mark.parametrize(("discount", "a"), [(0.5, 2.0), (0.7, 0.5), (0.8, 20.0), (0.5, 300.0)])
def test_seating(discount, a):
    """Draws have the mean and the variance of the exact row, below and above the tabulated numbers of customers."""
    seats, exact, n = Seats(discount), log_stirling(discount, 1500), 60_000
    for c in (3, 65, 200, 600, 1500):
        t = np.arange(1, c + 1)
        p = np.exp((row := exact[c, 1:] + np.arange(1, 1501) * np.log(a))[:c] - row[:c].max())
        p /= p.sum()
        mean = (p * t).sum()
        drawn = seats.draw(np.full(n, c), np.full(n, a), mix64(np.arange(n) + c))
        assert drawn.mean() == pytest.approx(mean, rel=0.02) and drawn.var() == pytest.approx((p * t * t).sum() - mean**2, rel=0.04, abs=1e-3)
    far = seats.draw(np.full(n, 10**9), np.full(n, 2.0), mix64(np.arange(n)))
    assert far.mean() == pytest.approx(1 + 2 / discount, rel=0.02)  # one more than a Poisson number
    assert (seats.draw(np.full(9, 1), np.full(9, 5.0), mix64(np.arange(9))) == 1).all()


def test_seats_of_unlike_groups():
    """One call for groups with up to 512 customers and many tables, and groups of a million with few."""
    seats, n = Seats(0.5), 4000
    customers, a = np.tile([400, 10**6], n), np.tile([300.0, 2.0], n)
    drawn = seats.draw(customers, a, mix64(np.arange(2 * n)))
    alone = [seats.draw(customers[i::2], a[i::2], mix64(np.arange(2 * n))[i::2]) for i in (0, 1)]
    assert (drawn[0::2] == alone[0]).all() and (drawn[1::2] == alone[1]).all()


def plain_seating(context, word, words, totals, sweeps):
    """Predictive probabilities [context, word] of customers that leave and sit down one by one; the last word is unknown."""
    rng = random.Random(4)
    tables = collections.defaultdict(list)  # sizes by (restaurant, word); the parent's restaurant is -1
    sizes, opened = collections.Counter(), collections.Counter()
    discount = lambda r: totals.parent_discount if r == -1 else totals.discount

    def chance(r, w):
        below = 1 / (words + 1) if r == -1 else chance(-1, w)
        own = sum(tables[r, w]) - discount(r) * len(tables[r, w]) if w is not None else 0
        return (own + (1 + discount(r) * opened[r]) * below) / (1 + sizes[r])

    def sit(r, w):
        new = (1 + discount(r) * opened[r]) * (1 / (words + 1) if r == -1 else chance(-1, w))
        shares = [s - discount(r) for s in tables[r, w]] + [new]
        at = rng.choices(range(len(shares)), shares)[0]
        sizes[r] += 1
        if at < len(tables[r, w]):
            tables[r, w][at] += 1
        else:
            tables[r, w].append(1)
            opened[r] += 1
            if r != -1:
                sit(-1, w)

    def leave(r, w):
        at = rng.choices(range(len(tables[r, w])), tables[r, w])[0]
        sizes[r] -= 1
        tables[r, w][at] -= 1
        if not tables[r, w][at]:
            del tables[r, w][at]
            opened[r] -= 1
            if r != -1:
                leave(-1, w)

    for r, w in zip(context, word, strict=True):
        sit(r, w)
    out = collections.Counter()
    for sweep in range(sweeps):
        for r, w in zip(context, word, strict=True):
            leave(r, w)
            sit(r, w)
        if sweep >= sweeps // 3:
            for r in set(context):
                for w in [*range(words), None]:
                    out[r, w] += chance(r, w) / (sweeps - sweeps // 3)
    return out


def test_scores_against_plain_seating(spark):
    rng = random.Random(6)
    follows = {w: rng.sample(WORDS, 3) for w in WORDS}

    def text(n):
        out = [rng.choice(WORDS)]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]] if rng.random() < 0.8 else WORDS))
        return " ".join(out)

    rows = [(i, text(rng.randint(10, 60))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    t = tokens_of(learn)
    _, totals = train(frame)
    plain = plain_seating(t.context.tolist(), t.word.tolist(), len(t.keys), totals, 60)
    number = {k: i for i, k in enumerate(t.keys.tolist())}
    got = {r["doc_id"]: r["score"] for r in score_texts(frame).collect()}
    unseen = {k: 1 / (len(t.keys) + 1) for k in range(CONTEXTS)}
    own = {i: tokens_of([x]) for i, x in rows}
    want = {i: sum(math.log10(plain.get((c, number.get(o.keys[w])), unseen[c])) for c, w in zip(o.context.tolist(), o.word.tolist(), strict=True))
            for i, o in own.items()}
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.03)
    assert all(got[i] == pytest.approx(want[i], rel=0.1) for i in got)


def test_word_contexts(spark):
    """Words of one class (equal endings) have followers of their own; scores are those of the model's rows, looked up one by one."""
    rows = [(i, " ".join(rng.choice(("baking flour", "biking tyres", "baking flour sugar", "biking tyres pump")) for _ in range(12))) for i in range(60)
            for rng in [random.Random(i)]] + [(None, "baking pump odd"), (60, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    pairs, seated, totals = learn(frame.fillna("", "text"), words=True)
    followed = {(r["before"], r["key"]): (r["n"], r["tables"]) for r in pairs.collect()}
    words = {r["key"]: r for r in seated.collect()}
    for before, r in words.items():
        own = [x for (u, _), x in followed.items() if u == before]
        assert (sum(n for n, _ in own), sum(t for _, t in own)) == (r["total"], r["follow"])
        assert all(1 <= t <= n for n, t in own)
    for k in range(CONTEXTS):  # the classes' customers are the pairs' tables
        assert sum(r["n"][r["context"].index(k)] for r in words.values() if k in r["context"]) == totals.customers[k]

    def chance(word, before, context):
        r = words.get(word)
        at = r["context"].index(context) if r and context in r["context"] else None
        parent = totals.parent(sum(r["tables"]), r["parent_tables"]) if r else totals.parent(0, 0)
        below = totals.predict(r["n"][at] if at is not None else 0, r["tables"][at] if at is not None else 0, context, parent)
        u = words.get(before)
        n, t = followed.get((before, word), (0, 0))
        return (n - totals.pair_discount * t + (1 + totals.pair_discount * (u["follow"] if u else 0)) * below) / (1 + (u["total"] if u else 0))

    kind = {}
    want = {}
    for i, text in rows:
        t = tokens_of([text or ""])
        keys = t.keys.view(np.int64).tolist()
        kind |= {keys[b]: c for b, c in zip(t.before.tolist(), t.context.tolist(), strict=True)}
        want[i] = sum(math.log10(chance(keys[w], keys[b], c)) for w, b, c in zip(t.word.tolist(), t.before.tolist(), t.context.tolist(), strict=True))
    for before in words:
        assert sum(chance(w, before, kind[before]) for w in [*words, None]) == pytest.approx(1, abs=1e-6)
    for most in ({}, {"head": 3, "pairs": 2}):  # by the arrays, and by the shuffle
        got = {r["doc_id"]: r["score"] for r in score_texts(frame, words=True, **most).collect()}
        assert got == pytest.approx(want, rel=1e-5)
    held = [i for i, t in rows if i is not None and t and zlib.crc32(str(i).encode()) % 7 == 2]
    classes = {r["doc_id"]: r["score"] for r in score_texts(frame).collect()}
    assert held and sum(want[i] for i in held) > 0.85 * sum(classes[i] for i in held)


@pytest.mark.parametrize("operator", [
    lambda d: count_tokens(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: pack(d, public_tokenizers.path("byte_bpe_50k.json")), chained, score_texts])
def test_no_documents(none, operator):
    assert operator(none).collect() == []
