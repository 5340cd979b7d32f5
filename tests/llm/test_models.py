"""Toxicity, mixing and chat repair; the pipeline; what queries there are."""

import itertools
import random

import numpy as np
import pytest

from polisframe.llm import mixing, toxicity
from polisframe.llm.chat_repair import ASSISTANT, CLOSING, INSERT, LABEL, MERGE, RELABEL, START, _NEXT, forward, repair, repair_chats
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad, poor = i % 5 == 0, i % 4 == 1
        t = prose(rng, rng.randint(20, 120)).split()
        for _ in range(max(2, len(t) // 30) if bad else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["scumbag", "lowlifes", "lowlifer", "vermin"]))
        text = " ".join(t)
        rows.append((i, text.upper().replace(" ", "!! ") if poor else text, "a", 0.5))
        if i % 2:
            labels.append((i, int(not poor), int(bad)))
    for i in range(0, 600, 10):  # toxic ones with a label
        labels.append((i, 1, 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string, rate double")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(marked, corpus, none):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "p_clean", "p_toxic", "p_heavy", "expected_severity", "toxic"]
    rows = got.collect()  # by place: own columns come first, whatever their names
    wrong = [r[0] for r in rows if r[8] != (r[0] % 5 == 0)]
    assert len(wrong) <= 6
    assert all(abs(r[4] + r[5] + r[6] - 1) < 1e-9 and abs(r[7] - r[5] - 2 * r[6]) < 1e-9 for r in rows)
    assert toxicity.clean(docs, model).count() == sum(not r[8] for r in rows)
    assert toxicity.score(corpus, model).count() == corpus.count()
    assert toxicity.clean(corpus, model).columns == corpus.columns
    assert toxicity.score(none, model).collect() == []
    blank = toxicity.fit(none, labels.where("false"))
    assert not any(r["toxic"] for r in toxicity.score(corpus, blank).collect())


def test_cumulative_link_gradient():
    rng = np.random.default_rng(0)
    active = [np.array(sorted(rng.choice(6, rng.integers(0, 4), replace=False)), np.int64) for _ in range(300)]
    grades = np.array([min(2, int((a == 0).any()) + int((a == 1).any())) for a in active])
    w, t = toxicity.fit_cumulative(active, grades, 6)
    assert t[0] < t[1] and w[0] > 2 and w[1] > 2 and abs(w[2:]).max() < min(w[0], w[1])
    p = toxicity.Severity(np.arange(6, dtype=np.uint64), w, t).probabilities([a.tolist() for a in active])
    assert (p.argmax(axis=1) == grades).mean() > 0.95


def test_mixing(marked, corpus, none):
    docs, labels = marked
    domain = labels.selectExpr("doc_id", "1 - quality AS domain")
    out = mixing.mix(docs, domain, [0.5, 0.5])
    rows = [(r[4], np.array(r[5]), r[6], r[7]) for r in out.collect()]
    tokens = sum(n * rate * p for n, p, rate, _ in rows)
    assert tokens / tokens.sum() == pytest.approx([0.5, 0.5], abs=1e-3) and min(r[2] for r in rows) >= 0
    drawn = sum(n * c * p for n, p, _, c in rows)
    assert drawn / drawn.sum() == pytest.approx([0.5, 0.5], abs=0.05)
    right = np.mean([(p.argmax() == 1) == (i % 4 == 1) for i, (_, p, _, _) in zip([r[0] for r in out.select(out.columns[0]).collect()], rows, strict=True)])
    assert right > 0.95
    kept = mixing.mixed_rows(docs, domain, [0.5, 0.5], least=1.0)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == docs.count() <= kept.count()
    assert mixing.mix(corpus, domain, [0.5, 0.5]).count() == corpus.count()
    assert mixing.mix(none, domain, [0.5, 0.5]).collect() == []
    assert mixing.mix(corpus, domain.where("false"), [0.5, 0.5]).count() == corpus.count()


def test_rates_by_brute_force(spark):
    """Held against plain projected gradient on the same objective, run long."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    n = rng.integers(1, 50, 200)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens bigint, posterior array<double>")
    steps = mixing.fit_rates(members, [0.7, 0.2, 0.1], tokens=float(n.sum()), near=1e-8, rounds=40)
    r = np.ones(200)
    for g in steps:
        r = np.maximum(0, r + p @ g)
    total = (r * n) @ p
    assert total / n.sum() == pytest.approx([0.7, 0.2, 0.1], abs=1e-4)
    x = np.ones(200)
    a = n[:, None] * p
    step = 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(20_000):
        x = np.maximum(0, x - step * a @ (x @ a - n.sum() * np.array([0.7, 0.2, 0.1])))
    assert np.abs(x @ a - n.sum() * np.array([0.7, 0.2, 0.1])).max() / n.sum() < 1e-3  # both meet the targets


def brute(roles):
    """Least cost over all ways to open or merge every turn."""
    best = 1 << 30
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            state, cost = START, 0
            for role, new, merge in zip(roles, labels, merges, strict=True):
                cost += 0 if new == role else LABEL if role == 0 else RELABEL
                if merge:
                    if new != state:
                        cost = 1 << 30
                        break
                    cost += MERGE
                    continue
                fills = 0
                while new not in _NEXT[state]:
                    state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                    fills += 1
                    if fills > 3:
                        break
                cost += INSERT * fills if fills <= 3 else 1 << 30
                state = new
            best = min(best, cost + INSERT * len(CLOSING[state]))
    return best


@pytest.mark.parametrize("roles", [r for n in (1, 2, 3) for r in itertools.product(range(4), repeat=n)])
def test_repair_is_cheapest(roles):
    end, acts = repair(list(roles))
    costs = forward(list(roles), START)[0][-1]
    assert costs[end] + INSERT * len(CLOSING[end]) == brute(roles)
    state = START
    for new, what, fill in acts:
        for f in fill:
            assert f in _NEXT[state]
            state = f
        assert (new == state) if "merge" in what else (new in _NEXT[state])
        state = new
    for c in CLOSING[state]:
        assert c in _NEXT[state]
        state = c
    assert state == ASSISTANT


def test_chats(spark):
    turns = [("c", None, None), ("user", "hi", 1), ("User ", "there", 2), ("assistant", "yes", 3), ("tool", None, 4), ("assistant", "", 5), ("system", "x", 6)]
    rows = [(1, t, r, x) for r, x, t in turns] + [(2, 1, "assistant", "alone")] + [(None, 1, "user", "q")]
    rng = random.Random(2)
    rows += [(9, i, rng.choice(["user", "assistant", "gpt", "odd", None]), f"t{i}") for i in range(400)]  # spans partitions
    rows += [(9, 7, "user", "t7")] * 3
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS key", "'x' AS kind").repartition(5)
    got = repair_chats(df).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:2]) + ((r[2] is not None, r[2] or ""),)
    kinds = {"user": 2, "assistant": 3, "gpt": 3, "system": 1}
    for conv in (1, 2, None, 9):
        mine = sorted((r for r in got if r["conv_id"] == conv), key=key)
        roles = [kinds.get((r["role"] or "").strip().lower(), 0) for r in mine]
        cost = forward(roles, START)[0][-1]
        best = min(cost[q] + INSERT * len(CLOSING[q]) for q in range(4))
        paid = sum((MERGE if "merge" in r["action"] else 0) + (0 if "relabel" not in r["action"] else LABEL if k == 0 else RELABEL) + INSERT * len(r["inserted"])
                   for r, k in zip(mine, roles, strict=True))
        text = "".join(r["rendered"] for r in mine) if conv != 9 else None
        last = {"user": 2, "assistant": 3, "system": 1}[mine[-1]["new_role"]]
        assert paid + INSERT * len(CLOSING[last]) == best
        if text is not None:
            spoken = [p.split("\n", 1)[0] for p in text.split("<|im_start|>")[1:]]
            assert spoken[-1] == "assistant" and text.endswith("<|im_end|>\n") and text.count("<|im_start|>") == text.count("<|im_end|>")
            assert all(a != b for a, b in itertools.pairwise(spoken))
    assert repair_chats(df.where("false")).collect() == []


def test_pipeline(spark, marked):
    import corpus_pipeline as c

    docs, _ = marked
    docs = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "bigint(length(text)) AS n_chars")
    sf = "/root/testdata/sf0.001"
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    given = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "z")]], docs.schema)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in c.dedup(spark, given, sf).collect()) == [(False, 1), (False, 3), (True, None)]
    assert c.run(spark, sf).count() > 0


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
