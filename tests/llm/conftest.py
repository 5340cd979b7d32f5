import random

import pytest

WORDS = "the of and to in law river stone cloud field winter green silent harbour engine paper market garden".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "er", "ing", "ly"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Hand-made documents: copies, near copies, nulls, empty, odd and long texts, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    texts += texts[:10]  # exact copies
    texts += [t + " end" for t in texts[20:30] if len(t) > 600]
    texts += [None, "", "   \n\t ", "é", "a b  c \n d", "<|endoftext|> x<|startoftext|>", "İstanbul ΣΑΣ 日本語 🙂🙂", "x" * 5000,
              prose(rng, 20_000), "aaaa aaaa aaaa aaaa aaaa"]
    rows = [(i, t, "n", 1.0, 7) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "n", 1.0, 7)] * 2 + [(None, "without id", "n", 1.0, 7), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, bits string, n_tokens double, _text int").repartition(3)


@pytest.fixture(scope="session")
def rows_of(corpus):
    return [(r["doc_id"], r["text"] or "") for r in corpus.collect()]


@pytest.fixture(scope="session")
def none(corpus):
    return corpus.where("false")
