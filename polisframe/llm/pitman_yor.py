"""LM scoring with a hierarchical Pitman-Yor model (Teh, "A hierarchical Bayesian language model based on Pitman-Yor processes", 2006).

A token's context is the word before it, whole (the end stands before a text's first word). Every such context is a restaurant; its tables are
customers of the restaurant of its word's class, one of ``CONTEXTS`` by the last three bytes (0: the text begins); the tables of those are customers of the
unigram restaurant, whose own base is uniform over the training vocabulary and one unknown word.

Training counts of word pairs are gathered by one shuffle, already summed in the tasks. Tables of pairs are drawn pair by pair, given the table totals of
the contexts and what the class restaurants predict, which reach the pairs by joins; a pair that was seen once has one table. The class restaurants' customers
are sums of these: a word with its at most ``CONTEXTS`` classes is one row. Seating is sampled by blocked Gibbs over table counts: given the table totals of
the restaurants, a sweep draws, word by word, how many tables serve it in each class, from the conditional S_d(c, t) a^t with the generalised
Stirling numbers S (``seating``), and then the word's tables in the unigram restaurant. Totals are exchanged between rounds; table counts of the classes are
averaged over the sweeps after burn-in, and the predictive probabilities sum to one.

Scoring reads the texts once more. The logarithm of a token's probability is that of its word in its class, the share that its context leaves to the class (a
number of the word before), and, where training has the pair, what the pair adds. The ``HEAD`` most frequent words are a matrix of bounded size, the
``PAIRS`` most frequent pairs an array, both broadcast to all tasks; all other tokens and pairs meet their row of the model in one shuffle, so nothing is
left out. Words and pairs are known by 64-bit hashes. Draws are fixed by pair, word, class and sweep, so tasks that run again give the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import mix64, starts_of, stored, text_column, text_slices, whole_groups
from polisframe.llm.seating import Seats

CONTEXTS, HEAD, PAIRS = 64, 1 << 16, 1 << 20
#: Rows of counts that a task holds before it sums them.
HELD = 1_500_000
BURN_IN, SWEEPS, ROUNDS = 2, 5, 2
#: Model rows, document rows and a pair's model rows among those of tokens, whose tag is a class, and of their pairs.
MODEL, DOCUMENT, PAIR_MODEL, PAIR = -1, -2, -3, CONTEXTS


@dataclass
class Tokens:
    """Tokens of a slice of texts: per token its word and the word before (numbers in ``keys``), the class of that and the text."""

    keys: np.ndarray
    word: np.ndarray
    before: np.ndarray
    context: np.ndarray
    text: np.ndarray
    sizes: np.ndarray


def tokens_of(texts: list[str]) -> Tokens:
    words: list[bytes] = []
    sizes = []
    for t in texts:
        own = t.encode().lower().split()  # of bytes: A-Z and ASCII white space only
        words += own
        words.append(b"")  # the end
        sizes.append(len(own) + 1)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    keys = np.fromiter((xxhash.xxh64_intdigest(w, 3) for w in number), np.uint64, len(number))
    kind = np.fromiter((1 + zlib.crc32(w[-3:]) % (CONTEXTS - 1) if w else 0 for w in number), np.int64, len(number))
    word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    before = np.concatenate([word[-1:], word[:-1]])  # the last one is an end
    return Tokens(keys, word, before, kind[before], np.repeat(np.arange(len(texts)), sizes), np.array(sizes, np.int64))


def pair_hash(key: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix64(key ^ mix64(before))


def held_out(ids: list[int | None]) -> np.ndarray:
    """Whether crc32 of the id as text leaves 2 modulo 7; rows without id are held out, too."""
    return np.array([i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def put():
        key, before, context, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((before, key))
        key, before, context, n = key[order], before[order], context[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (before[1:] != before[:-1])]))
        return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(before[first].view(np.int64)),
                                           pa.array(context[first].astype(np.int32)), pa.array(np.add.reduceat(n, first))], ["key", "before", "context", "n"])

    for batch in text_slices(batches):
        learn = ~held_out(batch.column("doc_id").to_pylist())
        t = tokens_of([x for x, ok in zip(batch.column("text").to_pylist(), learn.tolist(), strict=True) if ok])
        code, at, n = np.unique(t.word * len(t.keys) + t.before, return_index=True, return_counts=True)
        if len(code):
            held.append((t.keys[t.word[at]], t.keys[t.before[at]], t.context[at], n.astype(np.int64)))
        if sum(len(h[0]) for h in held) > HELD:
            yield put()
    if held:
        yield put()


def _dishes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a word; the row of class -1, the first of each word, counts the tables of its own restaurant."""
    for batch in whole_groups(batches, "key"):
        key, context, n, tokens = (batch.column(c).to_numpy() for c in ("key", "context", "n", "tokens"))
        first, rest = starts_of(key), context >= 0
        bounds = pa.array(np.append(first - np.arange(len(first)), rest.sum()), pa.int32())
        yield pa.RecordBatch.from_arrays([
            pa.array(key[first]), pa.array(np.add.reduceat(tokens, first)), pa.array(n[first]), pa.ListArray.from_arrays(bounds, pa.array(context[rest])),
            pa.ListArray.from_arrays(bounds, pa.array(n[rest]))], ["key", "total", "follow", "context", "n"])


@dataclass
class Totals:
    """What the restaurants have in all; small whatever the corpus."""

    vocabulary: int
    tokens: int
    customers: np.ndarray  # of each class: the tables of its words' restaurants
    tables: np.ndarray  # of each class, which are the parent's customers
    parent_tables: float
    discount: float
    parent_discount: float
    concentration: float = 1.0
    pair_discount: float = 0.5

    def open(self) -> np.ndarray:
        """What a new table's share is multiplied with, by class."""
        return self.concentration + self.discount * self.tables

    def parent(self, tables: np.ndarray, parent_tables: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of words with so many customers and tables; of unknown words with none."""
        base = (self.concentration + self.parent_discount * self.parent_tables) / (self.vocabulary + 1)
        return (tables - self.parent_discount * parent_tables + base) / (self.concentration + self.tables.sum())

    def predict(self, n: np.ndarray, tables: np.ndarray, context: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (n - self.discount * tables + self.open()[context] * parent) / (self.concentration + self.customers[context])

    def open_pair(self, follow: np.ndarray) -> np.ndarray:
        """What a new table's share is multiplied with in the restaurant of a word, which has ``follow`` tables."""
        return self.concentration + self.pair_discount * follow

    def left(self, total: np.ndarray, follow: np.ndarray) -> np.ndarray:
        """log10 of the share that the restaurant of a word with ``total`` tokens leaves to its class."""
        return np.log10(self.open_pair(follow) / (self.concentration + total))


def seat(keys: np.ndarray, dish: np.ndarray, context: np.ndarray, n: np.ndarray, totals: Totals, seats: tuple[Seats, Seats]
         ) -> tuple[np.ndarray, np.ndarray]:
    """(tables of each word and context, the parent's tables of each word), averaged over the sweeps after burn-in."""
    tables, words = np.ones(len(n), np.int64), len(keys)
    parent_a = np.full(words, (totals.concentration + totals.parent_discount * totals.parent_tables) / (totals.vocabulary + 1))
    many = np.flatnonzero(n > 1)
    mean, parent_mean = np.zeros(len(n)), np.zeros(words)
    for sweep in range(SWEEPS):
        seed = mix64(np.array([sweep * 7919 + 17], np.uint64))[0]
        guests = np.bincount(dish, tables, words).astype(np.int64)
        parent = seats[1].draw(guests, parent_a, mix64(keys + seed))
        p = totals.parent(guests, parent)
        a = totals.open()[context[many]] * p[dish[many]]
        noise = mix64(keys[dish[many]] ^ (seed + context[many].astype(np.uint64)))
        tables[many] = seats[0].draw(n[many], a, noise)
        if sweep >= BURN_IN:
            mean += tables
            parent_mean += parent
    return mean / (SWEEPS - BURN_IN), parent_mean / (SWEEPS - BURN_IN)


def _seated(batches: Iterator[pa.RecordBatch], totals: Totals, seats: tuple[Seats, Seats]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("n").value_lengths().to_numpy()
        dish = np.repeat(np.arange(len(sizes)), sizes)
        context, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("context", "n"))
        tables, parent = seat(batch.column("key").to_numpy().view(np.uint64), dish, context, n, totals, seats)
        bounds = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("key", "total", "follow", "context", "n")),
            pa.ListArray.from_arrays(bounds, pa.array(tables.astype(np.float32))), pa.array(parent)],
            ["key", "total", "follow", "context", "n", "tables", "parent_tables"])


_DISH = "key bigint, total bigint, follow bigint, context array<int>, n array<bigint>"
_SEATED = _DISH + ", tables array<float>, parent_tables double"


def _table_sums(seated: DataFrame) -> tuple[np.ndarray, float]:
    """(tables of each context, the parent's tables): the sums of the averages."""
    spread = seated.select(F.posexplode("context").alias("i", "k"), "tables").select("k", F.get("tables", F.col("i")).cast("double").alias("t"))
    rows = spread.groupBy("k").agg(F.sum("t").alias("t")).collect()  # one per context
    tables = np.zeros(CONTEXTS)
    for r in rows:
        tables[r["k"]] = r["t"]
    return tables, float(seated.agg(F.sum("parent_tables").alias("p")).first()["p"] or 0.0)


def _discount(ones: int, twos: int) -> float:
    return min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))


def _chances(batches: Iterator[pa.RecordBatch], totals: Totals) -> Iterator[pa.RecordBatch]:
    """What the class restaurants predict for each word that they have."""
    for batch in batches:
        sizes = batch.column("n").value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        context, n, tables = (batch.column(c).flatten().to_numpy() for c in ("context", "n", "tables"))
        parent = totals.parent(np.bincount(row, tables, len(sizes)), batch.column("parent_tables").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(batch.column("key").to_numpy()[row]), pa.array(context), pa.array(totals.predict(n, tables, context, parent[row]))],
                                         ["key", "context", "chance"])


def _pair_tables(batches: Iterator[pa.RecordBatch], totals: Totals, seats: Seats, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, before = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "before"))
        a = totals.open_pair(batch.column("follow").to_numpy()) * batch.column("chance").to_numpy()
        tables = seats.draw(batch.column("n").to_numpy(), a, pair_hash(key, before) + np.uint64(seed))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "before", "context", "n")), pa.array(tables)], ["key", "before", "context", "n", "tables"])


def _gains(batches: Iterator[pa.RecordBatch], totals: Totals) -> Iterator[pa.RecordBatch]:
    """What a pair's own customers add to log10 of the probability, beside what its context leaves to the class."""
    for batch in batches:
        key, before = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "before"))
        own = batch.column("n").to_numpy() - totals.pair_discount * batch.column("tables").to_numpy()
        gain = np.log10(1 + own / (totals.open_pair(batch.column("follow").to_numpy()) * batch.column("chance").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(key, before).view(np.int64)), batch.column("n"), pa.array(gain.astype(np.float32))], ["pair", "n", "gain"])


def _met_pairs(pairs: DataFrame, seated: DataFrame, totals: Totals) -> DataFrame:
    """The pairs with their class's prediction and the tables of the word before."""
    chances = seated.mapInArrow(lambda b: _chances(b, totals), "key bigint, context int, chance double")
    return pairs.join(chances, ["key", "context"]).join(seated.select(F.col("key").alias("before"), "follow"), "before")


def learn(docs: DataFrame, words: bool) -> tuple[DataFrame, DataFrame, Totals]:
    """(word pairs with counts and tables, one row per training word with its classes' counts and tables, totals) of ``docs`` (doc_id, text).

    Without ``words`` the classes are the only contexts: a pair has as many tables as customers, which is a discount of one.
    """
    counted = docs.mapInArrow(_counts, "key bigint, before bigint, context int, n bigint").groupBy("key", "before", "context").agg(F.sum("n").alias("n"))
    pairs = once = stored(counted.withColumn("tables", F.lit(1).cast("bigint") if words else F.col("n")), release=True)
    kinds = [F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")]
    pair_discount = _discount(*pairs.agg(*kinds).first()) if words else 1.0
    seated, totals, seats = None, None, None
    for i in range(ROUNDS):
        if i and words:
            now = totals
            many = _met_pairs(pairs.where("n > 1"), seated, now)
            drawn = many.mapInArrow(lambda b, now=now, i=i: _pair_tables(b, now, seats.value[2], i), pairs.schema)
            pairs = stored(drawn, release=True).unionByName(once.where("n = 1"))
        summed = pairs.groupBy("key", "context").agg(F.sum("tables").alias("n"), F.sum("n").alias("tokens"))
        own = pairs.groupBy(F.col("before").alias("key")).agg(F.lit(-1).alias("context"), F.sum("tables").alias("n"), F.lit(0).cast("bigint").alias("tokens"))
        dishes = stored(summed.unionByName(own).repartition("key").sortWithinPartitions("key", "context").mapInArrow(_dishes, _DISH), release=True)
        classes = dishes.select(F.explode(F.arrays_zip("context", "n")).alias("p")).groupBy("p.context").agg(
            F.sum("p.n").alias("c"), F.count("*").alias("d"), F.count_if(F.col("p.n") == 1).alias("ones"), F.count_if(F.col("p.n") == 2).alias("twos")).collect()
        customers, tables = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
        for r in classes:  # one per class
            customers[r["context"]], tables[r["context"]] = r["c"], r["d"]
        if totals is None:
            all_words = dishes.agg(F.count("*").alias("v"), F.sum("total").alias("all"), F.count_if(F.col("total") == 1).alias("ones"),
                               F.count_if(F.col("total") == 2).alias("twos")).first()
            totals = Totals(all_words["v"], all_words["all"] or 0, customers, tables, float(all_words["v"]), _discount(sum(r["ones"] for r in classes), sum(r["twos"] for r in classes)),
                            _discount(all_words["ones"], all_words["twos"]), pair_discount=pair_discount)
            # tables of a fixed size
            seats = docs.sparkSession.sparkContext.broadcast((Seats(totals.discount), Seats(totals.parent_discount), Seats(pair_discount) if words else None))
        now = replace(totals, customers=customers)
        seated = stored(dishes.mapInArrow(lambda b, now=now: _seated(b, now, seats.value), _SEATED))
        tables, parent_tables = _table_sums(seated)
        totals = replace(now, tables=tables, parent_tables=parent_tables)
    return pairs, seated, totals


def train(docs: DataFrame) -> tuple[DataFrame, Totals]:
    """With the classes as the only contexts: (one row per training word with its counts and tables, totals) of ``docs`` (doc_id, text)."""
    return learn(docs, words=False)[1:]


@dataclass
class Head:
    """The most frequent words: keys (sorted), counts, log10 probability by word and class, and of what their restaurant leaves to the class."""

    keys: np.ndarray
    total: np.ndarray
    score: np.ndarray
    left: np.ndarray


def _least(rows: DataFrame, count: str, most: int) -> int:
    """The least count (2 at least) that at most ``most`` rows reach."""
    sizes = rows.where(F.col(count) > 1).groupBy(F.col(count).alias("c")).agg(F.count("*").alias("n"))
    # counts of counts: few rows, as counts of frequent words are few
    at_least, so_far = 2, 0
    for r in sorted(sizes.collect(), key=lambda r: -r["c"]):
        if so_far + r["n"] > most:
            return r["c"] + 1
        so_far += r["n"]
    return at_least


def head_of(seated: DataFrame, totals: Totals, most: int = HEAD) -> tuple[Head, int]:
    """(the words with at least a count for which there are at most ``most``, that count)."""
    at_least = _least(seated, "total", most)
    got = seated.where(F.col("total") >= at_least).toArrow()  # at most ``most`` rows
    key = got["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    sizes = got["n"].combine_chunks().value_lengths().to_numpy() if len(key) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(key)), sizes)
    context, n, tables = (got[c].combine_chunks().flatten().to_numpy() if len(key) else np.zeros(0, np.int64) for c in ("context", "n", "tables"))
    guests = np.bincount(row, tables, len(key))
    parent = totals.parent(guests, got["parent_tables"].to_numpy())
    score = np.empty((len(key), CONTEXTS), np.float32)
    for k in range(CONTEXTS):
        score[:, k] = np.log10(totals.predict(0.0, 0.0, k, parent))
    score[row, context] = np.log10(totals.predict(n, tables, context, parent[row]))
    total = got["total"].to_numpy()
    left = totals.left(total, got["follow"].to_numpy())
    return Head(key[order], total[order], score[order], left[order]), at_least


def frequent_pairs(gains: DataFrame, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray, int]:
    """(the pairs, sorted, with at least a count for which there are at most ``most``, what they add, that count)."""
    at_least = _least(gains, "n", most)
    got = gains.where(F.col("n") >= at_least).select("pair", "gain").toArrow()  # at most ``most`` rows
    pair = got["pair"].to_numpy().view(np.uint64)
    order = np.argsort(pair)
    return pair[order], got["gain"].to_numpy()[order], at_least


def _pairs_in(t: Tokens, often: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of pairs, per other pair and text: the pair's number there, the text and how often; what the pairs in ``often`` give, by text)."""
    n, words = len(t.sizes), len(t.keys)
    pair, number = np.unique(t.word * words + t.before, return_inverse=True)
    code, times = np.unique(number * n + t.text, return_counts=True)
    of, text = code // n, code % n
    pair = pair_hash(t.keys[pair // words], t.keys[pair % words])
    place = np.minimum(np.searchsorted(often, pair), max(0, len(often) - 1))
    known = (often[place] == pair if len(often) else np.zeros(len(pair), bool))[of]
    added = np.bincount(text[known], times[known] * gain[place[of[known]]], n)
    return pair, of[~known], text[~known], times[~known], added


def _scored(batches: Iterator[pa.RecordBatch], shared, totals: Totals) -> Iterator[pa.RecordBatch]:
    """Document rows with what frequent words and pairs give, and rows of the other tokens and pairs."""
    head: Head
    head, pairs, gain = shared.value
    row = TaskContext.get().partitionId() << 33
    base = np.log10((head.total + 1) / (totals.tokens + totals.vocabulary + 1))
    for batch in text_slices(batches):
        ids = batch.column("doc_id").to_pylist()
        t = tokens_of(batch.column("text").to_pylist())
        at = np.minimum(np.searchsorted(head.keys, t.keys), max(0, len(head.keys) - 1))
        known = head.keys[at] == t.keys if len(head.keys) else np.zeros(len(t.keys), bool)
        ok = known[t.word]
        w, k, d = at[t.word[ok]], t.context[ok], t.text[ok]
        n = len(ids)
        pair, of_pair, with_pair, times, added = _pairs_in(t, pairs, gain) if pairs is not None else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, 0)
        sums = np.column_stack([np.bincount(d, minlength=n), np.bincount(d, base[w], n), np.bincount(d, head.score[w, k].astype(np.float64) + head.left[w], n) + added])
        rows = row + np.arange(n)
        # the other tokens, summed by text, word and context
        code = (t.text[~ok] * len(t.keys) + t.word[~ok]) * CONTEXTS + t.context[~ok]
        code, often = np.unique(code, return_counts=True)
        word = code // CONTEXTS % max(1, len(t.keys))
        of = code // CONTEXTS // max(1, len(t.keys))
        held = held_out(ids)
        payload = [np.array([n_t, *s, h, i is None, i or 0], object) for n_t, s, h, i in zip(t.sizes.tolist(), sums.tolist(), held.tolist(), ids, strict=True)]
        packed = [np.array([p[0], p[1], p[4], p[5], p[6]], np.int64).tobytes() + np.array([p[2], p[3]], np.float64).tobytes() for p in payload]
        m = len(code) + len(times)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([mix64(rows.astype(np.uint64)), t.keys[word], pair[of_pair]]).view(np.int64)),
            pa.array(np.concatenate([np.full(n, DOCUMENT), code % CONTEXTS, np.full(len(times), PAIR)]).astype(np.int32)),
            pa.array(np.concatenate([rows, rows[of], rows[with_pair]])), pa.array(np.concatenate([np.ones(n, np.int64), often, times]).astype(np.int32)),
            pa.concat_arrays([pa.array(packed, pa.binary()), pa.nulls(m, pa.binary())]), pa.nulls(n + m, pa.float32())],
            ["key", "tag", "row", "n", "payload", "gain"])
        row += n


_MET = "key bigint, tag int, row bigint, n int, payload binary, gain float"


def _model_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("context", "n", "tables")]
        payload = []
        numbers = zip(*(batch.column(c).to_pylist() for c in ("total", "parent_tables", "follow")), strict=True)
        for own, context, n, tables in zip(numbers, *columns, strict=True):
            payload.append(np.array(own, np.float64).tobytes() + np.concatenate([context, n, tables]).astype(np.float64).tobytes())
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.full(size, MODEL, np.int32)), pa.nulls(size, pa.int64()),
                                          pa.nulls(size, pa.int32()), pa.array(payload, pa.binary()), pa.nulls(size, pa.float32())],
                                         ["key", "tag", "row", "n", "payload", "gain"])


def _met(batches: Iterator[pa.RecordBatch], totals: Totals) -> Iterator[pa.RecordBatch]:
    """Sums per document row; a word's model row comes before the rows of its tokens, and so does a pair's."""
    open_key: int | None = None
    open_model = None
    open_pair: tuple[list, list] = ([], [])
    for batch in batches:
        key, tag = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
        payload = batch.column("payload")
        models, at = ([open_model], [open_key]) if open_model is not None else ([], [])
        here = np.flatnonzero(tag == MODEL)
        models += [np.frombuffer(payload[i].as_py(), np.float64) for i in here.tolist()]
        model_keys = np.array([*at, *key[here].tolist()], np.int64)
        shift = len(at)
        # the last model row at or before each row
        last = np.cumsum(tag == MODEL) - 1 + shift
        token = np.flatnonzero((tag >= 0) & (tag < PAIR))
        m = last[token]
        found = (m >= 0) & (model_keys[np.maximum(m, 0)] == key[token]) if len(model_keys) else np.zeros(len(token), bool)
        n = batch.column("n").fill_null(0).to_numpy().astype(np.int64)[token]
        context = tag[token].astype(np.int64)
        total, guests, parent_tables, follow = (np.zeros(len(token)) for _ in range(4))
        count, tables = np.zeros(len(token)), np.zeros(len(token))
        if models:
            width = np.array([(len(x) - 3) // 3 for x in models], np.int64)
            code = np.concatenate([i * CONTEXTS + x[3:3 + w] for i, (x, w) in enumerate(zip(models, width.tolist(), strict=True))])
            counts = np.concatenate([x[3 + w:3 + 2 * w] for x, w in zip(models, width.tolist(), strict=True)])
            seats = np.concatenate([x[3 + 2 * w:] for x, w in zip(models, width.tolist(), strict=True)])
            all_guests = np.bincount(np.repeat(np.arange(len(models)), width), seats, len(models))
            mm = m[found]
            total[found] = np.array([x[0] for x in models])[mm]
            parent_tables[found] = np.array([x[1] for x in models])[mm]
            follow[found] = np.array([x[2] for x in models])[mm]
            guests[found] = all_guests[mm]
            want = mm * CONTEXTS + context[found]
            pos = np.minimum(np.searchsorted(code, want), len(code) - 1)
            same = code[pos] == want
            count[found], tables[found] = np.where(same, counts[pos], 0.0), np.where(same, seats[pos], 0.0)
        p = totals.predict(count, tables, context, totals.parent(guests, parent_tables))
        base = np.log10((total + 1) / (totals.tokens + totals.vocabulary + 1))
        # the last model row of a pair at or before each row of one
        pair, here_pair = np.flatnonzero(tag == PAIR), np.flatnonzero(tag == PAIR_MODEL)
        pair_keys = np.array([*open_pair[0], *key[here_pair]], np.int64)
        gains = np.array([*open_pair[1], *batch.column("gain").take(pa.array(here_pair)).to_numpy()], np.float64)
        m = (np.cumsum(tag == PAIR_MODEL) - 1 + len(open_pair[0]))[pair]
        met = (m >= 0) & (pair_keys[np.maximum(m, 0)] == key[pair]) if len(pair_keys) else np.zeros(len(pair), bool)
        pair, m = pair[met], m[met]
        times = batch.column("n").fill_null(0).to_numpy()[pair]
        open_pair = (pair_keys[-1:].tolist(), gains[-1:].tolist())
        row = batch.column("row").fill_null(0).to_numpy()
        rows, inverse = np.unique(np.concatenate([row[token], row[pair]]), return_inverse=True)
        own, more = inverse[:len(token)], inverse[len(token):]
        sums = [np.bincount(own, x, len(rows)) for x in (n * found, n * base, n * (np.log10(p) + totals.left(total, follow)))]
        sums[2] = sums[2] + np.bincount(more, times * gains[m], len(rows))
        docs = np.flatnonzero(tag == DOCUMENT)
        whole = np.frombuffer(b"".join(payload[i].as_py()[:40] for i in docs.tolist()), np.int64).reshape(-1, 5)
        parts = np.frombuffer(b"".join(payload[i].as_py()[40:] for i in docs.tolist()), np.float64).reshape(-1, 2)
        none = len(rows)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([rows, batch.column("row").take(pa.array(docs)).to_numpy()])),
            pa.array([*[None] * none, *[None if x[3] else int(x[4]) for x in whole]], pa.int64()),
            pa.array([*[None] * none, *(whole[:, 2] != 0).tolist()], pa.bool_()),
            pa.array(np.concatenate([np.zeros(none, np.int64), whole[:, 0]])),
            pa.array(np.concatenate([sums[0].astype(np.int64), whole[:, 1]])),
            pa.array(np.concatenate([sums[1], parts[:, 0]])), pa.array(np.concatenate([sums[2], parts[:, 1]]))],
            ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        if len(here):
            open_key, open_model = int(key[here[-1]]), models[-1]


def score_texts(docs: DataFrame, head: int = HEAD, pairs: int = PAIRS, words: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score, the model's log10
    probability of the text; perplexity is 10^(-score / n_tokens). ``words``: contexts are the words before, backed by their classes, not the classes alone.

    A null or empty text is one end token. Rows without id are held out and keep a null id. Repeated rows are learned
    from and scored each. Without training rows every word is unknown. Other columns are ignored; no rows give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    counted, seated, totals = learn(texts, words)
    top, at_least = head_of(seated, totals, head)
    often, gain = None, None
    if words:
        gains = stored(_met_pairs(counted, seated, totals).mapInArrow(lambda b: _gains(b, totals), "pair bigint, n bigint, gain float"), release=True)
        often, gain, least_pair = frequent_pairs(gains, pairs)
    shared = docs.sparkSession.sparkContext.broadcast((top, often, gain))  # bounded by ``head`` and ``pairs``
    rows = texts.mapInArrow(lambda b: _scored(b, shared, totals), _MET)
    model = seated.where(F.col("total") < at_least).mapInArrow(_model_rows, _MET)
    if words:
        added = gains.where(F.col("n") < least_pair).select(F.col("pair").alias("key"), F.lit(PAIR_MODEL).alias("tag"), F.lit(None).cast("bigint").alias("row"),
                                                             F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("payload"), "gain")
        model = model.unionByName(added)
    met = rows.unionByName(model).repartition("key").sortWithinPartitions("key", "tag").mapInArrow(
        lambda b: _met(b, totals),
        "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
                                 F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
