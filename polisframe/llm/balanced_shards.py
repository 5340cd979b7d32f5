"""Sharding by balanced label propagation: linked rows move towards the shards of their neighbours, within byte quotas.

Links are memberships (row, link): rows that name one link are neighbours. So a group of copies is one link, an edge is a link of two,
and no pairs are ever made. Rows start in shards by a hash. In a round every link tallies its members by shard, every row adds
up the tallies of its links and wants the open shard that holds most of its neighbours; links take turns to send rows to lower and to
higher shards, so that neighbours don't swap places. Two shards exchange as many bytes as either offers; beyond that a shard may take its quota less
the linked bytes it holds, as unlinked rows can always give way. If more want to come, the greatest gains come first, link by link, up to a
threshold, and a shard that has no room and nothing to exchange is closed. Rounds end when no row wants to move.

Then the shards are levelled: those above their share hand rows to those below, unlinked rows first, then rows with few neighbours
beside them, in the order of a hash. Thresholds are found digit by digit in histograms of at most 4,096 sums a shard and digit, without sorting
and without collecting rows. Later passes hand on ever smaller rows until sizes differ from the share by no more than ``TOLERANCE`` of it.

What the driver sees depends on the number of shards only: sums for each pair of them, and 4,096 for each pair that wants more than it may.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisframe.llm._shared import stored, text_column

SHARDS, ROUNDS, PASSES = 8, 24, 12
#: Levelling ends when every shard is this close to its share; linked rows only move if shards are further off than ``ROUGH``.
TOLERANCE, ROUGH = 0.0005, 0.01
_BITS = 12


def thresholds(rows: DataFrame, limits: dict[int, list[int]], slack: int) -> dict[int, list[int]]:
    """For each bucket of ``rows`` (bucket, key below 2^60, size) and each limit the key below which the sizes sum up to at most the limit.

    The sum falls short of the limit by the next key's size, or by ``slack`` if that is more.
    """
    found = {b: [0] * len(of) for b, of in limits.items()}
    active = [(b, i, 0, 0) for b, of in limits.items() for i in range(len(of))]  # bucket, which, digits so far, sum below
    for shift in range(60 - _BITS, -1, -_BITS):
        wanted = sorted({(b, digits) for b, _, digits, _ in active})
        if not wanted:
            break
        inside = F.lit(False)
        for b, digits in wanted:
            inside |= (F.col("bucket") == b) & (F.shiftright("key", shift + _BITS) == digits)
        sums: dict[tuple[int, int], list[tuple[int, int]]] = {w: [] for w in wanted}
        histogram = rows.where(inside).groupBy("bucket", F.shiftright("key", shift).alias("digits")).agg(F.sum("size").alias("size"))
        for b, digits, size in sorted(histogram.collect()):  # 4096 sums a wanted bucket at most
            sums[b, digits >> _BITS].append((digits, size))
        going = []
        for b, i, digits, below in active:
            found[b][i] = (digits + 1) << (shift + _BITS)  # all of it, unless a part is too much
            for own, size in sums[b, digits]:
                if below + size > limits[b][i]:
                    found[b][i] = own << shift
                    if size > slack and shift:
                        going.append((b, i, own, below))
                    break
                below += size
        active = going
    return found


def _hash(*columns: Column | str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits)


def _wishes(members: DataFrame, shards: int, open_to: list[int], turn: int) -> DataFrame:
    """(row, size, shard, to, gain, anchor) of the rows that have more neighbours in an open shard of this turn's side."""
    tallies = members.groupBy("link").agg(*[F.sum(F.when(F.col("shard") == s, F.col("weight")).otherwise(0)).alias(f"t{s}") for s in range(shards)])
    summed = members.join(tallies, "link").groupBy("row", "size", "shard").agg(
        F.sum("weight").alias("own"), F.min(_hash("link", bits=28)).alias("anchor"), *[F.sum(f"t{s}").alias(f"t{s}") for s in range(shards)])
    here = F.coalesce(*[F.when(F.col("shard") == s, F.col(f"t{s}")) for s in range(shards)]) - F.col("own")
    down = (F.col("anchor") + turn) % 2 == 0
    may = lambda s: F.when(down, F.lit(s) < F.col("shard")).otherwise(F.lit(s) > F.col("shard"))
    best = F.greatest(F.lit(-1), *[F.when(may(s), F.col(f"t{s}")).otherwise(-1) for s in open_to])
    to = F.coalesce(*[F.when(may(s) & (F.col(f"t{s}") == F.col("best")), F.lit(s)) for s in open_to])
    summed = summed.withColumns({"best": best, "here": here}).where(F.col("best") > F.col("here"))
    return summed.select("row", "size", "shard", to.alias("to"), (F.col("best") - F.col("here")).alias("gain"), "anchor")


def _by_shard(rows: DataFrame, column: str, shards: int) -> list[int]:
    out = [0] * shards
    for s, size in rows.groupBy(column).agg(F.sum("size")).collect():  # one sum a shard
        out[s] = size
    return out


def propagated(rows: DataFrame, links: DataFrame, quota: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """(row, link, weight, size, shard) of all rows with neighbours, after the rounds; ``links`` has (row, link, weight)."""
    shared = links.groupBy("link").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(links.join(shared, "link", "left_semi").join(rows.select("row", "size"), "row").select(
        "row", "link", "weight", "size", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")))
    closed: set[int] = set()
    idle = 0
    for turn in range(rounds):
        open_to = [s for s in range(shards) if s not in closed]
        if idle == 2 or not open_to or members.isEmpty():
            break
        wishes = stored(_wishes(members, shards, open_to, turn))
        asked = {(r["shard"], r["to"]): r["size"] for r in wishes.groupBy("shard", "to").agg(F.sum("size").alias("size")).collect()}  # one sum a pair of shards
        room = [max(0, quota - held) for held in _by_shard(members.dropDuplicates(["row"]), "shard", shards)]
        idle = 0 if asked else idle + 1
        if not asked:
            continue
        # pairs of shards exchange as much as either side offers; what one side wants beyond that needs room
        limits = {(a, b): min(size, asked.get((b, a), 0)) for (a, b), size in asked.items()}
        swapped = {b: sum(x for (_, to), x in limits.items() if to == b) for _, b in asked}
        for (a, b), size in sorted(asked.items(), key=lambda x: -x[1]):
            more = min(size - limits[a, b], room[b])
            limits[a, b] += more
            room[b] -= more
        tight = [pair for pair, size in asked.items() if size > limits[pair]]
        key = F.shiftleft(15 - F.least(F.lit(15), F.log2("gain").cast("bigint")), 56) + F.shiftleft(F.col("anchor"), 28) + _hash("row", bits=28)
        ranked = wishes.withColumns({"bucket": F.col("shard") * shards + F.col("to"), "key": key})
        ends = thresholds(ranked, {a * shards + b: [limits[a, b]] for a, b in tight}, 0)
        admitted = F.lit(True)
        for a, b in tight:
            admitted &= (F.col("bucket") != a * shards + b) | (F.col("key") < ends[a * shards + b][0])
        closed |= {b for _, b in tight if not swapped[b]}
        moves = ranked.where(admitted).select("row", "to")
        members = stored(members.join(moves, "row", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
    return members


def shares(total: int, shards: int, largest: list[int]) -> list[int]:
    """What each shard should hold: the same, but for shards with one row that is larger; those keep it alone, the others share the rest."""
    alone: dict[int, int] = {}
    while True:
        rest = [s for s in range(shards) if s not in alone]
        left = total - sum(alone.values())
        over = {s: largest[s] for s in rest if largest[s] * len(rest) > left} if len(rest) > 1 else {}
        if not over or len(over) == len(rest):
            even = {s: left * (i + 1) // len(rest) - left * i // len(rest) for i, s in enumerate(rest)}
            return [(alone | even)[s] for s in range(shards)]
        alone |= over


def levelled(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, passes: int = PASSES) -> DataFrame:
    """``rows`` (row, size, shard, loss, …) with shards of nearly equal size; rows of the smallest ``loss`` (0 to 15) move first, others than those of
    loss 0 only if that leaves shards further than ``ROUGH`` from their share."""
    most, movable = None, F.col("loss") == 0
    for _ in range(passes):
        held, largest = [0] * shards, [0] * shards
        for s, size, most_of in rows.groupBy("shard").agg(F.sum("size"), F.max("size")).collect():  # a row a shard
            held[s], largest[s] = size, most_of
        total = sum(held)
        share = shares(total, shards, largest)
        off = [h - want for h, want in zip(held, share, strict=True)]
        worst = max(map(abs, off))
        if worst <= tolerance * total / shards:
            break
        if most is not None and worst >= most:
            if movable is None or worst <= ROUGH * total / shards:
                break
            movable = None
        most = worst
        # what each shard above its share hands to which one below
        gives = [(s, x) for s, x in enumerate(off) if x > 0]
        takes = [(s, -x) for s, x in enumerate(off) if x < 0]
        limits: dict[int, list[int]] = {}
        heirs: dict[int, list[int]] = {}
        while gives and takes:
            (a, x), (b, y) = gives[0], takes[0]
            part = min(x, y)
            limits[a] = [*limits.get(a, []), part + (limits[a][-1] if a in limits else 0)]
            heirs[a] = [*heirs.get(a, []), b]
            gives[:1] = [(a, x - part)] if x > part else []
            takes[:1] = [(b, y - part)] if y > part else []
        ranked = rows.withColumns({"bucket": F.col("shard"), "key": F.shiftleft(F.col("loss").cast("bigint"), 56) + _hash("row", bits=56)})
        fits = F.lit(False)
        for a in limits:
            fits |= (F.col("shard") == a) & (F.col("size") <= limits[a][-1])
        if movable is not None:
            fits &= movable
        ends = thresholds(ranked.where(fits), limits, int(tolerance * total / shards / 2))
        to = F.col("shard")
        for a, of in ends.items():
            for end, heir in reversed(list(zip(of, heirs[a], strict=True))):
                to = F.when(fits & (F.col("bucket") == a) & (F.col("key") < end), heir).otherwise(to)
        rows = stored(ranked.withColumn("shard", to.cast("int")).drop("bucket", "key"))
    return rows


def _placed(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        local = np.zeros(len(shard), np.int64)
        for s in np.unique(shard):
            own = shard == s
            local[own] = seen[s] + np.arange(int(own.sum()))
            seen[s] += int(own.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)], [*batch.schema.names, "_part", "_local"])


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard: a task's own count plus those of the tasks before."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _part int, _local bigint"
    counted = stored(rows.mapInArrow(lambda batches: _placed(batches, shards), schema))
    sizes = counted.groupBy("shard", "_part").agg((F.max("_local") + 1).alias("n"))  # one row a shard and partition
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return counted.join(starts, ["shard", "_part"]).withColumn("slot", F.col("start") + F.col("_local")).drop("_part", "_local", "start")


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (row, size, …; each ``row`` once, not null) with ``shard`` (0 to ``shards`` - 1) and ``slot``.

    ``links`` has (row, link, weight): rows that share a link are kept together as far as shards of equal sizes allow; null links are none.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    members = propagated(rows, links.where("link is not null"), total // shards, shards, rounds)
    tallies = members.groupBy("link", "shard").agg(F.sum("weight").alias("beside"))
    settled = members.join(tallies, ["link", "shard"]).groupBy("row").agg(
        F.first("shard").alias("shard"), F.least(F.lit(15), 1 + F.log2(F.sum("beside").cast("double")).cast("int")).cast("int").alias("loss"))
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    all_rows = stored(rows.join(settled, "row", "left").withColumns({"shard": F.coalesce("shard", start), "loss": F.coalesce("loss", F.lit(0))}))
    return with_slots(levelled(all_rows, shards), shards).drop("loss")


def shard_texts(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text); rows of one text are linked.

    The law is ``bytes``: sizes - UTF-8 bytes and one more - sum up nearly the same in all shards, as close as the smallest rows allow. A group
    of copies larger than a shard's share fills shards one after the other. Null texts have size 1 and stay with the empty ones; null ids
    and repeated rows are rows of their own; other columns are ignored; no rows give none.
    """
    raw = F.encode(text_column(), "utf-8")
    rows = stored(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("link"), F.monotonically_increasing_id().alias("row")))
    placed = balanced_shards(rows.drop("link"), rows.select("row", "link", F.lit(1).cast("bigint").alias("weight")), shards, rounds)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
