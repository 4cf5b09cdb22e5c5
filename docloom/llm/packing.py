"""Documents packed into containers of fixed capacity, by large-item matching.

The plan is made on the histogram of sizes, which has at most ``capacity``
entries however many documents there are, so it fits the driver at any scale.
Items above a third of the capacity (at most two fit together) are matched
greedily, largest first with the largest partner that fits; smaller ones go,
largest first, into the fullest container with room. The plan says, for each
size, which ranks go to which containers; the documents get their ranks from a
distributed sort and look their container up.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tokens import VOCABULARY, size_column
from docloom.runtime import durable

BINS = "doc_id long, part int, first_id int, n_ids int, bin_id long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (sizes in one container) and the number of containers with each.

    Sizes must lie in 1..capacity. The result's length is bounded by the number
    of distinct sizes, not by the number of items.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 1 <= s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    groups: list[tuple[tuple[int, ...], int]] = []
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at < 0:
            groups.append(((a,), left.pop(a)))
            large.pop()
            continue
        b = large[at]
        if a == b:
            pairs, odd = divmod(left.pop(a), 2)
            large.pop()
            if pairs:
                groups.append(((a, a), pairs))
            if odd:
                nxt = bisect.bisect_right(large, capacity - a) - 1
                if nxt >= 0:
                    b = large[nxt]
                    groups.append(((a, b), 1))
                    left[b] -= 1
                    if not left[b]:
                        del left[b], large[nxt]
                else:
                    groups.append(((a,), 1))
            continue
        n = min(left[a], left[b])
        groups.append(((a, b), n))
        for s in (a, b):
            left[s] -= n
            if not left[s]:
                del left[s]
                large.remove(s)
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for pattern, n in groups:
        by_room[capacity - sum(pattern)].append((pattern, n))
    rooms = sorted(by_room)
    for s in sorted(left, reverse=True):
        n = left[s]
        at = bisect.bisect_left(rooms, s)
        while n:
            if at == len(rooms):
                fit = capacity // s
                whole, rest = divmod(n, fit)
                for k, m in ((fit, whole), (rest, 1)):
                    if k and m:
                        _put(by_room, rooms, capacity - k * s, ((s,) * k, m))
                break
            room = rooms[at]
            stack = by_room[room]
            pattern, m = stack.pop()
            fit = room // s
            used = min(m, n // fit)
            if used:
                _put(by_room, rooms, room - fit * s, (pattern + (s,) * fit, used))
                n -= fit * used
                m -= used
            if m and 0 < n < fit:
                _put(by_room, rooms, room - n * s, (pattern + (s,) * n, 1))
                n, m = 0, m - 1
            if m:
                stack.append((pattern, m))
            elif not stack:
                del by_room[room]
                rooms.remove(room)
            at = bisect.bisect_left(rooms, s) if n else at
    return [g for room in sorted(by_room) for g in by_room[room]]


def _put(by_room: dict, rooms: list[int], room: int, group: tuple) -> None:
    if room not in by_room or not by_room[room]:
        if room not in rooms:
            bisect.insort(rooms, room)
    by_room[room].append(group)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """By size: (first rank, items per container, first container), ranks ascending."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    base = 0
    for pattern, n in patterns:
        for s in dict.fromkeys(pattern):
            k = pattern.count(s)
            out[s].append((given[s], k, base))
            given[s] += k * n
        base += n
    return dict(out)


def parts(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Each document as one part, or as several of at most ``capacity`` if it is larger."""
    n = F.col(size)
    last = F.floor((n - 1) / capacity).cast("int")
    each = df.filter(n > 0).select(F.col(key), n.alias("__n"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part") * capacity
    return each.select(key, "part", start.alias("first_id"), F.least(F.lit(capacity), F.col("__n") - start).cast("int").alias("n_ids"))


def pack(df: DataFrame, key: str = "doc_id", size: str = "n_ids", capacity: int = 2048) -> DataFrame:
    """The container of every document: ``BINS`` (with the key's own name and type).

    Only documents above ``capacity`` are divided, into parts of ``capacity``
    and a rest; documents of size null or 0 are left out. Repeated keys are
    documents of their own. An empty table gives no rows. The result depends
    on the data alone (ties in size are ranked by key and part).

    The sorted parts are checkpointed once; the ranks come from the counts by
    size and partition, which together are at most as many as partitions and
    sizes.
    """
    sized = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{size}`").cast("long").alias("__size"))
    whole = durable(parts(sized, "__key", "__size", capacity).repartitionByRange("n_ids", "__key", "part").sortWithinPartitions("n_ids", "__key", "part"))
    counted = whole.groupBy(F.spark_partition_id().alias("p"), "n_ids").count().collect()
    total: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for p, s, n in sorted(tuple(r) for r in counted):
        before[p, s] = total[s]
        total[s] += n
    where = slots(plan(total, capacity))
    table = {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in where.items()}
    kind = dict(whole.dtypes)["__key"]
    schema = f"`{key}` {kind}, part int, first_id int, n_ids int, bin_id long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(3).to_numpy()
            p = int(batch.column(4)[0].as_py())
            bins = np.empty(len(sizes), np.int64)
            edges = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]).tolist() + [len(sizes)]
            for i, j in zip(edges, edges[1:]):
                s = int(sizes[i])
                rank = before[p, s] + seen.get(s, 0) + np.arange(j - i)
                seen[s] = seen.get(s, 0) + j - i
                first, per, base = table[s]
                at = np.searchsorted(first, rank, side="right") - 1
                bins[i:j] = base[at] + (rank - first[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bins)], names=[key, "part", "first_id", "n_ids", "bin_id"])

    return whole.withColumn("__p", F.spark_partition_id()).mapInArrow(assign, schema)


def pack_texts(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """``pack`` of documents as large as their texts have ids."""
    sized = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).select(F.col(f"`{key}`"), size_column("__text", path).alias("n_ids"))
    return pack(durable(sized), key, "n_ids", capacity)  # the sort samples its input first, and the encoding must not run twice


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, ids, the room left unused and the least number possible."""
    one = packed.groupBy("bin_id").agg(F.sum("n_ids").alias("used"))
    return one.agg(F.count("*").alias("bins"), F.sum("used").alias("ids"), F.sum(capacity - F.col("used")).alias("unused"), F.ceil(F.sum("used") / capacity).alias("least"), F.max("used").alias("fullest"))
