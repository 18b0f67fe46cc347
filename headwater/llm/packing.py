"""Filling containers of fixed capacity, by best-fit decreasing.

Best-fit decreasing puts items, the largest first, each into the fullest container that still has room. Items of one size are
interchangeable, and so are containers with the same room. So the packing of any number of items follows from the number of
items per size, a table of at most as many rows as the capacity: a plan says which container the n-th item of a size goes to.
The plan is made on the driver, in time that depends on the capacity alone; items get their number within their size and look
up their container in parallel. The result is that of placing all items one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.scratch import Scratch

#: Items of one size that one task numbers; sizes with more items are numbered in several groups.
GROUP_ITEMS = 250_000


class RoomTree:
    """A segment tree over the rooms 0 to capacity, counting open containers: the least room of at least s in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts: dict[int, int] = defaultdict(int)  # only of nodes with open containers

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += n
            i //= 2

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        has = self.counts.get
        if has(i):
            return size
        while i > 1:
            if i % 2 == 0 and has(i + 1):
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.leaves:
            i = 2 * i if has(2 * i) else 2 * i + 1
        return i - self.leaves


@dataclass
class Plan:
    """Items of a size, from a rank on, go to consecutive containers, so many into each."""

    size: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    n_containers: int = 0

    def add(self, size: int, rank: int, container: int, per: int) -> None:
        self.size.append(size)
        self.rank.append(rank)
        self.container.append(container)
        self.per.append(per)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for so many items of each size (1 to capacity). Runs of equal items into containers of equal room are one step."""
    tree, plan = RoomTree(capacity), Plan()
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs of containers (first, number)

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, n, fresh = capacity, plan.n_containers, left, True
            else:
                first, n = rooms[room].pop()
                tree.add(room, -n)
                fresh = False
            each = room // size
            full, rest = min(n, left // each), left % each
            if full:
                plan.add(size, rank, first, each)
                put(room - each * size, first, full)
                left, rank = left - full * each, rank + full * each
            used = full
            if left and full < n:  # fewer than fill another container
                plan.add(size, rank, first + full, rest)
                put(room - rest * size, first + full, 1)
                left, rank, used = 0, rank + rest, full + 1
            if fresh:
                plan.n_containers += used
            else:
                put(room, first + used, n - used)
    return plan


def split_items(sizes: DataFrame, capacity: int) -> DataFrame:
    """Items no larger than the capacity: id, part, start, size. Only items above it are split; all parts but the last are full."""
    parts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))
    cut = sizes.select("id", F.col("size").alias("whole"), F.explode(parts).alias("part"))
    return cut.select("id", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("whole") - F.col("part") * capacity).cast("int").alias("size"))


def containers_of(steps: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Containers of items by size and rank. steps: rows size, rank, container, per, sorted by size and rank. Items of size 0 go to
    container 0."""
    s, r, c, per = steps
    out = np.zeros(len(size), "int64")
    values, which = np.unique(size, return_inverse=True)
    begin, end = np.searchsorted(s, values, "left"), np.searchsorted(s, values, "right")
    rows = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[rows], np.arange(len(values) + 1))
    for k, value in enumerate(values):
        if value > 0:
            at = rows[bounds[k] : bounds[k + 1]]
            step = begin[k] + np.searchsorted(r[begin[k] : end[k]], rank[at], "right") - 1
            out[at] = c[step] + (rank[at] - r[step]) // per[step]
    return out


def pack(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Containers of all items: key, part, start, size, container.

    sizes: one row per item; a null size counts as 0, rows with a null key are left out. Items of size 0 take no room and go to
    container 0. Containers are numbered from 0 without gaps. An empty table gives an empty result.
    """
    if not 1 <= capacity < 2**31:
        raise ValueError("the capacity must be positive and below 2^31")
    scratch = Scratch(sizes.sparkSession, "packing")
    once = sizes.select(F.col(key).alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size")).filter("id is not null")
    items = scratch.save(split_items(once, capacity))
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    plan = best_fit_decreasing(counts, capacity)
    groups = max(1, -(-max(counts.values(), default=1) // GROUP_ITEMS))
    grouped = items.withColumn("grp", F.pmod(F.xxhash64("id", "part"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("size").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.groupBy("size", "grp").agg(F.count(F.lit(1)).alias("n")).select("size", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_group = F.row_number().over(Window.partitionBy("size", "grp").orderBy("id", "part")) - 1
    ranked = grouped.withColumn("rank", in_group).join(offsets, ["size", "grp"]).withColumn("rank", (F.col("rank") + F.col("offset")).cast("bigint"))

    # Steps are sorted by size and, within a size, by rank: first the size's steps are looked up, then the rank among them.
    order = np.lexsort((np.array(plan.rank, dtype="int64"), np.array(plan.size, dtype="int64")))
    steps = np.array([plan.size, plan.rank, plan.container, plan.per], dtype="int64").reshape(4, -1)[:, order]
    shared = sizes.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for size_, rank_ in batches:
            yield pd.Series(containers_of(shared.value, size_.to_numpy("int64"), rank_.to_numpy("int64")))

    return ranked.select(F.col("id").alias(key), "part", "start", "size", container("size", "rank").alias("container"))


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, their lower bound (total size over capacity), total size, share of the room that is unused."""
    total = F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")
    n = F.coalesce(F.max("container") + 1, F.lit(0))
    return packed.agg(total.alias("total_size"), n.alias("n_containers")).select(
        "n_containers", F.ceil(F.col("total_size") / capacity).alias("lower_bound"), "total_size", (1 - F.col("total_size") / F.nullif(F.col("n_containers") * capacity, F.lit(0))).alias("unused_share")
    )
