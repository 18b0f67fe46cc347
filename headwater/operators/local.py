"""Graph algorithms for edge tables of a checked size, run by one task; callers have another way for larger ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that one task may hold, some 100 MB in its worker.
LOCAL_EDGES = 500_000


def in_one_task(edges: DataFrame, solve: Callable[[list[tuple[str, str]]], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``solve`` makes of all edges (src, dst); their number must be LOCAL_EDGES at most."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = [p for b in batches for p in zip(b["src"], b["dst"])]
        yield pd.DataFrame(solve(pairs), columns=names)

    return edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).coalesce(1).mapInPandas(run, schema)


def circles(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Strongly connected components that hold a circle, also that of a node with itself: (node, least node of its component).

    Two passes of a depth-first search without recursion: nodes by the order in which the first leaves them, the last first, each
    with all that lead to it in the second.
    """
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    left: list[str] = []
    seen: set[str] = set()
    for start in ahead:
        if start in seen:
            continue
        seen.add(start)
        way = [(start, iter(ahead[start]))]
        while way:
            node, rest = way[-1]
            nxt = next((b for b in rest if b not in seen), None)
            if nxt is None:
                way.pop()
                left.append(node)
            else:
                seen.add(nxt)
                way.append((nxt, iter(ahead.get(nxt, ()))))
    out, taken, selves = [], set(), {a for a, b in pairs if a == b}
    for start in reversed(left):
        if start in taken:
            continue
        taken.add(start)
        group, todo = [start], [start]
        while todo:
            for a in back.get(todo.pop(), ()):
                if a not in taken and a in seen:
                    taken.add(a)
                    group.append(a)
                    todo.append(a)
        if len(group) > 1 or start in selves:
            first = min(group)
            out += [(n, first) for n in group]
    return out


def levels(pairs: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """Level of each node that lies neither on a circle nor behind one: 0 without sources, else one above the highest source."""
    ahead: dict[str, list[str]] = {}
    waits: dict[str, int] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    now, level, out = [n for n, k in waits.items() if not k], 0, []
    while now:
        out += [(n, level) for n in now]
        nxt = []
        for n in now:
            for b in ahead.get(n, ()):
                waits[b] -= 1
                if not waits[b]:
                    nxt.append(b)
        now, level = nxt, level + 1
    return out


def chains(pairs: list[tuple[str, str]]) -> list[tuple[str, str, int]]:
    """For each component that holds a circle, a shortest circle through its least node: (least node, "a > b > a", number of links)."""
    member = dict(circles(pairs))
    ahead: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        if member.get(a) is not None and member.get(a) == member.get(b):
            ahead.setdefault(a, []).append(b)
    out = []
    for first in sorted(set(member.values())):
        back, now = {first: ""}, [first]
        last = None
        while now and last is None:
            nxt = []
            for n in now:
                for b in ahead[n]:
                    if b == first:
                        last = n if last is None else last
                    elif b not in back:
                        back[b] = n
                        nxt.append(b)
            now = nxt
        way = [first]
        while last:
            way.append(last)
            last = back[last]
        out.append((first, " > ".join(reversed(way)), len(way) - 1))
    return out
