"""Queries that are the same but for white space, case, punctuation and the order of selected items.

Each distinct text is canonicalised once into its fields: the items of each select list, and the rest of the text in order. A
field's identifier is an integer of 128 bits drawn from its content, so no dictionary has to be shuffled and joined. Each text
becomes the sorted tuple of (role, identifier), and equal tuples are grouped. Of the texts each distinct one is shuffled once, to
its hash, and combined before; all else that is shuffled are hashes, keys and tuples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.scratch import Scratch

#: Words, numbers with their decimal point, operators; brackets and commas only shape the select lists. A sign is an operator of
#: its own, which keeps -1 apart from 1 and a - 1 equal to a -1. All other characters are punctuation or white space.
TOKEN = re.compile(r"[^\W\d][\w$#@]*|\d+(?:\.\d+)?(?:[^\W\d]\w*)?|\.\d+|<>|!=|<=|>=|=>|\|\||[<>=+\-*/%|&^~!?@#$]|[(),]")
#: Words that stand between SELECT and the first item.
QUANTIFIERS = {"distinct", "all"}
#: Words at the depth of a select list that end it, besides FROM.
LIST_ENDS = {"from", "into", "union", "intersect", "except", "minus"}


def query_fields(text: str) -> list[tuple[int, str]]:
    """Fields of a query: (0, its text without the select lists) and (n, item) for each item of the n-th select list.

    Lists of queries in brackets stay where they are, with their items sorted. The time is linear in the text but for sorting.
    """
    # A frame is a list under construction: [depth, number or 0 for a nested one, items, current item].
    rest: list[str] = []
    fields: list[tuple[int, str]] = []
    frames: list[list] = []
    depth, lists, previous = 0, 0, ""

    def out() -> list[str]:
        return frames[-1][3] if frames else rest

    def close() -> None:
        _, number, items, current = frames.pop()
        items.append(" ".join(current))
        if number:
            fields.extend((number, i) for i in items)
            out().append(f"\x00{number}")
        else:
            out().extend(sorted(items))

    for token in TOKEN.findall(text.lower()):
        if token == "(":
            depth += 1
            continue
        if token == ")":
            while frames and frames[-1][0] >= depth > 0:
                close()
            depth = max(0, depth - 1)
            continue
        if token == ",":
            if frames and frames[-1][0] == depth:
                frames[-1][2].append(" ".join(frames[-1][3]))
                frames[-1][3] = []
            continue
        if frames and frames[-1][0] == depth and token in LIST_ENDS:
            close()
        at_start = bool(frames) and frames[-1][0] == depth and not frames[-1][2] and not frames[-1][3]
        if at_start and previous in ("select", *QUANTIFIERS) and token in (*QUANTIFIERS, "top") or at_start and previous == "top":
            frame = frames.pop()  # belongs to the query, not to the first item
            out().append(token)
            frames.append(frame)
        else:
            out().append(token)
        if token == "select":
            nested = depth > 0
            lists += 0 if nested else 1
            frames.append([depth, 0 if nested else lists, [], []])
        previous = token
    while frames:
        close()
    fields.append((0, " ".join(rest)))
    return fields


def query_tuple(text: str) -> bytes:
    """The sorted tuple of (role, identifier) of a query's fields: 4 and 16 bytes each."""
    coded = sorted(role.to_bytes(4, "big") + hashlib.blake2b(field.encode("utf-8", "surrogatepass"), digest_size=16).digest() for role, field in query_fields(text))
    return b"".join(coded)


def tuple_of(text: Column) -> Column:
    """The tuple of a query text; null for null."""

    @F.pandas_udf("binary")
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else query_tuple(t))

    return code(text)


def same_queries(entries: DataFrame, key: str, text: str) -> DataFrame:
    """Entries grouped by what they ask.

    entries: each key counts once; rows with a null key or text are left out, and of a key with several texts the one with the
    least hash counts. An empty text is a query like any other. Result: key, first_key (the least key of the group), copies
    (entries in the group).
    """
    scratch = Scratch(entries.sparkSession, "same-queries")
    hashed = entries.select(F.col(key).alias("id"), F.col(text).alias("t")).dropna().select("id", F.unhex(F.md5("t")).alias("h"), "t")
    rows = scratch.save(hashed.groupBy("id").agg(F.min("h").alias("h")))
    counts = rows.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    texts = hashed.groupBy("h").agg(F.first("t").alias("t"))
    coded = scratch.save(texts.select("h", tuple_of(F.col("t")).alias("tuple")).join(counts, "h"))
    groups = coded.groupBy("tuple").agg(F.min("least").alias("first_key"), F.sum("n").alias("copies"))
    by_text = coded.join(groups, "tuple").select("h", "first_key", "copies")
    return rows.join(by_text, "h").select(F.col("id").alias(key), "first_key", "copies")
