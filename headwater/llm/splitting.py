"""Splitting of long texts at natural boundaries, with overlap.

Separators form a hierarchy: section, statement, line, sentence, word, and at last the character. Pieces are packed greedily up
to the limit; a cut takes the highest separator that leaves the piece at least half full, else any line, else what is left.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EOL = r"(?:\r\n|\n|\r)"
#: Natural separators from the highest to the lowest; a cut is at the end of a match.
NATURAL = (
    re.compile(rf"{EOL}(?:[ \t]*{EOL})+"),  # blank lines
    re.compile(rf";[ \t]*{EOL}|{EOL}(?=[ \t]*(?:create|insert|update|delete|merge|select|with|if|call|exec|execute|begin|declare)\b)", re.I),
    re.compile(EOL),
)
LINE_END = re.compile(EOL)
#: Separators for what has to be cut within a line.
FORCED = (re.compile(r"[.!?;][ \t]+"), re.compile(r"[^\S\r\n]+|[,;)]"))
PIECES = "array<struct<piece_no: int, start: int, overlap: int, is_forced: boolean, piece: string>>"


def _last(cuts: list[int], low: int, high: int) -> int | None:
    """The greatest cut in (low, high]."""
    i = bisect.bisect_right(cuts, high) - 1
    return cuts[i] if i >= 0 and cuts[i] > low else None


def _first(cuts: list[int], low: int, high: int) -> int | None:
    """The least cut in (low, high]."""
    i = bisect.bisect_right(cuts, low)
    return cuts[i] if i < len(cuts) and cuts[i] <= high else None


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces of a text as (start, own start, end of the piece is forced), each up to the next one's own start.

    A piece starts with the last ``overlap`` characters before its own start; fewer if else a line would have to be cut or a
    word or line begins a little later. It ends inside a line only where the line alone is longer than the limit.
    """
    n = len(text)
    natural = [[m.end() for m in sep.finditer(text)] for sep in NATURAL]
    lines = sorted({x for m in LINE_END.finditer(text) for x in (m.start(), m.end())})
    within: list[list[int]] | None = None
    pieces = []
    own, forced = 0, False
    while True:
        start = _overlap_start(text, own, overlap, lines) if own else 0
        room = start + limit
        if room >= n:
            pieces.append((start, own, forced))
            return pieces
        half = own + (room - own) // 2
        cut = next((c for c in (_last(level, half, room) for level in natural) if c), None) or _last(lines, own, room)
        is_forced = False
        if cut is None:
            # No line ends within the limit; one may if the overlap is given up in part.
            cut = _first(lines, room, own + limit) or (n if n <= own + limit else None)
            if cut is not None:
                start = cut - limit
        if cut is None:
            is_forced = True
            if within is None:
                within = [[m.end() for m in sep.finditer(text)] for sep in FORCED]
            cut = next((c for c in (_last(level, half, room) for level in within) if c), None) or room
            if text[cut - 1 : cut + 1] == "\r\n":
                cut -= 1
        pieces.append((start, own, is_forced))
        own, forced = cut, is_forced
        if own >= n:
            return pieces


def _overlap_start(text: str, own: int, overlap: int, lines: list[int]) -> int:
    """Where the overlap before ``own`` starts: at a line within its last half, else at a word there, else at full length."""
    low = max(0, own - overlap)
    if low == 0:
        return 0
    i = bisect.bisect_left(lines, low)
    if i < len(lines) and lines[i] <= low + overlap // 2 and lines[i] < own:
        return lines[i]
    space = text.find(" ", low, low + overlap // 4)
    return space + 1 if 0 <= space < own - 1 else low


def _pieces(text: str | None, limit: int, overlap: int) -> list[dict]:
    if text is None:
        return []
    if len(text) <= limit:
        return [{"piece_no": 0, "start": 0, "overlap": 0, "is_forced": False, "piece": text}]
    cuts = split_text(text, limit, overlap)
    ends = [own for _, own, _ in cuts[1:]] + [len(text)]
    return [{"piece_no": i, "start": s, "overlap": own - s, "is_forced": f, "piece": text[s:e]} for i, ((s, own, f), e) in enumerate(zip(cuts, ends))]


def pieces(text: Column, limit: int, overlap: int) -> Column:
    """Pieces of a text of at most ``limit`` characters, as an array of structs.

    piece_no from 0, start (character the piece starts at), overlap (its characters that the piece before has too), is_forced
    (its end lies within a line), piece. The pieces without their overlaps make up the text. A text within the limit, also an
    empty one, is one piece; null has none.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")

    @F.pandas_udf(PIECES)
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: _pieces(t, limit, overlap))

    return split(text)


def split_long(rows: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """Pieces of all texts longer than the limit: key and the fields of ``pieces``. Each key counts once (its greatest text)."""
    once = rows.select(F.col(key), F.col(text).alias("_text")).filter(F.col(key).isNotNull() & (F.char_length("_text") > limit)).groupBy(key).agg(F.max("_text").alias("_text"))
    return once.select(key, F.explode(pieces(F.col("_text"), limit, overlap)).alias("_p")).select(key, "_p.*")
