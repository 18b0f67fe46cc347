"""Numbers of tokens of a public byte-level tokenizer.

Texts are cut into words, each with the white space before it, where no token can go across; each distinct word is cut into
pre-tokens and encoded once per worker. Texts repeat their words, so this does the same as encoding whole texts in less time.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file for texts of several languages, and where it lies; both are parameters.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same in the syntax of the standard library, which is faster and equal but for the characters of _exceptions.
FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: White space and the word behind it. No pre-token holds white space behind something else, so each starts where one can.
WORD = r"\s*\S+|\s+"
#: Words remembered per worker, and the longest that is.
REMEMBERED, LONGEST = 400_000, 32


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file: the name itself if it is a path, else a file of the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _exceptions() -> str:
    """A class of the characters for which the standard library's word, digit or space classes differ from Unicode's."""
    odd = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl") or 0x1C <= c <= 0x1F]
    ranges: list[list[int]] = []
    for c in odd:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


class TokenCounter(dict):
    """Numbers of tokens of texts; as a dict, of words with the white space before them."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = re.compile(WORD).findall
        self.cut = re.compile(FAST).findall
        self.odd = re.compile(_exceptions()).search
        self.pieces: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= LONGEST:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def __missing__(self, word: str) -> int:
        n = sum(map(self._piece, self.cut(word)))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.odd(text):
            return len(self.encoding.encode_ordinary(text))
        return sum(map(self.__getitem__, self.words(text)))


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null and empty ones."""
    path = vocabulary_path(vocabulary)

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(path)
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    return count(text)
