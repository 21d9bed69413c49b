"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary, decode up the tree.

``encode(a + b)`` is not ``encode(a) + encode(b)``, but it can be had from both. The pattern that
splits text before the merges has no alternative that holds a character of white space after any
other character, and a look-ahead only inside white space. So wherever a character that is not white
space stands before one that is, every scan has a piece end, whatever the text around it, and

    encode(text) == encode(text[:p]) + encode(text[p:])      for each such place p.

A join looks for the last such place in the left text and the first one in the right text, in
windows that double until they hold one (or the whole side); it re-encodes what is between, and the
two outer parts to learn how many ids they take at the seam. All other ids are proven to stay. The
windows are a few words as a rule, so a tree over a text of n characters costs n plus the windows.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from corpus_spark.llm.arrow import add_columns

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAF_CHARS = 8192
FIRST_WINDOW = 64
# A piece of any scan ends after the first character. Only white space of old standing is named, so
# that tables of different Unicode versions agree on it.
SEAM = re.compile(r"[^\s\x1c-\x1f\x85\u180e\u200b](?=[ \n])")


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The rank file as an encoding without special tokens; read once per Python worker."""
    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tree:
    """Encodes and decodes by tree reduction with one encoding."""

    def __init__(self, encoding: tiktoken.Encoding, leaf_chars: int = LEAF_CHARS, first_window: int = FIRST_WINDOW):
        self.encoding = encoding
        self.leaf_chars = max(2, leaf_chars)
        self.first_window = max(1, first_window)

    def leaf(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The ids of ``left + right`` from the ids of both."""
        start, stop = self.last_seam(left), self.first_seam(right)
        kept_left = len(left_ids) - len(self.leaf(left[start:])) if start else 0
        cut_right = len(self.leaf(right[:stop])) if stop < len(right) else len(right_ids)
        return np.concatenate([left_ids[:kept_left], self.leaf(left[start:] + right[:stop]), right_ids[cut_right:]])

    def last_seam(self, text: str) -> int:
        """The last place all scans share, or 0."""
        window = self.first_window
        while True:
            base = max(0, len(text) - window)
            found = None
            for found in SEAM.finditer(text, base):
                pass
            if found or not base:
                return found.end() if found else 0
            window *= 2

    def first_seam(self, text: str) -> int:
        """The first place all scans share, or the end."""
        window = self.first_window
        while True:
            # One character more, because a seam is seen only with the white space after it.
            found = SEAM.search(text, 0, window + 1)
            if found or window >= len(text):
                return found.end() if found else len(text)
            window *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a range of ids: decoding is a homomorphism, so halves are concatenated."""
        if len(ids) <= self.leaf_chars:
            return self.encoding.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encode_texts(
    df: DataFrame, text: str = "text", ids: str = "token_ids", n_tokens: str = "n_tokens",
    path: str = VOCABULARY, leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """The frame with the ids of each whole text (binary, little-endian unsigned 32-bit) and their number.

    A null text counts as empty: no ids. Rows are neither dropped nor matched with each other, so
    ties and repeated rows are encoded each on its own, and an empty table gives an empty table.
    Columns already named as the new ones are replaced, others pass through. A text of any length
    is encoded whole, leaf by leaf.
    """

    def make():
        tree = Tree(load_encoding(path), leaf_chars)

        def run(texts):
            found = [tree.encode(value or "") for value in texts]
            return {ids: [each.tobytes() for each in found], n_tokens: [len(each) for each in found]}

        return run

    return add_columns(df, text, f"`{ids}` binary, `{n_tokens}` long", make)


def decode_ids(
    df: DataFrame, ids: str = "token_ids", decoded: str = "decoded", path: str = VOCABULARY, leaf_ids: int = LEAF_CHARS,
) -> DataFrame:
    """The frame with the bytes that the ids stand for. Null ids count as none and give no bytes.

    Bytes, not text: the ids of a part of a text may end inside a character.
    """

    def make():
        tree = Tree(load_encoding(path), leaf_ids)
        return lambda values: {decoded: [tree.decode(np.frombuffer(value or b"", dtype="<u4")) for value in values]}

    return add_columns(df, ids, f"`{decoded}` binary", make)
