"""Token counts of whole texts; huge ones by overlapping chunks that are spliced where they agree.

The library scans a text from left to right into pieces and encodes each piece by itself, so from a
piece end onward its result depends on the text after it alone. Two chunks that overlap and share a
piece end therefore agree on everything after it, up to the margin at the first chunk's end where a
piece may still grow. Counting the first chunk's tokens before that place and the second's after it
is exact. Where no place is shared the overlap is doubled, at last to the whole rest of the text.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_spark.llm.arrow import add_columns

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CHUNK_CHARS = 32768
OVERLAP_CHARS = 256
LIMIT = 1024
# Known pieces per Python worker: at most this many, each of at most KNOWN_CHARS characters.
KNOWN_PIECES = 400_000
KNOWN_CHARS = 48
# Characters past a piece end that can still change it: two of a contraction, one of white space.
LOOK_AHEAD = 2


class Classed:
    """Tells texts all of whose characters have a class in Python's Unicode tables. Libraries of other
    Unicode versions may see letters in the rest. Characters are looked up when first met."""

    def __init__(self):
        self.met = set()

    def __call__(self, text: str) -> bool:
        for letter in set(text).difference(self.met):
            if unicodedata.category(letter) in ("Cn", "Cs"):
                return False
            self.met.add(letter)
        return True


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes inside the library's model: printable bytes for themselves,
    the others, in order, for the characters from 256 on."""
    itself = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {byte: chr(byte) if byte in itself else chr(next(others)) for byte in range(256)}


class _Known(dict):
    """Token counts of pieces, asked of the library's model when first met. The oldest half goes when full."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.merge = library.model.tokenize
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> int:
        count = len(self.merge(piece.encode().decode("latin-1").translate(self.letters)))
        if len(piece) <= KNOWN_CHARS:
            if len(self) >= KNOWN_PIECES:
                for old in list(self)[: KNOWN_PIECES // 2]:
                    del self[old]
            self[piece] = count
        return count


class Counter:
    """Counts the tokens the library gives for a text, without encoding it in one go."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.known = _Known(self.library)
        self.classed = Classed()
        self.chunk_chars = max(1, chunk_chars)
        self.overlap_chars = max(1, overlap_chars)
        # A token string that the chunk's end cuts is seen as ordinary text; so are piece ends in it.
        self.margin = LOOK_AHEAD + max([0, *map(len, self.added)])

    def __call__(self, text: str) -> int:
        if not self.classed(text):
            return len(self.library.encode(text, add_special_tokens=False))
        if len(text) <= self.chunk_chars:
            return self.short(text)
        return self.spliced(text)

    def short(self, text: str) -> int:
        segments = self.split_added.split(text)
        return len(segments) - 1 + sum(sum(map(self.known.__getitem__, self.pieces.findall(part))) for part in segments)

    def encode(self, text: str, offset: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ends (offsets in the whole text) and the tokens up to each of them."""
        ends, counts, start = [], [], 0
        for stop in [*self.split_added.finditer(text), None]:
            segment_end = stop.start() if stop else len(text)
            for piece in self.pieces.finditer(text, start, segment_end):
                ends.append(piece.end())
                counts.append(self.known[piece.group()])
            if stop:
                ends.append(stop.end())
                counts.append(1)
                start = stop.end()
        return np.array(ends, dtype=np.int64) + offset, np.cumsum(counts, dtype=np.int64)

    def spliced(self, text: str) -> int:
        """The exact count from overlapping chunks.

        ``ends`` are piece ends of the scan of the whole text, from ``done`` on; ``before`` tokens
        come before ``done``. A chunk is dropped when the next one has been spliced to it.
        """
        start, overlap, before = 0, self.overlap_chars, 0
        ends, counts = self.encode(text[: self.chunk_chars], 0)
        stop = min(self.chunk_chars, len(text))
        while stop < len(text):
            next_start = max(start, stop - overlap)
            next_stop = min(len(text), stop + self.chunk_chars)
            next_ends, next_counts = self.encode(text[next_start:next_stop], next_start)
            # Ends that more text cannot move, in both; the chunk's own start is a piece end only to itself.
            proven = ends[(ends > next_start) & (ends <= stop - self.margin)]
            shared = np.intersect1d(proven, next_ends, assume_unique=True)
            if len(shared):
                place = shared[-1]
                before += int(counts[np.searchsorted(ends, place)])
                first = int(np.searchsorted(next_ends, place)) + 1
                counts = next_counts[first:] - next_counts[first - 1]
                ends = next_ends[first:]
                start, stop, overlap = int(place), next_stop, self.overlap_chars
            elif next_start > start:
                overlap *= 2
            else:
                # The overlap is all that is not yet proven: the next chunk starts on a proven end.
                ends, counts, stop, overlap = next_ends, next_counts, next_stop, self.overlap_chars
        return before + (int(counts[-1]) if len(counts) else 0)


@lru_cache(maxsize=2)
def counter_of(path: str, chunk_chars: int, overlap_chars: int) -> Counter:
    """One counter per Python worker, so that tasks after the first one know its pieces."""
    return Counter(path, chunk_chars, overlap_chars)


def count_tokens(
    df: DataFrame, text: str = "text", n_tokens: str = "n_tokens", path: str = VOCABULARY,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """The frame with the number of tokens of each whole text, as the library counts them.

    No begin, end or added special tokens; a special string inside a text is one token, the
    library's default. A null or empty text has none. Each row is counted on its own, so repeated
    rows and ties need no rule, and an empty table gives an empty table. A column already named as
    the new one is replaced, others pass through. A text of any length is counted whole.

    Texts are split into pieces by the published pattern and each distinct piece is encoded by the
    library's model once. A text with a character that has no class in Python's Unicode tables goes to the
    library whole, because the splitters' tables may differ there.
    """

    def make():
        counter = counter_of(path, chunk_chars, overlap_chars)
        return lambda texts: {n_tokens: [counter(value or "") for value in texts]}

    return add_columns(df, text, f"`{n_tokens}` long", make)


def over_limit(n_tokens: str = "n_tokens", limit: int = LIMIT):
    """Whether a text has more tokens than a model takes."""
    return F.col(n_tokens) > limit
