"""Clipped n-gram counts of two texts in the same row.

A row's counts depend on that row alone, so nothing is exploded and nothing is shuffled: the
narrow step below turns each pair of texts into a few integers, and the corpus scores are plain
sums of them, combined on the map side. Exploding the n-grams and grouping them by row id gives
the same numbers but moves several hundred bytes per character through a hash aggregate.
Spark has no expression for a multiset intersection, hence the Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

FIELDS = ("hyp", "ref", "match")
# Working arrays of a chunk fit the processor cache; larger chunks are slower.
_CHUNK_BYTES = 1 << 17
_KEY_BITS = 63


def _clipped(ids: np.ndarray, hyp_len: np.ndarray, ref_len: np.ndarray, orders: int) -> np.ndarray:
    """Counts of shape (rows, orders, 3) for token ids, from 1 up, of all left texts followed by all right texts.

    Every position becomes one integer: its row, the next tokens as digits (0 past the end of the
    text), and its side in the last bit. In sorted order equal n-grams are runs for every n at
    once, so one sort serves as many orders as digits fit. When an alphabet is too large for that,
    the runs are numbered and the next sort goes on from those numbers.
    """
    rows = len(hyp_len)
    lengths = np.concatenate([hyp_len, ref_len])
    # Texts one after the other with zeros between them, so that the tokens after a position are slices.
    gaps = lengths + (orders - 1)
    tokens = np.zeros(int(gaps.sum()) + orders, dtype=np.int64)
    at = np.arange(len(ids)) + np.repeat(np.arange(2 * rows) * (orders - 1), lengths)
    tokens[at] = ids
    owner = np.repeat(np.tile(np.arange(rows), 2), lengths)
    from_ref = np.arange(len(ids)) >= hyp_len.sum()
    digit_bits = int(ids.max(initial=1)).bit_length()
    counts = np.zeros((rows, orders, len(FIELDS)), dtype=np.int64)
    for order in range(orders):
        counts[:, order, 0] = np.maximum(hyp_len - order, 0)
        counts[:, order, 1] = np.maximum(ref_len - order, 0)
    prefix, row_of_prefix, done = owner, np.arange(rows), 0
    while done < orders and len(at):
        room = (_KEY_BITS - 1 - len(row_of_prefix).bit_length()) // digit_bits
        take = min(max(room, 1), orders - done)
        size = len(tokens) - orders
        digits = tokens[done : done + size].copy()
        for step in range(done + 1, done + take):
            digits <<= digit_bits
            digits |= tokens[step : step + size]
        key = (prefix << (digit_bits * take)) | digits[at]
        key = (key << 1) | from_ref
        last = done + take == orders
        place = None if last else np.argsort(key, kind="stable")
        key = np.sort(key) if last else key[place]
        ref_before = np.concatenate([[0], np.cumsum(key & 1)])
        change = key[1:] ^ key[:-1]
        for step in range(1, take + 1):
            shift = 1 + digit_bits * (take - step)
            # Neighbours differ in a digit up to this one.
            bounds = np.concatenate([[0], np.flatnonzero(change >= 1 << shift) + 1, [len(key)]])
            gram = key[bounds[:-1]] >> shift
            ref = np.diff(ref_before[bounds])
            shared = np.minimum(np.diff(bounds) - ref, ref)
            shared[(gram & ((1 << digit_bits) - 1)) == 0] = 0
            row = row_of_prefix[gram >> (digit_bits * step)]
            counts[:, done + step - 1, 2] = np.bincount(row, weights=shared, minlength=rows)
        if not last:
            # Longer n-grams are shared only where these are.
            alive = np.repeat(shared > 0, np.diff(bounds))
            kept = place[alive]
            at, from_ref = at[kept], from_ref[kept]
            prefix = np.repeat(np.cumsum(shared > 0) - 1, np.diff(bounds))[alive]
            row_of_prefix = row[shared > 0]
        done += take
    return counts


def _char_ids(hyp: pa.Array, ref: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of both sides, renumbered from 1 without gaps, and the text lengths."""
    joined = "".join(hyp.to_pylist()) + "".join(ref.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    used = np.zeros(int(points.max(initial=0)) + 1, dtype=np.int64)
    used[points] = 1
    return np.cumsum(used)[points], *(pc.utf8_length(side).to_numpy().astype(np.int64) for side in (hyp, ref))


def _word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and how many each text has."""
    lists = pc.split_pattern(texts, " ")
    tokens = lists.flatten()
    is_word = pc.not_equal(tokens, "")
    before = np.concatenate([[0], np.cumsum(is_word.to_numpy(zero_copy_only=False))])
    return tokens.filter(is_word), np.diff(before[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def _word_ids(hyp: pa.Array, ref: pa.Array, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of both sides, numbered from 1: within their row, where one sort would not do for larger numbers."""
    (hyp_words, hyp_len), (ref_words, ref_len) = _word_lists(hyp), _word_lists(ref)
    words = pa.concat_arrays([hyp_words, ref_words]).dictionary_encode()
    rows, width = len(hyp), len(words.dictionary) + 1
    if width.bit_length() * orders + rows.bit_length() < _KEY_BITS:
        return words.indices.to_numpy().astype(np.int64) + 1, hyp_len, ref_len
    owner = np.repeat(np.tile(np.arange(rows), 2), np.concatenate([hyp_len, ref_len]))
    distinct, ids = np.unique(owner * width + words.indices.to_numpy(), return_inverse=True)
    first = np.searchsorted(distinct, np.arange(rows) * width)
    return ids - first[owner] + 1, hyp_len, ref_len


def _char_counts(hyp: pa.Array, ref: pa.Array, orders: int) -> np.ndarray:
    return _clipped(*_char_ids(hyp, ref), orders)


def _word_counts(hyp: pa.Array, ref: pa.Array, orders: int) -> np.ndarray:
    return _clipped(*_word_ids(hyp, ref, orders), orders)


def _chunks(hyp: pa.Array, ref: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Row slices of bounded size, whatever Arrow hands over; a longer text is a slice of its own."""
    size = np.cumsum(
        pc.binary_length(hyp).to_numpy(zero_copy_only=False).astype(np.int64)
        + pc.binary_length(ref).to_numpy(zero_copy_only=False)
    )
    start = 0
    while start < len(hyp):
        done = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + _CHUNK_BYTES, side="right")))
        yield hyp[start:stop], ref[start:stop]
        start = stop


def substitute(texts: pa.Array, rules: Iterable[tuple[str, str]]) -> pa.Array:
    """Patterns replaced one after the other, ``$1`` being the first group, by the linear-time engine of Arrow."""
    for pattern, put in rules:
        texts = pc.replace_substring_regex(texts, pattern, put.replace("$", "\\"))
    return texts


def _count_function(counter, orders: int, prepare: Callable[[pa.Array], pa.Array]):
    def count(hyp: pa.Array, ref: pa.Array) -> pa.Array:
        parts = [counter(prepare(left), prepare(right), orders).ravel() for left, right in _chunks(hyp, ref)]
        values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        offsets = np.arange(len(hyp) + 1, dtype=np.int32) * (orders * len(FIELDS))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    count.__annotations__ = {"hyp": pa.Array, "ref": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, ArrayType(LongType()))


def as_it_is(texts: pa.Array) -> pa.Array:
    return texts


def char_ngram_counts(hyp: Column, ref: Column, orders: int, prepare: Callable[[pa.Array], pa.Array] = as_it_is) -> Column:
    """Flat array ``[hyp, ref, match]`` per order 1..``orders`` over code points of the prepared texts; inputs not null."""
    return _count_function(_char_counts, orders, prepare)(hyp, ref)


def word_ngram_counts(hyp: Column, ref: Column, orders: int, prepare: Callable[[pa.Array], pa.Array] = as_it_is) -> Column:
    """The same over tokens that spaces part; inputs not null."""
    return _count_function(_word_counts, orders, prepare)(hyp, ref)
