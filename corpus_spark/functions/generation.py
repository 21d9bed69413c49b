"""Clean-up of generated text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpus_spark.functions.ngrams import _chunks
from corpus_spark.functions.text import drop_spans, squeeze

# Fixed values.
EMPTY_PREDICTION = "..."
SHORTEST_PHRASE, LONGEST_PHRASE = 3, 10


def strip_template_tokens(text: Column) -> Column:
    """``<|...|>`` marks are removed, within a line. A line without a close ahead is not searched again."""
    return drop_spans(text, "<|", "|>", within_line=True)


def strip_thinking(text: Column) -> Column:
    """``<think>...</think>`` spans are removed, across lines."""
    return drop_spans(text, "<think>", "</think>")


def _collapsed(texts: pa.Array) -> pa.Array:
    """``collapse_repeats`` of texts whose words single spaces part; none is null."""
    lists = pc.split_pattern(texts, " ")
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    ids, ends = words.dictionary_encode().indices.to_numpy(), np.cumsum(lengths)
    end_of = np.repeat(ends, lengths)
    longest = np.zeros(len(ids), dtype=np.int64)
    for size in range(SHORTEST_PHRASE, LONGEST_PHRASE + 1):
        same = np.concatenate([[0], np.cumsum(ids[size:] == ids[:-size])])
        starts = np.flatnonzero(same[size:] - same[:-size] == size)
        longest[starts[starts + 2 * size <= end_of[starts]]] = size
    starts = np.flatnonzero(longest)
    if not len(starts):
        return texts
    kept, done = np.ones(len(ids), dtype=bool), 0
    for start, size in zip(starts.tolist(), longest[starts].tolist()):
        if start >= done:
            done = start + 2 * size
            kept[start + size : done] = False
    places = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), words.filter(pa.array(kept))), " ")


def collapse_repeats(text: Column) -> Column:
    """A phrase of 3 to 10 words that is repeated at once is kept once.

    One left-to-right scan: at each word the longest repeated phrase wins, the pair becomes a
    single copy, and the scan goes on behind the pair. A regex with a back-reference says the same, but
    reads ten words ahead of every word; here all places of one phrase length are found in one comparison.
    """

    def collapse(texts: pa.Array) -> pa.Array:
        filled = pc.fill_null(texts, "")
        parts = [_collapsed(part) for part, _ in _chunks(filled, filled)]
        found = pa.concat_arrays(parts) if parts else filled
        return pc.if_else(pc.is_valid(texts), found, None)

    collapse.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(collapse, StringType())(squeeze(text))


def default_if_empty(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\z", EMPTY_PREDICTION)


def postprocess(text: Column) -> Column:
    """Clean one generated text; null and empty give ``"..."``."""
    value = strip_thinking(strip_template_tokens(F.coalesce(text, F.lit(""))))
    return default_if_empty(collapse_repeats(value))
