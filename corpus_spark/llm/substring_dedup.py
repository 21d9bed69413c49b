"""Passages that documents share, by hashing paragraphs that their own words bound.

A text is cut into units of some twenty words and more. Units that lines bound go from the start of a
line over as many whole lines as it takes. Lines are not enough: a passage may stand inside a longer
line, or across parts of several. So there are units that content bounds as well: a word whose hash is
the smallest among its neighbours on both sides is a place to cut, and equal passages have the same such
places wherever they start, but for the neighbours at their ends. A unit begins at every place and ends
at the next one that gives it its words, so units overlap and no run of units can be missed.

Units are normalised and hashed, digests are grouped over all documents, the earliest occurrence (by
id, then by offset) is kept and the others go, where they make up a passage.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpus_spark.llm.arrow import map_arrow, one_list, packed, slices, unpacked
from corpus_spark.llm.names import all_but, quoted
from corpus_spark.llm.scratch import written

# Words of a unit at least, and of a stretch of repeated units that is removed.
MIN_WORDS = 20
MIN_PASSAGE = 36
# Neighbours on each side that a word's hash must not exceed, for a cut before it.
REACH = 3
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Texts whose units are looked for together.
SLICE_BYTES = 8 << 20
# Words whose hashes a Python worker remembers.
KNOWN_WORDS = 400_000


class _Hashes(dict):
    """The first eight bytes of a word's MD5, in order."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:8], "big")
        return value


def cuts(hashes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Places before words whose hash none of the ``reach`` neighbours on either side is below, the start and the end."""
    least = hashes.copy()
    for step in range(1, min(reach, len(hashes) - 1) + 1):
        np.minimum(least[step:], hashes[:-step], out=least[step:])
        np.minimum(least[:-step], hashes[step:], out=least[:-step])
    return np.union1d(np.flatnonzero(least == hashes), [0, len(hashes)])


def spans_between(places: np.ndarray, min_words: int) -> np.ndarray:
    """(start, stop) from each place to the first one that is at least ``min_words`` words on."""
    stops = np.searchsorted(places, places + min_words)
    there = stops < len(places)
    return np.stack([places[there], places[stops[there]]], axis=1)


def unit_spans(text: str, known: _Hashes, min_words: int = MIN_WORDS, reach: int = REACH) -> tuple[list[bytes], np.ndarray]:
    """The words in lower case (A-Z), and the places of all units among them: bounded by content and by lines."""
    raw = text.encode().lower()
    words = raw.split()
    if len(words) < min_words:
        return words, np.zeros((0, 2), dtype=np.int64)
    by_content = spans_between(cuts(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), reach), min_words)
    lines = np.unique(np.cumsum([0, *[len(line.split()) for line in raw.split(b"\n")]]))
    return words, np.unique(np.concatenate([by_content, spans_between(lines, min_words)]), axis=0)


def unit_slices(df: DataFrame, doc_id: str, text: str, min_words: int, reach: int) -> DataFrame:
    """One row per slice of documents, written: their units, and each distinct unit once with its first place here.

    ``docs`` are the documents; ``n_units``, ``starts`` (steps from unit to unit), ``lengths`` and ``which`` (the
    place among the slice's distinct units) describe their units in words. A distinct unit has a key of 96 bits of the MD5
    of its words with single spaces between, the id, version and start of its first place in the slice, and whether it
    has others here; ``version`` tells texts of one id apart.
    """
    named = df.filter(quoted(doc_id).isNotNull() & quoted(text).isNotNull()).select(
        quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("version"), quoted(text).alias("text")
    )
    kind = named.schema["doc_id"].dataType.simpleString()
    schema = (
        f"slice long, docs array<struct<doc_id:{kind},version:bigint>>, n_units array<int>, starts binary, lengths binary, which binary, "
        f"keys array<bigint>, mores array<int>, first_ids array<{kind}>, versions array<bigint>, first_starts array<int>, repeats array<boolean>"
    )

    def run(batches):
        known = _Hashes()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, 2, SLICE_BYTES):
                yield _slice(rows, number, known, min_words, reach)
                number += 1

    return written(map_arrow(named, run, schema), "unit-slices")


def _ranks(rows: pa.RecordBatch) -> np.ndarray:
    """The place of each row in the order of id and version; equal rows have one."""
    names = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    rank = {name: place for place, name in enumerate(sorted(set(names)))}
    return np.fromiter(map(rank.__getitem__, names), np.int64, len(names))


def _first_places(which: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The index of the first occurrence, by rank and start, of each distinct unit."""
    order = np.lexsort((start, rank, which))
    return order[np.flatnonzero(np.diff(which[order], prepend=-1))]


def _slice(rows: pa.RecordBatch, number: int, known: _Hashes, min_words: int, reach: int) -> pa.RecordBatch:
    keys, spans, n_units = [], [np.zeros((0, 2), dtype=np.int64)], []
    for value in rows.column(2):
        words, own = unit_spans(value.as_py(), known, min_words, reach)
        n_units.append(len(own))
        if len(own):
            joined = b" ".join(words)
            begins = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
            for start, stop in zip(begins[own[:, 0]].tolist(), (begins[own[:, 1]] - 1).tolist()):
                keys.append(hashlib.md5(joined[start:stop], usedforsecurity=False).digest()[:12])
            spans.append(own)
    start, stop = np.concatenate(spans).T
    # Distinct units in the order in which they are met, so that neighbours have one document.
    numbers = {}
    which = np.fromiter((numbers.setdefault(key, len(numbers)) for key in keys), np.int64, len(keys))
    owner = np.repeat(np.arange(len(n_units)), n_units)
    rank = _ranks(rows)[owner]
    first = _first_places(which, rank, start)
    repeats = np.zeros(len(numbers), dtype=bool)
    repeats[which[(rank != rank[first[which]]) | (start != start[first[which]])]] = True
    digests = np.frombuffer(b"".join(numbers), np.int32).reshape(-1, 3)
    whose = pa.array(owner[first])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]), one_list(pa.StructArray.from_arrays([rows.column(0), rows.column(1)], ["doc_id", "version"])),
            one_list(pa.array(n_units, pa.int32())),
            *[pa.array([packed(each)], pa.binary()) for each in (_steps(start, n_units), stop - start, which)],
            one_list(pa.array(np.ascontiguousarray(digests[:, :2]).view(np.int64).ravel())), one_list(pa.array(digests[:, 2])),
            one_list(rows.column(0).take(whose)), one_list(rows.column(1).take(whose)), one_list(pa.array(start[first].astype(np.int32))),
            one_list(pa.array(repeats)),
        ],
        ["slice", "docs", "n_units", "starts", "lengths", "which", "keys", "mores", "first_ids", "versions", "first_starts", "repeats"],
    )


def _steps(values: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Differences of values that grow in each document; the first one of a document is itself."""
    steps = np.diff(values, prepend=0)
    begins = (np.cumsum(sizes) - sizes)[np.array(sizes, dtype=np.int64) > 0]
    steps[begins] = values[begins]
    return steps


def repeated_spans(units: DataFrame) -> DataFrame:
    """(doc_id, version, gone, shared): the places of units that go, as far as they do not overlap the one that stays,
    and of all units that stand more than once. Documents without any are left out.

    A slice asks once for each of its distinct units, so the rows of a unit that every document holds are no more than
    there are slices. It learns which ones other slices hold too, and whether the first place of all is its own.
    """
    kind = units.schema["first_ids"].dataType.elementType
    asked = units.select("slice", F.posexplode(F.arrays_zip("keys", "mores", "first_ids", "versions", "first_starts", "repeats")).alias("place", "unit"))
    same = Window.partitionBy("unit.keys", "unit.mores")
    own = F.struct("unit.first_ids", "unit.versions", "unit.first_starts")
    # Equal rows in several slices are one place.
    more = (F.min(own).over(same) != F.max(own).over(same)) | F.bool_or("unit.repeats").over(same)
    several = asked.select(
        "slice", "place", (own == F.min(own).over(same)).alias("own"), (F.count(F.lit(1)).over(same) > 1).alias("elsewhere"), more.alias("more")
    ).filter("elsewhere AND more")
    told = several.select("slice", "place", "own", F.lit(False).alias("last"))
    carried = units.select("slice", "docs", "n_units", "starts", "lengths", "which", F.lit(True).alias("last"))
    both = told.unionByName(carried, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "last", "place")
    schema = StructType().add("doc_id", kind)
    schema = StructType([*schema.fields, *StructType.fromDDL("version long, gone array<struct<start:int,stop:int>>, shared array<struct<start:int,stop:int>>").fields])

    def run(batches):
        places, owns = [], []
        for batch in batches:
            last = batch.column("last").to_numpy(zero_copy_only=False)
            start = 0
            for stop in [*np.flatnonzero(last).tolist(), batch.num_rows]:
                places.append(batch.column("place")[start:stop].to_numpy(zero_copy_only=False).astype(np.int64))
                owns.append(batch.column("own")[start:stop].to_numpy(zero_copy_only=False).astype(bool))
                start = stop + 1
                if stop < batch.num_rows:
                    found = _spans(batch.slice(stop, 1).to_pylist()[0], np.concatenate(places), np.concatenate(owns))
                    if found:
                        yield pa.RecordBatch.from_pylist(found, schema=to_arrow_schema(schema))
                    places, owns = [], []

    spans = map_arrow(both.select("last", "place", "own", "docs", "n_units", "starts", "lengths", "which"), run, schema)
    # Equal rows of different slices are found in each of them.
    return spans.groupBy("doc_id", "version").agg(F.first("gone").alias("gone"), F.first("shared").alias("shared"))


def _spans(row: dict, places: np.ndarray, owns: np.ndarray) -> list[dict]:
    n_units = np.array(row["n_units"], dtype=np.int64)
    size = int(n_units.sum())
    if not size:
        return []
    steps, lengths, which = (unpacked(row[name], size) for name in ("starts", "lengths", "which"))
    ends = np.cumsum(n_units)
    run = np.concatenate([[0], np.cumsum(steps)])
    start = run[1:] - np.repeat(run[ends - n_units], n_units)
    names = [(each["doc_id"], each["version"]) for each in row["docs"]]
    rank_of = {name: place for place, name in enumerate(sorted(set(names)))}
    rank = np.fromiter(map(rank_of.__getitem__, names), np.int64, len(names))[np.repeat(np.arange(len(names)), n_units)]
    first = _first_places(which, rank, start)[which]
    stays = (rank == rank[first]) & (start == start[first])
    elsewhere = np.zeros(which.max() + 1, dtype=bool)
    elsewhere[places] = True
    before = np.zeros(which.max() + 1, dtype=bool)
    before[places[~owns]] = True
    here = np.zeros(which.max() + 1, dtype=bool)
    here[which[~stays]] = True
    shared = (elsewhere | here)[which]
    gone = before[which] | ~stays
    # In the document of the place that stays, what overlaps that place is not cut off it.
    clipped = np.where((rank == rank[first]) & ~before[which], np.maximum(start, start[first] + lengths), start)
    stop = start + lengths
    gone &= clipped < stop
    found = []
    for name, end, n in zip(names, ends.tolist(), n_units.tolist()):
        own = slice(end - n, end)
        if shared[own].any():
            found.append({
                "doc_id": name[0], "version": name[1],
                "gone": _listed(clipped[own][gone[own]], stop[own][gone[own]]), "shared": _listed(start[own][shared[own]], stop[own][shared[own]]),
            })
    return found


def _listed(starts: np.ndarray, stops: np.ndarray) -> list[dict]:
    return [{"start": start, "stop": stop} for start, stop in merged(list(zip(starts.tolist(), stops.tolist())), 0)]


def merged(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """The spans joined where they touch, without those of fewer than ``least`` words."""
    found: list[list[int]] = []
    for start, stop in sorted(spans):
        if found and found[-1][1] >= start:
            found[-1][1] = max(found[-1][1], stop)
        elif start < stop:
            found.append([start, stop])
    return [(start, stop) for start, stop in found if stop - start >= least]


def dedup_units(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_passage: int = MIN_PASSAGE, reach: int = REACH,
) -> DataFrame:
    """The frame with ``kept_text``, ``n_words``, ``n_shared``, ``n_removed`` and ``removed``: (start, stop) of
    each removed stretch in the original text, in code points.

    Of equal units the one with the smallest id, and there the smallest offset, stays; the others go,
    in later documents and further on in the same one, as far as they do not overlap the one that stays there. Removed
    units that touch are one stretch, and a stretch of fewer than ``min_passage`` words stays. It goes with the
    blanks after it; nothing else of the text is changed. ``n_removed`` counts the words that went, ``n_shared`` those
    in stretches of as many words of units that stand more than once, the ones that stay included.

    A null or empty text has no words and stays empty. Rows of one id and one text are one document and lose the same;
    texts of one id that differ are documents of their own, in the order of a hash. A row with a null id is left as
    it is and counts for nothing. Ids may have any type that has an order. An empty table gives an empty table.
    Columns already named as the new ones are replaced, others pass through; the column of the texts may not have such
    a name. Runs a job when called.
    """
    new = StructType.fromDDL("kept_text string, n_words long, n_shared long, n_removed long, removed array<struct<start:int,stop:int>>")
    if text.lower() in new.names:
        raise ValueError(f"column {text} is read, so it cannot be written too")
    found = repeated_spans(unit_slices(df, doc_id, text, min_words, reach))
    spans = found.select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), F.struct("gone", "shared").alias("spans"))
    kept = df.select(*all_but(df, *new.names))
    rows = df.select(F.struct(*all_but(df, *new.names)).alias("row"), quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("version"))
    joined = rows.join(spans, F.expr("id = of AND version = of_version"), "left").select("row", "spans")
    column = [name.lower() for name in kept.columns].index(text.lower())
    schema = StructType([*kept.schema.fields, *new.fields])
    removed_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = [_without(value.as_py(), own.as_py(), min_passage) for value, own in zip(batch.column(0).field(column), batch.column(1))]
            texts, n_words, n_shared, n_removed, removed = zip(*found) if found else ([],) * 5
            arrays = [pa.array(texts, pa.string()), *[pa.array(each, pa.int64()) for each in (n_words, n_shared, n_removed)], pa.array(removed, removed_type)]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *arrays], schema.names)

    return map_arrow(joined, run, schema)


def _without(text: str | None, spans: dict | None, min_passage: int) -> tuple[str, int, int, int, list[dict]]:
    text = text or ""
    gone, shared = (
        [(each["start"], each["stop"]) for each in spans[name] if each["stop"] - each["start"] >= min_passage] if spans else [] for name in ("gone", "shared")
    )
    if not gone:
        return text, len(text.encode().split()), sum(stop - start for start, stop in shared), 0, []
    begins = [word.start() for word in WORD.finditer(text)]
    n_words = len(begins)
    begins.append(len(text))
    places = [(begins[start], begins[stop]) for start, stop in gone]
    ends = [0, *[stop for _, stop in places]]
    kept = "".join(text[stop:start] for stop, start in zip(ends, [*[start for start, _ in places], len(text)]))
    removed = [{"start": start, "stop": stop} for start, stop in places]
    return kept, n_words, sum(stop - start for start, stop in shared), sum(stop - start for start, stop in gone), removed
