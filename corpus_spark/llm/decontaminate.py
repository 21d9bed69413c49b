"""Benchmark passages in documents, found with a positional inverted index spread over the documents.

The index is a table of blocks. A block holds the words of some whole documents: each distinct term
with its postings, the places where it stands, counted through the block with a gap between
documents. A phrase is looked up in every block by itself: its terms' lists are moved back by their
offsets and intersected, starting from the term that is rarest there. No posting is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.arrow import map_arrow, slices
from corpus_spark.llm.names import fresh, quoted
from corpus_spark.llm.scratch import with_key, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
# Text in a block; a longer document has a block of its own.
BLOCK_BYTES = 4 << 20
# Windows looked up in one pass: what is broadcast is about this many rows of WINDOW numbers.
QUERY_WINDOWS = 1 << 17
_PIECE = 1024
_CANDIDATES = 1 << 20

INDEX = "block string, slot array<int>, doc_id array<{id}>, first array<int>, n_words array<int>, terms binary, begins binary, postings binary"


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; none for null."""
    return WORD.findall((text or "").encode().lower())


def build_index(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of all words of all rows, written to the shared folder.

    Every row is a document of its own, whatever its id; null texts have no words. ``slot`` numbers
    the rows of a block. Terms are joined by line feeds, numbers are little-endian 32-bit.
    """
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, block_bytes):
                yield pa.RecordBatch.from_pylist([_block(part)], schema=_block_schema(part.schema.field(0).type))

    named = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    return written(map_arrow(named, run, INDEX.format(id=kind)), "positional-index")


def _block_schema(id_type: pa.DataType) -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([
        ("block", pa.string()), ("slot", ints), ("doc_id", pa.list_(id_type)), ("first", ints), ("n_words", ints),
        ("terms", pa.binary()), ("begins", pa.binary()), ("postings", pa.binary()),
    ])


def _block(part: pa.RecordBatch) -> dict:
    codes = defaultdict(count().__next__)
    coded, first, sizes, place = [], [], [], 0
    for text in part.column(1).to_pylist():
        words = words_of(text)
        coded.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
        first.append(place)
        sizes.append(len(words))
        place += len(words) + 1
    code = np.concatenate(coded) if coded else np.array([], np.int32)
    where = np.concatenate([np.arange(start, start + size, dtype=np.int32) for start, size in zip(first, sizes)])
    order = np.argsort(code, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(codes)))])
    return {
        "block": uuid.uuid4().hex, "slot": range(len(sizes)), "doc_id": part.column(0).to_pylist(), "first": first, "n_words": sizes,
        "terms": b"\n".join(codes), "begins": begins.astype("<i4").tobytes(), "postings": where[order].astype("<i4").tobytes(),
    }


class Query:
    """Windows of items as rows of term numbers; small enough to broadcast."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        numbers = defaultdict(count().__next__)
        rows, of, names = [], [], defaultdict(count().__next__)
        for item, words in pieces:
            coded = [numbers[word] for word in words]
            for start in range(max(1, len(coded) - window + 1)):
                row = coded[start : start + window]
                rows.append(row + [-1] * (window - len(row)))
                of.append(names[item])
        table = np.array(rows, dtype=np.int32).reshape(len(rows), window)
        # A passage that several items share is looked up once.
        self.windows, self.which = np.unique(table, axis=0, return_inverse=True) if len(rows) else (table, np.array([], int))
        self.which = self.which.reshape(-1)
        self.of = np.array(of, dtype=np.int64)
        self.lengths = (self.windows >= 0).sum(axis=1)
        self.terms = list(numbers)
        self.items = np.array(list(names), dtype=object)
        order = np.argsort(self.which, kind="stable")
        self.items_of = np.split(self.of[order], np.flatnonzero(np.diff(self.which[order])) + 1) if len(order) else []


class Block:
    """One block of the index, opened for the terms of a query."""

    def __init__(self, row: dict, query: Query):
        numbers = {term: number for number, term in enumerate(row["terms"].split(b"\n"))} if row["terms"] else {}
        begins = np.frombuffer(row["begins"], "<i4")
        postings = np.frombuffer(row["postings"], "<i4")
        self.first = np.array(row["first"], dtype=np.int64)
        self.size = int(self.first[-1]) + row["n_words"][-1] + 1 if len(self.first) else 0
        self.lists = []
        for term in query.terms:
            number = numbers.get(term)
            self.lists.append(postings[begins[number] : begins[number + 1]] if number is not None else postings[:0])
        self.counts = np.array([len(each) for each in self.lists] or [0], dtype=np.int64)

    def exact(self, query: Query) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of each occurrence of each window."""
        used = query.windows >= 0
        held = np.where(used, self.counts[query.windows], np.iinfo(np.int64).max)
        found = np.flatnonzero((held > 0).all(axis=1))
        rarest = held[found].argsort(axis=1, kind="stable")
        sizes = np.take_along_axis(held[found], rarest[:, :1], axis=1)[:, 0] if len(found) else held[:0, 0]
        windows, places = [], []
        # The terms at each place, for the terms of the query: membership in a list is one look.
        at = np.full(self.size + query.windows.shape[1] + 1, -1, dtype=np.int32)
        for number, postings in enumerate(self.lists):
            at[postings] = number
        start = 0
        ends = np.cumsum(sizes)
        while start < len(found):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _CANDIDATES, "right")))
            chosen, by = found[start:stop], rarest[start:stop]
            window = np.repeat(np.arange(len(chosen)), sizes[start:stop])
            anchors = [self.lists[query.windows[w, o]] - o for w, o in zip(chosen, by[:, 0])]
            place = np.concatenate(anchors).astype(np.int64)
            keep = place >= 0
            window, place = window[keep], place[keep]
            for turn in range(1, query.windows.shape[1]):
                offset = by[window, turn]
                term = query.windows[chosen[window], offset]
                keep = (term < 0) | (at[place + offset] == term)
                window, place = window[keep], place[keep]
            windows.append(chosen[window])
            places.append(place)
            start = stop
        if not windows:
            return np.array([], np.int64), np.array([], np.int64)
        return np.concatenate(windows), np.concatenate(places)

    def near(self, query: Query, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its rarest term) where every term stands within ``reach`` words, in one document."""
        windows, places = [], []
        for window, row in enumerate(query.windows):
            terms = sorted(set(row[row >= 0].tolist()), key=lambda term: self.counts[term])
            anchors = self.lists[terms[0]].astype(np.int64)
            anchor_slot = np.searchsorted(self.first, anchors, "right")
            for term in terms[1:]:
                postings = self.lists[term].astype(np.int64)
                near = np.zeros(len(anchors), dtype=bool)
                if len(postings):
                    after = np.searchsorted(postings, anchors)
                    for each in (np.maximum(after - 1, 0), np.minimum(after, len(postings) - 1)):
                        other = postings[each]
                        near |= (np.abs(other - anchors) <= reach) & (np.searchsorted(self.first, other, "right") == anchor_slot)
                anchors, anchor_slot = anchors[near], anchor_slot[near]
            windows.append(np.full(len(anchors), window))
            places.append(anchors)
        return np.concatenate(windows or [np.array([], int)]), np.concatenate(places or [np.array([], int)])


def query_blocks(items: DataFrame, item_id: str, text: str, window: int, most: int = QUERY_WINDOWS):
    """The items' windows as queries of a bounded size, one after the other.

    Items are cut into pieces of at most ``_PIECE`` windows, distinct pieces are dealt by hash of id and
    words, so that the rows of one id spread, and the number of deals doubles until the largest keeps
    to twice the bound, or a piece.
    """

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                pieces = [words[at : at + _PIECE + window - 1] for at in range(0, max(1, len(words) - window + 1), _PIECE)] if words else []
                if pieces:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(pieces), pa.string()), pa.array(pieces, pa.list_(pa.binary()))],
                        ["item_id", "words"],
                    )

    named = items.select(quoted(item_id).cast("string").alias("item_id"), quoted(text).alias("text"))
    pieces = written(map_arrow(named, run, "item_id string, words array<binary>").distinct(), "query-pieces")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    deals = max(1, -(-total // most))
    limit = max(2 * most, _PIECE + window)
    while True:
        dealt = F.pmod(F.xxhash64("item_id", "words"), F.lit(deals))
        sizes = pieces.groupBy(dealt.alias("deal")).agg(F.sum(F.size("words")).alias("n")).orderBy("deal").collect()
        if max((row["n"] for row in sizes), default=0) <= limit:
            break
        deals *= 2
    # Neighbouring deals that keep to the bound together are one pass.
    passes, held = [(0, 0)] if not sizes else [], limit
    for deal, n in sizes:
        if held + n > limit:
            passes.append((deal, deal))
            held = 0
        passes[-1] = (passes[-1][0], deal)
        held += n
    for first, last in passes:
        rows = pieces.filter(dealt.between(first, last)).select("item_id", "words").toArrow()
        yield Query(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())), window)


def search(index: DataFrame, query: Query, reach: int | None = None) -> DataFrame:
    """(block, slot, spans, items) of each document with a hit: merged places of words from the
    document's first, and the items found. Exact phrases, or proximity within ``reach`` words."""
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(batches):
        query = shared.value
        for batch in batches:
            for number in range(batch.num_rows):
                found = _found(batch.slice(number, 1).to_pylist()[0], query, reach)
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=_FOUND)

    opened = index.select("block", "first", "n_words", "terms", "begins", "postings")
    return map_arrow(opened, run, "block string, slot int, spans array<struct<start:int,stop:int>>, items array<string>")


_FOUND = pa.schema([
    ("block", pa.string()), ("slot", pa.int32()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string())),
])


def _found(row: dict, query: Query, reach: int | None) -> list[dict]:
    block = Block(row, query)
    windows, places = block.exact(query) if reach is None else block.near(query, reach)
    if not len(windows):
        return []
    lengths = query.lengths[windows] if reach is None else np.ones(len(windows), int)
    covered = np.bincount(places, minlength=block.size + 1) - np.bincount(places + lengths, minlength=block.size + 1)
    hit = np.concatenate([[False], np.cumsum(covered) > 0, [False]])
    edges = np.flatnonzero(np.diff(hit))
    starts, stops = edges[::2], edges[1::2]
    slot_of_span = np.searchsorted(block.first, starts, "right") - 1
    slots = np.searchsorted(block.first, places, "right") - 1
    pairs = np.unique(np.stack([slots, windows]), axis=1)
    items = defaultdict(set)
    for slot, window in pairs.T.tolist():
        items[slot].update(query.items_of[window].tolist())
    spans = defaultdict(list)
    for slot, start, stop in zip(slot_of_span.tolist(), starts.tolist(), stops.tolist()):
        spans[slot].append({"start": start - int(block.first[slot]), "stop": stop - int(block.first[slot])})
    return [{"block": row["block"], "slot": slot, "spans": spans[slot], "items": query.items[sorted(found)].tolist()} for slot, found in items.items()]


def matches(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, reach: int | None = None, most: int = QUERY_WINDOWS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of the documents.

    Words are runs of ASCII letters and digits and of all other characters, with A-Z in lower case.
    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one
    window. ``n_hit`` counts the document's words inside any occurrence of a window, ``spans`` are
    those words' places, merged where they touch, and ``items`` the sorted ids of the items, as
    strings. With ``reach`` the windows need not stand as phrases: every word of the window must be
    within that many words of its rarest one, whose places are then the spans.

    Null texts have no words; items of one id are one item, those of a null id too, which is a null, the last, in
    ``items``. Repeated documents come out repeated. An empty table on either side gives no hits. Other columns
    are not read. Any number of items is looked up: in passes of ``most`` windows over the index.
    Runs jobs when called.
    """
    index = build_index(documents, doc_id, text)
    found = None
    for query in query_blocks(benchmark, item_id, item_text, window, most):
        each = search(index, query, reach)
        found = each if found is None else found.unionByName(each)
    # One row per document and pass that found something, so a group has as many rows as passes.
    hits = found.groupBy("block", "slot").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, span: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= span["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], span["stop"]).alias("stop"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(span))),
    )
    hits = hits.withColumn("spans", merged)
    rows = index.select("block", F.explode(F.arrays_zip("slot", "doc_id", "n_words")).alias("row")).select("block", "row.*")
    none = F.array().cast("array<string>")
    return rows.join(hits, ["block", "slot"], "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.aggregate("spans", F.lit(0), lambda n, span: n + span["stop"] - span["start"]), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
    )


def without_matches(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows without a hit, as they came. Rows are decided one by one: neither a null id nor one that rows share
    keeps a row with a hit or drops one without. ``doc_id`` is not read, but may be named as in ``matches``."""
    key = fresh(documents, "row_key")
    rows = with_key(documents, key)
    # Written, so that Spark knows how few they are.
    hit = written(matches(rows, benchmark, key, text, **options).filter("n_hit > 0").select("doc_id"), "hit-rows")
    return rows.join(hit, quoted(key) == hit["doc_id"], "left_anti").drop(key)
