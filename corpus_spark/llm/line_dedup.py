"""Lines that many documents share, found through levelled sorted runs of line hashes.

Documents are taken in batches of falling ids. A run is a table (key, documents, largest id) sorted
by key. Each batch is anti-joined with the keys that the runs have settled already (held by enough
documents, whose largest id came with an earlier batch), and adds the rest as a run of its own. When
a level holds ``fanout`` runs they are merged into one run of the next level, so a key is rewritten
once per level and never once per batch. In the end the runs name every key that enough documents
hold and the one document that keeps it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpus_spark.llm.arrow import add_columns, map_arrow
from corpus_spark.llm.names import all_but, quoted
from corpus_spark.llm.scratch import written

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCUMENTS = 5
BATCHES = 4
FANOUT = 2
# Ids looked at to cut the table into batches.
SAMPLED_IDS = 4096


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """MD5 of the line stripped and with A-Z in lower case; None where that is shorter than asked."""
    key = line.encode().strip(BLANKS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


class Runs:
    """Levelled runs of line keys in the shared folder."""

    def __init__(self, min_documents: int = MIN_DOCUMENTS, fanout: int = FANOUT):
        self.min_documents = min_documents
        self.fanout = max(2, fanout)
        self.levels: list[list[DataFrame]] = []

    def merged(self) -> DataFrame | None:
        """All runs as one: a row per key."""
        runs = [run for level in self.levels for run in level]
        return _merge(runs) if runs else None

    def settled(self) -> DataFrame | None:
        """Keys of enough documents, with the largest id that holds them."""
        merged = self.merged()
        return None if merged is None else merged.filter(F.col("n_documents") >= self.min_documents)

    def add(self, pairs: DataFrame) -> None:
        """Take a batch (key, doc_id) whose ids are below those of the batches before.

        The batch is counted first, as far as it goes before the shuffle, so a line that a third of all
        documents hold is one row in the join. A settled key needs no more counting and stays out of
        the new run.
        """
        own = pairs.groupBy("key").agg(F.count_distinct("doc_id").alias("n_documents"), F.max("doc_id").alias("keeper"))
        settled = self.settled()
        if settled is not None:
            own = own.join(settled.select("key"), "key", "left_anti")
        self._put(own, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions("key"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(_merge(full), level + 1)


def _merge(runs: list[DataFrame]) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    union = runs[0]
    for run in runs[1:]:
        union = union.unionByName(run)
    return union.groupBy("key").agg(F.sum("n_documents").alias("n_documents"), F.max("keeper").alias("keeper"))


def line_pairs(df: DataFrame, doc_id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """(key, doc_id, batch) for each distinct key of each document, written by batch; batch 0 has the largest ids."""

    def make():
        def run(texts):
            found = [{line_key(line, min_chars) for line in (value or "").split("\n")} - {None} for value in texts]
            return {"keys": [list(each) for each in found]}

        return run

    named = df.filter(quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    keyed = add_columns(named, "text", "keys array<binary>", make).select("doc_id", F.explode("keys").alias("key"))
    number = sum((F.when(F.col("doc_id") >= F.lit(bound), 0).otherwise(1) for bound in batch_bounds(named.select("doc_id"), batches)), F.lit(0))
    return written(keyed.withColumn("batch", number), "line-keys", "batch")


def batch_bounds(ids: DataFrame, batches: int) -> list:
    """Ids that cut all of them into about equal batches, from a sample of bounded size: the ids of the smallest
    hashes. What the batches are changes no result. Ids may have any type that has an order."""
    sample = [row.doc_id for row in ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED_IDS).collect()]
    ordered = sorted(sample)
    return [ordered[len(ordered) * number // batches] for number in range(1, batches)] if ordered else []


def dedup_lines(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT,
) -> DataFrame:
    """The frame with ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped``.

    A line's key is the line stripped of blanks with A-Z in lower case. Keys of at least
    ``min_chars`` characters that at least ``min_documents`` ids hold lose all their lines except in
    the largest id. Other lines stay in place, joined by a line feed. A null or empty text is one
    empty line. Rows of one id are one document: they count once and keep or lose a line together.
    A row with a null id is left as it is and counts for no key. Ids may have any type that has an order. An empty
    table gives an empty table. Columns already named as the new ones are replaced, others pass through; the column of
    the texts may not have such a name. Runs jobs when called: one per batch and merge.
    """
    if text.lower() in _ADDED:
        raise ValueError(f"column {text} is read, so it cannot be written too")
    pairs = line_pairs(df, doc_id, text, min_chars, batches)
    runs = Runs(min_documents, fanout)
    for batch in range(batches):
        runs.add(pairs.filter(F.col("batch") == batch).select("key", "doc_id"))
    repeats = (
        pairs.join(runs.settled(), "key").filter(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("key").alias("dropped"))
    )
    kept = df.select(*all_but(df, *_ADDED))
    rows = df.select(F.struct(*all_but(df, *_ADDED)).alias("row"), quoted(doc_id).alias("id"))
    joined = rows.join(repeats, F.col("id") == F.col("of"), "left").select("row", "dropped")
    return _without(joined, kept, text, min_chars)


_ADDED = ("kept_text", "n_lines", "n_dropped")


def _without(joined: DataFrame, kept: DataFrame, text: str, min_chars: int) -> DataFrame:
    """Rows (row, dropped) with the columns of ``kept`` and what is left of their texts without the dropped keys."""
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("kept_text string, n_lines long, n_dropped long").fields])
    column = [name.lower() for name in kept.columns].index(text.lower())

    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for value, dropped in zip(batch.column(0).field(column), batch.column(1)):
                lines = (value.as_py() or "").split("\n")
                n_lines.append(len(lines))
                if dropped.is_valid:
                    gone = set(dropped.as_py())
                    lines = [line for line in lines if line_key(line, min_chars) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append("\n".join(lines))
            arrays = [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *arrays], schema.names)

    return map_arrow(joined, run, schema)
