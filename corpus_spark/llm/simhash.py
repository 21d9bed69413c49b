"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Two fingerprints within ``radius`` bits have population counts within ``radius``, over the whole and
over the sum of the differences of their four quarters. Distinct fingerprints are sorted into classes by the
population counts of their quarters and cut into tiles; only tiles of classes within the radius meet.
A pair of tiles is compared in full with exclusive-or and bit counts, so no link can be missed.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.arrow import add_columns, map_arrow
from corpus_spark.llm.components import connected_components
from corpus_spark.llm.names import fresh, quoted
from corpus_spark.llm.scratch import with_key, written

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
# Fingerprints in a tile, on average at most.
TILE = 4096
_ROWS = 32
_SHINGLES = 1 << 16
# Population counts of the quarters of a fingerprint.
COUNTS = ["count_0", "count_1", "count_2", "count_3"]


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of the text's word shingles, repeats included; zero without words.

    Words are what blanks separate, with A-Z in lower case. A text of fewer words than a shingle has
    one shingle, all of it.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*[found[i:] for i in range(words)]))
        n = len(found) - words + 1
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _SHINGLES):
        size = min(_SHINGLES, n - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(shingles), SEED) for _ in range(size)), "<u8", size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """The frame with ``simhash``, the fingerprint's bits as a signed long. A null text has no words."""

    def make():
        def run(texts):
            return {"simhash": np.array([fingerprint(text, words) for text in texts], dtype=np.uint64).view(np.int64)}

        return run

    return add_columns(df, text, "simhash long", make)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect what the pairs of a tile with another (or itself) within the radius connect.

    A pair whose two sides are connected by links kept before adds nothing, so a tile full of near
    copies gives at most as many links as it has fingerprints.
    """
    own = b is None
    b = a if own else b
    of = np.arange(len(b))
    left, right = [], []
    for start in range(0, len(a), _ROWS):
        block = a[start : start + _ROWS]
        near = np.bitwise_count(block[:, None] ^ b[None, :]) <= radius
        for row in np.flatnonzero(near.any(axis=1)):
            hits = np.flatnonzero(near[row])
            if own:
                hits = hits[hits > start + row]
            if not len(hits):
                continue
            labels, first = np.unique(of[hits], return_index=True)
            left += [int(block[row])] * len(first)
            right += b[hits[first]].tolist()
            if len(labels) > 1:
                of[np.isin(of, labels[1:])] = labels[0]
    return left, right


def tiles(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """(count_0, ..., count_3, tile, members): fingerprints by the population counts of their quarters.

    A class of more than ``tile`` members is dealt over several tiles by hash. There are at most 17 ** 4 = 83,521
    classes, so the table of their sizes can be broadcast whatever the input.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("simhash", 16 * place).bitwiseAND(F.lit(0xFFFF))) for place in range(len(COUNTS))]
    classed = distinct.select("simhash", *[count.alias(name) for count, name in zip(quarter, COUNTS)])
    sizes = classed.groupBy(*COUNTS).agg(F.ceil(F.count(F.lit(1)) / tile).alias("n_tiles"))
    return (
        classed.join(F.broadcast(sizes), COUNTS)
        .withColumn("tile", F.pmod(F.xxhash64("simhash"), "n_tiles").cast("int"))
        .groupBy(*COUNTS, "tile").agg(F.collect_list("simhash").alias("members"))
    )


def steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of the four counts that add up to at most the radius, one of each two opposite ones."""
    every = [step for step in product(range(-radius, radius + 1), repeat=len(COUNTS)) if sum(map(abs, step)) <= radius]
    return [step for step in every if step >= (0,) * len(COUNTS)]


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that are within the radius."""
    made = written(tiles(distinct, tile), "simhash-tiles")
    # Half of the neighbourhood: each pair of classes meets once, a class also meets itself.
    half = F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in zip(COUNTS, step)]) for step in steps(radius)])
    others = [f"{name}_b" for name in COUNTS]
    other = made.select(*[F.col(name).alias(of) for name, of in zip(COUNTS, others)], F.col("tile").alias("tile_b"), F.col("members").alias("b"))
    moved = made.withColumn("step", F.explode(half)).withColumns({of: F.col(name) + F.col(f"step.{name}") for name, of in zip(COUNTS, others)})
    same_class = " AND ".join(f"step.{name} = 0" for name in COUNTS)
    pairs = moved.join(other, others).filter(f"NOT ({same_class}) OR tile <= tile_b")
    itself = F.expr(f"{same_class} AND tile = tile_b")
    # One class may hold most fingerprints: its pairs of tiles are dealt over all tasks.
    dealt = pairs.select(
        *COUNTS, "tile", *others, "tile_b", F.col("members").alias("a"), F.when(~itself, F.col("b")).alias("b"),
    ).repartition(*COUNTS, "tile", *others, "tile_b").select("a", "b")

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                first = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                second = b.values.to_numpy(zero_copy_only=False).view(np.uint64) if b.is_valid else None
                left, right = forest(first, second, radius)
                pair = [pa.array(np.array(side, dtype=np.uint64).view(np.int64)) for side in (left, right)]
                yield pa.RecordBatch.from_arrays(pair, ["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def _groups(nodes: DataFrame, radius: int, tile: int) -> DataFrame:
    """Distinct fingerprints (and what else the frame has) with ``root``, the fingerprint that names their group."""
    stars = connected_components(near_links(nodes.select("simhash"), radius, tile))
    return nodes.join(stars, F.col("simhash") == F.col("node"), "left").select(*nodes.columns, F.coalesce("root", "simhash").alias("root"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
    radius: int = RADIUS, tile: int = TILE,
) -> DataFrame:
    """(doc_id, simhash, component_id) for each row of the frame.

    ``component_id`` is the smallest id among all that links of at most ``radius`` differing bits
    reach, the row's own included. Equal fingerprints are one node, so exact copies and texts without
    words (fingerprint zero) cost one comparison. Repeated rows come out repeated. A row with a null
    id is linked as any other and names no component; where all ids are null so is the component's.
    An empty table gives an empty table; other columns are not read. Runs jobs when called.
    """
    named = df.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    found = written(fingerprints(named, "text", words).drop("text"), "simhash")
    nodes = found.groupBy("simhash").agg(F.min("doc_id").alias("least"))
    labels = _groups(nodes, radius, tile)
    named = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labels.join(named, "root").select("simhash", "component_id")
    return found.join(labels, "simhash").select("doc_id", "simhash", "component_id")


def hex_digits(simhash: str = "simhash"):
    """Sixteen lower-case hex digits."""
    return F.lpad(F.lower(F.hex(simhash)), 16, "0")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, as it came: the one with the smallest id, null ids after all others.

    Of rows of one id, and of rows without one, it is the first in a numbering of the rows. So no group vanishes and
    none keeps two rows, whatever ids are repeated or null.
    """
    key = fresh(df, "row_key")
    rows = with_key(df, key)
    named = rows.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(key).alias("key"))
    found = written(fingerprints(named, "text", words).drop("text"), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key"))
    nodes = found.groupBy("simhash").agg(first.alias("least"))
    labels = _groups(nodes, radius, TILE)
    kept = labels.groupBy("root").agg(F.min("least").alias("first")).select("root", F.col("first.key").alias("kept"))
    labels = labels.join(kept, "root").select("simhash", "kept")
    # Written, so that Spark knows how many they are.
    gone = written(found.join(labels, "simhash").filter("key <> kept").select(F.col("key").alias("gone")), "near-copies")
    return rows.join(gone, quoted(key) == gone["gone"], "left_anti").drop(key)
