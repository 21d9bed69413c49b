"""Tokens of two tokenizers laid against each other by the bytes they cover.

Both id lists of a text cover the same bytes. The cumulative ends of each list go into a dictionary
from end to index; the ends that both dictionaries have are intersected as hash sets, and their sorted
order slices both id lists into groups. Inside a slice every pair of tokens whose bytes overlap is a
link. Links are counted over the whole corpus per pair of ids, and every document learns what its own
links count.

The second tokenizer puts a space before a text, so the first one is given a space and the text. Both
have a token end wherever a character that is not white space stands before a space or a line feed: the
first one's pattern never joins the two, and no entry of the second one's vocabulary has a space after
another character, or a line feed. So each stretch between such places is aligned by itself and
remembered, and long texts are worked on part by part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_spark.llm.arrow import add_columns, map_arrow, one_list, packed, slices, unpacked
from corpus_spark.llm.scratch import written
from corpus_spark.llm.token_counts import byte_letters

BYTES_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE_MARK = "▁"
# Stretches, and an eighth of their links, that a Python worker remembers before it starts anew with the next slice.
KNOWN = 400_000
# A text is worked on in parts of about this many characters, cut where both tokenizers end a token.
PART_CHARS = 1 << 16
# Characters that are white space to no library, whatever its tables.
SOLID = r"[^\s\x1c-\x1f\x85\u180e\u200b]"
AFTER = r"(?= +[^ ]|\n)"
SEAM = re.compile(SOLID + AFTER)
IS_SOLID = re.compile(SOLID).match
STRETCH = re.compile(rf"(?:{SOLID.replace('^', '', 1)}*+{SOLID}++)+?{AFTER}|(?s:.+)")
# Texts whose links are counted together.
SLICE_BYTES = 8 << 20
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Numbers stretches when first met and remembers how they are aligned.

    ``shown`` has the groups of each stretch, with a semicolon after each; ``sizes`` its tokens of both
    tokenizers and its groups; ``pairs``, from one of ``starts`` to the next, its pairs of ids that overlap, a
    number each. ``lost`` says which ones a tokenizer does not give back byte by byte.
    """

    def __init__(self, path_a: str = BYTES_VOCABULARY, path_b: str = PIECES_VOCABULARY, part_chars: int = PART_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.part_chars = max(1, part_chars)
        self.forget()
        of_letter = {letter: byte for byte, letter in byte_letters().items()}
        tokens = self.library.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(tokens.values()) + 1)
        for token, number in tokens.items():
            known = all(letter in of_letter for letter in token)
            self.bytes_a[number] = bytes(map(of_letter.__getitem__, token)) if known else token.encode()
        self.bytes_b = [self._piece(number) for number in range(self.processor.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, each), np.int64, len(each)) for each in (self.bytes_a, self.bytes_b))

        self.inner_a, self.last_a = (_with(len(self.bytes_a), mark) for mark in ",|")
        self.inner_b, self.last_b = (_with(len(self.bytes_b), mark) for mark in ",;")

    def _piece(self, number: int) -> bytes:
        piece = self.processor.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.processor.is_byte(number) else piece.replace(SPACE_MARK, " ").encode()

    def forget(self) -> None:
        self.known = defaultdict(count().__next__)
        self.shown: list[str] = []
        self.sizes = np.zeros((0, 3), dtype=np.int64)
        self.starts = np.zeros(1, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.lost = np.zeros(0, dtype=bool)

    def numbers(self, text: str | None) -> np.ndarray:
        """The stretches of a whole text. ``learn`` has to follow before they are looked up."""
        text, start, found = " " + text if text else "", 0, []
        while start < len(text):
            seam = SEAM.search(text, start + self.part_chars)
            stop = seam.end() if seam else len(text)
            found.append(np.fromiter(map(self.known.__getitem__, STRETCH.findall(text[start:stop])), np.int64))
            start = stop
        return np.concatenate(found or [self.starts[:0]])

    def learn(self) -> None:
        """Align the stretches met since the last time.

        What starts with a space or a line feed and ends solid is encoded alike alone and in a row with others.
        """
        new = list(islice(self.known, len(self.shown), None))
        rows, held = [], 0
        for each in new:
            alone = each[0] not in " \n" or not IS_SOLID(each[-1])
            if not rows or alone or held + len(each) > self.part_chars:
                rows.append([])
                held = 0
            rows[-1].append(each)
            held = self.part_chars if alone else held + len(each)
        found = [self._aligned(row) or [self._aligned([each]) or _LOST for each in row] for row in rows]
        found = [one for row in found for one in (row if isinstance(row, list) else [row])]
        if not found:
            return
        shown, sizes, pairs, n_pairs, lost = zip(*found)
        self.shown += chain.from_iterable(shown)
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.pairs = np.concatenate([self.pairs, *pairs])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(n_pairs))])
        self.lost = np.concatenate([self.lost, *lost])

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of ids that the stretches link, the place of the stretch in the list, and the pair."""
        sizes = np.diff(self.starts)[numbers]
        owner = np.repeat(np.arange(len(numbers)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return owner, self.pairs[self.starts[numbers][owner] + inside]

    def _aligned(self, stretches: list[str]) -> tuple | None:
        """What is known of the stretches, aligned in a row; None where a tokenizer does not give all bytes back."""
        text = "".join(stretches)
        a = self.library.encode(text, add_special_tokens=False).ids
        # The mark that the second tokenizer puts first stands for a space, or stands before a line feed and goes.
        b = self.processor.encode(text[1:]) if text[0] == " " else self.processor.encode(text)[1:]
        raw = text.encode()
        if any(b"".join(map(table.__getitem__, ids)) != raw for ids, table in ((a, self.bytes_a), (b, self.bytes_b))):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        index_a, index_b = dict(zip(ends_a.tolist(), count(1))), dict(zip(ends_b.tolist(), count(1)))
        common = sorted(index_a.keys() & index_b.keys())
        cuts_a, cuts_b = (np.fromiter(map(index.__getitem__, common), np.int64, len(common)) for index in (index_a, index_b))
        # Inside a slice, between two neighbouring ends of either list, lies exactly one token of each.
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] * len(self.sizes_b) + b[np.searchsorted(ends_b, ends)]
        # A token comes after the other list's tokens of earlier slices; in a slice the first list leads.
        sizes_a, sizes_b = (np.diff(cuts, prepend=0) for cuts in (cuts_a, cuts_b))
        shown = np.empty(len(a) + len(b), dtype=object)
        texts_a, texts_b = self.inner_a[a], self.inner_b[b]
        texts_a[cuts_a - 1], texts_b[cuts_b - 1] = self.last_a[a[cuts_a - 1]], self.last_b[b[cuts_b - 1]]
        shown[np.arange(len(a)) + np.repeat(cuts_b - sizes_b, sizes_a)] = texts_a
        shown[np.arange(len(b)) + np.repeat(cuts_a, sizes_b)] = texts_b
        stops = np.cumsum([len(each.encode()) for each in stretches])
        upto = [np.searchsorted(each, stops, "right") for each in (ends_a, ends_b, np.array(common), ends)]
        places = [0, *np.cumsum([len(each) for each in shown.tolist()])[upto[0] + upto[1] - 1].tolist()]
        joined = "".join(shown.tolist())
        return (
            [joined[start:stop] for start, stop in zip(places, places[1:])],
            np.diff(np.stack(upto[:3], axis=1), axis=0, prepend=0), pairs, np.diff(upto[3], prepend=0), np.zeros(len(stretches), dtype=bool),
        )

    def groups(self, text: str | None) -> str:
        """``a1,a2|b1;a3|b2,b3`` of a whole text."""
        numbers = self.numbers(text)
        self.learn()
        return "" if self.lost[numbers].any() else "".join(map(self.shown.__getitem__, numbers.tolist()))[:-1]

    def digest(self, numbers: np.ndarray) -> str:
        """SHA-256 of the groups of these stretches, put together piece by piece."""
        digest = hashlib.sha256()
        for start in range(0, len(numbers), self.part_chars):
            shown = "".join(map(self.shown.__getitem__, numbers[start : start + self.part_chars].tolist()))
            digest.update((shown[:-1] if start + self.part_chars >= len(numbers) else shown).encode())
        return digest.hexdigest() if len(numbers) else ""


# What is known of a stretch that a tokenizer does not give back.
_LOST = ([""], np.zeros((1, 3), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), np.ones(1, dtype=bool))


def _with(size: int, mark: str) -> np.ndarray:
    return np.array([f"{number}{mark}" for number in range(size)], dtype=object)


@lru_cache(maxsize=2)
def aligner_of(path_a: str, path_b: str, part_chars: int) -> Aligner:
    """One aligner per Python worker, so that tasks after the first one know its stretches."""
    return Aligner(path_a, path_b, part_chars)


def align(
    df: DataFrame, text: str = "text", path_a: str = BYTES_VOCABULARY, path_b: str = PIECES_VOCABULARY, part_chars: int = PART_CHARS,
) -> DataFrame:
    """The frame with ``groups``: the ids of both tokenizers between places where both end a token.

    ``a1,a2|b1;a3|b2,b3`` in decimal. Empty for a text that is null or empty or that a tokenizer does not
    give back byte by byte. Rows are worked on one by one; repeated rows come out repeated, an empty
    table gives an empty table. A column already named as the new one is replaced, others pass through.
    """

    def make():
        aligner = aligner_of(path_a, path_b, part_chars)
        return lambda texts: {"groups": list(map(aligner.groups, texts))}

    return add_columns(df, text, "groups string", make)


def linked_slices(df: DataFrame, doc_id: str, text: str, path_a: str, path_b: str, part_chars: int) -> DataFrame:
    """One row per slice of documents: what is known of each, which pairs of ids it links and how often.

    ``pairs`` are the slice's distinct pairs in order and ``totals`` their links; ``n_entries`` says how
    many distinct pairs each document has, ``places`` (steps between the pairs' places) and ``times``
    what they are. Written to the shared folder.
    """
    named = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = named.schema["doc_id"].dataType.simpleString()
    schema = (
        f"slice long, docs array<struct<doc_id:{id_type},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>, "
        "n_entries array<int>, places binary, times binary, pairs array<bigint>, totals array<bigint>"
    )

    def run(batches):
        aligner = aligner_of(path_a, path_b, part_chars)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES):
                yield _slice(aligner, rows, number)
                number += 1

    return written(map_arrow(named, run, schema), "linked-slices")


def _slice(aligner: Aligner, rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
    if len(aligner.shown) > KNOWN or len(aligner.pairs) > 8 * KNOWN:
        aligner.forget()
    found = [aligner.numbers(text) for text in rows.column(1).to_pylist()]
    aligner.learn()
    found = [each[:0] if aligner.lost[each].any() else each for each in found]
    digests = list(map(aligner.digest, found))
    numbers = np.concatenate([aligner.starts[:0], *found])
    owner = np.repeat(np.arange(len(found)), list(map(len, found)))
    n_a, n_b, n_groups = (np.bincount(owner, weights=size, minlength=len(found)).astype(np.int64) for size in aligner.sizes[numbers].T)
    counts = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups}
    # Each distinct stretch of a document is looked up once.
    known = max(1, len(aligner.shown))
    once, repeats = np.unique(owner * known + numbers, return_counts=True)
    owner, numbers = np.divmod(once, known)
    at, pair = aligner.links(numbers)
    owner, n = owner[at], repeats[at]
    distinct, place = np.unique(pair, return_inverse=True)
    totals = np.bincount(place, weights=n, minlength=len(distinct)).astype(np.int64)
    # Several stretches of a document may have a pair.
    entry, back = np.unique(owner * max(1, len(distinct)) + place, return_inverse=True)
    entry_times = np.bincount(back, weights=n, minlength=len(entry)).astype(np.int64)
    owner, place = np.divmod(entry, max(1, len(distinct)))
    n_entries = np.bincount(owner, minlength=len(found))
    steps = np.diff(place, prepend=0)
    starts = (np.cumsum(n_entries) - n_entries)[n_entries > 0]
    steps[starts] = place[starts]
    docs = pa.StructArray.from_arrays([rows.column(0), *map(pa.array, counts.values()), pa.array(digests, pa.string())], ["doc_id", *_COUNTS, "groups_sha256"])

    return pa.RecordBatch.from_arrays(
        [
            pa.array([number]), one_list(docs), one_list(pa.array(n_entries.astype(np.int32))), pa.array([packed(steps)], pa.binary()),
            pa.array([packed(entry_times)], pa.binary()), one_list(pa.array(distinct)), one_list(pa.array(totals)),
        ],
        ["slice", "docs", "n_entries", "places", "times", "pairs", "totals"],
    )


def pair_counts(linked: DataFrame, pieces: int) -> DataFrame:
    """(pair, n, best): the links of each pair of ids in the whole corpus, and whether no pair of the same
    second id has more. Slices bring one row per pair, so a pair that every text has is one row a slice."""
    counts = linked.select(F.inline(F.arrays_zip("pairs", "totals"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("totals").alias("n"))
    second = F.pmod("pair", F.lit(pieces))
    most = counts.groupBy(second.alias("__second")).agg(F.max("n").alias("__most"))
    return counts.join(most, second == F.col("__second")).select("pair", "n", (F.col("n") == F.col("__most")).alias("best"))


def alignment_scores(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str = BYTES_VOCABULARY, path_b: str = PIECES_VOCABULARY,
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of the frame.

    ``n_a`` and ``n_b`` are the tokens of both tokenizers, ``n_groups`` the groups between common ends and
    ``n_links`` the pairs of tokens that overlap. A pair of ids counts as often as the whole corpus links
    it: ``count_sum`` adds that up over the row's links, and ``n_best`` are its links of pairs that no pair
    of the same second id exceeds (ties are all best). The digest is of what ``align`` shows. A text
    that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens: zeros and an
    empty digest. Ids may be null, repeated and of any type; every row is counted. An empty table gives
    an empty table; other columns are not read. Runs jobs when called.

    Tables of counts are never collected or broadcast by hand: each slice of some megabytes of text asks for
    its own pairs by a join and gets its rows back sorted, so a task holds one slice.
    """
    linked = linked_slices(df, doc_id, text, path_a, path_b, part_chars)
    pieces = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    scores = pair_counts(linked, pieces)
    told = linked.select("slice", F.explode("pairs").alias("pair")).join(scores, "pair").select("slice", "pair", "n", "best")
    carried = linked.select("slice", "docs", "n_entries", "places", "times")
    both = told.withColumn("last", F.lit(False)).unionByName(carried.withColumn("last", F.lit(True)), allowMissingColumns=True)
    sorted_rows = both.repartition("slice").sortWithinPartitions("slice", "last", "pair").select("last", "n", "best", "docs", "n_entries", "places", "times")
    id_type = linked.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    fields = [("doc_id", id_type), *((name, "long") for name in _COUNTS), ("n_best", "long"), ("count_sum", "long"), ("groups_sha256", "string")]
    schema = ", ".join(f"{name} {kind}" for name, kind in fields)

    def run(batches):
        held_n, held_best = [], []
        for batch in batches:
            last = batch.column(0).to_numpy(zero_copy_only=False)
            start = 0
            for stop in [*np.flatnonzero(last).tolist(), batch.num_rows]:
                held_n.append(batch.column(1)[start:stop].to_numpy(zero_copy_only=False).astype(np.int64))
                held_best.append(batch.column(2)[start:stop].to_numpy(zero_copy_only=False).astype(bool))
                start = stop + 1
                if stop < batch.num_rows:
                    yield _scored(batch.slice(stop, 1), np.concatenate(held_n), np.concatenate(held_best))
                    held_n, held_best = [], []

    return map_arrow(sorted_rows, run, schema)


def _scored(row: pa.RecordBatch, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of one slice, from the counts of its pairs in order."""
    docs = row.column(3).flatten()
    n_entries = row.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = int(n_entries.sum())
    steps, times = (unpacked(row.column(place)[0].as_py(), size) for place in (5, 6))
    stops = np.cumsum(n_entries)
    starts = stops - n_entries
    # Steps restart with each document: what the documents before added up to goes off again.
    run = np.concatenate([[0], np.cumsum(steps)])
    place = run[1:] - np.repeat(run[starts], n_entries)

    def per_document(values):
        run = np.concatenate([[0], np.cumsum(values)])
        return pa.array(run[stops] - run[starts])

    by_name = dict(zip((field.name for field in docs.type), docs.flatten()))
    return pa.RecordBatch.from_arrays(
        [
            by_name["doc_id"], *[by_name[name] for name in _COUNTS], per_document(times * best[place]), per_document(times * n[place]),
            by_name["groups_sha256"],
        ],
        ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"],
    )
