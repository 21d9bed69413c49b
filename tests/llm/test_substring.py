"""Removal of shared passages against a plain restatement."""

import hashlib
import random
import re

import check_queries
import pytest

from corpus_spark.llm import substring_dedup
from corpus_spark.llm.queries import op3_substring_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_units(text, min_words, reach):
    """(start, stop, words) of the units of a text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    hashes = [hashlib.md5(word.encode()).hexdigest()[:16] for word in words]
    content = {0, len(words)} | {i for i, h in enumerate(hashes) if h == min(hashes[max(0, i - reach) : i + reach + 1])}
    lines = {len(re.findall(r"[^\x20\x09-\x0D]+", text[:at])) for at in [0, len(text), *(m.end() for m in re.finditer("\n", text))]}
    found = set()
    for places in (content, lines):
        for start in places:
            stops = [stop for stop in places if stop >= start + min_words]
            if stops:
                found.add((start, min(stops)))
    return sorted((start, stop, tuple(words[start:stop])) for start, stop in found)


def stretches(places, least):
    found = []
    for place in sorted(places):
        if found and found[-1][1] == place:
            found[-1][1] += 1
        else:
            found.append([place, place + 1])
    return [(start, stop) for start, stop in found if stop - start >= least]


def plain(rows, min_words, min_passage, reach):
    """(doc_id, n_words, n_shared, n_removed, removed, kept) of each row, for ids with one text each."""
    texts = {doc: text for doc, text in rows if doc is not None and text is not None}
    holders = {}
    for doc, text in texts.items():
        for start, stop, words in plain_units(text, min_words, reach):
            holders.setdefault(words, []).append((doc, start, stop))
    shared, gone = {}, {}
    for words, places in holders.items():
        if len(places) > 1:
            first = min(places)
            for doc, start, stop in places:
                shared.setdefault(doc, set()).update(range(start, stop))
                gone.setdefault(doc, set()).update(range(max(start, first[2]) if doc == first[0] else start, stop))
    found = []
    for doc, text in rows:
        text = text or ""
        begins = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
        own = stretches(gone.get(doc, ()) if doc is not None else (), min_passage)
        removed = [(begins[start], begins[stop]) for start, stop in own]
        kept = "".join(c for at, c in enumerate(text) if not any(a <= at < b for a, b in removed))
        n_shared = sum(b - a for a, b in stretches(shared.get(doc, ()) if doc is not None else (), min_passage))
        found.append((doc, len(begins) - 1, n_shared, sum(b - a for a, b in own), removed, kept))
    return sorted(found, key=repr)


def result(found):
    return sorted(((r.doc_id, r.n_words, r.n_shared, r.n_removed, [tuple(s) for s in r.removed], r.kept_text) for r in found.collect()), key=repr)


@pytest.mark.parametrize("min_words,min_passage,reach", [(3, 3, 1), (4, 7, 2), (5, 6, 3)])
def test_units_equal_plain(spark, min_words, min_passage, reach):
    rng = random.Random(reach)
    pool = ["A", "b", "é", "É", "x", "y1", "zz", "w", "q", "r"]
    passages = [" ".join(rng.choice(pool) for _ in range(rng.randrange(6, 16))) for _ in range(6)]

    def text():
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(5))]
        return rng.choice(["", " ", "\n"]) + "".join(part + rng.choice([" ", "\n", "  \n", "\t"]) for part in parts)

    rows = [(doc, text()) for doc in range(40)]
    rows += [(None, passages[0]), (50, None), (51, ""), (52, " \n "), (53, "q " * 400), (54, "Q\n" * 300), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame([(*row, 1, 2, 3) for row in rows], "doc_id long, text string, Removed int, of int, version int")
    found = substring_dedup.dedup_units(df, min_words=min_words, min_passage=min_passage, reach=reach)
    assert found.columns == ["doc_id", "text", "of", "version", "kept_text", "n_words", "n_shared", "n_removed", "removed"]
    want = plain(rows, min_words, min_passage, reach)
    assert result(found) == want and any(row[3] for row in want)
    assert substring_dedup.dedup_units(df.limit(0)).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [("b", f"one {passage}"), ("b", f"{passage} two\nthree"), ("a", passage), ("c", "other words")]
    found = substring_dedup.dedup_units(spark.createDataFrame(rows, "doc_id string, text string"), min_words=5, min_passage=30).collect()
    kept = sorted((r.doc_id, r.kept_text) for r in found)
    assert [k for k in kept if k[0] in "ac"] == [("a", passage), ("c", "other words")]
    assert all(len(text) < 60 for doc, text in kept if doc == "b") and any("two\nthree" in text for _, text in kept)


def test_passages_inside_and_across_lines_go(spark, small_dir):
    """Of the words of 50-word passages that stand earlier, nine tenths and more go, and every such document loses some."""
    folder = small_dir.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    seen, repeated = {}, {}
    for doc in sorted(texts):
        words = lower(texts[doc]).split()
        for at in range(len(words) - 49):
            if seen.setdefault(tuple(words[at : at + 50]), (doc, at)) != (doc, at):
                repeated.setdefault(doc, set()).update(range(at, at + 50))
    removed = {r.doc_id: r for r in op3_substring_dedup(spark, folder).collect()}
    caught = 0
    for doc, places in repeated.items():
        assert removed[doc].n_removed > 0
        begins = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[doc])]
        spans = [tuple(map(int, span.split("-"))) for span in removed[doc].removed.split(",")]
        caught += sum(any(a <= begins[place] < b for a, b in spans) for place in places)
    assert caught >= 0.9 * sum(map(len, repeated.values())) > 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, small_dir, scale):
    folder = small_dir.replace("sf0.001", scale)
    good, note = check_queries.compare(spark, check_queries.connect(folder), folder, "op3_substring_dedup")
    assert good, note


def test_slices_change_nothing(spark, small_dir, monkeypatch):
    want = sorted(map(tuple, op3_substring_dedup(spark, small_dir).collect()))
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 20_000)
    assert sorted(map(tuple, op3_substring_dedup(spark, small_dir).collect())) == want
