"""Line, near-copy, benchmark and toxicity operators against plain restatements."""

import datetime
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import plain_toxicity
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import check_queries
from corpus_spark.llm import components, decontaminate, line_dedup, simhash, toxicity
from corpus_spark.llm.arrow import map_arrow
from corpus_spark.llm.queries import STATEMENTS, op2_benchmark_decontamination, op4_simhash_near_dedup, op10_toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Lines


def plain_lines(rows, min_chars, min_documents):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(doc)
    found = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if doc is None or len(holders.get(key(line), ())) < min_documents or max(holders[key(line)]) == doc
        ]
        found.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return found


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_equals_plain(spark, batches, fanout):
    rng = random.Random(batches)
    pool = ["Ünïque line", " Ünïque line\t", "ÜNïQUE LINE", "short", "", "another much longer line", "x" * 200, "ｗｉｄｅ ｃｈａｒｓ"]
    rows = [(doc, "\n".join(rng.choice(pool) + rng.choice(["", "", "1"]) for _ in range(rng.randrange(6)))) for doc in range(-5, 40)]
    rows += [(3, rows[0][1]), (3, rows[0][1]), (None, "another much longer line\nshort"), (41, None), (42, "")]
    df = spark.createDataFrame([(*row, 9) for row in rows], "doc_id long, text string, N_lines int")
    found = line_dedup.dedup_lines(df, min_chars=9, min_documents=3, batches=batches, fanout=fanout)
    assert found.columns == ["doc_id", "text", "kept_text", "n_lines", "n_dropped"]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(plain_lines(rows, 9, 3), key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind,ids", [
    ("string", ["b", "a", "é", "", "zz"]), ("long", [-(2**63), 2**63 - 1, 0, -1, 5]), ("date", [datetime.date(2000, 1, day) for day in range(1, 6)]),
])
def test_line_dedup_takes_ids_of_any_order(spark, kind, ids):
    rows = [(doc, f"some shared line\nown line {place}") for place, doc in enumerate(ids)] + [(None, "some shared line")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, f"doc_id {kind}, text string"), min_chars=9, min_documents=3, batches=3)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()), key=repr) == sorted(plain_lines(rows, 9, 3), key=repr)


# SimHash


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_equal_plain(spark):
    rng = random.Random(1)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(40)]
    links += [(500, 600 + i) for i in range(30)] + [(7, 7)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = plain_components({x for link in links for x in link}, links)
    assert sorted(map(tuple, found)) == sorted((node, want[node]) for node in linked)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_links_connect_what_brute_force_connects(spark, radius):
    rng = random.Random(radius)
    values = set()
    for _ in range(25):
        value = rng.getrandbits(64)
        for _ in range(12):
            values.add(value)
            value ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    values |= {0, 1, (1 << 64) - 1}
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    got = [tuple(r) for r in simhash.near_links(spark.createDataFrame(signed, "simhash long"), radius, tile=20).collect()]
    mask = (1 << 64) - 1
    assert all(0 < ((a & mask) ^ (b & mask)).bit_count() <= radius for a, b in got)
    ids = [v[0] for v in signed]
    near = [(a, b) for a, b in itertools.combinations(ids, 2) if ((a & mask) ^ (b & mask)).bit_count() <= radius]
    assert plain_components(ids, got) == plain_components(ids, near)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a b c d"), (7, "A b\tc  d"), (7, "a b c d"), (8, "é É"), (8, "é É"), (None, "solo")]
    df = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.simhash & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = {5: 3, 3: 3, 9: 3, 7: 7, 8: 8}
    assert {(doc, component) for doc, _, component in got if doc} == set(want.items())
    assert {value for _, value, _ in got} == {plain_simhash(text) for _, text in rows}
    assert (None, plain_simhash("a b c d"), 7) in got and (None, plain_simhash("solo"), None) in got
    # One of each group: of those without words, of the four words, of the two letters, and the row alone.
    assert sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(df).collect()) == [(0, "solo"), (3, ""), (7, "A b\tc  d"), (8, "é É")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_goes_by_rows(spark):
    a, b = "one text of some words", "quite another text with others"
    rows = [(1, a), (5, a), (5, b), (9, b), (None, b), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame([(*row, "x", 7) for row in rows], "doc_id long, text string, row_key string, gone int")
    found = simhash.one_of_each(df)
    assert found.dtypes == df.dtypes
    assert sorted((r.doc_id or 0, r.text) for r in found.collect()) == [(0, "alone"), (1, a), (5, b)]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_simhash_query_equals_brute_force(spark, small_dir):
    read = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    values = {doc: plain_simhash(text) for doc, text in read.items()}
    links = [(a, b) for a, b in itertools.combinations(values, 2) if (values[a] ^ values[b]).bit_count() <= 2]
    label = plain_components(read, links)
    got = sorted(map(tuple, op4_simhash_near_dedup(spark, small_dir).collect()))
    assert got == sorted((doc, f"{values[doc]:016x}", label[doc]) for doc in read)


# Benchmark passages


def plain_matches(rows, items, window):
    found = []
    for doc, text in rows:
        words, hit, ids = WORD.findall(lower(text)), set(), set()
        for item, passage in items:
            other = WORD.findall(lower(passage))
            if not other:
                continue
            for start in range(max(1, len(other) - window + 1)):
                part = other[start : start + window]
                for place in range(len(words) - len(part) + 1):
                    if words[place : place + len(part)] == part:
                        hit.update(range(place, place + len(part)))
                        ids.add(None if item is None else str(item))
        found.append((doc, len(words), len(hit), sorted(ids, key=lambda item: (item is None, item or ""))))
    return sorted(found, key=repr)


@pytest.mark.parametrize("most,block_bytes", [(5, 60), (1 << 17, 1 << 22)])
def test_matches_equal_plain(spark, monkeypatch, most, block_bytes):
    monkeypatch.setattr(decontaminate, "_PIECE", 7)
    monkeypatch.setattr(decontaminate.build_index, "__defaults__", ("doc_id", "text", block_bytes))
    rng = random.Random(most)
    draw = lambda n: " ".join(rng.choice(["the", "of", "É1", "x", "a-b", "\n", "ß"]) for _ in range(n))
    rows = [(doc % 30, draw(rng.randrange(60))) for doc in range(40)] + [(None, draw(30)), (50, None), (51, "")]
    items = [(i, draw(rng.randrange(1, 14))) for i in range(12)] + [(2, draw(5)), (90, None), (91, " ! "), (None, "the of"), (92, "zz the")]
    documents = spark.createDataFrame([(*row, 0) for row in rows], "doc_id long, text string, n_words int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(documents, benchmark, window=4, most=most)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()]
    assert sorted(got, key=repr) == plain_matches(rows, items, 4)
    for r in found.collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_hit
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert decontaminate.matches(documents.limit(0), benchmark, window=4).count() == 0
    assert {r.n_hit for r in decontaminate.matches(documents, benchmark.limit(0), window=4).collect()} == {0}


def test_items_without_an_id_count(spark, tmp_path):
    documents = [(1, "one two three four five six")]
    items = [(None, "two three four"), ("b", "five"), (None, "never")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = op2_benchmark_decontamination(spark, str(tmp_path)).first()
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = connection.sql(STATEMENTS["op2_benchmark_decontamination"])
    assert dict(zip(found.columns, found.fetchall()[0])) == row.asDict()
    assert (row.n_hit, row.n_items, row.items_sha256) == (4, 2, hashlib.sha256(b"b").hexdigest())


def test_rows_are_dropped_one_by_one(spark):
    rows = [(1, "some words of the test item here"), (1, "clean"), (None, "some words of the test item here"), (None, "clean too"), (2, None)]
    df = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, row_key string")
    found = decontaminate.without_matches(df, spark.createDataFrame([("i", "words of the test item")], "item_id string, text string"))
    assert found.dtypes == df.dtypes and sorted((r.doc_id or 0, r.text or "") for r in found.collect()) == [(0, "clean too"), (1, "clean"), (2, "")]


def test_rows_of_one_item_spread_over_passes(spark, monkeypatch):
    asked = []

    def pmod(*args, real=decontaminate.F.pmod):
        asked.append(args)
        assert len(asked) < 20, "the deals double without an end"
        return real(*args)

    monkeypatch.setattr(decontaminate.F, "pmod", pmod)
    monkeypatch.setattr(decontaminate, "_PIECE", 7)
    items = [(1, f"a{i} b{i} c{i} d{i}") for i in range(60)] + [(1, "a0 b0 c0 d0")] * 60
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    queries = list(decontaminate.query_blocks(benchmark, "item_id", "text", 4, most=60))
    assert len(queries) > 1 and sum(len(query.windows) for query in queries) == 60
    documents = [(i, f"x a{i} b{i} c{i} d{i} y") for i in range(61)]
    found = decontaminate.matches(spark.createDataFrame(documents, "doc_id long, text string"), benchmark, window=4, most=60).collect()
    assert {r.doc_id: (r.n_hit, list(r["items"])) for r in found} == {i: (4, ["1"]) if i < 60 else (0, []) for i in range(61)}


def test_proximity(spark):
    documents = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha " + "x " * 9 + "beta"), (4, "alpha"), (5, "beta")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    found = decontaminate.matches(documents, benchmark, reach=3).filter("n_hit > 0")
    assert sorted(r.doc_id for r in found.collect()) == [1, 2]


# Toxicity


def test_toxicity_finds_held_out_documents(spark, small_dir):
    folder = small_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op10_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.7)
    held = [row for row in rows if row.held_out and row.doc_id in truth]
    toxic = [row.score for row in held if truth[row.doc_id]]
    ordinary = [row.score for row in held if not truth[row.doc_id]]
    above = np.mean([[a > b or (a == b) / 2 for b in ordinary] for a in toxic])
    assert above > 0.85
    assert sum(row.predicted for row in held if not truth[row.doc_id]) <= 1


def scored(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.toxicity for r in toxicity.toxicity(rows, model).orderBy("i").collect()]


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.sample(pool, 20), "rotten" if i % 4 == 0 else "fine", *rng.sample(pool, 5)])) for i in range(400)]
    # Words of copies have one context each, however many documents are labelled.
    rows += [(i, "copied words of one page") for i in range(400, 600)]
    labels = [(i, int(i % 4 == 0 and i < 400)) for i in range(600)] + [(0, None), (9999, 1), (None, 1), (4, 1)]
    odd = [(1000, None), (1001, ""), (1001, ""), (None, "rotten " * 5000), (1002, "—"), (1003, "unseen rotten words")]
    documents = spark.createDataFrame([(*row, "x", 1, 2) for row in rows + odd], "doc_id long, text string, Toxicity string, text_key int, difference int")
    model = toxicity.fit(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = toxicity.toxicity(documents, model)
    assert found.columns == ["doc_id", "text", "text_key", "difference", "toxicity"]
    assert found.count() == len(rows + odd)
    scores = {(r.doc_id, (r.text or "")[:9]): r.toxicity for r in found.collect()}
    assert scores[1000, ""] == scores[1001, ""] == scores[1002, "—"]
    assert scores[None, "rotten ro"] >= scores[1003, "unseen ro"] > 0.7 > scores[1000, ""]
    assert all(r.toxicity > 0.7 for r in found.filter("text LIKE '%rotten%'").collect())
    assert all(r.toxicity == scores[1000, ""] for r in found.filter("text LIKE 'copied%'").collect())
    want = plain_toxicity.scores(rows + odd, labels, [r.text for r in found.collect()])
    assert max(abs(r.toxicity - w) for r, w in zip(found.collect(), want)) < 1e-6
    kept = toxicity.without_toxic(documents, model)
    assert kept.dtypes == documents.dtypes and kept.count() == found.filter("toxicity < 0.7").count()
    # A low threshold drops texts that say nothing.
    assert toxicity.without_toxic(documents, model, threshold=1e-9).count() == found.filter("toxicity < 1e-9").count()
    none = toxicity.fit(documents, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxicity for r in toxicity.toxicity(documents, none).collect()} == {0.5}
    assert toxicity.without_toxic(documents, none).count() == documents.count()
    assert toxicity.toxicity(documents.limit(0), model).count() == 0


def test_toxicity_learns_pairs_of_harmless_words(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(900):
        middle = ["get", "lost"] if i % 3 == 0 else rng.choice([["get", "home"], ["we", "lost"], ["lost", "get"]])
        rows.append((i, " ".join([*rng.sample(pool, 10), *middle, *rng.sample(pool, 5)])))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    scored = toxicity.toxicity(documents, toxicity.fit(documents, labels)).collect()
    assert all((r.toxicity > 0.7) == (r.doc_id % 3 == 0) for r in scored)


@pytest.mark.parametrize("name", ["op2_benchmark_decontamination", "op9_line_dedup"])
def test_query_equals_sql(spark, small_dir, name):
    good, note = check_queries.compare(spark, check_queries.connect(small_dir), small_dir, name)
    assert good, note


def test_toxicity_counts_both_folds_that_may_be_learnt_from(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(60)]
    number = lambda doc: zlib.crc32(str(doc).encode()) % 3
    rows = []
    for i in range(1200):
        # "rotten" is said in fold 0, "vile" in fold 2 only.
        insult = {0: "rotten", 2: "vile"}.get(number(i), "fine") if i % 4 == 0 else "fine"
        rows.append((i, " ".join([*rng.sample(pool, 20), insult, *rng.sample(pool, 5)])))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200) if number(i) != 1], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    nothing, rotten, vile = scored(spark, model, [None, "a rotten thing", "a vile thing"])
    assert rotten > nothing and vile > nothing


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_toxicity_equals_plain(spark, small_dir, monkeypatch, scale):
    folder = small_dir.replace("sf0.001", scale)
    monkeypatch.setattr(toxicity, "COUNTED_BYTES", 50_000)
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    want = dict(zip((doc for doc, _ in documents), plain_toxicity.scores(documents, labels, [text for _, text in documents])))
    got = {r.doc_id: r.score for r in op10_toxicity(spark, folder).collect()}
    assert got.keys() == want.keys() and max(abs(got[doc] - want[doc]) for doc in want) < 1e-6


def test_expressions_are_counted_with_the_words_of_one_document_in_memory(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.randrange(10**6):x}" for _ in range(350)) for _ in range(1000)]
    runs = []
    monkeypatch.setattr(toxicity, "map_arrow", lambda df, run, schema: runs.append(run) or map_arrow(df, run, schema))
    toxicity.expression_counts(spark.createDataFrame([], "text string, toxic boolean, number int"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([True] * 1000), pa.array([0] * 1000, pa.int32())], ["text", "toxic", "number"])
    tracemalloc.start()
    try:
        assert sum(found.num_rows for found in runs[0](iter([batch]))) > 350_000
        # Keys take 38 MB here, the words and pairs of all documents took 121.
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("n", [0, 1, 3000, 70_000])
def test_bitmaps_have_every_key(spark, tmp_path, n):
    spark.range(n).select(F.xxhash64("id").alias("key")).write.parquet(f"{tmp_path}/keys")
    bitmap = toxicity.Bitmap(spark.read.schema("key long").parquet(f"{tmp_path}/keys"))
    keys = np.array([r.key for r in spark.read.schema("key long").parquet(f"{tmp_path}/keys").collect()], np.int64)
    assert bitmap.may_have(keys).all() and (1 << bitmap.bits) >= 16 * n
    others = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    assert bitmap.may_have(others).mean() < 0.1


def test_rows_that_no_key_asks_for_are_left_out(spark, tmp_path):
    spark.range(0, 9000, 3).select(F.concat(F.lit("k"), "id").alias("id")).write.parquet(f"{tmp_path}/keys")
    keys = spark.read.schema("id string").parquet(f"{tmp_path}/keys")
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("of"), F.lit("t").alias("text"))
    found = {r.of for r in toxicity.maybe_among(rows, "of", keys, "id").collect()}
    assert {f"k{n}" for n in range(0, 9000, 3)} <= found and len(found) < 3000 + 0.1 * 17_000
    assert toxicity.maybe_among(rows, "of", keys.limit(0), "id").count() == 0
