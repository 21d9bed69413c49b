"""The pipeline against plain restatements of its stages, and the entry point with and without this part."""

import hashlib
import itertools
import subprocess
import sys
from pathlib import Path

import numpy as np
import plain_toxicity
from pyspark.sql import functions as F
from test_documents import plain_components, plain_lines, plain_matches, plain_simhash

import __spark_entry__ as spark_entry
import corpus_pipeline
from corpus_spark.llm import byte_bpe

REPO = Path(__file__).resolve().parents[2]


def plain_run(spark, folder):
    read = spark.read.parquet(f"{folder}/documents.parquet")
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    every = [(r.doc_id, r.text) for r in read.collect()]
    scores = plain_toxicity.scores(every, labels, [text for _, text in every])
    rows = [row for row, score in zip(every, scores) if score < 0.7]
    toxic = len(every) - len(rows)
    lines = plain_lines(rows, 40, 5)
    rows = [(doc, kept) for doc, _, _, kept in lines]
    values = {doc: plain_simhash(text) for doc, text in rows}
    links = [(a, b) for a, b in itertools.combinations(values, 2) if (values[a] ^ values[b]).bit_count() <= 2]
    label = plain_components(list(values), links)
    single = [(doc, text) for doc, text in rows if label[doc] == doc]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {doc for doc, _, n_hit, _ in plain_matches(single, items, 10) if n_hit}
    kept = [(doc, text) for doc, text in single if doc not in hit]
    # Each stage has something to do on these tables.
    assert toxic and sum(n for _, _, n, _ in lines) and len(single) < len(rows) and hit and kept
    encoding = byte_bpe.load_encoding(byte_bpe.VOCABULARY)
    found = []
    for doc, text in kept:
        ids = np.array(encoding.encode_ordinary(text), dtype="<u4")
        found.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found)


def test_pipeline_equals_plain(spark, small_dir):
    folder = small_dir.replace("sf0.001", "sf0.01")
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == plain_run(spark, folder)


def test_stages_keep_the_columns(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, small_dir)
        assert found.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), small_dir).count() == 0


def test_stages_take_nulls(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x " * 50, "en", "s", 1), (10**9, None, None, None, None), (10**9, None, None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, odd, small_dir).collect()
        # Those without words are one group of near copies.
        assert len(found) == (2 if name == "simhash_near_dedup" else 4), name
    assert {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.STAGES[1][1](spark, odd, small_dir).collect()} == {(None, None, None), (None, "x " * 50, 1), (10**9, None, None)}


def test_stages_take_columns_of_any_name(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(40)
    names = ["row", "id", "of", "kept_text", "N_lines", "dropped", "row_key", "gone", "text_key", "own_key", "difference", "simhash", "block", "__toxicity", "key", "spans", "version"]
    wide = docs.select("*", *[F.lit(place).alias(name) for place, name in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, wide, small_dir)
        assert found.dtypes == wide.dtypes, name
        kept = {r.doc_id for r in stage(spark, docs, small_dir).collect()}
        rows = found.collect()
        assert {r.doc_id for r in rows} == kept and all([r[each] for each in names] == list(range(len(names))) for r in rows), name


def test_every_operator_is_registered():
    names = [name for name in spark_entry.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert spark_entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_the_rest_does_without_this_part(tmp_path):
    for path in REPO.rglob("*.py"):
        inside = path.relative_to(REPO)
        if "llm" not in inside.parts and inside.name != "corpus_pipeline.py":
            (tmp_path / inside).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / inside).write_text(path.read_text())
    code = "import __spark_entry__ as e; assert 'clean_source' in e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
