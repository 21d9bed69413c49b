import hashlib

import pytest
from pyspark.sql import functions as F

from corpus_spark.sources import readers
from corpus_spark.operators import indexing, split


def md5(value):
    return hashlib.md5(value.encode()).hexdigest()


def held_out(keys, fraction=0.1, seed=42):
    ranked = sorted(set(keys), key=lambda key: md5(f"{seed}:{key}") if key is not None else md5(str(seed)))
    return set(ranked[:max(1, int(len(ranked) * fraction))])


@pytest.mark.parametrize("documents", [1, 2, 9, 10, 11, 19, 20, 257])
def test_document_split_is_exact_and_leak_free(spark, documents):
    keys = [f"d{place % documents}" for place in range(documents * 3)] + ["d0"] * 200
    rows = spark.createDataFrame([(key,) for key in keys], "text_id string").repartition(5)
    labels = {}
    for row in split.document_split(rows, "text_id").collect():
        labels.setdefault(row.text_id, set()).add(row.split)
    assert all(len(parts) == 1 for parts in labels.values())
    assert {key for key, parts in labels.items() if parts == {"val"}} == held_out(keys)


def test_split_does_not_depend_on_partitioning(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("id"))
    first = {tuple(row) for row in split.document_split(rows.repartition(2), "id").collect()}
    second = {tuple(row) for row in split.document_split(rows.repartition(7), "id").collect()}
    other_seed = {tuple(row) for row in split.document_split(rows, "id", seed=7).collect()}
    assert first == second != other_seed
    assert sum(label == "val" for _, label in first) == 300


def test_null_documents_are_one_document(spark):
    keys = [None, None, None, "a", "b", "c"]
    rows = spark.createDataFrame([(key,) for key in keys], "id string")
    labelled = split.document_split(rows, "id", fraction=0.5).collect()
    assert len({row.split for row in labelled if row.id is None}) == 1
    assert {row.id for row in labelled if row.split == "val"} == held_out(keys, 0.5)
    sizes = {row.split: (row.documents, row.rows) for row in split.split_sizes(split.document_split(rows, "id", fraction=0.5), "id").collect()}
    assert sum(documents for documents, _ in sizes.values()) == 4
    assert sum(count for _, count in sizes.values()) == 6


def test_documents_stay_out_of_shuffles(spark):
    rows = spark.range(100).selectExpr("id", "repeat('x', 100) AS text")
    plan = split.document_split(rows, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project") and "Join" not in plan.split("Range")[0].split("scalar-subquery")[0]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_row_split_without_a_key(spark, tmp_path, kind):
    path = str(tmp_path / "rows")
    rows = spark.range(0, 1000, 1, 5).select(F.col("id").cast("string").alias("text"))
    rows.write.parquet(path) if kind == "parquet" else rows.write.option("header", "true").csv(path)

    def labelled(tasks):
        read = spark.read.parquet(path) if kind == "parquet" else readers.read_csv(spark, path, positions=True)
        with pytest.warns(UserWarning, match="one by one"):
            found = split.auto_split(read.repartition(tasks))
        assert found.columns == ["text", "split"]
        return {row.text for row in found.filter("split = 'val'").collect()}

    assert len(labelled(3)) == 100
    assert labelled(3) == labelled(7)
    with pytest.raises(ValueError, match="give a key"), pytest.warns(UserWarning):
        split.auto_split(spark.range(3).select(F.lit("a").alias("text")))


def test_auto_split_prefers_the_document_id(spark):
    rows = spark.createDataFrame([("a", str(place)) for place in range(50)] + [("b", "x")], "Text_ID string, id string")
    assert {(row.Text_ID, row.split) for row in split.auto_split(rows).collect()} in (
        {("a", "val"), ("b", "train")}, {("a", "train"), ("b", "val")},
    )


def test_threshold_split(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"))
    labelled = split.threshold_split(rows, "id").collect()
    expected = {str(key) for key in range(4000) if int(md5(f"42:{key}")[:8], 16) < int(0.1 * 2**32)}
    assert {row.id for row in labelled if row.split == "val"} == expected
    assert {row.split for row in split.threshold_split(rows, "id", fraction=1.0).collect()} == {"val"}


def test_split_outputs(spark):
    rows = spark.range(500).withColumn("text", F.lit("t"))
    outputs = split.split_outputs(split.document_split(rows, "id"), "id")
    ids = {name: [row.id for row in frame.collect()] for name, frame in outputs.items()}
    assert len(ids["val"]) == 50 and len(ids["train_full"]) == 450
    assert sorted(ids["train_small"]) == sorted(ids["train_full"])[:100]
    assert not set(ids["val"]) & set(ids["train_full"])


def test_seeded_shuffle(spark):
    rows = spark.range(200)
    order = [row.id for row in split.seeded_shuffle(rows, "id").collect()]
    assert order == sorted(range(200), key=lambda key: md5(f"42:{key}"))


def test_membership_is_null_safe_and_complete(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    inside = [row.k for row in split.rows_with_key_in(rows, keys, "k").collect()]
    outside = [row.k for row in split.rows_with_key_not_in(rows, keys, "k").collect()]
    assert sorted(inside, key=str) == [None, "a", "a"] and sorted(outside) == ["b", "c"]


def test_row_index_is_dense_and_ordered(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 3).alias("hot")).repartition(6)
    indexed = indexing.with_row_index(rows, F.col("hot"), F.desc("id")).collect()
    by_index = {row.row_index: (row.hot, -row.id) for row in indexed}
    assert sorted(by_index) == list(range(2000))
    assert [by_index[place] for place in range(2000)] == sorted(by_index.values())


@pytest.mark.parametrize("kind", ["parquet", "csv", "lines"])
def test_row_index_without_an_order_is_file_order(spark, tmp_path, kind):
    start = 0
    for name, size in (("a", 10), ("b", 2000), ("c", 300), ("d", 5000)):
        part = spark.range(start, start + size, 1, 1)
        start += size
        part.write.parquet(f"{tmp_path}/{name}") if kind == "parquet" else part.write.option("header", "true").csv(f"{tmp_path}/{name}")
    paths = [f"{tmp_path}/{name}" for name in "dabc"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = spark.read.parquet(*paths) if kind == "parquet" else readers.read_csv(spark, *paths, positions=True, line_breaks=kind == "csv")
        indexed = indexing.with_row_index(rows)
        assert indexed.columns == ["id", "row_index"]
        assert all(int(row.id) == row.row_index for row in indexed.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="no file order"):
        indexing.with_row_index(spark.range(3))


def test_length_batches(spark):
    texts = [("x" * (place * 7 % 11), place) for place in range(100)]
    rows = spark.createDataFrame(texts, "text string, pos int").repartition(5)
    batched = indexing.length_batches(rows, F.length("text"), "pos", batch_size=8).collect()
    expected = sorted(texts, key=lambda row: (len(row[0]), row[1]))
    assert [(row.text, row.pos) for row in sorted(batched, key=lambda row: row.batch_pos)] == expected
    assert all(row.batch_id == row.batch_pos // 8 for row in batched)


def test_sort_by_length_and_restore(spark):
    rows = spark.createDataFrame([("x" * (9 - place), place) for place in range(10)], "text string, pos int")
    by_length = [len(row.text) for row in indexing.sort_by_length(rows, "text", "pos").collect()]
    assert by_length == sorted(by_length)
    restored = indexing.restore_order(indexing.sort_by_length(rows, "text", "pos"), "pos")
    assert [row.pos for row in restored.collect()] == list(range(10))


@pytest.mark.parametrize("function, expected", [(split.rows_with_key_in, 21000), (split.rows_with_key_not_in, 39000)])
def test_hot_keys_of_a_membership_join_are_split(spark, function, expected):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        rows = spark.range(60000).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        keys = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
        found = function(rows.repartition(8), keys, "k").agg(F.count("payload"), F.max("payload"))
        assert found.collect()[0][0] == expected
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
