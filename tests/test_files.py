import os
import random

import pytest
from pyspark.sql import functions as F

from corpus_spark.functions import chat
from corpus_spark.sources import paths, readers, writers


def nasty(seed, count):
    pick = random.Random(seed)
    pieces = ["a", "\"", "\"\"", ",", "\n", "\r\n", "\r", "\\", "\\\"", " ", "\t", "é", "#", "'", "\\n", "NA", ";"]
    return ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 8))) for _ in range(count)]


def test_csv_keeps_every_text(spark, tmp_path):
    values = [*nasty(1, 600), "", None, " a ", "NA", "null"]
    rows = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    writers.write_csv(rows, str(tmp_path / "deep" / "t.csv"), bytes_per_file=2000)
    back = readers.read_csv(spark, str(tmp_path / "deep" / "t.csv"))
    assert back.dtypes == [("id", "string"), ("text", "string")]
    assert {int(row.id): row.text for row in back.collect()} == dict(enumerate(values))


def test_a_reordered_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("text,id\nfour,4\n", encoding="utf-8")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).collect()


def test_csv_parts_are_bounded_in_bytes(spark, tmp_path):
    rows = spark.range(0, 300, 1, 1).select("id", F.expr("repeat('x', 1000)").alias("text"))
    writers.write_csv(rows, str(tmp_path / "t"), bytes_per_file=50_000)
    sizes = [part.stat().st_size for part in (tmp_path / "t").glob("part-*")]
    assert len(sizes) >= 6 and max(sizes) < 60_000


def test_csv_of_other_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"a ""b"", c\nd"\n2,\n3,NA\n', encoding="utf-8")
    assert [row.text for row in readers.read_csv(spark, str(tmp_path / "t.csv")).orderBy("id").collect()] == ['a "b", c\nd', None, "NA"]
    with_tokens = readers.read_csv(spark, str(tmp_path / "t.csv"), na_tokens=("NA",))
    assert [row.text for row in with_tokens.orderBy("id").collect()] == ['a "b", c\nd', None, None]


def test_chat_lines(spark, tmp_path):
    values = nasty(2, 100)
    rows = spark.createDataFrame([(value, f"é{value}") for value in values], "s string, t string")
    writers.write_jsonl(rows.select(chat.chat_messages(F.col("s"), F.col("t")).alias("messages")), str(tmp_path / "c.jsonl"))
    text = "".join(part.read_text(encoding="utf-8") for part in (tmp_path / "c.jsonl").glob("part-*"))
    assert "é" in text and "\\u00e9" not in text
    messages = F.col("messages")
    back = readers.read_chat(spark, str(tmp_path / "c.jsonl")).select(chat.message_source(messages), chat.message_reference(messages))
    assert sorted(map(tuple, back.collect())) == sorted((value, f"é{value}") for value in values)


def test_jsonl_writes_null_fields(spark, tmp_path):
    writers.write_jsonl(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "n.jsonl"))
    assert '{"a":1,"b":null}' in "".join(part.read_text() for part in (tmp_path / "n.jsonl").glob("part-*"))


def test_paths(spark, tmp_path):
    old, new, folder = tmp_path / "val_base.csv", tmp_path / "val_lora.csv", tmp_path / "val_dir.csv"
    old.write_text("x")
    new.write_text("x")
    (tmp_path / "test_lora.csv").write_text("x")
    folder.mkdir()
    (folder / "part-0.csv").write_text("x")
    os.utime(old, (100, 100))
    os.utime(new, (200, 200))
    os.utime(folder / "part-0.csv", (150, 150))
    assert paths.newest(spark, str(tmp_path), "val_*.csv").endswith("/val_lora.csv")
    os.utime(folder / "part-0.csv", (300, 300))
    assert paths.prediction_input(spark, str(tmp_path), "val").endswith("/val_dir.csv")
    assert paths.prediction_input(spark, str(tmp_path), "val", str(old)) == str(old)
    assert paths.exists(spark, str(new)) and not paths.exists(spark, str(tmp_path / "none"))
    assert paths.first_existing(spark, str(tmp_path / "none"), str(new)) == str(new)
    assert paths.existing(spark, str(tmp_path / "none"), str(new)) == [str(new)]
    with pytest.raises(FileNotFoundError):
        paths.newest(spark, str(tmp_path), "none_*.csv")
    with pytest.raises(FileNotFoundError):
        paths.first_existing(spark, str(tmp_path / "none"))


def test_names():
    assert paths.prediction_name("val") == "val_lora.csv"
    assert paths.prediction_name("test", with_adapter=False) == "test_base.csv"
    assert paths.clean_name("out/test_lora.csv") == "out/test_lora_clean.csv"


def test_scores_of_runs(spark, tmp_path):
    for run, geomean in (("model_r32-a64_lr2e-4_ep5", 2.0), ("x+y z", 3.0)):
        folder = tmp_path / "sweep" / run
        folder.mkdir(parents=True)
        (folder / "scores.json").write_text('{\n  "bleu": 1.5,\n  "chrfpp": 2.5,\n  "geomean": %s,\n  "epoch": 5\n}' % geomean)
    found = {row.run: (row.bleu, row.geomean, row.epoch) for row in readers.read_scores(spark, str(tmp_path / "sweep")).collect()}
    assert found == {"model_r32-a64_lr2e-4_ep5": (1.5, 2.0, 5), "x+y z": (1.5, 3.0, 5)}


def test_written_scores_read_back(spark, tmp_path):
    one = spark.sql("SELECT 1.5D AS bleu, 2.5D AS chrfpp, 2D AS geomean, 3 AS epoch")
    writers.write_scores(one, str(tmp_path / "sweep" / "runA" / "scores.json"))
    assert [tuple(row) for row in readers.read_scores(spark, str(tmp_path / "sweep")).collect()] == [("runA", 1.5, 2.5, 2.0, 3)]
    writers.write_run_scores(one.withColumn("run", F.lit("7")), str(tmp_path / "all"))
    assert [row.run for row in readers.read_run_scores(spark, str(tmp_path / "all")).collect()] == ["7"]


def test_settings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text('# sweep\nmodel_name: "Org/Model-1.7B"\nlr: 2e-4\nlora_r: 64 # wide\nload_in_4bit: true\n')
    (tmp_path / "b.yaml").write_text("model_name: 'Other'\nepochs: 3\n")
    rows = {row.model_name: row for row in readers.read_settings(spark, str(tmp_path / "*.yaml")).collect()}
    assert (rows["Org/Model-1.7B"].lr, rows["Org/Model-1.7B"].lora_r, rows["Org/Model-1.7B"].epochs) == ("2e-4", "64", None)
    assert rows["Other"].epochs == "3"


def test_split_folders_prune(spark, tmp_path):
    rows = spark.range(10).withColumn("split", F.when(F.col("id") < 2, "val").otherwise("train"))
    writers.write_split(rows, str(tmp_path / "s"))
    held_out = readers.read_parquet(spark, str(tmp_path / "s")).filter("split = 'val'")
    assert held_out.count() == 2
    assert "PartitionFilters: [isnotnull(split" in held_out._jdf.queryExecution().executedPlan().toString()
    writers.write_predictions(rows.withColumn("variant", F.lit("lora")), str(tmp_path / "p"), "split", "variant")
    assert (tmp_path / "p" / "split=val" / "variant=lora").is_dir()


def test_submission_file(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, translation string").withColumn("more", F.lit(1))
    writers.write_submission(rows, str(tmp_path / "s.csv"), order_by="id", single_file=True)
    parts = list((tmp_path / "s.csv").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text() == "id,translation\n1,a\n2,b\n"
