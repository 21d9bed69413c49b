import sys
import warnings

import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corpus_spark.functions import chat
from corpus_spark.operators import columns, corpus, predict, runs, submission
from corpus_spark.sources import readers
from corpus_spark.streaming import rowwise

# The predictors below are pickled into the tasks; workers cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_column_lookup(spark):
    rows = spark.createDataFrame([("a", "b", "c")], "Target string, SOURCE string, `x.y` string")
    assert columns.find_column(rows, *columns.SOURCE_ALIASES) == "SOURCE"
    assert columns.find_column(rows, "none", "X.Y") == "x.y"
    assert columns.find_column(rows, "none") is None
    assert columns.resolve(rows, source=("transliteration", "source"), target=("target",)).columns == ["target", "source", "x.y"]
    with pytest.raises(ValueError, match="Target"):
        columns.require_column(rows, "none")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="Ambiguous"):
            columns.find_column(spark.createDataFrame([(1, 2)], "id int, ID int"), "id")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


RAW = [("1. [x] a", " A  b "), ("<<x>>", "B"), (None, "C"), ("ok", None), ("ok", " "), ("é!", "D")]


@pytest.mark.parametrize("observe", [False, True])
def test_parallel_cleaning(spark, observe):
    rows = spark.createDataFrame(RAW, "Transliteration string, target string").withColumn("other", F.lit(1))
    observation = Observation("kept") if observe else None
    cleaned = corpus.clean_parallel(rows, observation)
    assert cleaned.columns == ["Transliteration", "target", "other", corpus.SOURCE_CLEAN, corpus.TARGET_CLEAN]
    assert sorted((row[3], row[4]) for row in cleaned.collect()) == [("<gap> a", "A b"), ("é", "D")]
    if observe:
        assert observation.get == {"rows_in": 6, "rows_kept": 2, "rows_dropped": 4}


@pytest.mark.parametrize("observe", [False, True])
def test_cleaning_runs_once_per_row(spark, observe):
    rows = spark.createDataFrame(RAW, "source string, target string")
    plan = corpus.clean_parallel(rows, Observation("once") if observe else None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("Q<<") == 1


def test_test_rows_are_all_kept(spark):
    rows = spark.createDataFrame(RAW, "source string, target string")
    assert [row[2] for row in corpus.clean_test(rows).collect()] == ["<gap> a", "", "", "ok", "ok", "é"]
    with pytest.raises(ValueError):
        corpus.clean_test(rows.drop("source"))


def test_fill_and_preview(spark):
    rows = spark.createDataFrame([(None, "x" * 300, 1)], "a string, b string, n int")
    assert columns.fill_missing(rows, a="...").collect()[0].a == "..."
    shown = columns.preview(rows).collect()[0]
    assert (len(shown.b), shown.n) == (100, 1)


def test_chat_messages(spark):
    row = spark.range(1).select(
        chat.chat_messages(F.lit("s"), F.lit("t")).alias("m"),
        chat.ChatTemplate().render(chat.prompt_messages(F.lit("s"), "SYS")).alias("p"),
        chat.ChatTemplate().render(chat.prompt_messages(F.lit("s"), "SYS"), add_generation_prompt=False).alias("q"),
    ).collect()[0]
    assert [(message.role, message.content) for message in row.m] == [
        ("system", chat.SYSTEM_PROMPT), ("user", "Translate: s"), ("assistant", "t"),
    ]
    assert row.p == (
        "<|im_start|>system\nSYS<|im_end|>\n<|im_start|>user\nTranslate: s<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
    )
    assert row.p.startswith(row.q) and row.q.endswith("<|im_end|>\n")


def recorder(options):
    """A factory whose predictor reports the batch it saw."""

    def predict_batch(prompts):
        assert 0 < len(prompts) <= options.batch_size
        return [f"{len(prompts)}:{prompt}" for prompt in prompts]

    return predict_batch


def short(options):
    return lambda prompts: prompts[1:]


def test_micro_batches(spark):
    rows = spark.createDataFrame([(str(place) if place % 5 else None,) for place in range(23)], "p string").coalesce(1)
    options = predict.GenerationOptions(batch_size=4)
    answers = [row.a for row in rows.select(predict.predict_column(F.col("p"), recorder, options).alias("a")).collect()]
    asked = [str(place) for place in range(23) if place % 5]
    assert [answer.split(":")[1] for answer in answers if answer] == asked
    assert [int(answer.split(":")[0]) for answer in answers if answer] == [4] * 16 + [2] * 2
    assert [place for place, answer in enumerate(answers) if answer is None] == [0, 5, 10, 15, 20]


def test_wrong_answer_count_is_an_error(spark):
    rows = spark.createDataFrame([("a",)], "p string")
    with pytest.raises(Exception, match="0 texts for 1 prompts"):
        rows.select(predict.predict_column(F.col("p"), short)).collect()


@pytest.mark.parametrize("global_order", [False, True])
def test_translate_keeps_rows_together(spark, global_order):
    rows = spark.createDataFrame([(1, "the king"), (2, ""), (3, None), (4, "of the")], "id int, text string")
    lookup = predict.WordLookup((("the", "THE"), ("of", "OF")))
    found = predict.translate(rows, "text", lookup, predict.GenerationOptions(), "id", global_length_order=global_order)
    assert {row.id: row.prediction for row in found.collect()} == {1: "THE king", 2: "...", 3: "...", 4: "OF THE"}


def test_local_length_order_needs_no_exchange(spark):
    plan = predict.translate(spark.range(100).selectExpr("repeat('a', int(id)) AS text"), "text", predict.WordLookup())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Sort" in text and text.count("ArrowEvalPython") == 1


def test_validation_and_clean_predictions(spark):
    records = spark.createDataFrame([("a b", "R")], "s string, t string").select(
        F.lit(7).alias("id"), chat.chat_messages(F.col("s"), F.col("t")).alias("messages")
    )
    found = predict.add_clean_predictions(predict.translate_validation(records, predict.WordLookup((("a", "<|x|>A"),))))
    row = found.collect()[0]
    assert (row.id, row.transliteration, row.reference, row.prediction, row.prediction_clean) == (7, "a b", "R", "<|x|>A b", "A b")


def test_submission_by_carried_id(spark):
    rows = spark.createDataFrame([(1, "a <|x|>"), (2, None)], "text_id int, prediction string")
    assert sorted(map(tuple, submission.submission(rows).collect())) == [(1, "a"), (2, "...")]
    raw = submission.submission(rows, apply_postprocess=False)
    assert sorted(map(tuple, raw.collect())) == [(1, "a <|x|>"), (2, None)]


def test_submission_by_key(spark):
    test = spark.createDataFrame([(1, 9), (2, 8), (4, 7)], "id int, text_id int")
    found = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "id int, prediction string")
    observation = Observation("pairs")
    joined = submission.submission_by_key(test, found, observation=observation)
    assert sorted(map(tuple, joined.collect())) == [(1, "a"), (2, "b"), (4, "...")]
    assert observation.get == {"test_rows": 3, "predicted": 2}
    assert "SortAggregate" not in joined._jdf.queryExecution().executedPlan().toString()
    raw = submission.submission_by_key(test, found.union(spark.createDataFrame([(4, None)], found.schema)), apply_postprocess=False)
    assert sorted(map(tuple, raw.collect())) == [(1, "a"), (2, "b"), (4, None)]
    with pytest.raises(Exception, match="Several predictions for id 2"):
        submission.submission_by_key(test, found.union(found.filter("id = 2"))).collect()


@pytest.mark.parametrize("count", [3, 5, 7])
def test_submission_by_position(spark, tmp_path, count):
    test = spark.createDataFrame([(f"t{place}",) for place in range(5)], "Text_Id string")
    spark.createDataFrame([(f"p{place}",) for place in range(count)], "prediction string").coalesce(1).write.parquet(f"{tmp_path}/p")
    found = spark.read.parquet(f"{tmp_path}/p")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        paired = submission.submission_by_position(test, found, test_order=(F.col("Text_Id"),))
    assert any("predictions for 5 test rows" in str(each.message) for each in caught) == (count != 5)
    pairs = sorted(map(tuple, paired.collect()))
    assert pairs == [(f"t{place}", f"p{place}" if place < count else "...") for place in range(5)]
    counts = submission.position_counts(test, found).collect()[0]
    assert (counts.test_rows, counts.prediction_rows, counts.same) == (5, count, count == 5)


def test_submission_id_falls_back_to_position(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "source string").coalesce(1).write.parquet(f"{tmp_path}/t")
    with pytest.warns(UserWarning, match="row position"):
        named = submission.with_submission_id(spark.read.parquet(f"{tmp_path}/t"))
    assert [(row.source, row.id) for row in named.orderBy("id").collect()] == [("a", 0), ("b", 1)]


def limits(options):
    return lambda prompts: [f"{options.batch_size} {options.max_input_tokens} {options.max_new_tokens}" for _ in prompts]


def test_options_come_from_settings(spark):
    rows = spark.createDataFrame([("4", "512", None)], "inference_batch_size string, max_seq_length string, max_new_tokens string")
    options = predict.GenerationOptions.from_settings(rows.first())
    found = rows.select(predict.predict_column(F.lit("x"), limits, options).alias("a")).first().a
    assert found == "4 512 256"
    with pytest.raises(ValueError, match="tie"):
        predict.translate(rows, "max_seq_length", limits, global_length_order=True)


def test_runs_are_identified(spark):
    names = "model_name string, lora_r string, lora_alpha string, lr string, epochs string, run_name string, sweep_dir string, output_dir string"
    rows = [("O/M", "8", None, None, None, None, "s/", "o"), ("O/M", None, None, None, None, "mine", "s", None), ("O/M", None, None, None, None, "mine", None, "o")]
    found = runs.identified(spark.createDataFrame(rows, names)).select("run", "folder").collect()
    assert list(map(tuple, found)) == [("m_r8-a64_lr0.0002_ep3", "s/m_r8-a64_lr0.0002_ep3"), ("mine", "s/mine"), ("mine", "o")]


def test_null_texts_make_no_messages(spark):
    row = spark.range(1).select(
        chat.chat_messages(F.lit(None).cast("string"), F.lit("t")).alias("a"), chat.chat_messages(F.lit("s"), F.lit(None).cast("string")).alias("b")
    ).first()
    assert row.a is None and row.b is None


def test_row_counts_are_observed(spark):
    observation = Observation("rows")
    submission.observed(spark.range(7), observation).collect()
    assert observation.get == {"rows": 7}


def test_run_names(spark):
    rows = spark.createDataFrame(
        [("Org/Model-1.5B-Instruct-2507", "16", "32", "1e-4", "5"), ("Model", None, None, None, None)],
        "m string, r string, a string, lr string, ep string",
    )
    names = [row[0] for row in rows.select(runs.run_name(*[F.col(name) for name in rows.columns])).collect()]
    assert names == ["model-1.5b_r16-a32_lr1e-4_ep5", "model_r32-a64_lr0.0002_ep3"]
    parsed = runs.parse_run_name(spark.createDataFrame([(name,) for name in [*names, "cloud-full-v1"]], "run string")).collect()
    assert [tuple(row)[1:] for row in parsed] == [
        ("model-1.5b", 16, 32, 1e-4, 5), ("model", 32, 64, 2e-4, 3), (None, None, None, None, None),
    ]


def test_best_run(spark):
    # The published scores of four runs.
    rows = spark.createDataFrame(
        [("r64", "m", 38.91), ("r32low", "m", 20.52), ("r32", "m", 37.20), ("r16", "n", 27.81), ("r17", "n", 27.81)],
        "run string, model string, geomean double",
    )
    assert runs.best_run(rows).collect()[0].run == "r64"
    assert {row.model: row.run for row in runs.best_run(rows, "model").collect()} == {"m": "r64", "n": "r17"}
    places = {row.run: row.place for row in runs.rank_runs(rows, "model").collect()}
    assert places == {"r64": 1, "r32": 2, "r32low": 3, "r17": 1, "r16": 2}
    settings = spark.createDataFrame([("r64", 5)], "run string, epochs int")
    assert runs.with_settings(rows, settings).filter("epochs = 5").count() == 1
    assert runs.with_settings(rows, settings).count() == 5


def test_streaming_gives_the_batch_rows(spark, tmp_path):
    rows = spark.createDataFrame([(str(place), f"{place}. [x] a", "B") for place in range(40)] + [("z", "<<x>>", "B")], "id string, source string, target string")
    rows.write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = rowwise.write_stream(rowwise.prepare_stream(raw, "id"), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    assert query.awaitTermination(120)
    streamed = {tuple(row) for row in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {tuple(row) for row in rowwise.prepare_stream(rows, "id").collect()}
    assert len(streamed) == 40


def test_limits_of_a_settings_file_reach_the_predictor(spark, tmp_path):
    (tmp_path / "settings.yaml").write_text("max_seq_length: 3\ninference_batch_size: 2\nmax_new_tokens: '9'\n")
    options = predict.GenerationOptions.from_settings(readers.read_settings(spark, f"{tmp_path}/settings.yaml").first())
    assert options == predict.GenerationOptions(batch_size=2, max_input_tokens=3, max_new_tokens=9)
    rows = spark.createDataFrame([(1, "a b c d e"), (2, "a"), (3, " "), (4, None)], "id int, source string")
    asked = []

    def factory(given):
        asked.append(given)
        return predict.WordLookup((("a", "x"),), limited=True)(given)

    found = predict.translate(rows, "source", predict.WordLookup((("a", "x"),), limited=True), options, "id")
    assert {r.id: r.prediction for r in found.collect()} == {1: "x b c", 2: "x", 3: "...", 4: "..."}
    assert factory(options)([]) == [] and asked == [options]
