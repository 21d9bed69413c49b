"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.functions import bleu, chat, chrf, generation, source_text, text, unicode
from corpus_spark.operators import choice, columns, context, corpus, fuzzy, indexing, lexicon, names, predict, runs, score, split, submission
from corpus_spark.plans import tables
from corpus_spark.session import scratch_path
from corpus_spark.sources import paths, readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The stub model of the translation queries.
MEANINGS = (("the", "šumma"), ("of", "ša"), ("and", "u"), ("que", "kī"), ("de", "ina"))
LOOKUP = predict.WordLookup(MEANINGS)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- cleaning -----------------------------------------------------------------------------------


@query
def clean_source(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged transliterations cleaned; rows that come out empty are dropped."""
    marked = tables.documents(spark, folder).select(
        "doc_id", "lang", tables.marked_source(F.col("text"), F.col("doc_id")).alias("marked")
    )
    return corpus.with_clean(marked, clean=source_text.clean_source(F.col("marked"))).drop("marked")


@query
def clean_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and characters removed by cleaning, per language."""
    marked = tables.documents(spark, folder).select(
        "lang", tables.marked_source(F.col("text"), F.col("doc_id")).alias("marked")
    )
    cleaned = corpus.with_clean(marked, clean=source_text.clean_source(F.col("marked")))
    return cleaned.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.sum(F.length("marked") - F.length("clean")).alias("chars_removed"),
    )


@query
def nfc_normalize(spark: SparkSession, folder: str) -> DataFrame:
    decomposed = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ"))
    return (
        tables.documents(spark, folder).select("doc_id", decomposed.alias("text"))
        .select("doc_id", unicode.nfc(F.col("text")).alias("text"))
    )


@query
def clean_target(spark: SparkSession, folder: str) -> DataFrame:
    return tables.conversations(spark, folder).select(
        "conv_id", "turn", source_text.clean_target(F.replace(F.col("text"), F.lit(" "), F.lit(" \t "))).alias("clean")
    )


def _raw_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = tables.turn_pairs(spark, folder)
    return pairs.select(
        "conv_id", "turn",
        tables.some_blank(tables.marked_source(F.col("source"), F.col("turn")), F.length("source")).alias("Source"),
        tables.some_blank(F.col("target"), F.length("target")).alias("Translation"),
    )


@query
def clean_parallel(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides cleaned, pairs with an empty side dropped, columns found by alias."""
    return corpus.clean_parallel(_raw_pairs(spark, folder)).select(
        "conv_id", "turn", corpus.SOURCE_CLEAN, corpus.TARGET_CLEAN
    )


@query
def clean_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in, kept and dropped."""
    pairs = _raw_pairs(spark, folder)
    cleaned = pairs.select(
        "turn",
        source_text.clean_source(F.col("Source")).alias("s"),
        source_text.clean_target(F.col("Translation")).alias("t"),
    )
    return corpus.kept_counts(cleaned, "s", "t", "turn")


@query
def clean_test(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows cleaned; none is dropped."""
    rows = _raw_pairs(spark, folder).drop("Translation")
    return corpus.clean_test(rows).select("conv_id", "turn", corpus.SOURCE_CLEAN)


@query
def postprocess(spark: SparkSession, folder: str) -> DataFrame:
    """Raw model output cleaned."""
    return tables.conversations(spark, folder).select(
        "conv_id", "turn",
        generation.postprocess(tables.some_blank(tables.marked_output(F.col("text")), F.length("text"))).alias("clean"),
    )


@query
def collapse_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated phrases collapsed in whole documents."""
    return tables.documents(spark, folder).select(
        "doc_id", generation.collapse_repeats(tables.marked_output(F.col("text"))).alias("clean")
    )


@query
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words, code points and the text joined again."""
    return (
        tables.documents(spark, folder)
        .select("doc_id", text.words(F.col("text")).alias("words"), text.code_points(F.col("text")).cast("long").alias("points"))
        .select("doc_id", "points", F.size("words").cast("long").alias("n_words"), text.join_words(F.col("words")).alias("joined"))
    )


@query
def blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text is missing or blank."""
    rows = tables.documents(spark, folder).select(
        "doc_id", "lang", tables.some_blank(F.col("text"), F.col("n_chars")).alias("text")
    )
    return rows.filter(text.is_blank(F.col("text"))).select("doc_id", "lang")


@query
def fill_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.predictions(spark, folder).select(
        "conv_id", "turn",
        tables.some_blank(F.col("prediction"), F.length("prediction")).alias("prediction"),
        tables.some_blank(F.col("reference"), F.length("reference")).alias("reference"),
    )
    return columns.fill_missing(rows, prediction="...", reference="")


@query
def preview(spark: SparkSession, folder: str) -> DataFrame:
    """The first five rows, texts cut for display."""
    rows = tables.documents(spark, folder).select("doc_id", "text").orderBy("doc_id")
    return columns.preview(rows)


# --- files --------------------------------------------------------------------------------------


@query
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes and line breaks written as CSV and read back."""
    path = scratch_path(spark, "texts.csv")
    quoted = F.replace(F.col("text"), F.lit(","), F.lit(' ,"'))
    writers.write_csv(tables.conversations(spark, folder).select("conv_id", "turn", "role", quoted.alias("text")), path)
    rows = readers.read_csv(spark, path)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")


@query
def chat_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Chat records written as JSON lines, read back and unpacked."""
    path = scratch_path(spark, "chat.jsonl")
    pairs = tables.turn_pairs(spark, folder)
    writers.write_jsonl(pairs.select(chat.chat_messages(F.col("source"), F.col("target")).alias("messages")), path)
    messages = F.col("messages")
    return readers.read_chat(spark, path).select(
        chat.message_source(messages).alias("source"), chat.message_reference(messages).alias("reference")
    )


@query
def prepared_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Raw pairs to the three chat sets: cleaned, filtered, split by conversation, written, read back.
    Writes them when called."""
    place = scratch_path(spark, "prepared")
    clean = corpus.clean_parallel(_raw_pairs(spark, folder)).withColumnRenamed("conv_id", "text_id")
    writers.write_chat_sets(corpus.chat_sets(clean, "text_id", "turn"), place, "text_id", "turn")
    read = None
    for name in ("train_full", "val", "train_small"):
        found = paths.first_existing(spark, f"{place}/{name}.missing", f"{place}/{name}.jsonl")
        messages = F.col("messages")
        part = readers.read_chat(spark, found).select(
            F.lit(name).alias("part"), chat.message_source(messages).alias("source"), chat.message_reference(messages).alias("reference")
        )
        read = part if read is None else read.unionByName(part)
    return read


# --- chat records -------------------------------------------------------------------------------


@query
def chat_records(spark: SparkSession, folder: str) -> DataFrame:
    messages = chat.chat_messages(F.col("source"), F.col("target"))
    return tables.turn_pairs(spark, folder).select("conv_id", "turn", F.to_json(messages).alias("messages"))


@query
def chat_unpack(spark: SparkSession, folder: str) -> DataFrame:
    packed = tables.turn_pairs(spark, folder).select(
        "conv_id", "turn", chat.chat_messages(F.col("source"), F.col("target")).alias("messages")
    )
    return packed.select(
        "conv_id", "turn",
        chat.message_source(F.col("messages")).alias("source"),
        chat.message_reference(F.col("messages")).alias("reference"),
    )


@query
def rendered_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Inference prompts as one string."""
    prompt = chat.ChatTemplate().render(chat.prompt_messages(F.col("text")))
    return tables.conversations(spark, folder).filter("role = 'user'").select("conv_id", "turn", prompt.alias("prompt"))


# --- splits, orders, membership -----------------------------------------------------------------


@query
def document_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.document_split(tables.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")


@query
def source_split(spark: SparkSession, folder: str) -> DataFrame:
    """Split by a key many rows share."""
    return split.document_split(tables.table(spark, folder, "documents").select("doc_id", "source"), "source")


@query
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    labelled = split.document_split(tables.table(spark, folder, "documents").select("source"), "source")
    return split.split_sizes(labelled, "source")


@query
def row_split(spark: SparkSession, folder: str) -> DataFrame:
    """Split by row position, for tables without a document id."""
    rows = tables.table(spark, folder, "documents").select("doc_id", "lang")
    indexed = indexing.with_row_index(rows, F.col("lang"), F.col("doc_id"))
    return split.row_split(indexed, "row_index")


@query
def keyless_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows on each side when a table without any id is split by where its rows stand."""
    labelled = split.auto_split(tables.table(spark, folder, "documents").select("lang", "text"))
    return labelled.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text").isNull()).alias("without_text"))


@query
def threshold_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.threshold_split(tables.table(spark, folder, "documents").select("doc_id", "source"), "doc_id")


@query
def split_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """The three data sets of a split, labelled; the small one is a top-k report by design."""
    labelled = split.document_split(tables.table(spark, folder, "documents").select("doc_id", "source"), "source")
    outputs = split.split_outputs(labelled, split.split_rank(F.col("doc_id")), "doc_id")
    parts = [frame.select("doc_id", F.lit(name).alias("part")) for name, frame in outputs.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its place in the seeded order."""
    rows = tables.table(spark, folder, "documents").select("doc_id")
    return indexing.with_row_index(rows, split.split_rank(F.col("doc_id")), F.col("doc_id"), name="place")


@query
def seeded_head(spark: SparkSession, folder: str) -> DataFrame:
    """The first documents of the seeded order, a top-k report by design."""
    rows = tables.table(spark, folder, "documents").select("source", "doc_id")
    return split.seeded_shuffle(rows, "source", "doc_id").limit(split.SMALL_ROWS)


@query
def row_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return indexing.with_row_index(rows, F.col("conv_id"), F.col("turn"))


@query
def distinct_documents(spark: SparkSession, folder: str) -> DataFrame:
    return split.distinct_keys(tables.table(spark, folder, "documents"), "source")


@query
def held_out_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents among a set of ids."""
    return split.rows_with_key_in(
        tables.table(spark, folder, "documents").select("doc_id", "lang"), tables.table(spark, folder, "labels"), "doc_id"
    )


@query
def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The complement of the same set."""
    return split.rows_with_key_not_in(
        tables.table(spark, folder, "documents").select("doc_id", "lang"), tables.table(spark, folder, "labels"), "doc_id"
    )


# --- scores -------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in ("bleu", "chrfpp", "geomean") if name in df.columns})


@query
def bleu_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """13a tokens of markup-rich text."""
    return tables.texts(spark, folder, "pages").select("page_id", bleu.tokenize_13a(F.col("html")).alias("tokens"))


@query
def chrf_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tables.texts(spark, folder, "pages").select("page_id", chrf.split_punctuation(F.col("html")).alias("tokens"))


@query
def bleu_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """N-gram counts of each pair."""
    rows = score.row_statistics(tables.predictions(spark, folder), "prediction", "reference", ("bleu",))
    return rows.drop("prediction", "reference")


@query
def chrf_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = score.row_statistics(tables.predictions(spark, folder), "prediction", "reference", ("chrf",))
    return rows.drop("prediction", "reference")


@query
def corpus_bleu(spark: SparkSession, folder: str) -> DataFrame:
    sums = score.corpus_statistics(tables.predictions(spark, folder), "prediction", "reference", metrics=("bleu",))
    return _rounded(sums.select(score.summed_bleu().alias("bleu")))


@query
def corpus_chrf(spark: SparkSession, folder: str) -> DataFrame:
    sums = score.corpus_statistics(tables.predictions(spark, folder), "prediction", "reference", metrics=("chrf",))
    return _rounded(sums.select(score.summed_chrf().alias("chrfpp")))


@query
def evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """BLEU, chrF++ and geometric mean of a predictions table."""
    return _rounded(score.evaluate(tables.predictions(spark, folder)))


@query
def evaluate_by_turn(spark: SparkSession, folder: str) -> DataFrame:
    """The same per group, missing texts filled."""
    rows = tables.predictions(spark, folder).withColumns(
        {
            "prediction": tables.some_blank(F.col("prediction"), F.length("prediction")),
            "reference": tables.some_blank(F.col("reference"), F.length("reference")),
        }
    )
    return _rounded(score.evaluate(rows, "turn"))


def _document_outputs(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = generation.postprocess(tables.marked_output(F.col("text")))
    return tables.documents(spark, folder).select("lang", cleaned.alias("prediction_clean"), F.col("text").alias("reference"))


@query
def document_bleu(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned output of whole documents against the documents, per language."""
    rows = _document_outputs(spark, folder)
    sums = score.corpus_statistics(rows, "prediction_clean", "reference", "lang", metrics=("bleu",))
    return _rounded(sums.select("lang", score.summed_bleu().alias("bleu")))


@query
def evaluate_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All scores of the same rows."""
    return _rounded(score.evaluate(_document_outputs(spark, folder), "lang"))


@query
def evaluate_newest(spark: SparkSession, folder: str) -> DataFrame:
    """Two prediction files written one after the other; the newer one is found and scored."""
    place = scratch_path(spark, "predictions")
    rows = tables.predictions(spark, folder)
    worse = rows.withColumn("prediction", F.upper("prediction"))
    writers.write_csv(worse, f"{place}/{paths.prediction_name('val', with_adapter=False)}")
    writers.write_csv(rows, f"{place}/{paths.prediction_name('val')}")
    return _rounded(score.evaluate(readers.read_csv(spark, paths.prediction_input(spark, place, "val"))))


@query
def epoch_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores per run and epoch."""
    return _rounded(score.evaluate(tables.run_predictions(spark, folder), "run", "epoch"))


@query
def last_epoch_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score.last_epoch_scores(epoch_scores(spark, folder))


# --- translation and submission -----------------------------------------------------------------


@query
def length_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Exact length-sorted micro-batches."""
    rows = tables.table(spark, folder, "documents").select("doc_id", F.length("text").alias("length"))
    return indexing.length_batches(rows, F.col("length"), "doc_id").drop("length")


@query
def translate_test(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned test rows through the stub model."""
    rows = corpus.clean_test(_raw_pairs(spark, folder)).select("conv_id", "turn", corpus.SOURCE_CLEAN)
    return predict.translate_test(rows, LOOKUP)


@query
def translate_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Chat records through the stub model, references kept."""
    records = tables.turn_pairs(spark, folder).select(
        "conv_id", "turn", chat.chat_messages(F.col("source"), F.col("target")).alias("messages")
    )
    return predict.translate_validation(records, LOOKUP)


@query
def clean_predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.predictions(spark, folder).select(
        "conv_id", "turn", tables.marked_output(F.col("prediction")).alias("prediction")
    )
    return predict.add_clean_predictions(rows).drop("prediction")


@query
def submission_table(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions that carry their id."""
    rows = tables.documents(spark, folder).select("doc_id", "text")
    carried = rows.select(F.col("doc_id").alias("text_id"), tables.marked_output(F.col("text")).alias("prediction"))
    return submission.submission(carried)


@query
def submission_file(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions taken in length order, put back in order of their ids, written as a submission and
    read back. Writes it when called."""
    place = scratch_path(spark, "submission.csv")
    rows = tables.documents(spark, folder).select("doc_id", "text")
    found = indexing.sort_by_length(rows, "text", "doc_id").select(
        F.col("doc_id").alias("id"), tables.marked_output(F.col("text")).alias("prediction")
    )
    writers.write_submission(submission.submission(indexing.restore_order(found, "id")), place, order_by="id")
    read = readers.read_csv(spark, place)
    columns.require_column(read, "translation")
    return read.select(F.col("id").cast("long"), "translation")


@query
def submission_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as predictions, joined by id with test rows of which some, negative ones, were not predicted."""
    own = tables.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    test = own.unionByName(tables.table(spark, folder, "part").select((-F.col("p_partkey") - 1).cast("long").alias("id")))
    found = tables.documents(spark, folder).select(F.col("doc_id").alias("id"), F.col("text").alias("prediction"))
    return submission.submission_by_key(test, found)


def _turn_id() -> Column:
    return F.concat_ws("-", "conv_id", "turn")


@query
def submission_by_position(spark: SparkSession, folder: str) -> DataFrame:
    """Answers paired with questions by position; questions beyond the answers get the empty prediction.
    Runs jobs when called."""
    turns = tables.conversations(spark, folder)
    order = (F.col("conv_id"), F.col("turn"))
    test = turns.filter("role = 'user'").select(_turn_id().alias("id"), "conv_id", "turn")
    found = turns.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    return submission.submission_by_position(test, found, test_order=order, prediction_order=order)


@query
def file_order_submission(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions in several files of unequal size, without ids, paired by their place in the files.
    Writes them when called."""
    place = scratch_path(spark, "unordered")
    rows = tables.table(spark, folder, "documents")
    for name, chosen in (("0", "doc_id < 10"), ("1", "doc_id >= 10 AND doc_id < 150"), ("2", "doc_id >= 150 AND doc_id < 153"), ("3", "doc_id >= 153")):
        writers.write_csv(rows.filter(chosen).orderBy("doc_id").select(F.col("text").alias("prediction")), f"{place}/{name}")
    found = readers.read_csv(spark, *[f"{place}/{name}" for name in "3102"], positions=True)
    test = rows.select(F.col("doc_id").alias("id"))
    return submission.submission_by_position(test, found, test_order=(F.col("id"),))


@query
def position_counts(spark: SparkSession, folder: str) -> DataFrame:
    turns = tables.table(spark, folder, "conversations")
    return submission.position_counts(turns.filter("role = 'user'"), turns.filter("role = 'assistant'"))


@query
def translate_and_submit(spark: SparkSession, folder: str) -> DataFrame:
    """Raw test rows to submission in one plan: clean, translate, clean the output, name the id."""
    raw = _raw_pairs(spark, folder).select(_turn_id().alias("id"), "Source")
    return submission.submission(predict.translate_test(corpus.clean_test(raw), LOOKUP))


# --- runs ---------------------------------------------------------------------------------------


@query
def run_names(spark: SparkSession, folder: str) -> DataFrame:
    """Run names from settings columns, defaults for missing ones."""
    parts = tables.table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit("Org/"), F.col("p_name"), F.when(F.col("p_size") > 25, "-Instruct-2507").otherwise("")).alias("model_name"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("lora_r"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 2).alias("lora_alpha"),
        F.when(F.col("p_size") % 3 == 0, "1e-4").alias("lr"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("epochs"),
    )
    name = runs.run_name(*[F.col(key) for key in ("model_name", "lora_r", "lora_alpha", "lr", "epochs")])
    return parts.select("p_partkey", name.alias("run_name"))


@query
def run_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Last-epoch scores written per run, read back, with the settings in the run name."""
    path = scratch_path(spark, "scores")
    writers.write_run_scores(last_epoch_scores(spark, folder), path)
    return runs.parse_run_name(readers.read_run_scores(spark, path))


@query
def best_run(spark: SparkSession, folder: str) -> DataFrame:
    """The best run of each epoch."""
    return runs.best_run(epoch_scores(spark, folder), "epoch")


@query
def ranked_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of each epoch, best first, with settings joined by run name."""
    scores = epoch_scores(spark, folder)
    settings = (
        tables.run_predictions(spark, folder).select("run").distinct()
        .withColumn("tag", F.regexp_extract("run", "_(r[0-9]+)-", 1))
    )
    ranked = runs.rank_runs(runs.with_settings(scores, settings), "epoch")
    return ranked.withColumn("place", F.col("place").cast("long"))


@query
def limited_translation(spark: SparkSession, folder: str) -> DataFrame:
    """Batch size and token limits read from a settings file, and questions translated under them.
    Writes the file when called."""
    place = scratch_path(spark, "limits")
    lines = ("model_name: Org/model", "inference_batch_size: 3", "max_seq_length: 40  # words of the stub", 'max_new_tokens: "12"')
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{place}/settings.yaml")
    options = predict.GenerationOptions.from_settings(readers.read_settings(spark, f"{place}/settings.yaml").first())
    rows = tables.turn_pairs(spark, folder).select("conv_id", "turn", "source")
    return predict.translate(rows, "source", predict.WordLookup(MEANINGS, limited=True), options, "conv_id", "turn").drop("source")


@query
def run_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Score documents and settings files of all runs, joined by the name that the settings give.
    Writes them when called, a file per run."""
    place = scratch_path(spark, "runs")
    scores = last_epoch_scores(spark, folder)
    for run in [row.run for row in tables.run_predictions(spark, folder).select("run").distinct().collect()]:
        writers.write_scores(scores.filter(F.col("run") == run).drop("run"), f"{place}/{run}/scores.json")
        rank = run.split("_r")[1].split("-")[0]
        lines = ("model_name: Org/model  # base", f"lora_r: {rank}", "lora_alpha: 32", "lr: 1e-4", "epochs: 4", 'sweep_dir: "sweeps/"')
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{place}/{run}/settings.yaml")
    settings = runs.identified(readers.read_settings(spark, f"{place}/*/settings.yaml"))
    joined = runs.with_settings(readers.read_scores(spark, place), settings.select("run", "folder", "lora_r"))
    return joined.select("run", "folder", "lora_r", "epoch", "bleu", "chrfpp", "geomean")


# --- context, lexicon, names and candidates at inference -------------------------------------------


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.documents(spark, folder)
    return rows.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


@query
def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with the two before and after them. Runs jobs when called."""
    found = context.with_context(tables.table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return found.select("conv_id", "turn", F.array_join("context_before", "\n").alias("lines_before"), F.array_join("context_after", "\n").alias("lines_after"))


@query
def context_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts for the lines of all documents, with three lines before and one after. Runs jobs when called."""
    found = context.with_context(_lines(spark, folder), "doc_id", "line", before=3, after=1)
    source = context.context_source(F.col("text"), F.col("context_before"), F.col("context_after"))
    return found.select("doc_id", "line", chat.ChatTemplate().render(chat.prompt_messages(source)).alias("prompt"))


def _lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words as lexicon entries: the items that hold a word are its meanings."""
    rows = tables.table(spark, folder, "benchmark").select("item_id", F.explode(text.words(F.col("text"))).alias("form"))
    kind = F.element_at(F.array(*map(F.lit, ("GN", "PN", "verb", "DN"))), (F.length("form") % 4 + 1).cast("int"))
    return rows.select("form", F.col("item_id").cast("string").alias("meaning"), kind.alias("type"), F.concat("form", F.lit("/"), F.col("item_id").cast("string")).alias("norm"))


@query
def lexicon_names(spark: SparkSession, folder: str) -> DataFrame:
    """One normal form for each name of the lexicon."""
    return lexicon.name_table(_lexicon(spark, folder))


@query
def lexicon_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with hints for their rare and ambiguous words. Runs a job when called."""
    rows = tables.documents(spark, folder).select("doc_id", "text")
    return lexicon.with_hints(rows, _lexicon(spark, folder), "doc_id", min_meanings=3).drop("text")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return tables.conversations(spark, folder).filter("role = 'assistant'")


@query
def capitalized_names(spark: SparkSession, folder: str) -> DataFrame:
    return names.capitalized(tables.documents(spark, folder))


def _forms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return names.capitalized(tables.documents(spark, folder)), names.capitalized(_answers(spark, folder))


@query
def fuzzy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the documents and of the answers that one edit makes equal."""
    return fuzzy.fuzzy_pairs(*_forms(spark, folder), "name", "name").withColumn("distance", F.col("distance").cast("long"))


@query
def fuzzy_names(spark: SparkSession, folder: str) -> DataFrame:
    """The one nearest name of the answers for names of the documents."""
    return fuzzy.fuzzy_table(*_forms(spark, folder), "name", "name").withColumn("distance", F.col("distance").cast("long"))


@query
def replaced_names(spark: SparkSession, folder: str) -> DataFrame:
    """The first word, and the first two words, of every turn as names; all turns with them marked. Runs a job when called."""
    rows = tables.conversations(spark, folder).select(_turn_id().alias("id"), "text")
    parts = names.tokens(F.col("text"))
    single = rows.select(F.get(parts, F.lit(0)).alias("name"), F.concat(F.lit("<"), F.get(parts, F.lit(0)), F.lit(">")).alias("canonical"))
    double = rows.filter(F.get(parts, F.lit(1)) == " ").select(
        F.concat(*[F.get(parts, F.lit(place)) for place in range(3)]).alias("name"),
        F.concat(F.lit("<"), F.get(parts, F.lit(0)), F.lit("_"), F.get(parts, F.lit(2)), F.lit(">")).alias("canonical"),
    )
    return names.replace_names(rows, single.unionByName(double), "id")


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of a conversation as candidates, as they are and with words changed."""
    answers = _answers(spark, folder).select("conv_id", "turn", "text")
    both = choice.pool(own=answers, changed=answers.withColumn("text", F.replace("text", F.lit("th"), F.lit("d"))))
    return both.withColumn("candidate", F.concat_ws("-", "origin", "turn"))


@query
def candidate_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return choice.agreement(_candidates(spark, folder), "conv_id", "candidate").withColumn("agreement", F.round("agreement", 6))


@query
def chosen_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate of each conversation that agrees most with the others."""
    return choice.choose(_candidates(spark, folder), "conv_id", "candidate").withColumn("agreement", F.round("agreement", 6))
