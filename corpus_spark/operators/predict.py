"""Batched application of a translation model to a column.

The model is behind a predictor: a factory that runs once per Python task and returns a function
from a list of prompts to a list of texts. Loading a model is the factory's business.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpus_spark.functions.chat import (
    SYSTEM_PROMPT,
    ChatTemplate,
    message_reference,
    message_source,
    prompt_messages,
)
from corpus_spark.functions.generation import EMPTY_PREDICTION, postprocess
from corpus_spark.functions.text import has_text
from corpus_spark.operators.columns import column, require_column
from corpus_spark.operators.indexing import sort_by_length


@dataclass(frozen=True)
class GenerationOptions:
    """Handed to the predictor factory; decoding is greedy, so outputs do not depend on batching."""

    batch_size: int = 8
    max_input_tokens: int = 2048
    max_new_tokens: int = 256

    @classmethod
    def from_settings(cls, settings: Row) -> GenerationOptions:
        """From one run's settings, defaults for what is not set there."""
        keys = {"batch_size": "inference_batch_size", "max_input_tokens": "max_seq_length", "max_new_tokens": "max_new_tokens"}
        found = {option: settings[key] for option, key in keys.items() if key in settings and settings[key] is not None}
        return cls(**{option: int(value) for option, value in found.items()})


Predictor = Callable[[list[str]], list[str]]
PredictorFactory = Callable[[GenerationOptions], Predictor]


@dataclass(frozen=True)
class WordLookup:
    """A predictor factory without a model: reads the user text out of the prompt and translates
    word by word from a small dictionary, keeping unknown words. Used to run the flow in tests. Where ``limited``
    its tokens are the words of the user text: it reads and writes as many as the options allow."""

    meanings: tuple[tuple[str, str], ...] = ()
    start: str = "<|im_start|>user\nTranslate: "
    end: str = "<|im_end|>"
    limited: bool = False

    def __call__(self, options: GenerationOptions) -> Predictor:
        meanings = dict(self.meanings)
        limit = min(options.max_input_tokens, options.max_new_tokens) if self.limited else None

        def predict(prompts: list[str]) -> list[str]:
            texts = [prompt.partition(self.start)[2].partition(self.end)[0] for prompt in prompts]
            words = [text.split(" ")[: limit] for text in texts]
            return [" ".join(meanings.get(word, word) for word in each) for each in words]

        return predict


def predict_column(prompt: Column, factory: PredictorFactory, options: GenerationOptions = GenerationOptions()) -> Column:
    """Apply a predictor in micro-batches of ``options.batch_size``; null prompts stay null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = factory(options)
        for batch in batches:
            prompts = batch.to_pylist()
            asked = [place for place, text in enumerate(prompts) if text is not None]
            answers: list[str | None] = [None] * len(prompts)
            for start in range(0, len(asked), options.batch_size):
                places = asked[start:start + options.batch_size]
                texts = predictor([prompts[place] for place in places])
                if len(texts) != len(places):
                    raise ValueError(f"The predictor gave {len(texts)} texts for {len(places)} prompts")
                for place, text in zip(places, texts):
                    answers[place] = text
            yield pa.array(answers, type=pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, StringType()).asNondeterministic()(prompt)


def translate(
    df: DataFrame,
    source: str,
    factory: PredictorFactory,
    options: GenerationOptions = GenerationOptions(),
    *tie: str,
    system_prompt: str = SYSTEM_PROMPT,
    template: ChatTemplate = ChatTemplate(),
    output: str = "prediction",
    global_length_order: bool = False,
) -> DataFrame:
    """Add a generated text per row; all other columns stay with their row.

    Batches hold texts of similar length. Sorting inside the partitions gives that without an
    exchange, and leaves short and long texts spread evenly over the tasks; the global order puts
    the longest texts together and is there for callers that want it. Blank sources are not sent
    to the model.
    """
    if global_length_order:
        if not tie:
            raise ValueError("A global length order needs a unique column that breaks ties")
        ordered = sort_by_length(df, source, *tie)
    else:
        ordered = df.sortWithinPartitions(F.length(column(source)), *[column(name) for name in tie])
    prompt = template.render(prompt_messages(column(source), system_prompt))
    asked = F.when(has_text(column(source)), prompt)
    return ordered.withColumn(output, predict_column(asked, factory, options)).withColumn(
        output, F.coalesce(output, F.lit(EMPTY_PREDICTION))
    )


def translate_validation(records: DataFrame, factory: PredictorFactory, options: GenerationOptions = GenerationOptions()) -> DataFrame:
    """Predictions for chat records: adds ``transliteration``, ``reference`` and ``prediction``."""
    messages = column(require_column(records, "messages"))
    texts = records.withColumns(
        {"transliteration": message_source(messages), "reference": message_reference(messages)}
    )
    return translate(texts.drop("messages"), "transliteration", factory, options)


def translate_test(test: DataFrame, factory: PredictorFactory, options: GenerationOptions = GenerationOptions()) -> DataFrame:
    """Predictions for a cleaned test table; ids and other columns stay with their row."""
    return translate(test, require_column(test, "transliteration_clean"), factory, options)


def add_clean_predictions(predictions: DataFrame) -> DataFrame:
    """Add ``prediction_clean``."""
    prediction = require_column(predictions, "prediction")
    return predictions.withColumn("prediction_clean", postprocess(column(prediction)))
