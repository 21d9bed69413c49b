"""Columns of any name pass through the operators that keep the columns of their frame."""

import inspect
import re

import pytest
from pyspark.sql import functions as F

from corpus_spark.llm import alignment, byte_bpe, decontaminate, licenses, line_dedup, scratch, simhash, substring_dedup, token_counts, toxicity, url_filter

TEXTS = ["one text of some words\nwith a second line", "MIT License", "one text of some words\nwith a second line", "", None]


def toxic_model(df):
    return toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))


# What each operator adds, and how it is called.
OPERATORS = {
    token_counts: [(("n_tokens",), token_counts.count_tokens)],
    byte_bpe: [(("token_ids", "n_tokens"), byte_bpe.encode_texts)],
    substring_dedup: [(("kept_text", "n_words", "n_shared", "n_removed", "removed"), substring_dedup.dedup_units)],
    licenses: [(("notices", "n_words"), licenses.scan)],
    line_dedup: [(("kept_text", "n_lines", "n_dropped"), line_dedup.dedup_lines)],
    toxicity: [(("toxicity",), lambda df: toxicity.toxicity(df, toxic_model(df))), ((), lambda df: toxicity.without_toxic(df, toxic_model(df)))],
    simhash: [((), simhash.one_of_each)],
    decontaminate: [((), lambda df: decontaminate.without_matches(df, df.select(F.lit("i").alias("item_id"), F.lit("no such words").alias("text"))))],
    url_filter: [(("host", "path", "rule", "verdict", "score"), lambda df: url_filter.judge(df, "text")), ((), lambda df: url_filter.allowed(df, "text"))],
    alignment: [(("groups",), alignment.align)],
}


@pytest.mark.parametrize("module", list(OPERATORS), ids=lambda module: module.__name__.rsplit(".", 1)[1])
def test_columns_pass_through(spark, module):
    for added, run in OPERATORS[module]:
        # Every word between quotes in the module, which all working columns are among.
        words = {word.lower() for source in (module, scratch) for word in re.findall(r"""["']([A-Za-z_]\w*)["']""", inspect.getsource(source))}
        names = sorted(words - {"doc_id", "text", *added})[:120]
        rows = [(doc, text, *range(len(names))) for doc, text in enumerate(TEXTS)]
        df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{name}` int" for name in names))
        found = run(df)
        assert found.columns == [*df.columns, *added]
        for row in found.collect():
            assert row.text == TEXTS[row.doc_id] and [row[name] for name in names] == list(range(len(names)))
