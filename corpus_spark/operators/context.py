"""Lines with the lines around them, for prompts that show a document's context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_spark.operators.columns import column
from corpus_spark.operators.indexing import POSITION, with_row_index

# Lines of a document that one window partition holds, besides its neighbours' edges.
RANGE_ROWS = 1 << 16


def with_context(
    lines: DataFrame, document: str, *order_by: str, text: str = "text", before: int = 2, after: int = 2,
    context_before: str = "context_before", context_after: str = "context_after", range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Each line with the ``before`` lines before it and the ``after`` lines after it in its document, as arrays in order.

    The order columns must tell the lines of a document apart. A null line is an empty one, null
    documents are one document, and at the ends of a document there are fewer lines. Columns already named as the new
    ones are replaced.

    Lines are numbered over all documents once, and the numbers cut into ranges of ``range_rows``. A window runs
    inside one document and one range, and a range has copies of the lines at its neighbours' edges, as many as a
    window reaches. So a document of any length is many tasks, and none holds more than a range and its
    edges. All columns are staged.
    """
    reach = max(before, after)
    size = max(range_rows, reach, 1)
    taken = {context_before.lower(), context_after.lower()}
    kept = [name for name in lines.columns if name.lower() not in taken]
    if text.lower() in taken:
        raise ValueError(f"column {text} is read, so it cannot be written too")
    rows = lines.select(F.struct(*map(column, kept)).alias("row"), column(document).alias("document"), *[column(name).alias(f"order{n}") for n, name in enumerate(order_by)])
    placed = with_row_index(rows, F.col("document"), *[F.col(f"order{n}") for n in range(len(order_by))], name="place")
    own = F.floor(F.col("place") / size)
    inside = F.pmod("place", F.lit(size))
    # A line near the edge of its range stands in the neighbouring range too.
    ranges = F.array_compact(F.array(own, F.when((inside < after) & (own > 0), own - 1), F.when(inside >= size - before, own + 1)))
    copies = placed.select("row", "document", "place", own.alias("own"), F.explode(ranges).alias("range"))
    line = F.coalesce(F.col("row").getField(text), F.lit(""))
    around = Window.partitionBy("document", "range").orderBy("place")
    found = copies.withColumns({
        "lines_before": F.collect_list(line).over(around.rowsBetween(-before, -1)) if before else _no_lines(),
        "lines_after": F.collect_list(line).over(around.rowsBetween(1, after)) if after else _no_lines(),
    }).filter("range = own")
    return found.select(
        *[F.col("row").getField(name).alias(name) for name in kept], F.col("lines_before").alias(context_before), F.col("lines_after").alias(context_after),
    ).drop(POSITION)


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def context_source(source: Column, lines_before: Column, lines_after: Column) -> Column:
    """The user text of a prompt that shows the lines around the one to translate; lines that are not there are left out."""
    def shown(label: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"[{label}: "), F.array_join(lines, "\n"), F.lit("]")))

    return F.concat_ws(
        "\n", shown("Preceding lines", lines_before), F.concat(F.lit("Translate this sentence: "), F.coalesce(source, F.lit(""))), shown("Following lines", lines_after),
    )
