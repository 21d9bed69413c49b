"""Corpus BLEU: tokenizer, per-row counts and the closing formula.

BLEU is Papineni et al. 2002, with the tokenizer and conventions of Post 2018: mteval-13a
tokens, orders 1 to 4, exponential smoothing, case kept, one reference.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_spark.functions.ngrams import substitute, word_ngram_counts
from corpus_spark.functions.text import BLANKS, squeeze

MAX_ORDER = 4

# The public 13a tokenization rules, applied in this order. The first class lists the
# ASCII punctuation but ' , - . one by one, which Java looks up in a table, and leaves out the space
# the standard has in it: blanks around a space change no token, they only cost time.
UNESCAPE = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SPLIT_RULES = (
    (r"""([!"#$%&()*+/:;<=>?@\[\\\]^_`{|}~])""", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def _unescaped(text: Column) -> Column:
    """The text before the split rules, without blanks at its end; null is empty."""
    value = F.rtrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    value = F.replace(value, F.lit("<skipped>"), F.lit(""))
    value = F.replace(value, F.lit("-\n"), F.lit(""))
    value = F.replace(value, F.lit("\n"), F.lit(" "))
    for entity, char in UNESCAPE:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def tokenize_13a(text: Column) -> Column:
    """13a tokens joined by single spaces; null gives no token."""
    value = F.concat(F.lit(" "), _unescaped(text), F.lit(" "))
    for pattern, replacement in SPLIT_RULES:
        value = F.regexp_replace(value, pattern, replacement)
    return squeeze(value)


def _split(texts: pa.Array) -> pa.Array:
    return substitute(pc.binary_join_element_wise("", texts, "", " "), SPLIT_RULES)


def bleu_counts(hyp: Column, ref: Column) -> Column:
    """Flat ``[hyp, ref, match]`` per order 1..4; order 1 also holds the token counts.

    The tokens are those of ``tokenize_13a``. No rule looks at two blanks, so blanks are squeezed before the rules, which
    then run beside the counting.
    """
    return word_ngram_counts(squeeze(_unescaped(hyp)), squeeze(_unescaped(ref)), MAX_ORDER, _split)


def bleu_score(total: list[str], correct: list[str], sys_len: str, ref_len: str) -> Column:
    """BLEU, 0 to 100, of columns with summed counts, named per order.

    An order without a match gets 100 / (2^k total), k counting such orders; no match at all, or
    an order without n-grams, gives 0.
    """
    logs = []
    for order, (n_total, n_correct) in enumerate(zip(total, correct)):
        missed = " + ".join(f"int({name} = 0)" for name in correct[:order + 1])
        hits = f"IF({n_correct} > 0, double({n_correct}), pow(2D, -({missed})))"
        logs.append(f"ln(try_divide(100D * {hits}, {n_total}))")
    brevity = f"least(0D, 1D - try_divide({ref_len}, {sys_len}))"
    no_match = " AND ".join(f"{name} = 0" for name in correct)
    short = " OR ".join(f"{name} = 0" for name in total)
    return F.expr(
        f"CASE WHEN ({no_match}) OR {short} THEN 0D ELSE exp({brevity} + ({' + '.join(logs)}) / {len(total)}) END"
    )
