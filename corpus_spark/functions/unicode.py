"""Unicode NFC normalisation, the one text step Spark has no expression for."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# All code points but those NFC never changes and that never join a neighbour: Latin up to U+02FF,
# Latin Extended Additional, and the punctuation, sub- and superscript blocks up to the currency
# signs. A text without a code point of this class is in NFC (the tests walk the blocks left out).
# Written as ranges, not as a negated class, which Java's matcher takes ten times as long over.
UNSTABLE = r"[\x{300}-\x{1dff}\x{1f00}-\x{2001}\x{20d0}-\x{10ffff}]"


def needs_nfc(text: Column) -> Column:
    """True where a text holds a character outside the blocks NFC leaves alone."""
    return text.rlike(UNSTABLE)


@F.arrow_udf(StringType())
def _compose(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if text is None else unicodedata.normalize("NFC", text) for text in texts.to_pylist()],
        type=pa.string(),
    )


# Nondeterministic keeps the optimizer from evaluating the function a second time in a pushed-down filter.
_compose = _compose.asNondeterministic()


def nfc(text: Column) -> Column:
    """NFC form. Texts that are in NFC by their character ranges never leave the JVM."""
    return F.coalesce(_compose(F.when(needs_nfc(text), text)), text)
