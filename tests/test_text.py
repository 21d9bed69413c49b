import random
import re
import sys
import time
import unicodedata

import pyarrow as pa
import pytest
from plain import chrf_words, clean_source, collapse_repeats, postprocess, squeeze, tokens_13a
from pyspark.sql import functions as F

from corpus_spark.functions import bleu, chrf, generation, ngrams, source_text, text, unicode

CLEAN_CASES = {
    "[KÙ.BABBAR]": "KÙ.BABBAR",
    "Ḫa-bu-wa-al": "Ha-bu-wa-al",
    "˹ša˺": "ša",
    "ù / šu-ma": "ù šu-ma",
    "[x]": "<gap>",
    "[... ...]": "<big_gap>",
    "a-lim{ki}": "a-lim{ki}",
    "": "",
    "  ": "",
    "[...]": "...",
    "[....]": "....",
    "[.....]": "<big_gap>",
    "[x x x]": "<gap>",
    "a<gap>b": "agapb",
    "<<x>>y": "y",
    "a<b>c": "abc",
    "a!b?": "ab",
    "a₁₀ b⁴": "a10 b4",
    "a:b": "a b",
    "1. a": "a",
    "r. 1. a": "a",
    "r. 1 a": "r. 1 a",
    "1' a": "1' a",
    "rev 2'. a": "a",
    "1.5 ma-na": "5 ma-na",
    " 1. a": "1. a",
    "1. 2. a": "2. a",
    "obv.1. a": "obv.1. a",
    "lo.e. 3. a": "a",
    "u.e 3′. a": "a",
    "é": "é",
    "a b": "a b",
    "ḫ̣": "ḥ",
    None: "",
}

POST_CASES = {
    None: "...",
    "": "...",
    "   ": "...",
    "<|im_start|>hello": "hello",
    "<|a\nb|>c": "<|a b|>c",
    "<think>a\nb</think>c": "c",
    "<think>open": "<think>open",
    "a b c a b c": "a b c",
    "a b c a b c a b c": "a b c a b c",
    "a b c " * 4: "a b c a b c",
    "a b a b": "a b a b",
    "a a a a a a": "a a a",
    "aa b c a b c": "aa b c a b c",
    "a b c a b cd": "a b c a b cd",
    "x. $1 \\2 x. $1 \\2": "x. $1 \\2",
}


def noise(seed, count, alphabet, longest=40):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, longest))) for _ in range(count)]


CLEAN_ALPHABET = [
    "a", "x", "x", "o", "r", "rev", "lo.e.", "1", "2", ".", "...", "[", "]", "[", "]", "<", ">", "<<", ">>", " ", " ",
    "\n", "\r", "\t", "/", ":", "!", "?", "ḫ", "Ḫ", "˹", "˺", "₁", "⁴", "²", "'", "′", "́", "e", "٣", "\u0085",
    " ", "\u001c", " ", "$", "\\", "[x x]", "[... ...]", "\U0001d15e", "Å", "한"[:1],
]


@pytest.mark.parametrize("cleaner", [source_text.clean_source, source_text.clean_source_stepwise])
def test_clean_source_cases(apply, cleaner):
    assert apply(cleaner, CLEAN_CASES) == list(CLEAN_CASES.values())


def test_clean_source_matches_plain(apply):
    values = noise(1, 4000, CLEAN_ALPHABET)
    expected = [clean_source(value) for value in values]
    assert sum(value != result for value, result in zip(values, expected)) > 3000
    assert apply(source_text.clean_source, values) == expected
    assert apply(source_text.clean_source_stepwise, values) == expected


def test_clean_target(apply):
    values = [None, "", " \t", " a \n b ", "x"]
    assert apply(source_text.clean_target, values) == ["", "", "", "a b", "x"]


def test_blanks_are_python_blanks(apply):
    points = [chr(point) for point in range(1, 0x3100)]
    blank = apply(text.is_blank, points)
    assert [c for c, is_blank in zip(points, blank) if is_blank] == [c for c in points if c.isspace()]
    assert apply(text.is_blank, [None, "", " a"]) == [True, True, False]


def test_words_and_join(apply):
    values = ["", "  ", "a", " a\tb\n c "]
    assert apply(text.words, values) == [value.split() for value in values]
    assert apply(lambda c: text.join_words(text.words(c)), values) == [squeeze(value) for value in values]


def test_prefix(apply):
    values = ["Translate: a", "Translate:a", "x Translate: a", "Translate: Translate: a", None]
    assert apply(lambda c: text.strip_prefix(c, "Translate: "), values) == [
        "a", "Translate:a", "x Translate: a", "Translate: a", None,
    ]


def test_length_counts_code_points(apply):
    assert apply(text.code_points, ["", "é", "é", "\U0001f600"]) == [0, 1, 2, 1]


def test_stable_ranges_are_stable():
    """No character of the ranges that skip the function changes under NFC, alone or beside another."""
    python_class = re.sub(r"\\x\{(\w+)\}", lambda point: f"\\U{int(point[1], 16):08x}", unicode.UNSTABLE)
    points = [point for point in range(sys.maxunicode + 1) if not re.match(python_class, chr(point))]
    assert points == [*range(0x300), *range(0x1E00, 0x1F00), *range(0x2002, 0x20D0)]
    for point in points:
        char = chr(point)
        assert unicodedata.normalize("NFC", char) == char
        assert unicodedata.combining(char) == 0
    seconds = set()
    for point in range(sys.maxunicode + 1):
        pair = unicodedata.decomposition(chr(point))
        if pair and not pair.startswith("<") and " " in pair:
            seconds.add(int(pair.split()[-1], 16))
    assert not seconds & set(points)


def test_nfc(apply):
    values = noise(2, 500, ["a", "e", "́", "̣", "ḫ", "Å", "ᄀ", "ᅡ", "ᆨ", "क़", " "], 12)
    assert apply(unicode.nfc, [*values, None]) == [*[unicodedata.normalize("NFC", value) for value in values], None]


def test_nfc_runs_once_under_a_filter(spark):
    rows = spark.createDataFrame([("é",)], "t string").select(unicode.nfc(F.col("t")).alias("n"))
    plan = rows.filter("length(n) > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_postprocess_cases(apply):
    assert apply(generation.postprocess, POST_CASES) == list(POST_CASES.values())


def test_collapse_repeats_matches_plain(apply):
    pick = random.Random(3)
    values = []
    for _ in range(1500):
        words = [pick.choice(["a", "b", "c", "aa", "a.", "é"]) for _ in range(pick.randint(0, 12))]
        for _ in range(pick.randint(0, 3)):
            at, size = pick.randint(0, len(words)), pick.randint(1, 12)
            words[at:at] = words[max(0, at - size):at] * pick.randint(1, 3)
        values.append(" ".join(words))
    expected = [" ".join(collapse_repeats(value.split())) for value in values]
    assert sum(value != result for value, result in zip(values, expected)) > 300
    assert apply(generation.collapse_repeats, values) == expected


def test_collapse_repeats_on_a_long_text(apply):
    pick = random.Random(4)
    words = [pick.choice("abcdefgh") for _ in range(30000)] + ["w" * 50000]
    assert apply(generation.collapse_repeats, [" ".join(words)]) == [" ".join(collapse_repeats(words))]


def test_postprocess_matches_plain(apply):
    values = noise(5, 1500, ["a", "b ", "c ", " ", "\n", "<|", "|>", "<think>", "</think>", "<", "|", ">"], 30)
    assert apply(generation.postprocess, values) == [postprocess(value) for value in values]


def test_tokenize_13a(apply):
    values = noise(6, 1500, [*"aZ09.,-'\"&;<>()[]{}`^_~/\\!? \n\t", "&quot;", "&amp;", "&lt;", "&amp;lt;", "<skipped>", "-\n", "é", " "], 30)
    assert [value.split() for value in apply(bleu.tokenize_13a, values)] == [tokens_13a(value) for value in values]
    assert apply(bleu.tokenize_13a, [None]) == [""]


def test_counted_tokens_are_the_tokens(spark, apply):
    """The rules run beside the counting give the tokens of the columns, on blanks, marks and characters of all lengths."""
    values = noise(12, 3000, ["a", "5", "é", "\U0001f600", ".", ",", "..", "-", "-\n", "\n", " ", " \u2003", "\x1c", "\x85", "&amp;", "&lt;", "<skipped>", *"!\"#$%'()*+/:;=?@[\\]^_`{|}~"], 14)
    for function, split, first in ((bleu.tokenize_13a, bleu._split, bleu._unescaped), (chrf.split_punctuation, chrf._split, lambda value: value)):
        prepared = pa.array(apply(lambda value: text.squeeze(first(value)), values))
        assert [value.split(" ") if value else [] for value in apply(function, values)] == [[word for word in value.split(" ") if word] for value in split(prepared).to_pylist()]


def test_counting_reads_texts_with_few_patterns(spark):
    """One pattern per text squeezes blanks; the split rules run beside the counting, and repeats are found without a back-reference."""
    for column in (bleu.bleu_counts(F.lit("a"), F.lit("b")), chrf.chrf_char_counts(F.lit("a"), F.lit("b")), chrf.chrf_word_counts(F.lit("a"), F.lit("b"))):
        assert column._jc.toString().count("regexp_replace") == 2
    assert generation.collapse_repeats(F.lit("a"))._jc.toString().count("regexp_replace") == 1


def test_collapse_repeats_of_nulls_and_many_chunks(apply, monkeypatch):
    monkeypatch.setattr(ngrams, "_CHUNK_BYTES", 40)
    values = ["x y z x y z", None, "", " ", None, "a b c d a b c d a b c d", "a b a b", "é ñ\tō  é ñ ō é ñ ō", None] * 20
    assert apply(generation.collapse_repeats, values) == [None if value is None else " ".join(collapse_repeats(value.split())) for value in values]
    assert apply(generation.collapse_repeats, [None]) == [None]


def test_split_punctuation(apply):
    values = noise(7, 1500, [*"ab.,-'\"()$\\[]^ ", "é", "…"], 20) + ["(hi)", "a", ".", "..", "(a", ""]
    assert [value.split() for value in apply(chrf.split_punctuation, values)] == [chrf_words(value) for value in values]


@pytest.mark.parametrize(
    "function,text",
    [
        (generation.strip_thinking, "<think>" * 100_000),
        (generation.strip_template_tokens, "<|" * 100_000),
        (source_text.drop_double_angles, "<<" * 100_000),
        (bleu.tokenize_13a, "a" + " " * 100_000 + "a"),
    ],
)
def test_cleaners_are_linear(spark, function, text):
    rows = spark.createDataFrame([(text,)], "text string").cache()
    rows.count()
    start = time.perf_counter()
    rows.select(F.length(function(F.col("text")))).collect()
    assert time.perf_counter() - start < 3


def test_spans_are_dropped_as_a_lazy_regex_does(apply):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["<<", ">>", "<", ">", "a", "\n", "<|", "|>", "<think>", "</think>"]) for _ in range(rng.randrange(12))) for _ in range(800)]
    assert apply(source_text.drop_double_angles, [*texts, None]) == [*[re.sub("<<[^\n]*?>>", "", text) for text in texts], None]
    assert apply(generation.strip_template_tokens, texts) == [re.sub(r"<\|[^\n]*?\|>", "", text) for text in texts]
    assert apply(generation.strip_thinking, [*texts, None]) == [*[re.sub(r"(?s)<think>.*?</think>", "", text) for text in texts], None]


def test_blanks_are_the_blank_class(spark):
    rows = spark.createDataFrame([(chr(code),) for code in range(0x10000) if not 0xD800 <= code < 0xE000], "c string")
    assert "".join(sorted(row.c for row in rows.filter(F.col("c").rlike(text.WS)).collect())) == text.BLANKS
