"""Token counts and byte-level BPE against the libraries on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpus_spark.llm import byte_bpe, token_counts
from corpus_spark.llm.queries import op1_token_counts, op5_byte_bpe

ALPHABETS = (
    "abc def's ll'r e've \n\t  1234 ,.!'",
    "äöü ßéñ 東京は 12  　'  ",
    "a",
    " ",
    "'rl ves!",
    "<|endoftext|> x",
    "x᠎​\x1c\x85 ՘y ",
)


def texts(seed, count=60, longest=400):
    rng = random.Random(seed)
    found = ["", " ", "<|endoftext|>", "a" * 500, " " * 300, "it's " * 90]
    for _ in range(count):
        letters = rng.choice(ALPHABETS)
        found.append("".join(rng.choice(letters) for _ in range(rng.randrange(longest))))
        words = ["the", " of", "'re", "<|endoftext|>", "\n\n", "  ", "ciónes", "!!", "42", "<|endof"]
        found.append("".join(rng.choice(words) for _ in range(rng.randrange(80))))
    return found


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk,overlap", [(7, 1), (20, 5), (33, 40), (100, 16), (10_000, 10)])
def test_spliced_counts_equal_the_library(library, chunk, overlap):
    counter = token_counts.Counter(token_counts.VOCABULARY, chunk, overlap)
    for text in texts(chunk):
        assert counter(text) == len(library.encode(text, add_special_tokens=False)), text


def test_classes_of_characters_agree_where_they_are_trusted(library):
    counter = token_counts.Counter(token_counts.VOCABULARY)
    trusted = [chr(c) for c in range(0x110000) if counter.classed(chr(c))]
    for start in range(0, len(trusted), 2000):
        text = "".join(f"a{c}a1{c}1!{c}!  {c}" for c in trusted[start : start + 2000])
        assert counter.short(text) == len(library.encode(text, add_special_tokens=False))


@pytest.mark.parametrize("leaf,window", [(2, 1), (9, 4), (50, 64), (8192, 64)])
def test_tree_equals_the_library(leaf, window):
    encoding = byte_bpe.load_encoding(byte_bpe.VOCABULARY)
    tree = byte_bpe.Tree(encoding, leaf, window)
    for text in texts(leaf):
        ids = tree.encode(text)
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


def test_join_is_associative():
    encoding = byte_bpe.load_encoding(byte_bpe.VOCABULARY)
    tree = byte_bpe.Tree(encoding, 4, 2)
    rng = random.Random(5)
    for text in texts(8, 30):
        a, b = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        x, y, z = text[:a], text[a:b], text[b:]
        ex, ey, ez = map(tree.encode, (x, y, z))
        one = tree.join(x + y, tree.join(x, ex, y, ey), z, ez)
        other = tree.join(x, ex, y + z, tree.join(y, ey, z, ez))
        assert np.array_equal(one, other)


def test_frames_with_nulls_and_clashing_names(spark):
    rows = [(1, None, 7), (1, None, 7), (None, "it's  <|endoftext|>", 8), (2, "word " * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int")
    counted = token_counts.count_tokens(df)
    assert counted.columns == ["doc_id", "text", "n_tokens"]
    assert sorted(row.n_tokens for row in counted.collect()) == [0, 0, 5, 20001]
    encoded = byte_bpe.decode_ids(byte_bpe.encode_texts(df)).collect()
    assert [bytes(row.decoded).decode() for row in encoded] == [row[1] or "" for row in rows]
    empty = df.limit(0)
    assert token_counts.count_tokens(empty).count() == 0
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(empty)).count() == 0


def test_queries_equal_the_libraries(spark, small_dir, library):
    read = {row.doc_id: row.text or "" for row in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    counted = op1_token_counts(spark, small_dir).collect()
    assert len(counted) == len(read)
    for row in counted:
        n_tokens = len(library.encode(read[row.doc_id], add_special_tokens=False))
        assert tuple(row) == (row.doc_id, len(read[row.doc_id].encode()), n_tokens, n_tokens > 1024)
    encoding = byte_bpe.load_encoding(byte_bpe.VOCABULARY)
    found = op5_byte_bpe(spark, small_dir).collect()
    assert len(found) == len(read)
    for row in found:
        ids = encoding.encode_ordinary(read[row.doc_id])
        digest = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert tuple(row) == (row.doc_id, len(ids), digest, hashlib.sha256(read[row.doc_id].encode()).hexdigest())
