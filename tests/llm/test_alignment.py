"""Alignment of two tokenizers against the libraries and a plain restatement."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpus_spark.llm import alignment
from corpus_spark.llm.queries import op13_tokenizer_alignment
from corpus_spark.llm.token_counts import byte_letters

POOL = [
    " ", "  ", "a", "the", "é", "\n", "\n", "\t", "<s>", "<|endoftext|>", "中文", "ﬁ", "'s", " 's", "1234", "x y", "　", " ", ".", "!!",
    "𝒳", "͸", "\x85", "​", "<0x0A>", " z ", "\r\n", "\x1c",
]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {letter: byte for byte, letter in byte_letters().items()}

    def encode(text):
        """(id, bytes) of both libraries' tokens; none where their bytes are not the text's."""
        a = first.encode(" " + text, add_special_tokens=False)
        a = [(number, bytes(byte_of[letter] for letter in token)) for number, token in zip(a.ids, a.tokens)]
        b = [(number, second.id_to_piece(number)) for number in second.encode(text)]
        b = [(number, bytes([int(piece[3:5], 16)]) if second.is_byte(number) else piece.replace("▁", " ").encode()) for number, piece in b]
        whole = (" " + text).encode()
        return (a, b) if text and whole == b"".join(x for _, x in a) == b"".join(x for _, x in b) else ([], [])

    return encode


def placed(tokens):
    found, start = [], 0
    for number, own in tokens:
        found.append((number, start, start + len(own)))
        start += len(own)
    return found


def plain(texts, encode):
    """Rows of the query, by comparing every token with every other."""
    rows, links, shown = [], [], []
    for text in texts:
        a, b = map(placed, encode(text or ""))
        ends = sorted({stop for _, _, stop in a} & {stop for _, _, stop in b})
        groups = []
        for start, stop in zip([0, *ends], ends):
            sides = [",".join(str(number) for number, low, high in side if start <= low and high <= stop) for side in (a, b)]
            groups.append("|".join(sides))
        rows.append((len(a), len(b), len(groups)))
        shown.append(";".join(groups))
        links.append([(x, y) for x, low, high in a for y, start, stop in b if low < stop and start < high])
    counts = Counter(link for own in links for link in own)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    found = []
    for sizes, own, groups in zip(rows, links, shown):
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        found.append((*sizes, len(own), sum(counts[link] == most[link[1]] for link in own), sum(counts[link] for link in own), digest))
    return found, shown


def texts_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(1, 25))) for _ in range(n)] + [None, "", " ", "  ", "x▁y", "the the the", "the the the"]


@pytest.mark.parametrize("part_chars", [1, 9, 1 << 16])
def test_groups_equal_the_libraries(libraries, part_chars):
    aligner = alignment.Aligner(part_chars=part_chars)
    texts = texts_of(part_chars, 700)
    assert [aligner.groups(text) for text in texts] == plain(texts, libraries)[1]
    long = "word, wörd\n  other x　y " * 3000
    assert aligner.groups(long) == alignment.Aligner(part_chars=1 << 30).groups(long)


@pytest.mark.parametrize("slice_bytes,known", [(1, 1), (300, 50), (8 << 20, 400_000)])
def test_scores_equal_plain(spark, libraries, monkeypatch, slice_bytes, known):
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(alignment, "KNOWN", known)
    texts = texts_of(7, 150)
    ids = [None if place % 29 == 0 else place // 2 for place in range(len(texts))]
    rows = [(i, text, 1) for i, text in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_best int").repartition(3)
    got = [tuple(row) for row in alignment.alignment_scores(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, *row) for i, row in zip(ids, plain(texts, libraries)[0])), key=repr)
    assert alignment.alignment_scores(df.limit(0)).count() == 0
    named = alignment.align(df.withColumn("Groups", df.text))
    assert named.columns == ["doc_id", "text", "N_best", "groups"]
    assert sorted(row.groups for row in named.collect()) == sorted(plain(texts, libraries)[1])


def test_query_equals_plain(spark, libraries, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = [row.text if len(row.text or "") < 4000 else None for row in rows]
    df = spark.createDataFrame([(row.doc_id, text) for row, text in zip(rows, texts)], "doc_id string, text string")
    want = sorted((str(row.doc_id), *found) for row, found in zip(rows, plain(texts, libraries)[0]))
    assert sorted(map(tuple, alignment.alignment_scores(df).collect())) == want
    whole = op13_tokenizer_alignment(spark, small_dir).collect()
    assert len(whole) == len(rows) and [field for field in whole[0].asDict()] == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
    ]
    assert all(row.n_links == row.n_a + row.n_b - row.n_groups and row.n_best <= row.n_links <= row.count_sum for row in whole)
