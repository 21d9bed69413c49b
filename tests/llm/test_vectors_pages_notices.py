"""Top-k, archives and licence notices against plain restatements."""

import gzip
import hashlib
import math
import random
import re

import pytest

import check_queries
from corpus_spark.llm import licenses, top_k, warc
from corpus_spark.llm.queries import op7_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op6_warc", "op8_top_k"])
def test_query_equals_sql(spark, small_dir, name):
    good, note = check_queries.compare(spark, check_queries.connect(small_dir), small_dir, name)
    assert good, note


# Top-k


@pytest.mark.parametrize("block,most", [(4, 3), (1000, 1000)])
def test_top_k_equals_brute_force(spark, block, most):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.1, 1, 5]) for _ in range(6)]) for i in range(-40, 60)]
    rows += [(i, [1.0, -2.0, 0.5, 0.0, 0.0, 0.0]) for i in range(60, 70)] + [(61, [1.0, -2.0, 0.5, 0.0, 0.0, 0.0]), (20, rows[3][1])]
    rows += [(100, None), (120, [1.0, None]), (140, [1.0, math.nan]), (160, [math.inf]), (None, [1.0] * 6), (180, []), (200, [9.0]), (220, [0.0] * 6)]
    df = spark.createDataFrame([(*row, 1) for row in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, top_k.top_k(df, lambda i: i % 20 == 0, k=5, block=block, most=most).collect()))
    read = [(r.vec_id, r.embedding) for r in df.collect()]
    sound = [
        (i, [math.floor(64 * x) for x in v]) for i, v in read
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = []
    for i, q in sorted({(i, tuple(v)) for i, v in sound if i % 20 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i)[:5]
        want += [(i, rank, j, -score) for rank, (score, j) in enumerate(scores, 1)]
    assert got == sorted(want)
    assert top_k.top_k(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_scores_beyond_whole_numbers_are_refused(spark):
    df = spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        top_k.top_k(df, lambda i: i % 20 == 0)


# Archives


def test_archives_round_trip(spark, tmp_path):
    body = "<p>" + "ü\n\r\n\r\nWARC/1.1\n" * 20
    rows = [(i, f"http://www.Example.org:80{'/x' * (i % 3)}?q={i}#f", body if i % 3 else f"page {i}") for i in range(40)]
    rows += [(50, None, body), (51, "not a url", None), (52, "http://[bad", ""), (53, "http://a.b/ü\nx", "z" * 99), (54, "http://a.b/ü\nx", "z" * 99)]
    rows += [(None, "http://n.org/", body), (60, "http://d.org/", "d" * 300), (60, "http://d.org/", "d" * 300), (61, "http://d.org/", "d" * 300_000)]
    pages = spark.createDataFrame([(*row, "x") for row in rows], "page_id long, url string, html string, Payload string")
    read = warc.archived(pages, archive_bytes=500, block_entries=3).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 100 and page != min(same)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None, b"" if revisit else data))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in read]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.archived(pages.limit(0)).count() == 0
    # The files are gzip members that any reader opens.
    warc.write_archives(pages, str(tmp_path / "out"))
    data = b"".join(gzip.open(path).read() for path in sorted((tmp_path / "out").glob("part-*")))
    assert data.count(b"WARC-Record-ID: ") == len(rows)


def test_look_up_reads_single_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://h{i % 7}.example.com/{i}", f"body {i}") for i in range(200)], "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archives(pages, path, archive_bytes=400)
    blocks, directory = warc.build_index(warc.capture_entries(spark, path), block_entries=7)
    assert directory.count() >= 200 / 7
    for row in blocks.collect():
        keys = [line.split(b"\t")[0] for line in warc.zlib.decompress(row.entries).split(b"\n")]
        assert keys == sorted(keys) and bytes.fromhex(keys[0].decode()) == row.first
    asked = [warc.entry_key(f"https://h{i % 7}.example.com/{i}", i) for i in (0, 13, 199)] + [b"zz", b"", b"com,example,h1)/"]
    found = warc.look_up(spark.createDataFrame([(key,) for key in asked * 2], "key binary"), blocks, directory)
    assert sorted(bytes(r.payload) for r in warc.read_ranges(spark, path, found).collect()) == [b"body 0", b"body 13", b"body 199"]


def test_url_keys():
    assert warc.url_key("https://user@www.A.Example.org:8080/P?q=1#f") == b"org,example,a:8080)/P?q=1"
    assert warc.url_key(None) == b")/" and warc.url_key("http://[x") == b")http://[x"


# Licence notices


def plain_scan(texts, templates=licenses.TEMPLATES, min_share=licenses.MIN_SHARE):
    found = [WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) for text in texts]
    known = {word for template in templates for word in template.words.split()}
    weight = {word: math.log((len(found) + 2) / (sum(word in words for words in map(set, found)) + 1)) for word in known}
    out = []
    for words in found:
        notices = []
        for number, template in enumerate(templates):
            parts, key = template.words.split(), template.key.split()
            offset = template.words.split(template.key)[0].count(" ")
            for at in range(len(words)):
                if words[at : at + len(key)] == key:
                    start = at - offset
                    held = sum(weight[p] for i, p in enumerate(parts) if 0 <= start + i < len(words) and words[start + i] == p)
                    share = held / sum(weight[p] for p in parts)
                    if template.base or share >= min_share:
                        notices.append((number, template.label, template.base, start, round(min(1.0, share), 9)))
        out.append((len(words), sorted(notices)))
    return out


def test_scan_equals_plain(spark):
    rng = random.Random(3)
    parts = ["GNU General Public License", "mit", "license", "by", "cc", "Apache", "cc-by-NC 4.0", "Licensed under", "x", "ß", "the Apache License, Version 2.0"]
    parts += [t.words for t in licenses.TEMPLATES] + ["gnu gnu general public license", "MİT License", "cc\x00by", "licenses"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(150)] + [None, "", "...", "MIT License", "MIT License"]
    texts.append("filler words " * 20000 + "cc by")
    df = spark.createDataFrame([(i, text, 5) for i, text in enumerate(texts)], "doc_id long, text string, N_Words int")
    found = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (n_words, notices) in enumerate(plain_scan(texts)):
        got = sorted((n.template, n.label, n.base, n.start, round(n.share, 9)) for n in found[i].notices)
        assert (found[i].n_words, got) == (n_words, notices), texts[i]
    assert licenses.scan(df.limit(0)).count() == 0


def test_scan_runs_no_python(spark, small_dir):
    plan = op7_license_scan(spark, small_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_license_query_equals_plain(spark, small_dir):
    read = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect())
    want = []
    for (doc, _), (n_words, notices) in zip(read, plain_scan([text for _, text in read])):
        base = [n for n in notices if n[2]]
        starts = [n[3] for n in base] or [None]
        names = [",".join(sorted({n[1] for n in each})) for each in (base, notices)]
        want.append((doc, n_words, len(base), starts and min(starts), max(starts), *names, max([n[4] for n in notices] or [0.0])))
    got = [(*tuple(r)[:-1], round(r.score, 9)) for r in op7_license_scan(spark, small_dir).orderBy("doc_id").collect()]
    assert got == want
    assert any(row[2] for row in got)
