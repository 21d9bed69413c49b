"""WARC archives of pages, and a two-level capture index to read single records from them.

Records are gzip members, one after the other, written by Spark's own text sink: its committer keeps
what finished tasks wrote and nothing of lost ones, on any file system that Spark can write to. The
sink ends each row with a separator, which is set to an empty gzip member, so the files are plain
``.warc.gz`` content.

The index is made from the archives. Its entries, a reversed-host URL key with the record's archive,
offset and length, are sorted and packed into compressed blocks; a directory keeps the first key of
each block. A look-up searches the directory by bisection, opens one block, searches that by
bisection, and reads the record's range.
"""

from __future__ import annotations

import gzip
import re
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm.arrow import map_arrow
from corpus_spark.llm.scratch import written
from corpus_spark.session import scratch_path

# Payloads shorter than this are always stored.
MIN_REVISIT_BYTES = 100
# Uncompressed payload in an archive, about; a whole archive is one row when it is read.
ARCHIVE_BYTES = 16 << 20
# Entries in an index block at least; more where the directory would outgrow its bound.
BLOCK_ENTRIES = 3000
DIRECTORY_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
# An empty gzip member.
SEPARATOR = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
END = b"\r\n\r\n"

RECORDS = "page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, payload binary"
ENTRIES = "key binary, archive string, offset long, length long"


def url_key(url: str | None) -> bytes:
    """Host names reversed, lower case, without scheme, user, ``www.`` and fragment: ``org,example)/a?b``."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return b")" + (url or "").encode()
    names = [name for name in host.removeprefix("www.").split(".") if name]
    at = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(names))}{at}){parts.path or '/'}{query}".encode()


def entry_key(url: str | None, page_id) -> bytes:
    """Index keys are unique per page: the URL's key, then the page's id."""
    return url_key(url) + b" " + (b"" if page_id is None else str(page_id).encode())


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to).

    Of equal payloads the smallest id is kept as response. Only digests and ids are grouped; a payload
    that a third of all pages share is combined before the shuffle and its join side can be split.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    read = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("html"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    kept = (
        read.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("payload_digest").agg(F.min("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND kept IS NOT NULL").select("payload_digest", "kept")
    )
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return read.join(kept, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
    )


def _urn(page_id) -> str:
    return f"<{RECORD_ID}{'' if page_id is None else page_id}>"


def record(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + html.encode()
    # A line break inside a URL would end its header line.
    target = None if url is None else re.sub(r"[\r\n]", lambda found: f"%{ord(found[0]):02X}", url)
    headers = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}",
        *([] if target is None else [f"WARC-Target-URI: {target}"]), f"WARC-Payload-Digest: sha256:{payload_digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"] if record_type == "revisit" else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(headers).encode() + END + block + END


def parse(data: bytes) -> dict:
    """A record's WARC headers, its target, and its HTTP body."""
    head, _, rest = data.partition(END)
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, body = block.partition(END)
    length = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    return {"headers": headers, "payload_bytes": length, "payload": body}


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write each row as a WARC record below ``path``, in archives of at most as many records as have
    ``archive_bytes`` of payload on average. Rows are archived where they are, without a shuffle of their own.

    Payloads are the html in UTF-8; null is empty. Of rows with equal payloads of at least
    ``MIN_REVISIT_BYTES`` the smallest id is a response, and so is every row of that id; others
    revisit it. Null ids are never the smallest; where all are null, all are responses. A null URL
    gives a record without a target.
    """
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(F.col(html)), F.lit(0)))).first()[0]
    rows = with_revisits(pages, page_id, url, html)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, 64):
                made = [gzip.compress(record(**dict(zip(names, row))), 6, mtime=0) for row in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns])]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["value"])

    # A cast from binary keeps the bytes as they are, and so does the sink.
    map_arrow(rows, run, "value binary").select(F.col("value").cast("string")).write.option(
        "lineSep", SEPARATOR.decode("latin-1")
    ).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", max(1, int(archive_bytes / max(1, mean or 1)))).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return spark.read.format("binaryFile").load(path).select(name.alias("archive"), "content")


def members(content: bytes):
    """(offset, length, data) of each gzip member that holds something."""
    at = 0
    view = memoryview(content)
    while at < len(content):
        stream, parts, end = zlib.decompressobj(31), [], at
        while not stream.eof:
            if end >= len(content):
                raise ValueError("the archive ends inside a record")
            piece = view[end : end + (1 << 16)]
            parts.append(stream.decompress(piece))
            end += len(piece)
        end -= len(stream.unused_data)
        data = b"".join(parts)
        if data:
            yield at, end - at, data
        at = end


def capture_entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, archive, offset, length) of each record, read from the archives."""

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows = []
                for offset, length, data in members(content.as_py()):
                    headers = parse(data)["headers"]
                    page = headers["WARC-Record-ID"][len(RECORD_ID) + 1 : -1]
                    rows.append((entry_key(headers.get("WARC-Target-URI"), page), archive.as_py(), offset, length))
                columns = list(zip(*rows)) or [[]] * 4
                kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "archive", "offset", "length"])

    return map_arrow(_archives(spark, path), run, ENTRIES)


def build_index(entries: DataFrame, block_entries: int = BLOCK_ENTRIES, directory_rows: int = DIRECTORY_ROWS) -> tuple[DataFrame, DataFrame]:
    """The sorted blocks (block, first, entries) and the sparse directory (block, first).

    Blocks have as many entries as keep the directory within about ``directory_rows`` rows.
    """
    entries = written(entries, "captures")
    size = max(block_entries, -(-entries.count() // directory_rows))

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                held.append(row)
                if len(held) == size:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def packed(rows) -> pa.RecordBatch:
        lines = b"\n".join(b"%s\t%s\t%d\t%d" % (key.hex().encode(), archive.encode(), offset, length) for key, archive, offset, length in rows)
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.binary()), pa.array([zlib.compress(lines)], pa.binary())], ["first", "entries"])

    order = ["key", "archive", "offset"]
    ordered = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(map_arrow(ordered, run, "first binary, entries binary").withColumn("block", F.monotonically_increasing_id()), "capture-blocks")
    return blocks, blocks.select("block", "first")


def look_up(keys: DataFrame, blocks: DataFrame, directory: DataFrame) -> DataFrame:
    """(archive, offset, length) of the entries with the given keys, each distinct key once.

    The directory is broadcast; its rows are bounded when the index is built. A key may stand at the
    end of one block and the start of the next ones: it goes to all of them.
    """
    spark = keys.sparkSession
    rows = sorted((bytes(row.first), row.block) for row in directory.collect())
    shared = spark.sparkContext.broadcast(([first for first, _ in rows], [block for _, block in rows]))

    def place(batches):
        firsts, numbers = shared.value
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                low = max(0, bisect_left(firsts, key) - 1)
                found += [(key, numbers[at]) for at in range(low, bisect_right(firsts, key))]
            columns = list(zip(*found)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64())], ["key", "block"])

    def search(batches):
        for batch in batches:
            for entries, wanted in zip(batch.column(0), batch.column(1)):
                lines = [line.split(b"\t") for line in zlib.decompress(entries.as_py()).split(b"\n")]
                known = [bytes.fromhex(line[0].decode()) for line in lines]
                found = []
                for key in wanted.as_py():
                    for at in range(bisect_left(known, key), bisect_right(known, key)):
                        found.append((lines[at][1].decode(), int(lines[at][2]), int(lines[at][3])))
                columns = list(zip(*found)) or [[]] * 3
                kinds = [pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "offset", "length"])

    placed = map_arrow(keys.select("key").distinct(), place, "key binary, block long")
    wanted = placed.groupBy("block").agg(F.collect_list("key").alias("keys"))
    found = blocks.join(wanted, "block").select("entries", "keys")
    return map_arrow(found, search, "archive string, offset long, length long")


def read_ranges(spark: SparkSession, path: str, ranges: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records in the given ranges of the archives below ``path``, with their payloads."""
    wanted = ranges.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    # The archives are the large side: they are looked up in a table of ranges and not sorted.
    pieces = _archives(spark, path).join(wanted.hint("shuffle_hash"), "archive").select("content", "ranges")

    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content, ranges in zip(batch.column(0), batch.column(1)):
                view, ranges = memoryview(content.as_buffer()), ranges.as_py()
                for part in _parts(ranges):
                    rows = [_row(gzip.decompress(view[each["offset"] : each["offset"] + each["length"]])) for each in part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    read = map_arrow(pieces, run, RECORDS.format(id="string"))
    return read.withColumns({name: F.col(name).cast(id_type) for name in ("page_id", "refers_to")})


def _parts(ranges: list[dict], most: int = 1 << 20):
    """Ranges taken together, about ``most`` bytes of the archive at a time."""
    part, held = [], 0
    for each in ranges:
        if part and held + each["length"] > most:
            yield part
            part, held = [], 0
        part.append(each)
        held += each["length"]
    if part:
        yield part


def _row(data: bytes) -> tuple:
    found = parse(data)
    headers = found["headers"]
    ids = [headers.get(name, "")[len(RECORD_ID) + 1 : -1] or None for name in ("WARC-Record-ID", "WARC-Refers-To")]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    return ids[0], headers.get("WARC-Target-URI"), found["payload_bytes"], digest, headers["WARC-Type"], ids[1], found["payload"]


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each row of
    the pages, written to archives in the shared folder, indexed, looked up by key and read back.

    Rules as in ``write_archives``. Repeated rows come back repeated; an empty table gives an empty
    table; other columns are not written. Runs jobs when called.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, page_id, url, html, archive_bytes)
    blocks, directory = build_index(capture_entries(spark, path), block_entries)
    asked = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"))

    def keys(batches):
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            found = [entry_key(None if u is None else re.sub(r"[\r\n]", lambda c: f"%{ord(c[0]):02X}", u), i) for i, u in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["key"])

    ranges = look_up(map_arrow(asked, keys, "key binary"), blocks, directory)
    return read_ranges(spark, path, ranges, pages.schema[page_id].dataType.simpleString())
