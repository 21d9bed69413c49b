"""The operators over the driver's tables: one query each, with the columns its contract names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm import alignment, byte_bpe, decontaminate, licenses, line_dedup, repair, simhash, substring_dedup, token_counts, top_k, toxicity, url_filter, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        token_counts.over_limit().alias("over_limit"),
    )


def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.dedup_units(table(spark, folder, "documents").select("doc_id", "text"))
    places = F.transform("removed", lambda each: F.concat_ws("-", each["start"], each["stop"]))
    return found.select(
        "doc_id",
        (F.col("n_shared") > 0).alias("shares_passage"),
        "n_shared",
        "n_removed",
        "n_words",
        F.array_join(places, ",").alias("removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = byte_bpe.encode_texts(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return byte_bpe.decode_ids(encoded).select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archived(table(spark, folder, "pages").select("page_id", "url", "html"))
    own = F.col("record_type") == "response"
    # A response's size and digest are those of the bytes read back; a revisit has none, its headers tell.
    return read.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("notices", lambda each: each["base"])
    starts = F.transform(base, lambda each: each["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        licenses.labels(base).alias("base_labels"),
        licenses.labels(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda each: each["share"])), F.lit(0.0)).alias("score"),
    )


def op8_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.top_k(table(spark, folder, "embeddings").select("vec_id", "embedding"), lambda vec_id: vec_id % 20 == 0)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, folder, "labels").select("doc_id", "toxic"))
    scored = toxicity.toxicity(documents, model, score="score")
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url")).drop("url", "score")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut short, repeated or given to the user, a twentieth of them each; nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce(F.col("text"), blank)
    rows = turns.withColumn("damage", F.crc32(key) % 20).filter("damage <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.coalesce(F.col("role"), blank)).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair(damaged(turns)).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select(
        "conv_id",
        *[F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment_scores(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc": op6_warc,
    "op7_license_scan": op7_license_scan,
    "op8_top_k": op8_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION_SQL = f"""
WITH item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL.format("coalesce(text, '')")} AS words FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, list_slice(words, pos, pos + 9) AS words
    FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS pos FROM item_words WHERE len(words) > 0)
), lengths AS (
    SELECT DISTINCT len(words) AS size FROM windows
), document_words AS (
    SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS words FROM documents
), spans AS (
    SELECT doc_id, item_id, pos, size
    FROM (
        SELECT doc_id, pos, size, list_slice(words, pos, pos + size - 1) AS words
        FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM document_words, lengths)
    ) JOIN windows USING (words)
), hits AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS place FROM spans) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM spans) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM document_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WARC_SQL = """
WITH payloads AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), kept AS (
    SELECT payload_digest, min(page_id) AS first_id FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM payloads LEFT JOIN kept USING (payload_digest)
"""

TOP_K_SQL = """
WITH sound AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
    FROM sound q, sound c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""

LINES_SQL = f"""
WITH numbered AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, {LOWER_SQL.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM numbered
), repeats AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, line, pos, keeper IS NULL OR keeper = doc_id AS kept FROM keyed LEFT JOIN repeats USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

BLANK_SQL = r"\x20\x09-\x0D"
UNITS_SQL = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, length(regexp_extract(coalesce(text, ''), '^[{BLANK_SQL}]*')) AS lead,
        regexp_extract_all(coalesce(text, ''), '[^{BLANK_SQL}]+[{BLANK_SQL}]*') AS tokens
    FROM documents
), tokens AS (
    SELECT doc_id, lead, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos, len(tokens) AS n FROM texts
), words AS (
    SELECT *, lead + coalesce(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        coalesce(contains(lag(token) OVER (PARTITION BY doc_id ORDER BY pos), chr(10)), true) AS begins_line,
        left(md5({LOWER_SQL.format(f"regexp_extract(token, '^[^{BLANK_SQL}]+')")}), 16) AS h
    FROM tokens
), least AS (
    SELECT *, min(h) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {substring_dedup.REACH} PRECEDING AND {substring_dedup.REACH} FOLLOWING) = h AS cut FROM words
), cuts AS (
    SELECT doc_id, 'content' AS kind, pos FROM least WHERE cut OR pos = 0 UNION SELECT doc_id, 'line', pos FROM least WHERE begins_line
    UNION SELECT doc_id, unnest(['content', 'line']), n FROM least
), spans AS (
    SELECT DISTINCT a.doc_id, a.pos AS start, b.pos AS stop
    FROM (SELECT *, pos + {substring_dedup.MIN_WORDS} AS least FROM cuts) a ASOF JOIN cuts b ON a.doc_id = b.doc_id AND a.kind = b.kind AND a.least <= b.pos
), normal AS (
    SELECT doc_id, list_transform(tokens, lambda t: {LOWER_SQL.format(f"regexp_extract(t, '^[^{BLANK_SQL}]+')")}) AS words FROM texts
), units AS (
    SELECT doc_id, start, stop, md5(array_to_string(list_slice(words, start + 1, stop), ' ')) AS key FROM spans JOIN normal USING (doc_id)
), repeated AS (
    SELECT *, first_value(doc_id) OVER w AS first_id, first_value(start) OVER w AS first_start
    FROM units WHERE key IN (SELECT key FROM units GROUP BY key HAVING count(*) > 1) WINDOW w AS (PARTITION BY key ORDER BY doc_id, start)
), covered AS (
    SELECT DISTINCT 'shared' AS kind, doc_id, unnest(range(start, stop)) AS pos FROM repeated
    UNION SELECT DISTINCT 'gone', doc_id, unnest(range(CASE WHEN doc_id = first_id THEN greatest(start, first_start + stop - start) ELSE start END, stop)) FROM repeated
), stretches AS (
    SELECT kind, doc_id, min(pos) AS start, max(pos) + 1 AS stop
    FROM (SELECT *, pos - row_number() OVER (PARTITION BY kind, doc_id ORDER BY pos) AS island FROM covered) GROUP BY kind, doc_id, island
    HAVING count(*) >= {substring_dedup.MIN_PASSAGE}
), gone AS (
    SELECT s.doc_id, s.start, s.stop, a.start AS from_char, coalesce(b.start, length(text)) AS to_char
    FROM stretches s JOIN texts USING (doc_id) JOIN words a ON a.doc_id = s.doc_id AND a.pos = s.start LEFT JOIN words b ON b.doc_id = s.doc_id AND b.pos = s.stop
    WHERE kind = 'gone'
), totals AS (
    SELECT doc_id, sum(stop - start) AS n, string_agg(from_char || '-' || to_char, ',' ORDER BY start) AS removed FROM gone GROUP BY doc_id
), shared AS (
    SELECT doc_id, sum(stop - start) AS n FROM stretches WHERE kind = 'shared' GROUP BY doc_id
), kept AS (
    SELECT doc_id, string_agg(token, '' ORDER BY pos) AS rest
    FROM words WHERE (doc_id, pos) NOT IN (SELECT (doc_id, unnest(range(start, stop))) FROM gone) GROUP BY doc_id
)
SELECT doc_id, coalesce(shared.n, 0) > 0 AS shares_passage, CAST(coalesce(shared.n, 0) AS BIGINT) AS n_shared, CAST(coalesce(totals.n, 0) AS BIGINT) AS n_removed,
    len(tokens) AS n_words, coalesce(removed, '') AS removed, sha256(left(text, lead) || coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN shared USING (doc_id) LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# Counts of accepted and rejected URLs in either half, by the characters of a gram.
URL_KINDS = ("allow_0", "block_0", "allow_1", "block_1")


def _levels_sql(order: int) -> str:
    """Counts, contexts and smoothed probabilities for one character, then for one more of context each time."""
    steps = []
    for size in range(1, order + 2):
        shorter = "1.0 / letters" if size == 1 else "shorter.{}"
        p = ", ".join(
            f"CASE WHEN {k}_n > 0 THEN (own.{k} + {k}_t * {shorter.format(k)}) / ({k}_n + {k}_t) ELSE {shorter.format(k)} END AS {k}" for k in URL_KINDS
        )
        steps.append(f"""
own_{size} AS (
    SELECT right(gram, {size}) AS gram, left(right(gram, {size}), {size - 1}) AS context, {", ".join(f"sum({k}) AS {k}" for k in URL_KINDS)} FROM counts GROUP BY ALL
), contexts_{size} AS (
    SELECT context, count(*) AS letters, {", ".join(f"sum({k}) AS {k}_n, count(*) FILTER ({k} > 0) AS {k}_t" for k in URL_KINDS)} FROM own_{size} GROUP BY context
), p_{size} AS (
    SELECT own.gram, {p} FROM own_{size} own JOIN contexts_{size} USING (context)
    {f"JOIN p_{size - 1} shorter ON right(own.gram, {size - 1}) = shorter.gram" if size > 1 else ""}
)""")
    return ",".join(steps)


URLS_SQL = f"""
WITH found AS (
    SELECT *, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM (SELECT DISTINCT url FROM pages)
), parsed AS (
    SELECT url, {LOWER_SQL.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM found
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
    FROM parsed
), urls AS (
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS action,
        CASE WHEN left(md5(url), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE 0 END AS half,
        repeat(chr(2), {url_filter.ORDER}) || {LOWER_SQL.format("coalesce(url, '')")} || chr(3) AS padded
    FROM ruled
), placed AS (
    SELECT coalesce(url, chr(0)) AS key, action, half, substring(padded, pos, {url_filter.ORDER + 1}) AS gram
    FROM (SELECT *, unnest(range(1, length(padded) - {url_filter.ORDER} + 1)) AS pos FROM urls)
), counts AS (
    SELECT gram, {", ".join(f"count(*) FILTER (action = '{k[:-2]}' AND half = {k[-1]}) AS {k}" for k in URL_KINDS)} FROM placed GROUP BY gram
), {_levels_sql(url_filter.ORDER)}, scored AS (
    SELECT key, any_value(action) AS action, any_value(half) AS half, round(avg(ln(allow_0 / block_0)), 6) AS half_0, round(avg(ln(allow_1 / block_1)), 6) AS half_1
    FROM placed JOIN p_{url_filter.ORDER + 1} USING (gram) GROUP BY key
), crossed AS (
    SELECT *, CASE WHEN half = 0 THEN half_1 ELSE half_0 END AS other FROM scored
), classes AS (
    SELECT avg(other) FILTER (action = 'allow') AS a, avg(other) FILTER (action = 'block') AS b,
        stddev_pop(other) FILTER (action = 'allow') AS sa, stddev_pop(other) FILTER (action = 'block') AS sb, count(DISTINCT (action, half)) FILTER (action IS NOT NULL) AS kinds
    FROM crossed
), threshold AS (
    SELECT kinds, round(CASE WHEN sa + sb = 0 THEN (a + b) / 2 ELSE (a * sb + b * sa) / (sa + sb) END, 6) AS threshold FROM classes
)
SELECT page_id, host, path, rule,
    coalesce(urls.action, CASE WHEN kinds < 4 OR round((half_0 + half_1) / 2, 6) >= threshold THEN 'allow' ELSE 'block' END) AS verdict
FROM pages JOIN urls ON pages.url IS NOT DISTINCT FROM urls.url JOIN scored ON scored.key = coalesce(urls.url, chr(0)), threshold
"""

STATEMENTS: dict[str, str] = {
    "op11_url_filter": URLS_SQL,
    "op3_substring_dedup": UNITS_SQL,
    "op2_benchmark_decontamination": DECONTAMINATION_SQL,
    "op6_warc": WARC_SQL,
    "op8_top_k": TOP_K_SQL,
    "op9_line_dedup": LINES_SQL,
}
