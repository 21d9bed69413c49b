"""DuckDB statements that say the same as the queries, over whole tables.

The statements are put together from small SQL builders, one per text rule. RE2, DuckDB's regex
engine, knows no back-references and only ASCII blanks, so blanks are an explicit class and
repeated phrases are found with windows.
"""

from __future__ import annotations

from corpus_spark.functions.chat import SYSTEM_PROMPT, ChatTemplate
from corpus_spark.plans.catalogue import MEANINGS
from corpus_spark.plans.tables import LINE_LABELS, OUTPUT_MARKS, SOURCE_MARKS

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


# The source cleaning rules in their order, as RE2 patterns.
SOURCE_RULES = (
    ("Ḫ", "H"),
    ("ḫ", "h"),
    ("[˹˺]", ""),
    (r"<<.*?>>", ""),
    (r"<(.*?)>", r"\1"),
    (rf"\[\.\.\.{WS}*\.\.\.?\]", "<big_gap>"),
    (rf"\[x(?:{WS}+x)*\]", "<gap>"),
    (r"\[(.*?)\]", r"\1"),
    ("[!?]", ""),
    (f"{WS}*/{WS}*", " "),
    (f"{WS}*:{WS}*", " "),
    *((f"[{subscript}{superscript}]", digit) for subscript, superscript, digit in zip("₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")),
)
LINE_NUMBER = rf"^(?:(?:o|r|rev|obv|lo\.?e\.?|u\.?e\.?)\.?{WS}+)?\p{{Nd}}+['′]?\.{WS}*"
# The public 13a tokenization, first literal replacements and then patterns.
TOKEN_MARKS = (
    ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
)
TOKEN_RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)


def q(value: str) -> str:
    """A SQL text literal."""
    return "'" + value.replace("'", "''") + "'"


def sub(text: str, pattern: str, put: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(put)}, 'g')"


def replaced(text: str, marks: tuple[tuple[str, str], ...]) -> str:
    for found, put in marks:
        text = f"replace({text}, {q(found)}, {q(put)})"
    return text


def squeezed(text: str) -> str:
    return f"trim({sub(text, WS + '+', ' ')}, ' ')"


def marked_source(text: str, key: str) -> str:
    cases = " ".join(f"WHEN {place} THEN {q(label)}" for place, label in enumerate(LINE_LABELS))
    return f"(CASE {key} % {len(LINE_LABELS) + 1} {cases} ELSE '' END || {replaced(text, SOURCE_MARKS)})"


def some_blank(text: str, size: str) -> str:
    return f"(CASE WHEN {size} % 11 = 0 THEN {q(' ' + chr(9))} WHEN {size} % 13 <> 0 THEN {text} END)"


def cleaned_source(text: str) -> str:
    value = f"nfc_normalize(coalesce({text}, ''))"
    for pattern, put in SOURCE_RULES:
        value = sub(value, pattern, put)
    return squeezed(f"regexp_replace({value}, {q(LINE_NUMBER)}, '')")


def cleaned_target(text: str) -> str:
    return squeezed(f"coalesce({text}, '')")


def stripped_output(text: str) -> str:
    return sub(sub(f"coalesce({text}, '')", r"<\|.*?\|>", ""), r"(?s:<think>.*?</think>)", "")


def collapsed(base: str) -> str:
    """CTEs ending in ``collapsed(id, clean)`` for ``base``, a query of ``id, text``.

    ``words`` numbers the words; ``hits`` has the longest repeated phrase at each word, found by
    counting equal neighbours at distance n in a window of n; ``taken`` walks from hit to hit.
    """
    leads = ", ".join(f"(word = lead(word, {n}) OVER seq)::INT AS e{n}" for n in range(3, 11))
    runs = ", ".join(
        f"sum(e{n}) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS s{n}"
        for n in range(3, 11)
    )
    longest = " ".join(f"WHEN s{n} = {n} THEN {n}" for n in range(10, 2, -1))
    return f"""RECURSIVE base AS ({base}),
    words AS (
        SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
        FROM (SELECT id, list_filter(string_split_regex(text, {q(WS + '+')}), lambda w: w <> '') AS ws FROM base)
    ),
    equal AS (SELECT id, i, {leads} FROM words WINDOW seq AS (PARTITION BY id ORDER BY i)),
    hits AS (
        SELECT id, i, n FROM (
            SELECT id, i, CASE {longest} ELSE 0 END AS n FROM (SELECT id, i, {runs} FROM equal)
        ) WHERE n > 0
    ),
    taken(id, i, n) AS (
        SELECT id, min(i), arg_min(n, i) FROM hits GROUP BY id
        UNION ALL
        SELECT h.id, min(h.i), arg_min(h.n, h.i)
        FROM taken t JOIN hits h ON h.id = t.id AND h.i >= t.i + 2 * t.n GROUP BY h.id
    ),
    dropped AS (SELECT id, i + n + unnest(range(n)) AS i FROM taken),
    kept AS (
        SELECT id, string_agg(word, ' ' ORDER BY i) AS clean
        FROM words ANTI JOIN dropped USING (id, i) GROUP BY id
    ),
    collapsed AS (SELECT base.id, coalesce(clean, '') AS clean FROM base LEFT JOIN kept USING (id))"""


PAIRS = """
    SELECT u.conv_id, u.turn, u.text AS source, a.text AS target
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""
RAW_PAIRS = f"""
    SELECT conv_id, turn,
           {some_blank(marked_source('source', 'turn'), 'length(source)')} AS source,
           {some_blank('target', 'length(target)')} AS target
    FROM ({PAIRS})"""


# --- scores -------------------------------------------------------------------------------------


def tokens_13a(text: str) -> str:
    value = f"regexp_replace(coalesce({text}, ''), {q(WS + '+$')}, '')"
    value = f"(' ' || {replaced(value, TOKEN_MARKS)} || ' ')"
    for pattern, put in TOKEN_RULES:
        value = sub(value, pattern, put)
    return squeezed(value)


def tokens_chrf(text: str) -> str:
    punctuation = r"[!-/:-@\[-`{-~]"
    word = (
        f"lambda w: CASE WHEN length(w) > 1 AND regexp_matches(w, {q(f'(?s){punctuation}$')}) THEN w[:-2] || ' ' || w[-1] "
        f"WHEN length(w) > 1 AND regexp_matches(w, {q(f'^{punctuation}')}) THEN w[1] || ' ' || w[2:] ELSE w END"
    )
    return f"array_to_string(list_transform(string_split({squeezed(f'coalesce({text}, {q('')})')}, ' '), {word}), ' ')"


def grams_of(units: str, orders: int, shift: int = 0) -> str:
    """Rows (key, side, o, gram) of a list of words or characters; ``shift`` keeps families apart.

    Each unit sees its followers through ``lead``, so the work is linear in the text.
    """
    numbered = f"SELECT key, side, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (SELECT key, side, {units} AS us FROM sides)"
    grams = ["u"]
    for n in range(1, orders):
        grams.append(f"{grams[-1]} || ' ' || lead(u, {n}) OVER seq")
    columns = ", ".join(f"{gram} AS g{n}" for n, gram in enumerate(grams, 1))
    listed = ", ".join(f"{{'o': {n + shift}, 'gram': g{n}}}" for n in range(1, orders + 1))
    return f"""SELECT key, side, g.o AS o, g.gram AS gram FROM (
        SELECT key, side, unnest([{listed}]) AS g FROM (
            SELECT key, side, {columns} FROM ({numbered}) WINDOW seq AS (PARTITION BY key, side ORDER BY i))
        ) WHERE g.gram IS NOT NULL"""


def word_list(column: str) -> str:
    return f"list_filter(string_split({column}, ' '), lambda w: w <> '')"


def char_list(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN [] ELSE string_split({column}, '') END"


def gram_ctes(pairs: str, bleu: bool = True, chrf: bool = True) -> str:
    """CTEs ending in ``counts(key, o, n_hyp, n_ref, n_match)`` for ``pairs``, a query of ``key, hyp, ref``.

    Orders 1 to 4 are BLEU words, 11 to 16 chrF characters, 21 and 22 chrF words.
    """
    families = []
    texts = []
    if bleu:
        texts.append(f"{tokens_13a('text')} AS toks")
        families.append(grams_of(word_list("toks"), 4))
    if chrf:
        squashed = sub("text", WS + "+", "")
        texts.append(f"{squashed} AS chars, {tokens_chrf('text')} AS words")
        families.append(grams_of(char_list("chars"), 6, 10))
        families.append(grams_of(word_list("words"), 2, 20))
    orders = [*(range(1, 5) if bleu else ()), *((11, 12, 13, 14, 15, 16, 21, 22) if chrf else ())]
    return f"""pairs AS ({pairs}),
    sides AS (
        SELECT key, side, {', '.join(texts)} FROM (
            SELECT key, 'h' AS side, hyp AS text FROM pairs UNION ALL SELECT key, 'r', ref FROM pairs)
    ),
    grams AS ({' UNION ALL '.join(families)}),
    per_gram AS (
        SELECT key, o, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r
        FROM grams GROUP BY key, o, gram
    ),
    found AS (SELECT key, o, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM per_gram GROUP BY key, o),
    counts AS (
        SELECT key, o, CASE WHEN o > 10 AND coalesce(r, 0) = 0 THEN 0 ELSE coalesce(h, 0) END::BIGINT AS n_hyp,
               coalesce(r, 0)::BIGINT AS n_ref, coalesce(m, 0)::BIGINT AS n_match
        FROM (SELECT key, unnest({orders}) AS o FROM pairs) LEFT JOIN found USING (key, o)
    )"""


def statistics(base: str, bleu: bool, chrf: bool) -> str:
    names = {n: f"word{n}" for n in range(1, 5)} if bleu else {}
    if chrf:
        names |= {10 + n: f"chr{n}" for n in range(1, 7)} | {20 + n: f"chw{n}" for n in (1, 2)}
    cells = ", ".join(
        f"any_value({value}) FILTER (o = {o}) AS {name}_{field}"
        for o, name in names.items() for field, value in (("hyp", "n_hyp"), ("ref", "n_ref"), ("match", "n_match"))
    )
    return f"WITH {gram_ctes(base, bleu, chrf)} SELECT key // 1000000 AS conv_id, key % 1000000 AS turn, {cells} FROM counts GROUP BY key"


def scores(base: str, groups: str = "", bleu: bool = True, chrf: bool = True, first: str = "") -> str:
    """Rounded scores per group; ``base`` also has the group columns, one value per key. ``first``
    holds CTEs that ``base`` reads."""
    by = f"{groups}, " if groups else ""
    group_by = f"GROUP BY {groups}, o" if groups else "GROUP BY o"
    last = f"GROUP BY {groups}" if groups else ""
    missed = "2 ^ (count(*) FILTER (o <= 4 AND m = 0) OVER (" + (f"PARTITION BY {groups} " if groups else "") + "ORDER BY o))"
    out = []
    if bleu:
        out.append(
            "CASE WHEN max(m) FILTER (o <= 4) = 0 OR min(h) FILTER (o <= 4) = 0 THEN 0.0 ELSE "
            "exp(least(0, 1 - any_value(r) FILTER (o = 1) / any_value(h) FILTER (o = 1)) + sum(lp) FILTER (o <= 4) / 4) END AS bleu"
        )
    if chrf:
        p = "coalesce(avg(m / h) FILTER (o > 10 AND h > 0 AND r > 0), 0)"
        r = "coalesce(avg(m / r) FILTER (o > 10 AND h > 0 AND r > 0), 0)"
        out.append(f"CASE WHEN {p} + {r} > 0 THEN 500 * {p} * {r} / (4 * {p} + {r}) ELSE 0.0 END AS chrfpp")
    shown = [f"round({name}, 6) AS {name}" for name, wanted in (("bleu", bleu), ("chrfpp", chrf)) if wanted]
    if bleu and chrf:
        shown.append("round(CASE WHEN bleu > 0 AND chrfpp > 0 THEN sqrt(bleu * chrfpp) ELSE 0.0 END, 6) AS geomean")
    return f"""WITH {first + ',' if first else ''} {gram_ctes(base, bleu, chrf)},
    summed AS (
        SELECT {by}o, sum(n_hyp)::DOUBLE AS h, sum(n_ref)::DOUBLE AS r, sum(n_match)::DOUBLE AS m
        FROM counts JOIN pairs USING (key) {group_by}
    ),
    logs AS (SELECT *, CASE WHEN h = 0 OR o > 4 THEN NULL WHEN m > 0 THEN ln(100 * m / h) ELSE ln(100 / ({missed} * h)) END AS lp FROM summed),
    scored AS (SELECT {by}{', '.join(out)} FROM logs {last})
    SELECT {by}{', '.join(shown)} FROM scored"""


PREDICTIONS = f"SELECT conv_id * 1000000 + turn AS key, source AS hyp, target AS ref FROM ({PAIRS})"
BLANKED = f"""SELECT conv_id * 1000000 + turn AS key, turn,
    coalesce({some_blank('source', 'length(source)')}, '...') AS hyp,
    coalesce({some_blank('target', 'length(target)')}, '') AS ref FROM ({PAIRS})"""
RUN_PREDICTIONS = f"""SELECT conv_id * 1000000 + turn AS key, source AS hyp, target AS ref,
    'model_r' || (2 ^ (conv_id % 4 + 3))::INT || '-a32_lr1e-4_ep4' AS run, (turn // 2)::INT AS epoch FROM ({PAIRS})"""
DOCUMENT_OUTPUTS = """SELECT id AS key, CASE WHEN clean = '' THEN '...' ELSE clean END AS hyp, text AS ref, lang
    FROM collapsed JOIN documents ON doc_id = id"""
EPOCH_SCORES = scores(RUN_PREDICTIONS, "run, epoch")
LAST_SCORES = f"""SELECT run, arg_max(bleu, epoch) AS bleu, arg_max(chrfpp, epoch) AS chrfpp,
    arg_max(geomean, epoch) AS geomean, max(epoch) AS epoch FROM ({EPOCH_SCORES}) GROUP BY run"""


# --- the rest -----------------------------------------------------------------------------------


def rank(key: str) -> str:
    return f"md5('42:' || {key})"


def labelled(rows: str, key: str) -> str:
    """``rows`` with ``split``: the first tenth of the distinct keys in rank order is held out."""
    return f"""WITH rows AS ({rows}), keys AS (SELECT DISTINCT {key} AS k FROM rows),
    held AS (SELECT k FROM keys ORDER BY {rank('k')} LIMIT (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT FROM keys))
    SELECT rows.*, CASE WHEN {key} IN (SELECT k FROM held) THEN 'val' ELSE 'train' END AS split FROM rows"""


def looked_up(text: str) -> str:
    cases = " ".join(f"WHEN {q(word)} THEN {q(meaning)}" for word, meaning in MEANINGS)
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def message(role: str, content: str) -> str:
    return f"{{'role': {q(role)}, 'content': {content}}}"


TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
LEXICON = f"""SELECT form, CAST(item_id AS VARCHAR) AS meaning, form || '/' || item_id AS norm, (['GN', 'PN', 'verb', 'DN'])[length(form) % 4 + 1] AS type
    FROM (SELECT item_id, unnest(list_filter(string_split_regex(text, {q(WS + '+')}), lambda w: w <> '')) AS form FROM benchmark)"""
CANDIDATES = """SELECT conv_id AS source, origin || '-' || turn AS candidate, CASE origin WHEN 'own' THEN text ELSE replace(text, 'th', 'd') END AS text
    FROM conversations, (SELECT unnest(['own', 'changed']) AS origin) WHERE role = 'assistant'"""


def around(order: str, before: int, after: int) -> str:
    """Texts of the rows before and after, as lists; ``order`` is the window of a document."""
    return f"""coalesce(list(text) OVER ({order} ROWS BETWEEN {before} PRECEDING AND 1 PRECEDING), []) AS lines_before,
        coalesce(list(text) OVER ({order} ROWS BETWEEN 1 FOLLOWING AND {after} FOLLOWING), []) AS lines_after"""


def capitals(rows: str) -> str:
    return f"""SELECT name, count(*) AS times FROM (SELECT unnest(regexp_extract_all(text, {q(TOKEN)})) AS name FROM {rows})
        WHERE regexp_matches(name, '^\\p{{Lu}}') GROUP BY name"""


def fuzzy_pairs() -> str:
    """All names against all, without an index."""
    # This engine counts edits of bytes, so every letter is made one byte first.
    letters = "".join(chr(code) for code in range(0xC0, 0x100) if chr(code).isalpha())
    single = "".join(chr(code) for code in range(1, 128) if not chr(code).isalnum())[: len(letters)]
    coded = f"SELECT name, translate(name, {q(letters)}, {q(single)}) AS coded FROM"
    return f"""SELECT f.name AS form, c.name AS canonical, levenshtein(f.coded, c.coded) AS distance
        FROM ({coded} ({capitals('documents')})) f, ({coded} ({capitals("(SELECT * FROM conversations WHERE role = 'assistant')")})) c
        WHERE f.name = c.name OR (length(f.name) >= 4 AND length(c.name) >= 4 AND abs(length(f.name) - length(c.name)) <= 1 AND levenshtein(f.coded, c.coded) <= 1)"""


def agreements() -> str:
    """chrF++ of each candidate against each sibling, and their mean."""
    pairs = f"""SELECT row_number() OVER (ORDER BY a.source, a.candidate, b.candidate) AS key, a.text AS hyp, b.text AS ref, a.source, a.candidate
        FROM ({CANDIDATES}) a JOIN ({CANDIDATES}) b ON a.source = b.source AND a.candidate <> b.candidate"""
    return f"""WITH {gram_ctes(pairs, bleu=False)},
    averages AS (
        SELECT key, coalesce(avg(n_match / n_hyp) FILTER (n_hyp > 0 AND n_ref > 0), 0) AS p, coalesce(avg(n_match / n_ref) FILTER (n_hyp > 0 AND n_ref > 0), 0) AS r
        FROM counts GROUP BY key
    ),
    means AS (
        SELECT source, candidate, avg(CASE WHEN p + r > 0 THEN 500 * p * r / (4 * p + r) ELSE 0 END) AS agreement
        FROM averages JOIN pairs USING (key) GROUP BY source, candidate
    )
    SELECT source AS conv_id, candidate, round(round(agreement, 9), 6) AS agreement, round(agreement, 9) AS fine FROM ({CANDIDATES}) LEFT JOIN means USING (source, candidate)"""


REPLACED_NAMES = f"""WITH RECURSIVE parts AS (
    SELECT conv_id || '-' || turn AS id, text, regexp_extract_all(text, {q(TOKEN)}) AS parts FROM conversations
), listed AS (
    SELECT name, min(put) AS put, len(regexp_extract_all(name, {q(TOKEN)})) AS size FROM (
        SELECT parts[1] AS name, '<' || parts[1] || '>' AS put FROM parts
        UNION ALL SELECT parts[1] || parts[2] || parts[3], '<' || parts[1] || '_' || parts[3] || '>' FROM parts WHERE parts[2] = ' ')
    WHERE name <> '' AND put IS NOT NULL GROUP BY name
), placed AS (
    SELECT id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM parts
), best AS (
    SELECT id, pos, max(size) AS size, arg_max(put, size) AS put
    FROM (SELECT id, pos, array_to_string(parts[pos:pos + n - 1], '') AS name FROM placed, (SELECT DISTINCT size AS n FROM listed) WHERE pos + n - 1 <= len(parts))
    JOIN listed USING (name) GROUP BY id, pos
), pointed AS (
    SELECT a.*, b.pos AS following FROM (SELECT *, pos + size AS stop FROM best) a ASOF LEFT JOIN best b ON a.id = b.id AND a.stop <= b.pos
), taken AS (
    SELECT p.* FROM pointed p JOIN (SELECT id, min(pos) AS pos FROM best GROUP BY id) USING (id, pos)
    UNION ALL SELECT p.* FROM taken t JOIN pointed p ON p.id = t.id AND p.pos = t.following
), shown AS (
    SELECT p.id, p.pos, CASE WHEN t.pos = p.pos THEN t.put WHEN p.pos < t.stop THEN '' ELSE p.parts[p.pos] END AS part
    FROM placed p ASOF LEFT JOIN taken t ON p.id = t.id AND p.pos >= t.pos
)
SELECT id, coalesce(any_value(joined), any_value(text)) AS text FROM parts LEFT JOIN (SELECT id, string_agg(part, '' ORDER BY pos) AS joined FROM shown GROUP BY id) USING (id) GROUP BY id"""


def oracle_statements() -> dict[str, str]:
    template = ChatTemplate()
    turn = f"{q(template.message_start)} || 'user' || {q(template.role_end)} || 'Translate: ' || text || {q(template.message_end)}"
    system = template.message_start + "system" + template.role_end + SYSTEM_PROMPT + template.message_end
    marked_docs = f"SELECT doc_id, lang, {marked_source('text', 'doc_id')} AS marked FROM documents"
    clean_docs = f"SELECT doc_id, lang, marked, {cleaned_source('marked')} AS clean FROM ({marked_docs})"
    outputs = replaced("text", OUTPUT_MARKS)
    turns_output = f"SELECT conv_id * 1000000 + turn AS id, {stripped_output(some_blank(outputs, 'length(text)'))} AS text FROM conversations"
    docs_output = f"SELECT doc_id AS id, {stripped_output(outputs)} AS text FROM documents"
    default = "CASE WHEN clean = '' THEN '...' ELSE clean END"
    prepared = labelled(
        f"""SELECT * FROM (SELECT conv_id AS text_id, turn, {cleaned_source('source')} AS source, {cleaned_target('target')} AS reference
            FROM ({RAW_PAIRS})) WHERE source <> '' AND reference <> ''""",
        "text_id",
    )
    by_source = labelled("SELECT doc_id, source FROM documents", "source")
    return {
        "clean_source": f"SELECT doc_id, lang, clean FROM ({clean_docs}) WHERE clean <> ''",
        "clean_summary": f"""SELECT lang, count(*) AS rows_kept, sum(length(marked) - length(clean))::BIGINT AS chars_removed
            FROM ({clean_docs}) WHERE clean <> '' GROUP BY lang""",
        "nfc_normalize": f"SELECT doc_id, nfc_normalize({replaced('text', (('é', 'é'), ('ñ', 'ñ')))}) AS text FROM documents",
        "clean_target": f"SELECT conv_id, turn, {cleaned_target(replaced('text', ((' ', ' ' + chr(9) + ' '),)))} AS clean FROM conversations",
        "clean_parallel": f"""SELECT * FROM (SELECT conv_id, turn, {cleaned_source('source')} AS transliteration_clean,
            {cleaned_target('target')} AS translation_clean FROM ({RAW_PAIRS}))
            WHERE transliteration_clean <> '' AND translation_clean <> ''""",
        "clean_counts": f"""SELECT turn, count(*) AS rows_in, count(*) FILTER (kept) AS rows_kept, count(*) FILTER (NOT kept) AS rows_dropped
            FROM (SELECT turn, {cleaned_source('source')} <> '' AND {cleaned_target('target')} <> '' AS kept FROM ({RAW_PAIRS}))
            GROUP BY turn""",
        "clean_test": f"SELECT conv_id, turn, {cleaned_source('source')} AS transliteration_clean FROM ({RAW_PAIRS})",
        "postprocess": f"WITH {collapsed(turns_output)} SELECT id // 1000000 AS conv_id, id % 1000000 AS turn, {default} AS clean FROM collapsed",
        "collapse_repeats": f"WITH {collapsed(f'SELECT doc_id AS id, {outputs} AS text FROM documents')} SELECT id AS doc_id, clean FROM collapsed",
        "word_counts": f"""SELECT doc_id, points, len(ws)::BIGINT AS n_words, array_to_string(ws, ' ') AS joined FROM (
            SELECT doc_id, length(text) AS points, list_filter(string_split_regex(text, {q(WS + '+')}), lambda w: w <> '') AS ws FROM documents)""",
        "blank_rows": f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, {some_blank('text', 'n_chars')} AS text FROM documents)
            WHERE text IS NULL OR NOT regexp_matches(text, {q(WS.replace('[', '[^', 1))})""",
        "fill_missing": f"""SELECT conv_id, turn, coalesce({some_blank('source', 'length(source)')}, '...') AS prediction,
            coalesce({some_blank('target', 'length(target)')}, '') AS reference FROM ({PAIRS})""",
        "preview": "SELECT doc_id, substring(text, 1, 100) AS text FROM documents ORDER BY doc_id LIMIT 5",
        "csv_round_trip": "SELECT conv_id, turn, role, replace(text, ',', ' ,\"') AS text FROM conversations",
        "chat_round_trip": f"SELECT source, target AS reference FROM ({PAIRS})",
        "chat_records": f"""SELECT conv_id, turn, to_json([{message('system', q(SYSTEM_PROMPT))},
            {message('user', "'Translate: ' || source")}, {message('assistant', 'target')}])::VARCHAR AS messages FROM ({PAIRS})""",
        "chat_unpack": f"SELECT conv_id, turn, source, target AS reference FROM ({PAIRS})",
        "rendered_prompts": f"""SELECT conv_id, turn, {q(system)} || {turn} || {q(template.generation)} AS prompt
            FROM conversations WHERE role = 'user'""",
        "document_split": labelled("SELECT doc_id, lang FROM documents", "doc_id"),
        "source_split": by_source,
        "split_sizes": f"SELECT split, count(DISTINCT source) AS documents, count(*) AS rows FROM ({by_source}) GROUP BY split",
        "row_split": labelled("SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_index FROM documents", "row_index"),
        "keyless_split": """WITH sizes AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.1))::BIGINT AS held, count(*) - count(text) AS empty FROM documents)
            SELECT 'val' AS split, held AS rows, 0::BIGINT AS without_text FROM sizes UNION ALL SELECT 'train', n - held, empty FROM sizes""",
        "limited_translation": f"""SELECT conv_id, turn, array_to_string(string_split({looked_up('source')}, ' ')[:12], ' ') AS prediction FROM ({PAIRS})""",
        "threshold_split": f"""SELECT doc_id, source,
            CASE WHEN substr({rank('doc_id')}, 1, 8) < '{int(0.1 * 2**32):08x}' THEN 'val' ELSE 'train' END AS split FROM documents""",
        "split_outputs": f"""WITH labelled AS ({by_source})
            SELECT doc_id, 'train_full' AS part FROM labelled WHERE split = 'train'
            UNION ALL SELECT doc_id, 'val' FROM labelled WHERE split = 'val'
            UNION ALL (SELECT doc_id, 'train_small' FROM labelled WHERE split = 'train' ORDER BY {rank('doc_id')}, doc_id LIMIT 100)""",
        "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {rank('doc_id')}, doc_id) - 1 AS place FROM documents",
        "seeded_head": f"SELECT source, doc_id FROM documents ORDER BY {rank('source')}, source, doc_id LIMIT 100",
        "row_index": "SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_index FROM conversations",
        "distinct_documents": "SELECT DISTINCT source FROM documents",
        "held_out_rows": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "training_rows": "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)",
        "bleu_tokens": f"SELECT page_id, {tokens_13a('html')} AS tokens FROM pages",
        "chrf_tokens": f"SELECT page_id, {tokens_chrf('html')} AS tokens FROM pages",
        "bleu_statistics": statistics(PREDICTIONS, True, False),
        "chrf_statistics": statistics(PREDICTIONS, False, True),
        "corpus_bleu": scores(PREDICTIONS, chrf=False),
        "corpus_chrf": scores(PREDICTIONS, bleu=False),
        "evaluate": scores(PREDICTIONS),
        "evaluate_newest": scores(PREDICTIONS),
        "evaluate_by_turn": scores(BLANKED, "turn"),
        "document_bleu": scores(DOCUMENT_OUTPUTS, "lang", chrf=False, first=collapsed(docs_output)),
        "evaluate_documents": scores(DOCUMENT_OUTPUTS, "lang", first=collapsed(docs_output)),
        "epoch_scores": EPOCH_SCORES,
        "last_epoch_scores": LAST_SCORES,
        "length_batches": """SELECT doc_id, batch_pos, batch_pos // 8 AS batch_id FROM (
            SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS batch_pos FROM documents)""",
        "translate_test": f"""SELECT conv_id, turn, clean AS transliteration_clean,
            CASE WHEN clean = '' THEN '...' ELSE {looked_up('clean')} END AS prediction
            FROM (SELECT conv_id, turn, {cleaned_source('source')} AS clean FROM ({RAW_PAIRS}))""",
        "translate_validation": f"""SELECT conv_id, turn, source AS transliteration, target AS reference,
            {looked_up('source')} AS prediction FROM ({PAIRS})""",
        "clean_predictions": f"""WITH {collapsed(f'''SELECT conv_id * 1000000 + turn AS id,
            {stripped_output(replaced('source', OUTPUT_MARKS))} AS text FROM ({PAIRS})''')}
            SELECT id // 1000000 AS conv_id, id % 1000000 AS turn, {default} AS prediction_clean FROM collapsed""",
        "submission_table": f"WITH {collapsed(docs_output)} SELECT id, {default} AS translation FROM collapsed",
        "submission_file": f"WITH {collapsed(docs_output)} SELECT id, {default} AS translation FROM collapsed",
        "submission_by_key": f"""WITH {collapsed(f"SELECT doc_id AS id, {stripped_output('text')} AS text FROM documents")}
            SELECT id, coalesce({default}, '...') AS translation
            FROM (SELECT doc_id AS id FROM documents UNION ALL SELECT -p_partkey - 1 FROM part) LEFT JOIN collapsed USING (id)""",
        "submission_by_position": f"""WITH {collapsed(f'''SELECT row_number() OVER (ORDER BY conv_id, turn) AS id,
            {stripped_output('text')} AS text FROM conversations WHERE role = 'assistant' ''')},
            test AS (SELECT conv_id || '-' || turn AS id, row_number() OVER (ORDER BY conv_id, turn) AS place
                     FROM conversations WHERE role = 'user')
            SELECT test.id, coalesce({default}, '...') AS translation FROM test LEFT JOIN collapsed ON collapsed.id = test.place""",
        "file_order_submission": f"""WITH {collapsed(f"SELECT doc_id AS id, {stripped_output('text')} AS text FROM documents")}
            SELECT id, {default} AS translation FROM collapsed""",
        "prepared_sets": f"""WITH prepared AS ({prepared})
            SELECT 'train_full' AS part, source, reference FROM prepared WHERE split = 'train'
            UNION ALL SELECT 'val', source, reference FROM prepared WHERE split = 'val'
            UNION ALL (SELECT 'train_small', source, reference FROM prepared WHERE split = 'train' ORDER BY text_id, turn LIMIT 100)""",
        "run_settings": f"""SELECT run, 'sweeps/' || run AS folder, regexp_extract(run, '_r([0-9]+)', 1) AS lora_r, epoch, bleu, chrfpp, geomean
            FROM ({LAST_SCORES})""",
        "translate_and_submit": f"""WITH {collapsed(f'''SELECT conv_id || '-' || turn AS id,
            CASE WHEN clean = '' THEN '...' ELSE {stripped_output(looked_up('clean'))} END AS text
            FROM (SELECT conv_id, turn, {cleaned_source('source')} AS clean FROM ({RAW_PAIRS}))''')}
            SELECT id, {default} AS translation FROM collapsed""",
        "position_counts": """SELECT test_rows, prediction_rows, test_rows = prediction_rows AS same FROM (
            SELECT count(*) FILTER (role = 'user') AS test_rows, count(*) FILTER (role = 'assistant') AS prediction_rows FROM conversations)""",
        "run_names": """SELECT p_partkey, lower(p_name) || '_r' || coalesce((CASE WHEN p_size % 5 <> 0 THEN p_size END)::VARCHAR, '32')
            || '-a' || coalesce((CASE WHEN p_size % 7 <> 0 THEN p_size * 2 END)::VARCHAR, '64')
            || '_lr' || CASE WHEN p_size % 3 = 0 THEN '1e-4' ELSE '0.0002' END
            || '_ep' || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '3' END AS run_name FROM part""",
        "context_windows": f"""SELECT conv_id, turn, array_to_string(lines_before, chr(10)) AS lines_before, array_to_string(lines_after, chr(10)) AS lines_after
            FROM (SELECT *, {around("PARTITION BY conv_id ORDER BY turn", 2, 2)} FROM conversations)""",
        "context_prompts": f"""SELECT doc_id, line, {q(system + template.message_start + "user" + template.role_end + "Translate: ")}
            || CASE WHEN len(lines_before) > 0 THEN '[Preceding lines: ' || array_to_string(lines_before, chr(10)) || ']' || chr(10) ELSE '' END
            || 'Translate this sentence: ' || text
            || CASE WHEN len(lines_after) > 0 THEN chr(10) || '[Following lines: ' || array_to_string(lines_after, chr(10)) || ']' ELSE '' END
            || {q(template.message_end + template.generation)} AS prompt
            FROM (SELECT *, {around("PARTITION BY doc_id ORDER BY line", 3, 1)} FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line FROM documents))""",
        "lexicon_names": f"""SELECT form, arg_min(norm, (list_position(['PN', 'GN', 'DN'], type), norm)) AS norm FROM ({LEXICON})
            WHERE type IN ('PN', 'GN', 'DN') GROUP BY form""",
        "lexicon_hints": f"""WITH meanings AS (SELECT form, list_sort(list(DISTINCT meaning)) AS meanings FROM ({LEXICON}) GROUP BY form),
            words AS (SELECT doc_id, list_filter(string_split_regex(text, {q(WS + '+')}), lambda w: w <> '') AS ws FROM documents),
            placed AS (SELECT doc_id, form, min(i) AS place FROM (SELECT doc_id, unnest(ws) AS form, generate_subscripts(ws, 1) AS i FROM words) GROUP BY doc_id, form),
            told AS (SELECT form, meanings FROM placed JOIN meanings USING (form) GROUP BY form, meanings
                HAVING count(*) <= 0.01 * (SELECT count(*) FROM documents) OR len(meanings) >= 3),
            lines AS (SELECT doc_id, string_agg('- ' || form || ': ' || array_to_string(meanings, ', '), chr(10) ORDER BY place) AS lines
                FROM placed JOIN told USING (form) GROUP BY doc_id)
            SELECT doc_id, coalesce('Lexicon hints:' || chr(10) || lines, '') AS hints FROM documents LEFT JOIN lines USING (doc_id)""",
        "capitalized_names": capitals("documents"),
        "fuzzy_pairs": fuzzy_pairs(),
        "fuzzy_names": f"""WITH pairs AS ({fuzzy_pairs()}), nearest AS (SELECT form, min(distance) AS distance FROM pairs GROUP BY form)
            SELECT form, any_value(canonical) AS canonical, any_value(distance) AS distance FROM pairs JOIN nearest USING (form, distance)
            GROUP BY form HAVING count(*) = 1""",
        "replaced_names": REPLACED_NAMES,
        "candidate_agreement": f"SELECT conv_id, candidate, agreement FROM ({agreements()})",
        "chosen_candidates": f"""SELECT conv_id, candidate, agreement FROM ({agreements()})
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(fine, 0) DESC, candidate) = 1""",
        "run_scores": f"""SELECT run, bleu, chrfpp, geomean, epoch, 'model' AS model, regexp_extract(run, '_r([0-9]+)', 1)::INT AS lora_r,
            32 AS lora_alpha, 0.0001::DOUBLE AS lr, 4 AS epochs FROM ({LAST_SCORES})""",
        "best_run": f"""SELECT epoch, run, bleu, chrfpp, geomean FROM ({EPOCH_SCORES})
            QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY geomean DESC, run DESC) = 1""",
        "ranked_runs": f"""SELECT run, epoch, bleu, chrfpp, geomean, regexp_extract(run, '_(r[0-9]+)-', 1) AS tag,
            row_number() OVER (PARTITION BY epoch ORDER BY geomean DESC, run DESC) AS place FROM ({EPOCH_SCORES})""",
    }
