"""The queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartotek.llm import (
    chat, decontamination, exact_dedup, filter_audit, line_dedup, mixing, pii, prefix_trie, secrets, simhash,
    substring_dedup, token_files, toxicity,
)
from kartotek.llm.common import table
from kartotek.sizing import pinned, scratch_path

# Tokenizer files, end id of the token files
BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


@query(
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents),
    keyed AS (
      SELECT doc_id, pos, line,
             translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines),
    common AS (
      SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id < c.keeper) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(k.doc_id < c.keeper, false)), ''))
             AS kept_sha256
    FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id
    """
)
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, folder, "documents"))


@query(
    r"""
    WITH plain AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER best AS kept, text_sha256
    FROM plain WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, folder, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), out, tokenizer_path(WORD_TOKENIZER), END_ID)
    return token_files.read_digests(spark, out)


@query()
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


@query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.clusters(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_digests(table(spark, folder, "documents"), with_lengths=True)


_DECONTAMINATION_SQL = r"""
    WITH texts AS (
      SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
      UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM benchmark),
    split AS (
      SELECT side, id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM texts),
    bare AS (SELECT *, list_transform(words, lambda w: trim(w, {marks})) AS bare FROM split),
    cores AS (SELECT *, list_transform(bare, lambda w: lower(w)) AS cores FROM bare),
    templates AS (
      SELECT side, id, cores, list_transform(cores, lambda w, i: CASE
        WHEN w >= '0' AND w < ':' THEN '<num>'
        WHEN i = 1 OR w = '' THEN w
        WHEN cores[i - 1] >= '0' AND cores[i - 1] < ':' AND w IN ({units}) THEN '<unit>'
        WHEN left(bare[i], 1) <> left(w, 1) AND NOT contains({ends}, right(words[i - 1], 1)) THEN '<name>'
        ELSE w END) AS template FROM cores),
    windows AS (
      SELECT side, id, place, template[place:place + 4] AS shape, cores[place:place + 4] AS vals
      FROM (SELECT *, unnest(range(1, len(template) - 3)) AS place FROM templates)),
    items AS (
      SELECT *, count(*) OVER (PARTITION BY id) AS windows FROM windows
      WHERE side = 'i' AND len(list_filter(shape, lambda w: w <> '' AND NOT starts_with(w, '<'))) >= 3),
    met AS (
      SELECT d.id AS doc_id, i.id AS item_id, i.windows, i.place AS i_place, d.place - i.place AS diagonal,
             i.shape, i.vals AS i_vals, d.vals AS d_vals
      FROM windows d JOIN items i ON d.side = 'd' AND d.shape = i.shape),
    found AS (
      SELECT doc_id, item_id, windows, count(DISTINCT i_place) AS found FROM met GROUP BY ALL
      HAVING count(DISTINCT i_place) * 100 >= windows * 80),
    diagonals AS (SELECT doc_id, item_id, diagonal, count(DISTINCT i_place) AS n FROM met GROUP BY ALL),
    best AS (
      SELECT doc_id, item_id, diagonal FROM diagonals
      QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, diagonal) = 1),
    slots AS (
      SELECT DISTINCT doc_id, item_id, i_vals[k] AS iv, d_vals[k] AS dv
      FROM (SELECT *, unnest(range(1, 6)) AS k FROM met JOIN best USING (doc_id, item_id, diagonal))
      WHERE starts_with(shape[k], '<')),
    checked AS (
      SELECT doc_id, item_id, count(*) = count(DISTINCT iv) AND count(*) = count(DISTINCT dv) AS consistent,
             bool_or(iv <> dv) AS differs
      FROM slots GROUP BY ALL)
    SELECT doc_id, item_id, windows, found, found / windows AS coverage,
           CASE WHEN coalesce(differs, false) THEN 'reparameterised' ELSE 'exact' END AS kind
    FROM found LEFT JOIN checked USING (doc_id, item_id) WHERE coalesce(consistent, true)
""".format(
    marks="'" + decontamination.MARKS.replace("'", "''") + "'",
    units=", ".join(f"'{u}'" for u in decontamination.UNITS),
    ends="'" + decontamination.SENTENCE_ENDS + "'",
)


@query(_DECONTAMINATION_SQL.replace("\\\\", "\\"))
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op10_all_forms(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"), all_forms=True)


@query()
def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


@query()
def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    path = tokenizer_path(BYTE_TOKENIZER)
    segments, paths = chat.pack(rows, path)
    return chat.read_back(pinned(segments), paths, path)


@query(
    r"""
    WITH plain AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
      FROM documents),
    flags AS (
      SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels
      WHERE doc_id IS NOT NULL GROUP BY doc_id),
    fails AS (
      SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
             100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(p.doc_id > min(p.doc_id) OVER (PARTITION BY text), false) AS e,
             coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM plain p LEFT JOIN flags f ON p.doc_id = f.doc_id),
    counts AS (
      SELECT part, [a, b, c, d, e] AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good,
             count(*) FILTER (WHERE toxic) AS toxic
      FROM fails GROUP BY ALL),
    letters AS (SELECT unnest(range(1, 6)) AS f),
    orders AS (
      SELECT [v.f, w.f, x.f, y.f, z.f] AS ord
      FROM letters v, letters w, letters x, letters y, letters z
      WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
    steps AS (
      SELECT part, mask, n, good, toxic, ord,
             coalesce(list_min(list_transform(list_filter(range(1, 6), lambda f: mask[f]), lambda f: list_position(ord, f))), 6)
               AS gone
      FROM counts, orders),
    cells AS (
      SELECT part, ord, step, ord[step] AS f,
             sum(n) FILTER (WHERE gone > step) AS kept, sum(n) FILTER (WHERE gone = step) AS removed,
             sum(n) FILTER (WHERE gone < step AND mask[ord[step]]) AS redundant,
             sum(n) FILTER (WHERE mask[ord[step]] AND len(list_filter(mask, lambda m: m)) = 1) AS unique_fails,
             sum(good) FILTER (WHERE gone = step) AS good_lost, sum(toxic) FILTER (WHERE gone = step) AS toxic_lost
      FROM (SELECT *, unnest(range(1, 6)) AS step FROM steps) GROUP BY part, ord, step)
    SELECT part, array_to_string(list_transform(ord, lambda f: substr('ABCDE', f, 1)), '') AS filter_order,
           step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
           coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
    FROM cells
    """
)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    r"""
    WITH turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
      SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
               [4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
               lambda crc, byte: list_reduce(
                 [xor(crc, byte)] || range(8),
                 lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (
      SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth
      FROM (SELECT c.conv_id, false AS own, i, role, text FROM convs c JOIN turns t ON t.conv_id = base AND i < h
            UNION ALL SELECT c.conv_id, true, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i >= h)),
    keyed AS (
      SELECT conv_id, depth, length(text) AS chars,
             string_agg(length(role) || ':' || length(text) || ':' || role || text, '')
               OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key
      FROM rebuilt
      UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    rows AS (
      SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS above,
             depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM keyed),
    nodes AS (
      SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, max(above) AS above,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
      FROM rows GROUP BY depth, key),
    children AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    figures AS (
      SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.key = c.key),
    below AS (
      SELECT r.depth, r.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM figures f JOIN rows r ON r.conv_id = f.conv_id AND r.depth <= f.depth GROUP BY ALL)
    SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
    FROM figures f JOIN below b ON f.depth = b.depth AND f.key = b.key
    LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.key = f.above
    """
)
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie_digests(table(spark, folder, "conversations"))


_SECRETS_SQL = r"""
    WITH texts AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),
    hits AS ({hits}),
    parts AS (
      SELECT nr, kind, text, pieces, found, unnest(range(1, len(found) + 1)) AS i FROM hits WHERE len(found) > 0),
    placed AS (
      SELECT nr, kind, found[i] AS hit, length(found[i]) AS n,
             sum(length(pieces[i]) + coalesce(length(found[i - 1]), 0)) OVER (PARTITION BY nr, kind ORDER BY i) AS start
      FROM parts),
    judged AS (
      SELECT nr, start, start + n AS stop,
             CASE WHEN kind = 1 AND length(regexp_extract(hit, '{assign}', 2)) < {least} THEN 4 ELSE kind END AS kind
      FROM placed
      WHERE kind <> 4 OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]'))),
    scoped AS (
      SELECT * FROM (SELECT *, count(*) FILTER (WHERE kind = 0) OVER (PARTITION BY nr ORDER BY start, kind, stop) AS scope FROM judged)
      WHERE kind > 0),
    single AS (
      SELECT s.* FROM scoped s WHERE s.kind NOT IN (4, 5) OR NOT EXISTS (
        SELECT 1 FROM scoped o WHERE o.nr = s.nr AND o.scope = s.scope AND o.start < s.stop AND o.stop > s.start
        AND o.kind <> 4 AND (o.kind <> 5 OR s.kind = 4))),
    near AS (
      SELECT a.nr, a.kind, a.start, a.stop, bool_or(b.kind IN (1, 3)) AS strong, bool_or(b.kind = 2) AS access,
             bool_or(b.kind = 4) AS secret, bool_or(b.kind = 5) AS named, bool_or(b.kind = 6) AS endpoint
      FROM single a LEFT JOIN single b ON a.nr = b.nr AND a.scope = b.scope AND b.kind <> a.kind
           AND b.start <= a.stop + {reach} AND b.stop >= a.start - {reach}
      GROUP BY ALL),
    spans AS (
      SELECT nr, kind, start, {names}[kind] || ':' || start || ':' || stop AS span FROM near
      WHERE kind < 4 OR (kind = 4 AND (access OR (named AND endpoint))) OR (kind = 5 AND (strong OR (secret AND endpoint)))
         OR (kind = 6 AND (access OR named) AND (strong OR secret)))
    SELECT t.doc_id, count(*) FILTER (WHERE kind = 1) AS n_assign, count(*) FILTER (WHERE kind = 2) AS n_access,
           count(*) FILTER (WHERE kind = 3) AS n_hex,
           sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 4), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
    FROM texts t LEFT JOIN spans s ON t.nr = s.nr GROUP BY t.nr, t.doc_id
"""


def _secrets_sql() -> str:
    def literal(pattern: str) -> str:
        return pattern.replace("'", "''")

    patterns = {
        secrets.ASSIGN: secrets.ASSIGN_PATTERN, secrets.ACCESS: secrets.ACCESS_PATTERN, secrets.HEX: secrets.HEX_PATTERN,
        secrets.SECRET: secrets.TOKEN_PATTERN, secrets.IDENTIFIER: secrets.IDENTIFIER_PATTERN,
        secrets.ENDPOINT: secrets.ENDPOINT_PATTERN, secrets.BREAK: secrets.BREAK_PATTERN,
    }
    hits = " UNION ALL ".join(
        f"SELECT nr, {kind} AS kind, text, string_split_regex(text, '{literal(p)}') AS pieces, "
        f"regexp_extract_all(text, '{literal(p)}', 0) AS found FROM texts"
        for kind, p in patterns.items()
    )
    values = {
        "{hits}": hits, "{assign}": literal(secrets.ASSIGN_PATTERN), "{least}": str(secrets.LEAST_VALUE),
        "{reach}": str(secrets.REACH), "{names}": str(list(secrets.KINDS)),
    }
    sql = _SECRETS_SQL
    for name, value in values.items():
        sql = sql.replace(name, value)
    return sql


@query(_secrets_sql())
def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digests(table(spark, folder, "documents"))
