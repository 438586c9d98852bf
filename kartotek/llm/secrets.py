"""Secrets in texts, and the weaker parts of credentials that become telling only next to each other.

Three kinds of spans are secrets by themselves: assignments, access identifiers and long hexadecimal strings. Three more
are weak: mixed tokens (and assignments of few characters), account names and endpoints. A text is divided into scopes by its
blank lines, every part claims an interval that reaches a little beyond it, and within a scope the intervals of
complementary parts are joined. The join is a sweep: for each part, the largest end of each class before it and the
smallest start after it tell whether any part of that class is in reach, so no pairs are made. A weak part is reported
only where its complements are.

All of it is built-in SQL functions. A text is scanned where it lies: the pieces between matches and the matches give
positions as running sums. Only the matches, as numbers, are shuffled, by row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kartotek.sizing import pinned

KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
ASSIGN, ACCESS, HEX, SECRET, IDENTIFIER, ENDPOINT = range(1, 7)
BREAK = 0
REACH = 200
LEAST_VALUE = 8


def either_case(pattern: str) -> str:
    """Letters of a pattern in upper and lower case, ASCII only; not for patterns with letters in classes or escapes."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern)


# What stands between a name and its value, the names of secrets, the three base patterns
_IS = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN_PATTERN = f"({either_case('password|passwd|secret|token|api_?key')}){_IS}([A-Za-z0-9+/_.=-]+)"
ACCESS_PATTERN = "AKIA[A-Z0-9]{12,}"
HEX_PATTERN = "[0-9a-f]{32,}"

# Weak parts: tokens, names of accounts, addresses of services, and what parts scopes
TOKEN_PATTERN = "[A-Za-z0-9+/_-]{20,}"
IDENTIFIER_PATTERN = (
    f"({either_case('user(name)?|login|account|client[_-]?id|access[_-]?key[_-]?id|key[_-]?id')}){_IS}[A-Za-z0-9_.@-]+"
)
ENDPOINT_PATTERN = r"""(https?|ftps?|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|ldaps?|s3)://[^\x20\x09-\x0D"'<>]+"""
BREAK_PATTERN = r"\n[\x20\x09\x0D]*\n"

_PART = "array<struct<kind: int, place: int, gap: int, len: int, ok: boolean>>"


def _parts(text: Column, kind: int, pattern: str, wanted: Column, ok) -> Column:
    """The matches of one kind: how far each lies from the one before, its length, and whether it counts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.zip_with(
        hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: F.struct(gap.alias("gap"), hit.alias("hit"))
    )
    rows = F.transform(
        both,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), m["gap"].alias("gap"), F.length(m["hit"]).alias("len"), ok(m["hit"]).alias("ok")
        ),
    )
    return F.when(wanted, rows).otherwise(F.array().cast(_PART))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row with a number of its own and the parts found in its text; weak kinds only where they could count."""
    text = F.col("text")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("row", F.monotonically_increasing_id())
    names = {
        "assign": ASSIGN_PATTERN, "access": ACCESS_PATTERN, "hex": HEX_PATTERN, "identifier": IDENTIFIER_PATTERN,
        "endpoint": ENDPOINT_PATTERN,
    }
    has = rows.select("*", *[text.rlike(pattern).alias(name) for name, pattern in names.items()])
    assign, access, hexed, named, endpoint = (F.col(n) for n in names)
    token = access | (named & endpoint)
    linked = token | (named & (assign | hexed))
    always = lambda hit: F.lit(True)
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN_PATTERN, 2)) >= LEAST_VALUE
    mixed = lambda hit: hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    parts = [
        _parts(text, ASSIGN, ASSIGN_PATTERN, assign, long_value), _parts(text, ACCESS, ACCESS_PATTERN, access, always),
        _parts(text, HEX, HEX_PATTERN, hexed, always), _parts(text, SECRET, TOKEN_PATTERN, token, mixed),
        _parts(text, IDENTIFIER, IDENTIFIER_PATTERN, named & linked, always),
        _parts(text, ENDPOINT, ENDPOINT_PATTERN, endpoint & linked, always), _parts(text, BREAK, BREAK_PATTERN, linked, always),
    ]
    return has.select("doc_id", "row", F.concat(*parts).alias("parts"))


def _among(kinds: tuple[int, ...]) -> Column:
    return F.col("kind").isin(*kinds)


def _spans(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end and ``base`` of every span that is reported."""
    parts = scanned.filter(F.size("parts") > 0).select("row", F.explode("parts").alias("part")).select("row", "part.*")
    of_kind = Window.partitionBy("row", "kind").orderBy("place")
    so_far = of_kind.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = of_kind.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(so_far) + F.coalesce(F.sum("len").over(before), F.lit(0))
    placed = (
        parts.withColumn("start", start).withColumn("end", F.col("start") + F.col("len"))
        .filter(F.col("ok") | (F.col("kind") == ASSIGN))
        .withColumn("kind", F.when((F.col("kind") == ASSIGN) & ~F.col("ok"), SECRET).otherwise(F.col("kind")))
    )
    in_text = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scoped = (
        placed.withColumn("scope", F.count(F.when(F.col("kind") == BREAK, 1)).over(in_text)).filter(F.col("kind") != BREAK)
    )
    in_scope = Window.partitionBy("row", "scope").orderBy("start", "kind", "end")
    earlier = in_scope.rowsBetween(Window.unboundedPreceding, -1)
    later = in_scope.rowsBetween(1, Window.unboundedFollowing)

    def met(reach: int, *kinds: int) -> Column:
        """Whether a part of these kinds lies within reach on either side; with reach -1, overlaps."""
        left = F.max(F.when(_among(kinds), F.col("end"))).over(earlier) >= F.col("start") - reach
        right = F.min(F.when(_among(kinds), F.col("start"))).over(later) <= F.col("end") + reach
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    covered = ((F.col("kind") == SECRET) & met(-1, ASSIGN, ACCESS, HEX, IDENTIFIER, ENDPOINT)) | (
        (F.col("kind") == IDENTIFIER) & met(-1, ASSIGN, ACCESS, HEX, ENDPOINT)
    )
    single = scoped.withColumn("covered", covered).filter("NOT covered")
    endpoint, named, secret = met(REACH, ENDPOINT), met(REACH, IDENTIFIER), met(REACH, SECRET)
    base = F.col("kind") <= HEX
    linked = reduce(
        lambda a, b: a | b,
        [
            base,
            (F.col("kind") == SECRET) & (met(REACH, ACCESS) | (named & endpoint)),
            (F.col("kind") == IDENTIFIER) & (met(REACH, ASSIGN, HEX) | (secret & endpoint)),
            (F.col("kind") == ENDPOINT) & met(REACH, ACCESS, IDENTIFIER) & met(REACH, ASSIGN, HEX, SECRET),
        ],
    )
    return single.withColumn("linked", linked).filter("linked").select("row", "kind", "start", "end", base.alias("base"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, kind, start, end (code points, end exclusive) and ``base`` of each span; ``row`` numbers the rows of ``docs``.

    Base spans are always there. A token is reported with an access identifier in reach, or with both an account name and an
    endpoint; an account name with a base secret, or with a token and an endpoint; an endpoint with an identifier and
    a secret of any kind. Weak parts that overlap stronger ones are not reported. Nulls and empty texts have no spans;
    rows that repeat an id are looked through each by itself.
    """
    scanned = pinned(_scanned(docs, id_col, text_col))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return scanned.select("doc_id", "row").join(_spans(scanned), "row").withColumn("kind", kind)


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 and all spans as text.

    Spans are ordered by start, then by kind; a row without spans has the digest of the empty string and empty spans. No rows
    give no rows.
    """
    scanned = pinned(_scanned(docs, id_col, text_col))
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(
                spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    found = (
        _spans(scanned).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
        .withColumn("base", F.filter("spans", lambda s: s["kind"] <= HEX))
    )

    def counted(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind - 1]}")

    counts = [counted(kind) for kind in (ASSIGN, ACCESS, HEX)]
    digests = found.select("row", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
    rows = scanned.select("doc_id", "row").join(digests, "row", "left")
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:3]],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
