"""Find benchmark questions in documents, also with other numbers, names and units. Native Spark SQL only.

Texts become templates: words without marks at their ends, in lower case, where a number, a unit after a number and a
name (a capital within a sentence) are replaced by typed placeholders. Windows of five template words are matched by
hash join. A window counts when at least three of its words are no placeholders.

An item is found in a document that holds ``share`` of its windows. Such a document must hold one of the item's
rarest windows, whichever others it lacks: only as many windows as it may lack, and one more, are searched in the
whole corpus, so a phrase that many items share brings no pairs. The pairs found are then checked in full.

On the diagonal (place in the document less place in the item) with the most windows the slots are compared: each
value of the item must stand for one value of the document and the other way round. Slots that differ but are
consistent tell a re-parameterised question; slots that contradict each other tell another text.

That is the rule of the SQL. With ``all_forms`` more is found: texts are read in several ways, and a
window is found in any of them. A unit written right after its number is a word of its own in all of them. In the second
reading number words are numbers and names are words like others, so case does not matter. In the
third every capitalised word is a name, also at the start of a text or sentence, unless all letters around it are
capitals. Slots are then compared on every diagonal that holds the share (or the most windows, where none does), one
that is consistent is enough, and only names must stand for one another; numbers may become equal or part. Items
without a window that counts, or with so few that none may be lacking, are also found by all their words in a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kartotek.llm.common import id_and_text, without_ids
from kartotek.sizing import pinned

# Marks cut off the ends of words, ends of sentences, units of measure
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'"
SENTENCE_ENDS = ".!?:;"
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yards", "mile", "miles", "mg", "g", "kg", "grams",
    "tons", "lb", "pounds", "ml", "l", "liters", "litres", "gallons", "s", "sec", "seconds", "min", "minutes", "h",
    "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh",
    "meters", "metres", "kilometers", "kilograms", "watts", "volts", "joules", "newtons",
)

CLOCK = ("am", "pm")
ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
TEENS = (
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
LARGE = ("zero", "hundred", "thousand", "million", "billion", "dozen")
NUMBER_WORDS = (*ONES, *TEENS, *TENS, *LARGE, *(f"{ten}-{one}" for ten in TENS for one in ONES))

WORDS = 5
CONTENT = 3
LEAST_CONTENT = 2
FEW_WINDOWS = 4
KEY_WORDS = 8
SHARE_PERCENT = 80
LEAST_WORDS = 3

_NO_ID = -(1 << 63)
_SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _templates(rows: DataFrame, all_forms: bool = False) -> DataFrame:
    """``rows`` with the arrays ``cores`` (words without marks at their ends, in lower case) and ``template``.

    With ``all_forms`` there is ``forms`` too, the array of all readings of a text, of which the template is the first.
    """
    units = ", ".join(map(_quoted, UNITS))
    if all_forms:
        glued = "([0-9])((?i:" + "|".join((*UNITS, *CLOCK)) + "))(?![A-Za-z0-9])"
        rows = rows.withColumn("text", F.regexp_replace("text", glued, "$1 $2"))
    words = rows.withColumn("words", F.expr(f"array_remove(split(text, '{_SPACE}'), '')")).drop("text")
    bare = words.withColumn("bare", F.expr(f"transform(words, w -> btrim(w, {_quoted(MARKS)}))"))
    read = bare.withColumn("cores", F.expr("transform(bare, w -> lower(w))")).withColumn(
        "template",
        F.expr(
            f"""transform(cores, (w, i) -> CASE
                WHEN w >= '0' AND w < ':' THEN '<num>'
                WHEN i = 0 OR w = '' THEN w
                WHEN get(cores, i - 1) >= '0' AND get(cores, i - 1) < ':' AND w IN ({units}) THEN '<unit>'
                WHEN left(get(bare, i), 1) <> left(w, 1)
                     AND instr({_quoted(SENTENCE_ENDS)}, right(get(words, i - 1), 1)) = 0 THEN '<name>'
                ELSE w END)"""
        ),
    )
    if all_forms:
        numbers, measures = (", ".join(map(_quoted, words)) for words in (NUMBER_WORDS, (*UNITS, *CLOCK)))
        read = read.withColumn(
            "folded",
            F.expr(
                f"""transform(cores, (w, i) -> CASE
                    WHEN w >= '0' AND w < ':' OR w IN ({numbers}) THEN '<num>'
                    WHEN w IN ({measures}) AND i > 0 AND (
                        get(cores, i - 1) >= '0' AND get(cores, i - 1) < ':' OR get(cores, i - 1) IN ({numbers})
                    ) THEN '<unit>'
                    ELSE w END)"""
            ),
        ).withColumn(
            "named",
            F.expr(
                """transform(folded, (w, i) -> CASE
                    WHEN w = '' OR startswith(w, '<') OR left(bare[i], 1) = left(cores[i], 1) THEN w
                    WHEN bare[i] = upper(bare[i])
                         AND coalesce(get(bare, i - 1) = upper(get(bare, i - 1)), true)
                         AND coalesce(get(bare, i + 1) = upper(get(bare, i + 1)), true) THEN w
                    ELSE '<name>' END)"""
            ),
        ).withColumn("forms", F.array("template", "folded", "named")).drop("folded", "named")
    return read.drop("words", "bare")


def _hashes_of(template: str) -> str:
    return f"""CASE WHEN size({template}) >= {WORDS}
        THEN transform(sequence(1, size({template}) - {WORDS - 1}), i -> xxhash64(slice({template}, i, {WORDS})))
        ELSE cast(array() AS array<bigint>) END"""


def _windows(templates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window: its keys, place, hash, template words and values; one of nulls for texts without.

    The outer form keeps the optimizer from testing the arrays before they are made, which would work them out anew
    for each word.
    """
    hashed = templates.withColumn("hashes", F.expr(_hashes_of("template")))
    return hashed.select(*keys, "cores", "template", F.posexplode_outer("hashes").alias("place", "hash")).select(
        *keys, "place", "hash", F.expr(f"slice(template, place + 1, {WORDS})").alias("shape"),
        F.expr(f"slice(cores, place + 1, {WORDS})").alias("values"),
    )


def _form_windows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The windows of all readings, with the number of the ``reading``."""
    read = _templates(rows, True).select(*keys, "cores", F.posexplode_outer("forms").alias("reading", "template"))
    return _windows(read, [*keys, "reading"])


_CONTENT = "size(filter(shape, w -> w <> '' AND NOT startswith(w, '<')))"


def item_forms(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """As :func:`item_windows`, with a row for each hash that a window has in some reading.

    The same windows count; of an item without any, those that count in the second reading do. A reading that leaves
    a window fewer than two words is not searched.
    """
    rows = _items(benchmark, item_col, text_col)
    own, at = Window.partitionBy("item_id", "item"), Window.partitionBy("item_id", "item", "place")
    full = F.col("content") >= CONTENT
    counted = (
        _form_windows(rows, ["item_id", "item"]).withColumn("content", F.expr(_CONTENT))
        .withColumn("basis", F.when(F.max(full & (F.col("reading") == 0)).over(own), 0).otherwise(1))
        .withColumn("counts", F.max(full & (F.col("reading") == F.col("basis"))).over(at))
        .filter(F.col("counts") & (F.col("content") >= LEAST_CONTENT))
        .select("item_id", "item", "place", "hash", "shape", "values").dropDuplicates(["item_id", "item", "place", "hash"])
    )
    held = counted.groupBy("hash").agg(F.count_distinct("item").alias("items"))
    ranked = (
        counted.join(held, "hash").withColumn("most", F.max("items").over(at))
        .withColumn("rank", F.dense_rank().over(own.orderBy("most", "place")))
        .withColumn("windows", F.max("rank").over(own).cast("long"))
    )
    return pinned(ranked.withColumn("probe", _is_probe()).drop("rank", "items", "most"))


def _plain(rows: DataFrame) -> DataFrame:
    """``rows`` with ``plain``, all words in lower case without marks at their ends; words of marks alone stay."""
    words = rows.withColumn("words", F.expr(f"array_remove(split(text, '{_SPACE}'), '')")).drop("text")
    core = f"btrim(w, {_quoted(MARKS)})"
    return words.withColumn("plain", F.expr(f"transform(words, w -> lower(coalesce(nullif({core}, ''), w)))")).drop("words")


def short_items(benchmark: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The words, without marks alone at either end, of items with few or no windows; and the hash of the first ones."""
    many = items.filter(F.col("windows") > FEW_WINDOWS).select("item_id", "item").distinct()
    ends = f"btrim(w, {_quoted(MARKS)}) <> ''"
    span = f"filter(transform(plain, (w, i) -> CASE WHEN {ends} THEN i END), i -> i IS NOT NULL)"
    return pinned(
        _plain(_items(benchmark, item_col, text_col).join(many, ["item_id", "item"], "left_anti"))
        .withColumn("span", F.expr(span)).filter("size(span) > 0")
        .withColumn("wanted", F.expr("slice(plain, span[0] + 1, array_max(span) - span[0] + 1)"))
        .withColumn("length", F.least(F.size("wanted"), F.lit(KEY_WORDS)))
        .select("item_id", "item", "wanted", "length", F.xxhash64(F.expr("slice(wanted, 1, length)")).alias("key"))
    )


def _in_a_row(rows: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs doc, item_id of documents that hold all words of a short item in a row; the first words are joined by hash."""
    lengths = sorted(r["length"] for r in short.select("length").distinct().collect())
    if not lengths:
        return rows.select("doc", F.lit(None).cast("long").alias("item_id")).filter(F.lit(False))
    keys = ", ".join(
        f"CASE WHEN size(plain) >= {n} THEN transform(sequence(1, size(plain) - {n - 1}), i -> xxhash64(slice(plain, i, {n})))"
        " ELSE cast(array() AS array<bigint>) END"
        for n in lengths
    )
    searched = _plain(rows).withColumn("keys", F.expr(f"array_distinct(concat({keys}))")).select(
        "doc", "row", F.explode_outer("keys").alias("at")
    )
    pairs = pinned(
        searched.join(short, F.col("at") == F.col("key")).select("doc", "row", "item_id", "item").distinct()
    )
    wanted = pairs.select(F.col("doc").alias("d"), F.col("row").alias("r")).distinct()
    again = rows.join(wanted, (F.col("doc") == F.col("d")) & (F.col("row") == F.col("r")), "left_semi").distinct()
    held = _plain(again).join(pairs, ["doc", "row"]).join(short.select("item_id", "item", "wanted"), ["item_id", "item"])
    whole = "size(plain) >= size(wanted) AND exists(sequence(1, greatest(size(plain) - size(wanted), 0) + 1), i -> slice(plain, i, size(wanted)) = wanted)"
    return held.filter(F.expr(whole)).select("doc", "item_id").distinct()


def _is_probe():
    return F.col("rank") <= F.col("windows") - F.ceil(F.col("windows") * SHARE_PERCENT / 100) + 1


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return id_and_text(benchmark, item_col, text_col).select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("item_id"), F.xxhash64("text").alias("item"), "text"
    ).distinct()


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows that count of every item, their number, and whether they are probes."""
    rows = _items(benchmark, item_col, text_col)
    counted = _windows(_templates(rows), ["item_id", "item"]).filter(F.expr(_CONTENT) >= CONTENT)
    own = Window.partitionBy("item_id", "item")
    held = counted.groupBy("hash").agg(F.count_distinct("item").alias("items"))
    ranked = counted.join(held, "hash").withColumn("windows", F.count(F.lit(1)).over(own)).withColumn(
        "rank", F.row_number().over(own.orderBy("items", "place"))
    )
    return pinned(ranked.withColumn("probe", _is_probe()).drop("rank", "items"))


_SLOTS = "filter(arrays_zip(shape, i_values, values), s -> startswith(s.shape, '<'))"


def _strict_slots(met: DataFrame, pair: list[str]) -> DataFrame:
    """Whether the slots of each pair are one to one on its best diagonal, and whether any differs."""
    best = (
        met.groupBy(*pair, "diagonal").agg(F.count_distinct("i_place").alias("n"))
        .groupBy(*pair).agg(F.max(F.struct("n", (-F.col("diagonal")).alias("neg"))).alias("top"))
        .select(*pair, (-F.col("top.neg")).alias("diagonal"))
    )
    slot = F.explode(F.expr(_SLOTS)).alias("slot")
    return (
        met.join(best, [*pair, "diagonal"]).select(*pair, slot).select(*pair, "slot.i_values", "slot.values").distinct()
        .groupBy(*pair).agg(
            F.count(F.lit(1)).alias("pairs"), F.count_distinct("i_values").alias("left"),
            F.count_distinct("values").alias("right"), F.max(F.col("i_values") != F.col("values")).alias("differs"),
        )
        .select(*pair, F.expr("pairs = left AND pairs = right").alias("consistent"), "differs")
    )


def _free_slots(met: DataFrame, pair: list[str]) -> DataFrame:
    """Whether names are one to one on some diagonal that holds the share, and whether slots differ on all of these."""
    on = [*pair, "diagonal"]
    held = met.groupBy(*on, "windows").agg(F.count_distinct("i_place").alias("n"))
    enough = F.least(F.ceil(F.col("windows") * SHARE_PERCENT / 100), F.max("n").over(Window.partitionBy(*pair)))
    wide = held.withColumn("enough", enough).filter("n >= enough").select(*on)
    slot = F.explode_outer(F.expr(_SLOTS)).alias("slot")
    name = F.col("shape") == "<name>"
    values = (
        met.join(wide, on).select(*on, slot).select(*on, "slot.shape", "slot.i_values", "slot.values").distinct()
        .groupBy(*on).agg(
            F.count(F.when(name, 1)).alias("pairs"), F.count_distinct(F.when(name, F.col("i_values"))).alias("left"),
            F.count_distinct(F.when(name, F.col("values"))).alias("right"),
            F.coalesce(F.max(F.col("i_values") != F.col("values")), F.lit(False)).alias("differs"),
        )
        .withColumn("fits", F.expr("pairs = left AND pairs = right"))
    )
    return values.groupBy(*pair).agg(
        F.max("fits").alias("consistent"), F.min(F.when(F.col("fits"), F.col("differs"))).alias("differs")
    )


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", all_forms: bool = False,
) -> DataFrame:
    """Pairs doc_id, item_id of documents and the items found in them, with windows, found, coverage and kind.

    ``kind`` is ``exact`` where all slots are equal and ``reparameterised`` where they differ consistently. Items of
    fewer than five words, or without a window that counts, are found by ``all_forms`` alone, as one window of their
    own length; items without words are never found. Null texts are empty, null ids are ids
    like others, rows that repeat an id are searched one by one and their pair is told once, with the best coverage.
    Empty tables give no rows.
    """
    items = (item_forms if all_forms else item_windows)(benchmark, item_col, item_text_col)
    rows = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text"
    )
    probes = pinned(items.filter("probe").select("item_id", "item", F.col("hash").alias("probe_hash")))
    hashes = _hashes_of("template")
    if all_forms:
        hashes = f"array_distinct(flatten(transform(forms, f -> {_hashes_of('f')})))"
    searched = _templates(rows, all_forms).drop("cores").withColumn("hashes", F.expr(hashes)).select(
        "doc", "row", F.explode_outer("hashes").alias("hash")
    )
    pairs = pinned(
        searched.join(probes, F.col("hash") == F.col("probe_hash")).select("doc", "row", "item_id", "item").distinct()
    )
    wanted = pinned(pairs.select(F.col("doc").alias("d"), F.col("row").alias("r")).distinct())
    again = rows.join(wanted, (F.col("doc") == F.col("d")) & (F.col("row") == F.col("r")), "left_semi").distinct()
    split = _form_windows(again, ["doc", "row"]) if all_forms else _windows(_templates(again), ["doc", "row"])
    candidates = split.join(pairs, ["doc", "row"])
    sides = items.select(
        F.col("item_id").alias("i_id"), F.col("item").alias("i"), F.col("hash").alias("i_hash"),
        F.col("place").alias("i_place"), F.col("values").alias("i_values"), "windows",
    )
    met = pinned(
        candidates.join(
            sides,
            (F.col("item_id") == F.col("i_id")) & (F.col("item") == F.col("i")) & (F.col("hash") == F.col("i_hash")),
        ).withColumn("diagonal", F.col("place") - F.col("i_place"))
        .select("doc", "row", "item_id", "item", "windows", "i_place", "diagonal", "shape", "values", "i_values")
    )
    pair = ["doc", "row", "item_id", "item"]
    found = met.groupBy(*pair, "windows").agg(F.count_distinct("i_place").alias("found")).filter(
        F.col("found") * 100 >= F.col("windows") * SHARE_PERCENT
    )
    checked = (_free_slots if all_forms else _strict_slots)(met, pair)
    told = found.join(checked, pair, "left").filter("coalesce(consistent, true)")
    kind = F.when(F.coalesce("differs", F.lit(False)), "reparameterised").otherwise("exact")
    told = told.select("doc", "item_id", "found", "windows", kind.alias("kind"))
    if all_forms:
        short = _in_a_row(rows, short_items(benchmark, items, item_col, item_text_col))
        one = F.lit(1).cast("long")
        told = told.unionByName(
            short.select("doc", "item_id", one.alias("found"), one.alias("windows"), F.lit("exact").alias("kind"))
        )
    return (
        told.groupBy("doc", "item_id")
        .agg(F.max(F.struct((F.col("found") / F.col("windows")).alias("coverage"), "found", "windows", "kind")).alias("m"))
        .select(
            F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), F.nullif("item_id", F.lit(_NO_ID)).alias("item_id"),
            F.col("m.windows").cast("long").alias("windows"),
            F.col("m.found").cast("long").alias("found"), F.col("m.coverage").alias("coverage"), F.col("m.kind").alias("kind"),
        )
    )


def few_words(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id of items all of whose texts have fewer than ``least_words`` words; marks alone are no words."""
    core = f"btrim(w, {_quoted(MARKS)})"
    return (
        _items(benchmark, item_col, text_col)
        .select("item_id", F.expr(f"size(filter(split(text, '{_SPACE}'), w -> {core} <> ''))").alias("n"))
        .groupBy("item_id").agg(F.max("n").alias("n")).filter(F.col("n") < least_words)
        .select(F.nullif("item_id", F.lit(_NO_ID)).alias("item_id"))
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", least_words: int = LEAST_WORDS, **columns,
) -> DataFrame:
    """``docs`` without the documents in which an item is found; rows that share an id go together.

    Items of fewer than ``least_words`` words (:func:`few_words`) take no document out: such words stand anywhere.
    """
    few = few_words(benchmark, item_col, item_text_col, least_words).withColumnRenamed("item_id", "__few")
    found = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, **columns)
    found = found.join(few, F.col("item_id").eqNullSafe(F.col("__few")), "left_anti").select("doc_id").distinct()
    return without_ids(docs, pinned(found), id_col)
