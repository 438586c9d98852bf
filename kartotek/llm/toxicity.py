"""Toxicity of texts, looking through leetspeak, spacing and repetition.

* A character language model (trigrams of letters) is counted over the words of all documents.
* A word with a doubled letter, a leet sign or any inner mark is a lattice: a digit or mark may stand for a letter or
  for nothing, a run of a letter for one or two of it, other marks for nothing; single letters in a row, whatever white
  space parts them, are one word. Viterbi search finds the likeliest restored word under the language model.
* Words and their beginnings that tell toxic texts from others are found on a sample of labelled rows, and a logistic
  regression on a second part of the sample turns what a restored text contains into a score.

The sample has about ``sample_rows`` labelled rows, drawn by a hash of the id (a documented bound); so are the number
of telling features and the letters with histories in the language model; others have their own frequency. Everything else covers all documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kartotek.llm import common
from kartotek.sizing import pinned

# What digits and marks may stand for
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}

SAMPLE_ROWS = 20_000
LEXICON = 5_000
LETTERS = 64
PREFIXES = range(4, 9)
MIN_EVIDENCE = 30.0
MIN_ODDS = 2.0
WORD_CACHE = 100_000
COUNTED_TEXTS = 500
COUNTED_ROWS = 200
START, END = "^", "$"

_ENDS = ".,;:!?\"'()[]{}<>#%&*/\\-_=~`"
_MARKS = re.escape("".join(LEET))
_LETTER = r"[^\W\d_]"
_HIDDEN = re.compile(rf"{_LETTER}[{_MARKS}]|[{_MARKS}]{_LETTER}|({_LETTER})\1|[\W_]")
_ANY_LETTER = re.compile(_LETTER)
_DOUBLED = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_WIDE = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


@dataclass
class Language:
    """Log probabilities of a letter after two others, with the mean of shorter histories for what was not seen."""

    trigrams: dict[str, float]
    bigrams: dict[str, float]
    unseen: float
    letters: dict[str, float] = field(default_factory=dict)
    rare: frozenset[str] = frozenset()

    def step(self, history: str, letter: str) -> float:
        found = self.trigrams.get(history + letter)
        if found is not None:
            return found
        pair = self.bigrams.get(history[-1] + letter)
        if pair is None and (letter in self.rare or history[-1] in self.rare):
            return self.letters.get(letter, self.unseen) - 2.0
        return (self.unseen if pair is None else pair) - 1.0


def language_of(counts: dict[str, int], letters: dict[str, int] | None = None) -> Language:
    """The model of trigram counts (two letters of history and a letter; START and END mark a word's ends).

    ``letters`` counts all letters; those that are in no trigram are rare and known by their own counts only.
    """
    pairs, history, last = Counter(), Counter(), Counter()
    for gram, n in counts.items():
        history[gram[:2]] += n
        pairs[gram[1:]] += n
        last[gram[1]] += n
    return Language(
        {g: log(n / history[g[:2]]) for g, n in counts.items()},
        {p: log(n / last[p[0]]) for p, n in pairs.items()},
        log(1.0 / (sum(last.values()) + 1.0)),
        {c: log(n / max(sum((letters or {}).values()), 1)) for c, n in (letters or {}).items()},
        frozenset(letters or {}) - {c for gram in counts for c in gram},
    )


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of the words of letters alone, marks at their ends aside, counted over some texts at a time."""
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])
    point, end = np.uint64((1 << 21) - 1), np.uint64(ord(END))
    for batch in batches:
        for start in range(0, batch.num_rows, COUNTED_TEXTS):
            low = pc.utf8_lower(batch.column("text").slice(start, COUNTED_TEXTS).cast(pa.large_string()))
            found = pc.value_counts(pc.list_flatten(pc.utf8_split_whitespace(low)))
            plain = pc.utf8_trim(found.field("values"), _ENDS)
            letters = pc.utf8_is_alpha(plain)
            first, last, none = (pa.scalar(x, pa.large_string()) for x in (START + START, END, ""))
            marked = pc.binary_join_element_wise(first, plain.filter(letters), last, none)
            counts = np.repeat(found.field("counts").filter(letters).to_numpy(), pc.utf8_length(marked).to_numpy())
            codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            if not len(codes):
                continue
            inside = (codes[:-2] != end) & (codes[1:-1] != end)
            grams = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[inside]
            values, at = np.unique(grams, return_inverse=True)
            totals = np.bincount(at, weights=counts[:-2][inside]).astype(np.int64)
            three = np.stack([values >> np.uint64(42), (values >> np.uint64(21)) & point, values & point], axis=1)
            text = np.ascontiguousarray(three.astype("<u4")).tobytes().decode("utf-32-le")
            yield common.batch_of(schema, ([text[i : i + 3] for i in range(0, len(text), 3)], pa.array(totals)))
    pa.default_memory_pool().release_unused()


def learn_language(docs: DataFrame, letters: int = LETTERS) -> Language:
    """The language model of all texts over their ``letters`` most frequent letters."""
    counts = pinned(docs.mapInArrow(_trigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    last = F.substring("gram", 3, 1)
    every = {
        r["letter"]: r["n"]
        for r in counts.groupBy(last.alias("letter")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").collect()
    }
    known = {START, END, *list(every)[: letters + 1]}
    inside = F.lit(True)
    for i in (1, 2, 3):
        inside &= F.substring("gram", i, 1).isin(sorted(known))
    return language_of({r["gram"]: r["n"] for r in counts.filter(inside & (F.length("gram") == 3)).collect()}, every)


def _lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, the strings it may stand for and what each costs.

    A digit or mark that stands for nothing is dear within a word, where every letter costs something too, and
    cheaper at its ends, where marks are common.
    """
    out = []
    for run in re.finditer(r"(.)\1*", word, re.DOTALL):
        char, length = run[1], len(run[0])
        if char in LEET:
            options = [("", 4.0 if run.end() == len(word) else 7.0 if run.start() == 0 else 9.0)]
            for letter in LEET[char]:
                options.append((letter, 0.5))
                if length > 1:
                    options.append((letter * 2, 0.8))
        elif char.isalpha():
            options = [(char, 0.0 if length == 1 else 0.5)]
            if length > 1:
                options.append((char * 2, 0.0 if length == 2 else 0.5))
        elif unicodedata.category(char)[0] == "M":
            options = [(run[0], 0.0)]
        else:
            options = [("", 0.2)]
        out.append(options)
    return out


def restore(word: str, language: Language) -> str:
    """The likeliest word behind an obfuscated one."""
    return _thinned(word, language) if word.isalpha() else _likeliest(word, language)


def _thinned(word: str, language: Language) -> str:
    """As :func:`_likeliest` for letters alone: all paths meet one letter after a run, so each run is settled by itself."""

    def settled(run: re.Match) -> str:
        char, length = run[1], len(run[0])
        before = word[run.start() - 1] if run.start() else START
        after = word[run.end()] if run.end() < len(word) else END
        one = language.step(before + char, after) - 0.5
        two = language.step(before + char, char) + language.step(char * 2, after) - (0.0 if length == 2 else 0.5)
        return char * 2 if two > one else char

    return _RUN.sub(settled, word)


def _likeliest(word: str, language: Language) -> str:
    """Viterbi search over the lattice of ``word``."""
    paths: dict[str, tuple[float, tuple]] = {START + START: (0.0, ())}
    for options in _lattice(word):
        following: dict[str, tuple[float, tuple]] = {}
        for history, (score, back) in paths.items():
            for letters, cost in options:
                now, state = score - cost, history
                for letter in letters:
                    now += language.step(state, letter)
                    state = state[1] + letter
                if state not in following or now > following[state][0]:
                    following[state] = now, (letters, back) if letters else back
        paths = following
    _, back = max(
        ((score + language.step(history, END), back) for history, (score, back) in paths.items()), key=lambda x: x[0]
    )
    parts = []
    while back:
        parts.append(back[0])
        back = back[1]
    return "".join(reversed(parts))


def plain_word(word: str, language: Language) -> str:
    """A lower-case word without marks at its ends, restored where it looks obfuscated."""
    if word.isalpha() and not _DOUBLED.search(word):
        return word
    core = word.strip(_ENDS)
    if not _HIDDEN.search(core) or not _ANY_LETTER.search(core):
        return core
    return restore(core, language)


def restored_words(text: str, language: Language, known: dict[str, str]) -> set[str]:
    """The distinct words of the restored text."""
    low = text.lower()
    written = set(low.split())
    words = {known[w] for w in written}
    if any(len(w) == 1 for w in written):
        for run in _WIDE.finditer(low):
            words.update(restore(joined, language) for joined in _joined(run[0]))
    return words


def _joined(run: str) -> set[str]:
    """Words that single letters in a row may be: all of them, those one blank apart, those the least space apart."""
    out = {"".join(run.split())} | {"".join(part[0].split()) for part in _SPACED.finditer(run)}
    least = min(map(len, re.findall(r"\s+", run)))
    parts = re.split(rf"\s{{{least + 1},}}", run)
    return out | {word for word in ("".join(part.split()) for part in parts) if len(word) > 2}


def restored_text(text: str, language: Language) -> str:
    """The text with words restored and spaced letters joined, for reading and for other scorers."""
    low = text.lower()
    for spaced in (_SPACED, _WIDE):
        low = spaced.sub(lambda m: restore("".join(m[0].split()), language), low)
    return re.sub(r"\S+", lambda m: plain_word(m[0], language), low)


def features(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def feature_hash(feature: str) -> int:
    h = xxhash.xxh3_64_intdigest(feature)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Model:
    language: Language
    weights: dict[str, float]
    bias: float
    slopes: tuple[float, ...]

    def word_weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def telling_words(self) -> common.Memo:
        """The restored form of words that have a weight, by the words as written; others give an empty text.

        Most words of letters alone are settled without restoring them: a word has a weight only if it begins like a
        telling word or beginning, and a restored one only if it does so with all runs of a letter as one letter.
        """
        heads = {f.lstrip("=")[: PREFIXES[0]] for f in self.weights}
        single = {_RUN.sub(r"\1", f.lstrip("=")) for f in self.weights}
        lengths = sorted({len(f) for f in single})

        def telling(word: str) -> str:
            core = word if word.isalpha() else word.strip(_ENDS)
            if core.isalpha():
                if not _DOUBLED.search(core):
                    return core if core[: PREFIXES[0]] in heads and self.word_weight(core) else ""
                thin = _RUN.sub(r"\1", core)
                if not any(thin[:n] in single for n in lengths):
                    return ""
            plain = plain_word(word, self.language)
            return plain if self.word_weight(plain) else ""

        return common.Memo(telling, WORD_CACHE)

    def summary(self, text: str, telling: common.Memo) -> tuple[float, ...]:
        words = restored_words(text, self.language, telling)
        found = [w for w in map(self.word_weight, words) if w]
        return (max(found, default=0.0), log(1.0 + sum(found)), log(1.0 + len(found)))

    def score(self, summary: tuple[float, ...]) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.slopes, summary))
        return 1.0 / (1.0 + exp(-max(-50.0, min(50.0, z))))


def _feature_counts(shared):
    schema = pa.schema([("feature", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = shared.value
        known = common.Memo(lambda w: plain_word(w, language), WORD_CACHE // 4)
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                part = batch.slice(start, COUNTED_ROWS)
                counts: dict[int, int] = {}
                for text, toxic in zip(common.texts(part), part.column("toxic").to_pylist()):
                    words = restored_words(text.decode(), language, known)
                    one = 1 if toxic else 1 << 32
                    for feature in {feature_hash(f) for w in words for f in features(w)}:
                        counts[feature] = counts.get(feature, 0) + one
                found = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
                both = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                yield common.batch_of(schema, (pa.array(found), pa.array(both & 0xFFFFFFFF), pa.array(both >> 32)))

    return run


def _feature_names(shared, wanted: set[int]):
    """The words and beginnings behind chosen hashes."""
    schema = pa.schema([("feature", pa.int64()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = shared.value
        known = common.Memo(lambda w: plain_word(w, language), WORD_CACHE // 4)
        found = set()
        for batch in batches:
            for text in common.texts(batch):
                for name in {f for w in restored_words(text.decode(), language, known) for f in features(w)}:
                    h = feature_hash(name)
                    if h in wanted:
                        found.add((h, name))
        yield common.batch_of(schema, zip(*found) if found else ([], []))

    return run


def _summaries(shared):
    """Score inputs of each text, next to its id (and label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        telling = model.telling_words()
        for batch in batches:
            rows = [model.summary(t.decode(), telling) for t in common.texts(batch)]
            yield batch.drop_columns(["text"]).append_column("x", pa.array(rows, pa.list_(pa.float64())))

    return run


def _scores(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        telling = model.telling_words()
        for batch in batches:
            rows = [model.score(model.summary(t.decode(), telling)) for t in common.texts(batch)]
            yield common.batch_of(schema, (batch.column("doc_id"), rows))

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Bias and slopes by Newton steps on the ridge-penalised likelihood."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(hessian, design.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: CRC-32 of the id as text is a multiple of 5."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def _label_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` labelled documents of those that may be learned from, each text once, with a ``part`` 0 to 3."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    count = usable.count()
    share = min(1.0, rows / max(count, 1))
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000))
    drawn = pinned(usable.filter(draw < int(share * 1_000_000)))
    found = docs.join(F.broadcast(drawn), "doc_id").withColumn("__text", F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("__text").orderBy("doc_id"))
    return pinned(
        found.withColumn("__n", first).filter("__n = 1").select(
            "doc_id", "text", "toxic", F.pmod(F.col("__text"), F.lit(4)).alias("part")
        )
    )


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lexicon: int = LEXICON) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); scores 0 where no label tells texts apart."""
    context = docs.sparkSession.sparkContext
    language = learn_language(docs)
    sample = _label_sample(docs, labels, sample_rows)
    part = {(r["toxic"], r["fit"]): r["n"] for r in sample.groupBy(
        (F.col("toxic") > 0).alias("toxic"), (F.col("part") == 0).alias("fit")
    ).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = part.get((True, False), 0), part.get((False, False), 0)
    counted = (
        sample.filter("part <> 0").select("text", (F.col("toxic") > 0).alias("toxic"))
        .mapInArrow(_feature_counts(context.broadcast(language)), "feature long, toxic long, clean long")
        .groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    )
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    expected = (F.col("a") + F.col("b")) * F.lit(toxic / max(toxic + clean, 1))
    evidence = 2 * F.col("a") * F.log(F.col("a") / expected)
    telling = (
        counted.filter("a > 2").withColumn("odds", odds).withColumn("evidence", evidence)
        .filter((F.col("odds") >= MIN_ODDS) & (F.col("evidence") >= MIN_EVIDENCE))
        .orderBy(F.desc("evidence"), "feature").limit(lexicon).collect()
    )
    odds_of = {r["feature"]: r["odds"] for r in telling}
    names = sample.filter("part <> 0 AND toxic > 0").select("text").mapInArrow(
        _feature_names(context.broadcast(language), set(odds_of)), "feature long, name string"
    ).distinct()
    weights = {r["name"]: odds_of[r["feature"]] for r in names.collect()} if telling else {}
    model = Model(language, weights, -50.0, (0.0, 0.0, 0.0))
    if not telling:
        return model
    fit = sample.filter("part = 0").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = fit.mapInArrow(_summaries(context.broadcast(model)), "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    if 0 < y.sum() < len(y):
        beta = logistic(np.array([r["x"] for r in rows]), y)
        return Model(language, model.weights, float(beta[0]), tuple(float(b) for b in beta[1:]))
    return Model(language, model.weights, -MIN_ODDS, (1.0, 0.0, 0.0))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; null and empty texts score as texts without telling words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.id_and_text(docs, id_col, text_col).mapInArrow(_scores(shared), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every document.

    Labels are only joined by id. Rows without label, with a null label or id, are scored but not learned from; of
    labels that repeat an id the largest counts. Without documents there are no rows.
    """
    rows = common.id_and_text(docs, id_col, text_col)
    model = learn(rows, labels, **settings)
    return scores(rows, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _flagged(shared, text_col: str):
    score = _scores(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(
                [pa.nulls(batch.num_rows, pa.int64()), pa.array(batch.column(text_col)).fill_null("")], ["doc_id", "text"]
            )
            for scored in score([plain]):
                clean = pc.less(scored.column("score"), 0.5)
                yield batch.filter(clean)

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without those that score 0.5 or more; all columns stay, and nothing is shuffled."""
    model = learn(common.id_and_text(docs, id_col, text_col), labels, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.mapInArrow(_flagged(shared, f"c{names.index(text_col)}"), plain.schema).toDF(*names)
