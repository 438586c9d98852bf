"""Mixing, token files, toxicity, personal data, chat formatting and decontamination against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kartotek.llm import chat, decontamination, mixing, pii, token_files, toxicity
from kartotek.llm.queries import END_ID, WORD_TOKENIZER

from .conftest import ODD

WORD_PATH = public_tokenizers.path(WORD_TOKENIZER)
BYTE_PATH = public_tokenizers.path("byte_bpe_50k.json")


# Mixing


def seats_by_hand(votes, seats, limits):
    """One seat after the other, in exact arithmetic."""
    won = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] > 0 and won[i] < limits[i]]
        if not open_:
            break
        won[max(open_, key=lambda i: (Fraction(votes[i]) / (2 * won[i] + 1), -i))] += 1
    return won


@pytest.mark.parametrize("seed", range(30))
def test_apportionment_by_highest_quotients(seed):
    draw = random.Random(seed)
    n = draw.randrange(1, 9)
    votes = [draw.choice([0, 5, 7, 100, draw.randrange(1, 10_000)]) for _ in range(n)]
    limits = [draw.randrange(0, 60) for _ in range(n)]
    seats = draw.randrange(0, 200)
    assert mixing.apportion(votes, seats, limits).tolist() == seats_by_hand(votes, seats, limits)


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 1000], [5, 2, 1]) == [30.0, 300.0, 780.0]
    assert mixing.targets([0, 10], [5, 2]) == [0.0, 10.0]
    assert mixing.targets([], []) == []


def test_mix_meets_its_targets(make, odd, nothing):
    draw = random.Random(1)
    sources = ["b", "a", None, "tiny", "z"]
    rows = [
        (i, " ".join("w" * 3 for _ in range(draw.randrange(0, 900))), sources[min(4, int(draw.expovariate(1)))])
        for i in range(400)
    ] + [(1_000, "five words are not many", "small")]
    small = {"shard_words": 5_000, "shard_docs": 40}
    got = [r.asDict() for r in mixing.plan(make(rows), **small).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes = {i: len(t.split()) for i, t, _ in rows}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == total[r["source"]] for r in got)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    assert mixing.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]) == [
        target[s] for s in names
    ]
    for s in names:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS + 0.01 * target[s]
    assert taken["small"] == 15
    again = {r["doc_id"]: r["taken"] for r in mixing.plan(make(rows).repartition(7), **small).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    assert sum(r["taken"] for r in mixing.plan(odd).collect()) > 0
    assert mixing.plan(nothing).collect() == []


def test_mixed_documents_hold_what_is_planned(make, nothing):
    draw = random.Random(2)
    rows = [(i, " ".join(f"{i}-{j}" for j in range(draw.randrange(0, 300))), draw.choice("ab")) for i in range(60)]
    plan = {r["doc_id"]: r for r in mixing.plan(make(rows)).collect()}
    mixed = mixing.mix(make(rows)).collect()
    held = defaultdict(list)
    for r in mixed:
        held[r["doc_id"]].append(r["text"].split())
    for i, text, _ in rows:
        words, p = text.split(), plan[i]
        expected = [words] * p["passes"]
        cut = words[p["a2"] : p["b2"]] + words[p["a1"] : p["b1"]]
        assert sorted(held[i]) == sorted(expected + ([cut] if cut else [])) or p["size"] == 0
        assert sum(map(len, held[i])) == p["taken"]
    assert mixing.mix(make(rows)).columns == make(rows).columns
    assert mixing.mix(nothing).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_shard_quotas_by_highest_quotients(spark, seed):
    draw = random.Random(seed)
    shards, seats = {}, {}
    for source in range(4):
        words = [draw.choice([0, 64, 640, 640, draw.randrange(1, 3_000)]) for _ in range(draw.randrange(1, 40))]
        shards[source] = words
        seats[source] = draw.choice([0, 1, 7, 60, 10**6])
    rows = [(s, i, w) for s, words in shards.items() for i, w in enumerate(words)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "source_no int, shard long, words long")
    got = {(r["source_no"], r["shard"]): r["quota"] for r in mixing.shard_quotas(frame, seats, 64).collect()}
    for source, words in shards.items():
        limits = [-(-w // 64) for w in words]
        expected = seats_by_hand(words, min(seats[source], sum(limits)), limits)
        assert [got[source, i] for i in range(len(words))] == expected


def test_a_million_tied_shards(spark):
    frame = spark.range(1_000_000).selectExpr("0 AS source_no", "id AS shard", "64000L AS words")
    got = mixing.shard_quotas(frame, {0: 333_333_333}, 64)
    assert [tuple(r) for r in got.groupBy("quota").agg({"shard": "max", "*": "count"}).orderBy("quota").select("quota", "count(1)", "max(shard)").collect()] == [
        (333, 666_667, 999_999), (334, 333_333, 333_332),
    ]


def test_mix_of_rows_that_repeat_an_id(make):
    draw = random.Random(6)
    rows = [(draw.choice([1, 1, 2, None, i]), " ".join(f"{i}-{j}" for j in range(draw.randrange(0, 90))), draw.choice(["a", "b", None])) for i in range(80)]
    rows += [(1, rows[3][1], "a")] * 3 + [(5, None, "b"), (5, "", "b"), (-(2**63), "x y z", "a")]
    taken = Counter()
    for r in mixing.plan(make(rows)).collect():
        taken[r["doc_id"], r["source"]] += r["taken"]
    mixed, held = Counter(), Counter()
    for r in mixing.mix(make(rows)).collect():
        words = r["text"].split()
        mixed[r["doc_id"], r["source"]] += len(words)
        held.update((r["doc_id"], w) for w in words)
    assert mixed == +taken
    every = Counter((i, w) for i, t, _ in rows for w in (t or "").split())
    assert all(n <= 3 * every[key] for key, n in held.items())


# Token files


TEXTS = [
    "It's a test, isn't it? I'LL say: 123 (twice)!", "Été ÉCOLE straße ÜBER ñandú", "a<|endoftext|>b <|endoftext|>",
    "İstanbul ΣΑΣ ß", "a\u001cb \u0085 c\u00a0d e\u0301te\u0301 e\u0301.", "||| ... .,;! x|y|", "日本語 テスト", "'s 'S don't", "", "\t\n",
]


def test_other_tokenizers_encode_whole_texts():
    plain, other = Tokenizer.from_file(BYTE_PATH), token_files.Encoder(BYTE_PATH)
    assert not other.words_apart and token_files.Encoder(WORD_PATH).words_apart
    for text in TEXTS + ["two  blanks and Case", "  before"]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(other.encode(text.encode()), dtype=other.kind).tolist() == ids


def test_words_apart_gives_the_same_ids():
    plain, words = Tokenizer.from_file(WORD_PATH), token_files.Encoder(WORD_PATH, cache_words=20)
    for text in TEXTS + [" ".join(TEXTS)] * 2:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text.encode()), dtype="<u2").tolist() == ids


@pytest.mark.parametrize("words_apart", [True, False])
def test_token_files_round_trip(spark, make, tmp_path, words_apart):
    rows = ODD + [(100 - i, t) for i, t in enumerate(TEXTS)]
    folder = str(tmp_path / "tokens")
    manifest = token_files.write_tokens(make(rows), folder, WORD_PATH, END_ID, words_apart=words_apart)
    got = token_files.read_digests(spark, folder).collect()
    assert len(got) == len(rows)
    plain = Tokenizer.from_file(WORD_PATH)
    ids_of = defaultdict(Counter)
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [END_ID]
        ids_of[i][(len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))] += 1
    start = 0
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    for r in ordered:
        assert r["start"] == start
        start += r["n_tokens"]
        ids_of[r["doc_id"]][(r["n_tokens"], r["ids_crc32"])] -= 1
    assert start == manifest["n_tokens"] and not any(n for c in ids_of.values() for n in c.values())


def test_token_files_by_uri_and_of_nothing(spark, make, nothing, tmp_path):
    token_files.write_tokens(make([(2, "two"), (1, "one")]), f"file://{tmp_path}/t", WORD_PATH, END_ID)
    assert [r["doc_id"] for r in token_files.read_digests(spark, f"file://{tmp_path}/t").orderBy("start").collect()] == [1, 2]
    token_files.write_tokens(nothing, f"{tmp_path}/none", WORD_PATH, END_ID)
    assert token_files.read_digests(spark, f"{tmp_path}/none").collect() == []


# Toxicity


TOXIC = ["idiot", "scumbag", "moron"]


def toxic_corpus(seed, docs=1500):
    draw = random.Random(seed)
    parts = ["ba", "do", "ki", "lu", "me", "ra", "to", "in", "st"]
    word = lambda: "".join(draw.choice(parts) for _ in range(draw.randrange(1, 4)))
    rows, labels = [], []
    for i in range(docs):
        words = [word() for _ in range(draw.randrange(5, 60))]
        toxic = draw.random() < 0.2
        if toxic:
            for _ in range(draw.randrange(1, 4)):
                words.insert(draw.randrange(len(words)), draw.choice(TOXIC))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_and_disguised_texts(spark, make):
    rows, labels = toxic_corpus(1)
    disguised = ["you 1d1ot ba", "m0r0n lu", "iiidiooot", "i d i o t", "m.o.r.o.n ki", "scumb@g", "SCUMBAG!!!", "idiot***"]
    more = [(10_000 + i, t) for i, t in enumerate(disguised)] + [(20_000 + i, t) for i, (_, t) in enumerate(ODD)]
    got = {
        r["doc_id"]: r for r in toxicity.toxicity(make(rows + more), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    }
    assert len(got) == len(rows) + len(more)
    for i in range(len(rows)):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    right = [got[i]["predicted"] == t for i, t in labels if got[i]["held_out"]]
    assert np.mean(right) > 0.97
    assert all(got[10_000 + i]["predicted"] == 1 for i in range(len(disguised)))
    assert not any(got[20_000 + i]["predicted"] for i in range(len(ODD)))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_toxicity_without_labels_or_documents(spark, make, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(odd, none).collect()} == {0}
    odd_labels = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, None, 1), (2, 1, 0)], none.schema)
    assert len(toxicity.toxicity(odd, odd_labels).collect()) == len(ODD)
    assert toxicity.toxicity(nothing, none).collect() == []


def test_drop_toxic_keeps_clean_documents_whole(spark, make):
    rows, labels = toxic_corpus(2, 800)
    kept = toxicity.drop_toxic(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    ids = {r["doc_id"] for r in kept.collect()}
    clean = {i for i, t in labels if not t}
    assert len(clean - ids) <= 3 and len(ids - clean) <= 5
    assert kept.columns == make([]).columns


def test_restored_text():
    rows, _ = toxic_corpus(3)
    counts = Counter()
    for _, text in rows:
        for word in text.split():
            marked = f"^^{word}$"
            counts.update(marked[i : i + 3] for i in range(len(marked) - 2))
    language = toxicity.language_of(counts)
    assert toxicity.restored_text("Ba 1d10t, ki m0r0n! i d i o t lu", language).split()[-2:] == ["idiot", "lu"]
    assert toxicity.plain_word("ba", language) == "ba" and toxicity.plain_word("!!!", language) == ""
    assert len(toxicity.restore("0" * 5_000 + "a", language)) > 0


# Personal data


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def base_by_hand(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                kind == 0
                or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)
                or kind == 3 and 9 <= len(digits) <= 15
            )
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_of_random_texts():
    draw = random.Random(7)
    for _ in range(4000):
        text = "".join(draw.choice(["@", ".", "+", "-", " ", "1", "22", "4111111111111111", "255", "a", "b.c", "é", "("]) for _ in range(draw.randrange(25)))
        assert pii.base_spans(text) == base_by_hand(text), text


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data(make, nothing):
    token = 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"'
    rows = ODD + [(100 + i, f"é mail me.{i}@mail.example.com or +1 (017) 555-77{i:02d}, {token}") for i in range(30)]
    rows += [(200 + i, f"card 4111 1111 1111 1111 from 10.0.0.{i}; not 9807915762804490") for i in range(30)]
    got = pii.find(make(rows)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for i, text in rows:
        base = base_by_hand(text)
        for r in by_id[i]:
            assert r["base_sha256"] == sha256(pii.written(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(k == n for _, k, _ in base) for n in range(4)]
            assert set(filter(None, pii.written(base).split(","))) <= set(r["spans"].split(","))
    assert "secret:" in by_id[100][0]["spans"] and by_id[200][0]["spans"].count("card:") == 1
    assert pii.find(nothing).collect() == []
    masked = {r["doc_id"]: r["text"] for r in pii.redact(make(rows)).collect()}
    assert masked[200] == "card <CARD> from <IP>; not 9807915762804490"


def test_reliabilities_favour_the_labelers_that_agree():
    draw = np.random.default_rng(0)
    truth = draw.random(4000) < 0.4
    votes = np.stack([np.where(draw.random(4000) < right, truth, ~truth) for right in (0.95, 0.9, 0.85, 0.55)], axis=1) * 2 - 1
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    soft, chance = pii.reliabilities(patterns, counts.astype(float))
    assert np.mean((soft[index.ravel()] > 0.5) == truth) > 0.95
    right = [chance[1, j, 2] for j in range(4)]
    assert right[0] > right[1] > right[2] > right[3]


# Chat


def chats_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in turns.items():
        own.sort()
        plain = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        out[conv] = (len(own), sha256(plain.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def chat_rows():
    hard = ["\\### Assistant: </turn> ok", "<turn:user>\n</turn>\n", "\\", "\\\\</turn>", "a\nb\u00e9\U0001f600", "<|endoftext|>", "", None]
    rows = [(-7, i, role, hard[0]) for i, role in enumerate(("user", "assistant"))]
    for i, text in enumerate(hard):
        rows += [(i, 0, "system", "shared start"), (i, 1, "user", text), (i, 2, "assistant", text), (i, 3, "a>\\b<", text)]
    rows += [(50, i, "user", "w " * 5_000) for i in range(3)] + [(None, None, None, "x"), (None, 2, "assistant", "y")]
    rows += [(60 + i, t, "assistant", f"t{t}") for i in range(8) for t in range(i + 1)] + [(80, 1, "user", "z")] * 2
    return rows


def test_chat_round_trip(spark):
    rows = chat_rows()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, start long")
    segments, leaves = chat.pack(frame, BYTE_PATH)
    got = {r[0]: tuple(r[1:5]) for r in chat.read_back(segments, leaves, BYTE_PATH).collect()}
    assert got == chats_by_hand(rows)


@pytest.mark.parametrize("parts", ["8", "40"])
def test_stream_of_shared_turns(spark, parts, monkeypatch):
    rows = chat_rows() + [(900, t, "user", f"long {t}") for t in range(300)]
    order = type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, *c: order(self, int(parts), *c))
    segments, _ = chat.pack(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE_PATH)
    held = sorted(segments.collect(), key=lambda r: r["start"])
    prefixes, at, stack = set(), 0, []
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for own in turns.values():
        own.sort()
        prefixes |= {tuple(t[2:] for t in own[: i + 1]) for i in range(len(own))}
    assert len(held) == len(prefixes)
    for r in held:
        assert r["start"] == at and r["end"] - r["start"] == len(r["tokens"])
        at = r["end"]
        stack = stack[: r["depth"] - 1]
        merged = []
        for a, b in stack:
            if merged and merged[-1][1] == a:
                a = merged.pop()[0]
            merged.append((a, b))
        assert [tuple(a) for a in r["attends"]] == merged
        assert r["position"] == sum(b - a for a, b in stack)
        stack.append((r["start"], r["end"]))


def test_chat_of_nothing(spark):
    segments, leaves = chat.pack(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), BYTE_PATH)
    assert chat.read_back(segments, leaves, BYTE_PATH).collect() == []


@pytest.mark.parametrize("text", ["", "\\", "<turn:", "</turn>", "\\</turn>\\\\<turn:x>\n", "<<turn:turn:"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.parse("".join(chat.pieces(text, text)) * 2) == [(text, text)] * 2


# Decontamination


ITEM = (
    "If Alice buys 12 apples at 30 cents each and Bruno buys 7 pears, while Alice gives 12 of the apples to Clara, "
    "how many grams of fruit weighing 150 g each does Alice still carry home today?"
)


def test_questions_with_other_slots(spark, make, odd, nothing):
    other = ITEM.replace("Alice", "Dora").replace("12", "48").replace("Bruno", "Emil").replace("30", "20").replace("150 g", "9 kg")
    torn = ITEM.replace("12 of the", "13 of the")
    rows = ODD + [
        (100, f"Some text before. {ITEM} And after."), (101, f"Before it. {other} After."), (102, f"Before. {torn}"),
        (103, " ".join(ITEM.split()[:14])), (104, "nothing of the kind is in here at all, not even Alice"),
        (105, f"{ITEM.upper()}"), (106, f"Twice. {ITEM}\n\n{ITEM}"), (107, None),
    ]
    bench = spark.createDataFrame([(1, ITEM, 0), (2, "too short", 0), (3, None, 0), (None, ITEM + " Or not?", 0)], "item_id long, text string, found int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.matches(make(rows), bench).collect()}
    assert {k for k in got if k[1] == 1} == {(i, 1) for i in (100, 101, 106)}
    assert [got[(i, 1)]["kind"] for i in (100, 101, 106)] == ["exact", "reparameterised", "exact"]
    assert got[(100, 1)]["coverage"] == 1.0
    kept = decontamination.decontaminate(make(rows), bench)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in (100, 101, 106))
    assert kept.columns == make(rows).columns
    assert decontamination.matches(nothing, bench).collect() == []
    assert decontamination.matches(odd, bench.limit(0)).collect() == []


def found_in_any_form(spark, make, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.matches(make(docs), bench, all_forms=True).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_copies_in_any_case_are_found(spark, make):
    docs = [(1, ITEM.upper()), (2, ITEM.lower()), (3, f"ALL OF IT: {ITEM.upper().replace('12', '31')}"), (4, "Nothing at all of it")]
    got = found_in_any_form(spark, make, docs, [(1, ITEM)])
    assert {k: (r["kind"], r["coverage"]) for k, r in got.items()} == {
        (1, 1): ("exact", 1.0), (2, 1): ("exact", 1.0), (3, 1): ("reparameterised", 1.0),
    }


def test_names_at_the_start_of_sentences(spark, make):
    item = "Tom has 5 apples. Tom buys 3 more apples from Ann. How many apples does Tom have now?"
    other = item.replace("Tom", "Lea").replace("Ann", "Jim").replace("5", "8").replace("3", "6")
    docs = [(1, other), (2, f"without a mark before it {other}"), (3, other.replace("Lea have", "Jim have"))]
    got = found_in_any_form(spark, make, docs, [(1, item)])
    assert {k: r["kind"] for k, r in got.items()} == {(1, 1): "reparameterised", (2, 1): "reparameterised"}


def test_slots_on_any_diagonal_and_free_numbers(spark, make):
    item = ITEM.replace("12 of the", "5 of the").replace("7 pears", "5 pears")
    torn = item.replace("5 of the", "6 of the").replace("gives", "hands")
    docs = [
        (1, item.replace("12", "4").replace("30", "4")), (2, item.replace("5 of the", "3 of the")),
        (3, f"{item.replace('does Alice', 'does Clara')} {item}"), (4, f"{torn} And so on. {item}"),
        (5, item.replace("does Alice", "does Clara")),
    ]
    got = found_in_any_form(spark, make, docs, [(1, item)])
    assert {k[0]: r["kind"] for k, r in got.items()} == {
        1: "reparameterised", 2: "reparameterised", 3: "exact", 4: "exact",
    }


def test_short_items_are_found_in_a_row(spark, make):
    items = [
        (1, "What is 3 + 4 ?"), (2, "Compute 12 * 7 - 5 + 3"), (3, "What is the capital city of France?"),
        (4, "Name two primes"), (5, " ".join(str(i) for i in range(30))), (6, "..."), (7, None),
    ]
    docs = [
        (1, "some words what is 3 + 4? and more"), (2, "now compute 12 * 7 - 5 + 3"), (3, "now compute 12 + 7 - 5 * 3"),
        (4, "some words What is the capital city of France?"), (5, "WHAT IS THE CAPITAL CITY OF FRANCE"),
        (6, "please name two primes."), (7, "two primes name"), (8, " ".join(str(i) for i in range(29))),
        (9, "first " + " ".join(str(i) for i in range(31))), (10, "..."), (11, None),
    ]
    got = found_in_any_form(spark, make, docs, items)
    assert set(got) == {(1, 1), (2, 2), (4, 3), (5, 3), (6, 4), (9, 5)}
    assert {(r["kind"], r["coverage"]) for r in got.values()} == {("exact", 1.0)}


def test_disguises_of_any_shape_are_restored():
    rows, _ = toxic_corpus(3)
    counts = Counter()
    for _, text in rows:
        for w in text.lower().split():
            if w.isalpha():
                counts.update(("^^" + w + "$")[i : i + 3] for i in range(len(w) + 1))
    language = toxicity.language_of(counts)
    for word in ("iidiott", "idioot", "i.d.1.0.t", "id.io.t", "i-d_io*t"):
        assert toxicity.plain_word(word, language) == "idiot", word
    assert toxicity.plain_word("12.30-7", language) == "12.30-7"
    known = toxicity.common.Memo(lambda w: toxicity.plain_word(w, language), 100)
    for text in ("i  d  i  o  t", "i\nd\n\ni\no\nt", "b a k   i d i o t", "b a k\ni d i o t", "i\u00a0d\u00a0i\u00a0o\u00a0t"):
        assert "idiot" in toxicity.restored_words(text, language, known), text


def test_rare_letters_have_their_own_estimate():
    language = toxicity.language_of({"^^a": 5, "^ab": 5, "ab$": 5}, {"a": 5, "b": 5, "$": 5, "\u0436": 2, "\u0449": 1})
    assert language.step("a\u0436", "q") < language.step("a\u0436", "b") and language.step("^^", "\u0449") < language.step("^^", "\u0436")
    assert toxicity.restore("\u0436\u0436\u0436", language) == "\u0436"


def test_runs_of_letters_are_settled_as_by_viterbi():
    draw = random.Random(5)
    counts = Counter()
    for _ in range(300):
        marked = f"^^{''.join(draw.choice('aabcd') for _ in range(draw.randrange(1, 7)))}$"
        counts.update(marked[i : i + 3] for i in range(len(marked) - 2))
    language = toxicity.language_of(counts)
    for _ in range(3_000):
        word = "".join(draw.choice("abcde") * draw.choice((1, 1, 2, 3)) for _ in range(draw.randrange(1, 8)))
        assert toxicity.restore(word, language) == toxicity._likeliest(word, language), word
