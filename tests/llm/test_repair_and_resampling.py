"""Conversation repair, substring dedup and importance resampling against brute force, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from skyloom.llm import conversation_repair as cr
from skyloom.llm import resampling as rs
from skyloom.llm import substring_dedup as sd

# --- conversations -----------------------------------------------------------------------------


def brute_repair(rows):
    """(cost, edits, repaired lines) by trying every edit; rows are (role, text, fault)."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @lru_cache(None)
    def best(i, state, inserts):
        out = []
        if i == len(rows) and state in (0, 3):
            out.append((0, "", ()))
        for initial, nxt in after[state].items():
            role = {"u": "user", "a": "assistant"}.get(initial)
            if role and inserts < 3:
                c, e, t = best(i, nxt, inserts + 1)
                out.append((c + 5, "I" + e, (f"{role}:", *t)))
            if i < len(rows) and rows[i][2] not in (1, 2):
                extra = 5 if rows[i][2] == 3 else 0
                c, e, t = best(i + 1, nxt, 0)
                if rows[i][0][:1] == initial:
                    out.append((c + extra, "K" + e, (f"{rows[i][0]}:{rows[i][1]}", *t)))
                if role:
                    out.append((c + extra + 1, "R" + e, (f"{role}:{rows[i][1]}", *t)))
        if i < len(rows):
            c, e, t = best(i + 1, state, 0)
            out.append((c + 2, "D" + e, t))
        return min(out) if out else (10**9, "", ())

    return best(0, 0, 0)


def brute_report(rows):
    """The report of a conversation's rows (turn, role, text, copies)."""
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    rows = sorted((r for r in rows for _ in range(r[3])), key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    seen, faulty = set(), []
    for _, role, text, _ in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = Counter(f for _, _, f in faulty)
    cost, edits, lines = brute_repair(tuple(faulty))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts[1], counts[2], counts[3], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_block_tables_equal_brute_force():
    rng = random.Random(3)
    tables = cr.tables()
    assert len(tables.vectors) < 200
    for n in [*range(10)] * 12:
        rows = tuple((rng.choice(["system", "user", "assistant", "tool", ""]), "x", rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n))
        cost, edits, _ = brute_repair(rows)
        assert tables.repair(bytes(cr.symbol(r[0][:1], r[2]) for r in rows)) == (cost, edits), rows


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_of_any_length_agree(block):
    rng = random.Random(block)
    other = cr.Tables(block)
    for _ in range(50):
        symbols = bytes(rng.randrange(cr.SYMBOLS) for _ in range(rng.randrange(200)))
        assert other.repair(symbols) == cr.tables().repair(symbols)


ROWS = "conv_id long, turn long, role string, text string, copies long"


def odd_conversations():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "and then", "", " \t\n", "Why?  ", "Ja.\x0b", "é.", "Yes."]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " ", ""])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, rng.choice(texts), rng.choice([0, 1, 1, 1, 2])))
    rows += [(None, 0, "user", "Hi.", 1), (None, 1, "assistant", "Hi.", 1), (90, 0, "user", "Hi.", 0)]
    rows += [(91, t, "user" if t % 2 else "assistant", f"{t} " * 50_000 + ".", 1) for t in range(3)]
    return rows


def test_report_equals_brute_force(spark):
    rows = odd_conversations()
    faults, found = cr.repair(spark.createDataFrame([(*r, 1) for r in rows], f"{ROWS}, audit int"))
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.digests(faults, found).collect()}
    got = {r[0]: (*r[1:], hashes[r[0]]) for r in found.collect()}
    want = {conv: brute_report([r[1:] for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert got == want
    repaired = {}
    for r in cr.repaired_rows(faults, found).orderBy("place").collect():
        repaired.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    for conv, digest in hashes.items():
        assert hashlib.sha256("\n".join(repaired.get(conv, [])).encode()).hexdigest() == digest


def test_damage(spark):
    rows = [(c, t, "assistant", f"One. Two! {c}") for c in range(20) for t in range(5)]
    rows += [(None, None, None, None), (1, None, "user", None)]
    shown = lambda x: " " if x is None else str(x)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", shown(text)) if kind == 2 else shown(text)
        want.append((c, t, "user" if kind == 4 else shown(role), text, {0: 0, 3: 2}.get(kind, 1)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, copies string")
    assert Counter(map(tuple, cr.damage(df).collect())) == Counter(want)


def test_a_long_conversation_and_an_empty_table(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "Ok." if t % 5 else f"{t}.", 1) for t in range(20_000)]
    rows += [(1, 7, "user", "same.", 1)] * 500 + [(2, 0, "user", "a.", 1)]
    df = spark.createDataFrame(rows, ROWS)
    faults, found = cr.repair(df)
    one = found.filter("conv_id = 1").first()
    said = [(r[2], r[3]) for r in rows if r[0] == 1]
    assert one.duplicate == len(said) - len(set(said)) and faults.count() == len(rows)
    assert len(one.audit) - one.audit.count("I") == 20_500
    assert cr.repair_report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- substrings --------------------------------------------------------------------------------


def brute_substrings(rows, window):
    places = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    for k, words in enumerate(split):
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i : i + window]), []).append((k, i))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for k, i in found:
                gone[k] |= set(range(i, i + window))
    return Counter(
        (doc, " ".join(w for i, w in enumerate(words) if i not in g), len(words), len(g))
        for (doc, _), words, g in zip(rows, split, gone, strict=True)
    )


def repeated_texts():
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(40)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 90)))) for i in range(30)]
    for i in range(30, 60):
        a, b = sorted(rng.sample(range(61), 2))
        rows.append((i, " ".join([word() for _ in range(rng.randrange(20))] + passage[a:b] + [word() for _ in range(20)])))
    rows += [(70, " ".join(passage)), (71, "\n".join(passage)), (72, " ".join(passage + passage))]
    rows += [(80, "tail " * 400), (81, "a b " * 120 + "c"), (82, "x a b " * 40), (83, "a " * 11), (84, "a " * 13)]
    rows += [(90, None), (91, ""), (92, " \t\n\x0b"), (93, "one"), (None, None), (None, "only here"), (93, "one")]
    rows += [(94, "ü é x " * 9), (95, " ".join(passage)), (95, " ".join(passage)), (None, " ".join(passage[5:50]))]
    return rows


@pytest.mark.parametrize("window", [1, 2, 12, 35])
def test_substrings_equal_brute_force(spark, window):
    rows = repeated_texts()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n_words int, runs int, first int")
    kept = sd.dedup_substrings(df, window)
    assert kept.columns == ["doc_id", "text", "runs", "first", "n_words", "n_removed"]
    got = Counter(tuple(r) for r in kept.select("doc_id", "text", "n_words", "n_removed").collect())
    assert got == brute_substrings(rows, window)


def test_texts_are_cut_into_chunks(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{rng.randrange(900)}" for _ in range(3000)]
    whole = list(sd.chunks([" ".join(words).encode()], 35))
    monkeypatch.setattr(sd, "CHUNK", 100)
    cut = list(sd.chunks([b"", None, " ".join(words).encode(), b"a b"], 35))
    assert len(cut) == 30 and sum(len(at) for *_, at in cut) == len(whole[0][3]) == 2966
    for held, row, place, at in cut:
        assert set(row) == {2} and all(held[a] == words[p].encode() for p, a in zip(place, at, strict=True))


def test_equal_windows_have_equal_symbols():
    rng = np.random.default_rng(1)
    inner = rng.integers(0, 2**63, 50).astype(np.uint64)
    found = []
    for _ in range(40):
        n = int(rng.integers(1, 60))
        ends = rng.choice(inner, n), rng.choice(inner, int(rng.integers(1, 60)))
        name, level, place, _ = sd.symbols(np.concatenate([ends[0], inner, ends[1]]), 35)
        found.append([(int(name[n + i]), int(level[n + i]), int(place[n + i]) - n) for i in range(16)])
    assert all(f == found[0] for f in found)
    same = np.full(200, 7, np.uint64)
    assert (sd.symbols(same, 35)[2] == np.arange(166)).all()


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.dedup_substrings(empty).count() == 0
    assert rs.resampling_ranks(empty, empty).count() == 0


# --- resampling --------------------------------------------------------------------------------


def brute_ranks(docs, target, percent, buckets, longest, least):
    def words(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)

    def found(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for _, x in rows for b in found(x)) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc, text in docs:
        f = found(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(enough[: len(enough) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("percent,longest,least", [(25, 2, 20), (50, 1, 0), (100, 3, 5), (0, 2, 20)])
def test_ranks_equal_brute_force(spark, percent, longest, least):
    rng = random.Random(percent)
    texts = [" ".join(rng.choice(["Ab", "c-d", "é", "zz9", "Q", "x_y"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    docs = list(enumerate(texts)) + [(100, None), (101, ""), (102, " -- "), (None, texts[3]), (None, None)]
    docs += [(103, texts[5])] * 40 + [(104, "long " * 30_000)]
    target = [(i, t.upper()) for i, t in enumerate(texts[:7])] + [(9, None)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, row int")
    items = spark.createDataFrame(target, "item_id long, text string")
    got = rs.resampling_ranks(df, items, percent, 50, longest, least).select("doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == brute_ranks(docs, target, percent, 50, longest, least)


def test_kth_smallest(spark):
    values = [random.Random(6).randrange(-(2**62), 2**62) for _ in range(300)] + [5] * 50 + [-(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 200, 351):
        assert rs.kth_smallest(df, "v", k) == sorted(values)[k - 1]


def test_resample_gives_whole_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 25, "s") for i in range(40)] + [(None, None, None)], "doc_id long, text string, drawn_id string")
    items = spark.createDataFrame([(1, "word3 word3")], "item_id long, text string")
    got = rs.resample(docs, items)
    assert got.columns == docs.columns and got.count() == 10


def test_without_target_texts(spark):
    docs = spark.createDataFrame([(i, "a b " * 20) for i in range(8)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rs.resampling_ranks(docs, none).filter("rank is not null").count() == 2
