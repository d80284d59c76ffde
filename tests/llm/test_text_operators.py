"""Line dedup, near duplicates and decontamination against brute force, with odd rows."""

import random
from itertools import combinations

import pytest

from skyloom.llm.common import words_of
from skyloom.llm.decontaminate import COVERAGE, MIN_MATCH, Block, contaminated, decontaminate, tile
from skyloom.llm.line_dedup import dedup_lines, spans
from skyloom.llm.near_dedup import collisions, drop_near_duplicates, near_duplicates

DOCS = "doc_id long, text string"


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(60)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, blank lines, nulls and repeated rows."""
    rng = random.Random(5)
    passage = "\n".join(sentence(rng, 7) for _ in range(4))
    base = "\n".join(sentence(rng, 9) for _ in range(12))
    rows = [(i, "\n".join(sentence(rng, rng.randrange(0, 9)) for _ in range(rng.randrange(1, 9)))) for i in range(25)]
    rows += [(30 + i, f"{sentence(rng, 5)}\n{passage}\n\n{sentence(rng, 30)}") for i in range(6)]
    rows += [(40 + i, base) for i in range(4)]
    for i in range(12):
        words = base.split(" ")
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((50 + i, " ".join(words)))
    rows += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "ONE"), (None, base), (None, "only here"), (None, None)]
    rows += [(40, base), (73, "one"), (80, "tail " * 5000 + "end")]
    return rows


def brute_lines(rows, least):
    """Every run of lines with enough words, in every document, against all earlier runs."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc, text in order:
        lines = text.split("\n")
        worded = [(i, tuple(x.lower().split())) for i, x in enumerate(lines) if x.split()]
        gone = set()
        for a in range(len(worded)):
            for b in range(a, len(worded)):
                run = tuple(w for _, w in worded[a : b + 1])
                if sum(map(len, run)) >= least:
                    if run in seen:
                        gone |= set(range(worded[a][0], worded[b][0] + 1))
                    seen.add(run)
        out[doc, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark, corpus):
    # One row for each id: the order of rows of one id is that of a hash.
    rows = list({r[0]: r for r in corpus if r[0] is not None}.values())
    for least in (8, 20):
        want = brute_lines(rows, least)
        got = dedup_lines(spark.createDataFrame(rows, DOCS), least).collect()
        assert {(r.doc_id, r.text, r.n_removed) for r in got} == {
            (d, *(want[d, t] if t is not None else (None, 0))) for d, t in rows
        }
        assert sum(r.n_removed for r in got) > 0


def test_line_dedup_odd_rows(spark, corpus):
    df = spark.createDataFrame([(*r, 1, "x") for r in corpus], DOCS + ", n_removed int, first string")
    got = dedup_lines(df).collect()
    assert len(got) == len(corpus) and set(got[0].asDict()) == {"doc_id", "text", "first", "n_removed"}
    assert sorted(r.n_removed for r in got if r.doc_id == 40) == [12, 12]  # equal rows: one outcome, null id first
    assert [r.n_removed for r in got if r.doc_id is None and r.text and "w" in r.text] == [0]
    assert dedup_lines(df.limit(0)).count() == 0


def test_spans_are_the_shortest():
    for seed in range(50):
        rng = random.Random(seed)
        words = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 9))]
        enough = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if sum(words[a : b + 1]) >= 7]
        want = {(a, min(y for x, y in enough if x == a)) for a, _ in enough}
        want |= {(max(x for x, y in enough if y == b), b) for _, b in enough}
        assert spans(words, 7) == want


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    part = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            part = [part[a] if p == part[b] else p for p in part]
    least = {}
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            least[p] = min(least.get(p, rows[i][0]), rows[i][0])
    return [(rows[i][0], len(sets[i]), least.get(p)) for i, p in enumerate(part)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, corpus, size, percent):
    got = near_duplicates(spark.createDataFrame(corpus, DOCS), size, percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute_components(corpus, size, percent)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """Cells of many blocks: copies of copies, which drift away from any hub."""
    from skyloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(11)
    rows, bases = [], [[f"b{k}_{i}" for i in range(90)] for k in range(3)]
    for i in range(150):
        words = list(rng.choice(bases + [r[1].split() for r in rows[-20:]]))
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()
    want = brute_components(rows, 3, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == set(want)
    assert 1 < len({w[2] for w in want}) < len(rows)


def test_one_of_each_group_stays(spark, corpus):
    df = spark.createDataFrame([(*r, "keep") for r in corpus], DOCS + ", node string")
    got = drop_near_duplicates(df, 5, 80).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "node"}
    want = {c for d, n, c in brute_components(corpus, 5, 80) if n and c is not None}
    assert sorted(r.doc_id for r in got if r.doc_id is not None and words_of(r.text)) == sorted(want)
    assert sorted(str(r.text) for r in got if r.doc_id is None) == ["None", "only here"]
    assert [r.text for r in got if r.doc_id in (70, 71, 72)].count(None) == 1
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_collisions_leave_few_links():
    assert collisions(100) == 40 and collisions(85) == 18 and collisions(80) < 18


def brute_tiles(pattern, text, least):
    """Greedy string tiling by comparing all places, longest first."""
    p, t, covered = [False] * len(pattern), [False] * len(text), 0
    for size in range(min(len(pattern), len(text)), least - 1, -1):
        for a in range(len(pattern) - size + 1):
            for b in range(len(text) - size + 1):
                if pattern[a : a + size] == text[b : b + size] and not any(p[a : a + size]) and not any(t[b : b + size]):
                    p[a : a + size] = t[b : b + size] = [True] * size
                    covered += size
    return covered


def test_tiles_equal_brute_force():
    for seed in range(80):
        rng = random.Random(seed)
        pattern = [rng.randrange(1, 9) for _ in range(rng.randrange(5, 25))]
        cut = rng.randrange(len(pattern))
        text = pattern[cut:] + [rng.randrange(1, 9) for _ in range(rng.randrange(9))] + pattern[:cut]
        assert tile(pattern, [text], 3) == brute_tiles(pattern, text, 3), seed


def test_tiles_of_long_texts():
    """Matches of many lengths in texts of thousands of tokens; a repeated token everywhere."""
    pattern = list(range(1, 4001))
    text, at, size = [], 0, 6
    while at + size < len(pattern):
        text += [*pattern[at : at + size], 0]
        at, size = at + size + 1, size + 1
    want = sum(range(6, size))
    assert tile(pattern, [text], 5) == want
    assert tile([7] * 300, [[7] * 2000], 5) == 300
    assert tile([7] * 300, [[7] * 40, [7] * 4], 5) == 40


def test_short_items_and_scripts_without_spaces():
    rng = random.Random(1)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    item = han(40)
    block = Block([(1, item), (2, "Yes or no"), (3, ""), (4, "yes  OR no"), (5, "ok 好")])
    assert [x[0] for x in block.leaks(f"{han(60)}{item[:30]}。{han(50)}", COVERAGE)] == [1]
    assert block.leaks(f"{han(60)}{item[:15]}{han(50)}", COVERAGE) == []
    assert [x[0] for x in block.leaks(" yes or\tNO ", COVERAGE)] == [2, 4]
    assert block.leaks("yes or no, she said to them", COVERAGE) == block.leaks("yes or", COVERAGE) == block.leaks("", COVERAGE) == []
    assert block.leaks("OK好", COVERAGE) == [(5, 1.0, 2)]


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"i{i}_{k}" for k in range(30))) for i in range(4)] + [(9, "too short"), (None, None), (0, None)]
    first, second = items[0][1].split(), items[1][1].split()
    rows = [
        (1, f"{sentence(rng, 40)} {items[0][1].upper()} {sentence(rng, 10)}"),
        (2, " ".join(first[20:] + ["x"] * 9 + first[:10] + ["y"] + first[10:20])),  # reordered
        (3, " ".join(first[:8]) + " and " + " ".join(second[5:11])),  # quotes a little
        (4, items[0][1] + "\n" + items[1][1]),
        (5, None), (6, ""), (7, "too short"), (None, items[2][1]), (8, sentence(rng, 30000) + " " + items[3][1]),
        (4, items[0][1] + "\n" + items[1][1]),
    ]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], DOCS + ", coverage double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(docs, bench).collect()
    key = lambda r: str(r)
    # A short item is leaked by a document that is nothing else.
    want = [(1, 0), (2, 0), (4, 0), (4, 1), (4, 0), (4, 1), (None, 2), (8, 3), (7, 9)]
    assert sorted([(r.doc_id, r.item_id) for r in got], key=key) == sorted(want, key=key)
    assert all(r.coverage >= COVERAGE for r in got)
    assert sorted(str(r.doc_id) for r in decontaminate(docs, bench).collect()) == ["3", "5", "6"]
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_in_blocks(spark):
    from skyloom.llm.decontaminate import benchmark_blocks

    bench = spark.createDataFrame([(i, f"a{i} b c d e f g") for i in range(20)], "item_id long, text string")
    parts = benchmark_blocks(bench, 40)
    assert len(parts) > 2 and sum(p.count() for p in parts) == 20


def test_leaks_equal_tiling_with_every_item():
    """Seeds and segments lose nothing: the same as tiling each text with each item whole."""
    for seed in range(25):
        rng = random.Random(seed)
        items = [(i, sentence(rng, rng.randrange(MIN_MATCH, 20))) for i in range(5)]
        text = " ".join(rng.choice(items)[1] if rng.random() < 0.4 else sentence(rng, 4) for _ in range(5))
        want = []
        for i, item in items:
            p = item.split()
            covered = brute_tiles(p, text.split(), MIN_MATCH)
            if covered >= COVERAGE * len(p):
                want.append((i, covered / len(p), covered))
        assert Block(items).leaks(text, COVERAGE) == want
