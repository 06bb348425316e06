import random

import pytest

from cuecraft.operators import chunking as ch

CUES = "lecture_id string, seq bigint, start_us bigint, end_us bigint, content string"


def half_even(x):
    return round(x)


def m_split(cues):
    import re

    out = []
    for lec, seq, s, e, c in cues:
        parts = re.split(r"(?<=\.)\s+", c)
        if len(parts) <= 1:
            out.append((lec, seq, 0, s, e, c))
            continue
        per, at = half_even((e - s) / len(c)), s
        for i, p in enumerate(parts):
            end = e if i == len(parts) - 1 else at + per * len(p)
            out.append((lec, seq, i, at, end, p))
            at = end
    return out


def m_islands(parts):
    out, open_ = [], {}
    order = {}
    for lec, _, _, s, e, c in sorted(parts, key=lambda p: p[:3]):
        b = open_.setdefault(lec, [])
        b.append((s, e, c))
        if c.endswith("."):
            out.append((lec, order.setdefault(lec, 0), b[0][0], b[-1][1], " ".join(x[2] for x in b)))
            order[lec] += 1
            open_[lec] = []
    out += [(lec, order.get(lec, 0), b[0][0], b[-1][1], " ".join(x[2] for x in b)) for lec, b in open_.items() if b]
    return out


def m_grow(blocks, least, overlap):
    out = []
    for lec in {b[0] for b in blocks}:
        bs = sorted((b for b in blocks if b[0] == lec), key=lambda b: b[1])
        i = n = 0
        while i < len(bs):
            j, text = i, bs[i][4]
            while len(text) <= least and j + 1 < len(bs):
                j += 1
                text += " " + bs[j][4]
            s, e = bs[i][2], bs[j][3]
            if overlap and i > 0:
                text, s = bs[i - 1][4] + " " + text, bs[i - 1][2]
            if overlap and j + 1 < len(bs):
                text, e = text + " " + bs[j + 1][4], bs[j + 1][3]
            out.append((lec, n, bs[i][1], bs[j][1], s, e, text))
            i, n = j + 1, n + 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for lec in ("l1", "l2", "l3"):
        t = 0
        for seq in range(40):
            text = " ".join(rng.choice(["alpha", "be.", "c", "delta.", "eps! ", "zeta?"]) for _ in range(rng.randrange(1, 9))).strip() or "x"
            end = t + rng.randrange(1, 9_000_000)
            out.append((lec, seq, t, end, text))
            t = end
    return out


def test_pipeline_against_a_sequential_model(spark, rows):
    cues = spark.createDataFrame(rows, CUES)
    parts = ch.split_cues(cues)
    assert sorted(map(tuple, parts.collect())) == sorted(m_split(rows))
    blocks = ch.islands(parts)
    model = m_islands(m_split(rows))
    assert sorted(map(tuple, blocks.collect())) == sorted(model)
    for overlap in (False, True):
        assert sorted(map(tuple, ch.grow(blocks, 60, overlap).collect())) == sorted(m_grow(model, 60, overlap))
    chunks = ch.chunk_cues(cues, 60, 90).collect()
    assert all(len(r["text"]) <= 90 or " " not in r["text"] for r in chunks)


def test_edges_of_the_cue_split(spark):
    rows = [("a", 1, 0, 9_000_000, "A b. C d."), ("a", 2, 0, 9, "3.14 is x"), ("a", 3, 0, 9, "Why? Yes! Ok."), ("a", 4, 0, 9, "A. "), ("a", 5, None, None, "A. B."), ("a", 6, 0, 5, None)]
    got = {(r["seq"], r["part"]): (r["start_us"], r["end_us"], r["content"]) for r in ch.split_cues(spark.createDataFrame(rows, CUES)).collect()}
    assert got[1, 0] == (0, 4_000_000, "A b.") and got[1, 1] == (4_000_000, 9_000_000, "C d.")
    assert (2, 1) not in got and (3, 1) not in got and got[4, 1][2] == "" and got[5, 0] == (None, None, "A.") and got[6, 0] == (0, 5, "")


def test_grow_is_strict_and_keeps_a_short_tail(spark):
    blocks = spark.createDataFrame([("a", i, i, i + 1, "x" * 10) for i in range(3)], "lecture_id string, block_no long, start_us long, end_us long, content string")
    assert sorted(len(r["content"]) for r in ch.grow(blocks, 10).collect()) == [10, 21]
    assert ch.grow(blocks.limit(0), 10).count() == 0


def test_halving():
    assert ch.halves("w" * 50, 0, 9, 10) == [("w" * 50, 0, 9)]
    assert [x[0] for x in ch.halves("aaa bbb ccc", 0, 11, 8)] == ["aaa", "bbb ccc"]
    whole = ch.halves("one  two three four five", 0, 100, 9)
    assert " ".join(x[0] for x in whole) == "one two three four five" and whole[0][1] == 0 and whole[-1][2] == 100 and all(a[2] == b[1] for a, b in zip(whole, whole[1:]))


def test_sizes_and_groups(spark):
    ch.check_sizes(5, 5)
    with pytest.raises(ValueError):
        ch.check_sizes(6, 5)
    df = spark.createDataFrame([(1, "A. B! C? D."), (2, None), (3, " ")], "k int, t string")
    assert [tuple(r) for r in ch.sentence_groups(df, "k", "t", 3).orderBy("group_no").collect()] == [(1, 0, "A. B! C?"), (1, 1, "D.")]


@pytest.mark.parametrize("slice_blocks", [1, 2, 5])
def test_slices_of_a_lecture_give_the_same_chunks(spark, slice_blocks):
    rng = random.Random(slice_blocks)
    rows = [(lecture, k, k * 10, k * 10 + 9, "x" * rng.choice([0, 1, 3, 8, 30])) for lecture in ("a", "b", None) for k in range(40 if lecture else 7)]
    blocks = spark.createDataFrame(rows, "lecture_id string, block_no bigint, start_us bigint, end_us bigint, content string").repartition(3)
    for least, overlap in ((10, False), (10, True), (0, True), (25, True), (10_000, True)):
        whole, cut = (sorted(map(tuple, ch.grow(blocks, least, overlap, n).collect()), key=repr) for n in (1_000, slice_blocks))
        assert whole == cut and sum(r[3] - r[2] + 1 for r in whole) == len(rows)


def test_blocks_of_a_lecture_in_many_ranges(spark):
    rows = [("l", i, 0, i, i, f"part {i}" + ("." if i % 3 == 0 else "")) for i in range(200)] + [("m", 0, 0, 0, 1, "one."), ("k", 0, 0, 0, 1, "open")]
    parts = spark.createDataFrame(rows, "lecture_id string, seq bigint, part int, start_us bigint, end_us bigint, content string")
    found = ch.islands(parts).collect()
    big = sorted((r["block_no"], r["start_us"], r["end_us"]) for r in found if r["lecture_id"] == "l")
    assert big == [(0, 0, 0)] + [(k, 3 * k - 2, min(3 * k, 199)) for k in range(1, 68)]
    assert {r["lecture_id"]: r["content"] for r in found if r["lecture_id"] != "l"} == {"m": "one.", "k": "open"}
