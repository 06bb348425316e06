import random

from pyspark.sql import functions as F

from cuecraft.functions.timefmt import clock, hms, parse_offset, srt_time
from cuecraft.operators.intervals import periods_and_gaps

SCHEMA = "lecture string, s bigint, t bigint"
HOUR = 3_600_000_000


def brute(rows, max_gap=HOUR):
    out = set()
    for lec in {r[0] for r in rows if r[0] is not None and r[0].strip()}:
        merged = []
        for s, t in sorted((s, t) for e, s, t in rows if e == lec and s is not None and t is not None and t > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out |= {(lec, "period", s, t) for s, t in merged}
        out |= {(lec, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if max_gap is None or b[0] - a[1] <= max_gap}
    return out


def got(spark, rows, **kw):
    df = periods_and_gaps(spark.createDataFrame(rows, SCHEMA), "lecture", "s", "t", **kw)
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_touching_nested_repeated_and_bad_rows(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 2, 5), ("a", 2, 5), ("a", 30, 40), ("a", 50, 50), ("a", 60, 55), ("a", None, 9), ("a", 1, None), (None, 0, 5), (" ", 0, 5), ("b", -5, -1), ("a", 40 + HOUR, 41 + HOUR), ("a", 42 + 2 * HOUR, 43 + 2 * HOUR)]
    found = got(spark, rows, slice_us=7)
    assert found == brute(rows)
    assert ("a", "gap", 40, 40 + HOUR) in found and ("a", "gap", 41 + HOUR, 42 + 2 * HOUR) not in found


def test_random_against_brute_force_for_any_slice(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["x", "y"]), s := rng.randrange(0, 4000), s + rng.randrange(-2, 9)) for _ in range(900)]
    for width in (1, 13, 1_000_000):
        assert got(spark, rows, slice_us=width, max_gap_us=3) == brute(rows, 3)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == set()
    df = spark.createDataFrame([("a", 0, 5, 1, 2, "k")], "lecture string, s bigint, t bigint, at int, slice int, kind string")
    assert [tuple(r) for r in periods_and_gaps(df, "lecture", "s", "t").collect()] == [("a", "period", 0, 5)]


def test_offsets_of_all_renderings(spark):
    cases = {"0:01:23.450000": 83_450_000, "1 day, 0:00:01": 86_401_000_000, "11 days, 10:00:00.000001": 986_400_000_001, "01:02:03,250": 3_723_250_000, "123:00:00": 442_800_000_000, "None": None, "": None, "1:2:3": None, "0:61:00": None, None: None, "00:00:01.5": 1_500_000}
    df = spark.createDataFrame([(k,) for k in cases], "x string").withColumn("us", parse_offset(F.col("x")))
    assert {r["x"]: r["us"] for r in df.collect()} == cases


def test_renderings(spark):
    row = spark.range(1).select(
        hms(F.lit(3_723_999_000).cast("bigint")).alias("a"), srt_time(F.lit(3723.25)).alias("b"), clock(F.lit(83_450_000).cast("bigint")).alias("c"),
        clock(F.lit(2 * 86_400_000_000 + 1_000_000).cast("bigint")).alias("d"), hms(F.lit(None).cast("bigint")).alias("e"), hms(F.lit(400_000_000_000).cast("bigint")).alias("f"),
    ).first()
    assert tuple(row) == ("01:02:03", "01:02:03,250", "0:01:23.450000", "2 days, 0:00:01", None, "111:06:40")
