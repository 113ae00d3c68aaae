"""Column helpers on hand-made values."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ordermill.functions.exact import cents_avg, cents_to_double, from_cents, half_up_div, to_cents
from ordermill.functions.time import hours_between, month_label
from ordermill.operators.picks import dedup


def test_cents_round_trip(spark):
    df = spark.createDataFrame([(Decimal("12345.67"),), (Decimal("0.05"),), (None,)], "p decimal(12,2)")
    r = df.select(to_cents(F.col("p")).alias("c"), from_cents(to_cents(F.col("p"))).alias("back"),
                  cents_to_double(to_cents(F.col("p"))).alias("d"), F.col("p").cast("double").alias("cast")).collect()
    assert [x.c for x in r] == [1234567, 5, None]
    assert [x.back for x in r] == [Decimal("12345.67"), Decimal("0.05"), None]
    assert [x.d for x in r] == [x.cast for x in r]


def test_cents_avg_and_half_up(spark):
    df = spark.createDataFrame([(5, 2), (15, 10), (-15, 10), (1, 3)], "s long, n long")
    r = df.select(cents_avg(F.col("s"), F.col("n")).alias("a"), half_up_div(F.col("s"), F.col("n")).alias("h")).collect()
    assert [x.a for x in r] == [0.03, 0.02, -0.02, 0.0]
    assert [int(x.h) for x in r] == [3, 2, -2, 0]


def test_hours_between_and_month(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 1, 2, 0, 0), dt.datetime(2018, 1, 1, 22, 30))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(hours_between("a", "b").alias("h"), month_label("a").alias("m")).first()
    assert (r.h, r.m) == (-1.5, "2018-01")


def test_dedup_with_caller_order(spark):
    df = spark.createDataFrame([(1, 9, "z"), (1, 3, "a"), (2, 5, "q")], "k long, prio long, v string")
    got = sorted((r.k, r.v) for r in dedup(df, ["k"], order_by=["prio"]).collect())
    assert got == [(1, "a"), (2, "q")]


def test_time_helpers_ignore_session_zone(spark):
    """Inside a daylight-saving gap of the session zone the NTZ arithmetic must not move."""
    from ordermill.functions.time import floor_days, week_start
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")   # DST began 1996-10-06 00:00
    try:
        df = spark.createDataFrame([(dt.datetime(1996, 10, 6, 0, 0), dt.datetime(1996, 10, 20, 16, 20, 50),
                                     dt.datetime(1997, 10, 8, 10, 0))], "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")
        r = df.select(hours_between("a", "b").alias("h"), floor_days("a", "b").alias("d"),
                      week_start("c").alias("w"), week_start("a").alias("w2")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r.h == (14 * 86400 + 16 * 3600 + 20 * 60 + 50) / 3600 and r.d == 14
    assert r.w == dt.datetime(1997, 10, 6) and r.w2 == dt.datetime(1996, 9, 30)
