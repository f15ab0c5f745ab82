from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates as D


def values(spark, items, dtype, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_spanish_date(spark):
    texts = [
        "martes 18 junio, 2024 | 16:47",
        "  Miércoles 3 enero, 2024 09:05 ",
        "sábado 1 SEPTIEMBRE, 2023 | 7:01",
        "",
        "hace 3 horas",
        "lunes 40 marzo, 2024 10:00",
        None,
    ]
    want = [
        datetime(2024, 6, 18, 16, 47),
        datetime(2024, 1, 3, 9, 5),
        datetime(2023, 9, 1, 7, 1),
        None,
        None,
        None,
        None,
    ]
    assert values(spark, texts, "string", D.spanish_date(F.col("v"))) == want


def test_free_date_drops_zone_without_conversion(spark):
    # fmt: off
    texts = ["2023-07-05 18:03:00-04:00", "2023-07-05T18:03:00Z", "05/07/2023 18:03", "2023-07-05", "x", "05-07-2023",
             "2023-07-05 18:03:00.5 +0200", "miércoles 5 julio, 2023 | 18:03", None]
    # fmt: on
    same = datetime(2023, 7, 5, 18, 3)
    assert values(spark, texts, "string", D.free_date(F.col("v"))) == [
        same, same, same, datetime(2023, 7, 5), None, datetime(2023, 7, 5),
        same.replace(microsecond=500_000), same, None,
    ]


def test_floor_modes(spark):
    now = datetime(2024, 5, 2, 13, 45, 10)
    one = lambda mode: values(spark, [now], "timestamp_ntz", D.lookback_floor(F.col("v"), mode))[0]
    assert one("rolling") == datetime(2024, 5, 1, 13, 45, 10)
    assert one("prev_midnight") == datetime(2024, 5, 1, 0, 45, 10)
    with pytest.raises(ValueError):
        D.lookback_floor(now, "other")


def test_days_and_validated_comparison(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 2, 12), datetime(2024, 1, 1))], "a timestamp_ntz, b timestamp_ntz"
    )
    a, b = F.col("a"), F.col("b")
    row = df.select(D.days_between(a, b), D.strictly_after(a, b), D.strictly_after(b, a)).first()
    assert tuple(row) == (1.5, True, False)
    with pytest.raises(Exception, match="dates are invalid"):
        df.select(D.strictly_after(a, F.lit(None).cast("timestamp_ntz"), strict=True)).collect()
    row = df.select(D.strictly_after(a, F.lit(None).cast("timestamp_ntz")).alias("v")).first()
    assert row.v is None


def test_free_dates_of_capture(spark):
    now = datetime(2024, 3, 31, 10, 30)
    cases = {
        "hace 3 horas": datetime(2024, 3, 31, 7, 30), "Hace  una hora": datetime(2024, 3, 31, 9, 30),
        "hace 2 días": datetime(2024, 3, 29, 10, 30), "an hour ago": datetime(2024, 3, 31, 9, 30),
        "1 month ago": datetime(2024, 2, 29, 10, 30), "hace un año": datetime(2023, 3, 31, 10, 30),
        "90 segundos atrás": datetime(2024, 3, 31, 10, 28, 30), "AYER": datetime(2024, 3, 30, 10, 30),
        "ayer a las 9:05": datetime(2024, 3, 30, 9, 5), "today 00:00": datetime(2024, 3, 31),
        "antier": datetime(2024, 3, 29, 10, 30), "29 de febrero de 2024": datetime(2024, 2, 29),
        "viernes 1 de marzo del 2024, 8:15": datetime(2024, 3, 1, 8, 15), "Sept 5, 2023": datetime(2023, 9, 5),
        "3rd": None, "July 4th, 2021 at 12:00": datetime(2021, 7, 4, 12), "4 jul. 2021": datetime(2021, 7, 4),
        "30 de febrero de 2024": None, "12 de nada de 2024": None, "hace mucho": None, "hace 3 lunas": None,
        "ayer a las 25:00x": None, "3 horas": None, "": None, "   ": None, "2024-02-03": datetime(2024, 2, 3),
        "hace 999999 horas": datetime(2024, 3, 31, 10, 30) - timedelta(hours=999999),
    }
    rows = [(i, t, now) for i, t in enumerate(cases)] + [(99, None, now)]
    df = spark.createDataFrame(rows, "i int, text string, at timestamp_ntz")
    got = {r.text: r.d for r in df.select("text", D.free_date(F.col("text"), F.col("at")).alias("d")).collect()}
    assert {t: got[t] for t in cases} == cases and got[None] is None
    told = df.filter("text = 'ayer'").select(D.free_date(F.col("text")).alias("d")).collect()
    assert all(r.d is None for r in told)
