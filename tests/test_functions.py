from pyspark.sql import functions as F

from ledgerlake.functions import normalise as N


def one_col(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {type_}")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_month_label(spark):
    got = one_col(spark, ["2024/3/5", "2024/03/05", "2024/3", "2024-03-09", None, "/", "2026-06-25", "2024/12/1"],
                  N.month_label)
    assert got == ["2024-03", "2024-03", "2024-03", "2024-03", None, "-00", "2026-06", "2024-12"]


def test_iso_date_text(spark):
    got = one_col(spark, ["2024/5/8", "2024/05/08", "2024/5/8xx", "", None, "2024-03-09T00:00", "2024/3", "2024/123/1"],
                  N.iso_date_text)
    assert got == ["2024-05-08", "2024-05-08", "2024-05-8x", "", "", "2024-03-09", "2024-3", "2024-123-01"]


def test_to_ledger_date(spark):
    import datetime as dt
    got = one_col(spark, ["2024/3/5", "2024/03/05", "2024-03-09", "nope", None], N.to_ledger_date)
    assert got == [dt.date(2024, 3, 5), dt.date(2024, 3, 5), dt.date(2024, 3, 9), None, None]


def test_trim_probability(spark):
    assert one_col(spark, ["100.0", "50", None, "", "10.05"], N.trim_probability) == ["100", "50", None, "", "10.05"]


def test_surname_modes(spark):
    names = ["山田 太郎", "山田　太郎", "山田", " 太郎", "a b c"]
    assert one_col(spark, names, lambda c: N.surname(c, "ascii")) == ["山田", "山田　太郎", "山田", "", "a"]
    assert one_col(spark, names, lambda c: N.surname(c, "any")) == ["山田", "山田", "山田", "", "a"]


def test_parse_ledger_date_serials(spark):
    got = one_col(spark, [1.0, 59.0, 60.0, 61.0, 45000.0, 45000.75, 0.0, None, -3.0], N.parse_ledger_date, "double")
    assert got == ["1900/01/01", "1900/02/28", "1900/02/29", "1900/03/01", "2023/03/15", "2023/03/15",
                   None, None, None]


def test_parse_ledger_date_text(spark):
    got = one_col(spark, ["2024/5/26", "", "0", "45000", "工事中"], N.parse_ledger_date)
    assert got == ["2024/5/26", None, None, "2023/03/15", "工事中"]


def test_effective_amount_keeps_zero(spark):
    df = spark.createDataFrame([(0, 5), (None, 5), (None, None)], "c bigint, e bigint")
    assert [r[0] for r in df.select(N.effective_amount("c", "e")).collect()] == [0, 5, None]
