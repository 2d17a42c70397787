import datetime as dt

from pyspark.sql import functions as F

from vigil.functions import parse as P


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_yymmdd_rules(spark):
    got = one_col(spark, ["690101", "700101", "99/12/31", " 000229 ", "010229", "20200101", "n/a", None,
                          "201301"], P.parse_date_yymmdd)
    assert got == [dt.date(2069, 1, 1), dt.date(1970, 1, 1), dt.date(1999, 12, 31), dt.date(2000, 2, 29),
                   None, None, None, None, None]


def test_decimal_comma_and_missing(spark):
    got = one_col(spark, ["85,5", " 12 ", "", "nan", "None", "1,234.5", "1d", "-", "-3,25", "1e3", "NaN",
                          "0x1A", "1_000", ".5", "+3", None], P.to_number)
    assert got == [85.5, 12.0, None, None, None, None, None, None, -3.25, 1000.0, None, None, None, 0.5, 3.0,
                   None]


def test_plain_and_clean(spark):
    assert one_col(spark, ["1,5", "2.5"], P.to_number_plain) == [None, 2.5]
    assert one_col(spark, ["-", " - ", "3,0"], P.to_number_clean) == [None, None, 3.0]


def test_excel_dates(spark):
    got = one_col(spark, ["42005", "42005.75", "2015-01-02", "2015-01-03 00:00:00", "TOTAL", ""],
                  P.parse_excel_date)
    assert got == [dt.date(2015, 1, 1), dt.date(2015, 1, 1), dt.date(2015, 1, 2), dt.date(2015, 1, 3), None, None]


def test_normalize_key(spark):
    labels = ["  Neumonía (J12–J18) ", "TOTAL DEMANDA", "Crisis obstructiva bronquial (J40-J46)", None,
              "Cirugías de urgencia", "ideación suicida (R45.8)"]
    assert one_col(spark, labels, P.normalize_key) == [
        "NEUMONIA J12 J18", "TOTAL DEMANDA", "CRISIS OBSTRUCTIVA BRONQUIAL J40 J46", "", "CIRUGIAS DE URGENCIA",
        "IDEACION SUICIDA R45 8"]
    strict = one_col(spark, ["Neumonía (J12–J18)"], lambda c: P.normalize_key(c, strict_ascii=True))
    assert strict == ["NEUMONIA J12J18"]


def test_text_year_category(spark):
    assert one_col(spark, [None, "  a b  "], P.normalize_text) == ["", "a b"]
    names = ["/x/ER_2019.xlsx", "report.2020", ".2021", "ER 1999 v.2021.xlsx", "a..2022", "plain"]
    assert one_col(spark, names, P.year_from_filename) == ["2019", "", "2021", "2021", "", ""]
    assert one_col(spark, ["  Regular ", None, "ALERTA"], P.normalize_category) == ["regular", None, "alerta"]


def test_iso_dates_in_other_shapes(spark):
    day = dt.date(2019, 1, 2)
    texts = ["2019-01-02", "2019-01-02 00:00:00", "2019-01-02T10:00:00", "2019-01-02 00:00:00.000", "2019/01/02", "2019.1.2",
             "2019-01-02T00:00:00Z", "2019-01-02T00:00:00.123+01:00", "01/02/2019", "1-2-2019", " 2019-01-02 "]
    assert one_col(spark, texts, P.to_date_iso) == [day] * len(texts)
    assert one_col(spark, ["25/12/2019", "12/25/2019"], P.to_date_iso) == [dt.date(2019, 12, 25)] * 2
    assert one_col(spark, ["02/01/2019"], lambda c: P.to_date_iso(c, day_first=True)) == [day]
    assert one_col(spark, ["2019-13-01", "2019/02/30", "2019-01/02", "x", "", None, "2019-01-02x", "20190102"],
                   P.to_date_iso) == [None] * 8


def test_folding_covers_all_of_unicode(spark):
    assert one_col(spark, ["Ạ ﬁebre", "Ｎeumonía", "½ ㎏ Ⅷ", "𝐀é", "e\u0301\u1AB0x"], P.normalize_key) == [
        "A FIEBRE", "NEUMONIA", "12 KG VIII", "AE", "EX"]
    assert one_col(spark, ["½"], lambda c: P.normalize_key(c, strict_ascii=True)) == ["12"]
