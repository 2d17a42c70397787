import re

import pytest
from pyspark.sql import functions as F

from vigil.llm.pii import permute_number, permute_text, pseudonymise


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban_ok(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


@pytest.fixture(scope="module")
def changed(spark):
    def run(texts, **options):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        return [r.text for r in pseudonymise(df, **options).orderBy("doc_id").collect()]
    return run


def test_values_change_within_their_format(changed):
    texts = ["card 4111 1111 1111 1111 and 4111111111111111, 3782-822463-10005", "call +1 (017) 555-7713 or +44 20 7946 0958",
             "mail a.b1@mail7.example.com", "ip 10.0.0.1", "on 2020-02-29, 29/02/2020 and 2020/02/29", "id 123-45-6789",
             "GB82 WEST 1234 5698 7654 32", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "THE!! 192.168.0.254!!"]
    out = changed(texts)
    shape = lambda t: re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t)))
    for before, after in zip(texts, out):
        assert before != after
        if "ip" not in before and "192" not in before:
            assert shape(before) == shape(after)
    cards = re.findall(r"[\d -]{15,19}\d", out[0])
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert len(digits) == 3 and all(map(luhn, digits)) and digits[0] == digits[1]
    assert all(0 <= int(x) < 256 for x in re.search(r"[\d.]+", out[3])[0].split("."))
    y, m, d = re.search(r"(\d+)-(\d+)-(\d+)", out[4]).groups()
    assert out[4] == f"on {y}-{m}-{d}, {d}/{m}/{y} and {y}/{m}/{d}"      # one date, one pseudonym
    assert iban_ok(out[6])
    assert changed(out, undo=True) == texts
    assert changed(texts, key="another") != out and changed(texts) == out


def test_what_is_no_valid_value_stays(changed):
    texts = ["4111111111111112", "256.1.1.1 and 1.2.3.4.5", "2020-02-30 and 1899-01-01", "GB83 WEST 1234 5698 7654 32",
             "version 4.0. of 12 in 2020", "12345678901234567890123", "", None, "plain words only", "a@b", "1,234,567.89",
             "page 123-456", "word " * 20_000]
    assert changed(texts) == texts


def test_neighbours_do_not_hide_a_value(changed):
    texts = ["12 4111111111111111 7", "4111111111111111 5500005555555559", "x4111111111111111y", "a@b.com,c@d.org;2001-01-01.",
             "+1 (017) 555-7713 4111111111111111", "4111111111111111$$$ 10.0.0.1### 10.0.0.1."]
    for before, after in zip(texts, changed(texts)):
        for value in ("4111111111111111", "5500005555555559", "a@b", "c@d", "2001-01-01", "555-7713", "10.0.0.1"):
            assert value not in after
        assert len(before) == len(after) or "10.0" in before


def test_equal_values_stay_linked(changed):
    out = changed(["A.b@Mail.org", "a.B@Mail.org", "+1 (017) 555-7713", "017-555-7713", "x 10.0.0.1 y 10.0.0.1"])
    assert out[0].lower() == out[1].lower()
    assert re.sub(r"\D", "", out[2])[1:] == re.sub(r"\D", "", out[3])
    a, b = re.findall(r"[\d.]+\d", out[4])
    assert a == b


def test_permutations(spark):
    rows = spark.range(323).select("id", permute_number(F.col("id"), 17, 19, "t").alias("p"))
    rows = rows.withColumn("back", permute_number(F.col("p"), 17, 19, "t", undo=True)).collect()
    assert sorted(r.p for r in rows) == list(range(323)) and all(r.back == r.id for r in rows)
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    rows = rows.withColumn("p", permute_text(F.col("s"), "t")).withColumn("back", permute_text(F.col("p"), "t", undo=True)).collect()
    assert len({r.p for r in rows}) == 1000 and all(r.back == r.s and len(r.p) == 3 for r in rows)


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ip 10.0.0.1", "m"), (1, "ip 10.0.0.1", "m")], "doc_id long, text string, matches string")
    out = pseudonymise(df)
    assert out.columns == df.columns and out.count() == 2 and out.distinct().count() == 1
    assert pseudonymise(df.limit(0)).count() == 0
