import re

from vigil.llm.pii import pseudonymise

from .test_pii import iban_ok


def changed(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonymise(df, **options).orderBy("doc_id").collect()]


def test_what_follows_an_iban_does_not_hide_it(spark):
    ibans = ["ES9121000418450200051332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947",
             "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00"]
    tails = ["", " BY", " 12 May", " BIC", " A 1 B2", " 4111 1111 1111 1111", "."]
    texts = [f"to {i}{t}" for i in ibans for t in tails]
    out = changed(spark, texts)
    for text, new in zip(texts, out):
        iban = next(i for i in ibans if i in text)
        assert iban not in new and iban_ok(new[3:3 + len(iban)]) and len(new) == len(text), text
        if "4111" in text:
            assert "4111 1111 1111 1111" not in new
        else:
            assert new[3 + len(iban):] == text[3 + len(iban):]
    assert changed(spark, out, undo=True) == texts


def test_long_secrets_change_to_their_end(spark):
    value = "".join("abcdefghij"[i * 7 % 10] + str(i % 10) for i in range(150))
    text = f'secret: "{value}" and more'
    new, = changed(spark, [text])
    assert value[128:] not in new and value[-40:] not in new
    assert len(new) == len(text) and new.endswith('" and more')
    assert changed(spark, [new], undo=True) == [text]


def test_dates_with_one_digit(spark):
    texts = ["on 3/7/2021.", "03/07/2021", "2021-7-3", "2021.07.03", "31.1.1999", "1/31/1999", "31/2/2020 and 1/1/1850"]
    out = changed(spark, texts)
    days = [tuple(map(int, re.findall(r"\d+", t))) for t in out]
    assert days[0] == days[1] == days[2][::-1] == days[3][::-1] != (3, 7, 2021)     # one date, one pseudonym
    assert days[4] == (days[5][1], days[5][0], days[5][2]) != (31, 1, 1999)
    assert out[6] == texts[6]
    assert not re.search(r"\b0\d", out[0] + out[2] + out[4])
    back = changed(spark, out[:5], undo=True)
    for before, after in zip(texts, back):
        assert [int(x) for x in re.findall(r"\d+", before)] == [int(x) for x in re.findall(r"\d+", after)]
