import random

import pytest

from somalog.llm import pii

KEY = b"a test key"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    f = pii.Feistel(KEY)
    out = [f.permute(x, size, "t") for x in range(size)]
    assert sorted(out) == list(range(size))
    assert [f.permute(x, size, "t", back=True) for x in out] == list(range(size))
    if size > 90:
        assert out != [f.permute(x, size, "u") for x in range(size)]
        assert sum(x == y for x, y in enumerate(out)) < 10


def valid_card(text):
    digits = "".join(c for c in text if c.isdigit())
    return pii.luhn_digit(digits[:-1]) == digits[-1]


VALUES = ["4111 1111 1111 1111", "378282246310005", "2024-02-29", "31.12.1999", "1.2.2003", "10/31/2020", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "192.168.7.255", "123-45-6789", "+1 (017) 555-7713", "(212) 555-0100", "+49 30 1234567", "an.na99@mail1.example.com", "É.x1@b.org"]
OTHERS = ["4111 1111 1111 1112", "2023-02-29", "30.02.2000", "300.1.1.1", "Version 2.0.", "000-12-3456", "12345", "DE88 3704 0044 0532 0130 00", "a@b", "1.2.3"]


@pytest.mark.parametrize("value", VALUES)
def test_formats_are_kept_and_values_come_back(value):
    one, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    text, n = one.text(f"see {value}, or {value}!")
    assert n == 2 and value not in text
    new = text[4 : text.index(", or")]
    assert text == f"see {new}, or {new}!"
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    if "." not in value or "@" in value:
        assert "DE" in value or "GB" in value or shape(new) == shape(value)
    assert back.text(text) == (f"see {value}, or {value}!", 2)
    assert pii.Pseudonyms(b"other").text(value)[0] != new


@pytest.mark.parametrize("value", OTHERS)
def test_what_is_not_valid_stays(value):
    assert pii.Pseudonyms(KEY).text(f"see {value}, or") == (f"see {value}, or", 0)


def test_validity_is_kept_and_values_stay_linked():
    one, rng = pii.Pseudonyms(KEY), random.Random(2)
    seen = {}
    for _ in range(300):
        payload = "".join(rng.choice("0123456789") for _ in range(15))
        number = payload + pii.luhn_digit(payload)
        new = one.text(number)[0]
        assert valid_card(new) and len(new) == 16
        assert one.text(" ".join(number[i : i + 4] for i in range(0, 16, 4)))[0].replace(" ", "") == new
        seen[number] = new
    assert len(set(seen.values())) == len(seen)
    assert one.text("2020-03-04")[0].split("-") == list(reversed(one.text("04.03.2020")[0].split(".")))


def test_table(spark):
    rows = [(1, "card 4111111111111111 x", 0.5), (2, None, 0.5), (3, "", 0.5), (4, "clean", 0.5), (1, "card 4111111111111111 x", 0.5), (None, "4111-1111-1111-1111 " * 2000, 0.5)]
    got = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string, n_found double").repartition(2), KEY).collect()
    want = sorted(((i, t if t is None else pii.Pseudonyms(KEY).text(t)[0]) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert sum(r.n_found for r in got) == 2002
    assert pii.pseudonymize(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


PHONE, CARD, IBAN, IP = "+1 (826) 555-4081", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "190.137.223.204"
NEIGHBOURS = [(PHONE, " ", IP), (PHONE, " ", CARD), (PHONE, " ", "2024-02-29"), (PHONE, " 17 ", "123-45-6789"), ("+49 30 1234567", " ", IP), (CARD, " 12/26 ", IP), ("4111111111111111", " 123 ", IBAN), (IBAN, " 1234 ", PHONE), (IBAN, " ", CARD), ("378282246310005", " 7 ", "31/12/1999"), (IP, " ", PHONE), (CARD, " ", "+49 30 1234567")]


@pytest.mark.parametrize(("a", "between", "b"), NEIGHBOURS)
def test_neighbours_get_the_pseudonyms_they_get_alone(a, between, b):
    one = pii.Pseudonyms(KEY)
    want = one.text(a)[0] + between + one.text(b)[0]
    assert one.text(a + between + b) == (want, 2)
    assert pii.Pseudonyms(KEY, back=True).text(want) == (a + between + b, 2)


def test_a_card_after_another_number():
    one = pii.Pseudonyms(KEY)
    assert one.text("no 7 " + CARD) == ("no 7 " + one.text(CARD)[0], 1)
    assert one.text("+4111111111111111")[1] == 1


def test_one_telephone_number_in_several_notations():
    one, plain = pii.Pseudonyms(KEY), lambda s: "".join(c for c in s if c.isdigit())
    assert len({plain(one.text(x)[0]) for x in ("+4930123456", "+49 30 123456", "+49 (30) 12-34-56")}) == 1
    assert "1" + plain(one.text("(212) 555-0100")[0]) == plain(one.text("+1 212 555 0100")[0])
    assert plain(one.text("+35312345678")[0])[:3] == "353"


def test_slash_dates_day_first():
    one, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True)
    for day in range(13, 32):
        new = one.text(f"{day}/12/1999")[0]
        assert new != f"{day}/12/1999" and back.text(new)[0] == f"{day}/12/1999"
        assert new.split("/") == one.text(f"{day}.12.1999")[0].split(".")


def test_random_values_come_back_and_stay_valid():
    one, back, rng = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, back=True), random.Random(3)
    for _ in range(1000):
        ssn = f"{rng.choice([1, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1900, 2099)
        pad = rng.choice(["d", "02d"])
        phone = f"+49{rng.randint(30, 999)}{rng.randint(10**5, 10**7)}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        mail = f"{rng.choice('aBcD')}{rng.randint(0, 999)}x{rng.choice('Yz')}@Host{rng.randint(1, 9)}.org"
        for value in (ssn, f"{d:{pad}}.{m:{pad}}.{y}", f"{m:{pad}}/{d:{pad}}/{y}", f"{y}-{m:02d}-{d:02d}", phone, ip, mail):
            new, n = one.text(value)
            assert n == 1 and back.text(new) == (value, 1), value
            assert len(new) == len(value) or value == ip
        new = one.text(ssn)[0]
        assert new[:3] not in ("000", "666") and new[4:6] != "00" and new[7:] != "0000"


def test_values_written_differently_stay_linked():
    one = pii.Pseudonyms(KEY)
    digits = lambda text: "".join(c for c in one.text(text)[0] if c.isdigit())
    assert digits("+491701234567") == digits("+49 170 1234567") == digits("+49-170-1234567")
    assert one.text("Max@x.com")[0].lower() == one.text("max@x.com")[0] == one.text("MAX@X.com")[0].lower()
    assert [int(x) for x in one.text("3.4.2020")[0].split(".")] == [int(x) for x in one.text("03.04.2020")[0].split(".")]


def test_key_comes_from_the_session(spark):
    with pytest.raises(ValueError):
        pii.key_of(spark)
    spark.conf.set(pii.KEY_SETTING, "k")
    try:
        assert pii.key_of(spark) == b"k"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "on 2020-03-04", 5, "kept")], "doc_id long, text string, _swapped int, __swapped string")
    got = pii.pseudonymize(docs, KEY).collect()[0]
    assert (got._swapped, got["__swapped"], got.n_found) == (5, "kept", 1) and got.text != "on 2020-03-04"
