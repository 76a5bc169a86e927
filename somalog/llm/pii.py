"""Format-preserving pseudonyms for personal numbers and dates.

What is found is validated (Luhn for card numbers, mod 97 for IBANs, the calendar for dates,
octets for IPv4 addresses, digit counts for telephone and social security numbers), turned into
a whole number below the size of its format, and permuted there by a keyed Feistel network with
cycle walking. So a card number becomes a valid card number of the same length, a date a date in
the same notation (dates after the 12th stay after the 12th, so slash dates keep their reading:
month first, or day first where only that is a date, and months and days of one digit stay so,
which keeps the notation); the same value gets the same pseudonym wherever and however it is written,
different values get different ones, and the key's holder can turn them back. Mail addresses
are treated alike: letters stay letters and digits digits before the @, whatever their case; the host
and letters outside A-Z stay.

Numbers often stand next to each other. What fails validation is tried again without its last
groups of digits, and then from later groups on; a telephone number ends where another number
that is valid by itself begins, and after ten digits if its country code is 1. Elsewhere the
groups that follow with a blank count as its digits, up to fourteen. Of overlapping candidates
that are all valid the first counts, and of those the longest (one card number in ten is valid
by chance).

Not found, and left as they are: dates before 1900 or after 2099, local telephone numbers without
an area code in brackets or a country code (212-555-0100), and numbers with 00 in place of a plus.

Defined results: a null text stays null, an empty one empty; repeated rows change alike;
an empty table gives an empty result; other columns pass, but for `n_found`.
"""

from __future__ import annotations

import hashlib
import math
import re
from datetime import date
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somalog.llm.common import free

#: The session's setting that holds the key; Spark redacts settings of such a name.
KEY_SETTING = "spark.somalog.pii.secret"
ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()

MAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b")
_FIRST = (
    r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
    r"|(?P<iso>(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-]))"
    r"|(?P<date>(?<![\d./])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?![\d/]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
)
_PHONE = r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d))"
_CARD = r"(?P<card>(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]))"
NUMBER, OTHER = re.compile(f"{_FIRST}|{_PHONE}|{_CARD}"), re.compile(f"{_FIRST}|{_CARD}")
KINDS = ("iban", "ip", "iso", "date", "ssn", "phone", "card")
#: Between groups of digits or letters.
GAP = re.compile(r"(?<=[\w)])[ .-]+(?=[\w(])")
#: Country codes of one and two digits; the others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
HINT = re.compile(r"[@0-9]")


def _kind(found: re.Match) -> str:
    return next(k for k in KINDS if found.groupdict().get(k) is not None)


class Feistel:
    """A keyed permutation of 0..size-1 for every size and kind of value."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = hashlib.blake2b(key).digest(), rounds

    def _value(self, kind: str, turn: int, size: int, x: int) -> int:
        data = f"{kind}/{turn}/{size}/{x}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key).digest(), "big")

    def _once(self, x: int, size: int, kind: str, back: bool) -> int:
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        left, right = divmod(x, b)
        sign = -1 if back else 1
        for turn in sorted(range(self.rounds), reverse=back):
            if turn % 2:
                right = (right + sign * self._value(kind, turn, size, left)) % b
            else:
                left = (left + sign * self._value(kind, turn, size, right)) % a
        return left * b + right

    def permute(self, x: int, size: int, kind: str, back: bool = False) -> int:
        if size < 2:
            return x
        x = self._once(x, size, kind, back)
        while x >= size:  # the network covers a little more; walk on until inside
            x = self._once(x, size, kind, back)
        return x


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload a valid card number."""
    total = 0
    for k, c in enumerate(reversed(payload)):
        v = int(c) * (2 - k % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def _filled(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _iban_rest(country: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


class Pseudonyms:
    """Pseudonyms under one key; back=True turns them into the values again."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.feistel, self.back = Feistel(key), back

    def _permuted(self, x: int, size: int, kind: str) -> int:
        return self.feistel.permute(x, size, kind, self.back)

    def _digits(self, digits: str, kind: str) -> str:
        return str(self._permuted(int(digits), 10 ** len(digits), f"{kind}{len(digits)}")).zfill(len(digits))

    def _mixed(self, text: str, kind: str) -> str:
        """Letters to letters of the same case and digits to digits, all in one number."""
        ranges = [(97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if "0" <= c <= "9" else None for c in text]
        x, size = 0, 1
        for c, r in zip(text, ranges, strict=True):
            if r:
                x, size = x * r[1] + ord(c) - r[0], size * r[1]
        shape = "".join("." if r is None else "aA0"[(97, 65, 48).index(r[0])] for r in ranges)
        x, out = self._permuted(x, size, kind + shape), []
        for c, r in zip(reversed(text), reversed(ranges), strict=True):
            if r:
                x, v = divmod(x, r[1])
                c = chr(r[0] + v)
            out.append(c)
        return "".join(reversed(out))

    def mail(self, text: str) -> str:
        local, _, host = text.partition("@")
        small = "".join(c.lower() if c.isascii() else c for c in local)
        new = self._mixed(small, "mail " + host.lower())
        return "".join(c.upper() if "A" <= old <= "Z" else c for c, old in zip(new, local, strict=True)) + f"@{host}"

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        payload = self._digits(digits[:-1], "card")
        return _filled(text, payload + luhn_digit(payload))

    def iban(self, text: str) -> str | None:
        chars = text.replace(" ", "")
        country, check, rest = chars[:2], chars[2:4], chars[4:]
        if not 15 <= len(chars) <= 34 or 98 - _iban_rest(country, rest) != int(check):
            return None
        rest = self._mixed(rest, "iban" + country)
        return _filled(text, f"{country}{98 - _iban_rest(country, rest):02d}{rest}")

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        x = self._permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _day(self, year: int, month: int, day: int) -> date | None:
        try:
            x = date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= x < DAYS:
            return None
        like = lambda day, month: (day > 12, day > 9, month > 9)
        while True:  # walk on until the day is on the same side of the 12th, and digits are as many
            x = self._permuted(x, DAYS, "date")
            out = date.fromordinal(FIRST_DAY + x)
            if like(out.day, out.month) == like(day, month):
                return out

    def iso(self, text: str) -> str | None:
        day = self._day(*map(int, text.split("-")))
        return day and day.isoformat()

    def date(self, text: str) -> str | None:
        sep = "." if "." in text else "/"
        widths = [len(x) for x in text.split(sep)]
        a, b, year = map(int, text.split(sep))
        day_first = sep == "." or a > 12 >= b  # day first with dots, month first with slashes if that is a date
        day = self._day(year, b, a) if day_first else self._day(year, a, b)
        if not day:
            return None
        first, second = (day.day, day.month) if day_first else (day.month, day.day)
        return f"{first:0{widths[0]}d}{sep}{second:0{widths[1]}d}{sep}{day.year}"

    def ssn(self, text: str) -> str | None:
        fine = lambda d: d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"
        digits = text.replace("-", "")
        if not fine(digits):
            return None
        digits = self._digits(digits, "ssn")
        while not fine(digits):  # walk on until it is a valid number
            digits = self._digits(digits, "ssn")
        return _filled(text, digits)

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        country = (COUNTRY.match(digits) or [""])[0] if text[0] == "+" else ""
        if not 6 <= len(digits) - len(country) <= 14:
            return None
        new = self._digits(digits[len(country) :], "phone+" + (country or "1"))  # (212) 555-0100 is +1 212 555 0100
        return _filled(text, country + new)

    def _swapped(self, kind: str, found: str, text: str, start: int) -> tuple[str, int] | None:
        """The pseudonym of the number at start, and where it ends; found is the longest candidate."""
        gaps = [m.span() for m in GAP.finditer(found)] if kind in ("phone", "card", "iban") else []
        ends = [len(found), *(a for a, _ in reversed(gaps))]
        if kind == "phone":
            ten = [end for end in ends if found.startswith("+1") and sum(map(str.isdigit, found[:end])) == 11]
            for a, b in () if ten else gaps:
                other = OTHER.match(text, start + b)
                if other and self._swapped(_kind(other), other[0], text, start + b):
                    ends = [end for end in ends if end <= a]
                    break
            ends = ten or ends
        for end in ends:
            if kind == "card" and sum(map(str.isdigit, found[:end])) < 13:
                break
            out = getattr(self, kind)(found[:end])
            if out is not None:
                return out, start + end
        return None

    def _numbers(self, text: str, at: int, to: int) -> tuple[str, int]:
        """text[at:to] with pseudonyms for its numbers, and how many."""
        text, parts, n, done, at = text[at:to], [], 0, 0, 0
        while found := NUMBER.search(text, at):
            if swapped := self._swapped(_kind(found), found[0], text, found.start()):
                parts += [text[done : found.start()], swapped[0]]
                n, done = n + 1, swapped[1]
                at = done
            else:
                at = found.start() + 1  # another number may begin inside
        return "".join([*parts, text[done:]]), n

    def text(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many."""
        if not HINT.search(text):
            return text, 0
        parts, end, n = [], 0, 0  # numbers are not looked for inside mail addresses
        for found in MAIL.finditer(text) if "@" in text else ():
            between, k = self._numbers(text, end, found.start())
            parts += [between, self.mail(found[0])]
            end, n = found.end(), n + k + 1
        rest, k = self._numbers(text, end, len(text))
        return "".join([*parts, rest]), n + k


@lru_cache(maxsize=8)
def _pseudonyms(key: bytes, back: bool) -> Pseudonyms:
    return Pseudonyms(key, back)


def key_of(spark: SparkSession) -> bytes:
    """The key that the session sets; there is no other."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to the key of the pseudonyms")
    return key.encode()


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with pseudonyms in text, and n_found long, how many a text holds."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_found", T.LongType())])

    @F.pandas_udf(kind)
    def swap(texts: pd.Series) -> pd.DataFrame:
        names = _pseudonyms(key, False)
        return pd.DataFrame([(None, 0) if t is None else names.text(t) for t in texts], columns=["text", "n_found"])

    docs = docs.drop("n_found")
    new = free(docs, "_swapped")
    columns = [F.col(f"{new}.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(new, swap("text")).select(*columns, f"{new}.n_found")
