"""Format-preserving pseudonyms: validated values are permuted within their format by a key.

E-mail addresses, IPv4 addresses, card numbers, IBANs, phone numbers, social security
numbers, dates and quoted hexadecimal secrets are found by pattern and then validated
(calendar, Luhn and mod-97 checks, ranges). A valid value is a number of a known range; a
balanced Feistel network of eight rounds, keyed by a hash, permutes the numbers of the next
power of four, and is applied again until the result lies in the range. So every value has
one pseudonym of the same format that is valid in the same way, no two values share one, and
equal values stay equal across documents, whatever separators they are written with. Phone
numbers are split by the country codes in use, so that the country stays and the rest is
permuted, with separators or without; two zeros in front say the same as a plus where ten
digits or more follow (with country code 1, eleven), and such a pseudonym that would be read
as a card's number is written with a plus. The name in an e-mail address has one pseudonym in
small and capital letters, which keep their places. A date has one pseudonym in whatever format it is
written; dates with slashes are month-first unless the first number is above 12, and a
day-first pseudonym that would be read as month-first is written with dots. Days and months
are written without zeros in front where one of the value's is. What follows a
word for "version" is no date or address. Only who has the key can go back (``reverse``).

Defined results: a null text stays null; texts without findings are left as they are, byte
for byte; repeated rows get equal results; an empty table gives an empty result; values that
fail validation stay, as do phone numbers without a country code and dates with names of
months. In rows other columns are kept as they are; counts whose names are taken get longer ones.
"""

from __future__ import annotations

import datetime
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, small_batches

#: No date or address is looked for after these.
VERSION = "".join(rf"(?<!\b{w}{s})" for w in ("ver", "Ver", "version", "Version", "release", "Release", "rev", "build") for s in (" ", ". ", ": "))
KINDS = ("email", "ipv4", "card", "iban", "phone", "ssn", "date", "secret")
FOUND = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-]))"
    rf"|(?P<ipv4>{VERSION}(?<![\w.])" r"\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w.])(?:\d{4}([ -])\d{4}\5\d{4}\5\d{4}|\d{4}([ -])\d{6}\6\d{5}|\d{13,19})(?!\w|\.\d))"
    r"|(?P<phone>(?:\+\d{1,3}|(?<![\w.,+/:-])00[ -]?[1-9]\d{0,2})[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,5}){1,4}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    rf"|(?P<date>{VERSION}(?<![\w./-])" r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-]|\.\d))"
    r"|(?P<secret>(?i:\b(?:token|key|secret|password|passwd|pwd|api_?key)\b\s*[=:]\s*[\"'])[0-9A-Fa-f]{16,128}(?=[\"']))"
)
HINT = re.compile(r"[@0-9]")
#: What is looked at as the number of a card.
CARD = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19}")
#: Dates are permuted within these spans of years.
YEARS = ((1600, 1900), (1900, 2100), (2100, 2400))
#: Country codes of one and two digits; all others have three.
ONE_DIGIT = "17"
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ROUNDS = 8


class Permuter:
    """Keyed permutations of the numbers below ``n``, another one for every ``tweak``."""

    def __init__(self, key: bytes, backwards: bool = False):
        self.key, self.backwards = key[:64], backwards

    def _round(self, tweak: bytes, i: int, x: int, mask: int) -> int:
        width = (mask.bit_length() + 7) // 8
        data = b"%d|%d|%d|" % (i, mask, x) + tweak
        out = b"".join(hashlib.blake2b(data + b"|%d" % j, key=self.key).digest() for j in range((width + 63) // 64))
        return int.from_bytes(out[:width], "little") & mask

    def __call__(self, x: int, n: int, tweak: bytes) -> int:
        half = (max(2, n - 1).bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            if self.backwards:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(tweak, i, left, mask), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._round(tweak, i, right, mask)
            x = left << half | right
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The digit that completes ``digits`` to a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def is_card(digits: str) -> bool:
    return luhn(digits[:-1]) == int(digits[-1]) and bool(digits.strip("0"))


def poured(form: str, chars: str, kind=str.isdigit) -> str:
    """``form`` with its characters of a kind replaced one by one."""
    new = iter(chars)
    return "".join(next(new) if kind(c) else c for c in form)


def classes(value: str) -> tuple[int, int, str]:
    """A word of letters and digits as a number: the number, how many there are, and the classes."""
    x, n, form = 0, 1, []
    for c in value:
        base, first = (10, "0") if c.isdigit() else (26, "a") if c.islower() else (26, "A")
        x, n = x * base + ord(c) - ord(first), n * base
        form.append(first)
    return x, n, "".join(form)


def spelled(x: int, form: str) -> str:
    out = []
    for first in reversed(form):
        x, d = divmod(x, 10 if first == "0" else 26)
        out.append(chr(ord(first) + d))
    return "".join(reversed(out))


def plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def pseudonym(kind: str, value: str, permute: Permuter) -> str | None:
    """The pseudonym of a value of this kind, or None if the value isn't valid."""
    tweak = kind.encode()
    digits = re.sub(r"\D", "", value)
    if kind == "email":
        local, _, domain = value.partition("@")
        word = "".join(filter(plain, local))
        x, n, form = classes(word.lower())
        new = spelled(permute(x, n, tweak + form.encode() + domain.lower().encode()), form)
        return poured(local, "".join(c.upper() if o.isupper() else c for o, c in zip(word, new, strict=True)), plain) + "@" + domain
    if kind == "ipv4":
        parts = [int(p) for p in value.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        x = permute(int.from_bytes(bytes(parts)), 2**32, tweak)
        return ".".join(map(str, x.to_bytes(4)))
    if kind == "card":
        if not is_card(digits):
            return None
        body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), tweak + b"%d" % len(digits))).zfill(len(digits) - 1)
        return poured(value, body + str(luhn(body)))
    if kind == "iban":
        word = value.replace(" ", "")
        as_number = lambda w: int("".join(str(int(c, 36)) for c in w))
        if not 15 <= len(word) <= 34 or as_number(word[4:] + word[:4]) % 97 != 1:
            return None
        x, n, form = classes(word[4:])
        body = spelled(permute(x, n, tweak + word[:2].encode() + form.encode()), form)
        check = 98 - as_number(body + word[:2] + "00") % 97
        return poured(value, word[:2] + f"{check:02d}" + body, str.isalnum)
    if kind == "phone":
        if value.startswith("00"):
            rest = value[2:].lstrip(" -")
            digits = re.sub(r"\D", "", rest.replace("(0)", ""))
            # numbers with zeros in front are told from those that are dialled by their length
            if not (len(digits) == 11 if digits[0] in "1" else len(digits) >= 10):
                return None
            new = pseudonym("phone", "+" + rest, permute)
            zeros = new and value[: len(value) - len(rest)] + new[1:]
            return new if zeros is None or CARD.fullmatch(zeros) and is_card(re.sub(r"\D", "", zeros)) else zeros
        digits = re.sub(r"\D", "", value.replace("(0)", ""))  # what is dialled within the country only
        if not 8 <= len(digits) <= 15:
            return None
        country = 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3
        body = digits[country:]
        new = digits[:country] + str(permute(int(body), 10 ** len(body), tweak + digits[:country].encode() + b"|%d" % len(body))).zfill(len(body))
        parts = value.split("(0)")
        at = [sum(c.isdigit() for c in "".join(parts[:i])) for i in range(len(parts))]
        return "(0)".join(poured(part, new[i:]) for part, i in zip(parts, at, strict=True))
    if kind == "ssn":
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        if not valid(digits):
            return None
        while True:
            digits = str(permute(int(digits), 10**9, tweak)).zfill(9)
            if valid(digits):
                return poured(value, digits)
    if kind == "date":
        parts = re.split(r"[./-]", value)
        try:
            if len(parts[0]) == 4:
                date = datetime.date(*map(int, parts))
            elif "." in value or int(parts[0]) > 12:
                date = datetime.date(*map(int, reversed(parts)))
            else:
                date = datetime.date(int(parts[2]), int(parts[0]), int(parts[1]))
        except ValueError:
            return None
        years = next((y for y in YEARS if y[0] <= date.year < y[1]), None)
        if years is None:
            return None
        first, after = (datetime.date(y, 1, 1).toordinal() for y in years)
        date = datetime.date.fromordinal(first + permute(date.toordinal() - first, after - first, tweak + b"%d" % years[0]))
        sep = re.search(r"[./-]", value)[0]
        width = 1 if min(map(len, parts)) == 1 else 2  # as it is written, with zeros in front or without
        if len(parts[0]) == 4:
            return f"{date.year:04d}{sep}{date.month:02d}{sep}{date.day:02d}"
        if "." in value or int(parts[0]) > 12:
            sep = "." if date.day <= 12 else sep
            return f"{date.day:0{width}d}{sep}{date.month:0{width}d}{sep}{date.year:04d}"
        return f"{date.month:0{width}d}{sep}{date.day:0{width}d}{sep}{date.year:04d}"
    head, word = re.match(r"(?s)(.*[\"'])([0-9A-Fa-f]+)$", value).groups()
    upper = word.upper() == word and word.lower() != word
    x = permute(int(word, 16), 16 ** len(word), tweak + b"%d" % len(word))
    new = f"{x:0{len(word)}x}"
    return head + (new.upper() if upper else new)


def replaced(text: str, permute: Permuter, known: dict) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds of what was replaced in order."""
    if not HINT.search(text):
        return text, []
    kinds = []

    def swap(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "card" and re.match("00[ -]?[1-9]", m[0]) and not is_card(re.sub(r"\D", "", m[0])):
            kind = "phone"
        at = (kind, m[0])
        if at not in known:
            if len(known) > 200_000:
                known.clear()
            known[at] = pseudonym(kind, m[0], permute)
        if known[at] is None:
            return m[0]
        kinds.append(kind)
        return known[at]

    return FOUND.sub(swap, text), kinds


def pseudonymised(docs: DataFrame, key: bytes, *, text_col: str = "text", counts: bool = True, reverse: bool = False) -> DataFrame:
    """The rows of ``docs`` with pseudonyms in their texts and, if asked for, a count for each kind."""
    small_batches(docs.sparkSession)
    if not key:
        raise ValueError("pseudonyms need a secret key")
    named = {k: free_name(docs, f"n_{k}") for k in KINDS} if counts else {}

    @F.pandas_udf("struct<text: string, " + ", ".join(f"{k}: long" for k in KINDS) + ">")
    def swap(texts: pd.Series) -> pd.DataFrame:
        permute, known = Permuter(key, reverse), {}
        done = [(None, []) if t is None else replaced(t, permute, known) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in done]} | {k: [x.count(k) for _, x in done] for k in KINDS})

    found = free_name(docs, "swapped")
    rows = docs.withColumn(found, swap(F.col(text_col).cast("string")))
    rows = rows.withColumns({text_col: F.col(f"{found}.text")} | {n: F.col(f"{found}.{k}") for k, n in named.items()})
    return rows.select(*docs.columns, *named.values())
