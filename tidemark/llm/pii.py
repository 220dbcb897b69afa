"""Personal data replaced by format-preserving pseudonyms from a keyed Feistel permutation.

A value is found by its form, checked by its rules (issuer digit and Luhn's sum for cards, remainder 97 for account numbers, ranges for
addresses and social security numbers, the calendar for dates), and mapped to another value of the same form that
passes the same rules. The map is a permutation of all values of the form, so equal values get equal pseudonyms in all
documents, different values different ones, and the key's holder can undo it. Separators stay where they are: a number
with and without spaces gets the same digits. So does a number in the decimal digits of another script, which it keeps.
What fails its rules is left alone.

The permutation is a balanced Feistel network on bit strings, walked along its cycle until the result is in the range
of the form. Each text is handled by itself, so there is no shuffle.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")

# One pattern for all forms; at a place the first alternative that fits is tried.
FORMS = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))"
    r"|(?P<date>(?<![\d./-])(?:(?:19|20)\d\d([-/.])\d{1,2}\5\d{1,2}|\d{1,2}([-/.])\d{1,2}\6(?:19|20)\d\d)(?![\d]|[./-]\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d]|-\d))"
    r"|(?P<card>(?<!\d)(?<!\d[.-])(?:\d{13,19}|\d{4}([ -])\d{4}\9\d{4}\9\d{4}|\d{4}([ -])\d{6}\10\d{5})(?!\d))"
    r"|(?P<phone>(?<![\w+(])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w+])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?!\d))"
)
OTHER_DIGIT = re.compile(r"[^\D0-9]")  # a decimal digit that is not 0-9
SPECIAL_DATES = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()


class Feistel:
    """Keyed permutations of the whole numbers below any bound."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        if rounds % 2:
            raise ValueError("the number of rounds must be even")
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.rounds = rounds

    def _round(self, tweak: bytes, number: int, half: int, size: int) -> int:
        raw = hashlib.blake2b(
            number.to_bytes(2, "big") + tweak + b"\0" + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big"),
            key=self.key, digest_size=min(64, (size + 7) // 8 + 8),
        ).digest()
        return int.from_bytes(raw, "big") & ((1 << size) - 1)

    def _once(self, value: int, size: int, tweak: bytes, back: bool) -> int:
        left, right = value >> size, value & ((1 << size) - 1)
        for number in reversed(range(self.rounds)) if back else range(self.rounds):
            if back:
                left, right = right ^ self._round(tweak, number, left, size), left
            else:
                left, right = right, left ^ self._round(tweak, number, right, size)
        return left << size | right

    def permute(self, value: int, bound: int, tweak: str, back: bool = False) -> int:
        """The image of ``value`` among the numbers below ``bound``; ``tweak`` selects the permutation."""
        if not 0 <= value < max(bound, 1):
            raise ValueError(f"{value} is not below {bound}")  # its walk need not come back below the bound
        if bound < 2:
            return value
        size = ((bound - 1).bit_length() + 1) // 2
        name = f"{tweak}:{bound}".encode()
        value = self._once(value, size, name, back)
        while value >= bound:
            value = self._once(value, size, name, back)
        return value


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _remainder97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _laid_out(like: str, symbols: str) -> str:
    """``symbols`` in the places of letters and digits of ``like``."""
    following = iter(symbols)
    return "".join(next(following) if c.isalnum() else c for c in like)


def _in_script(like: str, text: str) -> str:
    """``text`` with its runs of digits in the script of those of ``like``, place by place; the last one's beyond its end."""
    runs = iter(re.findall(r"\d+", like))

    def put(m: re.Match) -> str:
        zeros = [ord(c) - int(c) for c in next(runs)]
        return "".join(chr(zeros[min(i, len(zeros) - 1)] + int(c)) for i, c in enumerate(m[0]))

    return re.sub(r"[0-9]+", put, text)


def _in_radix(text: str, mapped: Callable[[int, int], int]) -> str:
    """Map a string of letters and digits, each place keeping its class."""
    value, bound, classes = 0, 1, []
    for c in text:
        base, start = (10, "0") if c.isdigit() else (26, "a" if c.islower() else "A")
        classes.append((base, start))
        value, bound = value * base + ord(c) - ord(start), bound * base
    value = mapped(value, bound)
    out = []
    for base, start in reversed(classes):
        value, digit = divmod(value, base)
        out.append(chr(ord(start) + digit))
    return "".join(reversed(out))


@functools.cache
def _days_written(month: str, day: str) -> list[int]:
    """The days whose month and day are below ten (``one`` digit, or ``zero`` and a digit) or have ``two`` digits."""
    low, high = SPECIAL_DATES
    dates = map(datetime.date.fromordinal, range(low, high))
    return [d.toordinal() for d in dates if (d.month >= 10) == (month == "two") and (d.day >= 10) == (day == "two")]


class Pseudonyms:
    """Pseudonyms of single values; each method returns None for what fails the rules of its kind."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.feistel, self.back = Feistel(key), back

    def _map(self, kind: str) -> Callable[[int, int], int]:
        return lambda value, bound: self.feistel.permute(value, bound, kind, self.back)

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        return f"{_laid_out(local, _in_radix(''.join(c for c in local if c.isalnum()), self._map('email')))}@{domain}"

    def card(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if luhn(digits[:-1]) != int(digits[-1]) or digits[0] not in "23456":
            return None
        body = digits[0] + _in_radix(digits[1:-1], self._map("card" + digits[0]))
        return _laid_out(text, f"{body}{luhn(body)}")

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _remainder97(plain[4:] + plain[:4]) != 1 or not 2 <= int(plain[2:4]) <= 98:
            return None
        body = _in_radix(plain[4:], self._map("iban" + plain[:2]))
        return _laid_out(text, f"{plain[:2]}{98 - _remainder97(body + plain[:2] + '00'):02d}{body}")

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        value = int.from_bytes(bytes(map(int, parts)), "big")
        return str(ipaddress.IPv4Address(self.feistel.permute(value, 1 << 32, "ip", self.back)))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self.feistel.permute(value, 898 * 99 * 9999, "ssn", self.back), 9999)
        area, group = divmod(value, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, text: str) -> str | None:
        digits = "".join(c for c in text if c.isdigit())
        if not 8 <= len(digits) <= 15:
            return None
        country = len(re.match(r"\+?(\d*)", text)[1]) if text[0] == "+" else 0
        if country > 3:  # no separator after the country's code
            country = 1
        kept = digits[:country]
        return _laid_out(text, kept + _in_radix(digits[country:], self._map(f"phone{kept}")))

    def date(self, text: str) -> str | None:
        a, mark, b, _, c = re.match(r"(\d+)([-/.])(\d+)([-/.])(\d+)", text).groups()
        year_first = len(a) == 4
        year, month, day = (int(a), int(b), int(c)) if year_first else (int(c), int(b), int(a))
        swapped = not year_first and mark == "/"  # month first with slashes
        if swapped:
            month, day = day, month
        low, high = SPECIAL_DATES
        padded = len(a) + len(b) + len(c) == 8
        try:
            ordinal = datetime.date(year, month, day).toordinal()
            if not low <= ordinal < high:
                return None
        except ValueError:
            return None
        if not padded:
            wide = (b, c) if year_first else (a, b) if swapped else (b, a)
            return self._plain_date(ordinal, wide, mark, year_first, swapped)
        new = datetime.date.fromordinal(low + self.feistel.permute(ordinal - low, high - low, "date", self.back))
        return self._written(new, mark, year_first, swapped, 2, 2)

    @staticmethod
    def _written(d: datetime.date, mark: str, year_first: bool, swapped: bool, wide_month: int, wide_day: int) -> str:
        month, day = f"{d.month:0{wide_month}d}", f"{d.day:0{wide_day}d}"
        parts = (f"{d.year}", month, day) if year_first else (month, day, f"{d.year}") if swapped else (day, month, f"{d.year}")
        return mark.join(parts)

    def _plain_date(self, ordinal: int, wide: tuple[str, str], mark: str, year_first: bool, swapped: bool) -> str:
        """Where month or day is one digit, widths say something about the value: the date stays among those written alike."""
        form = tuple("one" if len(w) == 1 else "zero" if w[0] == "0" else "two" for w in wide)
        days = _days_written(*form)
        place = self.feistel.permute(bisect.bisect_left(days, ordinal), len(days), f"date {form[0]} {form[1]}", self.back)
        new = datetime.date.fromordinal(days[place])
        return self._written(new, mark, year_first, swapped, *(1 if f == "one" else 2 for f in form))

    def text(self, text: str, counts: dict[str, int], kinds: frozenset[str]) -> str:
        """The text with all values replaced; ``counts`` is added to."""
        # Digits of all scripts are read as 0-9, each in its place.
        plain = text if text.isascii() else OTHER_DIGIT.sub(lambda m: str(int(m[0])), text)

        parts, end = [], 0
        for m in FORMS.finditer(plain):
            kind, old = m.lastgroup, text[m.start() : m.end()]
            new = getattr(self, kind)(m[0]) if kind in kinds else None
            if new is None:
                continue
            counts[kind] += 1
            parts += [text[end : m.start()], new if old == m[0] else _in_script(old, new)]
            end = m.end()
        return "".join([*parts, text[end:]])


# Part of every form: a text without any of these has no value. An account number may have letters only after its first four.
MAYBE = re.compile(r"\d[\d .()/-]{4,}|@|[A-Z]{2}\d\d")


def pseudonymise(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS, back: bool = False
) -> DataFrame:
    """Texts with personal data replaced. One row per input row: identifier, text, ``n_found`` and ``found`` by kind.

    A null text stays null, with nothing found. ``found`` is a map with an entry for each kind of ``kinds``. Repeated
    rows get equal results, empty tables an empty one. ``back`` undoes the replacement, given the same key. Other
    columns are not read.
    """
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    id_type = docs.schema[id_col].dataType.simpleString()
    wanted = frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            out, total, found = [], [], []
            for text in batch.column("text").to_pylist():
                counts = dict.fromkeys(kinds, 0)
                if text is not None and MAYBE.search(text):
                    text = names.text(text, counts, wanted)
                out.append(text)
                total.append(sum(counts.values()))
                found.append(list(counts.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(found, pa.map_(pa.string(), pa.int32()))],
                ["id", "text", "n_found", "found"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {id_type}, text string, n_found long, found map<string,int>")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_found", "found")
