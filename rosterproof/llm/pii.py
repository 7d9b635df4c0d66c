"""Format-preserving pseudonyms for validated numbers and dates.

Payment cards (Luhn), IBANs (mod 97), phone numbers, IPv4 addresses, US social security
numbers and calendar dates are found and validated; each value is replaced by another
valid value of the same format, from a keyed permutation: a balanced Feistel network over
the value's symbols with BLAKE2b as the round function, walked on until the result is
valid again. The same value gets the same pseudonym in every document, and different
values different ones; without the key it cannot be undone. E-mail addresses and long
hexadecimal secrets, whose letters and digits are permuted in their places, follow the
same scheme. What fails validation is left as it is.

Cases: a null text stays null, an empty one empty; repeated rows get equal results; dates
stay in their century, in any of their spellings the same day; nothing is truncated.
"""

from __future__ import annotations

import re
from datetime import date
from hashlib import blake2b
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterproof.llm.common import sliced

ROUNDS = 10
#: Values remembered by a worker; bounds its memory.
REMEMBERED = 200_000

KINDS = ("email", "hex", "iban", "phone", "ip", "date", "ssn", "card")

_FIND = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?P<hex>(?<!\w)[0-9a-fA-F]{32,64}(?!\w))
    |(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?!\w))
    |(?P<phone>(?:(?<![\w+])\+[0-9]{1,3}[ ]\([0-9]{3}\)[ ]|(?<!\w)\([0-9]{3}\)[ ]|(?<![\w-])[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![\w-]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))
    |(?P<date>(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<card>(?<!\w)(?:
        [0-9]{13,19}
        |[0-9]{4}(?P<s4>[ -])[0-9]{4}(?P=s4)[0-9]{4}(?P=s4)[0-9]{4}
        |[0-9]{4}(?P<s6>[ -])[0-9]{6}(?P=s6)[0-9]{5}
    )(?!\w))
    """,
    re.X,
)
_MAYBE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    """The keyed permutations of all kinds, with a bounded memory of known values."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str | None] = {}

    def _mix(self, kind: str, size: int, turn: int, other: int, modulus: int) -> int:
        said = f"{kind}|{size}|{turn}|{other}".encode()
        return int.from_bytes(blake2b(said, key=self.key, digest_size=32).digest()) % modulus

    def permute(self, kind: str, left: int, right: int, a: int, b: int) -> tuple[int, int]:
        """A keyed permutation of the pairs (0..a-1, 0..b-1): alternating Feistel rounds."""
        for turn in range(0, ROUNDS, 2):
            left = (left + self._mix(kind, a * b, turn, right, a)) % a
            right = (right + self._mix(kind, a * b, turn + 1, left, b)) % b
        return left, right

    def symbols(self, kind: str, values: list[int], radices: list[int]) -> list[int]:
        """Permute symbols of given radices in their places."""
        half = len(values) // 2

        def number(v, r):
            n = 0
            for x, k in zip(v, r, strict=True):
                n = n * k + x
            return n

        def spelled(n, r):
            out = []
            for k in reversed(r):
                n, x = divmod(n, k)
                out.append(x)
            return out[::-1]

        lo, hi = radices[:half], radices[half:]
        x, y = self.permute(
            kind, number(values[:half], lo), number(values[half:], hi), prod(lo), prod(hi)
        )
        return spelled(x, lo) + spelled(y, hi)

    def index(self, kind: str, n: int, size: int) -> int:
        """A keyed permutation of 0 .. size-1, by walking within a slightly larger square."""
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            x, y = self.permute(kind, *divmod(n, b), a, b)
            n = x * b + y
            if n < size:
                return n

    def __call__(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if the value is not a valid one of its kind."""
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[at] = getattr(self, f"_{kind}")(value)
        return self.known[at]

    def _digits(self, kind: str, digits: str) -> str:
        n = [int(c) for c in digits]
        return "".join(map(str, self.symbols(kind, n, [10] * len(n))))

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not luhn(digits) or not digits.strip("0"):
            return None
        while True:
            digits = self._digits("card", digits)
            if luhn(digits) and digits.strip("0"):
                return _into(value, digits)

    def _phone(self, value: str) -> str:
        code = re.match(r"\+\d+", value)
        start = code.end() if code else 0
        return value[:start] + _into(value[start:], self._digits("phone", re.sub(r"\D", "", value[start:])))

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        # Each part keeps its number of digits: 0-9, 10-99 or 100-255.
        low = [(0, 10, 100)[len(p) - 1] for p in parts]
        size = [(10, 90, 156)[len(p) - 1] for p in parts]
        new = self.symbols("ip", [int(p) - k for p, k in zip(parts, low, strict=True)], size)
        return ".".join(str(n + k) for n, k in zip(new, low, strict=True))

    def _ssn(self, value: str) -> str | None:
        area, group, serial = (int(p) for p in value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, rest = self.permute("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        group, serial = divmod(rest, 9999)
        return f"{a + 1 + (a >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _iban(self, value: str) -> str | None:
        if mod97(value) != 1:
            return None
        rest = value[4:]
        radix = [10 if c.isdigit() else 26 for c in rest]
        new = self.symbols("iban", [int(c) if c.isdigit() else ord(c) - 65 for c in rest], radix)
        body = "".join(str(n) if r == 10 else chr(65 + n) for n, r in zip(new, radix, strict=True))
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + body):02d}{body}"

    def _date(self, value: str) -> str | None:
        a, b, c = (int(p) for p in re.split(r"\D", value))
        swapped = False
        try:
            if "-" in value:
                day = date(a, b, c)
            else:
                # Day first; month first where only that is a date.
                swapped = b > 12
                day = date(c, a, b) if swapped else date(c, b, a)
        except ValueError:
            return None
        first = date(max(1, day.year // 100 * 100), 1, 1)
        last = date(day.year // 100 * 100 + 99, 12, 31)
        # However a day is spelled, it has one pseudonym: days up to the 12th, which could be
        # read as months, are permuted among themselves, and so are the others.
        late = day.day > 12
        while True:
            n = self.index("date", day.toordinal() - first.toordinal(), last.toordinal() - first.toordinal() + 1)
            day = date.fromordinal(first.toordinal() + n)
            if (day.day > 12) == late:
                break
        mark = value[2]
        if "-" in value:
            return day.isoformat()
        one, two = (day.month, day.day) if swapped else (day.day, day.month)
        return f"{one:02d}{mark}{two:02d}{mark}{day.year:04d}"

    def _email(self, value: str) -> str:
        keep = value.rindex(".")
        return self._places("email", value[:keep]) + value[keep:]

    def _places(self, kind: str, value: str) -> str:
        where, n, radix, base = [], [], [], []
        for i, c in enumerate(value):
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(first) < size:
                    where.append(i)
                    n.append(ord(c) - ord(first))
                    radix.append(size)
                    base.append(ord(first))
        out = list(value)
        for i, x, k in zip(where, self.symbols(kind, n, radix), base, strict=True):
            out[i] = chr(k + x)
        return "".join(out)

    def _hex(self, value: str) -> str | None:
        if value.isdigit() or value.isalpha() or value not in (value.lower(), value.upper()):
            return None
        new = [int(c, 16) for c in value]
        while True:
            new = self.symbols("hex", new, [16] * len(value))
            out = "".join("0123456789abcdef"[x] for x in new)
            if not (out.isdigit() or out.isalpha()):
                return out if value == value.lower() else out.upper()


def _into(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def pseudonymised(text: str, names: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """(new text, [(kind, start, end) in it]); every format keeps its length."""
    if not _MAYBE.search(text):
        return text, []
    found, out, at = [], [], 0
    for m in _FIND.finditer(text):
        kind = next(k for k in KINDS if m.group(k) is not None)
        new = names(kind, m.group(kind))
        if new is not None:
            out += (text[at : m.start()], new)
            at = m.end()
            found.append((kind, m.start(), m.end()))
    return ("".join([*out, text[at:]]) if found else text), found


def with_pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, found (kind, start, end)."""

    def run(batches):
        names = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in sliced(batches):
            got = [(None, []) if t is None else pseudonymised(t, names) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column("doc_id"),
                    "text": pa.array([t for t, _ in got], pa.string()),
                    "found": pa.array(
                        [[dict(zip(("kind", "start", "end"), f, strict=True)) for f in fs] for _, fs in got], kind
                    ),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        run, "doc_id long, text string, found array<struct<kind string, start long, end long>>"
    )
