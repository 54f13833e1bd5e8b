"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

Values are found by pattern and then validated: card numbers by their check digit, IBANs by modulo 97, social security numbers by
their ranges, dates by the calendar, addresses by their octets. A validated value is the i-th of the finitely many values of its
format; a Feistel network, keyed and distinct per format, permutes these numbers (walking on until the result is one of them),
and the result is written in the same layout, with check digits that hold. So equal values get equal pseudonyms in all
documents, different ones different pseudonyms, in whatever layout they are written, and with the key it can be undone.

Mail addresses and keys of programs (``token = "..."``) are permuted in the same way, letter for letter and digit for digit.
A date with slashes is read month first where that is a date, else day first. A phone number is linked with or without its country code. Not looked for
are numbers of ten digits set apart by blanks alone (``555 123 4567``) and keys without a name before them.
What doesn't validate stays. A null text stays null. All columns go along; names that start with ``pii_`` are reserved.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import map_rows

HALVES = 10  # Feistel rounds
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# The country codes of two digits. Zones 1 and 7 have one digit, all others three.
PAIR_CODES = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58"
    " 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()

#: Longer formats first: a value belongs to the first pattern that fits and validates.
PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![/-]?\d)",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "phone": r"(?<![\d+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d+])\+(?!1[ (.-])\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
    r"|(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ORDER = [(name, re.compile(pattern)) for name, pattern in PATTERNS.items()]
DIGITS = re.compile(r"\d+")
DOMAIN = re.compile(r"@((?:[A-Za-z0-9-]+\.)+)[A-Za-z]{2,}")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
ASSIGNED = re.compile(r"[:=] ?[\"']?([0-9A-Za-z_/+-]{16,})")
SECRET_NAME = re.compile(r"(?:token|secret|api[_-]?key|password|passwd)[\"']? ?\Z", re.IGNORECASE)


class Permutation:
    """A keyed permutation of 0 to n - 1 for every n and format name."""

    def __init__(self, key: bytes, backwards: bool = False) -> None:
        self.key, self.backwards = hashlib.blake2b(key, digest_size=32).digest(), backwards

    def half(self, name: str, step: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = f"{name}/{bits}/{step}/".encode() + value.to_bytes(size, "big")
        stream, block = b"", 0
        while len(stream) < size:
            stream += hashlib.blake2b(data + bytes([block]), key=self.key, digest_size=32).digest()
            block += 1
        return int.from_bytes(stream[:size], "big") & ((1 << bits) - 1)

    def once(self, name: str, value: int, bits: int) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        if self.backwards:
            for step in reversed(range(HALVES)):
                left, right = right ^ self.half(name, step, left, bits), left
        else:
            for step in range(HALVES):
                left, right = right, left ^ self.half(name, step, right, bits)
        return left << bits | right

    def __call__(self, name: str, value: int, n: int) -> int:
        """The value's image; steps outside of 0 to n - 1 are walked on from, so it stays a permutation."""
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        value = self.once(name, value, bits)
        while value >= n:
            value = self.once(name, value, bits)
        return value


def luhn(digits: str) -> int:
    """Sum that is divisible by 10 for a valid number."""
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)


def refill(layout: str, symbols: str) -> str:
    """``layout`` with its digits and letters replaced, one after the other."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in layout)


def alphabets(text: str) -> list[str]:
    """For each symbol the symbols it may become: digits, small letters, capitals; of hexadecimal strings, hexadecimal ones."""
    digits, small, capital = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if len(text) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        small, capital = small[:6], capital[:6]
    return [digits if c in digits else small if c in small else capital for c in text]


def permute_symbols(name: str, text: str, permutation: Permutation) -> str:
    """Every ASCII letter and digit within its kind, as one number of mixed base; all else stays."""
    symbols = "".join(c for c in text if c.isascii() and c.isalnum())
    kinds = alphabets(symbols)
    value, n = 0, 1
    for c, kind in zip(symbols, kinds):
        value, n = value * len(kind) + kind.index(c), n * len(kind)
    shape = "".join(kind[0] for kind in kinds) + str(len(kinds[0]) if kinds else "")
    value = permutation(f"{name}/{shape}", value, n)
    out = []
    for kind in reversed(kinds):
        value, k = divmod(value, len(kind))
        out.append(kind[k])
    rest = iter(reversed(out))
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in text)


def card(text: str, permutation: Permutation) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = str(permutation(f"card/{n}", int(digits[:-1]), 10**n)).zfill(n)
    return refill(text, body + str(-luhn(body + "0") % 10))


def country_code(digits: str) -> str:
    """The country code that an international number begins with: by the numbering zones one digit, one of the pairs, or three digits."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in PAIR_CODES else 3]


def phone(text: str, permutation: Permutation) -> str | None:
    """The number without its country code, which stays."""
    head = "+" + country_code(re.sub(r"\D", "", text)) if text[0] == "+" else ""
    if not text.startswith(head):
        return None
    digits = re.sub(r"\D", "", text[len(head) :])
    if not 7 <= len(digits) <= 14:
        return None
    return head + refill(text[len(head) :], str(permutation(f"phone/{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)))


def ipv4(text: str, permutation: Permutation) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permutation("ipv4", int.from_bytes(bytes(octets), "big"), 1 << 32)
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def ssn(text: str, permutation: Permutation) -> str | None:
    area, group, serial = map(int, text.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    value = permutation("ssn", (areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def date(text: str, permutation: Permutation) -> str | None:
    """Year first, or day and month before the year: with dots the day first, with slashes the month first where that is a date."""
    parts = [int(x) for x in re.split(r"\D", text)]
    orders = [(0, 1, 2)] if "-" in text else [(2, 1, 0)] if "." in text else [(2, 0, 1), (2, 1, 0)]
    for y, m, d in orders:
        try:
            day = datetime.date(parts[y], parts[m], parts[d]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # Days up to the 12th and later ones are permuted among themselves, in every layout, so a date with slashes is read as it was written.
        n, moved = LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY
        while True:
            moved = permutation("date", moved, n)
            new = datetime.date.fromordinal(FIRST_DAY + moved)
            if (new.day > 12) == (parts[d] > 12):
                break
        out = [0, 0, 0]
        out[y], out[m], out[d] = new.year, new.month, new.day
        separator = re.search(r"\D", text)[0]
        if "-" in text:
            return f"{out[0]:04d}-{out[1]:02d}-{out[2]:02d}"
        padded = [len(x) == 2 and x[0] == "0" for x in re.split(r"\D", text)[:2]]
        wide = "02d" if any(padded) or all(len(x) == 2 for x in re.split(r"\D", text)[:2]) else "d"
        return separator.join((format(out[0], wide), format(out[1], wide), f"{out[2]:04d}"))
    return None


def iban(text: str, permutation: Permutation) -> str | None:
    plain = text.replace(" ", "")
    as_number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_symbols(f"iban/{plain[:2]}", plain[4:], permutation)
    check = 98 - as_number(body + plain[:2] + "00") % 97
    return refill(text, f"{plain[:2]}{check:02d}{body}")


FORMATS = {"iban": iban, "date": date, "ipv4": ipv4, "ssn": ssn, "phone": phone, "card": card}


def spans(text: str, permutation: Permutation) -> list[tuple[int, int, str, str]]:
    """Start, end, format and pseudonym of each value, in order and apart from each other."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in DOMAIN.finditer(text):
            local = LOCAL.search(text, max(0, m.start() - 64), m.start())
            if local and (not found or local.start() >= found[-1][1]):
                head, at = local[0] + "@" + m[1], m.end(1)
                found.append((local.start(), at, "email", permute_symbols("email", head, permutation)))
    for m in ASSIGNED.finditer(text):
        if SECRET_NAME.search(text, max(0, m.start() - 16), m.start()):
            found.append((m.start(1), m.end(1), "secret", permute_symbols("secret", m[1], permutation)))
    found.sort()
    taken, last = [], 0
    for item in found:
        if item[0] >= last:
            taken.append(item)
            last = item[1]
    numbers, at, k = [], 0, 0
    while m := DIGITS.search(text, at):
        at = m.end()
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            at = max(at, taken[k][1])
            continue
        fit = number_at(text, m.start(), permutation)
        if fit and not (k < len(taken) and taken[k][0] < fit[1]):
            numbers.append(fit)
            at = fit[1]
    return sorted(taken + numbers)


def number_at(text: str, digit: int, permutation: Permutation) -> tuple[int, int, str, str] | None:
    """The value that holds this first digit: it may start up to two characters before, with a country's letters, + or (."""
    for start in range(max(0, digit - 2), digit + 1):
        if start < digit and not (text[start] in "+(" or text[start].isupper()):
            continue
        for name, pattern in ORDER:  # the first format that fits here and validates
            fit = pattern.match(text, start)
            new = FORMATS[name](fit[0], permutation) if fit else None
            if new is not None:
                return start, fit.end(), name, new
    return None


def rewrite(text: str, permutation: Permutation) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the formats found."""
    out, at, names = [], 0, []
    for start, end, name, new in spans(text, permutation):
        out += [text[at:start], new]
        at = end
        names.append(name)
    return "".join(out) + text[at:], names


@lru_cache(maxsize=4)
def permutation_of(key: bytes, backwards: bool) -> Permutation:
    return Permutation(key, backwards)


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", backwards: bool = False) -> DataFrame:
    """All columns, with ``text`` rewritten, and pii_found (values replaced) and pii_formats (formats found, with repeats)."""
    at = docs.columns.index(text)
    added = [T.StructField("pii_found", T.LongType()), T.StructField("pii_formats", T.ArrayType(T.StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = permutation_of(key, backwards)
        for batch in batches:
            kind = batch.column(at).type
            # Only texts with a digit or an @ can hold a value.
            likely = pc.fill_null(pc.match_substring_regex(batch.column(at), "[0-9@]|(?i:token|secret|key|passw)"), False).to_pylist()
            texts, names = batch.column(at).to_pylist(), [[] for _ in range(batch.num_rows)]
            for k, look in enumerate(likely):
                if look:
                    texts[k], names[k] = rewrite(texts[k], permutation)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, kind)
            own = [pa.array([len(x) for x in names], pa.int64()), pa.array(names, pa.list_(pa.string()))]
            columns += own
            yield pa.RecordBatch.from_arrays(columns, [f"c{n}" for n in range(len(columns))])

    fields = [T.StructField(f.name, f.dataType if f.name != text else T.StringType()) for f in docs.schema.fields]
    return map_rows(docs, run, fields + added)
