"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers and dates are found by pattern, validated, and permuted within their format:
a date becomes another date, a card number another one of the same network with a right
check digit, an address of the internet another one. Numbers are permuted by a Feistel
network over exactly the values of the format (values outside it are walked on); names
and keys, which may be of any length, by one over their symbols, whose round function is
as wide as the half that it changes. So equal values have equal pseudonyms in every
document, different values different ones, and who holds the key can undo it. Written
separators, letter case and grouping stay as they were.

Formats: dates from 1900 to 2099 (year, month, day or day, month, year); phone numbers
(10 to 15 digits with a country code, which stays, brackets or dashes; not all equal);
payment cards (a network's prefix and length, which stay, and a right check digit, made
anew); international account numbers (check digits made anew); social security numbers
(of areas, groups and serials that are given out); IPv4 addresses (not this host's own);
e-mail addresses (local part and domain, letters to letters and digits to digits, so
equal domains stay linked too); keys of 32 or more hexadecimal digits that follow a word
such as token, key or password (a digest or hex dump without one stays).

Defined cases: null text stays null; text without such values stays as it is; values
that fail their validation stay; long texts and long values are handled whole; an empty
table stays empty; repeated rows are rewritten alike; all other columns are kept as they
are, but for columns named as the counts are, in any case, which the counts replace.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm.common import in_pieces

ROUNDS = 8
#: Stands in for a secret that a deployment passes in.
DEFAULT_KEY = b"tilespark demonstration key"
KINDS = ("date", "card", "phone", "ssn", "ip", "iban", "email", "secret")
_FIRST, _DAYS = datetime.date(1900, 1, 1), 73049

_EMAIL = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]+)@((?:[A-Za-z0-9-]+\.)+)([A-Za-z]{2,})(?![\w-])")
_HEX = re.compile(r"(?<![0-9A-Za-z_])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z_])")
#: What a key is written after: a word for secrets, the rest of a name, and an assignment.
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|passphrase|pwd|credentials?|auth|bearer|key)[\w-]{0,24}[\"'`)\]]{0,2}\s{0,4}(?::|=>?|:=|is)?\s{0,4}[\"'`]?$", re.I)
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
#: Prefixes of payment card networks, and their lengths.
_NETWORK = re.compile(
    r"(?P<visa>4)(?:\d{12}|\d{15}|\d{18})$|(?P<mc>5[1-5]|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)(?<=\d\d)\d+$"
    r"|(?P<amex>3[47])\d{13}$|(?P<disc>6011|64[4-9]|65)\d+$|(?P<diners>30[0-5]|3[689])\d{11,17}$|(?P<jcb>35)\d{14,17}$|(?P<union>62)\d{14,17}$"
)
_LENGTHS = {"mc": (16,), "disc": (16, 19)}
#: Any run that could hold numbers; what they are is decided inside it.
_RUN = re.compile(r"[+(0-9][0-9 ()./+-]{5,}[0-9]")
_NUMBER = re.compile(
    r"(?P<ymd>(?<!\d)(?<!\d[-/.])\d{4}(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}(?!\d)(?![-/.]\d))"
    r"|(?P<dmy>(?<!\d)(?<!\d[-/.])\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)\d{4}(?!\d)(?![-/.]\d))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)(?!\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<g>[ -])\d{4}(?P=g)\d{4}(?P=g)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
    r"|(?P<phone>(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d))"
)


class Feistel:
    """Keyed permutations of 0 .. size-1, one for each format name and size."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.seen: dict[tuple, int | bytes] = {}

    def _mix(self, name: bytes, step: int, value: int) -> int:
        data = struct.pack("<B", step) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "little")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, person=name[:16], digest_size=32).digest(), "little")

    def _once(self, name: bytes, a: int, b: int, value: int, back: bool) -> int:
        left, right = divmod(value, b)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * self._mix(name, step, left)) % b
            else:
                left = (left + sign * self._mix(name, step, right)) % a
        return left * b + right

    def permute(self, name: str, size: int, value: int, fits: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of ``value``, walking on past values that do not fit."""
        at = (name if not back else f"{name}<", size, value)
        if at not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            a = isqrt(size - 1) + 1
            b = -(-size // a)
            tag, out = hashlib.blake2b(f"{name} {size}".encode(), digest_size=16).digest(), value
            while True:
                out = self._once(tag, a, b, out, back)
                if out < size and fits(out):
                    break
            self.seen[at] = out
        return self.seen[at]

    def symbols(self, name: str, bases: bytes, values: bytes, back: bool = False) -> bytes:
        """The image of a row of symbols, each below its base, of any length."""
        at = (name, bases, values, back)
        if len(values) > 1000 or at not in self.seen:
            tag, base = hashlib.blake2b(name.encode() + b"\0" + bases, digest_size=32).digest(), np.frombuffer(bases, np.uint8).astype(np.int64)
            half, row = len(values) // 2, np.frombuffer(values, np.uint8).astype(np.int64)
            for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
                changed, other = (slice(half, None), slice(0, half)) if step % 2 else (slice(0, half), slice(half, None))
                data = self.key + tag + struct.pack("<B", step) + row[other].astype(np.uint8).tobytes()
                stream = np.frombuffer(hashlib.shake_256(data).digest(4 * len(row[changed])), "<u4").astype(np.int64)
                row[changed] = (row[changed] + (-stream if back else stream)) % base[changed]
            out = row.astype(np.uint8).tobytes()
            if len(values) > 1000:
                return out
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[at] = out
        return self.seen[at]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban_check(country: str, account: str) -> str:
    """The two check digits of an international account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _refill(pattern: str, digits: str) -> str:
    """The digits put in place of those of a written form."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    """Finds and replaces values in a text; ``back`` undoes it under the same key."""

    def __init__(self, key: bytes = DEFAULT_KEY, back: bool = False) -> None:
        self.feistel, self.back = Feistel(key), back

    def _permute(self, name: str, size: int, value: int, fits: Callable[[int], bool] = lambda _: True) -> int:
        return self.feistel.permute(name, size, value, fits, self.back)

    def digits(self, name: str, digits: str, fits: Callable[[str], bool] = lambda _: True) -> str:
        n = len(digits)
        return f"{self._permute(name, 10**n, int(digits), lambda v: fits(f'{v:0{n}d}')):0{n}d}"

    def card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        network = _NETWORK.match(digits)
        if network is None or not luhn(digits) or len(digits) not in _LENGTHS.get(network.lastgroup, (len(digits),)):
            return None
        prefix = network[network.lastgroup]
        new = prefix + self.digits(f"card {prefix} {len(digits)}", digits[len(prefix) : -1])
        return _refill(found, next(new + c for c in "0123456789" if luhn(new + c)))

    def ssn(self, found: str) -> str | None:
        def given(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = found.replace("-", "")
        return _refill(found, self.digits("ssn", digits, given)) if given(digits) else None

    def phone(self, found: str) -> str | None:
        code = re.match(r"\+\d{1,3}(?=\D)|\+1(?=\d{10}$)|\+", found)
        rest = found[code.end() :] if code else found
        digits = re.sub(r"\D", "", rest)
        if found.startswith("+0") or not 7 <= len(digits) <= 15 or len(set(digits)) == 1:
            return None
        own = f"phone {code[0] if code else ''}"
        return (code[0] if code else "") + _refill(rest, self.digits(own, digits, lambda d: len(set(d)) > 1 and (code is None or code[0] != "+" or d[0] != "0")))

    def date(self, found: str, year_first: bool) -> str | None:
        parts = re.split(r"[-/.]", found)
        year, month, day = map(int, parts if year_first else reversed(parts))
        try:
            days = (datetime.date(year, month, day) - _FIRST).days
        except ValueError:
            return None
        if not 0 <= days < _DAYS:
            return None
        new = _FIRST + datetime.timedelta(self._permute("date", _DAYS, days))
        values = [new.year, new.month, new.day]
        sep = re.search(r"[-/.]", found).group()
        padded = [f"{v:0{2 if len(p) > 1 else 1}d}" for v, p in zip(values if year_first else reversed(values), parts)]
        return sep.join(padded)

    def ip(self, found: str) -> str | None:
        parts = list(map(int, found.split(".")))
        if max(parts) > 255 or parts[0] in (0, 127):
            return None
        value = self._permute("ip", 1 << 32, int.from_bytes(bytes(parts), "big"), lambda v: v >> 24 not in (0, 127))
        return ".".join(map(str, value.to_bytes(4, "big")))

    def iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if iban_check(country, account) != check:
            return None
        new = self.letters(f"iban {country}", account)
        rest = iter(country + iban_check(country, new) + new)
        return "".join(c if c == " " else next(rest) for c in found)

    def letters(self, name: str, found: str) -> str:
        """Letters to letters, digits to digits, all else as it is; capitals stay capitals."""
        shape = re.sub("[a-z]", "a", re.sub("[0-9]", "0", found.lower()))
        own = [c for c in found.lower() if c.isalnum()]
        bases, values = bytes(10 if c.isdigit() else 26 for c in own), bytes(int(c) if c.isdigit() else ord(c) - 97 for c in own)
        new = iter(self.feistel.symbols(f"{name} {shape}", bases, values, self.back))
        return "".join(c if not c.isalnum() else str(next(new)) if c.isdigit() else chr((65 if c.isupper() else 97) + next(new)) for c in found)

    def hexadecimal(self, found: str) -> str:
        values = bytes(int(c, 16) for c in found)
        digits = "0123456789ABCDEF" if found.isupper() else "0123456789abcdef"
        return "".join(map(digits.__getitem__, self.feistel.symbols("hex", bytes([16]) * len(values), values, self.back)))

    def rewrite(self, text: str, counts: dict[str, int]) -> str:
        def email(m: re.Match) -> str:
            counts["email"] += 1
            return f"{self.letters('local', m[1])}@{self.letters('domain', m[2])}{m[3]}"

        def secret(m: re.Match) -> str:
            # the case of a key without letters, and whether its digits differ, must outlast the permutation
            if not _NAMED.search(m.string, max(0, m.start() - 80), m.start()):
                return m[0]
            counts["secret"] += 1
            return self.hexadecimal(m[0])

        def number(m: re.Match) -> str:
            found = m[0]
            if m["ymd"] or m["dmy"]:
                kind, new = "date", self.date(found, bool(m["ymd"]))
            elif m["ip"]:
                kind, new = "ip", self.ip(found)
            elif m["card"]:
                kind, new = "card", self.card(found)
            elif m["ssn"]:
                kind, new = "ssn", self.ssn(found)
            else:
                kind, new = "phone", self.phone(found)
            if new is None:
                return found
            counts[kind] += 1
            return new

        def run(m: re.Match) -> str:
            start, end, whole = m.start(), m.end(), m.string
            if start and (whole[start - 1].isalnum() or whole[start - 1] == "_") or end < len(whole) and (whole[end].isalnum() or whole[end] == "_"):
                return bounded(m)
            return _NUMBER.sub(number, m[0])

        def bounded(m: re.Match) -> str:
            """A run that touches letters: its first or last number may be part of a word."""
            whole, start, end = m.string, m.start(), m.end()
            head = tail = ""
            inner = m[0]
            if start and (whole[start - 1].isalnum() or whole[start - 1] == "_"):
                head = re.match(r"\d*", inner)[0]
                inner = inner[len(head) :]
            if end < len(whole) and (whole[end].isalnum() or whole[end] == "_"):
                tail = re.search(r"\d*$", inner)[0]
                inner = inner[: len(inner) - len(tail)]
            return head + _NUMBER.sub(number, inner) + tail

        text = _HEX.sub(secret, text)
        if "@" in text:
            text = _EMAIL.sub(email, text)
        # what stands between international account numbers; their groups are no cards
        out, last = [], 0
        for m in _IBAN.finditer(text):
            if (new := self.iban(m[0])) is not None:
                counts["iban"] += 1
                out += [_RUN.sub(run, text[last : m.start()]), new]
                last = m.end()
        return "".join([*out, _RUN.sub(run, text[last:])])


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, counts: bool = False) -> DataFrame:
    """``docs`` with rewritten texts; with ``counts``, also n_<kind> for every kind of value."""
    extra = [f"n_{k}" for k in KINDS] if counts else []
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in extra]) if counts else docs
    names = docs.columns

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in in_pieces(batches):
            texts, found = [], []
            for text in batch.column(names.index("text")).to_pylist():
                n = dict.fromkeys(KINDS, 0)
                texts.append(None if text is None else own.rewrite(text, n))
                found.append(n)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            columns += [pa.array([n[k] for n in found], pa.int64()) for k in KINDS if counts]
            yield pa.RecordBatch.from_arrays(columns, [*names, *extra])

    return docs.mapInArrow(rewritten, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in extra]]))


def cleaned(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``docs`` with rewritten texts, and n_chars, where there is such a column, counted anew."""
    out = pseudonymise(docs, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
