"""Format-preserving pseudonyms for personal data.

Candidates are found by pattern and validated (Luhn, mod 97, octet ranges, calendar, number plans).
A valid value is a number below the size of its format; a keyed Feistel network permutes these
numbers, walking on while it leaves the format, so a pseudonym is a valid value of the same kind, equal
values have equal pseudonyms in all documents, and the key's holder can undo them. Check digits are
computed anew, separators and letter case stay where they are.

Null texts stay null with nothing found; texts without candidates stay as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, pieces

ROUNDS = 10


class Feistel:
    """A keyed permutation of the numbers below n."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keys = [hashlib.blake2b(f"{kind}/{n}/{r}".encode(), key=key, digest_size=32).digest() for r in range(ROUNDS)]

    def _round(self, r: int, x: int) -> int:
        d = hashlib.blake2b(x.to_bytes(self.half // 8 + 1, "big"), key=self.keys[r], digest_size=self.half // 8 + 1).digest()
        return int.from_bytes(d, "big") & self.mask

    def encrypt(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in range(ROUNDS):
                a, b = b, a ^ self._round(r, b)
            x = a << self.half | b
            if x < self.n:
                return x

    def decrypt(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for r in reversed(range(ROUNDS)):
                a, b = b ^ self._round(r, a), a
            x = a << self.half | b
            if x < self.n:
                return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, ch in enumerate(reversed(body)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(ch, 36)) for ch in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(shape: str, new: str, what: str = "0123456789") -> str:
    """shape with its characters of `what` replaced in turn."""
    it = iter(new)
    return "".join(next(it) if ch in what else ch for ch in shape)


class Pseudonyms:
    """Pseudonyms of all kinds under one key. `back` undoes them."""

    # Patterns of each kind, tried in this order at each place.
    PATTERNS = {
        "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
        "ipv4": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
        "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
        "phone": r"(?<!\w)\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w-])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
        "card": r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<s1>[ -])\d{4}(?P=s1)\d{4}(?P=s1)\d{4}(?:(?P=s1)\d{3})?|\d{4}(?P<s2>[ -])\d{6}(?P=s2)\d{5})(?![\w-])",
        "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
        "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w-])",
    }

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.permutations: dict[tuple[str, int], Feistel] = {}
        self.pattern = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in self.PATTERNS.items()))

    def permute(self, kind: str, x: int, n: int) -> int:
        f = self.permutations.get((kind, n)) or self.permutations.setdefault((kind, n), Feistel(self.key, kind, n))
        return f.decrypt(x) if self.back else f.encrypt(x)

    def _walk(self, kind: str, digits: str, valid: Callable[[str], bool]) -> str:
        """A permutation of the valid strings of these many digits, by walking on."""
        n = len(digits)
        while True:
            digits = f"{self.permute(kind, int(digits), 10**n):0{n}d}"
            if valid(digits):
                return digits

    def of(self, kind: str, value: str) -> str | None:
        """The pseudonym, or None if the value is not valid."""
        return getattr(self, f"_{kind}")(value)

    def _email(self, value: str) -> str | None:
        local, _, domain = value.partition("@")
        letters = [ch for ch in local if ch.isascii() and ch.isalpha()]
        digits = [ch for ch in local if ch.isascii() and ch.isdigit()]
        x = 0
        for ch in letters:
            x = x * 26 + ord(ch.lower()) - 97
        for ch in digits:
            x = x * 10 + int(ch)
        n = 26 ** len(letters) * 10 ** len(digits)
        x = self.permute(f"email {domain.lower()} {re.sub('[A-Za-z]', 'a', re.sub('[0-9]', '0', local))}", x, n)
        ds, ls = [], []
        for _ in digits:
            x, d = divmod(x, 10)
            ds.append(str(d))
        for _ in letters:
            x, d = divmod(x, 26)
            ls.append(chr(97 + d))
        letter, digit = iter(ls[::-1]), iter(ds[::-1])
        out = []
        for ch in local:
            if ch.isascii() and ch.isalpha():
                c = next(letter)
                out.append(c.upper() if ch.isupper() else c)
            else:
                out.append(next(digit) if ch.isascii() and ch.isdigit() else ch)
        return f"{''.join(out)}@{domain}"

    def _ipv4(self, value: str) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        x = self.permute("ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, value: str) -> str | None:
        flat = value.replace(" ", "")
        country, rest = flat[:2], flat[4:]
        if not 15 <= len(flat) <= 34 or int("".join(str(int(ch, 36)) for ch in rest + flat[:4])) % 97 != 1:
            return None
        digits = "".join(ch for ch in rest if ch.isdigit())
        d = f"{self.permute('iban' + country, int(digits or 0), 10 ** len(digits)):0{len(digits)}d}" if digits else ""
        new = _refill(rest, d)
        return _refill(value, country + _iban_check(country, new) + new, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")

    def _phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 10 <= len(digits) <= 15:
            return None
        lead = len(re.match(r"\+(\d{1,3})[ .(-]", value)[1]) if re.match(r"\+(\d{1,3})[ .(-]", value) else 0
        body = digits[lead:]
        return _refill(value, digits[:lead] + f"{self.permute('phone' + digits[:lead], int(body), 10 ** len(body)):0{len(body)}d}")

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = self._walk("card", digits[:-1], lambda s: len(set(s + luhn_digit(s))) > 1)
        return _refill(value, body + luhn_digit(body))

    def _ssn(self, value: str) -> str | None:
        def valid(s: str) -> bool:
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        digits = value.replace("-", "")
        return _refill(value, self._walk("ssn", digits, valid)) if valid(digits) else None

    def _date(self, value: str) -> str | None:
        parts = [int(x) for x in re.split(r"[./-]", value)]
        iso = "-" in value
        orders = ("ymd",) if iso else ("mdy", "dmy") if "/" in value else ("dmy",)
        for order in orders:
            y, m, d = (parts[order.index(k)] for k in "ymd")
            try:
                day = datetime.date(y, m, d).toordinal()
            except ValueError:
                continue
            first, last = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()) if 1900 <= y <= 2099 else (1, datetime.date.max.toordinal())

            def whole(x: int) -> bool:
                """The permuted day reads back in the same order and range."""
                t = datetime.date.fromordinal(x)
                inside = last > 800_000 and not (1900 <= t.year <= 2099) or last < 800_000
                return t.year >= 1000 and inside and (order != "dmy" or "/" not in value or t.day > 12)

            while True:
                day = first + self.permute(f"date {order} {first}", day - first, last - first + 1)
                if whole(day):
                    break
            t = datetime.date.fromordinal(day)
            numbers = {"y": f"{t.year:04d}", "m": f"{t.month:02d}", "d": f"{t.day:02d}"}
            sep = re.search(r"[./-]", value)[0]
            return sep.join(numbers[k] for k in order)
        return None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with pseudonyms, and (kind, start, end, pseudonym) of each place in the old text."""
        found = []
        if not re.search(r"[0-9@]", text):
            return text, found

        def one(m: re.Match) -> str:
            kind = next(k for k in self.PATTERNS if m[k] is not None)
            new = self.of(kind, m[0])
            if new is None:
                return m[0]
            found.append((kind, m.start(), m.end(), new))
            return new

        return self.pattern.sub(one, text), found


def pseudonymise(docs: DataFrame, key: bytes, with_spans: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_found, kinds, text[, spans]): the whole text with pseudonyms."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
    names = ["doc_id", "n_found", "kinds", "text"] + ["spans"] * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in pieces(batches, "text"):
            rows = []
            for text in col(batch, "text").to_pylist():
                new, found = p.replace(text) if text else (text, [])
                spans = [dict(zip(("kind", "start", "end", "pseudonym"), x)) for x in found]
                rows.append((len(found), ",".join(sorted({x[0] for x in found})), new, spans))
            n, kinds, new, spans = zip(*rows)
            arrays = [col(batch, "doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(kinds, pa.string()), pa.array(new, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(spans, span)] * with_spans, names)

    schema = "doc_id long, n_found long, kinds string, text string" + ", spans array<struct<kind:string,start:int,end:int,pseudonym:string>>" * with_spans
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(run, schema)
