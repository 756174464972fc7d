"""Format-preserving pseudonyms (operator 5).

Personal data in a text is found by patterns, validated (check digits, ranges, the calendar) and replaced by a keyed
permutation of the values of its format that leaves none in place: a balanced Feistel network over the value's number (walked in
cycles where the format has fewer values than the network) orders the valid values, and each is replaced by the one behind it.
So different values of a format have different pseudonyms, and equal values get equal ones in every document, whatever
separators they are written with; separators and check digits stay.  Kinds, in this order where they overlap: e-mail addresses,
secret hexadecimal tokens, IBANs, card numbers, social security numbers, dates, telephone numbers, IP addresses.

A date is one value whether written year, day or month first and with or without leading zeros (day first where both could be);
those with a day up to 12 go to such, and others to others, so that a pseudonym can be read again as the same date.  A month or
day in one digit may become one of two.  Telephone numbers behind + keep their country code; ten digits without + are read as a
number behind +1.  An e-mail address has at most 64 characters before the @.

The key is a secret that the caller passes.  Without one the queries take the setting KEY_SETTING of the session, and where it
is unset a random key of this application: pseudonyms are then linked within it and nobody can undo them.

Defined cases: null text stays null, empty text empty; null and repeated keys are kept, a row each; all other columns pass
through (with report, columns named n_pii and pii_kinds give way); an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, read_table

ROUNDS = 8
KEY_SETTING = "spark.loomfeed.pseudonyms.key"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Country codes of two digits; 1 and 7 are codes of one, all others have three.
_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

# One pass: the first alternative that matches at a place wins.
_PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9_%+-])(?=[A-Za-z0-9_.%+-]{1,64}@)[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?<![A-Za-z0-9])(?P<token>(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}))(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![0-9A-Za-z.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?!\.?[0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?!-?[0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<date>[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?:(?![0-9A-Za-z])|(?=[Tt][0-9]{2}:?[0-9]{2}))"
    r"|(?<![0-9A-Za-z])(?P<card>[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?P<phone>\+1(?:[ ./()-]{0,2}[0-9]){10}(?![0-9A-Za-z])|\+[2-9](?:[ ./()-]{0,2}[0-9]){7,14}(?![0-9A-Za-z])|(?:\+[0-9]{1,3}[ .#*$%&!|-]{0,5})?\([0-9]{2,4}\)[ .#*$%&!|-]{0,5}[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[01](?:[ ./()-]{0,2}[0-9]){7,14})(?![0-9A-Za-z])"
)


def luhn(digits: str) -> int:
    """The check digit behind these digits."""
    return -sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country) + "00") % 97


class Pseudonyms:
    """Replaces the values in texts under one key."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple[str, str], str | None] = {}

    def _network(self, x: int, size: int, tweak: str, back: bool) -> int:
        """A permutation of the numbers under size, or its inverse: cycle walking over a Feistel network of the next even width."""
        half = max(1, (size - 1).bit_length() + 1 >> 1)
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            if back:
                left, right = right, left
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                f = hashlib.blake2b(f"{tweak}|{size}|{i}|{right}".encode(), digest_size=32, key=self.key).digest()
                left, right = right, left ^ int.from_bytes(f, "big") & mask
            if back:
                left, right = right, left
            x = left << half | right
            if x < size:
                return x

    def permute(self, x: int, size: int, tweak: str, fine: Callable[[int], bool] = lambda _: True) -> int:
        """The fine number under size that stands behind x in the secret order of them all; x itself only if it is the only one."""
        place = self._network(x, size, tweak, False)
        while True:
            place = (place + 1) % size
            y = self._network(place, size, tweak, True)
            if fine(y):
                return y

    def _email(self, text: str) -> str:
        name, _, host = text.rpartition("@")
        spots = [i for i, c in enumerate(name) if c.isalnum()]
        x, size = 0, 1
        for i in spots:
            base = 10 if name[i].isdigit() else 26
            x, size = x * base + (int(name[i]) if base == 10 else _LETTERS.index(name[i].lower())), size * base
        y, out = self.permute(x, size, f"email|{host.lower()}|{re.sub('[a-z]', 'a', re.sub('[0-9]', '9', name.lower()))}"), list(name)
        for i in reversed(spots):
            base = 10 if name[i].isdigit() else 26
            y, d = divmod(y, base)
            out[i] = str(d) if base == 10 else _LETTERS[d].upper() if name[i].isupper() else _LETTERS[d]
        return f"{''.join(out)}@{host}"

    def _token(self, text: str) -> str:
        out = format(self.permute(int(text, 16), 16 ** len(text), f"token|{len(text)}"), f"0{len(text)}x")
        return out.upper() if text.upper() == text else out

    def _iban(self, text: str) -> str | None:
        raw = text.replace(" ", "")
        country, account = raw[:2], raw[4:]
        if not 15 <= len(raw) <= 34 or int("".join(str(int(c, 36)) for c in account + raw[:4])) % 97 != 1:
            return None
        x, size = 0, 1
        for c in account:
            base = 10 if c.isdigit() else 26
            x, size = x * base + (int(c) if base == 10 else ord(c) - 65), size * base
        y, out = self.permute(x, size, f"iban|{country}|{re.sub('[A-Z]', 'A', re.sub('[0-9]', '9', account))}"), []
        for c in reversed(account):
            y, d = divmod(y, 10 if c.isdigit() else 26)
            out.append(str(d) if c.isdigit() else chr(65 + d))
        new = "".join(reversed(out))
        return _like(text, f"{country}{iban_check(country, new):02d}{new}")

    def _card(self, text: str) -> str | None:
        d = re.sub("[^0-9]", "", text)
        if int(d[-1]) != luhn(d[:-1]):
            return None
        body = str(self.permute(int(d[:-1]), 10 ** (len(d) - 1), f"card|{len(d)}")).zfill(len(d) - 1)
        return _like(text, body + str(luhn(body)))

    def _ssn(self, text: str) -> str | None:
        fine = lambda n: 0 < n // 1_000_000 < 900 and n // 1_000_000 != 666 and n // 10_000 % 100 > 0 and n % 10_000 > 0
        x = int(text.replace("-", ""))
        return _like(text, f"{self.permute(x, 10**9, 'ssn', fine):09d}") if fine(x) else None

    def _date(self, text: str) -> str | None:
        parts = re.split("[-/.]", text)
        year_first = len(parts[0]) == 4
        y, *rest = map(int, parts if year_first else reversed(parts))
        for k, (m, d) in enumerate([rest] if year_first else [rest, rest[::-1]]):  # day first, else month first
            try:
                x = datetime.date(y, m, d).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= x <= LAST_DAY - FIRST_DAY:
                return None
            early = lambda n: datetime.date.fromordinal(n + FIRST_DAY).day <= 12
            kind = early(x)
            day = datetime.date.fromordinal(self.permute(x, LAST_DAY - FIRST_DAY + 1, f"date|{kind}", lambda n: early(n) == kind) + FIRST_DAY)
            new = [day.year, day.month, day.day] if year_first else [*([day.day, day.month], [day.month, day.day])[k], day.year]
            sign = re.search("[-/.]", text)[0]
            return sign.join(str(v).zfill(len(p)) for v, p in zip(new, parts, strict=True))
        return None

    def _phone(self, text: str) -> str | None:
        """The country code stays; the rest is permuted."""
        d = re.sub("[^0-9]", "", text)
        if not 7 <= len(d) <= 15:
            return None
        kept = 0 if text[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in _CODES else 3
        rest = d[kept:]
        country = "1" if not kept and len(d) == 10 else d[:kept]
        return _like(text, d[:kept] + str(self.permute(int(rest), 10 ** len(rest), f"phone|{country}|{len(rest)}")).zfill(len(rest)))

    def _ip(self, text: str) -> str | None:
        """Octets keep their widths, so that the text keeps its length."""
        parts = text.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        ranges = [(0, 10) if len(p) == 1 else (10, 90) if len(p) == 2 else (100, 156) for p in parts]
        x, size = 0, 1
        for p, (low, n) in zip(parts, ranges, strict=True):
            x, size = x * n + int(p) - low, size * n
        y, out = self.permute(x, size, f"ip|{[n for _, n in ranges]}"), []
        for low, n in reversed(ranges):
            y, v = divmod(y, n)
            out.append(str(low + v))
        return ".".join(reversed(out))

    def pseudonym(self, kind: str, value: str) -> str | None:
        """What stands for the value; null if it is not valid."""
        if (kind, value) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[kind, value] = getattr(self, f"_{kind}")(value)
        return self.known[kind, value]

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds that were found."""
        out, kinds, end, at = [], [], 0, 0
        while m := _PATTERN.search(text, at):
            kind = m.lastgroup if m.lastgroup not in ("s1", "s2") else "date"
            new = self.pseudonym(kind, m[kind])
            if new is None:  # not valid: go on behind its first run of digits or letters
                at = _RUN.match(text, m.start() + 1).end()
                continue
            out += [text[end : m.start()], new]
            kinds.append(kind)
            end = at = m.end()
        return ("".join([*out, text[end:]]) if out else text), kinds


def _like(shape: str, solid: str) -> str:
    """The characters of solid in the places of the letters and digits of shape."""
    rest = iter(solid)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


_HINT = re.compile(r"[0-9]{2}|@")
_RUN = re.compile(r"[0-9A-Za-z]*")


_RANDOM_KEYS: dict[str, bytes] = {}


def key_of(spark: SparkSession) -> bytes:
    """The key that the session's setting names, or a random one for this application."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else _RANDOM_KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", report: bool = True) -> DataFrame:
    """docs with pseudonyms in its text; with report also n_pii and pii_kinds.  No shuffle."""

    def replace(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for batch in it:
            found = [p(x) if x and _HINT.search(x) else (x, []) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([x for x, _ in found], batch.schema.field(at).type)
            counts = [pa.array([len(k) for _, k in found], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in found], pa.string())] if report else []
            yield pa.RecordBatch.from_arrays([*(columns[i] for i in kept), *counts], schema.names)

    more = [T.StructField("n_pii", T.LongType()), T.StructField("pii_kinds", T.StringType())] if report else []
    at, kept = docs.columns.index(text), [i for i, c in enumerate(docs.columns) if c not in [f.name for f in more]]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), *more])
    return map_arrow(docs, replace, schema)


def op5_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text")), key_of(spark))
