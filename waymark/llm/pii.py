"""Format-preserving pseudonyms for personal data and secrets.

Numbers and dates that pass their format's validation (checksums, calendars, numbering plans) are permuted within the
values of that format by a keyed Feistel network; the permutation depends on the key and the kind alone, so equal
values get equal pseudonyms in every document and different values stay different. Local parts of mail addresses, which
are compared without case, and the variable part of credentials are permuted over their own alphabets. Nothing is
gathered from the corpus.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import secrets
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROUNDS = 8
#: The setting of the session that holds the secret key.
KEY_SETTING = "spark.waymark.pseudonym.key"
#: Dates of these years are permuted among themselves; others within their century.
YEARS = (1900, 2099)
#: Lengths of the national account numbers by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
#: Digits of a national number, without the trunk prefix, by country code.
NATIONAL = {"33": (9, 9), "34": (9, 9), "44": (9, 10), "49": (7, 11)}
HEX, DIGITS, SMALL, LARGE = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: No text without one of these holds anything that is looked for.
HINT = re.compile(r"[0-9@]|AKIA|ASIA|password|token|secret|key", re.I)
FORMS = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<aws>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))
    |(?P<secret>(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?(?P<value>[A-Za-z0-9_+/-]{8,}={0,2}))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,26}(?![A-Za-z0-9]))
    |(?P<isodate>(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-]))
    |(?P<date>(?<![\w./-])[0-9]{1,2}(?P<sep>[/.-])[0-9]{1,2}(?P=sep)[0-9]{4}(?![\w/-]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<phone>(?<![\w+])(?:(?:\+1[ .-]?\(?|(?:1[ .-]?)?\()[0-9]{3}\)?[ .-]?[0-9]{3}|(?:1[ .-]?)?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2})[ .-][0-9]{4}(?![\w-]))
    |(?P<intl>(?<![\w+])\+(?P<country>33|34|44|49)[ ./-]?(?:\(0\)[ ./-]?)?[(]?[1-9][0-9]{0,4}[)]?(?:[ ./-]?[0-9]{2,8}){1,5}(?![\w-]))
    |(?P<pairs>(?<![\w+./-])(?<![0-9][ .])0[1-9](?:[ .][0-9]{2}){4}(?![\w-]|[ .][0-9]))
    |(?P<trunk>(?<![\w+./-])(?<![0-9][ .])0[1-9][0-9]{1,4}(?:[ ]|/)[0-9]{3,4}(?:[ ][0-9]{3,4})(?![\w/-]|[ ][0-9]))
    |(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?!\w))""",
    re.VERBOSE,
)
#: The rest of a group of letters and digits.
GROUP = re.compile("[A-Za-z0-9]*")


@functools.cache
def alphabet(c: str) -> str | None:
    """For a letter beyond ASCII those of its case among its 64 neighbouring characters; None for other characters."""
    if c.isascii() or not c.isalpha():
        return None
    first = ord(c) // 64 * 64
    return "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and x.islower() == c.islower() and x.lower().islower() == c.lower().islower() and (x.lower() == x) == (c.lower() == c))


class Feistel:
    """Keyed permutations of the numbers below a size and of strings over their own alphabets."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def mix(self, kind: str, nth: int, value: int) -> int:
        data = f"{kind}|{nth}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, digest_size=32, key=self.key).digest(), "big")

    def permute(self, kind: str, value: int, size: int) -> int:
        """A permutation of range(size): Feistel over pairs a * b >= size, walked on until the value is below size."""
        if size < 2:
            return value
        a = int(size**0.5) + 1 if size < 2**52 else 1 << ((size.bit_length() + 1) // 2)
        b = -(-size // a)
        name = f"{kind}|{size}"
        while True:
            left, right = divmod(value, b)
            for nth in range(ROUNDS):
                if nth % 2:
                    right = (right + self.mix(name, nth, left)) % b
                else:
                    left = (left + self.mix(name, nth, right)) % a
            value = left * b + right
            if value < size:
                return value

    def letters(self, kind: str, text: str) -> str:
        """Permute the letters and digits of text, each within its own class, the rest left as it is."""
        sets = [next((s for s in (DIGITS, SMALL, LARGE) if c in s), None) or alphabet(c) for c in text]
        return self.over(f"{kind}|{''.join('-' if s is None else s[0] for s in sets)}", text, sets)

    def over(self, kind: str, text: str, sets: list[str | None]) -> str:
        value, size = 0, 1
        for c, s in zip(text, sets):
            if s:
                value, size = value * len(s) + s.index(c), size * len(s)
        value = self.permute(kind, value, size)
        out = list(text)
        for k in range(len(text) - 1, -1, -1):
            if s := sets[k]:
                value, at = divmod(value, len(s))
                out[k] = s[at]
        return "".join(out)


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def refill(form: str, digits: str, characters: str = DIGITS) -> str:
    """form with its digits (or other characters) replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in characters else c for c in form)


def _card(f: Feistel, s: str) -> str | None:
    d = re.sub("[ -]", "", s)
    if len(d) < 13 or not luhn(d) or len(set(d)) == 1:
        return None
    body = str(f.permute(f"card{d[0]}", int(d[1:-1]), 10 ** (len(d) - 2))).zfill(len(d) - 2)
    return refill(s, d[0] + body + next(c for c in DIGITS if luhn(d[0] + body + c)))


def _phone(f: Feistel, s: str) -> str | None:
    """Numbers of the numbering plan (area code and exchange from 200) are permuted among themselves, as a bare number
    has to be one of them, and all others among themselves; so every form of a number has the same pseudonym."""
    d = re.sub("[^0-9]", "", s)
    head, area, middle, last = d[:-10], int(d[-10:-7]), int(d[-7:-4]), int(d[-4:])
    if area >= 200 and middle >= 200:
        value = f.permute("phone", ((area - 200) * 800 + middle - 200) * 10000 + last, 800 * 800 * 10000)
        area, middle = divmod(value // 10000, 800)
        area, middle = area + 200, middle + 200
    else:
        low = 200 * 1000  # pairs of an area code below 200 and any exchange; then the others with an exchange below 200
        pair = area * 1000 + middle if area < 200 else low + (area - 200) * 200 + middle
        value = f.permute("phone-other", pair * 10000 + last, (low + 800 * 200) * 10000)
        pair = value // 10000
        area, middle = divmod(pair, 1000) if pair < low else divmod(pair - low, 200)
        area += 0 if pair < low else 200
    return refill(s, f"{head}{area:03}{middle:03}{value % 10000:04}")


def _ssn(f: Feistel, s: str) -> str | None:
    area, group, serial = map(int, s.split("-"))
    areas = 898  # 001 to 899 without 666
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    value = f.permute("ssn", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, areas * 99 * 9999)
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def _ip(f: Feistel, s: str) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    return ".".join(map(str, f.permute("ip", int.from_bytes(bytes(parts), "big"), 2**32).to_bytes(4, "big")))


def _abroad(f: Feistel, s: str) -> str | None:
    """Numbers with a country code or the trunk prefix 0. The national number is permuted among those of its length, so
    the forms of a number with and without the code have one pseudonym."""
    start = 3 if s[0] == "+" else 1
    trunk = s.find("(0)") + 1  # the place of a bracketed prefix; 0, never a digit of the number, without one
    places = [k for k in range(start, len(s)) if s[k].isdigit() and k != trunk]
    number = "".join(s[k] for k in places)
    low, high = NATIONAL[s[1:3]] if s[0] == "+" else (9, 10)
    if not low <= len(number) <= high:
        return None
    least = 10 ** (len(number) - 1)
    out = list(s)
    for k, c in zip(places, str(least + f.permute("phone-national", int(number) - least, 9 * least))):
        out[k] = c
    return "".join(out)


def _day(f: Feistel, year: int, month: int, day: int) -> datetime.date | None:
    try:
        at = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    first, last = YEARS if YEARS[0] <= year <= YEARS[1] else (max(year - year % 100, 1), year - year % 100 + 99)
    start, end = datetime.date(first, 1, 1).toordinal(), datetime.date(last, 12, 31).toordinal()
    return datetime.date.fromordinal(start + f.permute("date" if first == YEARS[0] else f"date{first}", at - start, end - start + 1))


def _isodate(f: Feistel, s: str) -> str | None:
    new = _day(f, *map(int, s.split("-")))
    return new and new.isoformat()


def _date(f: Feistel, s: str) -> str | None:
    """Day first with dots; with slashes or hyphens month first, unless only day first is a date."""
    sep = next(c for c in s if not c.isdigit())
    a, b, year = map(int, s.split(sep))
    for month, day, form in [(b, a, "{d}{s}{m}{s}{y}")] if sep == "." else [(a, b, "{m}{s}{d}{s}{y}"), (b, a, "{d}{s}{m}{s}{y}")]:
        if new := _day(f, year, month, day):
            return form.format(d=f"{new.day:02}", m=f"{new.month:02}", y=f"{new.year:04}", s=sep)
    return None


def heads(s: str) -> Iterator[str]:
    """s and its beginnings that end at a space or hyphen, longest first."""
    yield s
    for k in range(len(s) - 1, 0, -1):
        if s[k] in " -":
            yield s[:k]


def _iban(f: Feistel, s: str) -> str | None:
    d = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if IBAN_LENGTHS.get(d[:2]) != len(d) or number(d[4:] + d[:4]) % 97 != 1:
        return None
    body = f.letters(f"iban{d[:2]}", d[4:])
    return refill(s, f"{d[:2]}{98 - number(body + d[:2] + '00') % 97:02}{body}", DIGITS + LARGE)


def _email(f: Feistel, s: str) -> str | None:
    local, at, host = s.rpartition("@")
    new = f.letters("email", local.lower())
    return new + at + host


def _aws(f: Feistel, s: str) -> str | None:
    return s[:4] + f.over("aws", s[4:], [LARGE + DIGITS] * 16)


def _value(f: Feistel, s: str) -> str:
    return f.over("hex", s, [HEX] * len(s)) if re.fullmatch("[0-9a-f]+", s) else f.letters("secret", s)


CHANGE: dict[str, Callable[[Feistel, str], str | None]] = {"email": _email, "aws": _aws, "iban": _iban, "isodate": _isodate, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "intl": _abroad, "pairs": _abroad, "trunk": _abroad, "card": _card}
#: Kinds that are reported under another name.
REPORTED = {"intl": "phone", "pairs": "phone", "trunk": "phone"}


def pseudonymise(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The new text, and (kind, start, length) of each replaced value in the old one.

    A candidate that fails validation is left as it is, and the search goes on after its first group. Of a card or an
    IBAN the longest beginning that is valid and ends at a separator counts: what follows may be an expiry date, a
    security code, a BIC or a currency. A credential (`token = ...`) needs a digit in its value.
    """
    if not HINT.search(text):
        return text, []
    out, found, last = [], [], 0
    at = 0
    while m := FORMS.search(text, at):
        start, end = m.span()
        if m["secret"]:
            kind, (start, end) = "secret", m.span("value")
            old = m["value"]
            new = _value(f, old) if any(c.isdigit() for c in old) else None
            if new and old[:4] in ("AKIA", "ASIA") and len(old) == 20:
                kind, new = "aws", _aws(f, old)
        else:
            kind = next(k for k in CHANGE if m[k])
            for old in heads(m.group()) if kind in ("card", "iban") else [m.group()]:
                if (new := CHANGE[kind](f, old)) is not None:
                    end = start + len(old)
                    break
        if new is not None:
            out += [text[last:start], new]
            last = at = end
            found.append((REPORTED.get(kind, kind), start, end - start))
        else:
            at = start if m["secret"] else GROUP.match(text, start + 1).end()
    return "".join([*out, text[last:]]), found


_FEISTELS: dict[bytes, Feistel] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting; without one a new random key, under which pseudonyms are linked within one
    result and nobody can undo them."""
    set_key = spark.conf.get(KEY_SETTING, None)
    return set_key.encode() if set_key else secrets.token_bytes(32)


def pseudonymise_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with its text pseudonymised, n_found, kinds ("email:2,ip:1") and found (kind, start and length in the old text).

    A null text stays null with nothing found. Rows are treated one by one: repeated rows give equal results, an empty
    table an empty one. Columns of docs named n_found, kinds or found are replaced.
    """
    docs = docs.drop("n_found", "kinds", "found")
    names = docs.columns
    at = names.index("text")
    plain = [f"c{k}" for k in range(len(names))]  # Python functions take no names with dots
    schema = f"{', '.join(f'{c} {f.dataType.simpleString()}' for c, f in zip(plain, docs.schema))}, n_found int, kinds string, found array<struct<kind:string,start:int,length:int>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _FEISTELS.setdefault(key, Feistel(key))
        for batch in batches:
            texts, counts, kinds, spans = [], [], [], []
            for value in batch.column(at):
                text = value.as_py()
                new, found = pseudonymise(text, f) if text is not None else (None, [])
                texts.append(new)
                counts.append(len(found))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(Counter(x[0] for x in found).items())))
                spans.append([{"kind": k, "start": s, "length": n} for k, s, n in found])
            columns = [pa.array(texts, batch.schema.field(k).type) if k == at else batch.column(k) for k in range(len(names))]
            columns += [pa.array(counts, pa.int32()), pa.array(kinds, pa.string()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, [*plain, "n_found", "kinds", "found"])

    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*names, "n_found", "kinds", "found")
