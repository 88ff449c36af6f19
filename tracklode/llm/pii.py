"""Personal data replaced by format-preserving pseudonyms.

Each find is permuted by a keyed Feistel network within its own format, so a value
gets the same pseudonym in every document and stays linked, and different values of
one format get different pseudonyms:

* payment cards: 13 to 19 digits, parted as written, that pass the Luhn check, also
  among other digits that only a space or hyphen parts from them; all digits but the
  last are permuted and the last is made to pass again;
* IBANs with valid check digits, also next to other capitals and digits: the rest is
  permuted letter by letter class, and the check digits are made valid again;
* US social security numbers and NANP telephone numbers (with or without +1), other
  international numbers led by + and national ones led by 0: digits are permuted;
* dates (year, month, day; day, month, year; month, day, year; parted by - . or /) that exist
  between 1900 and 2099: the day's number in that range is permuted, the form stays.
  Days beyond the twelfth stay beyond it, so that a day can't be taken for a month;
* IPv4 addresses, but not after a word for a version: the 32-bit number is permuted;
* e-mail addresses: local part and domain, but for its last label, are permuted by
  letters and digits of any script, each on its own, so one domain stays one domain;
* secrets (a name that ends in key, token, password, secret set to a value; quoted
  hexadecimal strings of 32 digits or more): permuted by letters and digits.

Digits are drawn mixed-radix, so the permutation covers all of a format; where a
format has forbidden values the network is walked on until the value is allowed.
Letters beyond ASCII are permuted among those of their kind and block of 256.
Pseudonyms never depend on the document.  A map: no shuffle, no state.

The key comes from ``KEY_CONF``, or is drawn once for the session: without the key
nobody inverts the pseudonyms, and with the same key later runs link to earlier ones.

Cases: a null text stays null with no finds; an empty text stays empty; a very long
text is one row, read in time proportional to it; overlapping finds go to the one that
starts first, then to the order of ``KINDS``; text without finds is returned unchanged;
repeated rows are treated alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
#: Names the key; "secret" in it keeps it out of Spark's listings.
KEY_CONF = "spark.tracklode.pii.secret"
FIRST_DAY = datetime.date(1900, 1, 1)
DAYS = (datetime.date(2100, 1, 1) - FIRST_DAY).days
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: What numbers look like; each pattern starts with a character that prose seldom has.
NUMBERS = {
    "ipv4": re.compile(r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\d|\.\d)"),
    "date": re.compile(r"(?<![\d./-])[0-9](?:[0-9]{3}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]?([./-])[0-9]{1,2}\2[0-9]{4})(?![\d/-]|\.\d)"),
    "ssn": re.compile(r"(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\d|-\d)"),
    "phone": re.compile(
        r"(?<![\d+])[0-9(+](?:(?<=\+)1[ .-]?|(?<=1)[ .-]?)?(?:(?<=\()|\()?[0-9]{2,3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?!\d|-\d)"
        r"|(?<![\d+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\d|-\d)"
        r"|(?<![\d+./-])(?<!\d )(?:\(0[1-9][0-9]{1,3}\) ?|0[1-9][0-9]{1,3}[ /-])[0-9]{3,4}[ -]?[0-9]{3,5}(?! ?\d|[/-]|\.\d)"
    ),
}
#: Digits that at most a space or hyphen parts, long enough to hold a card.
RUN = re.compile(r"(?<!\d)[0-9](?:[ -]?[0-9]){12,}")
GROUP = re.compile("[0-9]+")
#: How cards are parted mostly; of several numbers that pass, these go first.
USUAL = frozenset({(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (6, 13), *((n,) for n in range(13, 20))})
#: From each place where an IBAN may start, the most that can be one.
IBAN = re.compile(r"\b(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b))")
#: IBAN lengths by country.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18"
    " GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15"
    " OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
SETS = re.compile("[:=]")
#: What the name of a secret ends in, as a word of its own.
NAME = re.compile(r"(?:\A|[_-])(?:api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|secret|token|passwd|password|pwd)\Z", re.I)
VALUE = re.compile(r"[ \t]*(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})")
VERSION = re.compile(r"\b(?:v|ver|version|release|build|firmware)\.? ?\Z", re.I)
HEX = re.compile(r"(?<=[\"'])[0-9a-fA-F]{32,}(?=[\"'])")
KINDS = ("email", "secret", "iban", "ipv4", "date", "card", "ssn", "phone")


class Feistel:
    """Keyed permutations of numbers below any size."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def noise(self, label: str, i: int, value: int, size: int) -> int:
        seed = f"{label}|{i}|{value}".encode()
        out = hashlib.blake2b(seed, key=self.key[:64], digest_size=16 + (size.bit_length() + 7) // 8).digest()
        return int.from_bytes(out, "big") % size

    def pair(self, label: str, a: int, b: int, na: int, nb: int) -> tuple[int, int]:
        """A permutation of the pairs (a < na, b < nb)."""
        for i in range(ROUNDS):
            if i % 2 == 0:
                a = (a + self.noise(label, i, b, na)) % na
            else:
                b = (b + self.noise(label, i, a, nb)) % nb
        return a, b

    def number(self, label: str, x: int, size: int) -> int:
        """A permutation of the numbers below ``size``; walks on past it."""
        side = 1
        while side * side < size:
            side *= 2
        if size < 2:
            return x
        while True:
            a, b = self.pair(f"{label}|{size}", x // side, x % side, side, side)
            x = a * side + b
            if x < size:
                return x

    def symbols(self, label: str, text: str) -> str:
        """Permutes ASCII digits and letters of ``text``, each within its kind and place."""
        sets = [(i, s) for i, c in enumerate(text) if (s := alphabet(c))]
        if not sets:
            return text
        form = "".join("9" if s[0] == "0" else s[0] for _, s in sets)
        half = (len(sets) + 1) // 2
        sizes, values = [], []
        for part in (sets[:half], sets[half:]):
            size, value = 1, 0
            for i, s in part:
                size, value = size * len(s), value * len(s) + s.index(text[i])
            sizes.append(size), values.append(value)
        mixed = self.pair(f"{label}|{form}", *values, *sizes)
        out = list(text)
        for part, value in zip((sets[:half], sets[half:]), mixed):
            for i, s in reversed(part):
                value, k = divmod(value, len(s))
                out[i] = s[k]
        return "".join(out)


@lru_cache(maxsize=1 << 16)
def alphabet(c: str) -> str:
    """What a character may become: ASCII by digits, small and capital letters, others by kind and block."""
    if "0" <= c <= "9":
        return "0123456789"
    if c.isascii():
        return LETTERS if "a" <= c <= "z" else LETTERS.upper() if "A" <= c <= "Z" else ""
    kind, block = unicodedata.category(c), ord(c) & ~0xFF
    if kind[0] != "L" and kind != "Nd":
        return ""
    return "".join(x for x in map(chr, range(max(block, 0x80), block + 0x100)) if unicodedata.category(x) == kind)


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def placed(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def is_card(digits: str) -> bool:
    return luhn(digits) and len(set(digits)) > 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the numbers that can be cards; none overlap.

    In a run of groups every number of 13 to 19 digits made of whole groups is
    tried.  Of those that pass, the usual forms go first, then the longest, then
    the first.
    """
    for m in RUN.finditer(text):
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        if m.start() and text[m.start() - 1] in ".-":
            groups = groups[1:]
        if text[m.end() : m.end() + 1] in (".", "-") and text[m.end() + 1 : m.end() + 2].isdigit():
            groups = groups[:-1]
        valid = []
        for i in range(len(groups)):
            digits, form = "", ()
            for a, b in groups[i:]:
                digits, form = digits + text[a:b], (*form, b - a)
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and is_card(digits):
                    valid.append((form not in USUAL, -len(digits), i, len(form)))
        taken: set[int] = set()
        for _, _, i, n in sorted(valid):
            if taken.isdisjoint(range(i, i + n)):
                taken.update(range(i, i + n))
                yield groups[i][0], groups[i + n - 1][1]


def card(text: str, f: Feistel) -> str | None:
    digits = "".join(c for c in text if c.isdigit())
    if not is_card(digits):
        return None
    body = str(f.number("card", int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    return placed(text, next(body + d for d in "0123456789" if luhn(body + d)))


def iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def is_iban(code: str) -> bool:
    return 15 <= len(code) <= 34 and iban_rest(code) == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the valid IBANs: by the country's length if that is valid, else the longest."""
    for m in IBAN.finditer(text):
        start, most = m.start(), m[1]
        ends = [i for i, c in enumerate(most) if c == " "] + [len(most)]
        wanted = IBAN_LENGTH.get(most[:2])
        for end in sorted(ends, key=lambda e: (len(most[:e].replace(" ", "")) != wanted, -e)):
            if is_iban(most[:end].replace(" ", "")):
                yield start, start + end
                break


def iban(text: str, f: Feistel) -> str | None:
    code = text.replace(" ", "")
    if not is_iban(code):
        return None
    body = f.symbols("iban|" + code[:2], code[4:])
    new = code[:2] + f"{98 - iban_rest(code[:2] + '00' + body):02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


def ipv4(text: str, f: Feistel) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.number("ipv4", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def day_number(y: str, m: str, d: str) -> int | None:
    try:
        day = (datetime.date(int(y), int(m), int(d)) - FIRST_DAY).days
    except ValueError:
        return None
    return day if 0 <= day < DAYS else None


def date(text: str, f: Feistel) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    # Year first; else by the mark, the other way if that is no date: 3/4/1990 is in March, 25/12/1990 in December.
    orders = ("ymd",) if len(parts[0]) == 4 else ("mdy", "dmy") if mark == "/" else ("dmy", "mdy")
    for order in orders:
        y, m, d = (parts[order.index(x)] for x in "ymd")
        if (day := day_number(y, m, d)) is not None:
            break
    else:
        return None
    late = int(d) > 12
    while True:  # walk on to a day of the same side
        day = f.number("date", day, DAYS)
        new = FIRST_DAY + datetime.timedelta(day)
        if (new.day > 12) == late:
            break
    wide = any(len(p) == 2 and p[0] == "0" for p in (m, d)) or len(m) == len(d) == 2
    told = {"y": f"{new.year:04d}", "m": f"{new.month:02d}" if wide else str(new.month), "d": f"{new.day:02d}" if wide else str(new.day)}
    return mark.join(told[x] for x in order)


def email(text: str, f: Feistel) -> str:
    local, _, domain = text.rpartition("@")
    name, _, last = domain.rpartition(".")
    return f"{f.symbols('email', local)}@{f.symbols('domain', name)}.{last}"


def secret(text: str, f: Feistel) -> str:
    m = re.search(r"[:=]\s*[\"']?", text)
    start = m.end() if m else 0
    return text[:start] + f.symbols("secret", text[start:])


def ssn(text: str, f: Feistel) -> str | None:
    if text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000":
        return None
    while True:  # walk on to an allowed number
        text = f.symbols("ssn", text)
        if not (text[:3] in ("000", "666") or text[0] == "9" or text[4:6] == "00" or text[7:] == "0000"):
            return text


def phone(text: str, f: Feistel) -> str | None:
    digits = sum(c.isdigit() for c in text)
    if not 7 <= digits <= 15:
        return None
    lead = re.match(r"\+?1[ .-]?(?=\(?\d{3})|\+\d{1,3}(?=[ .-])", text)
    start = lead.end() if lead else 0
    own = [c for c in text[start:] if c.isdigit()]
    # The subscriber's digits alone are permuted, so ways of writing one number stay linked.
    return text[:start] + placed(text[start:], f.symbols("phone", "".join(own)))


MAKERS: dict[str, Callable[[str, Feistel], str | None]] = {
    "email": email, "secret": secret, "iban": iban, "ipv4": ipv4, "date": date, "card": card, "ssn": ssn, "phone": phone,
}


def back(text: str, at: int, ok: Callable[[str], bool]) -> int:
    """The start of the characters before ``at`` that are all ``ok``."""
    while at and ok(text[at - 1]):
        at -= 1
    return at


def finds(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of all that looks like a kind; finds may overlap."""
    at = text.find("@")
    while at >= 0:
        local = back(text, at, lambda c: c.isalnum() or c in "_.+%-")
        while local < at and text[local] in ".-":
            local += 1
        domain = DOMAIN.match(text, at)
        if local < at and domain:
            yield local, domain.end(), "email"
        at = text.find("@", at + 1)
    for m in SETS.finditer(text):
        end = back(text, m.start(), lambda c: c in " \t")
        end -= text[end - 1 : end] in ("'", '"')
        start = back(text, end, lambda c: c.isascii() and (c.isalnum() or c in "_-"))
        if start < end and NAME.search(text[start:end]) and (value := VALUE.match(text, m.end())):
            yield start, value.end(), "secret"
    if DIGIT.search(text):
        for m in HEX.finditer(text):
            yield m.start(), m.end(), "secret"
        for start, end in ibans(text):
            yield start, end, "iban"
        for start, end in cards(text):
            yield start, end, "card"
        for kind, pattern in NUMBERS.items():
            for m in pattern.finditer(text):
                if kind != "ipv4" or not VERSION.search(text, max(0, m.start() - 12), m.start()):  # the longest such word and a space
                    yield m.start(), m.end(), kind


def pseudonymised(text: str | None, f: Feistel) -> tuple[str | None, Counter]:
    """The text with its finds replaced, and how many of each kind."""
    found: Counter = Counter()
    if not text:
        return text, found
    out, at = [], 0
    for start, end, kind in sorted(finds(text), key=lambda x: (x[0], KINDS.index(x[2]))):
        if start < at or (new := MAKERS[kind](text[start:end], f)) is None:
            continue  # taken already, or not valid as that kind
        found[kind] += 1
        out += [text[at:start], new]
        at = end
    return ("".join(out) + text[at:] if out else text), found


def session_key(spark: SparkSession) -> bytes:
    """The key that is set, or one drawn for this session."""
    held = spark.conf.get(KEY_CONF, None) or spark.sparkContext.getConf().get(KEY_CONF, None)
    if not held:
        held = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, held)
    return hashlib.blake2b(held.encode()).digest()


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text, n_found, n_<kind> for every kind."""
    added = ["n_found", *(f"n_{k}" for k in KINDS)]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), *(T.StructField(n, T.LongType()) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            done = [pseudonymised(t.as_py(), f) for t in batch.column(1)]
            counts = [[sum(c.values()) for _, c in done], *([c[k] for _, c in done] for k in KINDS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), *(pa.array(c, pa.int64()) for c in counts)], schema.names
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))


QUERIES = {"op4_pii": op4_pii}
ORACLE: dict[str, str] = {}
