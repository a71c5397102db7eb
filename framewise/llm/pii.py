"""Format-preserving pseudonyms for personal data.

Every validated value is permuted inside its own format by a keyed Feistel network with cycle walking: a card
number becomes another card number with a right check digit, a date another date, an address another address.
The permutation depends on the key and the value only, so equal values stay equal across documents, and the
holder of the key can invert it.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framewise.llm.common import add_columns

ROUNDS = 8
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")

FOUND = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n_pii", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("pii_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)

#: Labels of secrets. After the first ones any value of some length counts, after the others one with a digit in it.
LABELS = r"(?:password|passwd|pwd|passphrase)"
OTHER_LABELS = r"(?:secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|access[_-]?token|client[_-]?secret)"
#: Prefixes by which issuers mark their tokens.
PREFIXES = ("AKIA", "ASIA", "gh[pousr]_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "xox[abprs]-", "AIza", "npm_", "hf_", "eyJ")

#: Patterns of the kinds, in the order in which they are tried, with a test of texts that can hold none of them.
#: Repeats without an end are of one set of characters and begin where no such character is before them, so that the
#: scan is linear in the text.
PATTERNS = [
    (r"(?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "@"),
    (
        rf"(?P<secret>(?<![\w-])(?:{'|'.join(PREFIXES)})(?=[A-Za-z_.-]*[0-9])[0-9A-Za-z_.-]{{15,}}(?<!\.)"
        rf"|(?i:{LABELS})[\"']?\s{{0,3}}(?:=\s{{0,3}}[\"']?(?P<given>[0-9A-Za-z_+/.~!@#$%^&*-]{{8,}})|:\s{{0,3}}[\"']?(?P<said>(?:(?=[A-Za-z_+/-]*[0-9])[0-9A-Za-z_+/-]{{8,}}|[0-9A-Za-z_+/-]{{12,}})))"
        rf"|(?i:{OTHER_LABELS})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?(?P<value>(?=[A-Za-z_+/.-]*[0-9])[0-9A-Za-z_+/.-]{{8,}}))",
        rf"(?i:{LABELS}|{OTHER_LABELS})|{'|'.join(PREFIXES)}",
    ),
    (
        r"(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
        r"|(?P<phone>(?<![\w.+])\+1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![\w])"
        r"|(?<![\w.+])\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)"
        r"|(?<![\w(])\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}(?!\w)"
        r"|(?<![\w.-])[2-9][0-9]{2}(?P<gap>[ .-])[2-9][0-9]{2}(?P=gap)[0-9]{4}(?![\w-])"
        r"|(?i:\b(?:phone|telephone|tel|mobile|cell|call|fax)\b)[.:]?\s{0,3}(?P<number>[2-9][0-9]{2}[2-9][0-9]{6})(?!\w))"
        r"|(?P<ssn>(?<![\w-])[0-9]{3}(?P<dash>[ -])[0-9]{2}(?P=dash)[0-9]{4}(?![\w-]))"
        r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9]))"
        r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])|(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]))"
        r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))",
        "[0-9]",
    ),
]
TESTS = [re.compile(test) for _, test in PATTERNS]


@functools.cache
def scanner(held: tuple[bool, ...]) -> re.Pattern:
    """One left-to-right scan for the patterns that a text can hold. Nothing begins behind a letter or digit."""
    return re.compile("(?<![A-Za-z0-9])(?:" + "|".join(p for (p, _), h in zip(PATTERNS, held, strict=True) if h) + ")")


#: Groups inside a kind that hold the value itself.
INNER = ("given", "said", "value", "number")

#: Issuer ranges of payment cards as (first digits from, to, numbers of digits).
ISSUERS = (
    (4, 4, (13, 16, 19)),
    (51, 55, (16,)),
    (2221, 2720, (16,)),
    (34, 34, (15,)),
    (37, 37, (15,)),
    (6011, 6011, (16, 19)),
    (644, 649, (16, 19)),
    (65, 65, (16, 19)),
    (62, 62, (16, 17, 18, 19)),
    (3528, 3589, (16, 17, 18, 19)),
    (300, 305, (14, 16, 19)),
    (36, 36, (14, 16, 19)),
    (38, 39, (14, 16, 19)),
)

FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def feistel(key: bytes, tweak: str, x: int, size: int, invert: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the next even number of bits, walked
    until it lands inside the range again."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def round_value(r: int, right: int) -> int:
        told = hashlib.blake2b(b"%d|%d|%d|" % (size, r, right) + tweak.encode(), key=key, digest_size=min(64, width + 8)).digest()
        return int.from_bytes(told, "big") & mask

    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if invert else range(ROUNDS):
            if invert:
                left, right = right ^ round_value(r, left), left
            else:
                left, right = right, left ^ round_value(r, right)
        x = left << half | right
        if x < size:
            return x


#: Characters that are permuted as one number; a longer value is permuted part by part.
PART = 64
HEX_UPPER, HEX_LOWER = "ABCDEF", "abcdef"


def permute_chars(key: bytes, tweak: str, value: str, invert: bool = False, kinds: tuple[str, ...] = (DIGITS, UPPER, LOWER)) -> str:
    """Digits, capitals and small letters change within their kind; every other character stays."""
    if len(value) > PART:
        return "".join(permute_chars(key, f"{tweak}|{a}/{len(value)}", value[a : a + PART], invert, kinds) for a in range(0, len(value), PART))
    alphabets = [next((a for a in kinds if c in a), c) for c in value]
    size, x = 1, 0
    for c, a in zip(value, alphabets, strict=True):
        size, x = size * len(a), x * len(a) + a.index(c)
    shape = "".join({DIGITS: "9", UPPER: "A", LOWER: "a", HEX_UPPER: "F", HEX_LOWER: "f"}.get(a, a) for a in alphabets)
    x = feistel(key, f"{tweak}|{shape}", x, size, invert)
    out = []
    for a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def refill(template: str, chars: str) -> str:
    """``template`` with its letters and digits replaced, in order, by ``chars``."""
    left = iter(chars)
    return "".join(next(left) if c.isalnum() else c for c in template)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        n = int(c) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{body}{country}00"))
    return f"{98 - number % 97:02d}"


def issuer(digits: str) -> int:
    """How many first digits name the card's issuer; 0 if none does."""
    for low, high, sizes in ISSUERS:
        n = len(str(low))
        if len(digits) in sizes and low <= int(digits[:n]) <= high:
            return n
    return 0


def card(key, value, invert):
    digits = re.sub(r"\D", "", value)
    kept = issuer(digits)
    if not kept or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[:kept] + permute_chars(key, f"card{digits[:kept]}", digits[kept:-1], invert)
    return refill(value, body + luhn_digit(body))


def iban(key, value, invert):
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    body = permute_chars(key, f"iban{plain[:2]}", plain[4:], invert)
    return refill(value, plain[:2] + iban_check(plain[:2], body) + body)


def ssn(key, value, invert):
    area, group, serial = (int(x) for x in re.split("[ -]", value))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = area - 1 - (area > 666)
    x = feistel(key, "ssn", (place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, invert)
    x, serial = divmod(x, 9999)
    place, group = divmod(x, 99)
    return refill(value, f"{place + 1 + (place >= 665):03d}{group + 1:02d}{serial + 1:04d}")


def phone(key, value, invert):
    digits = re.sub(r"\D", "", value)
    if value.startswith("+") and not value.startswith("+1"):
        if not 8 <= len(digits) <= 15:
            return None
        return refill(value, digits[:2] + permute_chars(key, f"phone{digits[:2]}", digits[2:], invert))
    head, body = digits[:-10], digits[-10:]
    if len(digits) not in (10, 11):
        return None
    x = ((int(body[:3]) - 200) * 800 + int(body[3:6]) - 200) * 10000 + int(body[6:])
    x, line = divmod(feistel(key, "phone", x, 800 * 800 * 10000, invert), 10000)
    area, exchange = divmod(x, 800)
    return refill(value, f"{head}{area + 200}{exchange + 200}{line:04d}")


def ip(key, value, invert):
    if ":" in value:
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return None
        if value.count(":") < 3 or not re.search("[0-9]", value):
            return None
        return permute_chars(key, "ip6", value, invert, (DIGITS, HEX_UPPER, HEX_LOWER))
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    x = feistel(key, "ip", int.from_bytes(bytes(parts), "big"), 1 << 32, invert)
    return ".".join(map(str, x.to_bytes(4, "big")))


def date(key, value, invert):
    if value[4] == "-":
        orders, between = [(0, 1, 2)], "-"
    elif value[2] == ".":
        orders, between = [(2, 1, 0)], "."
    else:
        orders, between = [(2, 1, 0), (2, 0, 1)], "/"
    parts = [int(x) for x in value.split(between)]
    for order in orders:
        try:
            day = dt.date(*[parts[k] for k in order]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # A day above 12 tells which order is meant; both orders stay inside days 1-12 otherwise.
        if len(orders) == 2:
            sure = max(parts[:2]) > 12
            fits = [d for d in _slash_days(sure)]
        else:
            fits = None
        if fits is None:
            new = dt.date.fromordinal(FIRST_DAY + feistel(key, "date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, invert))
        else:
            new = dt.date.fromordinal(fits[feistel(key, f"date/{sure}", _place(sure)[day], len(fits), invert)])
        out = [0, 0, 0]
        for k, n in zip(order, (new.year, new.month, new.day), strict=True):
            out[k] = n
        return between.join(f"{n:04d}" if k == order[0] else f"{n:02d}" for k, n in enumerate(out))
    return None


@functools.cache
def _slash_days(sure: bool) -> list[int]:
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if (dt.date.fromordinal(d).day > 12) == sure]


@functools.cache
def _place(sure: bool) -> dict[int, int]:
    return {d: k for k, d in enumerate(_slash_days(sure))}


def email(key, value, invert):
    local, _, domain = value.rpartition("@")
    if ".." in local or local.endswith(".") or not any(c.isalnum() for c in local):
        return None
    return f"{permute_chars(key, 'email', local, invert)}@{domain}"


MARKED = re.compile("|".join(f"(?:{p})" for p in PREFIXES))


def secret(key, value, invert):
    head = MARKED.match(value)
    head = head.group() if head and len(value) >= len(head.group()) + 15 else ""
    return head + permute_chars(key, f"secret{head}", value[len(head) :], invert)


PERMUTE = {"email": email, "secret": secret, "iban": iban, "card": card, "ssn": ssn, "phone": phone, "ip": ip, "date": date}


def pseudonym(key: bytes, kind: str, value: str, invert: bool = False) -> str | None:
    """The value's pseudonym in the same format; None if the value isn't valid for its kind."""
    return PERMUTE[kind](key, value, invert)


#: Kinds whose match may have run on into the number or word beside the value.
RUNS_ON = ("card", "iban", "phone")
SEPARATOR = re.compile(r"(?<=[0-9A-Za-z)])[ .-]")


def replace(key: bytes, text: str, memo, invert: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and (kind, start, end) of each in the original.

    A match that fails validation is read again without its last token, the last two and so on; if no reading is
    valid, the scan goes on one character later, so at the next token inside the match. A pseudonym beside a
    number can by chance be valid together with it; inverting such a text then reads the longer value.
    """
    out, spans, at, since = [], [], 0, 0
    held = tuple(test.search(text) is not None for test in TESTS)
    scan = scanner(held)
    while any(held) and (m := scan.search(text, at)):
        found = m.groupdict()
        kind = next(k for k in KINDS if found.get(k) is not None)
        start, end = next((m.span(g) for g in INNER if found.get(g) is not None), m.span())
        ends = [end]
        if kind in RUNS_ON:
            ends += [x.start() for x in SEPARATOR.finditer(text, start, end)][::-1]
        for end in ends:
            new = memo(kind, text[start:end]) if not invert else pseudonym(key, kind, text[start:end], True)
            if new is not None:
                break
        else:
            at = m.start() + 1
            continue
        out += [text[since:start], new]
        spans.append((kind, start, end))
        at = since = end
    return "".join([*out, text[since:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with the text pseudonymised: text, n_pii, a count for each kind and pii_spans
    (character offsets [start, end) in the original).

    A null text stays null with counts of 0; an empty one stays empty. Values that fail validation (wrong check
    digits, no issuer's first digits, impossible dates, octets above 255) stay as they are, as does every other
    character; an address's domain and a token's or card issuer's mark are kept. Values have no longest size: a secret
    is replaced to its end. A very long text is scanned once, from its beginning to its end. Rows are independent:
    repeated rows give equal results, null keys are kept, and an empty table gives an empty one. No shuffle.
    """

    def make():
        @functools.lru_cache(1 << 16)
        def memo(kind, value):
            return pseudonym(key, kind, value)

        may = np.zeros(256, bool)
        may[[*range(48, 58), *b"@=:"]] = True

        def work(column):
            texts, counts, places = [], [], []
            for value in column.to_pylist():
                spans: list = []
                if value and may[np.frombuffer(value.encode(), np.uint8)].any():
                    value, spans = replace(key, value, memo)
                texts.append(value)
                counts.append([sum(k == kind for k, _, _ in spans) for kind in KINDS] if spans else [0] * len(KINDS))
                places.append([[a, b] for _, a, b in spans])
            table = np.array(counts, np.int64).reshape(len(counts), len(KINDS))
            return [pa.array(texts, pa.string()), pa.array(table.sum(1)), *[pa.array(table[:, k]) for k in range(len(KINDS))], pa.array(places, pa.list_(pa.list_(pa.int64())))]

        return work

    return add_columns(docs, text, keep, FOUND, make)
