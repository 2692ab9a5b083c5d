"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation of each format's values.

A value is found by its form, validated (check digits, calendar, ranges), read as a number within the set of valid values
of that form, permuted there, and written back in the form it had. So equal values get equal pseudonyms in all documents,
different ones different pseudonyms, and each pseudonym is itself valid.
"""

from __future__ import annotations

import datetime
import hashlib
import itertools
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
KINDS = ("email", "secret", "iban", "card", "phone", "ssn", "ip", "date")
#: The forms of personal data. Longer forms come first; each is validated afterwards.
FORMS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?@(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z])",
    "card": r"(?:(?<![0-9.+-])|(?<=[0-9]-))[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9-]|[./][0-9])",
}
_ANY = re.compile("|".join(f"(?P<{k}>{f})" for k, f in FORMS.items()))
_EACH = {k: re.compile(f) for k, f in FORMS.items()}
_LAST_OF_IBAN, _LAST_OF_CARD, _LATER_GROUP = re.compile(r"[A-Z0-9](?![0-9A-Za-z])"), re.compile(r"[0-9](?![0-9])"), re.compile(r"(?<=[ -])[0-9]")
#: How long each country's IBANs are (ISO 13616 registry).
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST LY",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: The groups that cards are written in.
CARD_GROUPS = {(13,), (14,), (15,), (16,), (19,), (4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)}


class Feistel:
    """Keyed permutations of 0 .. size - 1, one for each size and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def _round(self, value: int, tweak: str, i: int, size: int) -> int:
        stretched = hashlib.shake_256(self.key + f"{tweak}|{i}|{size}|{value}".encode()).digest(size.bit_length() // 8 + 9)
        return int.from_bytes(stretched, "big") % size

    def permute(self, value: int, size: int, tweak: str) -> int:
        """Two digits of a mixed radix are added to in turn; results outside the set are permuted again."""
        if size < 2:
            return value
        left = math.isqrt(size - 1) + 1
        radix = (left, -(-size // left))
        while True:
            a, b = divmod(value, radix[1])
            for i in range(ROUNDS):
                if i % 2:
                    b = (b + self._round(a, tweak, i, radix[1])) % radix[1]
                else:
                    a = (a + self._round(b, tweak, i, radix[0])) % radix[0]
            value = a * radix[1] + b
            if value < size:
                return value


def luhn(digits: str) -> int:
    """The digit that follows."""
    doubled = [int(c) * (2 - k % 2) for k, c in enumerate(reversed(digits))]
    return -sum(d - 9 * (d > 9) for d in doubled) % 10


def _refill(form: str, symbols: str) -> str:
    """form with its letters and digits replaced in turn."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in form)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(cipher: Feistel, symbols: str, tweak: str, classes: tuple[str, ...] = _CLASSES) -> str:
    """Each symbol stays within its class (digit, small letter, capital); together they are one number."""
    of = [next(c for c in classes if s in c) for s in symbols]
    value, size = 0, 1
    for s, c in zip(symbols, of, strict=True):
        value, size = value * len(c) + c.index(s), size * len(c)
    value = cipher.permute(value, size, tweak + ":" + ",".join(c[0] for c in of))
    out = []
    for c in reversed(of):
        value, k = divmod(value, len(c))
        out.append(c[k])
    return "".join(reversed(out))


def _symbols(text: str) -> str:
    return "".join(c for c in text if c.isalnum())


def _email(cipher: Feistel, found: str) -> str:
    return _refill(found, _by_class(cipher, _symbols(found), "email"))


def _secret(cipher: Feistel, found: str) -> str:
    """Capitals and small letters of one value get one pseudonym in their case; where both occur each symbol keeps its class."""
    if found != found.lower() and found != found.upper():
        return _by_class(cipher, found, "secret", ("0123456789", "abcdef", "ABCDEF"))
    new = _by_class(cipher, found.lower(), "secret", ("0123456789abcdef",))
    if found == found.lower():
        return new
    while new.isdigit():  # digits alone are the pseudonyms of small letters
        new = _by_class(cipher, new, "secret", ("0123456789abcdef",))
    return new.upper()


def _iban_rest(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _iban(cipher: Feistel, found: str) -> str | None:
    s = _symbols(found)
    country, check, account = s[:2], s[2:4], s[4:]
    if _iban_rest(country, account) != check:
        return None
    account = _by_class(cipher, account, "iban" + country)
    return _refill(found, country + _iban_rest(country, account) + account)


def _is_card(s: str) -> bool:
    return len(s) >= 13 and s[0] in "3456" and luhn(s[:-1]) == int(s[-1])


def _card(cipher: Feistel, found: str) -> str | None:
    s = _symbols(found)
    if not _is_card(s):
        return None
    body = s[0] + f"{cipher.permute(int(s[1:-1]), 10 ** (len(s) - 2), f'card{s[0]}{len(s)}'):0{len(s) - 2}d}"
    return _refill(found, body + str(luhn(body)))


def _phone(cipher: Feistel, found: str) -> str:
    s = _symbols(found)[1:]
    if s[0] < "2" or s[3] < "2":
        # not in use as an area or office, but of the form: these are permuted among themselves
        while True:
            s = f"{cipher.permute(int(s), 10**10, 'phone any'):010d}"
            if s[0] < "2" or s[3] < "2":
                return _refill(found, "1" + s)
    value = cipher.permute(((int(s[:3]) - 200) * 800 + int(s[3:6]) - 200) * 10_000 + int(s[6:]), 800 * 800 * 10_000, "phone")
    front, line = divmod(value, 10_000)
    area, office = divmod(front, 800)
    return _refill(found, f"1{area + 200}{office + 200}{line:04d}")


def _ssn(cipher: Feistel, found: str) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    value = cipher.permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
    front, serial = divmod(value, 9999)
    area, group = divmod(front, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(cipher: Feistel, found: str) -> str | None:
    parts = found.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = cipher.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(cipher: Feistel, found: str) -> str | None:
    iso = found[4] == "-"
    year, month, day = (found[:4], found[5:7], found[8:]) if iso else (found[6:], found[3:5], found[:2])
    if not iso and found[2] == "/" and int(month) > 12:
        month, day = day, month  # the month comes first
    try:
        value = datetime.date(int(year), int(month), int(day)).toordinal() - DAYS[0]
    except ValueError:
        return None
    if not 0 <= value < DAYS[1] - DAYS[0]:
        return None
    d = datetime.date.fromordinal(DAYS[0] + cipher.permute(value, DAYS[1] - DAYS[0], "date"))
    first, second = (d.month, d.day) if not iso and month == found[:2] and day != month else (d.day, d.month)
    return d.isoformat() if iso else f"{first:02d}{found[2]}{second:02d}{found[5]}{d.year}"


_MAKERS: dict[str, Callable[[Feistel, str], str | None]] = {
    "email": _email, "secret": _secret, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date
}


def _ends(text: str, m: re.Match, last: re.Pattern) -> list[int]:
    """Where the groups of m end, the longest first; last: the last symbol of a group."""
    return [n.end() for n in itertools.takewhile(lambda n: n.end() <= m.end(), last.finditer(text, m.start()))][::-1]


def _iban_ends(text: str, m: re.Match) -> list[int]:
    """The known length of the country, then the whole; of other countries each length."""
    ends, known = _ends(text, m, _LAST_OF_IBAN), IBAN_LENGTHS.get(m.group()[:2])
    if known is None:
        return [e for e in ends if len(_symbols(text[m.start() : e])) >= 15]
    return [e for e in ends if len(_symbols(text[m.start() : e])) == known] + ends[:1]


def _card_ends(text: str, m: re.Match) -> list[int]:
    """Groups that cards are written in come first; others must not cut into such a card that begins later."""
    ends = [e for e in _ends(text, m, _LAST_OF_CARD) if _is_card(_symbols(text[m.start() : e]))]
    usual = [e for e in ends if _usual(text[m.start() : e])]
    if usual == ends:
        return ends
    begins = [n.start() for n in _LATER_GROUP.finditer(text, m.start() + 1, m.end())]
    runs = [n for n in (_EACH["card"].match(text, b) for b in begins) if n]
    taken = [n.start() for n in runs if any(_usual(text[n.start() : e]) and _is_card(_symbols(text[n.start() : e])) for e in _ends(text, n, _LAST_OF_CARD))]
    return usual + [e for e in ends if e not in usual and not any(b < e for b in taken)]


def _usual(found: str) -> bool:
    return tuple(map(len, re.split("[ -]", found))) in CARD_GROUPS


_SHORTER = {"iban": _iban_ends, "card": _card_ends}


def _at(text: str, m: re.Match, cipher: Feistel) -> tuple[str, int, str] | None:
    """Kind, end and pseudonym of the first value that passes its check at the place of m, whose kind comes first."""
    for kind in KINDS[KINDS.index(m.lastgroup) :]:
        own = _EACH[kind].match(text, m.start())
        for end in _SHORTER.get(kind, lambda t, o: [o.end()])(text, own) if own else ():
            if (new := _MAKERS[kind](cipher, text[m.start() : end])) is not None:
                return kind, end, new
    return None


def pseudonymise(text: str, cipher: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, begin, end) of what was found in the text as it was.

    Where a match fails its check, its shorter parts, the other forms and the places after its begin are tried in turn.
    """
    out, spans, done, pos = [], [], 0, 0
    while m := _ANY.search(text, pos):
        pos = m.start() + 1
        if (found := _at(text, m, cipher)) is not None:
            kind, pos, new = found
            out += [text[done : m.start()], new]
            spans.append((kind, m.start(), pos))
            done = pos
    return "".join([*out, text[done:]]) if spans else text, spans


def pseudonymise_texts(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and n_<kind> for every row of docs (doc_id, text; more columns are left out).

    A null text stays null and has nothing found; an empty one stays empty. Whole texts are read, whatever their length.
    Values that fail their validation (check digits, calendar) are left alone. Repeated rows each get a row, an empty table
    gives an empty result. Whoever has the key can undo the permutation, so it must be kept apart from the results.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ["n_found", *(f"n_{k}" for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cipher = Feistel(key.encode())
        for batch in batches:
            texts, found = [], {c: [] for c in counts}
            for text in batch.column("text"):
                new, spans = (None, []) if text.as_py() is None else pseudonymise(text.as_py(), cipher)
                texts.append(new)
                found["n_found"].append(len(spans))
                for k in KINDS:
                    found[f"n_{k}"].append(sum(s[0] == k for s in spans))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())} | {c: pa.array(v, pa.int64()) for c, v in found.items()})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, " + ", ".join(f"{c} long" for c in counts))
