"""Personal data and secrets replaced by keyed surrogates of the same type and format.

Numbers, addresses and secrets go through a keyed permutation of all values of their own format
(a Feistel network over the mixed-radix number that the letters and digits spell, walked on until
the result is valid again): digits stay digits, letters keep their case, separators stay, a card
number keeps its check digit valid, an IPv4 address stays one. A permutation never gives two
values the same surrogate, and the same value always gets the same one, in every document.

A secret is the whole run of non-blank characters behind its label, up to the closing quote if one
opens it, however long; closing punctuation at its end is not part of it. Its symbols and its letters
of other scripts are permuted too, brackets and separators stay. Long secrets are permuted in
pieces, each keyed by all pieces before it.

A valid IBAN gets valid check digits, a leading 0 or 1 of a phone number stays, and so does the start
that tells a token. Names are found behind a title or a label, and then wherever the name or a part of it stands in the
same document. Each part of a name has a surrogate of its own, so that "Mr. John Smith" and
"Mr. Smith" keep sharing a surname. It is spelled by a keyed code of the part alone, from syllables of
its script or, beyond Latin, Cyrillic and Greek, from the script's letters; the given name's ending
follows the gender that the titles in the document tell, once for all mentions of the name, and the
letter case follows the original. A part that the document also writes small ("Brown", "brown") is not
taken for a name where a sentence begins. Codes can collide, so every distinct entity of the corpus
is checked: if two values share a surrogate, or a value is its own surrogate, all surrogates are
drawn again with the next ``draw`` and longer codes, until none do.

Defined cases: null text stays null with no entities, empty text stays empty; rows that repeat are
replaced alike; overlapping matches go to the leftmost, then the longest; texts are searched whole.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import text_slices

_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)*"
#: Titles with the gender they tell: f, m or - for none.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "-", "Prof": "-", "Herr": "m", "Herrn": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sra": "f", "Sr": "m", "Dra": "f",
    "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f",
}
TITLES |= {title.upper(): gender for title, gender in TITLES.items()}
#: Beginnings that tell a token by themselves; they stay.
TOKEN_STARTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_")
_IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Vowel signs and accents that are characters of their own; they belong to the letter before them.
_MARKS = "".join(c for c in map(chr, range(0x300, 0xFE00)) if unicodedata.category(c) in ("Mn", "Mc"))
PATTERNS = {
    "email": rf"(?<![\w.+%{_MARKS}-])[^\W_][\w.%+{_MARKS}-]{{0,63}}@(?:[^\W_](?:(?:[^\W_]|[{_MARKS}-]){{0,61}}(?:[^\W_]|[{_MARKS}]))?\.){{1,8}}(?:xn--[A-Za-z0-9-]{{2,59}}|(?:[^\W\d_]|[{_MARKS}]){{2,24}})(?![\w{_MARKS}-])|(?<![\w.+%-])[^\W_][\w.%+-]{{0,63}}@localhost(?![\w.-])",
    "ipv4": rf"(?<![\w.]){_IPV4}(?!\w|\.\d)",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{{1,4}}:){{6}})(?:[0-9A-Fa-f]{{0,4}}:){{2,8}}(?:{_IPV4}|[0-9A-Fa-f]{{1,4}}|(?<=::))(?!\w|:[\w:]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w+.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,5}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?:\(0\d{1,4}\)[ /-]?|0\d{2,4}[ /-])\d{3,8}(?:[ -]?\d{2,5}){0,2})(?![\w-])",
    "access_key": r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)",
    "token": rf"(?<!\w)(?:{'|'.join(TOKEN_STARTS)})[A-Za-z0-9_-]{{16,255}}(?![\w-])",
    "secret": r"(?i:(?:(?<![^\W_])(?:password|passwd|pwd|token|secret|(?:api|access|private)[_-]?key)(?:[_-]\w{1,40})?\s{0,3}[:=]\s{0,3}|(?<!\w)bearer\s{1,3}(?=[\w.~+/=-]{16}))(?P<quote>[\"'])?)(?P<secret_value>\S{6})",
    "name": rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s(?:Dr\.?\s)?|(?i:(?:full |first |last )?name|nombre|nom)\s?[:=]\s?)(?P<name_value>{_NAME}(?:\s{_NAME}){{0,2}})|(?<!\w)(?i:(?:full |first |last )?name|nombre|nom)\s?[:=]\s?(?P<small_name>[^\W\d_]+(?:[ ][^\W\d_]+){{0,2}})(?=[ \t]*(?:[,;|\r\n]|\Z))",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
#: Heads and vowels of a script's syllables, and the endings of a given name by gender.
_SYLLABLES = {
    "LATIN": ("bdfgklmnprstvz", "aeiou", {"f": "ma", "m": "n"}),
    "CYRILLIC": ("бвгдзклмнпрстф", "аеиоу", {"f": "за", "m": "н"}),
    "GREEK": ("βγδζκλμνπρστφ", "αειοω", {"f": "κα", "m": "ς"}),
}
_HEX = re.compile("[0-9a-f:]+|[0-9A-F:]+")
#: The whole secret, by the quote that opens it.
_SECRET = {quote: re.compile(rf"[^\s{quote or ''}]+") for quote in (None, '"', "'")}
#: Symbols of a secret that are permuted; those that stay; and those that end a sentence or a bracket.
_SYMBOLS, _STAY, _CLOSERS = "!#$%&*?@\\^`|~", "+-_./=:,;()[]{}<>\"'", ".,;:)]}>\"'"
#: Characters of a secret that are permuted as one number.
_PIECE = 128
_SIGN = re.compile("[0-9@:=]")
#: Characters searched before and after a sign of an entity; longer than any pattern reaches.
_BEFORE, _AFTER = 100, 700


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _valid(kind: str, value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    if kind == "phone":
        return (9 if value.lstrip("(")[0] == "0" else 7) <= len(digits) <= 15
    if kind == "ipv6":
        return _is_ipv6(value)
    if kind == "secret":
        return len(value) >= 6 and bool(value.strip(_STAY))
    return True


def iban_valid(value: str) -> bool:
    return _iban_remainder(value) == 1


def _iban_remainder(value: str) -> int:
    plain = re.sub("[^0-9A-Za-z]", "", value)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _is_ipv6(value: str) -> bool:
    try:
        return isinstance(ipaddress.ip_address(value), ipaddress.IPv6Address) and value != "::"
    except ValueError:
        return False


def _is_short_ipv6(value: str) -> bool:
    return _is_ipv6(value) and ipaddress.IPv6Address(value).compressed == value


def _hex_digits(value: str) -> str:
    return "0123456789ABCDEF" if re.search("[A-F]", value) else "0123456789abcdef"


def _regions(text: str) -> list[list[int]]:
    """Stretches of the text around digits, signs and titles, outside of which nothing can match."""
    signs = [m.start() for m in _SIGN.finditer(text)]
    for word in (*TITLES, *TOKEN_STARTS, "AKIA", "ASIA", "earer ", "EARER "):
        at = text.find(word)
        while at >= 0:
            signs.append(at)
            at = text.find(word, at + len(word))
    regions: list[list[int]] = []
    for at in sorted(signs):
        if regions and at - _BEFORE <= regions[-1][1]:
            regions[-1][1] = at + _AFTER
        else:
            regions.append([max(0, at - _BEFORE), at + _AFTER])
    return regions


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """start, end, kind and gender ('' unless a name) of every entity, from left to right."""
    found, at = [], 0
    for low, high in _regions(text) if text else []:
        at = max(at, low)
        while m := _ANY.search(text, at, high):
            kind = m.lastgroup
            start, end = m.span({"secret": "secret_value", "name": "name_value" if m["name_value"] else "small_name"}.get(kind, kind))
            at = m.end()
            if kind == "secret":  # its end may lie behind the region
                whole = _SECRET[m["quote"]].match(text, start)
                end = start + len((whole[0] if whole else "").rstrip(_CLOSERS))
                at = max(start, end)
            if _valid(kind, text[start:end]):
                found.append((start, end, kind, TITLES.get(m["title"] or "", "-") if kind == "name" else ""))
            elif kind == "secret":
                at = start
            elif kind == "ipv6":
                at = start + 1
    return _with_mentions(text, found) if any(f[2] == "name" for f in found) else found


def _with_mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The entities with one gender for each name, and with the names' further mentions."""
    told: dict[str, set[str]] = {}  # genders of full names and of given names
    for start, end, kind, gender in found:
        name = text[start:end].lower().split() if kind == "name" else []
        if len(name) > 1:
            for key in (" ".join(name), name[0]):
                told.setdefault(key, set()).update({gender} - {"-"})

    def gender_of(value: str, own: str = "-") -> str:
        name = value.lower().split()
        given, full = told.get(name[0], set()), told.get(" ".join(name))
        if len(name) < 2:  # a given name alone keeps its ending
            return min(given).upper() if len(given) == 1 else own
        return min(full) if full else min(given) if len(given) == 1 else own

    values = {text[start:end] for start, end, kind, _ in found if kind == "name"}
    wanted = set()
    for value in values:
        for name in (value.split(), *([part] for part in value.split())):
            for form in (name, [p.upper() for p in name], [p.capitalize() for p in name] if value.isupper() else name):
                wanted.add(r"\s+".join(re.escape(p) if _unspaced(p) else rf"(?<!\w){re.escape(p)}(?!\w)" for p in form))
    mention = re.compile("|".join(sorted(wanted, key=lambda w: (-len(w), w))))
    small: dict[str, bool] = {}

    def is_name(m: re.Match) -> bool:
        word = m[0].lower()
        if len(word.split()) > 1 or word == m[0]:
            return True
        before = text[max(0, m.start() - 40) : m.start()].rstrip(" \t\"'(«“„‘")
        if before and before[-1] not in ".!?:…\r\n":
            return True
        if word not in small:
            small[word] = bool(re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text))
        return not small[word]

    out, at = [], 0
    for start, end, kind, gender in [*found, (len(text), len(text), "", "")]:
        out += [(*m.span(), "name", gender_of(m[0])) for m in mention.finditer(text, at, start) if is_name(m)]
        if kind:
            out.append((start, end, kind, gender_of(text[start:end], gender) if kind == "name" else gender))
        at = end
    return out


@lru_cache(1 << 12)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0].split("-")[0]


def _unspaced(part: str) -> bool:
    return _script(part[0]) in ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR")


@lru_cache(1 << 12)
def _likes(ch: str) -> str:
    """The characters that may stand for one of another script: of its category, from its 256 neighbours."""
    kind, first = unicodedata.category(ch), ord(ch) & ~255
    return "".join(c for c in map(chr, range(first, first + 256)) if ord(c) > 127 and unicodedata.category(c) == kind and not c.isspace())


class Surrogates:
    """Keyed replacement of values; ``draw`` picks one of many keyed mappings."""

    def __init__(self, key: str, draw: int = 0):
        self.key, self.draw = key, draw
        self._secret = hashlib.blake2b(f"{key}|{draw}".encode()).digest()
        self._short = lru_cache(1 << 16)(self._of)

    def of(self, kind: str, value: str, gender: str) -> str:
        return (self._short if len(value) <= 4 * _PIECE else self._of)(kind, value, gender)

    def _code(self, what: str, size: int = 16) -> int:
        digest = hashlib.blake2b(what.encode("utf-8", "replace"), key=self._secret, digest_size=min(size, 64)).digest()
        return int.from_bytes(digest if size <= 64 else hashlib.shake_256(self._secret + digest).digest(size), "big")

    def _permuted(self, x: int, n: int, tweak: str, holds: Callable[[int], bool]) -> int:
        """Image of ``x`` under a keyed permutation of the numbers below ``n`` for which ``holds``."""
        a = isqrt(n - 1) + 1
        size = max(32, a.bit_length() // 8 + 17)  # every digit of a half changes, however long it is
        while True:
            left, right = divmod(x, a)
            for r in range(4):
                left = (left + self._code(f"{tweak}|{r}|l|{right:x}", size)) % a
                right = (right + self._code(f"{tweak}|{r}|r|{left:x}", size)) % a
            x = left * a + right
            if x < n and holds(x):
                return x

    def _reshaped(self, value: str, tweak: str, holds: Callable[[str], bool] = lambda s: True,
                  fixed: Callable[[int], bool] = lambda i: False, loose: bool = False, hexadecimal: str = "", symbols: str = "", scripts: bool = False) -> str:
        """Permute ``value`` among all texts of its shape: character classes and separators stay.

        With ``loose`` the separators are no part of the shape, so one number written in two ways
        gets one surrogate written in the same two ways.
        """
        classes = (hexadecimal,) if hexadecimal else (
            "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", symbols)
        slots = [(i, next((c for c in classes if ch in c), _likes(ch) if scripts and ch > "\x7f" else "")) for i, ch in enumerate(value)]
        slots = [(i, c) for i, c in slots if c and not fixed(i)]
        taken = {i for i, _ in slots}
        rest = "".join(ch for i, ch in enumerate(value) if i not in taken and (ch.isalnum() or not loose))
        shape = "".join(f"{len(c)}{c[-1]}" for _, c in slots) + "|" + rest
        x, n = 0, 1
        for i, c in slots:
            x, n = x * len(c) + c.index(value[i]), n * len(c)

        def spelled(y: int) -> str:
            out = list(value)
            for i, c in reversed(slots):
                y, at = divmod(y, len(c))
                out[i] = c[at]
            return "".join(out)

        return spelled(self._permuted(x, n, f"{tweak}|{shape}", lambda y: holds(spelled(y))))

    def _email(self, value: str) -> str:
        local, host = value.rsplit("@", 1)
        *labels, top = host.split(".")
        return self._reshaped(local, f"local|{host.lower()}", scripts=True) + "@" + ".".join(
            [*(self._reshaped(x, "host", scripts=True) for x in labels), top])

    def _ipv4(self, value: str) -> str:
        x = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in value.split("."))))
        return str(ipaddress.IPv4Address(self._permuted(x, 1 << 32, "ipv4", lambda y: True)))

    def _ipv6(self, value: str) -> str:
        """An address by its shortest spelling, whose digits are permuted; one of few digits becomes any address."""
        address = ipaddress.IPv6Address(value)
        short = address.compressed
        if address.ipv4_mapped:
            new = self._ipv4(str(address.ipv4_mapped))
            return value[: value.rindex(":") + 1] + new if "." in value else f"::ffff:{new}"
        if sum(c.isalnum() for c in short) < 8:
            new = ipaddress.IPv6Address(self._permuted(int(address), 1 << 128, "ipv6", lambda y: True))
        else:
            new = ipaddress.IPv6Address(self._reshaped(short, "ipv6", _is_short_ipv6, hexadecimal="0123456789abcdef"))
        out = new.exploded if value.lower() == address.exploded else new.compressed
        return out.upper() if re.search("[A-F]", value) else out

    def _card(self, value: str) -> str:
        valid = luhn(re.sub(r"\D", "", value))
        return self._reshaped(value, f"card|{valid}", lambda s: luhn(re.sub(r"\D", "", s)) == valid, lambda i: i == 0, loose=True)

    def _phone(self, value: str) -> str:
        country = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        kept = country.end() if country else 0
        lead = next((i for i in range(kept, len(value)) if value[i].isdigit()), 0)
        real = value[lead] in "23456789"  # a leading 0 or 1 stays
        return self._reshaped(value, f"phone|{real}", lambda s: (s[lead] in "23456789") == real, lambda i: i < kept or i == lead and not real, loose=True)

    def _iban(self, value: str) -> str:
        """The country stays, and check digits that are right become right ones."""
        if not iban_valid(value):
            return self._reshaped(value, "iban", lambda s: not iban_valid(s), lambda i: i < 2, loose=True)
        bare = self._reshaped(value[:2] + "00" + value[4:], "iban|valid", fixed=lambda i: i < 4, loose=True)
        return f"{bare[:2]}{98 - _iban_remainder(bare):02d}{bare[4:]}"

    def _name(self, value: str, gender: str) -> str:
        """Surrogates of all parts; the first of several has the gender's ending, a single one if the gender is a capital."""
        parts = value.split()
        given = len(parts) > 1 or gender.isupper()
        return " ".join(self._name_part(p, gender.lower() if given and i == 0 else "") for i, p in enumerate(parts))

    def _name_part(self, part: str, gender: str) -> str:
        script, out = _script(part[0]), ""
        code = self._code(f"name|{part.lower()}")
        if script not in _SYLLABLES:
            letters = [c for c in _likes(part[0]) if _script(c) == script] or [part[0]]
            code = self._code(f"name|{part.lower()}", 2 * (len(part) + self.draw) + 16)
            for _ in range(len(part) + self.draw):
                code, at = divmod(code, len(letters))
                out += letters[at]
            return out.upper() if part.isupper() else out.capitalize()
        heads, vowels, endings = _SYLLABLES[script]
        for _ in range(3 + self.draw):
            code, h = divmod(code, len(heads))
            code, v = divmod(code, len(vowels))
            out += heads[h] + vowels[v]
        out += endings.get(gender, "")
        return out.upper() if part.isupper() else out.capitalize()

    def _hidden(self, value: str) -> str:
        hexadecimal = _hex_digits(value) if _HEX.fullmatch(value) else ""
        if len(value) <= _PIECE:
            if hexadecimal:
                return self._reshaped(value, "secret|hex", hexadecimal=hexadecimal)
            return self._reshaped(value, "secret", lambda s: not _HEX.fullmatch(s), symbols=_SYMBOLS, scripts=True)
        out, before = [], ""
        for start in range(0, len(value), _PIECE):
            piece = value[start : start + _PIECE]
            out.append(self._reshaped(piece, f"secret|{len(value)}|{hexadecimal}|{before}", hexadecimal=hexadecimal, symbols=_SYMBOLS, scripts=True))
            before = f"{self._code(f'{before}|{piece}'):x}"
        return "".join(out)

    def _of(self, kind: str, value: str, gender: str) -> str:
        if kind == "name":
            return self._name(value, gender)
        if kind == "access_key":
            return value[:4] + self._reshaped(value[4:], kind)
        if kind == "token":
            start = next(len(s) for s in TOKEN_STARTS if value.startswith(s))
            return value[:start] + self._reshaped(value[start:], f"token|{value[:start]}")
        if kind == "secret":
            return self._hidden(value)
        if kind in ("email", "ipv4", "ipv6", "iban", "card", "phone"):
            return {"email": self._email, "iban": self._iban, "ipv4": self._ipv4, "ipv6": self._ipv6, "card": self._card, "phone": self._phone}[kind](value)
        return self._reshaped(value, kind)

    def replace(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with every entity replaced, and the kinds replaced in order."""
        found = entities(text)
        if not found:
            return text, []
        out, at = [], 0
        for start, end, kind, gender in found:
            out += [text[at:start], self.of(kind, text[start:end], gender)]
            at = end
        return "".join([*out, text[at:]]), [f[2] for f in found]


def found_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct kind, value and gender of all entities of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            rows = {(k, t[a:b], g) for t in part.column("text").to_pylist() for a, b, k, g in entities(t)}
            kind, value, gender = zip(*sorted(rows)) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (kind, value, gender)], ["kind", "value", "gender"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "kind string, value string, gender string").distinct()


def with_surrogates(found: DataFrame, mapping: Surrogates) -> DataFrame:
    key, draw = mapping.key, mapping.draw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Surrogates(key, draw)
        for part in batches:
            kind, value, gender = (part.column(c).to_pylist() for c in ("kind", "value", "gender"))
            new = [m.of(*row) for row in zip(kind, value, gender)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(new, pa.string())], ["kind", "value", "gender", "surrogate"])

    return found.mapInArrow(run, "kind string, value string, gender string, surrogate string")


def _written_alike(kind: Column, value: Column) -> Column:
    """One spelling for all ways to write an entity."""
    return (F.when(kind == "ipv4", F.regexp_replace(value, r"(^|\.)0+(?=\d)", "$1"))
            .when(kind == "name", F.lower(F.regexp_replace(value, r"\s+", " ")))
            .when(kind.isin("phone", "card", "iban", "ssn"), F.regexp_replace(value, "[^0-9A-Za-z]", ""))
            .otherwise(value))


def collision_free(found: DataFrame, key: str, draws: int = 16) -> Surrogates:
    """The first mapping under which distinct entities stay distinct and none stays itself."""
    kind = F.col("kind")
    for draw in range(draws):
        mapping = Surrogates(key, draw)
        drawn = with_surrogates(found, mapping).select(
            "kind", _written_alike(kind, F.col("value")).alias("old"), _written_alike(kind, F.col("surrogate")).alias("new"))
        clash = drawn.groupBy("kind", "new").agg(F.min("old").alias("first"), F.max("old").alias("last"))
        if clash.filter((F.col("first") != F.col("last")) | (F.col("first") == F.col("new"))).isEmpty():
            return mapping
    raise RuntimeError(f"no collision-free surrogates in {draws} draws")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities and the kinds replaced, for every document."""
    mapping = collision_free(found_entities(docs, text_col), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Surrogates(mapping_key, mapping_draw)
        for part in text_slices(batches):
            texts, kinds = zip(*map(m.replace, part.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string()),
                "n_entities": pa.array(map(len, kinds), pa.int64()), "kinds": pa.array(kinds, pa.list_(pa.string()))})

    mapping_key, mapping_draw = mapping.key, mapping.draw
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return plain.mapInArrow(run, "doc_id long, text string, n_entities long, kinds array<string>")


def replace_in_place(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The same rows and columns, the text replaced."""
    mapping = collision_free(found_entities(docs, text_col), key)
    position = docs.columns.index(text_col)
    mapping_key, mapping_draw = mapping.key, mapping.draw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Surrogates(mapping_key, mapping_draw)
        for part in text_slices(batches):
            new = pa.array([m.replace(t)[0] for t in part.column(position).to_pylist()], pa.string())
            yield part.set_column(position, part.schema.field(position), new)

    return docs.mapInArrow(run, docs.schema)
