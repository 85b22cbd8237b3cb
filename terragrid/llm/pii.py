"""Surrogates for personal data.

Detected entities get a replacement of the same type and format, made with a key: equal
entities (after a type's normalisation) get equal surrogates in all texts, and different ones
different surrogates. Every surrogate is a value of a keyed permutation (a Feistel network with cycle
walking) of the domain of its format, which leaves none in its place: digits of numbers, and
the letters of names, e-mail addresses and secrets, each among the letters of its script, case and kind
(vowel or consonant). A given name has one of its gender before it. A surrogate depends on the entity and the key alone,
never on the text. A pass over the corpus checks that no two entities share a surrogate.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

TYPES = ("email", "phone", "ip", "card", "ssn", "secret", "name")

# fixed values: names for surrogates by script and gender
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Elena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera", "Lucia", "Emma"),
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Robert", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Кирилл", "Олег", "Павел", "Роман"),
}
HONORIFICS = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "n", "Prof": "n", "г-н": "m", "г-жа": "f"}
HONORIFICS |= {"Mx": "n", "Sir": "m", "Lady": "f", "Lord": "m", "Mlle": "f", "Mademoiselle": "f", "Fräulein": "f", "Señorita": "f", "Srta": "f", "Professor": "n", "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: What secrets of known issuers begin with, longest first.
ISSUERS = ("sk-proj-", "glpat-", "xoxa-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "pk-")
#: Alphabets whose letters are told apart as vowels, signs and consonants.
ALPHABETS = (("a", "z"), ("а", "я"), ("α", "ω"))
VOWELS, SIGNS = "aeiouyаеиоуыэюяαεηιουω", "ъьς"
#: Country codes of one digit and of two; all others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")

_NAME = r"[^\W\d_a-zа-яß-öø-ÿ][^\W\d_]+"
PATTERNS = {
    "email": r"(?<![\w.+-])\w[\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9])",
    "secret": r"""(?<=[=:])\s*["'](?P<quoted>[A-Za-z0-9+/_\-]{16,})(?=["'])"""
    r"""|(?i:(?:key|token|secret|passwd|password|pwd))\s*[=:]\s*(?P<bare>(?=[A-Za-z+/_\-]*\d)(?=[\d+/_\-]*[A-Za-z])[A-Za-z0-9+/_\-]{16,})"""
    r"""|(?<![A-Za-z0-9_\-])(?P<issued>(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?:sk|pk)-[A-Za-z0-9_\-]{20,}|gh[opusr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9\-]{16,}|glpat-[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{35})""",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d])",
    "name": r"(?<!\w)(?:" + "|".join(HONORIFICS) + r")\.? " + _NAME + r"(?: " + _NAME + r")?",
}
_ALONE = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Cards as they are mostly written: in groups, with an issuer's first digits.
_USUAL = re.compile(r"(?<!\d)(?:[3-6]\d{3}|2[2-7]\d{2})([ -]?)(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{5})(?!\d)")
#: What every number that is an entity, and every secret without an issuer's beginning, has somewhere.
_NUMBER_HINT, _SECRET_HINT = re.compile(r"\d[\d .()\-]{6}"), re.compile(r"[=:]\s*[\"']?[A-Za-z0-9+/_\-]{16}")
_TITLES = [h for h in HONORIFICS if not any(o != h and o in h for o in HONORIFICS)]


def kinds_in(text: str) -> tuple[str, ...]:
    """The types that a text can have, in their order; a type that it leaves out has no match."""
    number = _NUMBER_HINT.search(text) is not None
    there = {
        "email": "@" in text,
        "secret": _SECRET_HINT.search(text) is not None or any(i in text for i in ISSUERS),
        "name": any(h in text for h in _TITLES),
    }
    return tuple(k for k in PATTERNS if there.get(k, number))


@functools.cache
def _scan(kinds: tuple[str, ...]) -> re.Pattern:
    """One scan: the first alternative that fits at a place wins."""
    return re.compile("|".join(f"(?P<{k}_>{PATTERNS[k]})" for k in kinds))


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def key_bytes(key: str) -> bytes:
    """A key of any length as 32 bytes."""
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def _keyed(key: bytes, *parts, bits: int = 128) -> int:
    """A number of so many bits: keyed BLAKE2b of the parts, with a counter where one digest is too short."""
    text = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    size = (bits + 7) // 8
    blocks = [hashlib.blake2b(text, key=key, salt=bytes([i]), digest_size=min(64, size - 64 * i)).digest() for i in range((size + 63) // 64)]
    return int.from_bytes(b"".join(blocks), "big") >> (8 * size - bits)


def permute(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed permutation of range(size): six Feistel rounds over the next even number of bits, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        left, right = value >> half, value & ((1 << half) - 1)
        for r in range(6):
            left, right = right, left ^ _keyed(key, label, r, right, bits=half)
        value = (left << half) | right
        if value < size:
            return value


def permute_all(key: bytes, label: str, value: int, size: int) -> int:
    """``permute`` without fixed points: a run of them and the value after it change places in a ring."""
    new = permute(key, label, value, size)
    if new == value:
        return permute(key, label, (value + 1) % size, size)
    first = value
    while permute(key, label, (first - 1) % size, size) == (first - 1) % size:
        first = (first - 1) % size
    return new if first == value else first


def _digits(found: str) -> str:
    """The digits of any script as 0 to 9."""
    return "".join(str(int(c)) for c in found if c.isdecimal())


def _digits_like(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(chr(ord(c) - int(c) + int(next(it))) if c.isdecimal() else c for c in form)


@functools.cache
def letters_like(ch: str) -> str:
    """What may stand for a lower-case letter or a digit: digits of its script; of an alphabet, its vowels, signs or
    consonants; else the letters of its script and case in its block of 256. "" for what stays as it is."""
    if ch.isdecimal():
        return "".join(chr(ord(ch) - int(ch) + i) for i in range(10))
    if not ch.isalpha():
        return ""
    kind = lambda c: "v" if c in VOWELS else "s" if c in SIGNS else "c"
    for first, last in ALPHABETS:
        if first <= ch <= last:
            return "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if kind(c) == kind(ch))
    script = lambda c: (unicodedata.category(c), unicodedata.name(c, "").split(" ")[0])
    core = lambda c: any(a <= c <= b for a, b in ALPHABETS)
    stable = lambda c: c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c and c.isalpha()
    block = ord(ch) & ~255
    same = [c for c in map(chr, range(block, block + 256)) if script(c) == script(ch) and not core(c) and stable(c)]
    return "".join(same) if ch in same else ""


def reformed(key: bytes, label: str, text: str, sets: list[str]) -> str:
    """A keyed permutation, without fixed points, of all texts whose letters come from the same sets; "" keeps a letter."""
    value, size = 0, 1
    for ch, s in zip(text, sets):
        if s:
            value, size = value * len(s) + s.index(ch), size * len(s)
    if size < 2:
        return text
    value = permute_all(key, "\0".join([label, *(s or ch for ch, s in zip(text, sets))]), value, size)
    out = []
    for ch, s in zip(reversed(text), reversed(sets)):
        if s:
            value, at = divmod(value, len(s))
            ch = s[at]
        out.append(ch)
    return "".join(reversed(out))


def reformed_word(key: bytes, label: str, word: str) -> str:
    """A word of the same scripts and form; upper case stays where it was."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
    new = reformed(key, label, low, [letters_like(c) for c in low])
    return "".join(n.upper() if c != l else n for n, c, l in zip(new, word, low))


def family_name(key: bytes, word: str) -> str:
    """The word's letters permuted, behind a keyed pair of its script: longer than the word, so that it is seldom another's real name."""
    low = word.lower()
    span = next(("".join(map(chr, range(ord(a), ord(b) + 1))) for a, b in ALPHABETS if a <= low[0] <= b), "")
    sets = ("".join(c for c in span if c not in VOWELS + SIGNS), "".join(c for c in span if c in VOWELS)) if span else (letters_like(low[0]),) * 2
    n = _keyed(key, "pair", low)
    pair = "".join(s[(n >> (16 * i)) % len(s)] for i, s in enumerate(sets) if s)
    new = reformed_word(key, "family", word)
    return (pair + new.lower()).capitalize() if pair and word[1:] == low[1:] else pair.upper() + new


def _secret_form(text: str) -> tuple[str, bool]:
    """Issuer's beginning, and whether the rest is of hexadecimal digits."""
    begin = next((i for i in ISSUERS if text.startswith(i)), "")
    return begin, re.fullmatch(r"[0-9a-f]+", text[len(begin) :]) is not None


@functools.lru_cache(1 << 16)
def surrogate(kind: str, found: str, key: bytes) -> str:
    """The replacement of an entity."""
    label = kind
    if kind == "email":
        return reformed_word(key, label, found.lower()) + ".invalid"
    digits = _digits(found)
    if kind == "ip":
        n = permute_all(key, label, int.from_bytes(bytes(map(int, found.split("."))), "big"), 1 << 32)
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "card":
        body = f"{permute_all(key, f'{label}{len(digits)}', int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
        check = next(c for c in "0123456789" if luhn(body + c))
        return _digits_like(found, body + check)
    if kind == "ssn":
        return _digits_like(found, f"{permute_all(key, label, int(digits), 10**9):09d}")
    if kind == "phone":
        code = COUNTRY.match(digits).end() if found[0] == "+" else 0
        rest = digits[code:]
        return _digits_like(found, digits[:code] + f"{permute_all(key, f'{label}{digits[:code]}/{len(rest)}', int(rest), 10 ** len(rest)):0{len(rest)}d}")
    if kind == "secret":
        begin, hexa = form = _secret_form(found)
        classes = ("0123456789abcdef",) if hexa else (string.ascii_uppercase, string.ascii_lowercase, string.digits)
        sets = ["" if i < len(begin) else next((s for s in classes if c in s), "") for i, c in enumerate(found)]
        new = reformed(key, label, found, sets)
        while _secret_form(new) != form:  # walked until it is of the same form, as others of it are
            new = reformed(key, label, new, sets)
        return new
    title, _, name = found.partition(" ")
    words = name.split(" ")
    out = [family_name(key, words[-1])]
    if len(words) > 1:
        gender = HONORIFICS[title.rstrip(".")]
        gender = gender if gender != "n" else "fm"[_keyed(key, "gender", words[0].lower()) & 1]
        given = GIVEN.get(("cyrillic" if re.search("[А-яЁё]", name) else "latin" if words[0].isascii() or re.search("[A-Za-z]", name) else "", gender), ())
        own = reformed_word(key, "given", words[0])
        out.insert(0, f"{given[_keyed(key, 'given', words[0].lower()) % len(given)]}-{own}" if given else own)
    return f"{title} {' '.join(out)}"


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 for x in found.split("."))
    if kind == "card":
        digits = re.sub(r"\D", "", found)
        return luhn(digits) and int(digits) > 0
    if kind == "phone":
        return 7 <= len(re.sub(r"\D", "", found)) <= 15
    return True


def identity(kind: str, found: str) -> str:
    """Spellings with one identity refer to the same entity."""
    if kind in ("phone", "card", "ssn"):
        return "+" * (found[0] == "+") + _digits(found)
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "name":
        title, _, name = found.partition(" ")
        return f"{HONORIFICS[title.rstrip('.')]} {name.lower()}"
    return found.lower() if kind == "email" else found


def _span(kind: str, m: re.Match) -> tuple[int, int]:
    return m.span(next(g for g in ("quoted", "bare", "issued") if m[g])) if kind == "secret" else m.span()


def _others(text: str, start: int):
    """(kind, start, end) of what else fits at a place: each type's own match, and for cards and
    phone numbers each shorter one that ends with a run of digits, longest first."""
    for kind, pattern in _ALONE.items():
        m = pattern.match(text, start)
        if not m:
            continue
        yield kind, *_span(kind, m)
        if kind in ("card", "phone"):
            for end in range(m.end() - 1, start, -1):
                # what follows is no digit, as the patterns ask; beyond the end they see nothing
                if text[end - 1].isdecimal() and not text[end].isdecimal() and pattern.fullmatch(text, start, end):
                    yield kind, start, end


def _fits(text: str, kind: str, start: int, end: int) -> bool:
    """Valid, and no number before a card that fits with the card's first digits alone."""
    found = text[start:end]
    if not _valid(kind, found):
        return False
    if kind != "card" or _USUAL.fullmatch(found):
        return True
    later = (_USUAL.match(text, i) for i in range(start + 1, end))
    return not any(m and m.end() > end and _valid(kind, m[0]) for m in later)


def entities(text: str):
    """(kind, start, end) of entities from left to right. Where the scan's match doesn't fit, the
    others at its place are tried, and then the scan goes on from the next character."""
    kinds = kinds_in(text)
    if not kinds:
        return
    at, scan = 0, _scan(kinds)
    while m := scan.search(text, at):
        kind = next(k for k in kinds if m[f"{k}_"] is not None)
        start, end = _span(kind, m)
        if not _fits(text, kind, start, end):
            kind, start, end = next((o for o in _others(text, m.start()) if _fits(text, *o)), (None, 0, 0))
        if kind:
            yield kind, start, end
        at = end if kind else m.start() + 1


def replace_entities(text: str, key: bytes) -> tuple[str, dict[str, int], int]:
    """The text with surrogates, entities by type, and how many different ones."""
    out, at, counts = [], 0, {}
    seen: set[tuple[str, str]] = set()
    for kind, start, end in entities(text):
        found = text[start:end]
        seen.add((kind, identity(kind, found)))
        counts[kind] = counts.get(kind, 0) + 1
        out += (text[at:start], surrogate(kind, found, key))
        at = end
    out.append(text[at:])
    return "".join(out), counts, len(seen)


def _entity_rows(df: DataFrame, key: str, text_col: str) -> DataFrame:
    secret = key_bytes(key)
    digest = lambda kind, found: hashlib.blake2b(f"{kind}\0{identity(kind, found)}".encode("utf-8", "surrogatepass"), key=secret, digest_size=16).digest()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                seen = {}
                for t in b.column(0).slice(at, 512).to_pylist():
                    for kind, start, end in entities(t or ""):
                        seen[kind, t[start:end]] = None
                rows = [(kind, digest(kind, found), digest(kind, surrogate(kind, found, secret))) for kind, found in seen]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], names=["kind", "entity", "surrogate"])

    return df.select(text_col).mapInArrow(run, "kind string, entity binary, surrogate binary")


def entity_table(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, entity, surrogate): each different entity of the corpus once, both as keyed digests of their identities."""
    return _entity_rows(df, key, text_col).distinct()


def collisions(table: DataFrame) -> DataFrame:
    """(kind, what): "shared" for a surrogate that several entities have, "split" for an entity that has several, of rows
    (kind, entity, surrogate), repeated or not. Rows are added up before the one shuffle."""
    side = lambda what, a, b: F.struct(F.lit(what).alias("what"), F.col(a).alias("key"), F.col(b).alias("other"))
    both = table.select("kind", F.explode(F.array(side("shared", "surrogate", "entity"), side("split", "entity", "surrogate"))).alias("s"))
    return both.groupBy("kind", "s.what", "s.key").agg(F.min("s.other").alias("a"), F.max("s.other").alias("b")).where("a <> b").select("kind", "what")


def surrogates(df: DataFrame, key: str, text_col: str = "text", carry: list[str] | None = None, check: bool = True) -> DataFrame:
    """The columns of ``df`` (or those in ``carry``) with the text replaced, n_entities,
    n_distinct and n_<type> (long).

    One row for each row, repeated ones too. A null text stays null, an empty one empty; a text without entities is
    unchanged, one of any length is scanned whole. Columns named like an added one are replaced. ``check``: a pass before
    this one compares all entities of the corpus, and raises ValueError if two share a surrogate or one has two.
    """
    if check and (bad := collisions(_entity_rows(df, key, text_col)).limit(1).collect()):
        raise ValueError(f"surrogates of kind {bad[0]['kind']} are {bad[0]['what']}")
    secret = key_bytes(key)
    added = ["n_entities", "n_distinct", *(f"n_{t}" for t in TYPES)]
    carry = [c for c in (df.columns if carry is None else carry) if c not in (text_col, *added)]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                done = [(None, {}, 0) if t is None else replace_entities(t, secret) for t in part.column(0).to_pylist()]
                texts = pa.array([d[0] for d in done], pa.string())
                nums = [[sum(d[1].values()) for d in done], [d[2] for d in done], *[[d[1].get(t, 0) for d in done] for t in TYPES]]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], texts, *[pa.array(n, pa.int64()) for n in nums]], names=[*carry, text_col, *added])

    fields = [*[df.schema[c] for c in carry], StructField(text_col, df.schema[text_col].dataType), *StructType.fromDDL(", ".join(f"{c} long" for c in added)).fields]
    return df.select(F.col(text_col).alias("__text"), *carry).mapInArrow(run, StructType(fields))
