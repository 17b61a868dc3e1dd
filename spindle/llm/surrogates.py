"""Surrogates for personal data: keyed, of the same type and format, distinct and the same everywhere.

An entity is taken down to its *units*: an email, address or number without the
way it is written (case, separators), a name to its surname and, with a given name, the
person.  Each unit is replaced by a keyed bijection on strings of its shape (a
mixed-radix Feistel network: digits stay digits, letters stay letters of their script, and
what tells a type stays true: check digits of cards and IBANs, country codes,
private or public addresses), and the surrogate is written as the entity was.  So
"John Smith" and "Mr. Smith" share a surname, and a number has one surrogate however it is
written.  Given names come from a list of the gender and script that the title or the name tells.

The collision check is over the whole corpus: units whose surrogate is a unit
that is really there, another unit's surrogate, or the unit itself, are drawn again under
the next tweak, until none is left (addresses of private networks are only kept distinct).  Short names and emails may have fewer strings of their
shape than the corpus has units: after a few draws theirs get longer by a letter each.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import count
from math import prod

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import batch, lean, prepare, released, semi_by_id, stored

ROUNDS = 8
#: Draws in a unit's own shape; each later one of a name or email is a letter longer.
TRIES = 5
#: Draws after which what still collides is an error.
MOST = 60
#: Units that were drawn again go to every worker up to this many, else to the texts that hold them.
BROADCAST_UNITS = 100_000
#: Replacements that a worker remembers.
REMEMBERED = 1 << 16

# Titles, given names by gender and script, two-digit country codes of telephone numbers.
TITLES = {
    "mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "dr": "n", "prof": "n",
    "г-н": "m", "господин": "m", "г-жа": "f", "госпожа": "f", "доктор": "n", "κύριος": "m", "κυρία": "f",
}
HONORIFICS = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "さん": "n", "様": "n", "氏": "n"}
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "David", "Thomas", "Paul", "Peter", "Martin", "Daniel", "Simon", "Oscar"),
    "f": ("Mary", "Anna", "Laura", "Julia", "Sarah", "Emma", "Clara", "Maria", "Helen", "Alice", "Nora", "Elena"),
    "n": ("Alex", "Robin", "Sam", "Kim", "Chris", "Jordan", "Taylor", "Casey"),
}
GIVEN_CYRILLIC = {
    "m": ("Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Николай", "Андрей", "Павел"),
    "f": ("Анна", "Мария", "Ольга", "Елена", "Татьяна", "Наталья", "Ирина", "Вера"),
    "n": ("Саша", "Женя", "Валя", "Слава"),
}
GIVEN_GREEK = {"m": ("Γιώργος", "Νίκος", "Πέτρος", "Παύλος", "Ανδρέας"), "f": ("Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα"), "n": ("Άγγελος", "Φώτης")}
TWO_DIGIT_CODES = frozenset((20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58, 60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98))
#: Networks whose addresses stay among themselves (first address, bits of the rest).
NETWORKS = ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24), (0xA9FE0000, 16), (0x00000000, 24), (0x64400000, 22), (0xE0000000, 28), (0xF0000000, 28))

_KNOWN = {name.lower(): gender for lists in (GIVEN, GIVEN_CYRILLIC, GIVEN_GREEK) for gender, names in lists.items() for name in names}
_LATIN = [t for t in TITLES if t[0] < "Ͱ"]
_OTHER = [t for t in TITLES if t[0] >= "Ͱ"]
_any = lambda words: "|".join(sorted(words, key=len, reverse=True))
_TITLE = _any([t.capitalize() for t in _LATIN])
_OTHER_TITLE = _any([*_OTHER, *(t.capitalize() for t in _OTHER)])
_GIVEN = _any(n for lists in (GIVEN, GIVEN_CYRILLIC, GIVEN_GREEK) for names in lists.values() for n in names)
_extended = lambda kind: "".join(c for c in map(chr, range(0x100, 0x180)) if unicodedata.category(c) == kind)
_UP, _LOW = f"A-ZÀ-ÖØ-Þ{_extended('Lu')}", f"a-zß-öø-ÿ{_extended('Ll')}"
_NAME = f"(?:[{_UP}][{_LOW}]+(?:[-'][{_UP}][{_LOW}]+)?)"
_OTHER_NAME = "(?:[А-ЯЁЇІЄ][а-яёїіє]+|[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+)"
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
#: Detectors in order of precedence.
DETECTORS = {
    "email": rf"(?<![\w.+-])[^\W_][\w.+-]{{0,63}}@{_LABEL}(?:\.{_LABEL}){{0,6}}\.[^\W\d_]{{2,24}}(?![\w-])",
    "ip": r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w])|(?<![\w+])\+\d{8,15}(?!\w)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "name": rf"(?<!\w)(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?<!\w)(?:{_OTHER_TITLE})\.? {_OTHER_NAME}(?: {_OTHER_NAME})?|(?<!\w)(?:{_GIVEN}) (?:{_NAME}|{_OTHER_NAME})(?!\w)|[一-鿿]{{2,4}}?(?={_any(HONORIFICS)})",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in DETECTORS.items()))


@lru_cache(maxsize=1)
def needed() -> str:
    """A pattern in RE2's syntax that some part of every entity matches: each detector without what stands around it, and with fewer repeats.

    RE2 reads a text once, whatever the number of alternatives.  Its digits are those of Python's ``\\d``, listed.
    """
    digits = re.findall(r"\d+", "".join(map(chr, range(sys.maxunicode + 1))))
    listed = "".join(f"{x[0]}-{x[-1]}" for x in digits)
    d, other = f"[{listed}]", "А-ЯЁЇІЄΑ-ΩΆΈΉΊΌΎΏ"
    parts = {
        "email": r"@[^@\s.]+\.",
        "ip": rf"{d}\.{d}{{1,3}}\.{d}{{1,3}}\.{d}",
        "iban": rf"[A-Z]{{2}}{d}{{2}}(?: ?[A-Z0-9]{{4}}){{3}}",
        "ssn": rf"{d}{{3}}-{d}{{2}}-{d}{{4}}",
        "phone": rf"{d}{{3}}[ .-]{d}{{3}}|\+{d}{{8}}",
        "card": rf"{d}(?:[ -]?{d}){{12}}",
        "name": rf"(?:{_TITLE})\.? [{_UP}]|(?:{_OTHER_TITLE})\.? [{other}]|(?:{_GIVEN}) [{_UP}{other}]|[一-鿿](?:{_any(HONORIFICS)})",
    }
    return "|".join(parts[kind] for kind in DETECTORS)


# Alphabets of Latin, Cyrillic and Greek letters that stay among themselves, so that names can be spoken.
_SPOKEN = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ",
    "æøýÿ", "ðþ", "ÆØÝ", "ÐÞ", "āăąēĕėęěĩīĭįōŏőœũūŭůűų", "ćĉċčďđĝğġģĥħĵķĺļľłńņňŋŕŗřśŝşšţťŧŵźżž",
    "аеиоуыэюяёїіє", "бвгджзйклмнпрстфхцчшщ", "ьъ", "АЕИОУЭЮЯЁЇІЄ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αειουηω", "άέίόύήώ", "βγδζθκλμνξπρσςτφχψ", "ΑΕΙΟΥΗΩ", "ΆΈΊΌΎΉΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
_SPOKEN_OF = {c: a for a in _SPOKEN for c in a}


@lru_cache(maxsize=4096)
def _block(start: int, size: int, category: str) -> str:
    return "".join(c for c in map(chr, range(start, start + size)) if unicodedata.category(c) == category and c not in _SPOKEN_OF)


@lru_cache(maxsize=1 << 16)
def alphabet_of(c: str) -> str:
    """Characters that may stand for ``c``: of its kind, case and script; nothing for what is no letter or digit.

    Some letters have alphabets of their own; others stand for those of their case
    within 128 code points, Han characters and Hangul syllables for all of theirs.
    """
    if c in _SPOKEN_OF:
        return _SPOKEN_OF[c]
    kind, x = unicodedata.category(c), ord(c)
    if kind not in ("Lu", "Ll", "Lo", "Nd"):
        return ""
    if 0x4E00 <= x <= 0x9FFF:
        return _block(0x4E00, 0x5200, kind)
    if 0xAC00 <= x <= 0xD7A3:
        return _block(0xAC00, 0x2BA4, kind)
    return _block(x - x % 128, 128, kind)


def _noise(key: bytes, tweak: bytes, round_: int, value: int) -> int:
    return int.from_bytes(hmac.new(key, tweak + bytes([round_]) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big"), hashlib.sha256).digest(), "big")


def permuted(value: int, a: int, b: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of the numbers below a * b."""
    left, right = divmod(value, b)
    for r in range(0, ROUNDS, 2):
        left = (left + _noise(key, tweak, r, right)) % a
        right = (right + _noise(key, tweak, r + 1, left)) % b
    return left * b + right


def shaped(text: str, key: bytes, tweak: bytes) -> str:
    """A keyed permutation of all strings with this text's shape: alphabets and other characters place by place."""
    alphabets = [alphabet_of(c) for c in text]
    places = [i for i, a in enumerate(alphabets) if a]
    if not places:
        return text
    radices = [len(alphabets[i]) for i in places]
    value = 0
    for i, r in zip(places, radices, strict=True):
        value = value * r + alphabets[i].index(text[i])
    half = len(places) // 2
    shape = "".join(a[0] if a else c for a, c in zip(alphabets, text, strict=True)).encode()
    value = permuted(value, prod(radices[:half]), prod(radices[half:]), key, tweak + b"\0" + shape)
    out = list(text)
    for i, r in zip(reversed(places), reversed(radices), strict=True):
        value, digit = divmod(value, r)
        out[i] = alphabets[i][digit]
    return "".join(out)


# --- units --------------------------------------------------------------------


def luhn(digits: str) -> int:
    """The check digit that makes a number of these digits valid."""
    doubled = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(digits))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


def iban_check(country: str, account: str) -> int:
    """The two check digits of an IBAN, 2 to 98."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def _code_length(digits: str) -> int:
    return 1 if digits[0] in "17" else 2 if int(digits[:2]) in TWO_DIGIT_CODES else 3


def _network(value: int) -> tuple[int, int] | None:
    return next(((first, bits) for first, bits in NETWORKS if value >> bits == first >> bits), None)


def _parts(entity: str) -> tuple[str, str, str, str]:
    """(title, given, surname, gender) of a name; what is missing is empty."""
    words = entity.split(" ")
    title = words[0].rstrip(".").lower()
    lead = words.pop(0) if title in TITLES and len(words) > 1 else ""
    given = words[0] if len(words) > 1 else ""
    gender = TITLES.get(title, "n") if lead else "n"
    if gender == "n":
        gender = _KNOWN.get(given.lower(), "n")
    return lead, given, words[-1], gender


def units_of(kind: str, entity: str) -> list[tuple[str, str]]:
    """(kind, unit) of an entity: what must be replaced the same way wherever it stands."""
    if kind == "name":
        _, given, surname, gender = _parts(entity)
        return [("surname", surname.lower()), *([("person", f"{given.lower()} {gender} {surname.lower()}")] if given else [])]
    if kind == "email":
        return [(kind, entity.lower())]
    if kind == "ip":
        parts = [int(x) for x in entity.split(".")]
        return [("network" if _network(int.from_bytes(bytes(parts), "big")) else kind, ".".join(map(str, parts)))]
    if kind == "phone":
        return [(kind, re.sub(r"[^+\d]", "", entity))]
    return [(kind, re.sub(r"[ -]", "", entity))]


def surrogate(kind: str, unit: str, attempt: int, key: bytes) -> str:
    """The replacement of a unit; of a person the given name, capitalised."""
    tweak = f"{kind}:{attempt}".encode()
    more = ("en" * attempt)[: max(0, attempt - TRIES)]
    if kind == "email":
        local, _, host = unit.rpartition("@")
        head, _, top = host.rpartition(".")
        return f"{shaped(local + more[: max(0, 64 - len(local))], key, tweak)}@{shaped(head, key, b'host')}.{top}"
    if kind in ("ip", "network"):
        value = int.from_bytes(bytes(map(int, unit.split("."))), "big")
        if kind == "network":
            first, bits = _network(value)
            value = first + permuted(value - first, 1 << bits // 2, 1 << bits - bits // 2, key, tweak + first.to_bytes(4, "big"))
        else:  # until it is a public address again: a permutation of these
            value = permuted(value, 1 << 16, 1 << 16, key, tweak)
            while _network(value):
                value = permuted(value, 1 << 16, 1 << 16, key, tweak)
        return ".".join(map(str, value.to_bytes(4, "big")))
    if kind == "phone":
        code = unit[: 1 + _code_length(unit[1:])] if unit[0] == "+" else ""
        rest = unit[len(code) :]
        zeros = rest[: len(rest) - len(rest.lstrip("0"))] if rest.strip("0") else ""  # a trunk prefix
        return code + zeros + shaped(rest[len(zeros) :], key, tweak + f"{code}:{len(zeros)}".encode())
    if kind == "card":
        body = unit[0] + shaped(unit[1:-1], key, tweak + unit[:1].encode())
        return body + str((luhn(body) + int(unit[-1]) - luhn(unit[:-1])) % 10)  # valid if the number was
    if kind == "iban":
        country, digits, account = unit[:2], int(unit[2:4]), unit[4:]
        new = shaped(account, key, tweak + country.encode())
        off = digits - iban_check(country, account)
        return f"{country}{(iban_check(country, new) + off - 2) % 97 + 2:02d}{new}"
    if kind == "surname":
        return shaped(unit + (more if unit.isascii() else unit[-1:] * len(more)), key, tweak)
    if kind == "person":
        given, gender, _ = unit.split(" ")
        if attempt > TRIES:  # a person too many for the list
            return shaped(given + more, key, tweak).capitalize()
        script = unicodedata.name(given[0], "").partition(" ")[0]
        names = {"CYRILLIC": GIVEN_CYRILLIC, "GREEK": GIVEN_GREEK}.get(script, GIVEN)[gender]
        lower = [n.lower() for n in names]
        at = lower.index(given) if given in lower else _noise(key, b"given", 0, int.from_bytes(given.encode(), "big"))
        order = sorted(names, key=lambda n: _noise(key, b"order", attempt, int.from_bytes(n.encode(), "big")))
        return order[(at + attempt) % len(order)]
    return shaped(unit, key, tweak)


def _cased(template: str, text: str) -> str:
    """``text`` with capitals where the template has them."""
    return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(template, text, strict=False)) + text[len(template) :]


def replaced(kind: str, entity: str, of) -> str:
    """The entity's surrogate as the entity was written; ``of(kind, unit)`` gives that of a unit."""
    found = [of(*u) for u in units_of(kind, entity)]
    if kind == "name":
        lead, given, surname, _ = _parts(entity)
        return " ".join(x for x in (lead, found[1] if given else "", _cased(surname, found[0])) if x)
    if kind == "email":
        (local, _, host), (new, _, place) = entity.rpartition("@"), found[0].rpartition("@")
        return f"{_cased(local, new)}@{_cased(host, place)}"
    if kind == "ip":
        return found[0]
    left = iter(found[0].lstrip("+"))
    return "".join(next(left) if c.isalnum() else c for c in entity)


def entities_of(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of each entity, in order."""
    return [(m.lastgroup, m.start(), m.end()) for m in PATTERN.finditer(text or "")]


def may_hold(texts: pa.Array) -> pa.Array:
    """Which texts are worth a search: no other has an entity."""
    return pc.fill_null(pc.match_substring_regex(texts, needed()), False)


# --- Spark --------------------------------------------------------------------

_FOUND = pa.schema([("hash", pa.int64()), ("kind", pa.string()), ("unit", pa.string())])
_DRAWN = pa.schema([("kind", pa.string()), ("unit", pa.string()), ("attempt", pa.int32()), ("surrogate", pa.string())])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int64()), ("spans", pa.list_(_SPAN))])


@lean
def _find(batches):
    for b in batches:
        out, b = [], b.filter(may_hold(b.column("text")))
        for own, text in zip(b.column("hash").to_pylist(), b.column("text").to_pylist(), strict=True):
            out.extend((own, *u) for u in dict.fromkeys(u for k, s, t in entities_of(text) for u in units_of(k, text[s:t])))
        yield batch(_FOUND, *(zip(*out, strict=True) if out else ((), (), ())))


def _draw(key: bytes):
    def run(batches):
        for b in batches:
            rows = [(r["kind"], r["unit"], r["attempt"], _checked(r["kind"], r["unit"], r["attempt"], key)) for r in b.to_pylist()]
            yield batch(_DRAWN, *(zip(*rows, strict=True) if rows else ((), (), (), ())))

    return lean(run)


def _checked(kind: str, unit: str, attempt: int, key: bytes) -> str:
    """What must be distinct: a person's given name goes with the old surname, as surnames are distinct themselves."""
    new = surrogate(kind, unit, attempt, key)
    return f"{new.lower()} {unit.split(' ', 1)[1]}" if kind == "person" else new


def _replace(key: bytes, shared):
    def run(batches):
        common = shared.value if shared is not None else {}
        once = lru_cache(maxsize=REMEMBERED)(lambda kind, unit, attempt: surrogate(kind, unit, attempt, key))
        for b in batches:
            texts, counts, spans = [], [], []
            for text, may, again in zip(b.column("text").to_pylist(), may_hold(b.column("text")).to_pylist(), b.column("redrawn").to_pylist(), strict=True):
                own = {(r["kind"], r["unit"]): r["attempt"] for r in again} if again else common
                parts, at, found = [], 0, entities_of(text) if may else []
                for kind, start, end in found:
                    parts += [text[at:start], replaced(kind, text[start:end], lambda k, u, own=own: once(k, u, own.get((k, u), 0)))]
                    at = end
                texts.append("".join([*parts, text[at:]]) if parts else text)
                counts.append(len(found))
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            yield batch(_OUT, b.column("doc_id"), texts, counts, spans)

    return lean(run)


def redrawn_units(units: DataFrame, key: bytes) -> DataFrame:
    """``(kind, unit, attempt)`` of units whose first surrogate collides, with the first attempt that doesn't.

    ``units(kind, unit)``: those of the corpus, distinct.  Fails if collisions are left after ``MOST`` draws.
    """
    draw = lambda rows, n: rows.select("kind", "unit", F.lit(n).alias("attempt")).mapInArrow(_draw(key), "kind string, unit string, attempt int, surrogate string")
    units = stored(units, "units")
    # all of a private network may be in use, and its addresses are nobody's; a person's surname is checked on its own
    real = units.where("kind NOT IN ('person', 'network')").select("kind", F.col("unit").alias("surrogate"))
    state = stored(draw(units, 0), "surrogates")
    for attempt in count(1):
        shared = state.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("unit").alias("keeper")).where("n > 1")
        doubled = state.join(shared, ["kind", "surrogate"]).where("unit <> keeper").select("kind", "unit")
        taken = state.where("unit <> surrogate").join(real, ["kind", "surrogate"], "left_semi").select("kind", "unit")
        same = state.where("unit = surrogate AND kind <> 'network'").select("kind", "unit")
        bad = stored(doubled.union(taken).union(same).distinct(), "collisions")
        if bad.isEmpty():
            break
        if attempt > MOST:
            raise RuntimeError(f"surrogates of {bad.count()} units still collide after {MOST} draws")
        after = stored(state.join(bad, ["kind", "unit"], "left_anti").unionByName(draw(bad, attempt)), "surrogates")
        released(state, bad)
        state = after
    return state.where("attempt > 0").select("kind", "unit", "attempt")


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """``(doc_id, text, n_entities, spans)`` of every row of ``docs(doc_id, text, ...)``; ``text`` has surrogates, ``spans`` are places in the old text.

    ``key`` is a secret; the same key gives the same surrogates for the same corpus.  A null text
    stays null and an empty one empty; texts of any length are searched whole; where two detectors match,
    the first in order wins.  What a row becomes depends on its text and the corpus alone, so
    rows that share a doc_id, and rows without one, are replaced each on its own and
    equal texts alike; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    found = stored(rows.select("hash", "text").mapInArrow(_find, "hash long, kind string, unit string"), "units-of-texts")
    redrawn = stored(redrawn_units(found.select("kind", "unit").distinct(), key), "redrawn")
    n = redrawn.limit(BROADCAST_UNITS + 1).count()
    none = F.lit(None).cast("array<struct<kind:string,unit:string,attempt:int>>")
    if n <= BROADCAST_UNITS:
        shared = spark.sparkContext.broadcast({(r.kind, r.unit): r.attempt for r in redrawn.collect()})
        ready = rows.select("doc_id", "text", none.alias("redrawn"))
    else:
        shared = None
        by_text = found.distinct().join(redrawn, ["kind", "unit"]).groupBy("hash").agg(F.collect_list(F.struct("kind", "unit", "attempt")).alias("redrawn"))
        by_text = stored(by_text, "redrawn-by-text")
        touched = semi_by_id(rows, by_text, "hash").join(by_text, "hash").select("doc_id", "text", "redrawn")
        others = semi_by_id(rows, by_text, "hash", "left_anti").select("doc_id", "text", none.alias("redrawn"))
        ready = touched.union(others)
    return ready.mapInArrow(_replace(key, shared), "doc_id long, text string, n_entities long, spans array<struct<kind:string,start:int,end:int>>")
