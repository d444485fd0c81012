"""Personal data: detection, and surrogates that keep type, format, script and gender.

A surrogate is the image of the entity's plain form (an e-mail address in lower
case, a phone number's digits, an IBAN without spaces) under a keyed permutation
of all strings with the same pattern (the same kinds of characters in the same
places), put back into the entity's own format. So equal entities get equal
surrogates in every document however they are written, and different entities
get different ones. First names are permuted within the names of their gender,
other names among the words that are neither. Check digits are made to fit. The
checks on top are made where an entity is replaced (``check``) and over the whole
corpus (``collisions``).

People are found by title, by context (``my name is``, ``Author:``, a name before
``<address@host>``), or by a known first name before another capitalised word
that is no street, river or the like; a name found once is then found wherever it
stands in the document, alone too.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

# First names by gender, titles by gender (the third list: of any), words that make a name one of a place.
FEMALE = tuple(
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Sarah Margaret Emily Laura Rebecca Rachel Helen Catherine Julia Olivia Emma Anna Maria "
    "Sophie Camille Isabelle Brigitte Margaux Amélie Chloé Ingrid Ursula Katharina Monika Sabine Heike Gudrun Carmen Dolores Lucia Isabel Pilar Rosario Mercedes "
    "Giulia Francesca Chiara Agnieszka Katarzyna Olga Svetlana Natalia Tatiana Fatima Aisha Leila Priya Ananya Lakshmi Yuki Sakura Mei Анна Ольга Мария Ελένη Μαρία".split()
)
MALE = tuple(
    "James Robert Michael David William Richard Joseph Thomas Charles Daniel Matthew Andrew Joshua Kevin Brian George Edward Ronald Timothy Jason Jeffrey Barack "
    "Pierre Jacques François Philippe Guillaume Étienne Wolfgang Dieter Jürgen Hans Klaus Günther Stefan Carlos Miguel Pablo Fernando Alejandro Javier Diego Enrique "
    "Giovanni Luca Matteo Piotr Tomasz Dmitri Sergei Vladimir Mohammed Ahmed Omar Rajesh Sanjay Arjun Hiroshi Kenji Wei Иван Сергей Пётр Γιώργος Νίκος".split()
)
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Sra", "Señora", "Señorita", "Lady")
MALE_TITLES = ("Mr", "Monsieur", "Herr", "Sr", "Señor", "Sir", "Don")
TITLES = ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Rev", "Judge", "Senator", "Captain")
PLACES = frozenset(
    "street st road rd avenue ave lane drive square river park lake mountain mount island county city valley hill hills bridge station airport university college school "
    "church hospital museum theatre hotel company corporation inc ltd gmbh bank foundation institute prize award act law day straße platz rue calle plaza avenida place río fluss".split()
)
PARTICLES = ("van", "von", "de", "der", "den", "da", "di", "del", "la", "le", "bin", "ibn", "al", "el", "ten", "zu")
#: What comes before a name of two words or more: phrases, and labels with a colon or a line's end.
PHRASES = ("my name is", "mein name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es")
LABELS = ("name", "full name", "author", "contact", "patient", "customer", "employee", "from", "signed", "autor", "auteur", "nombre", "kontakt", "sincerely", "regards")

_UPPER = "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper())
_LOWER = "".join(chr(c) for c in range(0x61, 0x530) if chr(c).islower())
_NAME = rf"[{_UPPER}](?:[{_LOWER}]+|[{_UPPER}]+)?(?:['’-][{_UPPER}]?[{_LOWER}{_UPPER}]+)*"
_GAP = rf"(?:[ \t]+(?:(?:{'|'.join(PARTICLES)})[ \t]+)*)"
_RUN = rf"{_NAME}(?:{_GAP}{_NAME})*"
_EDGE = rf"(?<![\w'’-])"
# These begin with what is rare, not with a look behind; ``_begins`` checks that no word is cut.
_TITLED = re.compile(rf"(?:{'|'.join((*FEMALE_TITLES, *MALE_TITLES, *TITLES))})\.?[ \t]+(?P<name>{_NAME}(?:{_GAP}{_NAME}){{0,2}})(?!\w)")
_CUED = re.compile(rf"(?i:\b(?:{'|'.join(PHRASES)})[ \t]+|(?:^|(?<=[\s(\[]))(?:{'|'.join(LABELS)})[ \t]*[:,][ \t]*\n?[ \t]*)(?P<name>{_NAME}(?:{_GAP}{_NAME}){{1,2}})(?!\w)", re.M)
#: Without this, or a phrase or closing in lower case, nothing of _CUED is there.
_LABEL = re.compile(rf":[ \t]*\n?[ \t]*[{_UPPER}]")
_CLOSINGS = (*PHRASES, "sincerely", "regards")
_ADDRESSED = re.compile(rf"(?P<name>{_NAME}(?:{_GAP}{_NAME}){{1,2}})[ \t]*<(?=[\w.+-]+@)")
_RUNS = re.compile(rf"{_NAME}(?:{_GAP}{_NAME})+(?!\w)")
_TOKEN = re.compile(rf"{_NAME}")


@lru_cache(None)
def _pattern(card_digits: int) -> re.Pattern:
    """One pattern for all kinds, with cards of up to so many digits (under 13: none); an earlier alternative wins where two begin at one place."""
    card = rf"(?<![\w-])\d(?:[ -]?\d){{12,{card_digits - 1}}}(?![\w-]|\.\d)" if card_digits > 12 else "(?!)"
    return re.compile(
        rf"""
    (?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
  | (?P<cloud_key>\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b)
  | (?P<assigned>(?i:\b(?:password|passwd|pwd|token|secret|api_?key))\s?[=:]\s?["']?)(?P<value>[^\s"']{{6,}})
  | (?P<secret>(?<=["'=:\s])(?=[0-9a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{{32,64}}(?=["'\s.,;]|$))
  | (?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))
  | (?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<card>{card})
  | (?P<phone>(?<![\w.])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d(?:[ .-]?\d){{5,11}}(?!\w)|(?<![\w.])\(\d{{3}}\)[ ]?\d{{3}}[ .-]\d{{4}}(?!\w)|(?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]))
    """,
        re.X,
    )


PATTERN = _pattern(19)
#: Where none of these occurs, nothing of PATTERN can.
_DIGIT = re.compile("[0-9@]")
_HINTS = ("akia", "asia", "password", "passwd", "pwd", "token", "secret", "apikey", "api_key")
KINDS = ("email", "cloud_key", "secret", "ip", "iban", "ssn", "card", "phone", "person")

_CONSONANTS, _VOWELS = "bcdfghjklmnpqrstvwxz", "aeiouy"
_LETTERS = (
    "0123456789",
    _CONSONANTS,
    _VOWELS,
    "éèêëáàâäãåíìîïóòôöõøúùûüýÿæœ",
    "çñßðþćčďđěęąğłńňřśšşťůűźžż",
    "аеиоуыэюяё",
    "бвгджзйклмнпрстфхцчшщъь",
    "αεηιουωάέήίόύώ",
    "βγδζθκλμνξπρστφχψς",
)
_ALPHABETS = [x for low in _LETTERS for x in dict.fromkeys((low, "".join(u for u in map(str.upper, low) if len(u) == 1)))]
# A capital that is the capital of two letters (sigma) counts once.
_ALPHABETS = ["".join(dict.fromkeys(a)) for a in _ALPHABETS]
_CLASS = {c: k for k, a in enumerate(_ALPHABETS) for c in a}


def luhn_digit(digits: str) -> str:
    """The check digit that belongs after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _round(key: bytes, tweak: bytes, r: int, value: int, below: int) -> int:
    h = hashlib.blake2b(b"%d|%d|" % (r, value) + tweak, key=key, digest_size=32).digest()
    return int.from_bytes(h, "big") % below


def _moved(value: int, left: int, right: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(left * right) without fixed points (if that has two members).

    A Feistel network, in which each half is shifted by a function of the other,
    takes the value to its secret place; the next place is taken back.
    """
    a, b = divmod(value, right)
    for r in range(0, 8, 2):
        a = (a + _round(key, tweak, r, b, left)) % left
        b = (b + _round(key, tweak, r + 1, a, right)) % right
    a, b = divmod((a * right + b + 1) % (left * right), right)
    for r in range(6, -1, -2):
        b = (b - _round(key, tweak, r + 1, a, right)) % right
        a = (a - _round(key, tweak, r, b, left)) % left
    return a * right + b


def scramble(text: str, kind: str, key: bytes, hexadecimal: bool = False) -> str:
    """Replace each letter and digit by another of its class; other characters stay.

    One to one, and never the text itself if its pattern has another member.
    """
    alphabets = [("0123456789abcdef" if hexadecimal and c in "0123456789abcdef" else _ALPHABETS[_CLASS[c]]) if c in _CLASS or hexadecimal and c in "abcdef" else c for c in text]
    sizes = [len(a) for a in alphabets]
    half = len(text) // 2
    left = right = 1
    for n in sizes[:half]:
        left *= n
    for n in sizes[half:]:
        right *= n
    tweak = kind.encode() + b"|" + "".join(a[0] for a in alphabets).encode()
    value = 0
    for c, a in zip(text, alphabets):
        value = value * len(a) + a.index(c)
    moved = _moved(value, left, right, key, tweak)
    out = []
    for a in reversed(alphabets):
        moved, i = divmod(moved, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, account: str) -> str:
    """The two check digits (ISO 7064 mod 97-10)."""
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _script(word: str) -> int:
    return (ord(word[0]) >= 0x370) + (ord(word[0]) >= 0x400)


#: First names in lower case, by gender and script.
_POOLS = tuple(tuple(n.lower() for n in names if _script(n) == script) for names in (FEMALE, MALE) for script in range(3))
_KNOWN = {n: pool for pool, names in enumerate(_POOLS) for n in names}


@lru_cache(16)
def _shifted(pool: int, key: bytes) -> dict[str, str]:
    """Each name of a pool to the next in a keyed order."""
    order = sorted(_POOLS[pool], key=lambda x: hashlib.blake2b(x.encode(), key=key).digest())
    return {x: order[(i + 1) % len(order)] for i, x in enumerate(order)}


def _part_of_name(word: str, key: bytes) -> str:
    """The image of one word of a name, in lower case: a first name of the same gender and script, or no first name."""
    if word in _KNOWN:
        return _shifted(_KNOWN[word], key)[word]
    moved = scramble(word, "name", key)
    while moved in _KNOWN:  # back among the words that are none: still one to one
        moved = scramble(moved, "name", key)
    return moved


def canonical(kind: str, text: str) -> str:
    """The plain form, the same for all ways to write an entity."""
    if kind == "email":
        return text.lower()
    if kind in ("phone", "card"):
        return re.sub(r"[^\d+]", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "person":
        return " ".join(x.lower() for x in re.split(r"\s+", text))
    return text


def _is_kept_label(labels: list[str], i: int) -> bool:
    """The last label of a host, and a short one before a country's (``co.uk``)."""
    last = len(labels) - 1
    return i == last or i == last - 1 and last > 1 and len(labels[i]) <= 3 and len(labels[last]) == 2


@lru_cache(1 << 16)
def image(kind: str, plain: str, key: bytes) -> str:
    """The plain form of an entity's surrogate: one to one within a kind."""
    if kind == "card":
        body = plain[0] + scramble(plain[1:-1], f"card{plain[0]}", key)
        return body + luhn_digit(body)
    if kind == "ip":
        a, b, c, d = map(int, plain.split("."))
        low = _moved((b << 16) | (c << 8) | d, 1 << 12, 1 << 12, key, b"ip%d" % a)
        return f"{a}.{low >> 16}.{low >> 8 & 255}.{low & 255}"
    if kind == "phone":
        head = plain[: 0 if plain[0] != "+" else 2 if plain[1] in "17" else 3]  # the country stays
        return head + scramble(plain[len(head) :], "phone" + head, key)
    if kind == "email":
        name, _, host = plain.rpartition("@")
        labels = host.split(".")
        return scramble(name, "email", key) + "@" + ".".join(x if _is_kept_label(labels, i) else scramble(x, "host", key) for i, x in enumerate(labels))
    if kind == "cloud_key":
        return plain[:4] + scramble(plain[4:], "cloud_key", key)
    if kind == "secret":
        return scramble(plain, "secret", key, hexadecimal=re.fullmatch("[0-9a-f]+", plain) is not None)
    if kind == "iban":
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if iban_check(country, account) == check:
            moved = scramble(account, "iban" + country, key)
            return country + iban_check(country, moved) + moved
        moved = scramble(plain[2:], "iban", key)
        while iban_check(country, moved[2:]) == moved[:2]:  # stays one that does not check
            moved = scramble(moved, "iban", key)
        return country + moved
    if kind == "person":
        return " ".join(x if x in PARTICLES else _part_of_name(x, key) for x in plain.split(" "))
    return scramble(plain, kind, key)


def _cased(word: str, like: str) -> str:
    if len(word) == len(like):
        return "".join(w.upper() if x.isupper() and len(w.upper()) == 1 else w for w, x in zip(word, like))
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def surrogate(kind: str, text: str, key: bytes) -> str:
    """The replacement of an entity, in its own format."""
    moved = image(kind, canonical(kind, text), key)
    if kind in ("phone", "card", "iban"):
        places = iter(moved)
        return "".join(next(places) if c.isalnum() or c == "+" else c for c in text)
    if kind == "person":
        words = iter(moved.split(" "))
        return re.sub(r"\S+", lambda m: _cased(next(words), m[0]), text)
    return _cased(moved, text) if kind == "email" else moved


def is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return digits[0] in "23456" and luhn_valid(digits)


def _begins(text: str, at: int) -> bool:
    """Whether a word may begin at a place."""
    return not at or not (text[at - 1].isalnum() or text[at - 1] in "_'’-")


def _people(text: str, low: str) -> list[tuple[int, int]]:
    """Spans of names, titles left out; ``low`` is the text in lower case."""
    patterns = [_TITLED]
    if _LABEL.search(text) or any(x in low for x in _CLOSINGS):
        patterns.append(_CUED)
    if "<" in text and "@" in text:
        patterns.append(_ADDRESSED)
    spans = [m.span("name") for pattern in patterns for m in pattern.finditer(text) if _begins(text, m.start()) and not PLACES.intersection(m["name"].lower().split())]
    for m in _RUNS.finditer(text):
        if not _begins(text, m.start()):
            continue
        words = list(_TOKEN.finditer(m[0]))
        i = 0
        while i < len(words) - 1:
            if words[i][0].lower() in _KNOWN and words[i + 1][0].lower() not in PLACES:
                last = min(i + 2, len(words) - 1)
                if words[last][0].lower() in PLACES or last == i + 2 and words[last][0].lower() in _KNOWN:
                    last = i + 1
                spans.append((m.start() + words[i].start(), m.start() + words[last].end()))
                i = last
            i += 1
    if spans:
        words_below = set(re.findall(r"\w+", text))  # what the document writes without a capital is no name alone
        parts = {w for a, b in spans for w in _TOKEN.findall(text[a:b]) if len(w) > 2 and w.lower() not in words_below} | {text[a:b] for a, b in spans}
        again = re.compile(rf"{_EDGE}(?:{'|'.join(sorted(map(re.escape, parts), key=lambda x: (-len(x), x)))})(?![\w'’-])")
        spans += [m.span() for m in again.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, entity) of each entity, in order."""
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    low = text.lower()
    at = 0 if _DIGIT.search(text) or any(x in low for x in _HINTS) else len(text)
    while m := PATTERN.search(text, at):
        at = m.start() + 1
        while m and m["card"] and not is_card(m[0]):  # fewer digits may be a card, or another kind begins there
            m = _pattern(sum(c.isdigit() for c in m[0]) - 1).match(text, m.start())
        if not m:
            continue
        at = m.end()
        if m["value"]:
            out.append((*m.span("value"), "secret", m["value"]))
            continue
        out.append((m.start(), m.end(), m.lastgroup, m[0]))
    taken = list(out)
    i = 0
    for a, b in _people(text, low):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            out.append((a, b, "person", text[a:b]))
    return sorted(out)


def check(pairs: dict[tuple[str, str], str]) -> None:
    """Raise if two entities (kind, plain form) of a document would share a surrogate (plain form)."""
    seen: dict[tuple[str, str], str] = {}
    for (kind, plain), moved in pairs.items():
        if seen.setdefault((kind, moved), plain) != plain:
            raise ValueError(f"two entities of kind {kind} have one surrogate")


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    found = find(text)
    if not found:
        return text, found
    plain = {(kind, canonical(kind, entity)) for _, _, kind, entity in found}
    check({(kind, x): image(kind, x, key) for kind, x in plain})
    out, at = [], 0
    for begin, end, kind, entity in found:
        out += [text[at:begin], surrogate(kind, entity, key)]
        at = end
    return "".join([*out, text[at:]]), found


def _tag(key: bytes, kind: str, plain: str) -> bytes:
    """Stands for an entity where the entity itself must not be written."""
    return hashlib.blake2b(f"{kind} {plain}".encode(), key=key, digest_size=16).digest()


_PAIRS = pa.list_(pa.struct([("kind", pa.string()), ("surrogate", pa.string()), ("entity", pa.binary())]))


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """Per document: doc_id, n_entities, kinds (the sorted kinds found, comma-joined), text (with surrogates).

    ``key`` (16 to 64 bytes) is the secret that alone can undo the surrogates. A
    null text stays null and an empty one empty, with no entities. Repeated rows
    give repeated rows, with the same surrogates. Other columns are ignored.
    Texts are taken whole. The result is written to the shared folder, and the
    call raises if over all its documents two entities share a surrogate.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")

    def run(batches):
        for b in batches:
            done = [replace(x.as_py(), key) for x in b.column("text")]
            pairs = [[{"kind": kind, "surrogate": image(kind, plain, key), "entity": _tag(key, kind, plain)} for kind, plain in sorted({(x[2], canonical(x[2], x[3])) for x in f})] for _, f in done]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(f) for _, f in done], pa.int32()), pa.array([",".join(sorted({x[2] for x in f})) for _, f in done]), pa.array([t for t, _ in done], pa.string()), pa.array(pairs, _PAIRS)],
                names=["doc_id", "n_entities", "kinds", "text", "pairs"],
            )

    schema = "doc_id long, n_entities int, kinds string, text string, pairs array<struct<kind:string,surrogate:string,entity:binary>>"
    out = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "surrogates")
    if not collisions(out).isEmpty():
        raise ValueError("two entities have one surrogate")
    return out.drop("pairs")


def collisions(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate) of surrogates that stand for several entities, from the ``pairs`` of all documents; none is expected."""
    pairs = replaced.select(F.explode("pairs").alias("p")).select("p.*")
    return pairs.groupBy("kind", "surrogate").agg(F.min("entity").alias("one"), F.max("entity").alias("other")).where("one <> other").select("kind", "surrogate")


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """A row for each entity of each document: doc_id, begin, end, kind, entity, surrogate."""
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())])

    def run(batches):
        for b in batches:
            rows = [
                {"doc_id": d, "begin": begin, "end": end, "kind": kind, "entity": entity, "surrogate": surrogate(kind, entity, key)}
                for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                for begin, end, kind, entity in find(text)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, begin long, end long, kind string, entity string, surrogate string")
