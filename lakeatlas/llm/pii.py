"""PII surrogates: detected entities get keyed replacements of the same type, format, script and gender.

E-mail addresses, phone numbers, card numbers, IBANs, social security numbers and IPv4 addresses are permuted by a keyed
Feistel network over the numbers of their own format: digits stay digits, letters stay letters of their case, check digits
are set anew. A permutation never maps two entities to one, and maps the same entity to the same surrogate everywhere.
Phone numbers are groups of digits that are judged by their shape and count. Names are found by their title, which also
tells the gender, and from then on a text's further mentions of them (whole, given or family name) without it. Each word of a
name is numbered among the words of its script and length, the number is permuted by key among words of as many syllables as
that takes, and a given name ends as its gender does. So a surrogate depends on its name and the key only, two names never
share one, and mentions of a person keep what they share, in whatever corpus and run.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import hmac
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, text_or_empty

#: Patterns of the entity types, in the order in which they take a stretch of text.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])",
    "phone": r"(?<![\w.+-])(?:\+?[0-9]+|\+?\(\+?[0-9]{1,5}\))(?:[ ./-]?\([0-9]{1,5}\)|[ ./-][0-9]+|(?<=\))[0-9]+)*(?![\w-]|\.[0-9])",
    "ssn": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]|\.[0-9])",
    "ip": r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])",
    "name": r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Г-н|Г-жа|Господин|Госпожа|Κύριος|Κυρία)\.? +(?:[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+)(?: [^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+)?",
}
_FOUND = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Titles of women; others are of men.
WOMEN = {"Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа", "Κυρία"}
#: Consonants and vowels of the syllables of names by script, and ends of given names by gender.
SYLLABLES = {
    "latin": [c + v for c in "bcdfghjklmnprstvwxyz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгджзклмнпрстфхцчшщ" for v in "аеиоу"],
    "greek": [c + v for c in "βγδζθκλμνξπρστφχψ" for v in "αεηιοω"][:100],
}
ENDS = {("latin", "m"): "n", ("latin", "f"): "a", ("cyrillic", "m"): "н", ("cyrillic", "f"): "я", ("greek", "m"): "ς", ("greek", "f"): "α"}
#: Code points by which a word's letters are numbered, from the narrowest range on; the last takes any word.
RANGES = {"latin": [(0x61, 26), (0, 0x250)], "cyrillic": [(0x430, 32)], "greek": [(0x3AC, 35)]}
_ANY = (0, 0x110000)


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of 0..size-1: eight Feistel rounds over the next even number of bits, walked until inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            left, right = right, left ^ (_number(key, tweak, half, r, right) & mask)
        value = left << half | right
        if value < size:
            return value


def permute_text(key: bytes, tweak: str, text: str) -> str:
    """Permute the ASCII letters and digits of ``text`` among the texts of the same pattern; other characters stay."""
    kinds = [10 if c.isdecimal() and c.isascii() else 26 if c.isalpha() and c.isascii() else 0 for c in text]
    value, size = 0, 1
    for c, k in zip(text, kinds):
        if k:
            value, size = value * k + (int(c) if k == 10 else ord(c.lower()) - 97), size * k
    pattern = "".join("9" if k == 10 else ("a" if c.islower() else "A") if k else c for c, k in zip(text, kinds))
    value = permute(key, f"{tweak}/{pattern}", value, size)
    out = []
    for c, k in zip(reversed(text), reversed(kinds)):
        if k:
            value, d = divmod(value, k)
            c = str(d) if k == 10 else chr(97 + d) if c.islower() else chr(65 + d)
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban_sum(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script_of(text: str) -> str:
    for c in text:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


_DATE = re.compile(r"(?:^| )(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:[0-9]{4}|[0-9]{2})|[0-9]{4}([./-])[0-9]{1,2}\2[0-9]{1,2})(?= |$)")
_GROUP = re.compile(r"[0-9]+")
_LOCAL = re.compile(r"1?[2-9][0-9][0-9][2-9][0-9]{6}")
#: Country numbers of two digits; those of one are 1 and 7, and others have three.
TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def is_phone(text: str) -> bool:
    """Whether groups of digits are a phone number as a whole, by their number of digits and the shape of the groups."""
    groups = _GROUP.findall(text)
    sizes, digits = [len(g) for g in groups], "".join(groups)
    if not 7 <= len(digits) <= 15 or len(sizes) >= 4 and set(sizes) == {4}:
        return False
    if "+" in text:
        return all(n > 1 for n in sizes[1:] if n != 1 or "(0)" not in text)
    if len(sizes) == 3 and 2 <= sizes[0] <= 4 and sizes[1] in (3, 4) and sizes[2] in (3, 4):
        return True
    if _DATE.search(text) or sizes == [3, 2, 4] or len(sizes) == 4 and set(re.sub("[0-9]", "", text)) == {"."} and max(sizes) <= 3:
        return False
    if re.match(r"00?[1-9]", digits):
        return 9 <= len(digits) and min(sizes) > 1
    return _LOCAL.fullmatch(digits) is not None and sizes[len(digits) == 11 and sizes[0] == 1 :] in ([10], [3, 7], [3, 3, 4], [6, 4], [11])


def phones_in(text: str) -> list[tuple[int, int]]:
    """(start, end) of the phone numbers in a run of digit groups, longest first from the left; runs part at spaces only."""
    if len(text) < 7:
        return []
    if re.fullmatch("[0-9]{4}(?:[ -][0-9]{4}){3,}", text):
        return []
    starts = [0, *(m.end() for m in re.finditer(" ", text))]
    ends = [*(m.start() for m in re.finditer(" ", text)), len(text)]
    out, i = [], 0
    while i < len(starts):
        near = [j for j in range(i, min(i + 8, len(ends))) if ends[j] - starts[i] <= 24]
        j = next((j for j in reversed(near) if is_phone(text[starts[i] : ends[j]])), None)
        if j is not None and j > i and re.fullmatch("(?:19|20)[0-9][0-9]", text[starts[j] : ends[j]]):  # a year beside a number that is whole without it
            rest = text[starts[i] : ends[j - 1]]
            j -= len(re.sub("[^0-9]", "", rest)) >= 10 and is_phone(rest)
        if j is None:
            i += 1
        else:
            out.append((starts[i], ends[j]))
            i = j + 1
    return out


def country_of(own: str) -> str:
    """The country's number after a plus: the group of its own, or else by the numbers that are dealt out."""
    if "+" not in own:
        return ""
    digits = re.sub("[^0-9]", "", own)
    alone = re.match(r"\(?\+([0-9]{1,3})(?=[ ./()-])", own)
    return alone[1] if alone else digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3]


def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further mentions of the names in ``found``; a given name alone has - for its family name."""
    known: dict[str, str] = {}
    for given in (False, True):
        for _, _, kind, entity in found:
            gender, _, name = entity.partition(":")
            if kind == "name":
                words = name.split()
                for form, own in ([(words[0], f"{words[0]} -")] if len(words) > 1 else []) if given else [(name, name), (words[-1], words[-1])]:
                    known.setdefault(form, f"{gender}:{own}")
    if not known:
        return []
    forms = "|".join(r" +".join(map(re.escape, f.split())) for f in sorted(known, key=lambda f: (-len(f), f)))
    taken = sorted((s, e) for s, e, _, _ in found)
    out = []
    for m in re.finditer(rf"(?<!\w)(?:{forms})(?!\w)", text):
        if not _overlaps(taken, m.start(), m.end()):
            out.append((m.start(), m.end(), "name", known[" ".join(m[0].split())]))
    return out


def _name_parts(text: str) -> tuple[str, str]:
    title, _, name = text.partition(" ")
    return title, name.strip()


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """``taken``: sorted stretches, none in another."""
    k = bisect.bisect_left(taken, (end,))
    return k > 0 and taken[k - 1][1] > start


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, entity) by start, without overlap; entity is the form that all its mentions share."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    if not text:
        return found
    digits = re.search("[0-9]", text) is not None
    for kind, pattern in _FOUND.items():
        if kind == "email" and "@" not in text or kind not in ("email", "name") and not digits:
            continue
        spans = ((m.start(), m.end()) for m in pattern.finditer(text))
        if kind == "phone":
            spans = ((a + b, a + c) for a, z in spans for b, c in phones_in(text[a:z]))
        new: list[tuple[int, int]] = []
        for s, e in spans:
            own = text[s:e]
            if kind == "email":
                entity = own.lower()
            elif kind == "name":
                entity = " ".join(_name_parts(own)[1].split())
                s = e - len(_name_parts(own)[1])
            else:
                entity = re.sub(r"[^A-Z0-9]", "", own)
                if kind == "card" and not luhn(entity) or kind == "iban" and _iban_sum(entity) != 1:
                    continue
                if kind == "ip" and max(map(int, own.split("."))) > 255:
                    continue
                if kind == "phone":  # the country's number stays, and the rest is the same with and without it
                    country = country_of(own)
                    entity = f"{country}:{entity[len(country):]}"
                if kind == "ip":
                    entity = ".".join(str(int(x)) for x in own.split("."))
            if kind == "name":
                entity = f"{'f' if _name_parts(own)[0].rstrip('.') in WOMEN else 'm'}:{entity}"
            if entity and not _overlaps(taken, s, e):
                new.append((s, e))
                found.append((s, e, kind, entity))
        # what one type takes is without overlap, so that types are merged one by one
        taken = list(heapq.merge(taken, sorted(new)))
    return sorted(found + _mentions(text, found))


@functools.cache
def _need(base: int, n: int) -> int:
    """Syllables, of 100 kinds, among which all words of ``n`` letters of ``base`` kinds have room four times."""
    k = 1
    while 4 * base**n > 100**k:
        k += 1
    return k


@functools.cache
def _before(script: str, which: int, n: int) -> int:
    """How many words with narrower letters, or as narrow ones and fewer, share the number of syllables."""
    ranges = [*RANGES[script], _ANY]
    k = _need(ranges[which][1], n)
    total = 0
    for i, (_, base) in enumerate(ranges[: which + 1]):
        m = 1
        while _need(base, m) <= k and (i, m) < (which, n):
            total += base**m if _need(base, m) == k else 0
            m += 1
    return total


def _syllabic(key: bytes, part: str, word: str) -> str:
    """The word's surrogate: a keyed permutation of the words of its script among those of as many syllables as they need."""
    script = script_of(word)
    ranges = [*RANGES[script], _ANY]
    capital = word[0].isupper() and word[1:].islower() or len(word) == 1 and word.isupper()
    for which, (first, base) in enumerate(ranges):
        lower = first > 0  # letters of one case, the first a capital
        letters = word.lower() if lower else word
        if (capital or not lower) and len(letters) == len(word) and all(first <= ord(c) < first + base for c in letters) and (not lower or letters.capitalize() == word):
            break
    value = 0
    for c in letters:
        value = value * base + ord(c) - first
    k = _need(base, len(word))
    value = permute(key, f"{part}/{script}/{k}", _before(script, which, len(word)) + value, 100**k)
    out = []
    for _ in range(k):
        value, d = divmod(value, 100)
        out.append(SYLLABLES[script][d])
    return "".join(out)


def _given(key: bytes, gender: str, word: str) -> str:
    return _syllabic(key, f"given {gender}", word).capitalize() + ENDS[script_of(word), gender]


def _family(key: bytes, word: str) -> str:
    return _syllabic(key, "family", word).capitalize()


def surrogate(key: bytes, kind: str, entity: str) -> str:
    """The surrogate of an entity in its shared form."""
    if kind == "name":
        gender, _, name = entity.partition(":")
        words = name.split()
        out = [_given(key, gender, words[0])] if len(words) > 1 else []
        return " ".join(out + ([] if words[-1] == "-" else [_family(key, words[-1])]))
    if kind == "email":
        return permute_text(key, "email", entity.partition("@")[0]) + "@" + _domain(key, entity.partition("@")[2])
    if kind == "card":
        body = permute_text(key, "card", entity[:-1])
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == "iban":
        body = permute_text(key, "iban", entity[4:])
        return f"{entity[:2]}{98 - _iban_sum(entity[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        a, b, c, d = map(int, entity.split("."))
        n = permute(key, "ip", (a << 24) + (b << 16) + (c << 8) + d, 1 << 32)
        return ".".join(str(n >> k & 255) for k in (24, 16, 8, 0))
    if kind == "phone":
        country, _, rest = entity.partition(":")
        return country + permute_text(key, kind, rest)
    return permute_text(key, kind, entity)


def _domain(key: bytes, domain: str) -> str:
    *labels, top = domain.split(".")
    return ".".join([*(permute_text(key, "domain", x) for x in labels), top])


def _in_form(original: str, kind: str, new: str) -> str:
    """Set a surrogate in the separators (or the case) of a mention."""
    if kind == "email":
        return new.upper() if original.isupper() else new
    if kind in ("name", "ip"):
        return new
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in original)


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    found, out, at = detect(text), [], 0
    for s, e, kind, entity in found:
        out += [text[at:s], _in_form(text[s:e], kind, surrogate(key, kind, entity))]
        at = e
    return "".join(out) + text[at:], found


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) over all texts; a map task counts an entity once."""

    def run(batches):
        for b in batches:
            found = {(k, e) for t in b["text"] for _, _, k, e in detect(t)}
            if found:
                yield pd.DataFrame(sorted(found), columns=["kind", "entity"])

    return docs.select(text_or_empty().alias("text")).mapInPandas(run, "kind string, entity string").distinct()


def shared_surrogates(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """(kind, surrogate, n): surrogates that several entities of one type share. There are none, as they come from permutations;
    this counts over all texts whether that holds."""
    secret = key.encode()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"kind": b["kind"], "surrogate": [f"{e[:2] if k == 'name' else ''}{surrogate(secret, k, e)}" for k, e in zip(b["kind"], b["entity"], strict=True)]})

    made = entities(docs).mapInPandas(run, "kind string, surrogate string")
    return made.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def pseudonymise(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``docs`` with surrogates in text, and the new column pii: an array of (start, end, kind) in the old text.

    Rows without entities are unchanged. A null text stays null, with no pii; empty texts, repeated rows and other columns
    stay as they are (an existing column pii is replaced), and n_chars is not set anew: formats keep their length but for
    names and IP addresses. A surrogate may by chance be another real name or number, which is replaced in its turn. An empty
    table gives no rows. Digits are 0-9; those of other scripts are not looked at.
    """
    secret = key.encode()
    columns = [c for c in docs.columns if c != "pii"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        done = [replace(t, secret) if t is not None else (None, []) for t in b.column("_la_old").to_pylist()]
        return [pa.array([t for t, _ in done], pa.string()), pa.array([[{"start": s, "end": e, "kind": k} for s, e, k, _ in f] for _, f in done], span)]

    src = docs.select(*(F.col(f"`{c}`") for c in columns if c != "text"), F.col("text").alias("_la_old"))
    out = map_arrow(src, run, "text string, pii array<struct<start:int,end:int,kind:string>>", drop=("_la_old",))
    return out.select(*(F.col(f"`{c}`") for c in columns), "pii")
