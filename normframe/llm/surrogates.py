"""Personal data replaced by keyed surrogates of the same type and format.

Numbers, addresses and secrets go through a keyed permutation of all strings of
their format (an alternating Feistel network over mixed radices). A permutation
gives distinct values distinct surrogates and one value the same surrogate in
all documents, without a table and without a shuffle; formats differ in shape,
so surrogates of different formats can't meet either. No string is its own
surrogate. A name word is numbered among all words of its letters, the number
is permuted, and written in syllables of its script with an ending of its
gender: a pronounceable word, and another one for every other name, however many
there are. A collision check over all distinct name words of the corpus finds
surrogates that are real names there, and moves them on. Name words that a
title, a letter's begin or end, an introduction or an e-mail address gave away
are replaced in the whole document.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, read_table, remove, utf8

#: For tests and the sample query; production passes a secret of its own.
DEMO_KEY = "normframe demonstration key"

# Alphabets that a surrogate's characters stay in.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
HEX = ("0123456789abcdef", "0123456789ABCDEF")
# Titles before a name, by gender.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Sir", "Signor", "Signore", "Sig", "господин", "κύριος", "Κύριος", "κύριο", "κυρίου"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Srta", "Señorita", "Doña", "Madame", "Mme", "Mlle", "Mademoiselle", "Lady", "Signora", "Signorina", "госпожа", "κυρία", "Κυρία", "κυρίας"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Mx", "Rev", "Reverend", "President", "Senator", "Governor", "Judge", "Captain", "Colonel", "Sergeant", "Detective", "Inspector"),
}
# Titles that are also found in capitals.
SHOUTED = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Signor", "Signora", "господин", "госпожа")
# What stands before a name in a letter's end, and where people say or write their names; in any case.
CLOSINGS = ("regards", "sincerely", "sincerely yours", "yours truly", "yours faithfully", "best wishes", "mit freundlichen grüßen", "viele grüße", "liebe grüße", "cordialement", "bien à vous",
            "saludos", "saludos cordiales", "atentamente", "cordiali saluti", "с уважением", "με εκτίμηση")
NAMINGS = ("my name is", "my name's", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es", "mi chiamo", "меня зовут", "με λένε", "signed by", "full name:", "first name:",
           "given name:", "last name:", "family name:", "surname:", "attn:")
# Words after "Dear" and at a letter's end that are no names.
ADDRESSED = ("Sir", "Sirs", "Madam", "Customer", "Customers", "Client", "Friend", "Friends", "Colleague", "Colleagues", "Team", "All", "Everyone", "Editor", "Reader", "Readers", "Parents", "Mom", "Mum", "Dad", "Santa",
             "Diary", "God", "Lord", "Guest", "Guests", "Member", "Members", "Student", "Students", "Our", "My", "Sent", "Please")
# Names that are ordinary words too, and stay where they stand alone at a sentence's start or before another word with a capital.
AMBIGUOUS = frozenset("may will mark bill grant rose grace hope faith joy white black brown green gray grey young long short king price rich stone wood hill field church park lake bush rice cook baker "
                      "miller smith fox wolf bird fish day winter summer love best good strong wise small little north west east".split())  # fmt: skip
# Lower-case words within names, which stay.
PARTICLES = ("de", "del", "de la", "de las", "de los", "la", "las", "los", "y", "da", "das", "do", "dos", "di", "della", "du", "des", "le", "van", "van de", "van den", "van der", "von", "von der",
             "vom", "zu", "zum", "zur", "ten", "ter", "den", "der", "af", "av", "al", "el", "bin", "bint", "ibn", "ben", "фон", "де", "ван")
# Words that a name may take along, and that are replaced only there.
COMMON = frozenset("the and but for not his her him she they you your this that these those with from then than when where what who why how was were has had have are will "
                   "der die das den dem des ein eine einer und oder aber mit von wir sie ihr ist war hat auf aus bei nach wie "
                   "los las una por para con que pero como esta este les des dans mais pour avec est qui elle ils nous vous "
                   "он она они это как что для его ему".split())  # fmt: skip
# Syllables of made-up names by script, and endings by gender (n: family names), two for each kind of letters in the real name.
SYLLABLES = {
    "latin": ([c + v for c in "bdfgklmnprstvz" for v in "aeiou"], {"m": ["n", "r", "s", "l", "k", "t"], "f": ["na", "la", "ra", "ia", "ne", "sa"], "n": ["man", "son", "sen", "ley", "vey", "lin"]}),
    "cyrillic": ([c + v for c in "бвгдзклмнпрст" for v in "аеиоу"], {"m": ["н", "р", "с", "л", "к", "т"], "f": ["на", "ла", "ра", "ия", "са", "та"], "n": ["енко", "ук", "ин", "ман", "лей", "тон"]}),
    "greek": ([c + v for c in "βγδκλμνπρστ" for v in "αεηιο"], {"m": ["νος", "ρος", "λος", "κος", "τος", "σης"], "f": ["να", "λα", "ρα", "κη", "τη", "σα"], "n": ["ίδης", "άκης", "έας", "ούδης", "άτος", "ίου"]}),
}
# Letters of names by script, the usual ones and those with marks.
NAME_LETTERS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżžșț" + "".join(map(chr, range(0x300, 0x330)))),
    "cyrillic": ("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "ѓєѕіїјљњћќўџґ" + "".join(map(chr, range(0x300, 0x330)))),
    "greek": ("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώ", "ϊϋΐΰ" + "".join(map(chr, range(0x300, 0x330)))),
}
# Blocks of letters (first, last) of other scripts, and of marked Latin letters, whose characters are replaced by others of the block.
BLOCKS = ((0xE0, 0xF6), (0xF8, 0xFF), (0xC0, 0xD6), (0xD8, 0xDE), (0x561, 0x586), (0x5D0, 0x5EA), (0x627, 0x63A), (0x641, 0x64A), (0x905, 0x914), (0x915, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0),
          (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
# Address blocks with a meaning of their own (prefix, bits); surrogates stay inside.
IP_BLOCKS = ((0, 8), (10, 8), (127, 8), (0xA9FE, 16), (0xAC1, 12), (0xC0A8, 16), (0xE, 4), (0xF, 4))

# Last letters of given names that are read as feminine where no title tells.
FEMININE_ENDINGS = "aeаяαη"


def _lower() -> str:
    """The lower-case letters of the Latin, Greek and Cyrillic scripts."""
    return "".join(chr(c) for low, high in ((0x41, 0x530), (0x1E00, 0x2000)) for c in range(low, high) if chr(c).islower())


_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_GENDER |= {t.upper(): _GENDER[t] for t in SHOUTED}
_SHOUTED = "|".join(sorted((t.upper() for t in SHOUTED), key=len, reverse=True))
_CUE = "|".join(sorted((*CLOSINGS, *NAMINGS), key=len, reverse=True))
_NO_NAME = "|".join(sorted((*(w.capitalize() for w in COMMON), *ADDRESSED), key=len, reverse=True))
# A name: words, initials and lower-case particles; it ends with a word or an initial, and stops before another title.
_LETTER = r"(?:[^\W\d_][\u0300-\u036f]*)"
_CAPITAL = rf"(?:[^\W\d_{_lower()}][\u0300-\u036f]*)"
_APOSTROPHE = r"(?:['’](?!(?:[sSdDmMtT]|ll|LL|re|RE|ve|VE)(?![^\W\d_]))(?=[^\W\d_]))"
_WORD = rf"(?:(?!(?:{_TITLE}|{_SHOUTED})\b)(?:[dDlL]['’])?{_CAPITAL}{_APOSTROPHE}?{_LETTER}+(?:{_APOSTROPHE}{_LETTER}+)*)"
_INITIAL = rf"(?:{_CAPITAL}\.(?=[ -]?{_CAPITAL}))"
_PARTICLES = rf"(?:(?:{'|'.join(sorted(PARTICLES, key=len, reverse=True))}) )"
_NAME = rf"{_PARTICLES}{{0,3}}(?:{_INITIAL}[ -]?)*{_WORD}(?:[ -]{_PARTICLES}{{0,3}}(?:{_INITIAL}[ -]?)*{_WORD})*"
_FEW = _NAME[:-1] + "{0,9}"
_LOUD = rf"(?!(?:{'|'.join(sorted((w.upper() for w in COMMON), key=len, reverse=True))})\b){_WORD}"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]++@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<assigned>(?i:\b(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth)\b)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_+/=.~-]{8,})"
    r"|(?P<key>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})\b)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<ipv6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]))"
    r"|(?P<card>(?<![\w])\d(?:[ -]?\d){12,18}(?![\w]))"
    rf"|(?P<title>\b(?:{_TITLE})\b\.?\s{{1,3}})(?P<name>{_NAME})"
    rf"|(?P<shout>\b(?:{_SHOUTED})\b\.?\s{{1,3}})(?P<shouted>{_LOUD}(?:[ -]{_LOUD}){{0,2}})"
    rf"|(?P<cue>\b(?i:{_CUE})[,.!]?\s{{1,4}})(?P<cued>(?!(?:{_NO_NAME})\b){_FEW})(?=[ \t]{{0,3}}(?:[\r\n,.;!?)]|\Z))"
    rf"|(?P<dear>\bDear )(?P<greeted>(?!(?:{_NO_NAME})\b){_FEW})(?=[,!:\r\n])"
)
_NAME_KINDS = {"name": "title", "shouted": "shout", "cued": "", "greeted": ""}
_CAPITALS = re.compile(rf"(?<![^\W_]){_WORD}(?![^\W_])")
_PARTS = re.compile(rf"(?P<initial>{_CAPITAL}(?=\.))|{_LETTER}+")
#: Texts without any of these have no name, or no entity; RE2 tests whole columns, and its \\b knows ASCII only.
_NAMED = rf"@|Dear |(?i:{_CUE})|{_SHOUTED}|{_TITLE}"
_MAYBE = rf"{_NAMED}|\p{{Nd}}|[a-f]{{32}}|::|AKIA|(?i:token|secret|passw|pwd|key|auth)|sk-|gh[pousr]_|xox"


#: Characters that are permuted as one number.
PIECE = 256


class Keyed:
    """Surrogates under one key. ``moved``: attempts of name words that the collision check moved on; ``roles``: of the words that texts have in several."""

    def __init__(self, key: str, moved: dict[tuple[str, str, str], int] | None = None, roles: dict[str, str] | None = None):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.moved, self.roles = moved or {}, roles or {}
        self.surrogate = lru_cache(100_000)(self.surrogate)
        self.name_word = lru_cache(100_000)(self.name_word)

    def number(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, left: int, right: int, tweak: object) -> int:
        """A keyed permutation of 0..left*right-1 without a fixed point (if there is a second number): a step in a keyed order of all numbers."""
        size = left * right
        if size < 2:
            return value
        a, b = divmod(value, right)
        for r in range(0, 10, 2):
            a = (a + self.number(tweak, r, b)) % left
            b = (b + self.number(tweak, r + 1, a)) % right
        a, b = divmod((a * right + b + 1 + self.number(tweak, "step") % (size - 1)) % size, right)
        for r in range(8, -1, -2):
            b = (b - self.number(tweak, r + 1, a)) % right
            a = (a - self.number(tweak, r, b)) % left
        return a * right + b

    def string(self, text: str, tweak: object, hexadecimal: bool | str = False) -> str:
        """A keyed permutation of the strings of that shape: each character stays in its alphabet, others stay.

        Long strings go piece by piece, each by a permutation of its own for what stands before it, so different strings stay different.
        """
        if hexadecimal is True:  # digits belong to the case of the letters
            hexadecimal = HEX[1] if any(c in "ABCDEF" for c in text) else HEX[0]
        if len(text) > PIECE:
            before, out = hashlib.blake2b(digest_size=32), []
            for at in range(0, len(text), PIECE):
                out.append(self.string(text[at : at + PIECE], (tweak, at, before.hexdigest()), hexadecimal))
                before.update(text[at : at + PIECE].encode())
            return "".join(out)
        sets = []
        for c in text:
            own = next((a for a in (HEX if hexadecimal else ALPHABETS) if c in a), None)
            if hexadecimal and own is None:
                own = next((a for a in ALPHABETS if c in a), None)
            sets.append(own if own is not None else digits_like(c) if c.isdecimal() else block_of(c))
        if hexadecimal:
            sets = [hexadecimal if s in HEX else s for s in sets]
        radices = [len(s) for s in sets if s]
        digits = [s.index(c) for s, c in zip(sets, text, strict=True) if s]
        shape = "".join((str((*ALPHABETS, *HEX).index(s)) if s in (*ALPHABETS, *HEX) else s) if s else c for s, c in zip(sets, text, strict=True))
        half = len(radices) // 2
        left = right = 1
        for r in radices[:half]:
            left *= r
        for r in radices[half:]:
            right *= r
        value = 0
        for d, r in zip(digits, radices, strict=True):
            value = value * r + d
        value = self.permute(value, left, right, (tweak, shape))
        for i in range(len(radices) - 1, -1, -1):
            value, digits[i] = divmod(value, radices[i])
        it = iter(digits)
        return "".join(s[next(it)] if s else c for s, c in zip(sets, text, strict=True))

    def walk(self, text: str, tweak: str, ok: Callable[[str], bool]) -> str:
        """The permutation walked on to the next string for which ``ok`` holds, as it does for ``text``; the walk comes back to ``text`` only if there is no other."""
        out = self.string(text, tweak)
        while not ok(out):
            out = self.string(out, tweak)
        return out

    def surrogate(self, kind: str, text: str) -> str:
        """The surrogate of an entity other than a name."""
        if kind == "email":
            local, _, domain = text.rpartition("@")
            host, dot, top = domain.rpartition(".")
            return self.string(local, ("local", domain)) + "@" + self.string(host, ("host", top)) + dot + top
        if kind == "ip":
            return self._ip(text)
        if kind == "ipv6":
            return self.string(text, "ipv6", True)
        if kind == "card":
            digits = re.sub(r"\D", "", text)
            if luhn(digits):
                new = self.string(digits[:-1], "card")
                new += next(d for d in digits_like(digits[-1]) if luhn(new + d))
            else:
                new = self.walk(digits, "other card", lambda x: not luhn(x))
            it = iter(new)
            return "".join(next(it) if c.isdigit() else c for c in text)
        if kind == "iban":
            plain = text.replace(" ", "")
            land, rest = plain[:2], self.string(plain[4:], ("iban", plain[:2]))
            new = land + (iban_check(land, rest) if iban_check(land, plain[4:]) == plain[2:4] else self.string(plain[2:4], "check")) + rest
            it = iter(new)
            return "".join(c if c == " " else next(it) for c in text)
        if kind == "phone":
            kept = re.match(r"\+\d{1,3}(?=[ .(-])|", text)[0]
            return kept + self.string(text[len(kept) :], ("phone", kept))
        if kind in ("secret", "key"):
            kept = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|", text)[0]
            body = text[len(kept) :]
            plain_hex = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body) is not None and not body.isdigit()
            return kept + self.string(body, ("secret", kept, plain_hex), plain_hex)
        return self.string(text, kind)

    def _ip(self, text: str) -> str:
        value = 0
        for part in text.split("."):
            value = value << 8 | int(part)
        for prefix, bits in IP_BLOCKS:
            if value >> (32 - bits) == prefix:
                host = (32 - bits) // 2
                low = self.permute(value & ((1 << (32 - bits)) - 1), 1 << (32 - bits - host), 1 << host, ("ip", prefix))
                value = prefix << (32 - bits) | low
                break
        else:
            while True:
                value = self.permute(value, 1 << 16, 1 << 16, "ip")
                if not any(value >> (32 - bits) == prefix for prefix, bits in IP_BLOCKS):
                    break
        return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))

    def initial(self, letter: str) -> str:
        """Another letter for an initial, of its alphabet or block, or else of its script's."""
        out = self.string(letter, "initial")
        if out != letter:
            return out
        letters = ALPHABETS[{"cyrillic": 4, "greek": 6}.get(script_of(letter), 2)]
        return letters[self.number("initial", letter) % len(letters)]

    def name_word(self, role: str, word: str, attempt: int | None = None) -> str:
        """A made-up word for a name word; ``role``: m or f for given names by gender, n for family names.

        Words of one kind of letters are numbered by length and then in order.
        Numbers that some syllables suffice for are permuted among these, so
        two words have two surrogates; endings tell kinds of letters apart.
        Every attempt takes another syllable.
        """
        low, script = word.lower(), script_of(word)
        attempt = self.moved.get((role, script, low), 0) if attempt is None else attempt
        if script == "other":
            out = self.string(word, ("name", role, attempt))
            if out != word:
                return out
        syllables, endings = SYLLABLES.get(script, SYLLABLES["latin"])
        usual, marked = NAME_LETTERS.get(script, NAME_LETTERS["latin"])
        kind = next((k for k, letters in enumerate((usual, usual + marked)) if all(c in letters for c in low)), 2)
        base, place = ((len(usual), usual.index), (len(usual + marked), (usual + marked).index), (0x110000, ord))[kind]
        n = 0
        for c in low:
            n = n * base + place(c) + 1  # numbers words of all lengths without a gap
        size = 2
        while len(syllables) ** size * 2 <= n:
            size += 1
        size += attempt
        n = self.permute(n, len(syllables) ** (size // 2), len(syllables) ** (size - size // 2) * 2, ("name", role, script, kind, size, attempt))
        n, last = divmod(n, 2)
        out = ""
        for _ in range(size):
            n, i = divmod(n, len(syllables))
            out += syllables[i]
        out += endings[role][2 * kind + last]
        return out.upper() if word.isupper() and len(word) > 1 else out[0].upper() + out[1:]


@lru_cache(10_000)
def block_of(c: str) -> str | None:
    """The letters of the block that a character belongs to."""
    return next(("".join(map(chr, range(a, b + 1))) for a, b in BLOCKS if a <= ord(c) <= b), None)


def digits_like(c: str) -> str:
    """The ten digits of the script that a decimal digit belongs to."""
    return "".join(chr(ord(c) - int(c) + k) for k in range(10))


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_check(land: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + land + '00')) % 97:02d}"


def script_of(word: str) -> str:
    if any("\u0400" <= c <= "\u04ff" for c in word):
        return "cyrillic"
    if any("\u0370" <= c <= "\u03ff" for c in word):
        return "greek"
    return "latin" if any("a" <= c <= "z" or "\u00df" <= c <= "\u024f" for c in word.lower()) else "other"


def find(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities of a text in order; the gender is of a name's title (n: none that tells).

    Names are found after a title, at a letter's begin and end, where people say
    them, and where the text has the two names of an e-mail address with capitals.
    """
    found = list(_spelt(text))
    mailed = {_mailed(text[x:y]) for x, y, kind, _ in found if kind == "email"} - {None}
    if mailed:
        ends = [e[1] for e in found]
        last, more = None, []
        for m in _CAPITALS.finditer(text):
            if last and text[last.end() : m.start()] in (" ", ", ") and not mailed.isdisjoint({(_plain(last[0]), _plain(m[0])), (_plain(m[0]), _plain(last[0]))}):
                i = bisect_right(ends, last.start())
                if i == len(found) or found[i][0] >= m.end():
                    more.append((last.start(), m.end(), "name", "n"))
                    last = None
                    continue
            last = m
        found = sorted([*found, *more])
    yield from found


def _plain(word: str) -> str:
    """A name word as e-mail addresses have it: lower case, without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


def _mailed(address: str) -> tuple[str, str] | None:
    """The first and last of the names in an e-mail address."""
    parts = re.split(r"[._-]", address.partition("@")[0].casefold())
    return (parts[0], parts[-1]) if len(parts) > 1 and all(p.isalpha() for p in parts) and min(len(parts[0]), len(parts[-1])) > 1 else None


def _spelt(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in PATTERN.finditer(text):
        kind = m.lastgroup
        if kind in _NAME_KINDS:
            title = _NAME_KINDS[kind]
            yield m.start(kind), m.end(kind), "name", _GENDER[m[title].strip().rstrip(".")] if title else "n"
        elif kind == "secret":
            yield m.start("secret"), m.end("secret"), "secret", ""
        elif kind != "card" or luhn(re.sub(r"\D", "", m[0])):  # a card's number has a check digit
            yield m.start(), m.end(), kind, ""


def name_words(text: str, gender: str) -> Iterator[tuple[int, str, str]]:
    """(start, role, word) of the words of a name: the last is the family name (n), those before are given names (m or f, g if the title does not tell). Initials have the role i; particles are left out."""
    found = [m for m in _PARTS.finditer(text) if m["initial"] or not (m[0].upper() != m[0] == m[0].lower() or (len(m[0]) == 1 and text[m.end() : m.end() + 1] in ("'", "’")))]
    full = [m for m in found if not m["initial"]]
    for m in found:
        yield m.start(), "i" if m["initial"] else "n" if m is full[-1] else "g" if gender == "n" else gender, m[0]


def settled_role(word: str, roles: list[str]) -> str:
    """One role for all mentions of a word in a document: a given name by the first title that tells its gender, else by its ending, else a family name."""
    given = [r for r in roles if r in "mf"]
    if given:
        return given[0]
    if "g" in roles:
        return "f" if word.lower()[-1] in FEMININE_ENDINGS else "m"
    return "n"


def entities(text: str, roles_of: dict[str, str] | None = None) -> list[tuple[int, int, str, list[tuple[int, str, str]]]]:
    """(start, end, kind, name words) of all entities in order: those of the pattern, and all other mentions of the names in it.

    A name word has one role in the whole document, whatever the title it
    stands after: that of ``roles_of`` where the corpus has it in several.
    """
    out, told = [], {}
    for start, end, kind, gender in find(text):
        named = list(name_words(text[start:end], gender)) if kind == "name" else []
        out.append((start, end, kind, named))
        for _, role, word in named:
            told.setdefault(word.lower(), []).append(role)
    one = {low: (roles_of or {}).get(low) or settled_role(low, rs) for low, rs in told.items()}
    out = [(x, y, kind, [(at, "i" if r == "i" else one[w.lower()], w) for at, r, w in named]) for x, y, kind, named in out]
    roles = {}
    for _, _, _, named in out:
        for _, role, word in named:
            if role != "i" and len(word) > 1 and word.lower() not in COMMON:
                roles.update(dict.fromkeys((word, word.upper(), word.capitalize()), role))
    if not roles:
        return out
    word = f"(?:{'|'.join(map(re.escape, sorted(roles, key=len, reverse=True)))})(?![^\\W_]|[\u0300-\u036f])"
    ends, more = [x[1] for x in out], []
    for m in re.finditer(rf"(?<![^\W_])(?<![\u0300-\u036f]){word}(?:[ -]{word})*", text):
        if m[0].lower() in AMBIGUOUS and _ordinary(text, m.start(), m.end()):
            continue
        for w in re.finditer(word, m[0]):
            x, y = m.start() + w.start(), m.start() + w.end()
            i = bisect_right(ends, x)
            if i == len(out) or out[i][0] >= y:
                if more and more[-1][1] + 1 == x and text[more[-1][1]] in " -":
                    start, _, kind, named = more[-1]
                    named.append((x - start, roles[w[0]], w[0]))
                    more[-1] = (start, y, kind, named)
                else:
                    more.append((x, y, "name", [(0, roles[w[0]], w[0])]))
    return sorted([*out, *more], key=lambda e: e[0])


def _ordinary(text: str, start: int, end: int) -> bool:
    """Whether a word stands at a sentence's start, or before another word with a capital."""
    before = text[max(0, start - 3) : start].rstrip(" ")
    return (before[-1:] in ".!?:\n\"“" if before else start < 3) or re.match(rf" {_WORD}", text[end : end + 80]) is not None


def replace(text: str, keyed: Keyed) -> tuple[str, list[dict]]:
    """The text with surrogates, and their kinds and places in it."""
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, named in entities(text, keyed.roles):
        old = text[start:end]
        if kind == "name":
            new, last = "", 0
            for place, role, word in named:
                new += old[last:place] + (keyed.initial(word) if role == "i" else keyed.name_word(role, word))
                last = place + len(word)
            new += old[last:]
        else:
            new = keyed.surrogate(kind, old)
        out += [text[at:start], new]
        size += start - at
        spans.append({"kind": kind, "start": size, "length": len(new)})
        size += len(new)
        at = end
    return "".join([*out, text[at:]]), spans


def _maybe(column: pa.Array) -> list[bool]:
    return pc.match_substring_regex(column, _MAYBE).to_pylist()


def names_of(df: DataFrame, text_col: str) -> DataFrame:
    """The distinct name words of all texts: role by the title (g or n without one), script, word (lower case), and how often; not yet settled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            titled = pc.match_substring_regex(column, _NAMED)
            found = Counter(
                (role, script_of(word), word.lower())
                for text in column.filter(titled).to_pylist()
                for start, end, kind, gender in find(text)
                if kind == "name"
                for _, role, word in name_words(text[start:end], gender)
                if role != "i"
            )
            rows = sorted(found.items())
            columns = [pa.array([r[k] for r, _ in rows], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in rows], pa.int64())], ["role", "script", "word", "n"])

    counted = df.select(utf8(text_col).alias("t")).mapInArrow(scan, "role string, script string, word string, n bigint")
    return counted.groupBy("role", "script", "word").agg(F.sum("n").alias("n"))


def settled_roles(names: DataFrame) -> DataFrame:
    """One role for each name word of the corpus, and in how many roles texts have it.

    A given name by the titles that tell its gender, by the greater number of
    them (f if equal), else by its ending; a family name if no text has it before
    another word. So a lone word after a title is the given name that it is elsewhere.
    """
    n = {r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0)) for r in "mfgn"}
    told = names.groupBy("script", "word").agg(*[c.alias(r) for r, c in n.items()])
    ending = F.when(F.substring("word", -1, 1).isin(*FEMININE_ENDINGS), "f").otherwise("m")
    role = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > 0, "f").when(F.col("g") > 0, ending).otherwise("n")
    kinds = sum(((F.col(r) > 0).cast("int") for r in "mfgn"), F.lit(0))
    return told.select(role.alias("role"), "script", "word", kinds.alias("kinds"))


def settle_names(names: DataFrame, key: str) -> Keyed:
    """Surrogates for all name words, checked for collisions.

    A word has one role in the whole corpus, so a person keeps one name over
    all documents. Distinct words can't share a surrogate, whatever their
    roles; one that is itself a name word of the corpus, or that several words
    share, moves on to the next attempt, all but the first by order. Every
    attempt takes another syllable, so there are ever more surrogates and the rounds
    end. The check is a grouped count and a join; only the words that moved, and those that
    texts have in several roles, come to the driver.
    """
    scratch: list[str] = []
    settled = materialize(settled_roles(names), "names", scratch)
    roles = {r["word"]: r["role"] for r in settled.filter("kinds > 1").select("word", "role").collect()}
    names = settled.select("role", "script", "word")
    real = names.select("script", F.col("word").alias("made"), F.lit(True).alias("hits"))
    moved: dict[tuple[str, str, str], int] = {}
    while True:
        made = _surrogates(names, key, moved)
        shared = made.groupBy("script", "made").agg(F.count("*").alias("n"), F.min("word").alias("first")).filter("n > 1")
        wrong = made.join(shared, ["script", "made"], "left").join(real, ["script", "made"], "left")
        wrong = wrong.filter(F.col("hits") | (F.col("n").isNotNull() & (F.col("word") != F.col("first")))).select("role", "script", "word").collect()
        if not wrong:
            remove(names.sparkSession, scratch[0])
            return Keyed(key, moved, roles)
        for r in wrong:
            moved[tuple(r)] = moved.get(tuple(r), 0) + 1


def _surrogates(names: DataFrame, key: str, moved: dict[tuple[str, str, str], int]) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(key, moved)
        for batch in batches:
            rows = batch.to_pylist()
            made = pa.array([keyed.name_word(r["role"], r["word"]).lower() for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], ["role", "script", "word", "made"])

    return names.mapInArrow(make, "role string, script string, word string, made string")


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", spans_col: str | None = "pii_spans") -> DataFrame:
    """Replace the entities in ``text_col`` and, unless it is None, add ``spans_col``.

    Spans give kind, start and length of each surrogate in the new text, in
    code points. One pass collects the distinct name words (few beside the
    texts), a second replaces; texts are not shuffled. A null text stays null
    and has no spans; an empty table gives none. Texts of any length are searched whole. Of two entities that
    overlap the one that starts first counts, then the kind named first in the pattern. Repeated rows are
    rows like any other, with the same surrogates. Other columns stay; one that
    has the name ``spans_col`` is replaced.
    """
    if spans_col:
        df = df.drop(spans_col)
    keyed = settle_names(names_of(df, text_col), key)
    args = (key, keyed.moved, keyed.roles)
    kept = df.schema.fields

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Keyed(*args)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            maybe = _maybe(batch.column(at))
            texts, spans = [], []
            for value, may in zip(batch.column(at), maybe, strict=True):
                text, found = replace(value.as_py(), own) if may else (value.as_py(), [])
                texts.append(text)
                spans.append(found)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            names = batch.schema.names
            if spans_col:
                columns.append(pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))))
                names = [*names, spans_col]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    if spans_col:
        schema += f", `{spans_col}` array<struct<kind:string,start:int,length:int>>"
    return df.mapInArrow(apply, schema)


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data, and where these are."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonymize(docs, DEMO_KEY, spans_col="spans")
    return done.select("doc_id", "text", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_entities"), "spans")
