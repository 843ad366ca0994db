"""PII surrogates: detected entities get keyed, type-consistent replacements.

A replacement keeps what a reader or a model could rely on: the kind of entity, its format (digits
stay digits, separators stay), its script and letter case, and, for names, the gender. The same
entity gets the same replacement in every document, different ones never share one, and none is its
own, unless a very short name leaves no other; no table has to be shared for that:
- formats (phones, cards, addresses, keys) go through a keyed cycle over all strings of their format;
  where a format has check digits, the walk goes on until they hold;
- listed given names go round a keyed cycle of the names of their gender and script;
- other names go through a keyed cycle over the names of their shape (vowels, consonants, case),
  with the ending that tells gender kept: Иванов and Иванова stay one family.
Parts of a name stand for the whole: "Anna Weber", "Anna" and "Weber" stay one person.

Names are found by titles, by listed given names before a capitalised word, and by the phrases and
labels that introduce one. Lower-case names and names in scripts without case are not found.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from tokenloom.llm.common import batch_of, kind_of
from tokenloom.session import ship_package

# Given names by gender and script, family names by script, titles by gender.
GIVEN = {
    ("f", "latin"): "Alice Anna Carla Clara Elena Emma Eva Hanna Helena Ida Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Teresa Vera".split(),
    ("m", "latin"): "Adam Albert Anton Bruno Carlos David Emil Erik Felix Hugo Ivan Jan Jonas Karl Leo Louis Lukas Marco Martin Max Oscar Pablo Paul Peter Simon Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга София Татьяна".split(),
    ("m", "cyrillic"): "Алексей Антон Борис Виктор Дмитрий Иван Михаил Николай Олег Павел".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
# Further common given names by gender; like those above they are signs of a name.
MORE_GIVEN = {
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Michelle Amanda Melissa Rebecca Fatima Amina Aisha Priya Ana Carmen Isabel Chloe Camille Sophie Charlotte Amelia Grace Hannah Olivia Ingrid Astrid Zeynep Leila".split(),
    "m": "James John Robert Michael William Richard Joseph Charles Christopher Daniel Matthew Anthony Mark Donald Steven Andrew Kenneth Joshua Kevin Brian George Edward Ronald Timothy Jason Ryan Jacob Eric Stephen Jonathan Justin Brandon Benjamin Samuel Gregory Frank Alexander Patrick Henry Ahmed Mohammed Ali Omar Raj Wei Hiroshi Juan José Luis Diego Pierre Jean Hans Klaus Stefan Giovanni Piotr Lars Sven Mehmet".split(),
}
#: Endings of family names that tell gender or origin; they stay.
ENDINGS = re.compile("(?:ск(?:ий|ая)|[оеё]ва?|ина?|ου|ski|ska|ová|ova?)$")
# Letters that may replace each other in a name, by script.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")
NAME_LETTERS = {c: group for low in LETTERS for group in (low, low.upper()) for c in group}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Dr": ""}

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ROUNDS = 8


class Permutation:
    """A keyed cycle through all strings that have one shape: each place keeps its alphabet.

    A Feistel network over two halves of the string seen as mixed-radix numbers puts the strings in
    a keyed order; the image is the next in that order. So no two strings of a shape share an image,
    and none is its own. A different key is derived for each kind and shape.
    """

    def __init__(self, key: bytes):
        self.key = key

    def _draw(self, label: bytes, round_no: int, value: int, below: int) -> int:
        data = label + bytes([round_no]) + value.to_bytes((value.bit_length() + 8) // 8, "big")
        return int.from_bytes(hmac.digest(self.key, data, sha256), "big") % below

    def apply(self, kind: str, places: list[tuple[str, str | list[str]]]) -> list[str]:
        """`places`: (character or part, its alphabet). Returns those that take their place."""
        radix = [len(alphabet) for _, alphabet in places]
        if not radix or max(radix) == 1:
            return [c for c, _ in places]
        label = f"{kind}|{','.join(map(str, radix))}|".encode()
        half = max(1, len(radix) // 2)
        sizes = [_product(radix[:half]), _product(radix[half:])]
        values = [alphabet.index(c) for c, alphabet in places]
        parts = [_number(values[:half], radix[:half]), _number(values[half:], radix[half:])]
        for r in range(ROUNDS):
            side = r % 2
            parts[side] = (parts[side] + self._draw(label, r, parts[1 - side], sizes[side])) % sizes[side]
        following = (parts[0] * sizes[1] + parts[1] + 1) % (sizes[0] * sizes[1])
        parts = list(divmod(following, sizes[1]))
        for r in reversed(range(ROUNDS)):
            side = r % 2
            parts[side] = (parts[side] - self._draw(label, r, parts[1 - side], sizes[side])) % sizes[side]
        out = _digits(parts[0], radix[:half]) + _digits(parts[1], radix[half:])
        return [alphabet[v] for v, (_, alphabet) in zip(out, places, strict=True)]


def _product(radix: list[int]) -> int:
    total = 1
    for r in radix:
        total *= r
    return total


def _number(values: list[int], radix: list[int]) -> int:
    total = 0
    for v, r in zip(values, radix, strict=True):
        total = total * r + v
    return total


def _digits(total: int, radix: list[int]) -> list[int]:
    out = []
    for r in reversed(radix):
        total, v = divmod(total, r)
        out.append(v)
    return out[::-1]


def alphabet_of(c: str, hexadecimal: bool = False) -> str | None:
    """The characters that may replace `c`, or None if it stays."""
    if c in DIGITS:
        return DIGITS + "abcdef" if hexadecimal else DIGITS
    if hexadecimal and c in "abcdef":
        return DIGITS + "abcdef"
    return LOWER if c in LOWER else UPPER if c in UPPER else None


def permute(permutation: Permutation, kind: str, text: str, movable: Callable[[int, str], str | None], accept=lambda s: True) -> str:
    """`text` with its movable characters permuted; walks on until `accept` holds.

    `accept` must hold for `text` itself: then the walk is a permutation of the accepted strings and
    ends, at the latest where it comes back to `text`.
    """
    at = [(i, a) for i, c in enumerate(text) if (a := movable(i, c))]
    current = text
    while True:
        moved = permutation.apply(kind, [(current[i], a) for i, a in at])
        chars = list(current)
        for (i, _), c in zip(at, moved, strict=True):
            chars[i] = c
        current = "".join(chars)
        if accept(current):
            return current


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c in DIGITS]
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def octets(text: str) -> bool:
    parts = text.split(".")
    return all(str(int(p)) == p and int(p) < 256 for p in parts)


def iban_check(country: str, account: str) -> str:
    """The two check digits that belong to an account number."""
    digits = "".join(str(int(c, 36)) for c in account.replace(" ", "") + country) + "00"
    return f"{98 - int(digits) % 97:02d}"


#: The octets of one, two and three digits.
OCTETS = {1: [str(i) for i in range(10)], 2: [str(i) for i in range(10, 100)], 3: [str(i) for i in range(100, 256)]}


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str


#: Detectors in order of precedence; a later one does not cut into an earlier find.
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)+", re.A)),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END")),
    ("service_key", re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_|github_pat_|glpat-|xox[abpr]-|sk_live_|sk-|AIza)(?=[A-Za-z_-]*[0-9])([A-Za-z0-9_-]{16,})")),
    ("aws_key", re.compile(r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-./+]{8,})")),
    ("hex_key", re.compile(r"(?<![A-Za-z0-9])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])")),
    ("ip", re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\d]|\.\d)", re.A)),
    ("ipv6", re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[23Ff][0-9A-Fa-f]{3}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A)),
    ("card", re.compile(r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])", re.A)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)),
    ("phone", re.compile(r"(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?![\w-])", re.A)),
    ("phone", re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp)\b[.:]?[ ](?:me |us )?(?:at |on )?(\d{7,12})(?![\w-])", re.A)),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)", re.A)),
    ("phone", re.compile(r"(?<![\w+])\+\d[\d .-]{7,16}\d(?!\w)", re.A)),
]
_WORD = "[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ][a-zß-öø-ÿа-яёα-ωάέήίόύώς]+"
_CAPITAL = rf"(?:[OD]['’])?{_WORD}(?:(?<=Mc){_WORD}|-{_WORD})?"
_PERSON = rf"\b(?P<first>{_CAPITAL})(?:[ ](?:[A-Z]\.[ ])?(?P<last>{_CAPITAL}))"
NAME = re.compile(rf"(?:\b(?P<title>{'|'.join(TITLES)})\.?[ ])?{_PERSON}?")
CAPITAL = re.compile(_CAPITAL)
#: Phrases and labels before a full name.
INTRODUCED = re.compile(rf"(?:\b(?i:my name is|signed by|written by|sincerely,|regards,|attn:|author:|name:|patient:|customer:|employee:))\s+{_PERSON}")


DIGIT = re.compile("[0-9]")


def find_entities(text: str) -> list[Entity]:
    """Entities of fixed formats, without overlaps, in text order."""
    taken: list[Entity] = []
    # A detector scans only texts with its signs; those not named here need a digit.
    has_digit = DIGIT.search(text) is not None
    has_sign = {"email": "@" in text, "aws_key": "AKIA" in text or "ASIA" in text, "secret": ":" in text or "=" in text}
    has_sign |= {"private_key": "PRIVATE KEY" in text, "ipv6": has_digit and ":" in text}
    for kind, pattern in PATTERNS:
        if not has_sign.get(kind, has_digit):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1) if pattern.groups else m.span()
            if kind == "card" and sum(c in DIGITS for c in text[start:end]) not in range(13, 20):
                continue
            if kind == "ipv6" and not is_ipv6(text[start:end]):
                continue
            if all(end <= e.start or start >= e.end for e in taken):
                taken.append(Entity(start, end, kind))
    return sorted(taken, key=lambda e: e.start)


def is_ipv6(text: str) -> bool:
    try:
        return ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


class Surrogates:
    """Replacements of one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.permutation = Permutation(key)
        self.order: dict[str, str] = {}

    def replace(self, kind: str, text: str) -> str:
        """The replacement of an entity of a fixed format."""
        move = getattr(self, f"_{kind}", self._plain)
        return move(kind, text)

    def _plain(self, kind: str, text: str) -> str:
        return permute(self.permutation, kind, text, lambda i, c: alphabet_of(c))

    def _email(self, kind: str, text: str) -> str:
        at = text.index("@")
        domain, _, suffix = text[at + 1 :].rpartition(".")
        # The last label stays: it tells the country or kind. Equal domains stay equal.
        local = permute(self.permutation, f"local@{text[at + 1:]}", text[:at], lambda i, c: alphabet_of(c))
        return f"{local}@{permute(self.permutation, 'domain', domain, lambda i, c: alphabet_of(c))}.{suffix}"

    def _aws_key(self, kind: str, text: str) -> str:
        return text[:4] + permute(
            self.permutation, kind, text[4:], lambda i, c: UPPER + DIGITS if c in UPPER + DIGITS else None
        )

    def _hex_key(self, kind: str, text: str) -> str:
        return permute(self.permutation, kind, text, lambda i, c: alphabet_of(c, True))

    def _secret(self, kind: str, text: str) -> str:
        if re.fullmatch(r"[0-9a-f]{8,}", text):
            return self._hex_key(kind, text)
        return self._plain(kind, text)

    def _ip(self, kind: str, text: str) -> str:
        return ".".join(self.permutation.apply(kind, [(part, OCTETS[len(part)]) for part in text.split(".")]))

    def _card(self, kind: str, text: str) -> str:
        # The first digit tells the network. Valid numbers stay valid, others stay invalid.
        valid, first = luhn(text), text.index(next(c for c in text if c in DIGITS))
        return permute(
            self.permutation, kind, text, lambda i, c: DIGITS if c in DIGITS and i != first else None,
            lambda s: luhn(s) == valid,
        )

    def _iban(self, kind: str, text: str) -> str:
        country, check, account = text[:2], text[2:4], text[4:]
        if check == iban_check(country, account):
            new = permute(self.permutation, f"{kind}{country}", account, lambda i, c: alphabet_of(c))
            return country + iban_check(country, new) + new
        # Invalid numbers stay invalid.
        return country + permute(
            self.permutation, kind, text[2:], lambda i, c: alphabet_of(c),
            lambda s: s[:2] != iban_check(country, s[2:]),
        )

    def _ipv6(self, kind: str, text: str) -> str:
        # The first digit tells the kind of network; a group without leading zero stays so.
        hexadecimal = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
        if any(c not in hexadecimal and c != ":" for c in text):
            return self._ipv6(kind, text.lower()).upper()

        def movable(i: int, c: str) -> str | None:
            if i == 0 or c == ":":
                return None
            begins = text[i - 1] == ":" and text[i + 1 : i + 2] not in ("", ":")
            return hexadecimal if not begins else "0" if c == "0" else hexadecimal[1:]

        return permute(self.permutation, kind, text, movable, is_ipv6)

    def _private_key(self, kind: str, text: str) -> str:
        # Piece by piece: numbers as long as a whole key would be slow.
        pieces = [text[i : i + 64] for i in range(0, len(text), 64)]
        return "".join(self._plain(f"{kind}{i}", piece) for i, piece in enumerate(pieces))

    def _phone(self, kind: str, text: str) -> str:
        # The country code stays.
        code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        start = code.end() if code else 0
        return text[:start] + permute(self.permutation, kind, text[start:], lambda i, c: DIGITS if c in DIGITS else None)

    def given_name(self, name: str) -> str:
        """Listed names go round their list; each part of a double name by itself."""
        parts = name.split("-")
        if any(p in _GENDER for p in parts):
            return "-".join(self._listed(p) if p in _GENDER else self._shaped("given", p, len(p) - 1) for p in parts)
        # The last letter tells gender more often than any other.
        return self._shaped("given", name, len(name) - 1)

    def family_name(self, name: str) -> str:
        return self._shaped("family", name, _stem(name))

    def _listed(self, name: str) -> str:
        if not self.order:
            for group, names in POOLS.items():
                ranked = sorted(names, key=lambda n: hmac.digest(self.key, f"given|{n}".encode(), sha256))
                self.order |= dict(zip(ranked, ranked[1:] + ranked[:1], strict=True))
        return self.order[name]

    def _shaped(self, kind: str, name: str, end: int) -> str:
        """The letters before `end` move; the result parses as the name does, so no two names meet."""
        ending = name[end:]

        def accept(stem: str) -> bool:
            new = stem + ending
            return new not in _GENDER if kind == "given" else _stem(new) == end

        return permute(self.permutation, kind, name[:end], lambda i, c: NAME_LETTERS.get(c), accept) + ending


def _stem(family: str) -> int:
    """Where the ending of a family name begins."""
    ending = ENDINGS.search(family)
    return ending.start() if ending and ending.start() > 1 else len(family)


POOLS = {g: [*names, *(MORE_GIVEN[g[0]] if g[1] == "latin" else ())] for g, names in GIVEN.items()}
_GENDER = {name: gender for (gender, _), names in POOLS.items() for name in names}
_ANCHORS = _GENDER.keys() | TITLES.keys()
NO_LETTERS = re.compile(r"[\W\d_]+")


#: Capitalised words that are no family name after a given name.
NO_FAMILY = set("And As At But By For From Had Has He In Is It Of On Or She That The They This To Was We When Who Will With You".split())


def _people(text: str) -> Iterator[tuple[str, str]]:
    """(part, name) of all who are named with a title, a listed given name or an introduction."""
    at = 0
    while m := NAME.search(text, at):
        title, first, last = m["title"], m["first"], m["last"]
        at = m.end()
        listed = first.split("-")[0] in _GENDER
        if title and not last:
            yield "family", first
        elif last and last not in NO_FAMILY and (title or listed):
            yield "given", first
            yield "family", last
        elif last:
            # The second word may begin a name.
            at = m.start("last")
    for m in INTRODUCED.finditer(text):
        if m["first"] not in TITLES and m["last"] not in NO_FAMILY:
            yield "given", m["first"]
            yield "family", m["last"]


def find_names(text: str) -> list[tuple[int, int, str]]:
    """(start, end, part): given and family names; later mentions of a person's parts are found too."""
    if _ANCHORS.isdisjoint(NO_LETTERS.split(text)) and not INTRODUCED.search(text):
        return []
    parts: dict[str, str] = {}
    for part, name in _people(text):
        if parts.get(name) != "given":
            parts[name] = part
    found = ((m.start(), m.end(), parts.get(m.group())) for m in CAPITAL.finditer(text)) if parts else ()
    return [(start, end, part) for start, end, part in found if part and text[start:end] not in TITLES]


def anonymise(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[str, int]]]:
    """The text with replacements, and (kind, how many) of what was found; null stays null."""
    if not text:
        return text, []
    found = [(e.start, e.end, e.kind) for e in find_entities(text)]
    formats = list(found)
    for start, end, part in find_names(text):
        if all(end <= a or start >= b for a, b, _ in formats):
            found.append((start, end, part))
    out, last, counts = [], 0, {}
    images: dict[tuple[str, str], str] = {}
    for start, end, kind in sorted(found):
        own = text[start:end]
        if kind == "given":
            new = surrogates.given_name(own)
        elif kind == "family":
            new = surrogates.family_name(own)
        else:
            new = surrogates.replace(kind, own)
        # The permutations cannot collide; a collision here would be a fault, never output.
        if images.setdefault((kind, new), own) != own:
            raise RuntimeError(f"two {kind} entities of a document share a replacement")
        counts[kind] = counts.get(kind, 0) + 1
        out += [text[last:start], new]
        last = end
    return "".join([*out, text[last:]]), sorted(counts.items())


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document row: doc_id, text (with surrogates), n_entities, kinds (kind, n)."""
    ship_package(docs.sparkSession)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [anonymise(text, surrogates) for text in batch["text"].to_pylist()]
                yield batch_of(
                    {
                        "doc_id": batch["doc_id"],
                        "text": [text for text, _ in found],
                        "n_entities": [sum(n for _, n in kinds) for _, kinds in found],
                        "kinds": [[{"kind": k, "n": n} for k, n in kinds] for _, kinds in found],
                    },
                    text=pa.string(), n_entities=pa.int64(),
                    kinds=pa.list_(pa.struct([("kind", pa.string()), ("n", pa.int64())])),
                )

    schema = f"doc_id {kind_of(docs, 'doc_id')}, text string, n_entities long, kinds array<struct<kind:string,n:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(replace, schema)
