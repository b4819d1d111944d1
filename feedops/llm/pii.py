"""Personal data replaced by surrogates that keep type, gender, script and format.

Detected: e-mail addresses, phone numbers, card and account numbers, IP addresses, secrets, names after a title, and every
further whole-word mention of such a name in the same document. A row of 13 to 19 digits is a card number if its check digit
is right or a word for a card stands before it; an account number must pass its remainder test or follow its name. A private
key without an end line goes up to where its characters end. An entity is its kind and normal form (letter case, separators and titles do not count), so every mention of it, in any
document and any notation, gets the same surrogate (coreference). The surrogate is drawn from a keyed hash of the entity and
then written in the notation of the mention: digits into its digits, words into its letter case.

Distinctness is checked over the whole corpus: the distinct entities are shuffled by surrogate; where two meet, or a surrogate
is itself an entity of the corpus, all but the first draw again, until none meets; given names count like all others. The space of the draws grows with every
attempt, past the mention's own length if need be, so this ends. Only the redrawn entities (few: draws are from large spaces)
have to be known when texts are rewritten; they are broadcast in slices of fixed size.

Null and empty texts stay. Overlapping matches: the leftmost, then the earlier kind wins. Repeated rows are rewritten alike;
other columns, whatever their names, are passed through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedops.llm.common import each_slice, keep

# Titles by gender, given names and word parts by script.
MALE_TITLES = ("Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "господин", "г-н", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Mlle", "Mademoiselle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Signora", "госпожа", "г-жа", "κυρία")
OPEN_TITLES = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Doctor", "Doctora", "доктор")
GIVEN = {
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Lucas", "Marco", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irma", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Sofia"),
    ("latin", "x"): ("Alexis", "Andrea", "Charlie", "Dominique", "Kim", "Robin", "Sascha", "Toni"),
    ("cyrillic", "m"): ("Андрей", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел"),
    ("cyrillic", "f"): ("Алла", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "София"),
    ("cyrillic", "x"): ("Саша", "Женя", "Валя", "Шура"),
    ("greek", "m"): ("Αλέξης", "Γιώργος", "Νίκος", "Πέτρος"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "x"): ("Άγγελος", "Χάρις"),
}
PARTS = {
    "latin": ("ba", "ber", "bo", "cor", "da", "den", "fal", "fen", "gar", "hal", "ken", "lan", "lor", "mar", "mel", "nor", "pel", "ran", "ros", "sal", "ter", "tor", "val", "win"),
    "cyrillic": ("бар", "вел", "гор", "дан", "кор", "лас", "мар", "нов", "пол", "рад", "сав", "тур"),
    "greek": ("βαρ", "δημ", "θεο", "καλ", "λαμ", "μαν", "παπ", "σταυ"),
}
ENDINGS = {
    "latin": {"m": ("son", "mann", "ard", "ell"), "f": ("son", "mann", "ard", "ell"), "x": ("son", "mann", "ard", "ell")},
    "cyrillic": {"m": ("ов", "ин"), "f": ("ова", "ина"), "x": ("енко", "юк")},
    "greek": {"m": ("ίδης", "όπουλος"), "f": ("ίδου", "οπούλου"), "x": ("άκη", "έα")},
}
#: Endings of given names that are put together, so that those of different genders never meet.
GIVEN_ENDINGS = {
    "latin": {"m": "o", "f": "a", "x": "i"},
    "cyrillic": {"m": "ий", "f": "ия", "x": "и"},
    "greek": {"m": "ος", "f": "ία", "x": "ι"},
}
# Words before a number that name its kind.
CARD_WORDS = ("card", "cards", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta", "carta", "карта", "карты", "κάρτα")
ACCOUNT_WORDS = ("iban", "account", "konto", "kontonummer", "compte", "cuenta", "conto", "счёт", "счет", "λογαριασμός")
#: Parts of a family name at the first draw; each further attempt takes one more.
FIRST_PARTS = {"latin": 4, "cyrillic": 4, "greek": 5}
#: Attempts in the length of the mention; later ones grow by a character each.
SAME_LENGTH = 4
MARKS = "!#$%&*+-=?@^_~"
KINDS = ("key", "email", "secret", "iban", "card", "ipv4", "ipv6", "phone", "ssn", "name")


def _titles() -> str:
    every = sorted({*MALE_TITLES, *FEMALE_TITLES, *OPEN_TITLES}, key=len, reverse=True)
    return "|".join(map(re.escape, every))


_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
PATTERNS = (
    r"(?P<key>-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN ).)*?-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*[A-Za-z-]+: [^\n]*\n)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})+(?:(?:\s|\\[nr])*[A-Za-z0-9+/]+={1,2}|\r?\n[A-Za-z0-9+/]+(?=\s*(?:\n|\Z)))?))",
    r"(?P<email>(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:[\w-]+\.)+[^\W\d_]{2,})",
    r"(?P<secret>(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[pousr]_\w{30,}|(?<!\w)sk-[\w-]{20,}|(?<!\w)eyJ[\w-]{10,}\.[\w-]{5,}\.[\w-]{5,}"
    r"|(?<!\w)(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"
    r"|(?:(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?)(?:[\"'](?P<quoted>[^\s\"']{6,})(?=[\"'])"
    r"|(?P<bare>(?=[^\s\"']*\d)[\w!@#$%^&*+/=.~-]{5,}\w)|(?<==)(?P<plain>[\w!@#$%^*+/.~-]{5,}\w)(?![\w(])))",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?!\w))",
    r"(?P<card>(?<![\d.])(?:(?P<run>\d{13,19})|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<wide>[ -])\d{6}(?P=wide)\d{5})(?![\d]))",
    r"(?P<ipv4>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))",
    r"(?P<ipv6>(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[a-fA-F:]*\d)[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?)(?![\w:]|\.\d))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
    # national groupings; not inside longer rows of numbers
    r"|(?<![\w+.,/-])(?<!\d )(?:[2-9]\d{2} \d{3} \d{4}|(?=(?:\D?\d){9,12}(?!\d))(?:0\d{2,4}[ /-]\d{3,4}[ -]\d{3,4}|0\d{2,4}[ /-]\d{5,8})|0\d(?:(?: \d{2}){4}|(?:\.\d{2}){4}))(?![\w/-]|[.,]\d| \d))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    rf"(?P<name>(?<!\w)(?P<title>{_titles()})\.?[ ](?P<who>{_CAPITAL}(?:[ ]{_CAPITAL})?))",
)
PATTERN = "|".join(PATTERNS)
#: A text without any of these holds no entity: two searches that start at few characters, as a look-behind would not.
GATES = (r"[0-9@=:]|PRIVATE KEY", rf"(?:{_titles()})\.? ")


def _after(words: tuple[str, ...]) -> Callable[[str], re.Match | None]:
    """Finds one of the words, perhaps with "number" or the like behind it, at the end of a text."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?:[ ]?(?:no|nr|num|number|nummer|n°))?[\s.:#=\"'-]{{1,4}}\Z", re.IGNORECASE).search


_card_word, _account_word = _after(CARD_WORDS), _after(ACCOUNT_WORDS)
#: Characters before a number that are searched for the word that names it.
WORD_REACH = 32


def stands(match: re.Match) -> bool:
    """Whether a match is what its form says: numbers with check digits have to pass or be named."""
    if match.group("run") is not None:
        number, named = match.group("run"), _card_word
        passes = luhn(number[:-1]) == int(number[-1])
    elif match.group("iban") is not None:
        number, named = match.group("iban").replace(" ", ""), _account_word
        passes = remainder(number) == 1
    else:
        return True
    return passes or named(match.string[max(0, match.start() - WORD_REACH):match.start()]) is not None


def remainder(account: str) -> int:
    """Remainder by 97 of an account number with its first four characters moved behind and letters as numbers from 10."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def script_of(word: str) -> str:
    first = word[:1]
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


class Mention:
    """One match: the entities in it (kind, normal form) and how their surrogates are written."""

    def __init__(self, match: re.Match):
        held = match.groupdict()
        kind = next(k for k in KINDS if held.get(k) is not None)
        text = match.group(kind)
        self.start, self.stop = match.span(kind)
        self.keys: list[tuple[str, str]] = []
        if kind == "name":
            self.start, self.stop = match.span("who")
            words = match.group("who").split(" ")
            title = match.group("title")
            gender = "m" if title in MALE_TITLES else "f" if title in FEMALE_TITLES else "x"
            kinds = [f"given-{script_of(words[0])}-{gender}"] * (len(words) - 1) + [f"family-{script_of(words[-1])}"]
            self.keys = [(k, w.lower()) for k, w in zip(kinds, words)]
            self.parts = [(key, word, gender) for key, word in zip(self.keys, words)]
            self.write = lambda cores: " ".join(_cased(_gendered(core, *key, gender), word) for core, key, word in zip(cores, self.keys, words))
        elif kind == "phone":
            country = re.match(r"\+(\d{1,3})(?=[ .(-])|(0)", text)
            head = country.end() if country else 0
            code = country.group(1) or country.group(2) if country else "" if text.startswith("+") else "1"
            self.keys = [("phone", f"{code}|{_digits(text[head:])}")]
            self.write = lambda cores: text[:head] + _fill(text[head:], cores[0].partition("|")[2])
        elif kind in ("card", "ssn"):
            self.keys = [(kind, _digits(text))]
            self.write = lambda cores: _fill(text, cores[0])
        elif kind == "iban":
            plain = text.replace(" ", "")
            self.keys = [(kind, plain)]
            self.write = lambda cores: _fill(text, cores[0], " ")
        elif kind == "email":
            self.keys = [(kind, text.lower())]
            self.write = lambda cores: cores[0].upper() if text.isupper() else cores[0]
        elif kind == "ipv6":
            self.keys = [(kind, _exploded(text))]
            self.write = lambda cores: ":".join(group.lstrip("0") or "0" for group in (cores[0].upper() if text.isupper() else cores[0]).split(":"))
        else:
            for inner in ("quoted", "bare", "plain"):
                if match.group(inner) is not None:
                    self.start, self.stop = match.span(inner)
                    text = match.group(inner)
            self.keys = [(kind, text)]
            self.write = lambda cores: cores[0]


class Again:
    """A further mention of a name that stands after a title elsewhere in the text."""

    def __init__(self, start: int, word: str, key: tuple[str, str], gender: str):
        self.start, self.stop, self.keys = start, start + len(word), [key]
        self.write = lambda cores: _cased(_gendered(cores[0], *key, gender), word)


def _gendered(core: str, kind: str, normal: str, gender: str) -> str:
    """A family name's core, which has its masculine form, in the form of ``gender``."""
    if kind.startswith("family-"):
        forms = ENDINGS[kind[7:]]
        for ending, own in zip(forms["m"], forms[gender]):
            if core.endswith(ending):
                return core[:-len(ending)] + own
    return core


def _exploded(text: str) -> str:
    """The eight groups of an address; what is none stays."""
    try:
        return ipaddress.IPv6Address(text).exploded
    except ValueError:
        return text.lower()


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _fill(text: str, core: str, skip: str = "") -> str:
    """``core`` in place of the digits of ``text`` (or of all but ``skip``)."""
    new = iter(core)
    return "".join(next(new) if (c != skip if skip else c.isdigit()) else c for c in text) + "".join(new)


def _cased(core: str, like: str) -> str:
    return core.upper() if like.isupper() else core.capitalize()


def draw(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """The surrogate's normal form: a keyed function of the entity and of how often it drew again."""
    size = 64 + len(normal) + 2 * attempt
    more = max(0, attempt - SAME_LENGTH)
    seed = hashlib.blake2b(f"{kind}\0{normal}\0{attempt}".encode("utf-8", "surrogatepass"), key=key[:64], digest_size=64).digest()
    stream = iter(hashlib.shake_256(seed).digest(8 * size))

    def pick(options):
        return options[(next(stream) << 16 | next(stream) << 8 | next(stream)) % len(options)]

    def like(c: str) -> str:
        if c.isdigit():
            return pick("0123456789")
        if c.isalpha():
            letters = "abcdefghijklmnopqrstuvwxyz"
            letters = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script_of(c), letters)
            return pick(letters.upper() if c.isupper() else letters)
        return c

    if kind.startswith(("given-", "family-")):
        part, script, gender = f"{kind}-m".split("-")[:3]
        if part == "given" and attempt == 0:
            return pick(GIVEN[script, gender]).lower()
        stem = "".join(pick(PARTS[script]) for _ in range(FIRST_PARTS[script] + attempt if part == "family" else 1 + attempt))
        return stem + (pick(ENDINGS[script][gender]) if part == "family" else GIVEN_ENDINGS[script][gender])
    if kind == "email":
        local, _, domain = normal.rpartition("@")
        return "".join(map(like, local)) + "@" + "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(6 + more)) + ".example." + _safe_end(domain)
    if kind == "phone":
        code, _, rest = normal.partition("|")
        return code + "|" + "".join(pick("23456789") if i in (0, 3) else pick("0123456789") for i in range(len(rest) + more))
    if kind == "card":
        body = normal[0] + "".join(pick("0123456789") for _ in range(len(normal) - 2 + more))
        check = luhn(body)
        return body + str(check if luhn(normal[:-1]) == int(normal[-1]) else (check + 1 + pick(range(9))) % 10)
    if kind == "ssn":
        return "9" + "".join(pick("0123456789") for _ in range(len(normal) - 1 + more))
    if kind == "ipv4":
        private = re.match(r"10\.|192\.168\.|127\.|172\.(?:1[6-9]|2\d|3[01])\.", normal)
        if more:
            return ".".join(str(pick(range(256))) for _ in range(4))
        if private:
            return ".".join(["10", *(str(pick(range(256))) for _ in range(3))])
        return ".".join([str(pick(range(240, 255))), *(str(pick(range(256))) for _ in range(3))])
    if kind == "ipv6":
        return ":".join(["2001", "0db8", *(format(pick(range(65536)), "04x") for _ in range(6))])
    if kind == "iban":
        body = "".join(map(like, normal[4:])) + "".join(pick("0123456789") for _ in range(more))
        check = 98 - remainder(f"{normal[:2]}00{body}")
        return f"{normal[:2]}{check if remainder(normal) == 1 else (check + 1 + pick(range(95))) % 97:02d}{body}"
    if kind == "key":
        _, head, _, *tail = normal.split("-----")
        body = "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
        return f"-----{head}-----\n{body}" + (f"\n-----{tail[0]}-----" if tail else "")
    known = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|eyJ", normal)
    head = known.group() if known else ""
    if not any(c.isdigit() or c.isalpha() for c in normal):
        # nothing that like() would change
        return "".join(pick(MARKS) for _ in range(len(normal) + more))
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", normal):
        return "".join(pick("0123456789abcdef" if normal.islower() or normal.isdigit() else "0123456789ABCDEF") for _ in normal + "0" * more)
    return head + "".join(map(like, normal[len(head):])) + "".join(pick("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(more))


def _safe_end(domain: str) -> str:
    end = domain.rpartition(".")[2]
    return end if end in ("com", "net", "org") else "org"


def luhn(body: str) -> int:
    """Check digit that follows ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


class Finder:
    """Compiled patterns of a task."""

    def __init__(self):
        self.gates = [re.compile(gate).finditer for gate in GATES]
        self.pattern = re.compile(PATTERN, re.DOTALL)
        #: All kinds but those with check digits, for the place of a number that fails.
        self.others = re.compile("|".join(p for p in PATTERNS if not p.startswith(("(?P<iban>", "(?P<card>"))), re.DOTALL)

    def find(self, text: str, start: int = 0, stop: int | None = None) -> Iterator[Mention]:
        stop = len(text) if stop is None else stop
        while match := self.pattern.search(text, start, stop):
            start = match.end()
            if stands(match):
                yield Mention(match)
            elif other := self.others.match(text, match.start(), stop):
                start = other.end()
                yield Mention(other)

    def mentions(self, text: str | None) -> list[Mention]:
        """Matches in the lines that may hold one; a key block, which spans lines, has the whole text searched."""
        if not text:
            return []
        if "PRIVATE KEY" in text:
            return self.with_again(text, list(self.find(text)))
        lines = {}
        for gate in self.gates:
            stop = 0
            for hit in gate(text):
                if hit.start() >= stop:
                    stop = text.find("\n", hit.start()) + 1 or len(text)
                    lines[text.rfind("\n", 0, hit.start()) + 1] = stop
        return self.with_again(text, [m for start in sorted(lines) for m in self.find(text, start, lines[start])])

    def with_again(self, text: str, found: list[Mention]) -> list[Mention | Again]:
        """``found`` with the further mentions of its names, capitalised or in capitals, outside other matches."""
        names: dict[str, tuple[tuple[str, str], str]] = {}
        for m in found:
            for key, word, gender in getattr(m, "parts", ()):
                for form in (word, word.upper(), word.lower().capitalize()):
                    names.setdefault(form, (key, gender))
        if not names:
            return found
        out, at = [], 0
        hits = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)").finditer(text)
        hit = next(hits, None)
        for m in [*found, None]:
            stop = m.start if m else len(text)
            while hit and hit.end() <= stop:
                if hit.start() >= at:
                    out.append(Again(hit.start(), hit.group(), *names[hit.group()]))
                hit = next(hits, None)
            if m:
                out.append(m)
                at = m.stop
                while hit and hit.start() < at:
                    hit = next(hits, None)
        return out


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, normal) of all texts; repeats are dropped in the map tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            found = {key for text in batch.column(0) for m in finder.mentions(text.as_py()) for key in m.keys}
            if found:
                kinds, normals = zip(*sorted(found))
                yield pa.record_batch([pa.array(kinds), pa.array(normals)], names=["kind", "normal"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, normal string").distinct()


def _drawn(rows: DataFrame, key: bytes, attempt: int, drawing: Callable[[bytes, str, str, int], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, normals = (batch.column(c).to_pylist() for c in ("kind", "normal"))
            cores = [drawing(key, k, n, attempt) for k, n in zip(kinds, normals)]
            yield pa.record_batch(
                [batch.column("kind"), batch.column("normal"), pa.array(np.full(len(cores), attempt, np.int32)), pa.array(cores, pa.string())],
                names=["kind", "normal", "attempt", "core"],
            )

    return rows.select("kind", "normal").mapInArrow(run, "kind string, normal string, attempt int, core string")


def assign(found: DataFrame, key: bytes, drawing: Callable[[bytes, str, str, int], str] = draw) -> DataFrame:
    """(kind, normal, attempt, core) with all cores of a kind different and none of them an entity of the corpus.

    Of entities that meet in a core the one that has drawn least, then the smallest, keeps it, so what is settled stays: a round
    reads the settled cores and writes only what it drew. A family name of any gender takes its masculine core.
    """
    found = keep(found, "entities")
    core = F.col("normal")
    for script, forms in ENDINGS.items():
        for own, *others in zip(forms["m"], forms["f"], forms["x"]):
            if {own} != {*others}:
                core = F.when(F.col("kind") == f"family-{script}", F.regexp_replace(core, f"(?:{'|'.join(others)})$", own)).otherwise(core)
    taken = found.select("kind", core.alias("core")).distinct()
    settled, attempt = [], 0
    while True:
        drawn = keep(_drawn(found, key, attempt, drawing), "cores")
        used = taken
        for layer in settled:
            used = used.unionByName(layer.select("kind", "core"))
        first = drawn.groupBy("kind", "core").agg(F.min("normal").alias("normal"))
        first = first.join(used, ["kind", "core"], "left_anti")
        settled.append(keep(drawn.join(first, ["kind", "core", "normal"], "left_semi"), "settled"))
        found = keep(drawn.join(first, ["kind", "core", "normal"], "left_anti").select("kind", "normal"), "redrawn")
        if found.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        attempt += 1


def replace(docs: DataFrame, key: bytes, drawing: Callable[[bytes, str, str, int], str] = draw, slice_rows: int = 200_000) -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_replaced``, the number of mentions, as last column.

    A column of that name is replaced. ``key`` decides all draws: the same key gives the same surrogates.
    """
    if "n_replaced" in docs.columns:
        docs = docs.drop("n_replaced")
    again = assign(entities(docs), key, drawing).filter("attempt > 0").select("kind", "normal", "attempt")
    context, slices, held = docs.sparkSession.sparkContext, [], {}
    for row in again.toLocalIterator():
        held[row.kind, row.normal] = row.attempt
        if len(held) >= slice_rows:
            slices.append(context.broadcast(held))
            held = {}
    if held or not slices:
        slices.append(context.broadcast(held))
    at = docs.columns.index("text")
    schema = docs.withColumn("n_replaced", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = batch.column(at)
            hits = {i: found for i, text in enumerate(texts) if (found := finder.mentions(text.as_py()))}
            attempts = {k: 0 for found in hits.values() for m in found for k in m.keys}
            for own in each_slice(slices):
                attempts.update((k, own[k]) for k in attempts if k in own)
            column = texts
            if hits:
                new = texts.to_pylist()
                for i, found in hits.items():
                    out, begin = [], 0
                    for m in found:
                        out += [new[i][begin:m.start], m.write([drawing(key, *k, attempts[k]) for k in m.keys])]
                        begin = m.stop
                    new[i] = "".join([*out, new[i][begin:]])
                column = pa.array(new, texts.type)
            counts = np.zeros(batch.num_rows, np.int32)
            for i, found in hits.items():
                counts[i] = len(found)
            columns = [*batch.columns[:at], column, *batch.columns[at + 1:], pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_replaced"])

    return docs.mapInArrow(run, schema)
