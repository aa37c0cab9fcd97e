"""Personal data replaced by keyed surrogates (operator 5).

Detected entities get replacements that depend on a key and on the entity alone, so an entity has the
same surrogate wherever it occurs. Surrogates keep the type and the form: digits stay digits in the same
places, card numbers that pass the check digit still do, addresses stay addresses, letters keep case
and script, names keep the gender that their title shows. Names are replaced part by part, so "Mrs Anna
Berg" and "Mrs Berg" still belong together. A given name after a neutral title has the gender that other
mentions show in the corpus, if that is one gender; else it is an entity of its own.

Names are found after a title, and without one where a given name of the dictionary (``GIVEN`` and a
table of the caller) stands before a capitalised word. Other mentions of the parts found in a text are
replaced in the same text too, whatever they stand for there.

Two entities must not get the same surrogate, and no surrogate may be another entity of the corpus. Both
are checked over the table of distinct entities: of those that want the same surrogate one gets it, the
others try again with the next attempt, until none is left. Only entities, never texts, take part.
The replacements then go to the rows that need them, by a digest of the text: what a text holds depends on the
text alone, so rows without id and repeated rows are like all others, and equal texts are looked up once.

Phone numbers start with + or 0 or a bracket, or have three, three and four digits with one separator; dates
are none. IBANs pass their check (mod 97), and so do their surrogates. Mail domains are permuted by key within
their form, so two domains never become one. Where a range is full, addresses widen to other private ranges and
to IPv6; an entity that finds nothing in ``MOST_ATTEMPTS`` rounds is an error, with a count.

Defined results: null text stays null; texts without entities stay as they are, very long ones are searched whole. Of entities
that want one surrogate the least gets it. Equal entities in different spelling (blanks and marks
in numbers, capitals in mail addresses) are one entity. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpida.llm.tables import stored

# Titles with the gender they show (empty: none), and names to draw from by script and gender.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Signor": "m", "Signora": "f",
    "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
GIVEN = {
    ("LATIN", "m"): "Adrian Benno Carlo Dario Emil Fabio Gustav Henrik Ivo Julian Karl Linus Marco Nils Oscar Pavel Rafael Simon Tobias Viktor".split(),
    ("LATIN", "f"): "Alma Berta Clara Doris Elena Flora Greta Helena Irma Julia Karin Lena Maria Nora Olga Paula Rosa Silvia Tilda Vera".split(),
    ("CYRILLIC", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("CYRILLIC", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Клара Лидия Марина".split(),
    ("GREEK", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λουκάς".split(),
    ("GREEK", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Μαρία Σοφία".split(),
}
FAMILY = {
    "LATIN": "Albers Brandt Castell Dorn Ebert Falk Grimm Hansen Iversen Jansen Keller Lorenz Moreau Norden Olsen Petit Quist Renard Sander Thorn Ulrich Vidal Weber Zeller".split(),
    "CYRILLIC": "Белов Волков Громов Доронин Егоров Жуков Зимин Ильин Котов Лебедев Морозов Носов".split(),
    "GREEK": "Αντωνίου Βλάχος Γεωργίου Δήμου Ιωάννου Κωστόπουλος Λάμπρου Μάρκου".split(),
}

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
ENTITY = re.compile(
    rf"""(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?<![\w.])(?P<iban>[A-Z]{{2}}\d\d(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?)(?!\w)
    |(?<![\w.])(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){{3}})(?![\w]|\.\d)
    |(?<![\w.-])(?P<ssn>\d{{3}}-\d\d-\d{{4}})(?![\w-])
    |(?<![\w.])(?P<card>[2-6]\d{{3}}(?:[\x20-]?\d{{4}}){{2}}[\x20-]?\d{{1,7}})(?!\w)
    |(?<![\w.])(?P<phone>(?:\+\d{{1,3}}[\x20.-]?)?(?:\(\d{{2,5}}\)|\d{{2,5}})(?:[\x20./-]\d{{2,5}}){{1,4}}|\+\d{{8,15}})(?!\w)
    |(?<!\w)(?P<title>{_TITLE})\.?\x20+(?P<name>{_NAME}(?:\x20{_NAME}){{0,2}})""",
    re.X,
)
_DATE = re.compile(r"(?:\d{4}([./-])\d{1,2}\1\d{1,2}|\d{1,2}([./-])\d{1,2}\2(?:\d{4}|\d\d))")
_PHONE = re.compile(r"[+0(].*|\d{3}([\x20./-])\d{3}\1\d{4}", re.S)
_MAY_HOLD = re.compile(rf"[0-9@]|\b(?:{_TITLE})\b")
KINDS = ("email", "iban", "ip", "ssn", "card", "phone", "name")
_DIGITS = "0123456789"
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_RUN = re.compile(rf"(?<!\w){_NAME}(?:\x20{_NAME})+(?!\w)")
#: Rounds after which an entity without surrogate is an error.
MOST_ATTEMPTS = 60
#: Names of a caller's table, which go to all workers.
MOST_NAMES = 20_000
NAMES = {name.casefold(): gender for (_, gender), names in GIVEN.items() for name in names}


def _script(part: str) -> str:
    return unicodedata.name(part[0], "LATIN").split()[0]


def _titled(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    if not _MAY_HOLD.search(text):
        return
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        if kind == "name":
            gender = TITLES[m["title"]]
            parts = list(re.finditer(r"\S+", m["name"]))
            for n, part in enumerate(parts):
                family = n == len(parts) - 1
                what = "family" if family else f"given{gender}"
                yield m.start("name") + part.start(), m.start("name") + part.end(), what, part[0].casefold(), "name"
        else:
            value = m[kind]
            digits = re.sub(r"\D", "", value)
            if kind == "phone" and (not 8 <= len(digits) <= 15 or not _PHONE.fullmatch(value) or _DATE.fullmatch(value)):
                continue
            if kind == "card" and not 13 <= len(digits) <= 19 or kind == "iban" and mod97(value) != 1:
                continue
            canon = value.lower() if kind == "email" else value if kind == "ip" else re.sub(r"\W", "", value)
            yield m.start(), m.end(), kind, canon, kind


def _pairs(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str, str, str]]:
    """Untitled names: given names of the dictionary and the capitalised word after them."""
    for run in _RUN.finditer(text):
        words = [(run.start() + m.start(), run.start() + m.end(), m[0].casefold()) for m in re.finditer(r"\S+", run[0])]
        n = 0
        while n + 1 < len(words):
            if words[n][2] not in names:
                n += 1
                continue
            while n + 1 < len(words) and (words[n][2] in names):
                yield *words[n][:2], f"given{names[words[n][2]]}", words[n][2], "name"
                n += 1
            yield *words[n][:2], "family", words[n][2], "name"
            n += 1


def entities(text: str, names: dict[str, str] = NAMES) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, entity, kind counted as): what has one surrogate, in the order of the text."""
    found = list(_titled(text))

    def add(more) -> None:
        starts = [f[0] for f in found]
        for one in more:
            k = bisect.bisect(starts, one[0])
            if (not k or found[k - 1][1] <= one[0]) and (k == len(starts) or one[1] <= starts[k]):
                new.append(one)
        found.extend(new)
        found.sort()

    new: list = []
    add(_pairs(text, names))
    kinds: dict[str, str] = {}
    for _, _, kind, canon, counted in found:
        # A part that was a given name with a gender somewhere is that name.
        if counted == "name" and (canon not in kinds or kinds[canon] == "given" and kind.startswith("given")):
            kinds[canon] = kind
    if kinds:
        new = []
        add((m.start(), m.end(), kinds[m[0].casefold()], m[0].casefold(), "name") for m in _WORD.finditer(text) if m[0].casefold() in kinds)
    return found


def luhn(digits: str) -> int:
    """The sum of the check; 0 if the number passes."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) << (n & 1)
        total += d - 9 if d > 9 else d
    return total % 10


def mod97(iban: str) -> int:
    """The check of an IBAN, blanks and all; 1 if it passes."""
    plain = re.sub(r"\W", "", iban)
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


class _Draw:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, *what) -> None:
        self.key, self.seed, self.n, self.left = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + b"\x1f%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def like(self, text: str) -> str:
        """Letters for letters and digits for digits."""
        out = []
        for c in text:
            if c in _DIGITS:
                out.append(_DIGITS[self.below(10)])
            elif "a" <= c.lower() <= "z":
                new = chr(97 + self.below(26))
                out.append(new.upper() if c.isupper() else new)
            else:
                out.append(c)
        return "".join(out)


def _permuted(key: bytes, text: str) -> str:
    """Another text of the same form, letters for letters and digits for digits; no two texts give the same.

    Rounds add to one half of the characters a number drawn from the other half, each of which can be undone.
    """
    at = [n for n, c in enumerate(text) if c in _DIGITS or "a" <= c <= "z"]
    sizes = [10 if text[n] in _DIGITS else 26 for n in at]
    values = [int(text[n]) if text[n] in _DIGITS else ord(text[n]) - 97 for n in at]
    form = "".join("9" if c in _DIGITS else "a" if "a" <= c <= "z" else c for c in text)
    middle = (len(at) + 1) // 2
    for turn in range(6):
        part, rest = (range(middle), values[middle:]) if turn % 2 else (range(middle, len(at)), values[:middle])
        if len(at) == 1:
            part, rest = range(1), []
        draw = _Draw(key, "domain", form, turn, rest)
        for n in part:
            values[n] = (values[n] + draw.below(sizes[n])) % sizes[n]
    out = list(text)
    for n, size, value in zip(at, sizes, values, strict=True):
        out[n] = _DIGITS[value] if size == 10 else chr(97 + value)
    return "".join(out)


def _address(draw: _Draw, attempt: int) -> str:
    """An address of the private ranges; later attempts take others, and at last IPv6 ones."""
    if attempt < 4:
        return f"10.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}"
    if attempt < 8:
        first = [f"172.{16 + draw.below(16)}.{draw.below(256)}", f"192.168.{draw.below(256)}", f"100.{64 + draw.below(64)}.{draw.below(256)}"]
        return f"{first[draw.below(3)]}.{draw.below(256)}"
    return f"fd{draw.below(256):02x}:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(7))


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The surrogate that an entity asks for; later attempts draw from wider ranges where the first are narrow."""
    draw = _Draw(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        made = draw.like(local) + (f"{draw.below(10 ** min(9, attempt))}" if attempt > 2 else "")
        return f"{made}@{_permuted(key, domain.rpartition('.')[0])}.{domain.rpartition('.')[2]}"
    if kind == "ip":
        return _address(draw, attempt)
    if kind == "card":
        made = entity[0] + draw.like(entity[1:])
        if not luhn(entity):
            made = made[:-1] + next(d for d in _DIGITS if not luhn(made[:-1] + d))
        return made
    if kind == "phone":
        keep = max(0, len(entity) - 10)  # the country's part
        return entity[:keep] + draw.like(entity[keep:])
    if kind == "iban":
        made = draw.like(entity[4:])
        return f"{entity[:2]}{98 - mod97(entity[:2] + '00' + made):02d}{made}"
    if kind == "ssn":
        return draw.like(entity)
    script = _script(entity)
    pool = FAMILY.get(script) if kind == "family" else None
    if kind.startswith("given"):
        gender = kind[5:] or "mf"[draw.below(2)]
        pool = GIVEN.get((script, gender))
    if pool is None:  # a script without names here: letters of the same block
        base = ord(entity[0]) & ~15
        return "".join(chr(base + draw.below(16)) for _ in entity) + "".join(chr(base + draw.below(16)) for _ in range(attempt))
    return "-".join(pool[draw.below(len(pool))] for _ in range(1 + min(attempt, 8) // 2 + max(0, attempt - 8))).casefold()


def shaped(text: str, made: str, kind: str) -> str:
    """The surrogate in the form of the entity's text: separators, capitals."""
    if kind in ("card", "phone", "iban", "ssn"):
        rest = iter(made)
        return "".join(next(rest) if c.isalnum() else c for c in text)
    if kind == "email":
        return made.upper() if text.isupper() else made
    if kind == "ip":
        return made
    return made.upper() if text.isupper() and len(text) > 1 else "-".join(p[:1].upper() + p[1:] for p in made.split("-"))


def _detect(names: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("of").to_pylist(), batch.column("text").to_pylist(), strict=True)
            rows = sorted({(of, kind, canon) for of, text in texts if text for _, _, kind, canon, _ in entities(text, names)})
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["of", "kind", "entity"])

    return run


def _asking(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, k, e, attempt) for k, e in zip(batch.column("kind").to_pylist(), batch.column("entity").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("entity"), pa.array(made, pa.string())], ["kind", "entity", "surrogate"])

    return run


def _space() -> Column:
    """Kinds that share a space of surrogates."""
    return F.when(F.col("kind").startswith("given"), F.lit("given")).otherwise(F.col("kind"))


def assign(found: DataFrame, key: bytes, ask: Callable[[bytes, int], Callable] = _asking) -> DataFrame:
    """Distinct (kind, entity) with a surrogate each: no two alike, none of them an entity."""
    taken = found.select(_space().alias("space"), F.col("entity").alias("surrogate")).distinct()
    done, waiting, attempt = None, found, 0
    while attempt == 0 or not waiting.isEmpty():
        asked = waiting.mapInArrow(ask(key, attempt), "kind string, entity string, surrogate string").withColumn("space", _space())
        free = asked.join(taken, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        chosen = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "entity")).alias("one")).select("one.kind", "one.entity", "surrogate", "space")
        chosen = stored(chosen, "surrogates")
        done = chosen if done is None else done.union(chosen)
        waiting = stored(waiting.join(chosen, ["kind", "entity"], "left_anti"), "waiting")
        attempt += 1
        if attempt == MOST_ATTEMPTS and not waiting.isEmpty():
            left = {r["space"]: r["count"] for r in waiting.groupBy(_space().alias("space")).count().collect()}
            raise ValueError(f"entities without a free surrogate after {attempt} rounds: {left}")
    return done.select("kind", "entity", "surrogate")


RESULT = "doc_id long, text string, n_entities long, " + ", ".join(f"n_{k} long" for k in KINDS)


def _apply(names: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts, counts = [], []
                for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
                    number = dict.fromkeys(KINDS, 0)
                    if known and text:
                        made = {(k["kind"], k["entity"]): k["surrogate"] for k in known}
                        out, at = [], 0
                        for start, end, kind, canon, counted in entities(text, names):
                            out += [text[at:start], shaped(text[start:end], made[kind, canon], kind)]
                            at = end
                            number[counted] += 1
                        text = "".join([*out, text[at:]])
                    texts.append(text)
                    counts.append([sum(number.values()), *number.values()])
                columns = list(zip(*counts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in columns]],
                    [f.split()[0] for f in RESULT.split(", ")],
                )

    return run


def _dictionary(table: DataFrame | None) -> dict[str, str]:
    if table is None:
        return NAMES
    rows = table.select("name", "gender").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return NAMES | {r.name.casefold(): r.gender or "" for r in rows if r.name}


def _resolved(distinct: DataFrame) -> DataFrame:
    """(kind, entity, settled): a given name without gender gets the one gender that the corpus shows for it."""
    given = distinct.where(F.col("kind").startswith("given"))
    seen = given.groupBy("entity").agg(F.bool_or(F.col("kind") == "givenm").alias("m"), F.bool_or(F.col("kind") == "givenf").alias("f"))
    kind = F.when(F.col("m") & ~F.col("f"), "givenm").when(F.col("f") & ~F.col("m"), "givenf").otherwise("given")
    settled = given.join(seen, "entity").select("kind", "entity", F.when(F.col("kind") == "given", kind).otherwise(F.col("kind")).alias("settled"))
    return settled.union(distinct.where(~F.col("kind").startswith("given")).select("kind", "entity", F.col("kind").alias("settled")))


def replace_entities(docs: DataFrame, key: bytes, given_names: DataFrame | None = None) -> DataFrame:
    """Every row: doc_id, text with surrogates, and how many entities of each kind it had.

    ``given_names``: a table (name, gender: m, f or empty) of at most ``MOST_NAMES`` rows beside ``GIVEN``.
    """
    names = _dictionary(given_names)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2("text", 256)).alias("of"))
    found = stored(docs.select("of", "text").mapInArrow(_detect(names), "of binary, kind string, entity string"), "entities")
    resolved = stored(_resolved(found.select("kind", "entity").distinct()), "distinct-entities")
    assigned = assign(resolved.select(F.col("settled").alias("kind"), "entity").distinct(), key)
    assigned = resolved.join(assigned.withColumnRenamed("kind", "settled"), ["settled", "entity"]).select("kind", "entity", "surrogate")
    known = found.distinct().join(assigned, ["kind", "entity"]).groupBy("of").agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("known"))
    return docs.join(known, "of", "left").select("doc_id", "text", "known").mapInArrow(_apply(names), RESULT)
