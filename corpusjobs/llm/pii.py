"""PII surrogates: detected entities get keyed replacements of the same type and form.

Types: e-mail addresses, secrets (values of token, key, secret or password, quoted or with a digit), access keys by their
prefix, IBANs (checked), IPv6 and IPv4 addresses, US social security numbers, telephone numbers (international, or ten
digits in groups), card numbers (13 to 19 digits that pass the Luhn test) and other numbers of that length, and personal
names: after a title, or a listed given name before a capitalised word. The given and the family name of a person are
entities of their own, so "Mr. Weber" and "Dr. Adam Weber" agree. An entity's canonical form ignores case (e-mail) and
separators (numbers), so all spellings of one entity share a surrogate, within and across documents.

Surrogates come from a secret key, which has no default. Runs of digits or letters are moved by a keyed permutation of all runs
of that form (a balanced Feistel network, walked until the result has the form), so two entities of one form cannot meet.
What a form asks for is kept: check digits of cards and IBANs are made anew, countries and key prefixes stay, private
addresses stay in their block and public ones public. Names are drawn from a list of the same script and gender first, then
made of syllables, more of them with each few attempts; gender is what any title in the corpus tells of a given name.

Collisions are checked over the whole corpus, in Spark: a surrogate must not be the surrogate of another entity, nor an
entity that really occurs. Those that are get the next attempt, until none is left; surrogates that a document alone does
not tell are joined back to the documents that need them. The text is otherwise unchanged.

Edge cases: null text stays null with no entities; where patterns overlap the type named first wins; texts of any length
are read whole; repeated rows, and rows that share a doc_id or have none, are replaced row by row, alike; two spellings
that tie on a surrogate are ordered by a hash; an empty table gives an empty result; `replaced` carries other columns, and
puts its own in place of columns that are named n_entities or kinds.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import cut, slices

BROADCAST_ENTITIES = 200_000

#: Given and family names by script and gender, for names that follow a title.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Eva Hannah Ida Irene Julia Laura Lea Lina Lucia Maria Marta Nora Olivia Paula Rosa Sara".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Lukas Martin Oscar Paul Simon Victor".split(),
    ("latin", "n"): "Alex Andrea Ariel Charlie Dana Eden Jamie Jordan Kim Lee Morgan Noa Quinn Robin Sasha Sam Taylor Toni Val Yuki".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Олег Павел Сергей Юрий".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура".split(),
}
FAMILY = {
    "latin": "Adler Bauer Blanco Carter Costa Duval Fischer Garner Hale Keller Lambert Lopez Marsh Moreau Navarro Novak Parker Rossi Stone Weber".split(),
    "cyrillic": "Белов Волков Громов Зайцев Козлов Лебедев Морозов Орлов Попов Соколов".split(),
}
#: Titles and the gender they tell.
TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "г-н": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "г-жа": "f", "dr": "n", "prof": "n"}

#: Syllables and endings of made names, blocks of addresses that are not public, and prefixes of access keys.
SYLLABLES = {"latin": [c + v for c in "bdfgklmnprstv" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдклмнпрст" for v in "аеиоу"]}
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "n", ("latin", "n"): "s", ("latin", ""): "ler", ("cyrillic", "f"): "на", ("cyrillic", "m"): "н", ("cyrillic", "n"): "ш", ("cyrillic", ""): "ров"}
BLOCKS = [ipaddress.ip_network(x) for x in "10.0.0.0/8 172.16.0.0/12 192.168.0.0/16 127.0.0.0/8 169.254.0.0/16 100.64.0.0/10 224.0.0.0/3 0.0.0.0/8".split()]
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ sk- xoxb- xoxp-".split()

_name = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[А-Я][а-яё]+"
_titles = "|".join(re.escape(f(t)) for t in sorted(TITLES, key=len, reverse=True) for f in (str.lower, str.capitalize, str.upper))
_givens = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
_number = re.compile(r"[0-9][0-9 .()-]{5,}[0-9]")
_person = rf"(?:(?P<title>{_titles})(?:\.[ ]*|[ ]+)(?P<first>{_name})(?:[ ]+(?P<second>{_name}))?|(?P<given>{_givens})[ ]+(?P<family>{_name}))(?!\w)"
#: (type, what a text with it holds, pattern), in the order in which types win. What a text holds is told by patterns that begin
#: with a literal or a few characters, which are fast; the others run on the texts that are left.
PATTERNS = [
    ("email", re.compile("@"), re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+")),
    ("secret", re.compile("[=:]"), re.compile(r"\b(?:[Tt]oken|TOKEN|(?:api|API|Api)[_-]?(?:key|KEY|Key)|[Ss]ecret|SECRET|[Pp]assword|PASSWORD)\s*[=:]\s*(?:[\"'](?P<value>[^\"'\n]{8,200})[\"']|(?P<bare>(?=\S*\d)[\w+/.=-]{8,200}))")),
    ("key", re.compile("|".join(KEY_PREFIXES)), re.compile(rf"\b(?:{'|'.join(KEY_PREFIXES)})[0-9A-Za-z-]{{16,80}}(?![0-9A-Za-z])")),
    ("iban", _number, re.compile(r"\b[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ipv6", re.compile("::|:[0-9A-Fa-f]{1,4}:"), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]*\w)")),
    ("ip", _number, re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")),
    ("ssn", _number, re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])")),
    ("phone", _number, re.compile(
        r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{2,4}(?:[ -]?\d{2,4})?(?!\d)|(?<![\d.-])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\d.-]*\d)")),
    ("card", _number, re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])")),
    ("person", re.compile(rf"(?:{_titles}|{_givens})(?:\.? +|\.)[A-ZÀ-ÖØ-ÞА-Я]"), re.compile(_person)),
]
#: Attempts after which a form counts as full, and after which a surrogate may be longer than its entity.
FULL_AFTER, WIDER_AFTER = 8, 64
QUICK = list(dict.fromkeys(quick for _, quick, _ in PATTERNS))


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), "sha256")[:16], "big")


def permute(value: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0 .. size - 1: four Feistel rounds over two halves, again while the result is outside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for n in range(4):
            a, b = b, a ^ (_digest(key, label, half, n, b) & mask)
        value = (a << half) | b
        if value < size:
            return value


def _digits(text: str, key: bytes, label: str) -> str:
    return str(permute(int(text), 10 ** len(text), key, f"{label}{len(text)}")).zfill(len(text)) if text else text


_CLASSES = [("abcdefghijklmnopqrstuvwxyz", str.islower), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", str.isupper)]


def _form(text: str, key: bytes, label: str) -> str:
    """A string of the same form: ASCII letters, their case, digits and signs stay what they are in kind; one permutation of
    all strings of that form. Other letters become ASCII letters of their case."""
    kinds, number, size = [], 0, 1
    hexed = all(c in "0123456789abcdef" for c in text) and any(map(str.isdigit, text)) and any(map(str.isalpha, text))
    for c in text:
        if hexed:
            signs = "0123456789abcdef"
        elif c.isascii() and c.isdigit():
            signs = "0123456789"
        elif c.isalpha():
            signs = _CLASSES[c.isupper()][0]
        else:
            kinds.append(c)
            continue
        kinds.append((signs,))
        at = signs.find(c)
        number = number * len(signs) + (at if at >= 0 else _digest(key, label, c) % len(signs))
        size *= len(signs)
    if size == 1:
        return text
    number = permute(number, size, key, f"{label}{''.join(k if isinstance(k, str) else k[0][0] for k in kinds)}")
    out = []
    for k in reversed(kinds):
        if isinstance(k, str):
            out.append(k)
        else:
            number, at = divmod(number, len(k[0]))
            out.append(k[0][at])
    return "".join(reversed(out))


class Entity(NamedTuple):
    """What is replaced: its type, canonical form, gender (given names only), and place in the text."""

    kind: str
    canon: str
    hint: str | None
    start: int
    end: int


def luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    doubled = [int(d) * (2 - k % 2) for k, d in enumerate(reversed(digits))]
    return -sum(n - 9 * (n > 9) for n in doubled) % 10


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account)) % 97


def _block(number: int) -> ipaddress.IPv4Network | None:
    address = ipaddress.ip_address(number)
    return next((b for b in BLOCKS if address in b), None)


def _script(word: str) -> str:
    return "cyrillic" if "\u0400" <= word[0] <= "\u04ff" else "latin"


def _known_gender(given: str) -> str | None:
    return next((g for (_, g), names in GIVEN.items() if given in names), None)


def _ssn_allowed(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def surrogate(kind: str, canon: str, hint: str | None, attempt: int, key: bytes) -> str:
    """The replacement of an entity in its canonical form; after `WIDER_AFTER` attempts longer than that."""
    if attempt >= WIDER_AFTER and kind not in ("given", "family"):
        return f"{surrogate(kind, canon, hint, 0, key)}-{_digest(key, kind, attempt, canon) % 10**12:012}"
    label = f"{kind}/{attempt}/"
    match kind:
        case "email":
            user, _, host = canon.partition("@")
            name, dot, top = host.rpartition(".")
            return f"{_form(user, key, label)}@{_form(name, key, label + 'h')}{dot}{top}" if dot else f"{_form(user, key, label)}@{_form(host, key, label)}"
        case "secret":
            return _form(canon, key, label)
        case "key":
            prefix = next(p for p in KEY_PREFIXES if canon.startswith(p))
            return prefix + _form(canon[len(prefix) :], key, label + prefix)
        case "iban":
            account = _form(canon[4:], key, label + canon[:2])
            return f"{canon[:2]}{98 - _mod97(account + canon[:2] + '00'):02}{account}"
        case "ipv6":
            number = int(ipaddress.ip_address(canon))
            return str(ipaddress.ip_address(number >> 112 << 112 | permute(number & (1 << 112) - 1, 1 << 112, key, label + str(number >> 112))))
        case "ip":
            number = int(ipaddress.ip_address(".".join(str(int(x)) for x in canon.split("."))))
            block = _block(number)
            if block:
                first = int(block.network_address)
                return str(ipaddress.ip_address(first + permute(number - first, block.num_addresses, key, label + str(block))))
            number = permute(number, 1 << 32, key, label)
            while _block(number):
                number = permute(number, 1 << 32, key, label)
            return str(ipaddress.ip_address(number))
        case "ssn":
            found = _digits(canon, key, label)
            while not _ssn_allowed(found):
                found = _digits(found, key, label)
            return found
        case "phone":
            keep = 0 if canon[0] != "+" else 2 if len(canon) <= 12 else 3  # the country stays
            return canon[:keep] + _digits(canon[keep:], key, label)
        case "card":
            body = canon[0] + _digits(canon[1:-1], key, label)
            return body + str(luhn(body))
        case "number":
            return _digits(canon, key, label)
        case _:
            script, number = _script(canon), _digest(key, label, canon)
            gender = (hint or "n") if kind == "given" else ""
            if not attempt:
                names = GIVEN[script, gender] if gender else FAMILY[script]
                return names[number % len(names)]
            parts, syllables = [], SYLLABLES[script]
            for _ in range(2 + (attempt - 1) // 3):
                number, at = divmod(number, len(syllables))
                parts.append(syllables[at])
            return "".join(parts).capitalize() + ENDINGS[script, gender]


def spelled(kind: str, text: str, replacement: str) -> str:
    """The surrogate in the spelling of the occurrence: its separators, its case."""
    if kind in ("phone", "card", "number", "ssn", "iban"):
        signs = iter(c for c in replacement if c.isalnum())
        return "".join(next(signs) if c.isalnum() else c for c in text)
    if kind == "email":
        return replacement.upper() if text.isupper() else replacement
    return replacement


def _entities(kind: str, m: re.Match) -> tuple[str, list[Entity]] | None:
    """(type to report, what to replace) of a match; None if it fails its check."""
    text = m.group()
    if kind == "person":
        title = (m.group("title") or "").lower()
        if title and not m.group("second") and not _known_gender(m.group("first")):  # a title and one name: the family's
            return kind, [Entity("family", m.group("first"), None, *m.span("first"))]
        given, family = ("first", "second") if title else ("given", "family")
        told = TITLES.get(title, "n")
        hint = told if told != "n" else _known_gender(m.group(given))
        found = [Entity("given", m.group(given), hint, *m.span(given))]
        return kind, found + ([Entity("family", m.group(family), None, *m.span(family))] if m.group(family) else [])
    if kind == "secret":
        part = "value" if m.group("value") else "bare"
        return kind, [Entity(kind, m.group(part), None, *m.span(part))]
    canon = text
    if kind == "email":
        canon = text.lower()
    elif kind == "phone":
        canon = "+" * (text[0] == "+") + re.sub(r"\D", "", text)
    elif kind in ("card", "ssn"):
        canon = re.sub(r"\D", "", text)
        if kind == "card" and luhn(canon[:-1]) != int(canon[-1]):
            kind = "number"
    elif kind == "iban":
        canon = text.replace(" ", "")
        if not 15 <= len(canon) <= 34 or _mod97(canon[4:] + canon[:4]) != 1:
            return None
    elif kind == "ipv6":
        try:
            canon = str(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        if text.count(":") < 3 and "::" not in text or len(text) < 4:
            return None
    return kind, [Entity(kind, canon, None, *m.span())]


def entities_of(text: str | None) -> list[tuple[str, list[Entity]]]:
    """(type, what to replace) for each entity of a text, in order; they do not overlap."""
    taken: list[tuple[int, int, str, list[Entity]]] = []
    holds = {quick: bool(quick.search(text)) for quick in QUICK} if text else {}
    for kind, quick, pattern in PATTERNS:
        if holds.get(quick):
            at = 0
            while m := pattern.search(text, at):
                at = m.end()
                if kind == "person" and m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
                    at = m.start() + 1
                    continue
                k = bisect_left(taken, (m.end(),))
                if (k == 0 or taken[k - 1][1] <= m.start()) and (found := _entities(kind, m)):
                    insort(taken, (m.start(), m.end(), *found))
    return [t[2:] for t in taken]


def find_entities(docs: DataFrame) -> DataFrame:
    """doc_id, kind, canon, hint: one row for each thing to replace of each document, equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, found = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                for e in dict.fromkeys(e[:3] for _, parts in entities_of(text) for e in parts):
                    row.append(n)
                    found.append(e)
            columns = [pa.array([e[k] for e in found], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], ["doc_id", "kind", "canon", "hint"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kind string, canon string, hint string")


def _attempted(entities: DataFrame, key: bytes) -> DataFrame:
    """Add the surrogate to rows with kind, canon, hint, mixed, attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, canon, hint, _, attempt = (c.to_pylist() for c in batch.columns)
            out = [surrogate(*x, key) for x in zip(kind, canon, hint, attempt)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["kind", "canon", "hint", "mixed", "attempt", "surrogate"])

    return entities.select("kind", "canon", "hint", "mixed", "attempt").mapInArrow(run, "kind string, canon string, hint string, mixed boolean, attempt int, surrogate string")


def _form_of(canon: F.Column) -> F.Column:
    """Letters and digits of an entity by kind: what its surrogates keep."""
    out = canon
    for kind, sign in ((r"\p{Lu}", "A"), (r"[\p{L}&&[^A]]", "a"), (r"\p{Nd}", "0")):
        out = F.regexp_replace(out, kind, sign)
    return out


def settle(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, hint, mixed, attempt, surrogate for each entity found (kind, canon, hint): surrogates are distinct and no
    real entities. mixed: its occurrences tell different genders, or some none.

    Each attempt draws anew (names from more names after a few). A form, such as a@b.com or the addresses of a network, whose entities
    still meet real ones after `FULL_AFTER` attempts has too few others: there the first attempt holds, which permutes the form, so
    surrogates are distinct though some are other real entities. Whatever is still shared after `WIDER_AFTER` attempts is made longer. So
    the loop ends.
    """
    hints = F.count_distinct(F.coalesce("hint", F.lit(""))) > 1
    entities = cut(found.groupBy("kind", "canon").agg(F.max("hint").alias("hint"), hints.alias("mixed")))
    real, full = entities.select("kind", "canon"), None
    settled = cut(_attempted(entities.withColumn("attempt", F.lit(0)), key))
    while True:
        order = F.struct("attempt", F.xxhash64("canon"), "canon")  # the earliest attempt keeps a shared surrogate
        keeper = settled.groupBy("kind", "surrogate").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("n"))
        shared = keeper.filter("n > 1").select("kind", "surrogate", F.col("k.canon").alias("keeper"))
        taken = real.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("taken"))
        checked = settled.join(shared, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left").withColumn("form", _form_of(F.col("canon")))
        checked = checked.join(full.withColumn("full", F.lit(True)), ["kind", "form"], "left") if full is not None else checked.withColumn("full", F.lit(None).cast("boolean"))
        is_full = F.coalesce(F.col("full"), F.lit(False))
        again = (F.coalesce(F.col("taken"), F.lit(False)) & ~is_full) | (F.col("keeper").isNotNull() & (F.col("keeper") != F.col("canon")))
        marked = cut(checked.withColumn("again", again).select(*settled.columns, "form", is_full.alias("full"), "again"))
        if not marked.filter("again").limit(1).count():
            return settled
        crowded = marked.filter(F.col("again") & ~F.col("full") & (F.col("attempt") >= FULL_AFTER) & ~F.col("kind").isin("given", "family")).select("kind", "form").distinct()
        crowded = cut(crowded)
        full = crowded if full is None else cut(full.unionByName(crowded).distinct())
        # the entities of a form that has just turned out full begin anew
        anew = marked.join(crowded.withColumn("anew", F.lit(True)), ["kind", "form"], "left").withColumn("anew", F.coalesce("anew", F.lit(False)))
        moved = anew.filter("anew or again").withColumn("attempt", F.when(F.col("anew"), 0).otherwise(F.col("attempt") + 1))
        settled = cut(anew.filter("not anew and not again").select(settled.columns).unionByName(_attempted(moved, key)))


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced, plus n_entities and kinds (an entity kind for each occurrence, in order)."""
    if not key:
        raise ValueError("surrogates need a secret key")
    docs = docs.drop("n_entities", "kinds")
    names = docs.columns
    found = cut(find_entities(docs.select("doc_id", "text")))
    settled = settle(found.select("kind", "canon", "hint"), key)
    # what a document alone does not tell: later attempts, and genders that other documents tell
    later = cut(settled.filter("attempt > 0 or mixed").select("kind", "canon", "surrogate"))
    few = F.broadcast(later) if later.count() <= BROADCAST_ENTITIES else later
    told = F.collect_set(F.struct("kind", "canon", "surrogate"))
    moved = cut(found.join(few, ["kind", "canon"]).groupBy(F.col("doc_id").alias("id")).agg(told.alias("told")))
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"))
    side = F.broadcast(moved) if moved.count() <= BROADCAST_ENTITIES else moved
    rows = rows.join(side, F.col("row.doc_id").eqNullSafe(F.col("id")), "left").select("row", "told")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str, str | None], str] = {}
        for batch in slices(batches):
            out, kinds = [], []
            columns = batch.column(0).flatten()
            for text, told in zip(columns[at].to_pylist(), batch.column(1).to_pylist()):
                known = {(m["kind"], m["canon"]): m["surrogate"] for m in told or []}
                parts, done, seen = [], 0, []
                for kind, entities in entities_of(text):
                    for e in entities:
                        new = known.get(e[:2])
                        if new is None:
                            if len(memo) > 100_000:
                                memo.clear()
                            new = memo.get(e[:3]) or memo.setdefault(e[:3], surrogate(*e[:3], 0, key))
                        parts += [text[done : e.start], spelled(e.kind, text[e.start : e.end], new)]
                        done = e.end
                    seen.append(kind)
                out.append(text if not seen else "".join([*parts, text[done:]]))
                kinds.append(seen)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(k) for k in kinds], pa.int32()), pa.array(kinds, pa.list_(pa.string()))], [*names, "n_entities", "kinds"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema["row"].dataType.fields)
    return rows.mapInArrow(run, fields + ", n_entities int, kinds array<string>")
