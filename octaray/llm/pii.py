"""Surrogates for personal data: entities are replaced by keyed ones of the same type and format.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers, social security numbers, and
names of people (a listed given name with a capitalised name behind it, or a title with a capitalised name behind it).
Numbers and addresses go through a keyed permutation of all strings of the same shape (a balanced Feistel network over
the mixed-radix number of their letters and digits, walked on until it leaves no fixed point or invalid value), so
equal entities get equal surrogates, different ones different surrogates, and punctuation, letter case, country codes
and the state of a card's check digit stay. Telephone numbers are permuted by their digits, whatever their punctuation.
Names move within a list of the same script and gender by a keyed step; names that are not listed are permuted letter
by letter within vowels and consonants of their script. Titles and initials stay.

Collision checks: the distinct (entity, surrogate) pairs of all texts are gathered; entities whose surrogate another one
has too, or equals an entity of the corpus (itself included), get the next surrogate of their chain, in distributed
rounds over all pairs until no clash is left. From attempt ``LISTED`` on, listed names leave their list and are permuted
by letters; from ``WIDER`` on, names and e-mail addresses get more letters, as their shape can be full. Up to ``INLINE``
moved entities are broadcast; more are joined with the texts that hold them, which changes the plan only. More than
``MAX_ROUNDS`` rounds raise an error; no clash is left in silence.

Coreference: a name is an entity by its words without titles. Surnames are settled first, each for all who bear it (one
that is mentioned with only a title is an entity by itself); then full names, by their given names alone. So "Ms.
Garcia" and "Maria Garcia" share a surname after any clash, and so do all the people of one surname.

Cases: null and empty texts stay; texts are read whole; repeated rows are replaced alike; an empty table gives no rows;
extra columns stay, and where one is called ``n_entities`` or ``spans``, the new column gets underscores.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, read_table, settle, spread_join

KEY = b"octaray surrogate key"
INLINE, MAX_ROUNDS = 100_000, 64
LISTED, WIDER = 4, 8

#: Given names by script and gender, and surnames by script.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Catherine Charlotte Claire Clara Elena Elizabeth Emily Emma Greta Hannah Helen Ingrid Isabel Jane Jennifer Julia Karen Katharina Laura Linda Lucia Maria Martha Mary Monica Nancy Patricia Sabine Sandra Sarah Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Albert Alexander Andreas Anthony Antonio Carlos Charles Christopher Daniel David Diego Edward Francisco George Hans Henri Jacques James Javier Jean John Joseph Juan Jürgen Klaus Louis Manuel Mark Michael Miguel Nicolas Paul Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang".split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κωνσταντίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Σπυρίδων Χρήστος".split(),
}
SURNAMES = {
    "latin": "Adams Allen Anderson Baker Becker Bernard Brown Campbell Carter Clark Davis Dubois Durand Evans Fernandez Fischer Flores Garcia Gomez Gonzalez Green Hall Harris Hernandez Hill Hoffmann Jackson Johnson Jones King Klein Koch Lambert Laurent Lee Lewis Lopez Martin Martinez Meyer Miller Mitchell Moore Moreau Müller Nelson Perez Petit Phillips Richter Rivera Roberts Robinson Rodriguez Roux Sanchez Schmidt Schneider Schulz Scott Simon Smith Taylor Thomas Thompson Torres Turner Wagner Walker Weber White Williams Wilson Wolf Wright Young Zimmermann".split(),
    "cyrillic": "Волков Иванов Козлов Кузнецов Лебедев Морозов Новиков Петров Попов Смирнов Соколов".split(),
    "greek": "Αγγελόπουλος Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παπαδόπουλος".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme Mlle Господин Госпожа Κύριος Κυρία".split()

_NAME = r"[^\W\d_a-zа-яα-ωß-öø-ÿά-ώ][^\W\d_]+"
_GIVEN_ALL = sorted({n for names in GIVEN.values() for n in names})
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])",
    "card": r"(?<![\w.-])(?:[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w.]*\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?<=[ .-])\d{2,4}(?:[ .-]\d{2,4}){2,4})(?![\w-])|(?<![\w.+-])\+\d{8,15}(?!\w)",
    "name": rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.?\x20{_NAME}(?:\x20{_NAME})?|(?:{'|'.join(_GIVEN_ALL)})(?:\x20[A-ZА-ЯΑ-Ω]\.)?\x20{_NAME})(?!\w)",
}
KINDS = tuple(PATTERNS)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_NUMERIC = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in KINDS if k != "name"))
_NAMES = re.compile(f"(?P<name>{PATTERNS['name']})")


def _digest(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x00".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size-1: four or more Feistel rounds on two halves, walked until inside."""
    if size < 2:
        return value
    half = max(1, -(-(size - 1).bit_length() // 2))
    low = (1 << half) - 1
    while True:
        a, b = value >> half, value & low
        for r in range(6):
            a, b = b, a ^ (_digest(key, tweak, str(size), str(r), str(b)) & low)
        value = (a << half) | b
        if value < size:
            return value


_SETS = [str("0123456789"), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_PHONETIC = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]


def permute_text(text: str, key: bytes, tweak: str, sets: list[str] = _SETS) -> str:
    """Permutes the strings of one shape: every listed character stays in its set, all others stay."""
    places = [(i, s) for i, c in enumerate(text) for s in sets if c in s]
    value, size = 0, 1
    for i, s in places:
        value, size = value * len(s) + s.index(text[i]), size * len(s)
    shape = "".join(str(sets.index(s)) for _, s in places)
    moved = permute(value, size, key, f"{tweak}/{shape}")
    if moved == value:  # the walk's fixed point: its successor's place is checked for clashes like any other
        moved = (value + 1) % size
    out = list(text)
    for i, s in reversed(places):
        moved, digit = divmod(moved, len(s))
        out[i] = s[digit]
    return "".join(out)


def luhn(digits: str) -> int:
    """Sum modulo 10; 0 where the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind == "email":
        return text.lower()
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "name":
        return " ".join(_parts(text)[1])
    return text


def _parts(name: str) -> tuple[list[str], list[str]]:
    """(titles, the other words) of a mention."""
    words = name.split(" ")
    n = next((i for i, w in enumerate(words[:-1]) if w.rstrip(".") not in TITLES), len(words) - 1)
    return words[:n], words[n:]


def _lead(text: str) -> int:
    """The digits of a number's country code."""
    if not text.startswith("+"):
        return 0
    code = re.match(r"\+(\d{1,3})[ .(-]", text)
    return len(code[1]) if code else 1 if text[1] == "1" else 2


def _refill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _step(words: list[str], word: str, key: bytes, tweak: str) -> str:
    return words[(words.index(word) + 1 + _digest(key, tweak) % (len(words) - 1)) % len(words)]


def _one_name(word: str, key: bytes, tweak: str, lists: list[dict]) -> str:
    """A step in the first list that holds the word, or the word's letters permuted."""
    for names in lists:
        for group, words in names.items():
            if word in words:
                return _step(words, word, key, f"{tweak}/{group}")
    return permute_text(word, key, f"{tweak}/name", _PHONETIC)


def _more(text: str, key: bytes, tweak: str, attempt: int) -> str:
    """Letters to add: three, and one more every fourth attempt, in the script of the text."""
    at = next((i for i in range(0, len(_PHONETIC), 4) if any(c in s for c in text for s in _PHONETIC[i : i + 4])), 0)
    letters, n = _PHONETIC[at] + _PHONETIC[at + 1], _digest(key, f"{tweak}/more", text)
    return "".join(letters[(n >> 16 * j) % len(letters)] for j in range(min(16, 3 + (attempt - WIDER) // 4)))


def surrogate(kind: str, text: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The replacement of one mention; ``attempt`` walks the entity's chain of surrogates.

    Of a "name", given names with the surrogate of the surname, the given names are replaced.
    """
    tweak = f"{kind}/{attempt}"
    if kind == "email":
        local, _, domain = text.lower().rpartition("@")
        labels = domain.split(".")
        kept = 2 if labels[-2:] in (["example", "com"], ["example", "org"], ["example", "net"]) else 1
        place = permute_text(".".join(labels[:-kept]), key, f"{tweak}/domain") if labels[:-kept] else ""
        out = f"{permute_text(local, key, tweak)}@{'.'.join([*([place] if place else []), *labels[-kept:]])}"
        out = "".join(n.upper() if o.isupper() else n for o, n in zip(text, out, strict=True))
        return out if attempt < WIDER else out.replace("@", f"{_more(local, key, tweak, attempt)}@")
    if kind == "ip":
        number = 0
        for octet in text.split("."):
            number = number * 256 + int(octet)
        moved = permute(number, 1 << 32, key, tweak)
        moved = (number + 1) % (1 << 32) if moved == number else moved
        return ".".join(str(moved >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":
        digits = canonical(kind, text)
        state = luhn(digits)
        body = digits[0] + permute_text(digits[1:-1], key, tweak)
        return _refill(text, next(body + c for c in "0123456789" if luhn(body + c) == state))
    if kind in ("phone", "ssn"):
        digits = canonical(kind, text)
        lead = _lead(text)
        return _refill(text, digits[:lead] + permute_text(digits[lead:], key, tweak))
    more = _more(text, key, tweak, attempt) if attempt >= WIDER else ""
    if kind == "surname":
        return _one_name(text, key, tweak, [SURNAMES, GIVEN] if attempt < LISTED else []) + more
    *given, last = text.split(" ")
    lists = [GIVEN, SURNAMES] if attempt < LISTED else []
    given = [w if w.rstrip(".") in TITLES or re.fullmatch(r"\w\.", w) else _one_name(w, key, tweak, lists) for w in given]
    return " ".join([given[0] + more, *given[1:], last])


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and not overlapping, in code points."""
    if not text:
        return []
    found = [(m.start(), m.end(), m.lastgroup) for m in _NUMERIC.finditer(text)] if _HINT.search(text) else []
    taken = list(found)
    for m in _NAMES.finditer(text):
        if all(m.end() <= s or m.start() >= e for s, e, _ in taken):
            found.append((m.start(), m.end(), "name"))
    return sorted(found)


_HINT = re.compile(r"@|\d\D?\d\D?\d")


@lru_cache(maxsize=100_000)
def _replacement(kind: str, text: str, key: bytes, attempt: int) -> str:
    return surrogate(kind, text, key, attempt)


def _mention(kind: str, text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> str:
    """The replacement of a mention as it stands in a text; ``attempts`` of its entity and its surname, if not 0."""
    if kind != "name":
        return _replacement(kind, text, key, attempts.get((kind, canonical(kind, text)), 0))
    titles, (*given, last) = _parts(text)
    new = _replacement("surname", last, key, attempts.get(("surname", last), 0))
    if given:
        new = _replacement("name", " ".join([*given, new]), key, attempts.get(("name", " ".join([*given, last])), 0))
    return " ".join([*titles, new])


def _entities(kind: str, text: str) -> list[tuple[str, str]]:
    """The entities whose attempts a mention's replacement depends on."""
    whole = canonical(kind, text)
    return [(kind, whole), ("surname", whole.rpartition(" ")[2])] if kind == "name" else [(kind, whole)]


PAIRS = "kind string, entity string, form int, mention string, attempt int, surrogate string"


def entity_pairs(docs: DataFrame, text: str, key: bytes) -> DataFrame:
    """``PAIRS``, one for each entity of all texts, by canonical form, and each length of its country code."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {}
            for t in batch.column(0).to_pylist():
                for s, e, kind in find_entities(t):
                    place = kind, canonical(kind, t[s:e]), _lead(t[s:e]) if kind == "phone" else 0
                    if place not in seen:
                        seen[place] = t[s:e], canonical(kind, _mention(kind, t[s:e], key, {}))
            rows = [(*place, *said) for place, said in seen.items()]
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["kind", "entity", "form", "mention", "surrogate"])

    found = docs.select(text).mapInArrow(work, "kind string, entity string, form int, mention string, surrogate string")
    pairs = found.groupBy("kind", "entity", "form").agg(F.min("mention").alias("mention"), F.min("surrogate").alias("surrogate"))
    return pairs.select("kind", "entity", "form", "mention", F.lit(0).alias("attempt"), "surrogate")


def clashes(pairs: DataFrame, avoided: Column | None = None) -> DataFrame:
    """(kind, entity) whose surrogate is an entity, or also another's surrogate: all but the smallest of those that share one.

    ``avoided``: which pairs' entities no surrogate may equal, if not those of all.
    """
    first = pairs.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.max("entity").alias("last")).filter("first <> last")
    shared = pairs.join(first, ["kind", "surrogate"]).filter("entity <> first").select("kind", "entity")
    entities = (pairs if avoided is None else pairs.filter(avoided)).select("kind", F.col("entity").alias("surrogate"))
    return shared.union(pairs.join(entities, ["kind", "surrogate"], "left_semi").select("kind", "entity")).distinct()


def _without_clashes(pairs: DataFrame, key: bytes) -> DataFrame:
    """``PAIRS`` of kinds that do not depend on each other, at attempts that leave no clash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            for i, moved in enumerate(rows.pop("moved")):
                if moved:
                    rows["attempt"][i] += 1
                    rows["surrogate"][i] = canonical(rows["kind"][i], surrogate(rows["kind"][i], rows["mention"][i], key, rows["attempt"][i]))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([f for f in batch.schema if f.name != "moved"]))

    pairs = settle(pairs)
    # A surname is an entity where it is mentioned alone (form 1), and always its own.
    avoided = F.expr("kind <> 'surname' OR form = 1 OR entity = surrogate")
    for _ in range(MAX_ROUNDS):
        moved = settle(clashes(pairs, avoided))
        if moved.isEmpty():
            return pairs
        pairs = settle(pairs.join(moved.withColumn("moved", F.lit(True)), ["kind", "entity"], "left").select(*pairs.columns, "moved").mapInArrow(work, PAIRS))
    raise ValueError("the entities of some shape leave no free surrogates")


def _last_word(column: str) -> Column:
    return F.substring_index(column, " ", -1)


def _first_words(column: str) -> Column:
    """All but the last word, with the space behind them."""
    return F.col(column).substr(F.lit(1), F.length(column) - F.length(_last_word(column)))


def settled_pairs(pairs: DataFrame, key: bytes) -> DataFrame:
    """``pairs`` with the attempt and surrogate of each at which no clash is left, and a pair of kind "surname" for each
    surname, mentioned alone (form 1) or not (0). Full names keep what is settled for their surnames."""
    pairs = settle(pairs)
    names, alone = pairs.filter("kind = 'name'"), ~F.col("entity").contains(" ")
    surname = F.struct(F.lit("surname").alias("kind"), _last_word("entity").alias("entity"), alone.cast("int").alias("form"), _last_word("entity").alias("mention"))
    surnames = names.groupBy(surname.alias("of")).agg(F.min(_last_word("surrogate")).alias("surrogate"))
    surnames = surnames.select("of.*", F.lit(0).alias("attempt"), "surrogate")
    apart = _without_clashes(pairs.filter("kind <> 'name'").unionByName(surnames), key)

    new = apart.filter("kind = 'surname'").select(F.col("entity").alias("_last"), F.col("surrogate").alias("_new")).distinct()
    full = spread_join(names.filter(~alone).withColumn("_last", _last_word("entity")), new, ["_last"])
    full = full.withColumn("mention", F.concat(_first_words("entity"), "_new")).withColumn("surrogate", F.concat(_first_words("surrogate"), "_new"))
    return apart.unionByName(_without_clashes(full.select(*pairs.columns), key))


OUT = "text string, n_entities int, spans string"


def _texts(texts: pd.Series, key: bytes, attempts: Iterator) -> pd.DataFrame:
    """OUT of texts, each with a table of the attempts of its moved entities."""
    rows = []
    for t, attempt in zip(texts, attempts, strict=False):
        spans = find_entities(t)
        parts, at = [], 0
        for s, e, kind in spans:
            parts += [t[at:s], _mention(kind, t[s:e], key, attempt)]
            at = e
        rows.append(("".join([*parts, t[at:]]) if spans else t, len(spans), ",".join(f"{k}:{s}:{e}" for s, e, k in spans)))
    return pd.DataFrame(rows, columns=["text", "n_entities", "spans"])


def _moved_by_text(docs: DataFrame, text: str, moved: DataFrame) -> DataFrame:
    """mark (a hash of the text) and its moved entities: as many as the text holds. A frequent entity is dealt over tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(m, *x) for m, t in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True) for s, e, k in find_entities(t) for x in _entities(k, t[s:e])}
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["mark", "kind", "entity"])

    found = settle(docs.select(F.xxhash64(text).alias("mark"), text).mapInArrow(work, "mark long, kind string, entity string").distinct())
    held = spread_join(found, moved, ["kind", "entity"])
    return settle(held.groupBy("mark").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("moved")))


def replace_entities(docs: DataFrame, text: str = "text", key: bytes = KEY, inline: int = INLINE) -> DataFrame:
    """``docs`` with the text's entities replaced, ``n_entities`` and ``spans`` (kind:start:end of the original text)."""
    spark = docs.sparkSession
    pairs = settled_pairs(entity_pairs(docs, text, key), key)
    moved = pairs.filter("attempt > 0").select("kind", "entity", "attempt").distinct()
    listed = moved.limit(inline + 1).collect()
    new, mark, held = (free_name(docs, n) for n in ("new_text", "text_mark", "text_moved"))
    if len(listed) <= inline:
        again = spark.sparkContext.broadcast({(r["kind"], r["entity"]): r["attempt"] for r in listed})

        @F.pandas_udf(OUT)
        def alike(texts: pd.Series) -> pd.DataFrame:
            return _texts(texts, key, repeat(again.value))

        out = docs.withColumn(new, alike(F.col(text)))
    else:

        @F.pandas_udf(OUT)
        def apart(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
            return _texts(texts, key, ({} if v is None else {(r["kind"], r["entity"]): r["attempt"] for r in v} for v in lists))

        told = _moved_by_text(docs, text, moved).select(F.col("mark").alias(mark), F.col("moved").alias(held))
        joined = docs.withColumn(mark, F.xxhash64(text)).join(told, mark, "left")
        out = joined.withColumn(new, apart(F.col(text), F.col(held)))
    others = [F.col(new)["text"].alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*others, *[F.col(new)[n].alias(free_name(docs, n)) for n in ("n_entities", "spans")])


def op3_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
