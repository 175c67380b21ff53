"""Surrogates for personal data.

Detected entities (mail addresses, IP addresses of both versions, phone and card numbers, account and social
numbers, keys and passwords, titled names) are replaced by surrogates of the same
kind. Formatted ones go through a keyed permutation of all strings of their format:
a Feistel network in the mixed radix of their letters and digits. It keeps
separators, case, script (letters outside of the fixed alphabets stay in their
block of 128 characters), a card's check digit and a number's leading signs, and no
two entities of one format can meet. A mail address is permuted in two parts, so its
domain's surrogate is that of all its addresses. Parts of addresses and secrets without
a letter or digit are drawn by key; a secret of one sign repeated is a mask already and
stays.
Names are drawn by key from syllables of their script with the ending of the title's
gender, or permuted in other scripts; given and family names are replaced one by
one, and later mentions in the document without the title follow.

One key gives one surrogate to an entity in every document. Before the texts are
rewritten, Spark compares all distinct entities: where two share a surrogate, or a
surrogate is itself an entity of the corpus (in a permuted format: the same entity), the
later ones are drawn again until none do; after ``DRAWS`` draws, which only formats of
very few strings reach, a warning is given and what is left stays. Each draw gives names a syllable more, and later draws lengthen secrets, mail
addresses and phone numbers. The draws are a table, broadcast where it is small and
joined to the texts' entities where not.

Null texts stay null, empty ones empty. Repeated rows get equal results. Columns of
documents pass by; ``pii`` (the replaced kinds) is added or replaced. Overlapping
entities: the one that starts first, then the longest. Empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofmill.llm import memo
from proofmill.llm.shared import at_most, maybe_broadcast, table, written
from proofmill.llm.vec import slices

#: The setting of the session that holds the secret key, and the key of tests and demonstrations: who knows it can undo the permutations.
KEY_SETTING, DEMO_KEY = "spark.proofmill.surrogateKey", b"known to everybody"
ROUNDS = 6
HELD = 200_000  # overrides in a broadcast; more are joined
DRAWS = 50
#: Kinds whose first surrogates are a permutation of all strings of a format, so no two can meet.
PERMUTED = ("key", "ip", "ipv6", "iban", "social", "card")
SAME_LENGTH = 3  # draws before surrogates grow
#: Alphabets that a letter or digit stays in.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: Fixed value: signs that a secret without letters or digits is drawn from.
SIGNS = "!#$%&*+-./:=?@^_~"
HEX = ("0123456789", "abcdef", "ABCDEF")
#: Titles by gender.
TITLES = {"m": "Mr Herr Monsieur Señor Sr господин".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra госпожа".split(), "n": "Dr Prof".split()}
#: Syllables and endings by script.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi na ne no pa pe ra re ri ro sa se ta te va ve wa za".split(), "cyrillic": "ба бе бо да де до ка ке ла ле ли ло ма ме ми на не но па пе ра ре ри ро са се та те ва ве за".split(), "greek": "βα βε γα δα δε κα κε λα λε λι μα με μι να νε νο πα πε ρα ρε σα σε τα τε".split()}
ENDINGS = {("latin", "m"): "rd", ("latin", "f"): "na", ("latin", "n"): "l", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на", ("cyrillic", "n"): "л", ("greek", "m"): "ς", ("greek", "f"): "η", ("greek", "n"): "ν"}
#: A capital and further letters of either case.
_NAME = r"(?:[DO]['’])?[^\W\d_a-zа-яα-ω][^\W\d_]+"
_HEXES = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
#: Fixed value: particles between or before names, which stay.
PARTICLES = "van von der den de del della di da la le zu bin al".split()
KINDS = {
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"(?i:\b(?:token|password|passwd|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)(?P<value>[^\s\"',;]{6,})",
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ipv6": rf"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:{_HEXES})?::(?:{_HEXES})?)(?![\w:])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b",
    "social": r"(?<![\w-])\d{3}(?P<gap>[ -])\d{2}(?P=gap)\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}(?P<between>[ .-])\d{3}(?P=between)\d{4}|0\d{2,4}[ /-]\d{5,9})(?![\w-])",
    "name": rf"\b(?P<title>{'|'.join(t for ts in TITLES.values() for t in ts)})\.? (?P<person>(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_NAME}(?:[ -](?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_NAME}){{0,2}})",
}
PATTERN = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in KINDS.items()))
_ASSIGN = re.compile(KINDS["secret"])
_TITLED = re.compile(KINDS["name"])
#: A text without any of these holds no entity.
HINT = re.compile(rf"[@\d]|(?i:token|passw|secret|api.?key)|{'|'.join(t + r'[. ]' for ts in TITLES.values() for t in ts)}")
GENDER = {t: g for g, ts in TITLES.items() for t in ts}


def surrogate_key(spark: SparkSession) -> bytes:
    """The key in ``KEY_SETTING``; without one a warning is given and the demonstration's key is taken."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is unset: surrogates are made with a key that everybody knows", stacklevel=2)
    return key.encode() if key else DEMO_KEY


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest(), "big")


def _kept_case(c: str) -> bool:
    """Whether changing the case there and back gives ``c`` again, in one character."""
    return len(c.upper()) == len(c.lower()) == 1 and c in (c.upper().lower(), c.lower().upper())


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """What a letter or digit may turn into; empty for other characters."""
    fixed = next((a for a in ALPHABETS if c in a), "")
    kind = unicodedata.category(c)
    if fixed or kind[0] != "L" and kind != "Nd":
        return fixed
    block = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in block if unicodedata.category(x) == kind and _kept_case(x) == _kept_case(c) and not any(x in a for a in ALPHABETS))


def permute(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """The image of ``text`` under a keyed permutation of the strings of its format."""
    own = [next((a for a in alphabets if c in a), None) or alphabet(c) for c in text]
    where = [(i, a) for i, a in enumerate(own) if a]
    shape = "".join(a[0] if a else c for a, c in zip(own, text, strict=True))
    digits, radix = [a.index(text[i]) for i, a in where], [len(a) for _, a in where]
    n = len(digits)
    halves = (range(0, n // 2), range(n // 2, n))
    for k in range(ROUNDS):
        mine, other = halves[k % 2], halves[1 - k % 2]
        x = _number(key, tweak, shape, str(k), ",".join(str(digits[i]) for i in other))
        for i in mine:
            x, r = divmod(x, radix[i]) if x > 1 << 64 else divmod(_number(key, tweak, str(k), str(i), str(x)), radix[i])
            digits[i] = (digits[i] + r) % radix[i]
    out = list(text)
    for (i, a), d in zip(where, digits, strict=True):
        out[i] = a[d]
    return "".join(out)


def _drawn(n: int, signs: str, key: bytes, *parts: str) -> str:
    """``n`` of ``signs`` by key."""
    return "".join(signs[_number(key, str(i), *parts) % len(signs)] for i in range(n))


def _fixed(text: str) -> bool:
    """Whether the permutation can't change ``text``."""
    return all(len(alphabet(c)) < 2 for c in text)


def _part(text: str, key: bytes, tweak: str) -> str:
    """A part of a mail address: permuted, or drawn where it has no letter or digit."""
    if not _fixed(text):
        return permute(text, key, tweak)
    return "".join(c if c == "." else _drawn(1, ALPHABETS[1], key, tweak, text, str(i)) for i, c in enumerate(text))


def _grown(text: str, attempt: int, key: bytes, tweak: str) -> str:
    """What later draws add: characters like the first that can change."""
    more = max(0, attempt - SAME_LENGTH)
    signs = next((a for a in map(alphabet, text) if len(a) > 1), ALPHABETS[1])
    return _drawn(more, signs, key, tweak, "more", text) if more else ""


def _luhn(digits: list[int]) -> int:
    """The check digit that belongs after ``digits``."""
    return -sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def _script(text: str) -> str:
    if re.search("[Ѐ-ӿ]", text):
        return "cyrillic"
    if re.search("[Ͱ-Ͽ]", text):
        return "greek"
    return "latin" if all(unicodedata.name(c, "").startswith("LATIN") for c in text if c.isalpha()) else "other"


def _person(name: str, gender: str, attempt: int, tweak: str, key: bytes) -> str:
    script = _script(name)
    if script == "other":
        return permute(name, key, tweak) + _grown(name, attempt, key, tweak)
    x = _number(key, tweak, "name", gender, name.lower())
    out = ""
    for _ in range(3 + attempt):
        x, r = divmod(x, len(SYLLABLES[script]))
        out += SYLLABLES[script][r]
    out += ENDINGS[script, gender]
    return out.upper() if name.isupper() else out.capitalize()


def surrogate(kind: str, text: str, attempt: int, key: bytes = DEMO_KEY) -> str:
    """The replacement of an entity in its own format; ``attempt`` draws again."""
    tweak = f"{kind}{attempt}"
    if kind in ("male", "female", "family"):
        return _person(text, {"male": "m", "female": "f"}.get(kind, "n"), attempt, tweak, key)
    if kind == "email":
        head, _, end = text.rpartition(".")
        local, _, domain = head.rpartition("@")
        # a domain has one surrogate in all its addresses, whatever the draw
        host = _part(domain, key, f"domain{end.lower()}")
        return f"{_grown(local, attempt, key, tweak)}{_part(local, key, tweak)}@{host}.{end}"
    if kind == "ipv6":
        return permute(text, key, tweak, HEX)
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        for k in range(ROUNDS):
            a, b = ((0, 1), (2, 3)) if k % 2 else ((2, 3), (0, 1))
            x = _number(key, tweak, str(k), *(str(octets[i]) for i in b))
            for i in a:
                x, r = divmod(x, 256)
                octets[i] = (octets[i] + r) % 256
        return ".".join(map(str, octets))
    if kind == "card":
        at = [i for i, c in enumerate(text) if c.isdigit()]
        old = [int(text[i]) for i in at]
        inner = permute("".join(map(str, old[1:-1])), key, tweak + str(old[0]) + re.sub(r"\d", "0", text))
        new = [old[0], *map(int, inner)]
        new.append((old[-1] - _luhn(old[:-1]) + _luhn(new)) % 10)
        out = list(text)
        for i, d in zip(at, new, strict=True):
            out[i] = str(d)
        return "".join(out)
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=\D)", text)
        fixed = country[0] if country else ""
        return fixed + permute(text[len(fixed) :], key, tweak + fixed) + _grown(text[len(fixed) :], attempt, key, tweak)
    if kind == "key":
        return text[:4] + permute(text[4:], key, tweak)
    if kind == "iban":
        return text[:2] + permute(text[2:], key, tweak + text[:2])
    more = _grown(text, attempt, key, tweak) if kind == "secret" else ""
    if _fixed(text):
        return _drawn(len(text), SIGNS, key, tweak, text) + more
    return permute(text, key, tweak, HEX if re.fullmatch(r"[0-9a-fA-F]+", text) else ALPHABETS) + more


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, in order, none overlapping."""
    if not HINT.search(text):
        return []
    out, people = [], {}
    for m in PATTERN.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        if m["secret"] is not None:
            kind, (a, b) = "secret", m.span("value")
        elif m["name"] is not None:
            gender = GENDER[m["title"]]
            parts = list(re.finditer(_NAME, m["person"]))
            for k, p in enumerate(parts):
                if k == len(parts) - 1:
                    role = "family"
                else:
                    role = {"m": "male", "f": "female"}.get(gender, "family")
                role = people.setdefault(p[0], role)
                for form in (p[0].upper(), p[0].capitalize() if p[0].isupper() else p[0]):
                    people.setdefault(form, role)
                out.append((m.start("person") + p.start(), m.start("person") + p.end(), role, p[0].lower()))
            continue
        else:
            kind = next(k for k in KINDS if m[k] is not None)
        found = text[a:b]
        if kind == "secret" and len(set(found)) == 1 and not found[0].isalnum():
            continue
        if kind == "phone" and not 7 <= sum(c.isdigit() for c in found) <= 15:
            continue
        out.append((a, b, kind, found.lower() if kind == "email" else found))
    if people:
        taken = {i for a, b, *_ in out for i in range(a, b)}
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, people)) + r")\b", text):
            if m.start() not in taken and m.end() - 1 not in taken:
                out.append((*m.span(), people[m[0]], m[0].lower()))
        out.sort()
    return out


def _cased(original: str, new: str) -> str:
    """``new`` with the letter case of ``original``, place by place where the lengths agree."""
    if original.islower() or original == new:
        return new
    if len(original) == len(new):
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new, strict=True))
    return new.upper() if original.isupper() else new.capitalize()


def rewrite(text: str, overrides: dict, key: bytes = DEMO_KEY) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    out, at, kinds = [], 0, []
    for a, b, kind, form in entities(text):
        if a < at:
            continue
        new = surrogate(kind, form, overrides.get((kind, form), 0), key)
        out += [text[at:a], _cased(text[a:b], new) if kind in ("email", "male", "female", "family") else new]
        kinds.append(kind)
        at = b
    return "".join([*out, text[at:]]), kinds


def distinct_entities(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """kind, form, new: the distinct entities of all documents and their first surrogates."""

    @memo.task()
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                seen = {(kind, form) for text in part.column("text").to_pylist() if text for _, _, kind, form in entities(text)}
                rows = [(kind, form, surrogate(kind, form, 0, key)) for kind, form in seen]
                yield pa.record_batch({c: pa.array([r[i] for r in rows], pa.string()) for i, c in enumerate(("kind", "form", "new"))})

    return docs.select("text").mapInArrow(find, "kind string, form string, new string").distinct()


def drawn_again(found: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """kind, form, attempt of the entities whose first surrogate another one has or that is itself an entity."""
    state = found.withColumn("attempt", F.lit(0))
    entity = found.select("kind", F.lower("form").alias("mark")).distinct()
    for attempt in range(1, DRAWS):
        # a name's surrogate is compared without case
        keyed = state.withColumn("mark", F.lower("new"))
        shared = keyed.groupBy("kind", "mark").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "form")).alias("keeps")).filter("n > 1")
        twice = keyed.join(shared, ["kind", "mark"]).filter("form <> keeps.form").select("kind", "form")
        # what a permutation turned into another entity of its format is fine: that one is turned into something else
        plain = ~F.col("kind").isin(*PERMUTED)
        own = keyed.filter(plain).join(entity, ["kind", "mark"], "left_semi").select("kind", "form").union(keyed.filter(~plain & (F.col("new") == F.col("form"))).select("kind", "form"))
        again = written(twice.union(own).distinct(), "again")
        if not again.limit(1).count():
            return state.filter("attempt > 0").select("kind", "form", "attempt")

        def draw(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, forms = (batch.column(c).to_pylist() for c in ("kind", "form"))
                new = [surrogate(kind, form, attempt, key) for kind, form in zip(kinds, forms, strict=True)]
                yield pa.record_batch({"kind": batch.column("kind"), "form": batch.column("form"), "new": pa.array(new, pa.string()), "attempt": pa.array([attempt] * len(new), pa.int32())})

        drawn = again.mapInArrow(draw, "kind string, form string, new string, attempt int")
        state = written(state.join(maybe_broadcast(again, HELD), ["kind", "form"], "left_anti").unionByName(drawn), "entities")
    # formats so full that draws keep meeting: the last ones stay
    warnings.warn(f"some entities share surrogates after {DRAWS} draws", stacklevel=2)
    return state.filter("attempt > 0").select("kind", "form", "attempt")


def collision_overrides(found: DataFrame, key: bytes = DEMO_KEY) -> dict[tuple[str, str], int]:
    """The table of ``drawn_again``, collected."""
    return {(r.kind, r.form): r.attempt for r in drawn_again(found, key).collect()}


def _again(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """k1, k2, again: the overrides of each distinct text of ``docs`` (k1, k2, text)."""

    @memo.task()
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                k1, k2, texts = (part.column(c).to_pylist() for c in ("k1", "k2", "text"))
                rows = [(a, b, *e) for a, b, t in zip(k1, k2, texts, strict=True) if t for e in {(kind, form) for _, _, kind, form in entities(t)}]
                yield pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate({"k1": pa.int64(), "k2": pa.int64(), "kind": pa.string(), "form": pa.string()}.items())})

    found = docs.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, kind string, form string").distinct()
    return found.join(overrides, ["kind", "form"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("again"))


def replace_pii(docs: DataFrame, key: bytes | None = None, held: int = HELD) -> DataFrame:
    """Documents with surrogates in ``text``, and ``pii``: the kinds replaced, in order. ``key``: None for the session's."""
    key = surrogate_key(docs.sparkSession) if key is None else key
    docs = docs.drop("pii")
    overrides = drawn_again(written(distinct_entities(docs, key), "entities"), key)
    names, fields = docs.columns, docs.schema.fields
    join = not at_most(overrides, held)
    shared = docs.sparkSession.sparkContext.broadcast({} if join else {(r.kind, r.form): r.attempt for r in overrides.collect()})
    if join:
        keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
        docs = keyed.join(_again(keyed.select("k1", "k2", "row.text"), overrides), ["k1", "k2"], "left").select(*[F.col("row")[c].alias(c) for c in names], F.col("again").alias("_again"))

    @memo.task()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                again = [{(x["kind"], x["form"]): x["attempt"] for x in xs or []} for xs in part.column("_again").to_pylist()] if join else [shared.value] * len(texts)
                done = [(None, []) if t is None else rewrite(t, o, key) for t, o in zip(texts, again, strict=True)]
                columns = [pa.array([t for t, _ in done], part.column(c).type) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([k for _, k in done], pa.list_(pa.string()))], names=[*names, "pii"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("pii", T.ArrayType(T.StringType()))]))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), "pii")
