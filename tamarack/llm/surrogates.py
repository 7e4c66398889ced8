"""Personal data: keyed, type-consistent surrogates for detected entities."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tamarack.llm.common import Scratch, free_names, map_arrow, row_key, strings

#: Titles that announce a name, by gender (fixed values).
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа", "госпожа", "κυρία"),
    "n": ("Dr", "Prof"),
}
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f"}
#: First names by script and gender, and the syllables of surnames by script (fixed values).
FIRST = {
    "latin": {"m": "Adam Boris Carl Daniel Erik Felix Georg Hugo Ivan Jonas Karl Louis".split(), "f": "Anna Bella Clara Diana Elsa Flora Greta Helen Irene Julia Karin Laura".split(), "n": "Alex Charlie Robin Kim Sascha Dominique Andrea Jules Noa Remi Sam Toni".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор".split(), "f": "Анна Вера Галина Дарья Елена Жанна".split(), "n": "Саша Женя Валя Слава".split()},
    "greek": {"m": "Άρης Γιάννης Δήμος Ηλίας".split(), "f": "Άννα Δήμητρα Ελένη Ζωή".split(), "n": "Άρτεμις Φώτη".split()},
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ge go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га ге го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то".split(),
    "greek": "βα βε βο δα δε δο γα γε γο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}
#: Alphabets within which characters are exchanged; a character outside all of them stays.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_PLACE = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}
_HAN = range(0x4E00, 0x9FA6)

#: Words that stand between the parts of a name and stay as they are (fixed values).
PARTICLES = "van von der den de del della di da du dos la le el al bin ibn ter ten zu zur y".split()
_NAME = r"[^\W\d_a-zà-ÿа-яα-ω][^\W\d_]*(?:['’-][^\W\d_]+)*"
_TITLE = re.compile(r"\b(" + "|".join(re.escape(t) for g in TITLES.values() for t in g) + rf")\b\.?[ \t]+({_NAME}(?:[ \t]+(?:(?:{'|'.join(PARTICLES)})[ \t]+){{0,3}}{_NAME}){{0,3}})")
_HAN_NAME = re.compile(r"([一-龥]{2,3})(" + "|".join(HAN_TITLES) + ")")
_EMAIL = re.compile(r"[\w.+%-]*\w@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_SECRET = re.compile(r"(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd|bearer)\b[\"']?(?:\s*[:=]\s*|\s+)[\"']?((?=[^\s\"']*\d)[A-Za-z0-9_+/=.-]{8,})")
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")
_NUMBER = re.compile(r"(?<![\w.,])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d+(?:[ .-]\d+)*(?!\w)")
#: An international number, whatever marks stand between its groups.
_PHONE = re.compile(r"(?<!\w)\+\d{1,3}[^\w\n(]{0,6}\(\d{1,5}\)[^\w\n]{1,6}\d{2,4}[^\w\n]{1,4}\d{3,4}(?!\w)")
BLOT = "\x7f"
_ANY_TITLE = tuple(t for g in TITLES.values() for t in g)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _number_kind(text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", text):
        return "ssn"
    if re.fullmatch(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5}", text):
        return "card"
    if 7 <= len(digits) <= 15 and ("+" in text or "(" in text or re.fullmatch(r"\d{2,5}[ .-]\d{3,4}[ .-]\d{3,4}|0\d{6,}", text)):
        return "phone"
    return None


def _numbers(text: str, start: int, end: int) -> list[tuple[int, int, str, str]]:
    """The entities within numbers that follow each other: at each one the longest that has a kind."""
    runs = [(start, end)] if end - start < 8 else [m.span() for m in re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d+").finditer(text, start, end)]
    found, k = [], 0
    while k < len(runs):
        for j in range(min(k + 5, len(runs) - 1), k - 1, -1):  # the longest kind has six groups of digits
            a, b = runs[k][0], runs[j][1]
            if b - a <= 30 and (kind := _number_kind(text[a:b])):
                found.append((a, b, kind, re.sub(r"[^\d+]", "", text[a:b])))
                k = j
                break
        k += 1
    return found


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, kind, canonical form), left to right, without overlaps.

    The canonical form is what mentions of one entity share: without separators, lower case
    for mail addresses, single words for names.
    """
    found: list[tuple[int, int, str, str]] = []
    rest = text  # what an earlier kind has taken is blotted out for the later ones

    def take(spans: list[tuple[int, int, str, str]]) -> None:
        nonlocal rest
        parts, end = [], 0
        for a, b, kind, entity in spans:  # in order, and none overlaps another
            if BLOT not in rest[a:b]:
                found.append((a, b, kind, entity))
                parts += [rest[end:a], BLOT * (b - a)]
                end = b
        if parts:
            rest = "".join([*parts, rest[end:]])

    digits = bool(_DIGIT.search(text))
    if digits:
        take([(*m.span(1), "secret", m[1]) for m in _SECRET.finditer(rest)])
        take([(*m.span(), "secret", m[0]) for m in _KEYS.finditer(rest)])
    if "@" in rest:
        take([(*m.span(), "email", m[0].lower()) for m in _EMAIL.finditer(rest)])
    if digits:
        take([(*m.span(), "iban", m[0].replace(" ", "")) for m in _IBAN.finditer(rest)])
        take([(*m.span(), "ip", m[0]) for m in _IP.finditer(rest)])
        take([(*m.span(), "phone", re.sub(r"[^\d+]", "", m[0])) for m in _PHONE.finditer(rest)])
        take([n for m in _NUMBER.finditer(rest) for n in _numbers(rest, *m.span())])
    names = []
    for m in _TITLE.finditer(rest) if any(t in rest for t in _ANY_TITLE) else ():
        gender = next(g for g, titles in TITLES.items() if m[1] in titles)
        words = [w for w in re.finditer(r"\S+", m[2]) if w[0] not in PARTICLES]
        for k, w in enumerate(words):
            part = "last" if k == len(words) - 1 else f"first.{gender}"
            names.append((m.start(2) + w.start(), m.start(2) + w.end(), f"{part}.{script_of(w[0])}", w[0].lower()))
    told = {entity: kind for _, _, kind, entity in names if kind.startswith(("first.m", "first.f"))}
    # one person, whatever the title: a first name that another title gives a gender has it here too
    names = [(a, b, told.get(entity, kind) if kind.startswith("first.n") else kind, entity) for a, b, kind, entity in names]
    take(names)
    if names:
        take(_bare(rest, names))
    take([(*m.span(1), f"han.{HAN_TITLES[m[2]]}", m[1]) for m in _HAN_NAME.finditer(rest)])
    return sorted(found)


def _bare(text: str, names: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions without a title, anywhere in the text, of names found in it; single letters and words in lower case are none."""
    known: dict[str, str] = {}
    for _, _, kind, entity in names:
        if len(entity) > 1:
            known.setdefault(entity, kind)
    if not known:
        return []
    either = "|".join(map(re.escape, sorted(known, key=lambda e: (-len(e), e))))
    found = []
    for m in re.finditer(rf"(?<![^\W_])(?:{either})(?![^\W_])", text, re.IGNORECASE):
        kind = known.get(m[0].lower())
        if kind and not m[0][0].islower():
            found.append((*m.span(), kind, m[0].lower()))
    return found


class Surrogates:
    """Surrogates under a key. Kinds made of characters go through a keyed permutation of all
    strings of the same pattern (a Feistel network with cycle walking), so different entities
    of a pattern cannot meet; names draw from pools by script and gender. ``attempt`` gives
    another choice, for the few that the collision check sends back."""

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _draw(self, *what: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, what)).encode(), key=self.key, digest_size=32).digest(), "big")

    def permute(self, x: int, size: int, *tweak: object) -> int:
        """A keyed permutation of range(size)."""
        if size < 2:
            return x
        half = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for r in range(8):
                a, b = b, a ^ (self._draw(r, size, b, *tweak) & mask)
            x = a << half | b
            if x < size:
                return x

    def characters(self, text: str, *tweak: object) -> str:
        """Each character stays in its alphabet; strings of one pattern are permuted among themselves."""
        places = [_PLACE.get(c) for c in text]
        value, size = 0, 1
        for p in places:
            if p:
                value, size = value * len(p[0]) + p[1], size * len(p[0])
        if size < 2:  # no character of a known alphabet: the collision check keeps such draws apart
            return hashlib.blake2b("\x1f".join([text, *map(str, tweak)]).encode(), key=self.key).hexdigest()[: max(8, len(text))]
        pattern = "".join(str(ALPHABETS.index(p[0])) if p else c for p, c in zip(places, text, strict=True))
        value, out = self.permute(value, size, pattern, *tweak), []
        for p, c in zip(reversed(places), reversed(text), strict=True):
            if p:
                value, k = divmod(value, len(p[0]))
                c = p[0][k]
            out.append(c)
        return "".join(reversed(out))

    def canonical(self, kind: str, entity: str, attempt: int = 0) -> str:
        """The surrogate's canonical form."""
        if kind == "email":
            local, _, domain = entity.partition("@")
            *labels, top = domain.split(".")
            return ".".join([f"{self.characters(local, kind, domain, attempt)}@{self.characters('.'.join(labels), 'domain', top)}", top])
        if kind == "ip":
            spans = [(0, 10) if len(o) == 1 else (10, 90) if len(o) == 2 else (100, 156) for o in entity.split(".")]
            value, size = 0, 1
            for o, (low, n) in zip(entity.split("."), spans, strict=True):
                value, size = value * n + int(o) - low, size * n
            value, out = self.permute(value, size, kind, [n for _, n in spans], attempt), []
            for low, n in reversed(spans):
                value, k = divmod(value, n)
                out.append(str(low + k))
            return ".".join(reversed(out))
        if kind == "card":
            if luhn(entity):
                body = entity[0] + self.characters(entity[1:-1], kind, attempt)
                return next(body + c for c in "0123456789" if luhn(body + c))
            out = entity
            while True:  # the walk stays among numbers that fail the check, as the entity does
                out = out[0] + self.characters(out[1:], kind, "odd", attempt)
                if not luhn(out):
                    return out
        if kind == "iban":
            bban = self.characters(entity[4:], kind, entity[:2], attempt)
            digits = "".join(str(int(c, 36)) for c in bban + entity[:2] + "00")
            return f"{entity[:2]}{98 - int(digits) % 97:02d}{bban}"
        if kind == "phone" and entity.startswith("+"):
            keep = len(entity) - 10 if len(entity) > 11 else 2
            return entity[:keep] + self.characters(entity[keep:], kind, entity[:keep], attempt)
        if kind.startswith(("first.", "last.")) and (parts := re.split("([-'’])", entity))[1:]:  # each part of a double name for itself
            return "".join(x if k % 2 else self.canonical(kind, x, attempt) if x else "" for k, x in enumerate(parts))
        if kind.startswith("first."):
            _, gender, script = kind.split(".")
            pool = FIRST[script][gender]
            return pool[self._draw(kind, entity, attempt) % len(pool)].lower() if attempt < 3 else self._syllables(kind, script, entity, attempt)
        if kind.startswith("last."):
            return self._syllables(kind, kind.split(".")[1], entity, attempt)
        if kind.startswith("han."):
            value, size = 0, 1
            for c in entity:
                value, size = value * len(_HAN) + ord(c) - _HAN[0], size * len(_HAN)
            value, out = self.permute(value, size, kind, len(entity), attempt), []
            for _ in entity:
                value, k = divmod(value, len(_HAN))
                out.append(chr(_HAN[k]))
            return "".join(out)
        return self.characters(entity, kind, attempt)

    def _syllables(self, kind: str, script: str, entity: str, attempt: int) -> str:
        """A word of syllables; later attempts draw longer ones, so that a free one is always found."""
        pool, x, out = SYLLABLES[script], self._draw(kind, entity, attempt), []
        for _ in range(max(2, min(6, len(entity) // 2)) + attempt // 2):
            x, k = divmod(x, len(pool))
            out.append(pool[k])
        return "".join(out)

    def render(self, kind: str, mention: str, canonical: str) -> str:
        """The surrogate in the mention's dress: its separators, its upper and lower case."""
        if kind in ("card", "phone", "ssn", "iban"):
            drawn = iter(canonical)
            return "".join(next(drawn) if c.isalnum() or c == "+" else c for c in mention)
        if kind == "email" and len(canonical) == len(mention):
            return "".join(c.upper() if m.isupper() else c for m, c in zip(mention, canonical, strict=True))
        if kind.startswith(("first.", "last.")):
            if len(mention) > 1 and mention.isupper():
                return canonical.upper()
            inner = {k for k, c in enumerate(mention) if k and c.isupper() and mention[k - 1].isalpha()}  # as in McDonald
            made = "".join(x.capitalize() for x in re.split("([-'’])", canonical))
            return "".join(c.upper() if k in inner and "-" not in mention else c for k, c in enumerate(made))
        return canonical


def _entities(docs: DataFrame, text_col: str, key: bytes, attempt: int = 0) -> DataFrame:
    """kind, entity, surrogate, attempt: of each entity once per batch."""
    maker = Surrogates(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({s[2:] for t in strings(batch.column(0)) for s in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string()), pa.array([maker.canonical(k, e, attempt) for k, e in seen], pa.string()), pa.array([attempt] * len(seen), pa.int32())], names=["kind", "entity", "surrogate", "attempt"])

    return map_arrow(docs.select(F.col(text_col).cast("string")), run, "kind string, entity string, surrogate string, attempt int").distinct()


def _again(rows: DataFrame, key: bytes) -> DataFrame:
    maker = Surrogates(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [maker.canonical(k, e, a + 1) for k, e, a in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([a + 1 for a in batch.column(2).to_pylist()], pa.int32())], names=["kind", "entity", "surrogate", "attempt"])

    return map_arrow(rows.select("kind", "entity", "attempt"), run, "kind string, entity string, surrogate string, attempt int")


def resolve(docs: DataFrame, key: bytes, *, text_col: str = "text", scratch: Scratch) -> DataFrame:
    """kind, entity, surrogate, attempt of every distinct entity, no two of a kind (or first names of a script) with one surrogate.

    What shares a surrogate with another entity (all but the first of them), or is its own
    surrogate, takes its next attempt, until nothing does. First names beyond their pool become
    words of syllables.
    """
    table = scratch.cut(_entities(docs, text_col, key), "entities")
    while True:
        meant = table.withColumn("among", F.regexp_replace("kind", r"^first\.[mfn]\.", "first."))
        shared = meant.groupBy("among", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        crowded = meant.join(shared, ["among", "surrogate"]).where(F.col("entity") != F.col("keeps.entity")).select("kind", "entity", "attempt")
        own = table.where(F.col("entity") == F.col("surrogate")).select("kind", "entity", "attempt")
        sent_back = scratch.cut(crowded.union(own).distinct(), "sent-back")
        if sent_back.isEmpty():
            return table
        kept = table.join(sent_back.select("kind", "entity"), ["kind", "entity"], "left_anti")
        table = scratch.cut(kept.unionByName(_again(sent_back, key)), "entities")


#: Up to so many re-drawn entities go to every task; more are joined to the documents that mention them.
REDRAWN_ROWS = 20_000


def replace_entities(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and added ``n_entities`` and ``kinds`` (``card:1,email:2``).

    An entity gets one surrogate wherever it occurs; different entities get different ones;
    the key decides which, and without it they cannot be undone or linked. Names are found by a
    title, and then wherever they stand in the same text; particles between their parts stay. A
    first name under a title without gender has the gender that another title gives it in its text. Format, script,
    gender and validity (check digits, octets) match. Null texts stay null with 0 entities;
    empty texts, very long ones, repeated rows and an empty table need nothing special; an added
    name that exists gets an underscore.
    """
    added = free_names(docs.columns, ["n_entities", "kinds"])
    scratch = Scratch(docs.sparkSession, "surrogates")
    redrawn = resolve(docs, key, text_col=text_col, scratch=scratch).where("attempt > 0").select("kind", "entity", "attempt")
    few = redrawn.limit(REDRAWN_ROWS + 1).collect()  # bounded: only whether there are more is asked
    overrides: dict | None = {(r.kind, r.entity): r.attempt for r in few} if len(few) <= REDRAWN_ROWS else None
    source = docs.select("*", F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>").alias("\x01redrawn"))
    if overrides is None:
        keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(r, *e) for r, t in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True) for e in sorted({s[2:] for s in detect(t)})]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.string(), pa.string()))], names=["row", "kind", "entity"])

        each = map_arrow(keyed, mentions, "row binary, kind string, entity string").distinct().join(redrawn, ["kind", "entity"])
        each = each.groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("\x01redrawn"))  # of one text
        source = docs.withColumn("\x01row", row_key(F.col(id_col), F.col(text_col))).join(each.withColumnRenamed("row", "\x01row"), "\x01row", "left").select(*docs.columns, "\x01redrawn")
    names, at = docs.columns, docs.columns.index(text_col)
    maker = Surrogates(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                spans = detect(text) if text else []
                drawn = {(r["kind"], r["entity"]): r["attempt"] for r in own or ()} or overrides or {}
                parts, end, by = [], 0, {}
                for a, b, kind, entity in spans:
                    made = maker.canonical(kind, entity, drawn.get((kind, entity), 0))
                    parts += [text[end:a], maker.render(kind, text[a:b], made)]
                    end = b
                    name = "name" if "." in kind else kind
                    by[name] = by.get(name, 0) + 1
                texts.append("".join([*parts, text[end:]]) if spans else text)
                counts.append(len(spans))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(by.items())))
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=[*names, *added])

    schema = StructType([*docs.schema.fields, StructField(added[0], LongType()), StructField(added[1], StringType())])
    return map_arrow(source, run, schema)
