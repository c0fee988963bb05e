"""Personal information in free text: detection and consistent, typed replacement.

Mentions of e-mail addresses, phone numbers, identity numbers, street addresses and person names are found by form; names
by a list of given and family names, widened by the stems and endings that the list itself repeats. Each entity then gets
a replacement derived from a secret key, the same wherever the entity occurs, whatever its spelling (case, order of a
name, separators of a number). Two styles exist: a typed placeholder with a short keyed tag, and a surrogate of the same
type and format (a name of the same ending class for a name, digits for digits, upper case for upper case). Replacements
of different entities are checked against each other and against the entities of the whole corpus; where two collide, the
later one is drawn again until all differ. A replacement is a function of key and entity wherever the first draw holds, so
only the entities drawn again form a table; it goes to all tasks up to ``REDRAWN`` rows, and texts and mentions stay where
they are, however often an entity occurs.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import cut, spread

KINDS = ("email", "phone", "id_number", "address", "name")
ROUNDS = 20
REDRAWN = 500_000  # entities drawn again that are sent to all tasks; more are joined by shuffle

_INVISIBLE = re.compile("[­͏؜​-‏‪-‮⁠-⁯﻿]")
_S = "[  ]"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = rf"(?:\.|{_S}+(?:dot|DOT){_S}+|{_S}?[\[(](?:dot|DOT)[\])]{_S}?)"
_EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+-])?"
    rf"(?:(?:{_S}?@{_S}?|{_S}?[\[({{](?:at|AT)[\])}}]{_S}?){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}"
    rf"|{_S}(?:at|AT){_S}{_LABEL}(?:{_S}(?:dot|DOT){_S}{_LABEL})*{_S}(?:dot|DOT){_S}[A-Za-z]{{2,24}}"
    rf"|{_S}(?:at|AT){_S}{_LABEL}(?:\.{_LABEL})*\.(?:com|org|net|edu|example|test|invalid|COM|ORG|NET|EDU|EXAMPLE|TEST|INVALID))(?![A-Za-z0-9])"
)
_AT = re.compile(rf"@|[\[({{](?:at|AT)[\])}}]|{_S}(?:at|AT){_S}(?={_LABEL}(?:{_S}(?:dot|DOT){_S}|\.[A-Za-z0-9]))")
_LOCAL_CHARS, _DOMAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"), re.compile(r"[A-Za-z0-9.\-  \[\](){}]*")
_PHONE = re.compile(
    r"(?<![\w.+\-/])(?:"
    rf"\+\d{{1,3}}(?:{_S}?\(\d{{1,5}}\){_S}?\d{{2,5}}(?:[  .-]\d{{2,5}}){{1,3}}|(?:[  .-]\d{{2,5}}){{2,5}}|\d{{8,12}})"
    rf"|\(\d{{3}}\){_S}?\d{{3}}[  .-]\d{{4}}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    rf"|0\d{{3,4}}{_S}\d{{6,7}}|0\d(?:{_S}\d\d){{4}}|0\d{{2,3}}{_S}\d{{3,5}}{_S}\d{{3,4}}"
    r")(?![\w]|[.\-]\d)"
)
_ID = re.compile(
    rf"(?<![\w.+\-])(?:\d{{3}}-\d\d-\d{{4}}|\d{{3}}{_S}\d\d{_S}\d{{4}}|\d{{6}}-\d{{4}}|\d{{1,2}}\.\d{{3}}\.\d{{3}}-[\dK]|[A-Z]{{2}}\d{{7}}|00\d{{9}}|00(?:{_S}\d{{3}}){{3}})(?![\w]|-\d)"
)
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Court|Ct|Close|Terrace|Drive|Dr|Way|Row|Place|Square|Crescent|Boulevard|Blvd|Walk|Hill|Gardens|Grove|Mews|Parade"
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][\w'’\-]*"
_FR = "rue|bd|av\\.|avenue|chemin|place|boulevard|quai|allée|impasse|cours|route|square|passage"
_ES = "Calle|C/|C\\.|Avenida|Avda?\\.?|Pza\\.?|Plaza|Paseo|Camino|Carrera|Ronda|Travesía"
_DE = "straße|strasse|str\\.|gasse|weg|platz|allee|ufer|damm|ring|steig"
_ADDRESS = re.compile(
    rf"(?<![\w.,\-/])(?:\d{{1,5}}(?:[-–/]\d{{1,4}})?[A-Za-z]?,?\s(?:{_CAPITAL}\s){{1,3}}(?:{_STREET}|{_STREET.upper()})\b"
    rf"|\d{{1,5}}(?:\s?(?:bis|ter|[A-D]))?,?\s(?:{_FR}|{_FR.title()}|{_FR.upper()})\s(?:(?:de\sla|de\sl['’]|des|du|de|d['’]|DE\sLA|DES|DU|DE)\s?)?{_CAPITAL}(?:\s{_CAPITAL})?"
    rf"|(?:{_ES}|{_ES.upper()})\s?(?:(?:de\slas?|de\slos|del|de)\s)?(?:{_CAPITAL}\s){{0,2}}{_CAPITAL},?\s(?:n\.?º\s?)?\d{{1,5}}[A-Za-z]?\b"
    rf"|(?:{_CAPITAL}[\s-])?[A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ\-]*(?:{_DE}|{_DE.upper()}|Straße|Strasse|Weg|Gasse|Platz|Allee)\s\d{{1,4}}[a-hA-H]?\b)"
)
_DE_LEAD = re.compile(r"(?:Am|An|Im|In|Zum|Zur|Auf|Alte|Alter|Neue|Große|Kleine|Lange|Obere|Untere)\b")
_TOKEN = re.compile(r"(?<![\w@.+'’\-])[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]+)*(?![\w@])")
_AFTER_GIVEN = re.compile(rf"(?:{_S}[A-ZÀ-ÖØ-Þ]\.)*{_S}+([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]+)*)(?![\w@])")
_AFTER_FAMILY = re.compile(rf",?{_S}([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’]+)(?:{_S}[A-ZÀ-ÖØ-Þ]\.)?(?![\w@])")
_AFTER_FAMILY_INITIAL = re.compile(rf",{_S}([A-ZÀ-ÖØ-Þ]\.)(?!\w)")
_INITIALS = re.compile(rf"(?<![\w.])((?:[A-ZÀ-ÖØ-Þ]\.{_S}?){{1,3}})$")


class Names:
    """The listed names and a model of the unlisted: a stem and an ending, each of which the list repeats."""

    GIVEN, FAMILY = 1, 2

    def __init__(self, given: set[str], family: set[str], least: int = 4) -> None:
        self.listed = {self.GIVEN: {g.lower() for g in given}, self.FAMILY: {f.lower() for f in family}}
        self.parts = {kind: self._model(listed, least) for kind, listed in self.listed.items()}
        self.known: dict[str, int] = {}

    @staticmethod
    def _model(listed: set[str], least: int) -> tuple[set[str], set[str]]:
        """Endings that twice ``least`` stems take, and stems of three letters or more that take ``least`` of those."""
        stems = defaultdict(set)
        for name in listed:
            for i in range(3, len(name)):
                stems[name[i:]].add(name[:i])
        endings = {e for e, s in stems.items() if len(s) >= 2 * least}
        taken = defaultdict(int)
        for e in endings:
            for stem in stems[e]:
                taken[stem] += 1
        return {s for s, n in taken.items() if n >= least}, endings

    def _of_kind(self, word: str, kind: int) -> bool:
        if word in self.listed[kind]:
            return True
        stems, endings = self.parts[kind]
        return any(word[:i] in stems and word[i:] in endings for i in range(3, len(word)))

    def kinds(self, word: str) -> int:
        """GIVEN, FAMILY, both or 0. A double name is a family name if either half is."""
        found = self.known.get(word)
        if found is None:
            low = word.lower()
            halves = low.split("-") if "-" in low else [low]
            found = (self.GIVEN if self._of_kind(low, self.GIVEN) else 0) | (self.FAMILY if any(self._of_kind(h, self.FAMILY) for h in halves) else 0)
            if len(self.known) < 200_000:
                self.known[word] = found
        return found


def _names(text: str, names: Names, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, entity) of full names."""
    done = 0
    for token in _TOKEN.finditer(text):
        start, end = token.span()
        if start < done:
            continue
        kinds = names.kinds(token.group())
        if not kinds or any(a <= start < b for a, b in taken):
            continue
        word = token.group().lower()
        if kinds & Names.GIVEN and (m := _AFTER_GIVEN.match(text, end)) and names.kinds(m.group(1)) & Names.FAMILY:
            done = m.end(1)
            yield start, done, f"{word} {m.group(1).lower()}"
        elif kinds & Names.FAMILY:
            if (m := _AFTER_FAMILY.match(text, end)) and names.kinds(m.group(1)) & Names.GIVEN:
                done = m.end()
                yield start, done, f"{m.group(1).lower()} {word}"
            elif m := _INITIALS.search(text, max(0, start - 12), start):
                done = end
                yield m.start(1), end, f"{m.group(1)[0].lower()}. {word}"
            elif m := _AFTER_FAMILY_INITIAL.match(text, end):
                done = m.end()
                yield start, done, f"{m.group(1).lower()} {word}"


def find(text: str | None, names: Names) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, entity) of all mentions, 0-based, in order, without overlaps."""
    if not text:
        return []
    places = None
    if not text.isascii() and _INVISIBLE.search(text):
        places = [i for i, ch in enumerate(text) if not _INVISIBLE.match(ch)] + [len(text)]
        text = "".join(text[i] for i in places[:-1])
    found: list[tuple[str, int, int, str]] = []
    for sign in _AT.finditer(text):
        least, begin = found[-1][2] if found else 0, sign.start()
        if begin > least and text[begin - 1] in "  ":
            begin -= 1
        while begin > least and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = next((m for m in _EMAIL.finditer(text, begin, _DOMAIN.match(text, sign.end()).end()) if m.start() < sign.start() < m.end()), None)
        if m:
            entity = re.sub(r"[\s\[\](){}]+", " ", m.group().lower())
            entity = re.sub(r" ?(?:@| at ) ?", "@", entity)
            found.append(("email", *m.span(), re.sub(r" ?(?:\.| dot ) ?", ".", entity)))
    taken = [(a, b) for _, a, b, _ in found]
    free = lambda a, b: not any(a < y and x < b for x, y in taken)
    for kind, pattern in (("id_number", _ID), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            if free(*m.span()):
                found.append((kind, *m.span(), re.sub(r"[^0-9A-Z]", "", m.group())))
                taken.append(m.span())
    for m in _ADDRESS.finditer(text):
        a, b = m.span()
        first = m.group().split()[0]
        if not first[0].isdigit() and re.search(rf"(?:{_DE})$", m.group().rsplit(None, 1)[0].lower()) and " " in m.group().strip() and not _DE_LEAD.match(first) and m.group().count(" ") > 1:
            a += len(first) + 1  # a capital word before a German street name is no part of it, unless one of those
        if free(a, b):
            found.append(("address", a, b, re.sub(r"\s+", " ", text[a:b].lower())))
            taken.append((a, b))
    found += [("name", a, b, e) for a, b, e in _names(text, names, taken)]
    found.sort(key=lambda f: f[1])
    return [(k, places[a], places[b - 1] + 1, e) for k, a, b, e in found] if places else found


def _listed(names: DataFrame) -> tuple[set[str], set[str]]:
    """Given and family names; the list is a dictionary of bounded size, not data that grows with the corpus."""
    rows = names.where("name is not null and name_kind is not null").select("name", "name_kind").distinct().collect()
    return {r[0] for r in rows if r[1] == "given"}, {r[0] for r in rows if r[1] == "family"}


def mentions(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ``kind``, ``start_pos``, ``end_pos``, ``mention``, ``entity``), positions 1-based and inclusive, one row per mention.

    NULL and empty texts have none. Repeated rows count once. Whole texts are read. Other columns are not.
    """
    listed = docs.sparkSession.sparkContext.broadcast(_listed(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Names(*listed.value)
        for batch in batches:
            rows = [(i, kind, a + 1, b, t[a:b], entity) for i, t in zip(batch["id"], batch["text"], strict=True) if t for kind, a, b, entity in find(t, known)]
            yield pd.DataFrame(rows, columns=["id", "kind", "start_pos", "end_pos", "mention", "entity"])

    plain = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].cast("bigint").alias("id"), docs[text].cast("string").alias("text"))
    out = spread(plain).mapInPandas(run, "id bigint, kind string, start_pos int, end_pos int, mention string, entity string").distinct()
    return out.withColumnRenamed("id", doc_id)


def _draw(key: str, *parts: object) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:16], "big")


def _format_like(sample: str, number: int) -> str:
    """Digits for digits and letters for letters; leading zeros and the sign stay."""
    out, opening = [], True
    for ch in sample:
        if ch.isdigit() and not (opening and ch == "0"):
            number, d = divmod(number, 10)
            out.append(str(d if not opening else d % 9 + 1))
            opening = False
        elif ch.isascii() and ch.isupper():
            number, d = divmod(number, 26)
            out.append(chr(65 + d))
            opening = False
        else:
            out.append(ch)
    return "".join(out)


def replacement(kind: str, entity: str, key: str, attempt: int, style: str, given: list[str], family: list[str]) -> str:
    """The canonical replacement of an entity: lower case for names, e-mail and street addresses, bare for numbers."""
    number = _draw(key, kind, entity, attempt)
    if style == "placeholder":
        return f"[{kind.upper()}_{number % 16**12:012x}]"
    if kind == "name":
        first, last = entity.split(" ", 1)
        same = [g for g in given if g.endswith("a") == first.endswith("a")] or given or ["nomen"]
        pick = f"{chr(97 + _draw(key, 'initial', first, attempt) % 26)}." if first.endswith(".") else same[_draw(key, "given", first, attempt) % len(same)]
        # with the list nearly used up, family names become double ones
        halves = [*last.split("-"), *[f"{last} {i}" for i in range(attempt // 7)]]
        return pick + " " + "-".join((family or ["nescio"])[_draw(key, "family", half, attempt) % max(1, len(family))] for half in halves)
    if kind == "email":
        return f"user{number % 10**9:09d}@mail.example.org"
    if kind == "address":
        return _format_like(re.sub(r"[^0-9]", "", entity) or "1", number) + f" {(family or ['nescio'])[number // 10**6 % max(1, len(family))]}"
    return _format_like(entity, number)


def _render(kind: str, mention: str, canonical: str, style: str) -> str:
    """The replacement in the form of the mention: its case, order, separators and street type."""
    if style == "placeholder":
        return canonical
    if kind == "name":
        first, last = canonical.split(" ", 1)
        shape = lambda model, word: word.upper() if model.isupper() and len(model) > 2 else "-".join(h[:1].upper() + h[1:] for h in word.split("-"))
        parts = mention.replace(" ", " ").split()
        if mention.count(","):
            return f"{shape(parts[0].strip(','), last)}, {shape('x', first)}"
        middle = " ".join(p for p in parts[1:-1])
        return " ".join(p for p in (shape(parts[0], first), middle, shape(parts[-1], last)) if p)
    if kind == "email":
        return canonical.upper() if mention.isupper() else canonical
    if kind == "address":
        digits, word = canonical.split(" ", 1)
        words = re.findall(r"\S+", mention)
        kept = [w for w in words if not re.search(r"\d", w)]
        swapped, first = [], True
        for w in words:
            if re.search(r"\d", w):
                swapped.append(re.sub(r"\d+", digits, w, count=1))
            elif first and w[:1].isupper() and not re.fullmatch(_ES, w.title()) and (len(kept) > 1 and w != kept[-1] or len(kept) == 1):
                ending = re.search(rf"(?:{_DE})$", w)
                swapped.append(word.title() + (ending.group() if ending else ""))
                first = False
            else:
                swapped.append(w)
        return " ".join(swapped)
    flat = iter(canonical)
    return "".join(next(flat, ch) if ch.isdigit() or ch.isascii() and ch.isupper() else ch for ch in mention)


def _lists(names: DataFrame) -> tuple[list[str], list[str]]:
    given, family = _listed(names)
    return sorted(g.lower() for g in given), sorted(f.lower() for f in family)


def redrawn(found: DataFrame, names: DataFrame, key: str, style: str) -> DataFrame:
    """(``kind``, ``entity``, ``canonical``) of the entities whose first draw does not hold; all others keep it.

    Entities are drawn in rounds; one whose replacement another one holds, or which occurs in the corpus as an entity
    itself, is drawn again in the next round.
    """
    lists = found.sparkSession.sparkContext.broadcast(_lists(names))

    def draw(attempt: int, todo: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, f = lists.value
            for b in batches:
                b["canonical"] = [replacement(k, e, key, attempt, style, g, f) for k, e in zip(b["kind"], b["entity"], strict=True)]
                yield b

        return todo.mapInPandas(run, "kind string, entity string, canonical string")

    entities = cut(found.select("kind", "entity").distinct(), "entities")
    todo, held = entities, None
    first = Window.partitionBy("kind", "canonical").orderBy("entity")
    kept: list[DataFrame] = []
    for attempt in range(ROUNDS):
        ranked = draw(attempt, todo).withColumn("_place", F.row_number().over(first))
        ranked = ranked.join(entities.select("kind", F.col("entity").alias("canonical"), F.lit(True).alias("_real")), ["kind", "canonical"], "left")
        if held is not None:
            ranked = ranked.join(held.select("kind", "canonical", F.lit(True).alias("_held")), ["kind", "canonical"], "left")
        else:
            ranked = ranked.withColumn("_held", F.lit(None).cast("boolean"))
        good = F.col("_held").isNull() & F.col("_real").isNull() & (F.col("_place") == 1)
        ranked = cut(ranked.select("kind", "entity", "canonical", good.alias("_good")), "drawn")
        fine = ranked.where("_good").select("kind", "entity", "canonical")
        held = fine if held is None else held.unionByName(fine)
        if attempt:
            kept.append(fine)
        todo = ranked.where("not _good").select("kind", "entity")
        if todo.isEmpty():
            break
    else:  # with every name used up, a number makes the rest distinct
        kept.append(draw(ROUNDS, todo).withColumn("canonical", F.concat("canonical", F.lit("-"), F.substring(F.sha2(F.col("entity"), 256), 1, 16))))
    out = kept[0] if kept else entities.limit(0).withColumn("canonical", F.lit(""))
    for k in kept[1:]:
        out = out.unionByName(k)
    return cut(out, "redrawn")


def replaced_mentions(docs: DataFrame, names: DataFrame, key: str, style: str = "surrogate", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``mentions`` plus ``replacement``, as it stands in the new text. ``key`` is the caller's secret; the empty key is refused."""
    if not key:
        raise ValueError("a secret key is needed: without one anybody could rebuild the replacements")
    found = cut(mentions(docs, names, doc_id, text), "mentions")
    again = redrawn(found, names, key, style)
    lists = found.sparkSession.sparkContext.broadcast(_lists(names))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, f = lists.value
        for b in batches:
            drawn = [c if isinstance(c, str) else replacement(k, e, key, 0, style, g, f) for k, e, c in zip(b["kind"], b["entity"], b["canonical"], strict=True)]
            b["replacement"] = [_render(k, m, c, style) for k, m, c in zip(b["kind"], b["mention"], drawn, strict=True)]
            yield b.drop(columns="canonical")

    side = F.broadcast(again) if again.count() <= REDRAWN else again
    joined = found.join(side, ["kind", "entity"], "left").select(*found.columns, "canonical")
    return joined.mapInPandas(render, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", replacement string")


def replace(docs: DataFrame, names: DataFrame, key: str, style: str = "surrogate", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): every text with its mentions replaced and all else unchanged, one row per row of ``docs``.

    NULL texts stay NULL. Texts are read twice, once for the entities of the corpus and once to be rewritten where they lie;
    they are shuffled only where more than ``REDRAWN`` entities had to be drawn again.
    """
    if not key:
        raise ValueError("a secret key is needed: without one anybody could rebuild the replacements")
    spark = docs.sparkSession
    again = redrawn(mentions(docs, names, doc_id, text), names, key, style)
    plain = docs.select(docs[doc_id].cast("bigint").alias(doc_id), docs[text].cast("string").alias(text))
    if again.count() > REDRAWN:
        return _replace_by_join(plain, replaced_mentions(docs, names, key, style, doc_id, text), doc_id, text)
    sent = spark.sparkContext.broadcast((_listed(names), _lists(names), {(r.kind, r.entity): r.canonical for r in again.collect()}))  # at most REDRAWN rows

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, (g, f), held = sent.value
        known = Names(*listed)
        for b in batches:
            out = []
            for t in b[text]:
                parts, at = [], 0
                for kind, a, z, entity in find(t, known) if t else []:
                    canonical = held.get((kind, entity)) or replacement(kind, entity, key, 0, style, g, f)
                    parts += [t[at:a], _render(kind, t[a:z], canonical, style)]
                    at = z
                out.append("".join(parts) + t[at:] if parts else t)
            yield pd.DataFrame({doc_id: b[doc_id], text: out})

    return spread(plain).mapInPandas(rewrite, f"`{doc_id}` bigint, `{text}` string")


def _replace_by_join(plain: DataFrame, done: DataFrame, doc_id: str, text: str) -> DataFrame:
    edits = done.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "mention", "replacement"))).alias("_edits"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, edits_ in zip(b[text], b["_edits"], strict=True):
                if t is not None and edits_ is not None:
                    parts, at = [], 0
                    for e in edits_:
                        a, z = e["start_pos"] - 1, e["end_pos"]
                        if t[a:z] == e["mention"] and a >= at:
                            parts += [t[at:a], e["replacement"]]
                            at = z
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pd.DataFrame({doc_id: b[doc_id], text: out})

    return plain.join(edits, doc_id, "left").mapInPandas(rewrite, f"`{doc_id}` bigint, `{text}` string")
