"""Surrogates for personal data and secrets.

Entities are found by pattern, normalised to an identity (kind and value), and replaced by keyed draws of the same kind:
digits for digits, letters for letters of the same case, hex for hex, separators untouched, card numbers valid where they were,
names of the same gender and script. One identity has one surrogate in the whole corpus, in whatever format a mention has it
(coreference), and a name's kind is settled over the corpus: where any document shows it as a man's or a woman's given name, it is one everywhere; two identities never share one, and none gets a value that the corpus itself holds (collision checks: losers
of a collision are drawn again). First draws need no table; only redrawn identities and names of which a document alone would tell another
kind are handed to the tasks.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from unicodedata import category

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, row_key, unused, written

#: Redrawn identities are broadcast up to this number; beyond it they are joined to the rows that mention them.
BROADCAST_REDRAWN = 200_000
#: Draws that keep an identity's length.
GROWING = 12

_PATTERNS = re.compile(
    r"""(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})
    |(?i:\b(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key)\b["']?\s*[:=]\s*["']?)(?P<secret>[A-Za-z0-9_/+.=-]{8,})
    |(?P<hex>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))
    |(?P<access>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})\b)
    |(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))
    |(?P<iban>\b[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?\b)
    |(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]))
    |(?P<card>(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d.]\d|\d))""",
    re.X,
)
#: Titles before names, by gender.
TITLES = {"m": ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Don", "господин", "κύριος"], "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Doña", "госпожа", "κυρία"]}
#: Titles that tell no gender.
UNGENDERED = ["Dr", "Prof", "Professor", "Doctor", "Доктор", "доктор"]
_GENDER = {t: g for g, ts in TITLES.items() for t in ts} | dict.fromkeys(UNGENDERED, "")
#: Cased letters of all scripts.
_UPPER, _LOWER = ("".join(c for c in map(chr, range(0x20000)) if category(c) in kinds) for kinds in (("Lu", "Lt"), ("Ll", "Mn")))
#: A part of a name: a capital, then small letters; hyphens, apostrophes and further capitals inside, but no possessive 's.
_PART = rf"[{_UPPER}](?:[{_LOWER}]|['’-](?!s(?!\w))(?=[{_UPPER}{_LOWER}])|(?<=[{_LOWER}'’-])[{_UPPER}](?=[{_LOWER}'’]))+"
_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
_NAME = re.compile(rf"(?<!\w)({_TITLE})\.?[ ](?:[{_UPPER}]\.[ ]?){{0,3}}((?!(?:{_TITLE})\b)(?:{_PART})(?:[ ](?!(?:{_TITLE})\b)(?:{_PART})){{0,2}})")
#: One of these is in every match of the patterns: a digit or '@', a keyword (looked for in folded text first), a long run.
_SIGNS, _KEYWORDS, _RUN = re.compile(r"[\d@]"), ("token", "secret", "passw", "pwd", "key"), re.compile("[0-9A-Za-z]{16,}")
_KEYWORD = re.compile("|".join(_KEYWORDS), re.I)
#: The rest of a word and the nine that follow: no match goes farther beyond its last sign.
_AHEAD, _WORD_END = re.compile(r"\S*(?:\s+\S+){0,9}"), re.compile(r"\S*")
#: Syllables of made-up names by script: beginnings, middles and endings for each gender.
_SYLLABLES = {
    "latin": (["Al", "Bren", "Cor", "Da", "El", "Fer", "Gar", "Hel", "Is", "Jor", "Kal", "Lor", "Mar", "Nor", "Or", "Per", "Ro", "Sel", "Tor", "Val"], ["a", "be", "da", "fi", "ga", "li", "mo", "na", "ri", "sta", "ti", "vo"], {"m": ["n", "rd", "s", "ck"], "f": ["na", "lia", "ssa", "ra"], "": ["ner", "ton", "man", "sen"]}),
    "cyrillic": (["Ал", "Бор", "Вла", "Гле", "Дар", "Ел", "Зар", "Ив", "Кир", "Лю", "Мар", "Ник", "Ол", "Рад", "Сер", "Тат"], ["а", "ве", "ди", "ла", "ми", "ро", "са", "ти"], {"m": ["н", "слав", "р"], "f": ["на", "ра", "ла"], "": ["ров", "нко", "кин"]}),
    "greek": (["Αλ", "Βασ", "Γε", "Δη", "Ελ", "Ζη", "Θε", "Κων", "Λε", "Μαρ", "Νικ", "Παν"], ["α", "δι", "λε", "μη", "νο", "ρι", "τα"], {"m": ["ος", "ης", "ας"], "f": ["ια", "ηνη", "ω"], "": ["ίδης", "όπουλος", "άκης"]}),
}


def _script(text: str) -> str:
    first = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


def _windows(text: str) -> list[tuple[int, int]]:
    """Where the patterns may match: words with a sign and those that follow. Both ends are at white space, so a pattern sees what it would see in the whole text."""
    signs = [m.start() for m in _SIGNS.finditer(text)]
    if any(k in folded for folded in [text.casefold()] for k in _KEYWORDS):
        signs += [m.start() for m in _KEYWORD.finditer(text)]
    signs += [m.start() for m in _RUN.finditer(text)]
    out, word_end = [], -1
    for at in sorted(signs):
        if at < word_end:
            continue
        word_end, stop = _WORD_END.match(text, at).end(), _AHEAD.match(text, at).end()
        if out and at < out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
            continue
        while at and not text[at - 1].isspace():
            at -= 1
        out.append((at, stop))
    return out


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, mention) of the entities of a text, in order, none overlapping. Names are given part by part.

    A name that a title introduces is found wherever else the text has it, with or without a title.
    """
    found = []
    for start, stop in _windows(text):
        for m in _PATTERNS.finditer(text, start, stop):
            kind = m.lastgroup
            if kind == "iban" and not _iban_valid(m[kind]) or kind == "card" and not _card_valid(m[kind]):
                continue
            found.append((m.start(kind), m.end(kind), kind, m[kind]))
    if any(t in text for t in _GENDER):
        taken, kinds = [(s, e) for s, e, _, _ in found], {}
        free = lambda m: not any(s < m.end() and m.start() < e for s, e in taken)
        named = [m for m in _NAME.finditer(text) if free(m)]
        parts = []
        for m in named:
            at, own = m.start(2), m[2].split(" ")
            for i, part in enumerate(own):
                gender = _GENDER[m[1]] if len(own) > 1 and i < len(own) - 1 else ""
                kinds[part] = max(kinds.get(part, ""), f"name{gender}")
                parts.append((at, part))
                at += len(part) + 1
        # a part is of one kind in the whole text, so that it has one surrogate there: a given name, where any mention shows it as one
        found += [(at, at + len(part), kinds[part], part) for at, part in parts]
        if kinds:
            taken += [(m.start(), m.end()) for m in named]
            known = "|".join(map(re.escape, sorted(kinds, key=len, reverse=True)))
            for m in re.finditer(rf"(?<!\w)(?:{known})(?!\w)", text):
                if free(m):
                    found.append((m.start(), m.end(), kinds[m[0]], m[0]))
    return sorted(found)


def _iban_valid(said: str) -> bool:
    s = said.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


# How the numbers of card issuers begin, and how long they are.
_ISSUERS = re.compile(r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3[068]\d{12}|35\d{14}|6(?:011|4[4-9]\d|5\d\d|2\d\d)\d{12,15}")


def _card_valid(said: str) -> bool:
    """Other long numbers are no card numbers: order numbers, sums, stamps of time."""
    digits = re.sub(r"\D", "", said)
    return bool(_ISSUERS.fullmatch(digits)) and _luhn(digits)


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def identity(kind: str, mention: str) -> str:
    """What mentions of one entity have in common."""
    if kind == "email":
        return mention.lower()
    if kind == "phone":
        return re.sub(r"[^\d+]", "", mention)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", mention)
    return mention.replace(" ", "") if kind == "iban" else mention


class Draw:
    """A keyed stream of numbers for an identity and an attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.key, self.seed, self.pool, self.n = key, f"{kind}\n{value}\n{attempt}".encode(), 0, 0
        self.round = 0

    def below(self, n: int) -> int:
        if self.n < 64:
            block = hmac.new(self.key, self.seed + self.round.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.n, self.round = int.from_bytes(block, "big"), 256, self.round + 1
        self.n -= 16
        self.pool, low = divmod(self.pool, 65536)
        return low % n


def _alike(text: str, draw: Draw, hexes: str = "") -> str:
    out = []
    for c in text:
        if hexes and c in hexes:
            out.append(hexes[draw.below(16)])
        elif c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            out.append(chr((65 if c.isupper() else 97) + draw.below(26)) if c.isascii() else c)
        else:
            out.append(c)
    return "".join(out)


def _country(digits: str) -> int:
    """How many digits the country's code has."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in _TWO else 3


# Country codes of two digits.
_TWO = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement of an identity, itself an identity of the same kind and format.

    Draws that collide again and again show that a format is nearly used up. From attempt GROWING on they are longer by a letter or
    digit each time, so that there always is a free one.
    """
    draw = Draw(key, kind, value, attempt)
    if (more := attempt - GROWING) > 0 and not kind.startswith("name") and kind != "ip":
        local, at, domain = value.rpartition("@")
        value = f"{local}{'a' * more}{at}{domain}" if at else value + value[-1] * more
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_alike(local, draw)}@{_alike(host, draw)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "phone":
        keep = 1 + _country(value[1:]) if value.startswith("+") else 1
        return value[:keep] + _alike(value[keep:], draw)
    if kind == "card":
        keep = {"4": 1, "3": 2, "5": 2}.get(value[0], 4)  # the issuer
        number = value[:keep] + _alike(value[keep:], draw)
        if _luhn(value):
            number = next(x for d in "0123456789" if _luhn(x := number[:-1] + d))
        return number
    if kind == "iban":
        body = _alike(value[4:], draw)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind.startswith("name"):
        first, middle, last = _SYLLABLES[_script(value)]
        ends = last[kind[4:]]
        return first[draw.below(len(first))] + "".join(middle[draw.below(len(middle))] for _ in range(1 + draw.below(2) + attempt)) + ends[draw.below(len(ends))]
    lettered = any(c.isalpha() for c in value)  # digits alone stay digits
    lower = lettered and all(c in "0123456789abcdef" for c in value)
    upper = lettered and all(c in "0123456789ABCDEF" for c in value)
    return _alike(value, draw, "0123456789abcdef" if lower else "0123456789ABCDEF" if upper else "")


def dress(kind: str, mention: str, made: str) -> str:
    """The surrogate in the format of a mention."""
    if kind in ("phone", "card", "ssn", "iban"):
        it = (c for c in made if c.isalnum())
        return "".join([next(it) if c.isalnum() else c for c in mention] + list(it))
    if kind == "email":
        grown = len(made) - len(mention)
        local = mention.index("@")
        like = mention[:local] + mention[local - 1] * grown + mention[local:]
        return "".join(m.upper() if c.isupper() else m for c, m in zip(like, made, strict=True))
    return made


def replace(text: str, key: bytes, redrawn: dict) -> tuple[str, int]:
    """``redrawn``: (kind, value) as a text shows it to the kind and the attempt of its surrogate, where these aren't its own kind and 0."""
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, mention in found:
        value = identity(kind, mention)
        settled, attempt = redrawn.get((kind, value), (kind, 0))
        out += [text[at:start], dress(kind, mention, surrogate(key, settled, value, attempt))]
        at = end
    return "".join([*out, text[at:]]), len(found)


class _Mentions:
    def __call__(self, batch) -> dict:
        out = {"a": [], "b": [], "kind": [], "value": []}
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for kind, value in dict.fromkeys((k, identity(k, m)) for _, _, k, m in find(text or "")):
                for c, x in zip(out, (key["a"], key["b"], kind, value), strict=True):
                    out[c].append(x)
        return out


def mentions(rows: DataFrame) -> DataFrame:
    """a, b (the row's key), kind, value: the identities that each row mentions."""
    return map_arrow(rows.select("key", "text"), _Mentions(), "a long, b long, kind string, value string")


def _draw_all(identities: DataFrame, key: bytes) -> DataFrame:
    def draws(batch) -> dict:
        kinds, values, attempts = (batch.column(c).to_pylist() for c in ("kind", "value", "attempt"))
        return {"kind": kinds, "value": values, "attempt": attempts, "made": [surrogate(key, k, v, n) for k, v, n in zip(kinds, values, attempts, strict=True)]}

    return map_arrow(identities.select("kind", "value", "attempt"), draws, "kind string, value string, attempt int, made string")


def redraws(identities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt of the identities whose first surrogate is another's too, or a value of the corpus.

    Of those that meet, the one settled earlier (then the smaller value) keeps its surrogate. Rounds go on until none meet.
    """
    settled = None
    pending = identities.select("kind", "value", F.lit(0).alias("attempt"))
    while True:
        drawn = written(_draw_all(pending, key))
        every = drawn if settled is None else settled.unionByName(drawn)
        owner = every.groupBy("kind", "made").agg(F.min(F.struct("attempt", "value")).alias("o")).select("kind", "made", F.col("o.value").alias("owner"))
        real = identities.select("kind", F.col("value").alias("made"), F.lit(True).alias("real"))
        judged = drawn.join(owner, ["kind", "made"]).join(real, ["kind", "made"], "left").withColumn("lost", (F.col("owner") != F.col("value")) | F.coalesce("real", F.lit(False)))
        judged = written(judged.select("kind", "value", "attempt", "made", "lost"))
        won = judged.where(~F.col("lost")).drop("lost")
        settled = won if settled is None else settled.unionByName(won)
        pending = judged.where("lost").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled.where("attempt > 0").select("kind", "value", "attempt")


def settled_kinds(shown: DataFrame) -> DataFrame:
    """kind, value (as texts show them) and ``settled``: of a name the kind that tells most in the whole corpus, else its own."""
    names = shown.where(F.col("kind").startswith("name")).groupBy("value").agg(F.max("kind").alias("settled"))
    named = shown.where(F.col("kind").startswith("name")).join(names, "value").select("kind", "value", "settled")
    return named.unionByName(shown.where(~F.col("kind").startswith("name")).select("kind", "value", F.col("kind").alias("settled")))


def pseudonymise(docs: DataFrame, key: bytes, broadcast_redrawn: int = BROADCAST_REDRAWN) -> DataFrame:
    """All columns of ``docs`` with entities in ``text`` replaced, and n_entities, the number of replaced mentions.

    Null texts stay null and empty ones empty. Repeated rows get equal results. No rows in, none out. A column named
    n_entities is replaced. The key is a secret of the run's owner: the same key gives the same first draws.
    """
    docs = docs.drop("n_entities")
    redrawn_at, key_at = unused("again", docs.columns), unused("row", docs.columns)
    told = written(mentions(docs.select("text", row_key(F.col("doc_id"), F.col("text")).alias("key"))))
    shown = written(settled_kinds(told.select("kind", "value").distinct()))
    drawn = redraws(written(shown.select(F.col("settled").alias("kind"), "value").distinct()), key).withColumnRenamed("kind", "settled")
    again = written(shown.join(drawn, ["settled", "value"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))).where("attempt > 0 OR kind <> settled").select("kind", "value", "settled", "attempt"))
    if (n := again.count()) <= broadcast_redrawn:
        held = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): (r["settled"], r["attempt"]) for r in again.collect()} if n else {})
        beside = docs.withColumn(redrawn_at, F.lit(None).cast(_AGAIN))
    else:
        held = None
        per = told.join(again, ["kind", "value"]).groupBy(F.struct("a", "b").alias(key_at)).agg(F.collect_list(F.struct("kind", "value", "settled", "attempt")).alias(redrawn_at))
        beside = docs.withColumn(key_at, row_key(F.col("doc_id"), F.col("text"))).join(per, key_at, "left").select(*docs.columns, redrawn_at)

    def convert(batch) -> dict:
        out = {"text": [], "n_entities": []}
        for text, own in zip(batch.column("text").to_pylist(), batch.column(redrawn_at).to_pylist(), strict=True):
            redrawn = held.value if held is not None else {(x["kind"], x["value"]): (x["settled"], x["attempt"]) for x in own or []}
            made, n = replace(text, key, redrawn) if text else (text, 0)
            out["text"].append(made)
            out["n_entities"].append(n)
        return out | {c: batch.column(c) for c in batch.schema.names if c not in ("text", redrawn_at)}

    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType())])
    return map_arrow(beside, convert, schema)


_AGAIN = "array<struct<kind:string,value:string,settled:string,attempt:int>>"
