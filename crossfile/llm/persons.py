"""Candidates for names, birth dates and postal addresses, with the votes of their labelers.

A labeler votes 1 (personal), -1 (not) or 0 (nothing to say). Of each kind some labelers are anchors: a candidate that none of these
votes for is background, from which the weak-supervision model learns what ordinary text looks like, but is never personal.
Entries of the gazetteer are lower-cased. The patterns pass over a text once, and what is looked at around a candidate is bounded.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Terms = dict[str, frozenset[str]]

#: A gazetteer is sent to every task; a larger one is refused.
MOST_BYTES = 16 << 20
#: Fixed values, used where no gazetteer is given: given names, titles, and words for streets (sure ones, and ones with other meanings).
GIVEN = """
    alice andrew anna barbara charles christopher daniel david deborah dorothy edward elizabeth emily emma eric george hannah helen henry jacob james
    jennifer jessica john jonathan joseph joshua karen kevin laura linda margaret maria martha mary matthew michael nancy nicholas olivia oliver patricia
    peter rachel rebecca richard robert ruth samuel sandra sarah sharon sophia stephanie stephen steven susan thomas timothy victoria walter william
    andreas birgit dieter franz friedrich günter hans heike heinrich helga ingrid johannes jürgen karl katrin klaus lukas monika petra sabine stefan
    ursula uwe wolfgang antoine camille chloé françois françoise guillaume hélène isabelle jacques jean julien laurent léa louis marie mathieu monique
    nathalie nicolas philippe pierre sylvie véronique yves alejandro ana antonio carlos carmen diego francisco guadalupe isabel javier jesús jorge josé
    juan lucía luis manuel miguel pablo pedro rafael ramón rosa teresa
"""
TITLES = "mr mrs ms miss dr prof sir madam herr frau monsieur madame mademoiselle mme mlle señor señora señorita sr sra don doña"
WAYS = "street st road rd avenue ave boulevard blvd rue impasse calle avenida straße strasse"
OTHER_WAYS = "lane drive way square court place chemin allée quai plaza paseo camino weg platz gasse allee"
DEFAULTS: Terms = {k: frozenset(v.split()) for k, v in (("given", GIVEN), ("title", TITLES), ("way", WAYS), ("other_way", OTHER_WAYS))}

_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
# Patterns start with a set of characters, and look behind it from there: so the search skips to these characters.
#: A full stop joins words only after an abbreviation or an initial.
RUN = re.compile(rf"[{_UPPER}](?<!\w.)[{_LOWER}]++(?:(?:(?<=\b\w\w)\. |(?<=\b\w\w\w)\. | |-)(?:[{_UPPER}][{_LOWER}]++|[{_UPPER}]\.(?= ))){{0,4}}(?!\w)")
_WORD = re.compile(rf"[{_UPPER}{_LOWER}]+")
_NAMED = re.compile(r"(?:\bnames?|\bnom|\bnombre|\bcontact|\bkontakt|\bcontacto|\bsigned|\battn|\bpatient|\bemployee)\s*[:=]\s*$", re.IGNORECASE)
_GREETINGS = frozenset("dear regards sincerely grüße grüßen cordialement atentamente cher chère liebe lieber querido querida estimado estimada".split())
_LAST = re.compile(r"(\w+),?\s+$")
_REACHED = re.compile(r"@|\+[0-9]|\b(?:tel|phone|mobile|fax|e-?mail|born|geboren|née?|nacid[oa])\b", re.IGNORECASE)
_LABEL = frozenset("dear contact signed name attn patient from".split())

DATE = re.compile(r"[0-9](?<![\w./-].)(?:[0-9]?([./-])[0-9]{1,2}\1(?:[0-9]{4}|[0-9]{2})|[0-9]{3}-[0-9]{2}-[0-9]{2})(?![\w/-]|\.[0-9])")
_BORN = re.compile(r"\b(?:born|birth(?:day|date)?|d\.?o\.?b\.?|geboren|geburts(?:tag|datum)|née?|naissance|nacid[oa]|nacimiento)\b", re.IGNORECASE)
_DATED = re.compile(r"\b(?:version|updated|published|issued|dated|due|invoice|release[d]?|rev)\b", re.IGNORECASE)

NUMBER = re.compile(r"[0-9](?<![\w.,/-].)[0-9]{0,4}[A-Za-z]?(?![\w/-]|[.,][0-9])")
_ON = re.compile(r"(?:,? [^\W\d_]+){1,6}")
_BACK = re.compile(r"(?<!\w)(?:[^\W\d_]+ ){0,5}[^\W\d_]+,? $")
_JOINS = frozenset("de du des la le les del los las el the of der den von zum zur am".split())
_POSTAL = re.compile(r"\b[0-9]{5}\b|\b[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}\b")
_LIVES = re.compile(r"\b(?:address|lives|living|resid(?:es|ing|ence)|ship(?:ped)? to|home|adresse|anschrift|wohnhaft|wohnt|domicile|habite|domicilio|dirección|vive)\b", re.IGNORECASE)

#: The votes that anchor a candidate, by kind.
ANCHORS = {"name": (0, 1, 2), "birth": (0,), "address": (0, 2)}
VOTERS = {"name": 5, "birth": 4, "address": 4}

Found = tuple[int, int, tuple[int, ...]]


def load(gazetteer: DataFrame) -> Terms:
    """The gazetteer of rows (kind, entry); kinds without rows keep their default. Null kinds and entries are left out. It is measured before it is read."""
    rows = gazetteer.select("kind", F.lower(F.trim("entry")).alias("entry")).where("kind is not null and entry <> ''").distinct()
    if unknown := [r.kind for r in rows.where(~F.col("kind").isin(list(DEFAULTS))).select("kind").distinct().limit(5).collect()]:
        raise ValueError(f"kinds of a gazetteer are {', '.join(DEFAULTS)}, not {', '.join(unknown)}")
    if (size := rows.agg(F.sum(F.octet_length("entry") + 64)).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"a gazetteer of {size} bytes is beyond the {MOST_BYTES} that every task may hold")
    found: dict[str, set[str]] = {}
    for r in rows.collect():
        found.setdefault(r.kind, set()).add(r.entry)
    return DEFAULTS | {k: frozenset(v) for k, v in found.items()}


def names(text: str, terms: Terms) -> list[Found]:
    """Runs of capitalised words, without titles and words that lead to a name.

    Votes: a title before it; a given name in it; a label before it; how many words it has; means to reach someone, or a greeting, nearby.
    """
    out = []
    for m in RUN.finditer(text):
        # Most runs are the first word of a sentence; a word alone needs a label, and labels end in one of these signs.
        if " " not in m.group() and "-" not in m.group() and text[max(0, m.start() - 32) : m.start()].rstrip()[-1:] not in (":", "="):
            continue
        words = [(w.start() + m.start(), w.end() + m.start()) for w in _WORD.finditer(m.group())]
        titled, labelled = False, False
        while words and ((word := text[slice(*words[0])].lower()) in terms["title"] or word in _LABEL):
            titled, labelled = titled or word in terms["title"], labelled or word in _LABEL
            words = words[1:]
        if not words:
            continue
        start, end = words[0][0], words[-1][1]
        given = any(text[slice(*w)].lower() in terms["given"] for w in words)
        before = text[max(0, start - 32) : start]
        named = before.rstrip()[-1:] in (":", "=") and bool(_NAMED.search(before))
        if len(words) == 1 and not (titled or named):
            continue
        last = _LAST.search(before)
        greeted = labelled or last is not None and last.group(1).lower() in _GREETINGS
        reached = bool(_REACHED.search(text, end, min(len(text), end + 40)))
        out.append((start, end, (int(titled), int(given), int(named), 1 if 2 <= len(words) <= 3 else -1, int(greeted or reached))))
    return out


def _day(text: str) -> tuple[bool, int | None]:
    """(whether it is a day of the calendar, in one order of day and month or the other; its year, if that is written in full)."""
    parts = re.split(r"[./-]", text)
    year, first, second = (parts[0], *parts[1:]) if len(parts[0]) == 4 else (parts[2], *parts[:2])

    def real(month: str, day: str) -> bool:
        try:
            date(int(year) if len(year) == 4 else 2000, int(month), int(day))
        except ValueError:
            return False
        return True

    return real(first, second) or len(parts[0]) < 4 and real(second, first), int(year) if len(year) == 4 else None


def births(text: str, terms: Terms) -> list[Found]:
    """Days in figures. Votes: birth named shortly before; a day of the calendar; a year in which somebody living may be born; no other matter named before."""
    out = []
    for m in DATE.finditer(text):
        real, year = _day(m.group())
        before = text[max(0, m.start() - 32) : m.start()]
        living = 0 if year is None else 1 if 1900 <= year <= 2030 else -1
        out.append((m.start(), m.end(), (1 if _BORN.search(before) else 0, 1 if real else -1, living, -1 if _DATED.search(before) else 0)))
    return out


def _way(word: str, terms: Terms) -> int:
    """2 for a sure word of streets, 1 for one with other meanings, or words that end in one; else 0."""
    low = word.lower()
    if low in terms["way"] or low.endswith(("straße", "strasse")):
        return 2
    return 1 if low in terms["other_way"] or word[0].isupper() and low.endswith(("weg", "platz", "gasse", "allee")) else 0


def _fits(words: list[str]) -> bool:
    return bool(words) and all(w[0].isupper() or w.lower() in _JOINS for w in words) and any(w[0].isupper() for w in words)


def addresses(text: str, terms: Terms) -> list[Found]:
    """House numbers with a street: number first (its word for streets last, or first as in French), or number last. Of
    overlapping ones the first stays.

    Votes: a sure word for streets; a postal code nearby; a place to live named before; a capitalised street.
    """
    out: list[Found] = []
    for m in NUMBER.finditer(text):
        span, kind, street = None, 0, []
        on = _ON.match(text, m.end(), min(len(text), m.end() + 64))
        words = [(w.start() + m.end(), w.end() + m.end()) for w in re.finditer(r"[^\W\d_]+", on.group())] if on else []
        for i, (a, b) in enumerate(words):
            if not (kind := _way(text[a:b], terms)):
                continue
            if i:
                span, street = (m.start(), b), [text[x:y] for x, y in words[:i]]
            else:
                j = 1
                while j < len(words) and (text[words[j][0]].isupper() or text[slice(*words[j])].lower() in _JOINS):
                    j += 1
                while j > 1 and not text[words[j - 1][0]].isupper():
                    j -= 1
                span, street = (m.start(), words[j - 1][1]), [text[x:y] for x, y in words[1:j]]
            break
        if span is None:
            low = max(0, m.start() - 64)
            back = _BACK.search(text[low : m.start()])
            words = [(w.start() + low, w.end() + low) for w in re.finditer(r"[^\W\d_]+", text[low : m.start()]) if back and w.start() >= back.start()]
            for i in range(len(words) - 1, -1, -1):
                word = text[slice(*words[i])]
                if kind := _way(word, terms):
                    ends = word.lower() not in terms["way"] | terms["other_way"]
                    # A street may be one word with its ending, or a word for streets and what follows it.
                    span, street = (words[i][0], m.end()), [word] if ends else [text[x:y] for x, y in words[i + 1 :]]
                    break
        if span is not None and (not out or span[0] >= out[-1][1]):
            a, b = span
            postal = bool(_POSTAL.search(text, b, min(len(text), b + 32)))
            lives = bool(_LIVES.search(text, max(0, a - 32), a))
            fits = _fits(street)
            out.append((a, b, (1 if kind == 2 and fits else 0, int(postal), 1 if lives and fits else 0, 1 if fits else -1)))
    return out


FAMILIES = {"name": names, "birth": births, "address": addresses}


def anchored(kind: str, votes: tuple[int, ...]) -> bool:
    return any(votes[i] == 1 for i in ANCHORS[kind])
