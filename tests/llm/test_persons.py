"""Names, birth dates and addresses beside the secrets: spans of given sentences, background left alone, gazetteers of one's own."""

from __future__ import annotations

import time

import pytest
from crossfile.llm import persons, pii

#: (sentence, what is personal in it)
PERSONAL = [
    ("Dear Anna Schmidt, your parcel is here.", {"name": ["Anna Schmidt"]}),
    ("Contact: Maria Lopez for the keys.", {"name": ["Maria Lopez"]}),
    ("yesterday Dr. Helen F. Ortega spoke", {"name": ["Helen F. Ortega"]}),
    ("Herr Jürgen Müller wohnt in der Lindenstraße 12, 10115 Berlin", {"name": ["Jürgen Müller"], "address": ["Lindenstraße 12"]}),
    ("she lives at 221 Baker Street, NW1 6XE", {"address": ["221 Baker Street"]}),
    ("il habite 12 rue de la Paix, 75002 Paris", {"address": ["12 rue de la Paix"]}),
    ("vive en Calle de Alcalá 45, 28014 Madrid", {"address": ["Calle de Alcalá 45"]}),
    ("he was born 12.03.1984 in the north", {"birth": ["12.03.1984"]}),
    ("date of birth: 1990-02-28", {"birth": ["1990-02-28"]}),
]
CLEAN = ["The Northern Harbour Council met. Later they left.", "In 1990 we found 3 ways to go.", "version 1.2.2003 was published", "Many People Agree with 12 of them.", "issued 03/04/2015, see 4 pages", "go 2 way home", "", None]


def _texts():
    return [t for t, _ in PERSONAL for _ in range(5)] + CLEAN * 40


def _kinds(text, model):
    out = {}
    for a, b, k in pii.all_spans(text, model)[1]:
        out.setdefault(k, []).append(text[a:b])
    return out


def test_spans_of_every_kind(spark):
    docs = spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").repartition(4)
    model = pii.fit(docs)
    for text, want in PERSONAL:
        assert _kinds(text, model) == want, text
    for text in CLEAN:
        assert _kinds(text or "", model) == {}, text
    rows = pii.find(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = _texts()[r.doc_id] or ""
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, b, k in pii.all_spans(text, model)[1])
        assert r.n_added == sum(len(v) for t, want in PERSONAL if t == text for v in want.values())
    assert pii.masked("Dear Anna Schmidt, mail a@b.de", model) == "Dear [name], mail [email]"


def test_background_alone_teaches_that_nothing_is_personal(spark):
    docs = spark.createDataFrame([(t,) for t in CLEAN * 30], "text string")
    model = pii.fit(docs)
    assert all(not pii.all_spans(t or "", model)[1] for t in CLEAN)


def test_rare_kinds_are_found_in_much_ordinary_text():
    """Five candidates among millions of runs of capitalised words; what labelers contradict is not taken."""
    rare, ordinary = (0, 1, 0, 1, 0, 0), (0, 0, 0, 1, 0, 0)
    for many in (0, 60, 60_000, 60_000_000):
        model = pii.Model({"name": pii.train([(rare, 5), *([(ordinary, many)] if many else [])], kind="name")}, persons.DEFAULTS)
        assert pii.accepted("name", rare, model)
    born, doubtful, issued = (1, 1, 1, 0, 0), (1, -1, -1, -1, 0), (0, 1, 1, -1, 0)
    model = pii.Model({"birth": pii.train([(born, 50), (doubtful, 20), (issued, 900)], kind="birth")}, persons.DEFAULTS)
    assert pii.accepted("birth", born, model) and not pii.accepted("birth", doubtful, model)


def test_days_of_the_calendar():
    assert persons._day("31/12/1999") == (True, 1999) and persons._day("12/31/99") == (True, None)
    assert persons._day("1990-02-30") == (False, 1990) and persons._day("1990-28-02") == (False, 1990) and persons._day("00.00.2000") == (False, 2000)


def test_a_gazetteer_of_ones_own(spark, monkeypatch):
    rows = spark.createDataFrame([("given", " Zorbla "), ("given", None), (None, "x"), ("way", "strada")], "kind string, entry string")
    texts = ["later Zorbla Quent came back"] * 5 + ["at 12 Vecchia Strada, 20121"] * 5 + CLEAN * 30
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    with_own, without = pii.fit(docs, gazetteer=rows), pii.fit(docs)
    assert _kinds(texts[0], with_own) == {"name": ["Zorbla Quent"]} and _kinds(texts[0], without) == {}
    assert _kinds(texts[5], with_own) == {"address": ["12 Vecchia Strada"]} and _kinds(texts[5], without) == {}
    with pytest.raises(ValueError, match="planet"):
        persons.load(spark.createDataFrame([("planet", "mars")], "kind string, entry string"))
    monkeypatch.setattr(persons, "MOST_BYTES", 64)
    with pytest.raises(ValueError, match="bytes"):
        persons.load(rows)
    assert persons.load(rows.limit(0)) == persons.DEFAULTS


@pytest.mark.parametrize("text", ["Aa " * 200_000, "A" * 600_000, "1 " * 200_000, "1.1." * 150_000, "rue " * 150_000, "Aa-" * 200_000, "12 rue de " * 60_000])
def test_long_texts_take_time_in_proportion(text):
    start = time.monotonic()
    for family in persons.FAMILIES.values():
        family(text, persons.DEFAULTS)
    assert time.monotonic() - start < 20
