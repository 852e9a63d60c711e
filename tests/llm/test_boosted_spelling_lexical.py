"""Boosted trees over statistics, spelling variants and ranked search, against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from crossfile.llm import boosted, lexical, spelling
from crossfile.llm.frames import ship

RUN, TERM = re.compile("[A-Za-zÀ-ÿ]+"), re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows):
    n = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            i = h % len(run)
            n[run[:i] + run[i + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: set() for w in n}
    letters = {c for w in n for c in w}
    for w in n:
        for i in range(len(w) + 1):
            for v in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i + k :] for c in letters for k in (0, 1))} - {w}:
                if v in n:
                    near[w].add(v)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    root = dict.fromkeys(n)
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted((w, form[w] or "", root[w], n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def spelt(spark, rows, schema="doc_id long, text string, word string, n int"):
    ship(spark)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df).collect())


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    stems = ["kitchen", "kitchens", "kitchan", "gardenés", "Éléphantes", "ananasses", "aaaaaaaa", "aaaaaaa", "wonderful"]
    rows = [(i, " ".join(str(rng.choice(stems)) for _ in range(60))) for i in range(120)]
    rows += [(None, "Kitchen kitchenĀgarden"), (None, None), (5, ""), (5, "x" * 90), (5, "x" * 90), (6, "straightforward7straightforward " * 3), (7, "×÷×÷×÷× ×÷×÷×÷×")]
    got = spelt(spark, rows)
    assert got == brute_variants(rows)
    assert any(g[1] for g in got) and any(g[4] > 3 for g in got)


def test_variants_of_real_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert spelt(spark, rows) == brute_variants(rows)


def test_forms_lead_on_to_roots(spark):
    """a is a variant of b, b of c and so on, each ten times as frequent."""
    chain = ["plankton", "plankten", "plenkten", "plenktenz"]
    rows = [(i, w) for k, w in enumerate(chain) for i in range(3 * 12**k)]
    got = spelt(spark, rows)
    assert got == brute_variants(rows) and ("plankton", "plankten", "plenktenz") in [g[:3] for g in got]


def test_words_longer_than_what_is_sent(spark):
    """Beyond 64 letters words are compared by their names first, by strings then; 64 and 65 letters meet as well."""
    a = "".join(chr(97 + i * 7 % 26) for i in range(64))
    many = ["q" * 3 + a, "q" * 4 + a, "q" * 5 + a, "q" * 3 + a[:30] + "z" + a[31:], a, "w" + a, "u" * 5000, "u" * 5001]
    rows = [(i, w) for k, w in enumerate(many) for i in range(20 if k % 3 else 400)]
    got = spelt(spark, rows)
    assert got == brute_variants(rows) and max(len(g[0]) for g in got if g[4]) >= 5000


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "short words only 123")]])
def test_no_words_no_variants(spark, rows):
    assert spelt(spark, rows) == []


def test_crc_of_segments():
    data = np.frombuffer(b"abc" + b"z" * 700 + b"hello", np.uint8)
    start, end = np.array([0, 3, 703]), np.array([3, 703, 708])
    before = np.array([zlib.crc32(b"7:"), zlib.crc32(b":"), 0], np.uint32)
    assert spelling.crcs(data, start, end, before).tolist() == [zlib.crc32(b"7:abc"), zlib.crc32(b":" + b"z" * 700), zlib.crc32(b"hello")]


def brute_search(docs, items, k=10):
    d = [(key, Counter(t)) for key, text in docs if (t := [x.translate(LOWER) for x in TERM.findall(text or "")])]
    total, df = sum(sum(c.values()) for _, c in d), Counter(t for _, c in d for t in c)
    asked = {}
    for key, text in items:
        asked.setdefault(key, Counter()).update(x.translate(LOWER) for x in TERM.findall(text or ""))
    out = []
    for item, terms in asked.items():
        scored = []
        for key, c in d:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * len(d)) // total
            s = sum(q * math.floor(1000 * math.log((2 * len(d) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if c[t])
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def sought(spark, docs, items, k=10):
    ship(spark)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item string, score int").repartition(3)
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=str)


DOCS = [(1, "the cat the cat sat"), (1, "the cat the cat sat"), (None, "The CAT"), (2, None), (3, " .,! "), (4, "dog dog_dog don't 中文 café CAFÉ"), (5, "the " * 500 + "zebra"), *((i, "the common words again " + "w%d" % (i % 7)) for i in range(10, 60))]
ITEMS = [(1, "cat"), (2, "the the zebra"), (3, "dog café 中文"), (4, None), (5, "nowhere"), (None, "w3 w3 the"), (1, "sat zebra"), (7, "common words again the w1 w2")]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_equals_brute_force(spark, k):
    assert sought(spark, DOCS, ITEMS, k) == brute_search(DOCS, ITEMS, k)


def test_search_in_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(lexical, "VOCABULARY", 4)
    assert sought(spark, DOCS, ITEMS) == brute_search(DOCS, ITEMS)


def test_search_of_real_texts(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sought(spark, docs, items) == brute_search(docs, items)


@pytest.mark.parametrize("docs,items", [([], ITEMS), (DOCS, []), (DOCS, [(1, None), (2, "..")]), ([(1, None)], ITEMS)])
def test_search_without_rows(spark, docs, items):
    assert sought(spark, docs, items) == []


def test_pruning_leaves_out_only_what_cannot_win():
    """Pairs given full scores are few, and the best are among them."""
    rng = np.random.default_rng(1)
    rows, places = 3000, 40
    tf = rng.poisson(rng.random(places) ** 4 * 3 + 0.02, (rows, places))
    row, place = np.nonzero(tf)
    value = lexical.gain(tf[row, place], tf.sum(axis=1)[row], rows, int(tf.sum()))
    df = (tf > 0).sum(axis=0)
    weight = np.floor(1000 * np.log((2 * rows + 2) / (2 * df + 1))).astype(np.int64)
    by = [np.sort(value[place == p])[::-1] for p in range(places)]
    top, kth = np.array([v[0] for v in by]), np.array([v[9] if len(v) > 9 else 0 for v in by])
    plan = lexical.Plan(np.zeros(places, np.int64), np.arange(places), weight, top, kth, 1, places)
    item, r, s = plan.scored(row, place, value, rows, plan.bound)
    full = np.bincount(row, weight[place] * value, rows)
    assert len(plan.resting[1]) > 0 and (full[r] == s).all()
    assert set(np.argsort(-full, kind="stable")[:10]) <= set(r.tolist()) and len(r) <= rows


def test_trees_in_arrays_are_walked_like_trees():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = boosted.train(x, y, np.ones(500), trees=30)

    def walk(row):
        total = model.base
        for t in range(30):
            at = 0
            while at < model.feature.shape[1]:
                at = 2 * at + 1 + (row[model.feature[t, at]] > model.limit[t, at])
            total += model.leaf[t, at - model.feature.shape[1]]
        return total

    assert np.allclose(model.raw(x), [walk(r) for r in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert (boosted.train(x, np.ones(500), np.ones(500)).score(x) > 0.99).all() and boosted.train(x[:0], y[:0], np.ones(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_splits_are_the_best_there_are():
    """A level's split has the greatest gain of all features and bins."""
    rng = np.random.default_rng(5)
    binned, grad = rng.integers(0, boosted.BINS, (300, 3)), rng.normal(size=300)
    feature, cut = boosted._level(binned, np.zeros(300, np.int64), grad, np.ones(300), np.ones(300), 1)

    def gain(j, b):
        left = binned[:, j] <= b
        if not boosted.LEAST_ROWS <= left.sum() <= 300 - boosted.LEAST_ROWS:
            return 0
        return sum(grad[m].sum() ** 2 / (m.sum() + boosted.RIDGE) for m in (left, ~left)) - grad.sum() ** 2 / (300 + boosted.RIDGE)

    assert np.isclose(gain(feature[0], cut[0]), max(gain(j, b) for j in range(3) for b in range(boosted.BINS)))


def test_statistics_of_a_text():
    x = dict(zip(boosted.FEATURES, boosted.statistics(pa.array(["Ab 12 ab.\nAb 12 ab.\né #!", None, ""]))[0], strict=True))
    assert x["upper"] == 2 / 25 and x["digit"] == 4 / 25 and x["beyond"] == 2 / 25 and x["longest_word"] == 3
    assert x["distinct_words"] == 5 / 8 and x["repeated_2"] == 4 / 7 and x["repeated_lines"] == 1 / 3 and x["lines_ending_in_stop"] == 2 / 3
    assert np.isclose(x["log_words"], math.log(9)) and x["words_ending_in_symbol"] == 1 / 8 and x["words_starting_upper"] == 2 / 8
    assert not boosted.statistics(pa.array([None, ""])).any()


def test_quality_of_documents_held_out(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = boosted.fit(docs, labels)
    rows = boosted.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.97 and all(r.predicted == (r.score >= 0.7) for r in rows)
    # Labels of the fold held out, and other columns, change nothing.
    other = labels.withColumn("quality", 1 - labels.quality).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    kept = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    again = boosted.fit(docs, kept.unionByName(other))
    assert (again.leaf == model.leaf).all() and (again.limit == model.limit).all()


def test_quality_of_odd_tables(spark):
    ship(spark)
    schema = "doc_id long, text string, held_out string, score string"
    docs = spark.createDataFrame([(None, None, "a", "b"), (1, "", "a", "b"), (1, "x y", "a", "b"), (1, "x y", "a", "b"), (2, "word " * 400_000, "a", "b")], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = boosted.classify(docs, boosted.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[2].score == got[3].score
    assert boosted.classify(docs.limit(0), boosted.fit(docs.limit(0), labels.limit(0))).count() == 0
