"""Rows recomputed one by one where no SQL can: shards and slots, scores under given models, orders of epochs, the pipeline's stages."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from crossfile.llm import mixing, pii, quality, sentencepiece_stream, sharding, toxicity
from crossfile.llm.frames import cut
from crossfile.llm.queries import VOCABULARY
from test_row_operators import brute_quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def hashed(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12]


def brute_shard(key, shards):
    at = ""
    for depth in (1, 2, 3):
        weights = {}
        for s in shards:
            name = "/".join((s.region, s.rack, str(s.id))[:depth])
            if name.startswith(at + "/" if at else ""):
                weights[name] = weights.get(name, 0.0) + s.weight
        at = min(weights, key=lambda n: (-math.log((int(hashed(key, n), 16) + 0.5) / (1 << 48)) / weights[n], n))
    return int(at.rpartition("/")[2])


def test_shards_sizes_and_slots(spark, real):
    odd = spark.createDataFrame([(None, None), (7, ""), (7, ""), (7, "é"), (-3, "x" * 70_000)], "doc_id long, text string")
    rows = real.select("doc_id", "text").union(odd)
    shards = sharding.tree(16)
    got = sharding.assign(rows, shards).collect()
    want = []
    for r in rows.collect():
        key, data = "" if r.doc_id is None else str(r.doc_id), (r.text or "").encode()
        want.append((brute_shard(key, shards), int(hashed(key), 16), r.doc_id, len(data) + 1, zlib.crc32(data), brute_shard(key, sharding.grow(shards))))
    slots, expected = Counter(), []
    for shard, _, key, size, crc, grown in sorted(want, key=lambda w: (w[0], w[1], w[2] is not None, w[2] or 0, w[3], w[4])):
        expected.append((key, size, crc, shard, slots[shard], grown))
        slots[shard] += 1
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot, r.grown_shard) for r in got), key=str) == sorted(expected, key=str)


def test_toxicity_of_a_given_model():
    weights = np.linspace(-0.5, 0.7, len(toxicity.Model.features(np.zeros(1))))
    model = toxicity.Model(b"plain words of no harm " * 9, b"plain words of no harm nasty slur vile curse " * 9, 0.2, weights, window=32)
    for text in (None, "", "a nasty SLUR", "plain words " * 40 + "vile curse", "é" * 500):
        data, a, b = (text or "").lower().encode(), *model._coders()
        gains = [len(a.compress(data[i : i + 40])) - len(b.compress(data[i : i + 40])) for i in range(0, max(len(data), 1), 32)]
        n, over = len(gains), [sum(g >= k for g in gains) for k in range(1, 8)]
        x = [1, sum(gains) / n, max(gains) / 10, math.log(n), *(k / n for k in over), *(math.log1p(k) for k in over[1:])]
        assert math.isclose(model.score(text), 1 / (1 + math.exp(-sum(p * q for p, q in zip(x, weights, strict=True)))), rel_tol=1e-9)


def test_epochs_are_dealt_in_the_order_of_hashes(spark, real):
    docs = real.select("doc_id", "source", "text")
    out = mixing.mix(docs, 0.98, 4.0, 1.5).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r.source or ""] += len(WORD.findall(r.text or "")) + 1
    total, a = sum(tokens.values()), out[0]._exponent
    powered = {s: (n / total) ** a for s, n in tokens.items()}
    bits = max(2, (docs.count().bit_length() + 1) // 2)
    for r in out:
        source, key = r.source or "", "" if r.doc_id is None else str(r.doc_id)
        block = int(hashed(key), 16) >> 48 - bits
        assert math.isclose(r._weight, powered[source] / sum(powered.values()), rel_tol=1e-9)
        assert r._order == hashed(r._epoch, source, block) + hashed(r._epoch, source, key)


def shingles(text, n=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} if w else ())


def test_pipeline_stage_by_stage(spark, real):
    docs = real
    stages = dict(corpus_pipeline.STAGES)
    # Quality: exactly those whose measures pass.
    first = cut(stages["quality_rules"](spark, docs, SF))
    kept = sorted((r.doc_id, r.text) for r in docs.collect() if brute_quality(r.text)[-1])
    assert sorted((r.doc_id, r.text) for r in first.collect()) == kept and quality.NGRAM_LIMITS
    # Near duplicates: the least of every component.
    second = cut(stages["near_duplicates"](spark, first, SF))
    sets = [(k, shingles(t)) for k, t in kept]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = sorted(sets[i][0] for i in range(len(sets)) if find(i) == i)
    assert sorted(r.doc_id for r in second.collect()) == least
    # Personal data: masked by the classifier that all documents train.
    third = cut(stages["personal_data"](spark, second, SF))
    model = pii.fit(second)
    texts = {r.doc_id: pii.masked(r.text, model) for r in second.collect()}
    assert {r.doc_id: r.text for r in third.collect()} == texts and all(r.n_chars == len(r.text) for r in third.collect())
    # Sources: every document once at least, at most four times, each source up to its quota.
    fourth = cut(stages["source_weights"](spark, third, SF))
    copies = Counter(r.doc_id for r in fourth.collect())
    assert set(copies) == set(texts) and max(copies.values()) <= 4 and fourth.columns == docs.columns
    # Ids: those of the codec, for every copy.
    codec = sentencepiece_stream.Codec(sentencepiece_stream.read_pieces(VOCABULARY))
    last = stages["encoding"](spark, fourth, SF).collect()
    assert Counter(r.doc_id for r in last) == copies and all(list(r.ids) == list(codec.encode(texts[r.doc_id])) for r in last)
