"""Operators that work row by row or on narrow keys: quality rules, sharding, mixing, SentencePiece."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from crossfile.llm import mixing, quality, sentencepiece_stream, sharding
from crossfile.llm.queries import VOCABULARY
from crossfile.llm.text import buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, k string, shard int"
ROWS = [
    (1, "a b c d e f g h i j", "en", "s", 1, 0, "x", 9),
    (1, "a b c d e f g h i j", "en", "s", 1, 0, "x", 9),
    (2, None, "en", None, 1, 0, "x", 9),
    (3, "", None, "t", None, 0, "x", 9),
    (None, " \n\t ", "en", "t", 1, 0, "x", 9),
    (4, "x y z w é ü 漢字 " * 40 + "\nsame line here\nsame line here\n#$ |", "en", "s", 1, 0, "x", 9),
    (5, " ".join(f"w{i}" for i in range(3000)), "en", "s", 1, 0, "x", 9),
    (6, "▁ odd ▁▁  marks \x00 \U0001f600", "en", "s", 1, 0, "x", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def brute_quality(text):
    text = text or ""
    found = list(WORD.finditer(text))
    w = [m.group() for m in found]

    def covered(k):
        at = defaultdict(list)
        for i in range(len(w) - k + 1):
            at[tuple(w[i : i + k])].append(i)
        return {i + j for v in at.values() if len(v) > 1 for i in v for j in range(k)}

    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    chars = sum(map(len, w))
    n_repeat = len(covered(8))
    failed = len(w) < 20 or 100 * n_repeat > 30 * len(w)
    shares = [sum(len(w[i]) for i in covered(k)) / max(chars, 1) for k in quality.NGRAM_LIMITS]
    counts = Counter(lines)
    line_share = sum(len(x) for x in lines if counts[x] > 1) / max(1, sum(map(len, lines)))
    kept = not failed and line_share <= quality.LINE_LIMIT and all(s <= m for s, m in zip(shares, quality.NGRAM_LIMITS.values(), strict=True))
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, n_repeat, failed, kept


def test_quality_equals_brute_force(spark, docs):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text").union(real)
    got = sorted((tuple(r)[:8] for r in quality.measure(rows).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute_quality(r.text)) for r in rows.collect()), key=str)
    assert quality.measure(docs.limit(0)).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_shards(spark, docs):
    rows = sharding.assign(docs, sharding.tree(16)).collect()
    assert len(rows) == len(ROWS)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {1}
    assert sharding.assign(docs.limit(0), sharding.tree(16)).count() == 0


def test_a_changed_weight_moves_rows_only_with_its_subtree(spark):
    shards = sharding.tree(16)
    heavier = tuple(sharding.Shard(s.id, s.region, s.rack, 2.0 if s.id == 5 else 1.0) for s in shards)
    keys = spark.range(4000).selectExpr("cast(id as string) k")
    moved = keys.select(sharding.place(keys.k, shards).alias("a"), sharding.place(keys.k, heavier).alias("b")).where("a <> b").collect()
    assert moved and all(r.b // 4 == 1 for r in moved)  # rows only enter the region of shard 5, or move within it
    assert all(r.b // 2 == 2 for r in moved if r.a // 4 == 1)


def brute_mix(rows, budget, repetition, evenness):
    """Quotas of the sources, by the definition."""
    import math

    tokens = Counter()
    for r in rows:
        tokens[r.source or ""] += len(WORD.findall(r.text or "")) + 1
    total = sum(tokens.values())
    p = {s: n / total for s, n in sorted(tokens.items())}

    def q(a):
        w = {s: x**a for s, x in p.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    even = lambda a: -sum(x * math.log(x) for x in q(a).values()) >= evenness * math.log(len(p)) - 1e-9
    spared = lambda a: budget * q(a)[min(p, key=p.get)] <= repetition * min(p.values()) + 1e-12

    def bisect(holds):
        lo, hi = 0.0, 1.0
        for _ in range(50):
            lo, hi = ((lo + hi) / 2, hi) if holds((lo + hi) / 2) else (lo, (lo + hi) / 2)
        return round((lo + hi) / 2, 9)

    a = max(1.0 if even(1.0) else bisect(even), 0.0 if spared(0.0) else bisect(lambda x: not spared(x)))
    return tokens, {s: math.floor(budget * total * x + 1e-6) for s, x in q(a).items()}, a


@pytest.mark.parametrize("evenness,budget,repetition", [(0.999, 1.0, 4.0), (0.9, 2.5, 4.0), (1.0, 3.0, 3.2)])
def test_mix_meets_quotas(spark, evenness, budget, repetition):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "if(doc_id % 3 = 0, 'hot', source) source", "text", "doc_id _n_chars").collect()
    docs = spark.createDataFrame(rows)
    tokens, quotas, a = brute_mix(rows, budget, repetition, evenness)
    out = mixing.mix(docs, evenness, repetition, budget).collect()
    assert abs(out[0]._exponent - a) < 1e-6
    dealt, copies, longest = Counter(), Counter(), Counter()
    for r in out:
        dealt[r.source] += r._n_tokens
        copies[r.source, r.doc_id] += 1
    for r in rows:
        longest[r.source] = max(longest[r.source], len(WORD.findall(r.text)) + 1)
    for s, quota in quotas.items():
        whole = quota // tokens[s]
        assert quota - longest[s] < dealt[s] <= quota
        assert {copies[s, r.doc_id] for r in rows if r.source == s} <= {whole, whole + 1}
        # the partial epoch is a prefix of its own order
        order = {}
        for r in rows:
            if r.source == s:
                order[r.doc_id] = None
        last = {r.doc_id for r in out if r.source == s and r._epoch == whole}
        assert dealt[s] - whole * tokens[s] == sum(len(WORD.findall(r.text)) + 1 for r in rows if r.doc_id in last and r.source == s)


@pytest.mark.parametrize("evenness,budget,repetition", [(0.999, 1.0, 4.0), (0.9, 2.5, 4.0), (1.0, 3.0, 3.2), (0.97, None, 4.0), (0.99, None, 1.5)])
def test_many_sources_are_mixed_as_few_are(spark, monkeypatch, evenness, budget, repetition):
    """Exponents from sums over a table of sources, and documents that meet theirs by a shuffle, give the same rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "if(doc_id % 3 = 0, 'hot', concat(source, doc_id % 5)) source", "text")
    rows = lambda: sorted((r.source, r.doc_id, r._epoch, r._order, round(r._exponent, 8), round(r._weight, 9)) for r in mixing.mix(docs, evenness, repetition, budget).collect())
    few = rows()
    monkeypatch.setattr(mixing, "ONE_ROW", 3)
    monkeypatch.setattr(mixing, "SOURCES_BROADCAST", 3)
    assert rows() == few


def test_mix_edge_rows(spark, docs):
    out = mixing.mix(docs, budget=None)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert {(r.doc_id, r.source) for r in out.collect()} == {(r[0], r[3]) for r in ROWS}  # every document is dealt
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_stream.read_pieces(VOCABULARY)


def optimum(text, pieces, unknown):
    """The best total over pieces, without the characters that are written as bytes."""
    scores = {p: s for p, s, k in pieces if k == 1}
    best = [(0.0, 0.0)]
    text = "▁" + text
    for n in range(1, len(text) + 1):
        options = [(best[m][0] + scores[text[m:n]], best[m][1] + scores[text[m:n]]) for m in range(max(0, n - 16), n) if text[m:n] in scores]
        best.append(max(options) if text[n - 1] in scores else max([*options, (best[n - 1][0] + unknown, best[n - 1][1])]))
    return best[-1][1]


def test_sentencepiece_round_trip_and_library(spark, docs, pieces):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # the library's own Viterbi over the same pieces and scores
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = sentencepiece_stream.Codec(pieces)
    score = {i: s for i, (_, s, k) in enumerate(pieces) if k == 1}
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text").union(real)
    texts = Counter((r.doc_id, r.text) for r in rows.collect())
    out = sentencepiece_stream.encode(rows, pieces).collect()
    assert len(out) == sum(texts.values())
    by_id = {r.doc_id: r for r in out}
    total = lambda ids: sum(score.get(i, 0) for i in ids)
    for doc_id, text in texts:
        r = by_id[doc_id] if doc_id != 1 else by_id[1]
        if Counter(k for k, _ in texts)[doc_id] == 1:
            assert r.exact and codec.decode(r.ids) == (text or "") and len(r.ids) == r.n_ids
            assert codec.encode(text or "") == r.ids
            if text and "▁" not in text and "\x00" not in text:
                best = optimum(text.replace(" ", "▁"), pieces, codec.unknown)
                assert total(r.ids) == best >= total(library.encode(text))  # the library adds in single precision
    assert sentencepiece_stream.encode(docs.limit(0), pieces).count() == 0


def test_paths_are_committed_within_a_bounded_window(pieces):
    codec = sentencepiece_stream.Codec(pieces)
    parts = list(codec.stream("x" * 5000 + " " + "ab" * 3000))
    assert len(parts) > 50 and max(map(len, parts)) < 200


@pytest.mark.parametrize("score", [lambda rng: -float(rng.integers(1, 4)), lambda rng: -0.1 * float(rng.integers(1, 5)), lambda rng: -5 * float(rng.random())])
def test_many_cuts_are_encoded_side_by_side(score, monkeypatch):
    """The ids are those of the stream, with ties, fractions, and characters as bytes; only long cuts take Python steps of their own."""
    rng = np.random.default_rng(5)
    draw = lambda alphabet, most: "".join(rng.choice(list(alphabet), int(rng.integers(1, most))))
    words = {"▁" * int(rng.integers(0, 3)) + draw("abcé漢", 6) for _ in range(200)} | {"▁"}
    codec = sentencepiece_stream.Codec([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(w, score(rng), 1) for w in sorted(words)])
    texts = [None, "", " ", "  a", "▁", "\x00 \U0010ffff", "ab" * 2000 + " a", *(draw("abcé漢😀▁\n   ", 60) for _ in range(400))]
    expected = [[i for cut in re.findall(" +[^ ]*", " " + t) for part in codec.stream(cut) for i in part] if t else [] for t in texts]
    streamed, stream = [], codec.stream
    monkeypatch.setattr(codec, "stream", lambda chars: streamed.append(chars) or stream(chars), raising=False)
    monkeypatch.setattr(sentencepiece_stream, "BESIDE", 500, raising=False)
    data, offsets = buffers(pa.array(texts, pa.string()))
    ids, by_row = codec.encode_slice(data, offsets, 0, len(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(by_row)[:-1])] == expected
    assert streamed == [" " + "ab" * 2000]
