"""Operators do the whole job where inputs are uneven, sparse or without ids."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from crossfile.llm import hnsw, mixing, ngram_join, quality, substring


@pytest.mark.parametrize("units", [[200, *[20] * 18, 1], [200, *[20] * 10, *[2] * 9]])
def test_no_source_is_repeated_more_than_four_times(spark, units):
    rows = [(s * 1000 + i, f"s{s}", " ".join(f"w{i}x{j}" for j in range(9))) for s, n in enumerate(units) for i in range(n)]
    out = corpus_pipeline.source_weights(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"), "").collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) == {r[0] for r in rows} and max(copies.values()) == 4


@pytest.mark.parametrize("group", [0, 300])
def test_a_lone_pair_is_found_though_no_edge_leads_to_it(group):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 24))
    x[:group] = x[0] + rng.normal(size=(group, 24)) * 0.02
    x[900] = x[777] + rng.normal(size=24) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    g.levels = [{i: [j for j in near if j not in (777, 900)] for i, near in level.items()} for level in g.levels]
    g._mend()
    true = [set(np.flatnonzero(x @ q >= 0.93).tolist()) for q in x]
    assert [set(f) for f in hnsw.search(g, x, 0.93, same=True)[0]] == true


def test_sparse_pairs_beyond_the_audit_are_found():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 24))
    x[500:] = x[:500] + rng.normal(size=(500, 24)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, width, _ = hnsw.search(hnsw.Graph(x), x, 0.93, same=True)
    assert width < len(x) and np.mean([(i + 500) % 1000 in f for i, f in enumerate(found)]) >= 0.99


def test_shards_grow_and_their_audit_is_told(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 12))
    x[1500:2000] = x[:500] + rng.normal(size=(500, 12)) * 0.02
    out = hnsw.near_duplicates(spark.createDataFrame([(i, [float(v) for v in q], i % 2) for i, q in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.shards for r in out} == {hnsw.SHARDS} and all(r.recall >= hnsw.RECALL and r.beam >= hnsw.BEAM for r in out)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(3000)[:, None] % 2 == np.arange(3000) % 2)
    true = near.sum(axis=1) - 1
    assert sum(r.n_links for r in out) >= 0.99 * true.sum()


def bridge():
    """Texts a and b, similar to 0.9 only through n."""
    n = [f"w{i}" for i in range(100)]
    return " ".join([*n[:-3], "x", "y", "z"]), " ".join(n), " ".join(["q", "r", "s", *n[3:]])


def test_a_document_without_an_id_links_its_neighbours(spark):
    a, n, b = bridge()
    rows = [(1, a), (None, n), (2, b), (3, "other words of no one else"), (None, "alone " * 9)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.n_links) for r in got), key=str) == sorted([(1, 1, 1), (None, 1, 2), (2, 1, 1), (3, 3, 0), (None, None, 0)], key=str)


def test_one_of_each_component_stays_row_by_row(spark):
    a, n, b = bridge()
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "x"), (2, a, "y"), (2, other, "z"), (None, a, "x"), (None, a, "x"), (7, None, "x"), (7, None, "x"), (8, "", "x"), (9, "few words", "p"), (9, "few words", "p"), (9, "few words", "q")]
    docs = spark.createDataFrame([(*r, {"k": 1}, 5) for r in rows], "doc_id long, text string, source string, row0 map<string,int>, r int").repartition(3)
    got = Counter((r.doc_id, r.text, r.source) for r in ngram_join.keep_one(docs).collect())
    kept = Counter({(1, a, "x"): 1, (2, other, "z"): 1, (7, None, "x"): 2, (8, "", "x"): 1})  # id 2 shares its fate with none
    few = [k for k in got if k[0] == 9]
    assert len(few) == 1 and got[few[0]] == 1 and got - Counter(few) == kept
    assert ngram_join.keep_one(docs).columns == docs.columns and ngram_join.keep_one(docs.limit(0)).count() == 0


def test_rows_without_copies_are_not_sent_to_be_kept(spark, tmp_path, monkeypatch):
    """Where those that go are too many to broadcast, too; and a filter that lets all rows pass changes none of the rows."""
    def text(i):
        return " ".join(f"{i}w{j}" for j in range(2000))

    rows = [(i, text(i)) for i in range(300)] + [(300 + i, text(i)) for i in range(3)] + [(7, text(7))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ngram_join.keep_one(spark.read.parquet(str(tmp_path / "docs")))
        sc = spark.sparkContext
        sc.setJobGroup("last", "what is left to do once it is known which rows go")
        out.write.parquet(str(tmp_path / "kept"))
        sc.setJobGroup("others", "")
        store, jobs = sc._jsc.sc().statusStore(), [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("last")]
        sent = sum(store.lastStageAttempt(s).shuffleWriteRecords() for j in jobs for s in j.stageIds if store.lastStageAttempt(s).status().name() == "COMPLETE")
        assert 0 < sent < 100  # rows: of five in doubt and the few that are to go
        monkeypatch.setattr(ngram_join, "_passes", lambda words, lanes: np.ones(len(lanes), bool))
        all_sent = ngram_join.keep_one(spark.read.parquet(str(tmp_path / "docs"))).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == sorted(r.doc_id for r in all_sent) == list(range(300))


def test_texts_beyond_a_slice_are_read_whole(spark):
    words = [f"w{i}" for i in range(260_000)]
    long_, near = " ".join(words), " ".join([*words[:-9], *("y" * 5 for _ in range(9))])  # about 1.8 MB each
    one = "x" * (3 << 20)
    docs = spark.createDataFrame([(1, long_), (2, near), (3, one), (4, one + " b"), (5, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.join(docs).collect()}
    assert [got[i].component_id for i in range(1, 6)] == [1, 1, 3, 4, 5] and got[1].n_shingles == len(words) - 2 and got[3].n_shingles == 1
    assert {r.doc_id: r.n_words for r in quality.measure(docs).collect()} == {1: len(words), 2: len(words), 3: 1, 4: 2, 5: 3}
    cut = {r.doc_id: r.n_removed for r in substring.deduplicate(docs).collect()}
    assert cut == {1: 0, 2: len(words) - 9, 3: 0, 4: 0, 5: 0}


def test_mix_keeps_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}", "keep", i) for i in range(30)], "doc_id long, text string, source string, _source string, _epoch int")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "__n_tokens", "__exponent", "__weight", "__epoch", "__order"]
    assert {r._source for r in out.collect()} == {"keep"} and out.where("_epoch <> doc_id").count() == 0


@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_odd_tables(spark, tmp_path, empty):
    """No rows; and columns named like those that stages make themselves."""
    rows = [(None, None, None, 1, "a", "b", 2), (1, "some words " * 30, "s", 1, "a", "b", 2), (2, " ".join(f"w{i}" for i in range(60)), None, 1, "a", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, r string, name string, _copies int")
    now = docs.limit(0) if empty else docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, "")
        assert i == 4 or now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert {r.doc_id for r in now.collect()} == (set() if empty else {2})


def test_vectors_that_share_an_id_have_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.0, 1.0, 0.01], 0), (9, [0.0, 0.0, 1.0], 0), (9, [0.0, 0.0, 1.0], 0)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_wide_vectors_make_more_shards(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 8 * 16 * 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16))
    x[600:] = x[:100] + rng.normal(size=(100, 16)) * 0.02
    got = hnsw.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert {r.shards for r in got} == {7} and [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == true.tolist()


@pytest.mark.parametrize("noise", [0.02, 0.05, 0.09])
def test_groups_of_near_vectors_are_counted_by_balls(noise):
    """Balls that link whole, balls that link in part, and balls that no longer link."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1600, 16))
    for at, of in ((0, 900), (900, 1200)):
        x[at:of] = x[at] + rng.normal(size=(of - at, 16)) * noise * np.linalg.norm(x[at])
    x[1200:1210] = x[1210:1220] * 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[rng.permutation(len(x))]
    size = rng.integers(1, 4, len(x))
    g = hnsw.Graph(x, tight=float(np.cos(0.499 * np.arccos(0.93))))
    found, _, recall = hnsw.search(g, x[g.leaders], 0.93 - 1e-9, True, g.wide[g.leaders])
    a, b = np.repeat(g.leaders, [len(f) for f in found]), np.concatenate(found)
    a, b = np.divmod(np.unique(np.minimum(a, b) * len(x) + np.maximum(a, b)), len(x))
    n, n2, edges = hnsw.counted(g, g, size, size, a[a != b], b[a != b], 0.93)
    inner = np.bincount(g.lead, size, len(x))[g.lead] - size
    true = (x @ x.T >= 0.93) @ size - size
    assert recall >= hnsw.RECALL and (n + n2 + inner == true).mean() >= 0.99 and (n + n2 + inner <= true).all()
    assert all(x[i] @ x[j] >= 0.93 for i, j in edges)
    if noise == 0.02:
        assert len(g.leaders) < 420 and len(a) < 2 * len(g.leaders)


def test_a_search_looks_at_no_more_vectors_in_a_larger_graph(monkeypatch):
    """Side by side too, a search stays a search: its similarities don't grow with the graph, and there are few steps in Python."""
    rng = np.random.default_rng(12)
    seen, calls = [], []
    dots = hnsw.Graph._dots
    monkeypatch.setattr(hnsw.Graph, "_dots", lambda self, q, r, j, x: (seen.append(len(r)), dots(self, q, r, j, x))[1])
    for n in (1000, 5000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g = hnsw.Graph(x)
        seen.clear()
        g.above(x[:256], 0.93, hnsw.BEAM)
        calls.append((sum(seen) / 256, len(seen)))
    assert calls[1][0] < 1.5 * calls[0][0] and calls[1][0] < 0.2 * 5000 and max(c for _, c in calls) < 256
