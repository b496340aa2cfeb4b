"""Cells and codes against brute force."""

import numpy as np
import pytest

from quillgraph.operators import cells


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim)) * 2
    return [(i, (centres[i % 30] + rng.normal(size=dim)).tolist()) for i in range(n)]


def brute(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in asked:
        c = x @ (np.array(v) / np.linalg.norm(v))
        order = [j for j in np.lexsort((ids, -np.round(c, 12))) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), round(float(c[j]), 9)) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r["rank"])):
        out.setdefault(r.query, []).append((r.id, round(r.cosine, 9)))
    return out


def test_recall_and_exact_scores(spark):
    """A third of all vectors are copies of one; recall over every fiftieth id is what was asked for, scores are exact."""
    rows = clustered(3000) + [(5000 + i, clustered(1)[0][1]) for i in range(1500)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").repartition(6)
    s = cells.Setting(sample=1500, block=256, probes=2, proposals=16, recall=0.95)
    index = cells.build(v, s)
    assert max(index.parts_of_cell.values()) >= 1500 // 256 and index.blocks.count() > len(index.parts_of_cell)
    asked = [(i, x) for i, x in rows if i % 50 == 0]
    got = found(cells.search(index, v.where("id % 50 = 0").withColumnRenamed("id", "query"), 10))
    want = brute(rows, asked, 10)
    least = {q: w[-1][1] for q, w in want.items()}
    hit = sum(c >= least[q] - 1e-9 for q, f in got.items() for _, c in f)
    assert hit >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): c for q, w in brute(rows, asked, 4500).items() for i, c in w}
    assert all(abs(exact[q, i] - c) < 1e-8 for q, f in got.items() for i, c in f)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0]), (3, [1.0, 1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, 2.0]), (8, [float("nan")] * 4), (None, [1.0] * 4), (9, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    got = found(cells.search(cells.build(v, cells.Setting(recall=1.0)), v.withColumnRenamed("id", "query"), 2))
    assert {q: [i for i, _ in f] for q, f in got.items()} == {1: [9, 3], 2: [3, 1], 3: [1, 2], 9: [1, 3]}
    assert cells.search(cells.build(v.limit(0)), v.withColumnRenamed("id", "query"), 2).count() == 0
    with pytest.raises(ValueError):
        cells.build(v.where("id = 7"))


def test_no_vectors_come_to_the_driver(spark, monkeypatch):
    """What is collected while an index is built and searched: what was fitted, and figures; no row holds a vector."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (seen.append(dict(self.dtypes)), collect(self))[1])
    v = spark.createDataFrame(clustered(600), "id long, vector array<double>")
    got = cells.search(cells.build(v, cells.Setting(sample=200, recall=1.0)), v.where("id % 50 = 0").withColumnRenamed("id", "query"), 3)
    assert seen and not any("array<double>" in t for types in seen for t in types.values())
    assert got.count() == 36


def test_an_audit_of_many_widths_is_one_plan(spark):
    """Vectors without cells that help: from a probe and a proposal it is as many jobs to everything as from everything."""
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)))]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = v.where("id % 50 = 0").withColumnRenamed("id", "query")
    jobs, got = [], []
    for probes, proposals in ((1, 1), (1024, 900)):
        index = cells.build(v, cells.Setting(sample=300, probes=probes, proposals=proposals, recall=1.0))
        spark.sparkContext.setJobGroup(f"audit-{probes}", "an audit")
        s = cells.widened(index, asked, 10)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"audit-{probes}")))
        spark.sparkContext.setJobGroup("rest", "the rest")
        assert s.probes > 1 and s.proposals > 1
        got.append(found(cells.search(index, asked, 10)))
    assert jobs[0] == jobs[1] <= 25
    assert got[1] == brute(rows, [(i, x) for i, x in rows if i % 50 == 0], 10)
    assert got[0] == got[1]  # all 18 queries are audited


def test_a_part_sends_on_its_best(spark):
    """A part of copies, repeated ids and others gives at most ``k`` rows a query, those of brute force, ties to the smaller id; also where codes choose."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.repeat(rng.normal(size=(2, 8)), 150, axis=0), rng.normal(size=(300, 8))])
    ids = rng.permutation(np.r_[np.arange(598), 3, 3])
    centres = cells.means(x / np.linalg.norm(x, axis=1, keepdims=True), 4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rest = unit - centres[cells.nearest(unit, centres)]
    words = np.stack([cells.means(rest[:, i : i + 4], 64) for i in (0, 4)])
    own, codes = cells.codes_of(unit, centres, words)
    held = cells._Held(ids, own, codes, [v.tobytes() for v in x], (centres, words), 5)
    at = np.r_[0, 160, 400:420, np.flatnonzero(ids == 3)]
    for proposals in (600, 20):
        got = {}
        for who, found_ids, cosine in held.answers(ids[at], x[at], [sorted(set(own.tolist()))] * len(at), proposals):
            for i, j, c in zip(who.tolist(), found_ids.tolist(), cosine.tolist(), strict=True):
                got.setdefault(i, []).append((j, round(c, 9)))
        assert all(len(f) == 5 for f in got.values()) and len(got) == len(at)
        if proposals == 600:
            for i, q in enumerate(at):
                c = np.round(unit @ unit[q], 9)
                order = [j for j in np.lexsort((ids, -c)) if ids[j] != ids[q]][:5]
                assert got[i] == [(ids[j], c[j]) for j in order]


def test_blocks_without_vectors(spark):
    """Blocks of one vector: many of a cell's blocks get none, and the parts asked for them have nothing of that cell."""
    rows = clustered(200, 8)
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    index = cells.build(v, cells.Setting(sample=100, block=1, recall=1.0, audit=200))
    assert index.blocks.count() < sum(index.parts_of_cell.values())
    assert found(cells.search(index, v.withColumnRenamed("id", "query"), 4)) == brute(rows, rows, 4)


def test_ids_that_are_strings(spark):
    rows = [(f"v{i:03d}", x) for i, x in clustered(300, 8)]
    v = spark.createDataFrame(rows, "id string, vector array<double>")
    asked = v.where("id like '%7'").withColumnRenamed("id", "query")
    got = found(cells.search(cells.build(v, cells.Setting(sample=200, recall=1.0)), asked, 3))
    want = brute(list(enumerate(x for _, x in rows)), [(i, x) for i, (_, x) in enumerate(rows) if i % 10 == 7], 3)
    assert got == {f"v{q:03d}": [(f"v{i:03d}", c) for i, c in w] for q, w in want.items()}


def test_codes_are_near_what_they_stand_for():
    x = np.array([v for _, v in clustered(2000)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = cells.means(x, 40)
    rest = x - centres[cells.nearest(x, centres)]
    words = np.stack([cells.means(rest[:, i : i + 4], 128) for i in range(0, 16, 4)])
    cell, codes = cells.codes_of(x, centres, words)
    back = centres[cell] + np.concatenate([w[codes[:, i]] for i, w in enumerate(words)], 1)
    assert ((x - back) ** 2).sum(1).mean() < 0.3 * (rest**2).sum(1).mean()
