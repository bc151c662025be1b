import random

import numpy as np
import pytest

from spanweave.functions import graphs, quantiles
from spanweave.operators import intervals as iv
from spanweave.operators import segments


@pytest.mark.parametrize(
    "spans, merged",
    [
        ([(100, 200), (150, 250)], [(100, 250)]),
        ([(100, 200), (200, 300)], [(100, 300)]),
        ([(100, 200), (201, 300)], [(100, 200), (201, 300)]),
        ([(300, 400), (100, 350), (100, 350)], [(100, 400)]),
        ([(5, 5)], []),
    ],
)
def test_merge(spark, spans, merged):
    df = spark.createDataFrame([("c", s, e) for s, e in spans], "chrom string, start long, end long")
    assert sorted((r.start, r.end) for r in iv.merge_intervals(df, ["chrom"]).collect()) == merged


def test_merge_across_tiles_and_strict(spark):
    edge = 1 << 20
    df = spark.createDataFrame([("c", edge - 10, edge + 5), ("c", edge + 2, edge + 9), ("c", edge + 9, edge + 12)], "chrom string, start long, end long")
    assert [(r.start, r.end, r.n) for r in iv.merge_intervals(df, ["chrom"]).collect()] == [(edge - 10, edge + 12, 3)]
    strict = iv.merge_intervals(df, ["chrom"], touching=False).collect()
    assert sorted((r.start, r.end) for r in strict) == [(edge - 10, edge + 9), (edge + 9, edge + 12)]


def test_overlap_join_finds_each_pair_once(spark):
    rng = random.Random(4)
    left = [(i, s, s + rng.randint(1, 400)) for i, s in enumerate(rng.sample(range(3000), 60))]
    right = [(i, s, s + rng.randint(1, 400)) for i, s in enumerate(rng.sample(range(3000), 60))]
    a = spark.createDataFrame([("c", *x) for x in left], "chrom string, i long, start long, end long")
    b = spark.createDataFrame([("c", *x) for x in right], "chrom string, j long, r_start long, r_end long")
    found = sorted((r.i, r.j) for r in iv.overlap_join(a, b, ["chrom"], 128).collect())
    assert found == sorted((i, j) for i, s, e in left for j, t, f in right if s < f and t < e)


def test_nearest_with_both_tolerances(spark):
    sites = spark.createDataFrame([("c", 10), ("c", 10), ("c", 500)], "chrom string, pos long")
    targets = spark.createDataFrame([("c", 12), ("c", 40), ("c", 90), ("c", 430)], "chrom string, pos long")
    after = sorted((r.pos, r.target) for r in iv.nearest_after(sites, targets, ["chrom"], 3, 100).collect() if r.target)
    assert after == [(10, 40), (10, 40)]
    before = [(r.pos, r.target) for r in iv.nearest_before(sites, targets, ["chrom"], 3, 100).collect() if r.target]
    assert before == [(500, 430)]


def test_depth_bins_and_maxima(spark):
    df = spark.createDataFrame([("c", 0, 10), ("c", 5, 15), ("c", 20, 30)], "chrom string, start long, end long")
    assert sorted((r.start, r.end, r.depth) for r in iv.depth_runs(df, ["chrom"]).collect()) == [(0, 5, 1), (5, 10, 2), (10, 15, 1), (20, 30, 1)]
    assert sorted((r.bin, r.n) for r in iv.bin_counts(df, ["chrom"], "start", "end", 10, 0).collect()) == [(0, 2), (1, 1), (2, 1)]
    votes = spark.createDataFrame([("c", 1, 3), ("c", 4, 3), ("c", 50, 1)], "chrom string, pos long, n long")
    assert sorted(r.pos for r in iv.local_maxima(votes, ["chrom"], "pos", "n", 10).collect()) == [1, 50]


def test_runs_and_segments(spark):
    df = spark.createDataFrame([("g", i) for i in [1, 2, 3, 5, 6, 8]], "g string, i long")
    assert sorted((r.first, r["last"]) for r in iv.runs(df, ["g"], "i").collect()) == [(1, 3), (5, 6), (8, 8)]
    bounds = spark.createDataFrame([("g", p) for p in (10, 20, 20, 45)], "g string, pos long")
    assert [(r.seg_idx, r.start, r.end) for r in iv.segments(bounds, ["g"]).orderBy("seg_idx").collect()] == [(0, 10, 20), (1, 20, 45)]


def test_runs_hold_one_sort_and_keep_nulls(spark):
    rng, rows = random.Random(8), [("a", None), ("b", 4), (None, 1), (None, 2), (None, 2)]
    rows += [(rng.choice("abc"), rng.randrange(-30, 60)) for _ in range(150)]
    want = set()
    for g in {r[0] for r in rows}:
        own = {i for h, i in rows if h == g and i is not None}
        firsts = sorted(i for i in own if i - 1 not in own)
        want |= {(g, i, next(k for k in range(i, 99) if k + 1 not in own)) for i in firsts}
    found = iv.runs(spark.createDataFrame(rows, "g string, i long"), ["g"], "i")
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want | {("a", None, None)} and len(got) == len(set(got))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2  # of the distinct rows only


def test_quantiles():
    assert quantiles.poisson_inverse(6.55) == 13
    assert quantiles.poisson_inverse(0.0) == 0


def test_beta_against_closed_forms():
    x, n = np.array([1e-9, 0.01, 0.3, 0.5, 0.77, 0.999]), np.array([0.2, 1.0, 3.5, 40.0, 3000.0, 1e7])
    assert np.allclose(quantiles.beta_cdf(x[:, None], 1.0, n), -np.expm1(n * np.log1p(-x[:, None])), rtol=1e-7)
    assert np.allclose(quantiles.beta_cdf(x[:, None], n, 1.0), x[:, None] ** n, rtol=1e-7, atol=1e-300)
    assert np.allclose(quantiles.beta_cdf(x, 2.0, 3.0), 6 * x**2 - 8 * x**3 + 3 * x**4)
    assert np.allclose(quantiles.beta_cdf(x, 7.5, 90.0) + quantiles.beta_cdf(1 - x, 90.0, 7.5), 1)
    assert np.allclose(quantiles.beta_cdf(0.5, n, n), 0.5)
    for p in (0.01, 0.5, 0.99):
        assert np.allclose(quantiles.beta_inverse(p, 1.0, n), -np.expm1(np.log1p(-p) / n), rtol=1e-7)
        assert np.allclose(quantiles.beta_inverse(p, n, 1.0), p ** (1 / n), rtol=1e-7)
        back = quantiles.beta_cdf(quantiles.beta_inverse(p, n, 20 * n), n, 20 * n)
        assert np.allclose(back, p, rtol=1e-6)
    assert quantiles.beta_cdf(np.array([-1.0, 0.0, 1.0, 2.0]), 2.0, 2.0).tolist() == [0, 0, 1, 1]
    assert quantiles.beta_inverse(0.01, 1e-6, 100.0)[0] == 0 and np.isnan(quantiles.beta_inverse(0.5, 3.0, -1.0)[0])


def test_expression_bounds(spark):
    low, middle, high = quantiles.fpkm_bounds([10], [200], [1e6])[0]
    assert low < middle < high and abs(middle - 10 / 1e6 * 1e9 / 200) < 2
    by = ["chrom", "strand", "gene"]
    segs = spark.createDataFrame([("c", "+", 1, 0, 100, 200), ("c", "+", 1, 1, 200, 250)], "chrom string, strand string, gene int, seg_idx int, start long, end long")
    depth = spark.createDataFrame([("c", "+", 1, 150, 260, 6), ("c", "+", 1, 90, 110, 3), ("c", "-", 2, 100, 200, 9)], "chrom string, strand string, sample int, start long, end long, depth long")
    samples = spark.createDataFrame([(1, 150, 1000), (2, 100, 2000)], "sample int, length int, mapped long")
    got = {(r.seg_idx, r.sample): r for r in segments.segment_expression(segs, depth, samples, by, by[:2]).collect()}
    assert {k: round(r["count"], 4) for k, r in got.items()} == {(0, 1): round(330 / 150, 4), (1, 1): 2.0, (0, 2): 0.0, (1, 2): 0.0}
    assert all(r.low <= r.middle <= r.high for r in got.values())
    assert abs(got[1, 1].middle - quantiles.beta_inverse(0.5, 2 + 1e-6, 998 - 1e-6)[0] * 1e9 / 50) < 1e-3


def test_cliques():
    pairs = [(0, 1), (0, 2), (1, 2), (0, 5), (2, 3), (3, 4), (4, 5)]
    adjacent = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(7)}
    assert graphs.maximal_cliques(adjacent) == [(0, 1, 2), (0, 5), (2, 3), (3, 4), (4, 5), (6,)]


def test_interval_cliques_are_the_graphs(spark):
    rng, rows = random.Random(2), []
    for gene in range(40):
        rows += [(gene, i, s, s + rng.randint(1, 9)) for i, s in enumerate(rng.choices(range(25), k=rng.randint(1, 9)))]
    df = spark.createDataFrame(rows, "gene int, i int, start long, end long")
    common = {}
    for r in iv.cliques(df, ["gene"]).collect():
        common.setdefault(r.gene, []).append((r.start, r.end, r.size, r.clique))
    groups = {}
    for r in iv.clique_runs(df, ["gene"]).collect():
        groups.setdefault((r.gene, r.first_clique, r.last_clique), set()).add(r.i)
    for gene in range(40):
        spans = {i: (s, e) for g, i, s, e in rows if g == gene}
        adjacent = {i: {j for j, (t, f) in spans.items() if j != i and s < f and t < e} for i, (s, e) in spans.items()}
        wanted = graphs.maximal_cliques(adjacent)
        assert sorted(x[:3] for x in common[gene]) == sorted((max(spans[i][0] for i in c), min(spans[i][1] for i in c), len(c)) for c in wanted)
        assert sorted(x[3] for x in common[gene]) == list(range(len(wanted)))
        members = {}
        for i in spans:
            members.setdefault(tuple(i in c for c in wanted), set()).add(i)
        assert sorted(map(sorted, members.values())) == sorted(sorted(v) for k, v in groups.items() if k[0] == gene)


def test_junction_filter_depends_on_order():
    edges = {("d1", "a1"): 100, ("d1", "a2"): 6, ("d2", "a2"): 105, ("d3", "a2"): 7}
    assert ("d3", "a2") in graphs.prune_junctions(edges, 2, 5, 0.06)
    later = dict(reversed(edges.items()))
    assert set(graphs.prune_junctions(later, 2, 5, 0.06)) == {("d1", "a1"), ("d2", "a2")}


def test_chains():
    assert graphs.chains([(0, 10), (5, 12), (20, 30)], 50, 200) == [(0, 2), (1, 2)]
    assert graphs.chains([(i, i + 1) for i in range(60)], 50, 200) is None


def test_sweeps_do_not_depend_on_tiles(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), s := rng.randrange(300), s + rng.choice([1, 5, 60]), rng.randrange(4)) for _ in range(250)]
    df = spark.createDataFrame(rows, "g string, start long, end long, v int")
    plain = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    sums = df.groupBy("g", "start").agg({"v": "sum"}).withColumnRenamed("sum(v)", "v")
    for tile in (3, 17, 100):
        assert plain(iv.depth_runs(df, ["g"], tile=tile)) == plain(iv.depth_runs(df, ["g"]))
        assert plain(iv.local_maxima(sums, ["g"], "start", "v", 4, tile=tile)) == plain(iv.local_maxima(sums, ["g"], "start", "v", 4))
        assert plain(iv.drop_repeats(df, ["g"], ["start", "v", "end"], ["start", "v"], tile=tile)) == plain(iv.drop_repeats(df, ["g"], ["start", "v", "end"], ["start", "v"]))
    depth = {}
    for r in iv.depth_runs(df, ["g"], tile=17).collect():
        depth |= {(r.g, p): r.depth for p in range(r.start, r.end)}
    for g in ("a", "b", None):
        for p in range(370):
            assert depth.get((g, p), 0) == sum(x[0] == g and x[1] <= p < x[2] for x in rows)


def test_repeats_are_those_of_the_row_before(spark):
    rng, order = random.Random(3), ["s", "k", "e", "name"]
    rows = [(rng.choice(["a", None]), rng.randrange(3000), rng.choice(["+", "-", None]), rng.randrange(2), f"n{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "c string, s long, k string, e long, name string")
    for same in (["s", "k"], ["k"], ["e", "k"]):
        want, last = [], {}
        at = [["c", "s", "k", "e", "name"].index(x) for x in same]
        for r in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3], r[4])):
            key = tuple(r[i] for i in at)
            want += [r] if last.get(r[0]) != key else []
            last[r[0]] = key
        got = iv.drop_repeats(df, ["c"], order, same, 1000)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = iv.drop_repeats(df, ["c"], order, ["s", "k"]).select("s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "name" not in plan.split("Relation")[0].split("LogicalRDD")[0]


def test_lone_sites_by_stretches(spark):
    """Against brute force, where tiles of a few stretches have borders everywhere; nulls meet nothing."""
    rng = random.Random(8)
    sites = [("c" if rng.random() < 0.7 else "d", rng.randint(-3000, 3000)) for _ in range(600)]
    targets = [("c" if rng.random() < 0.7 else "d", rng.randint(-3000, 3000)) for _ in range(150)]
    odd = [(None, 5), ("c", None), ("c", None)]
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, pos long")
    for reach in (0, 7, 29, 200):
        want = {(c, p) for c, p in sites if not any(c == d and abs(p - q) <= reach for d, q in targets)} | set(odd)
        for tile in (1, 64, 100, 1 << 16):
            found = [tuple(r) for r in iv.lone(frame(sites + odd), frame(targets + odd), ["chrom"], reach, tile=tile).collect()]
            assert len(found) == len(set(found)) and set(found) == want
    # one row for a stretch of sites, and two shuffles
    plan = iv.lone(frame(sites), frame(targets), ["chrom"], 29)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chrom") == 2


def test_expression_bounds_are_taken_once_for_each_count(spark):
    """All segments of a sample that show as much share their quantiles; lengths only scale them."""
    import glob

    from spanweave.functions import quantiles
    from spanweave.operators import segments
    from spanweave.storage import shared_dir

    by = ["chrom", "strand", "gene"]
    segs = spark.createDataFrame([("c", "+", g, 0, 1000 * g, 1000 * g + 200 + 100 * (g % 3)) for g in range(60)], "chrom string, strand string, gene long, seg_idx int, start long, end long")
    depth = spark.createDataFrame([("c", "+", s, 1000 * g, 1000 * g + 150, 1 + g % 2) for g in range(50) for s in (1, 2)], "chrom string, strand string, sample long, start long, end long, depth long")
    samples = spark.createDataFrame([(1, 1000, 150), (2, 2000, 150)], "sample long, mapped long, length int")
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    before = set(glob.glob(f"{folder}/count-bounds-*"))
    got = segments.segment_expression(segs, depth, samples, by, by[:2]).collect()
    assert len(got) == 120
    (made,) = set(glob.glob(f"{folder}/count-bounds-*")) - before
    assert spark.read.parquet(made).count() == 6  # no depth, one read and two, in both samples
    for r in got:
        want = quantiles.fpkm_bounds([r["count"]], [r.length], [1000 * r.sample])[0]
        assert all(abs(x - y) <= 1e-9 * y for x, y in zip((r.low, r.middle, r.high), want, strict=True))
