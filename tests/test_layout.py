"""Reads stored by place: every read once, scans that read few files, deep bins in several files."""

import glob
import random

from spanweave.sources import layout

SCHEMA = "chrom string, rs long, re long, name string"


def stored(spark, tmp_path, size=1000):
    rng, rows = random.Random(4), []
    for i in range(3000):
        at = rng.randrange(0, 60_000) if i % 3 else 20_500 + i % 7
        rows.append((rng.choice(["1", "2", "x"]), at, at + rng.choice([50, 90, 4000]), f"r{i}"))
    rows += [rows[0], (None, 1, 2, "lost"), ("1", None, None, "lost")]
    path = str(tmp_path / "stored")
    layout.write_reads(spark.createDataFrame(rows, SCHEMA), path, size)
    return path, [r for r in rows if r[0] and r[1] is not None]


def test_scans_are_those_of_all_reads(spark, tmp_path):
    path, rows = stored(spark, tmp_path)
    assert sorted(tuple(r) for r in layout.stored_reads(spark, path).select("chrom", "rs", "re", "name").collect()) == sorted(rows)
    regions = [("1", 20_000, 21_000, "a"), ("2", 999, 1001, "b"), ("x", 59_000, 90_000, "c"), ("x", 0, 1, "d"), ("1", 5, 5, "empty"), ("none", 0, 99, "e")]
    found = layout.scan_stored(spark.createDataFrame(regions, "chrom string, start long, end long, tag string"), path)
    want = sorted((t, n) for c, s, e, t in regions for k, a, b, n in rows if s < e and k == c and a < e and s < b)
    assert sorted((r.tag, r.name) for r in found.collect()) == want


def test_other_folders_are_pruned_at_run_time(spark, tmp_path):
    path, _ = stored(spark, tmp_path)
    regions = spark.createDataFrame([("2", 30_000, 30_500)], "chrom string, start long, end long")
    found = layout.scan_stored(regions, path)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()
    scans = _scan_metrics(found)
    assert scans and min(scans) < len(glob.glob(f"{path}/reads/chrom=*/bin=*/*.parquet")) / 4


def test_small_bins_make_no_more_folders(spark, tmp_path):
    path, rows = stored(spark, tmp_path, 20)
    assert len(glob.glob(f"{path}/reads/chrom=*/bin=*")) <= 3 * layout.FOLDERS
    regions = [("1", 20_000, 21_000, "a"), ("2", 999, 1001, "b"), ("x", 59_000, 90_000, "c"), ("x", 20_510, 20_511, "d")]
    found = layout.scan_stored(spark.createDataFrame(regions, "chrom string, start long, end long, tag string"), path)
    assert sorted((r.tag, r.name) for r in found.collect()) == sorted((t, n) for c, s, e, t in regions for k, a, b, n in rows if k == c and a < e and s < b)
    assert sorted(tuple(r) for r in layout.stored_reads(spark, path).select("chrom", "rs", "re", "name").collect()) == sorted(rows)


def _scan_metrics(df):
    """Files read by each scan of an executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    stack, out = [plan], []
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            metric = node.metrics().get("numFiles")
            out += [metric.get().value()] if metric.isDefined() else []
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return out
