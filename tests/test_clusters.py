import pytest

from spanweave.operators import clusters
from spanweave.sources import formats

BLOCKS = "blocks array<struct<start:long,end:long>>"


def test_assignment(spark):
    genes = spark.createDataFrame([("g1", "c", "+", [(0, 100), (200, 300)]), ("g2", "c", "-", [(0, 100)]), ("g3", "c", "+", [(900, 950)]), ("g4", "c", "+", [(40, 60)])], f"name string, chrom string, strand string, {BLOCKS}")
    parts = spark.createDataFrame([("a", "c", "+", 0, 60), ("a", "c", "+", 50, 70), ("b", "c", "+", 40, 100), ("b", "c", "+", 200, 250)], "cluster string, chrom string, strand string, start long, end long")
    got = {r.name: r.cluster for r in clusters.assign(genes, parts, ["chrom", "strand"]).collect()}
    assert got == {"g1": "b", "g2": None, "g3": None, "g4": "a"}
    listed = spark.createDataFrame([("a", "g1"), ("a", "gone")], "cluster string, gene string")
    assert clusters.listed_genes(listed.limit(1), genes).first().name == "g1"
    with pytest.raises(Exception, match="no such gene: gone"):
        clusters.listed_genes(listed, genes).collect()
    rows = spark.createDataFrame([("a", "g1", "c", "+", 5, 50), ("a", "g4", "c", "+", 1, 9)], "cluster string, name string, chrom string, strand string, start long, end long")
    assert clusters.span_lines(rows).first().line == "c\t1\t50\ta\t2\t+"
    for other in (("a", "g2", "d", "+", 5, 50), ("a", "g2", "c", "-", 5, 50)):
        with pytest.raises(Exception, match="several chromosomes or strands: a"):
            clusters.span_lines(rows.unionByName(spark.createDataFrame([other], rows.schema))).collect()


def test_outputs(spark, tmp_path):
    lines = spark.createDataFrame([("x",)], "line string")
    isos = spark.createDataFrame([("F", "f1"), ("P", "p1")], "label string, line string")
    formats.write_outputs({"intron": lines}, isos, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/intron.bed6").first()[0] == "x"
    assert {(r.kind, r.value) for r in spark.read.text(f"{tmp_path}/isoforms.bed12").collect()} == {("isoF", "f1"), ("isoP", "p1")}
    with pytest.raises(ValueError):
        formats.write_outputs({"exon": lines}, isos, str(tmp_path))
