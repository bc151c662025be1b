"""Indexed sequences against the reader of whole records: lines of any width, ends of lines, regions, a wrong index."""

import random

import pytest

from spanweave.sources import formats, genome


def write(folder, width, ending="\n"):
    rng = random.Random(width)
    data, rows, wanted = b"", [], {}
    for name, n in (("c1", 1000), ("c2", 7), ("empty", 0), ("c3", width * 3)):
        wanted[name] = "".join(rng.choice("ACGTNacgt") for _ in range(n))
        data += f">{name} told{ending}".encode()
        rows.append(f"{name}\t{n}\t{len(data)}\t{width if n else 0}\t{width + len(ending) if n else 0}")
        data += "".join(wanted[name][i : i + width] + ending for i in range(0, n, width)).encode()
    path = folder / f"g{width}{len(ending)}.fa"
    path.write_bytes(data)
    (folder / f"{path.name}.fai").write_text("\n".join(rows) + "\n")
    return str(path), wanted


@pytest.mark.parametrize("width,ending,chunk,split", [(60, "\n", 64, 64), (60, "\r\n", 100, 250), (13, "\n", 1 << 16, 1 << 20), (1, "\n", 7, 10)])
def test_chunks_are_those_of_whole_records(spark, tmp_path, width, ending, chunk, split):
    path, wanted = write(tmp_path, width, ending)
    got = genome.read_genome(spark, path, chunk, split=split)
    rows = {(r.chrom, r.chunk_no): r.seq for r in got.collect()}
    assert {n: "".join(s for (c, _), s in sorted(rows.items()) if c == n) for n in wanted} == wanted
    assert all(len(s) <= chunk for s in rows.values())
    whole = {(r.chrom, r.chunk_no): r.seq for r in formats.read_fasta(spark, path, chunk).collect()}
    assert {k: v for k, v in rows.items() if k[0] != "empty"} == {k: v for k, v in whole.items() if k[0] != "empty"}
    each = max(1, split // chunk)
    assert got.rdd.getNumPartitions() == sum(-(-max(1, -(-len(s) // chunk)) // each) for s in wanted.values())


def test_regions_and_subsequences(spark, tmp_path):
    path, wanted = write(tmp_path, 50)
    part = genome.read_genome(spark, path, 32, ("c1", 100, 165))
    assert sorted(r.chunk_no for r in part.collect()) == [3, 4, 5]
    ranges = spark.createDataFrame([(1, "c1", 100, 165), (2, "c1", 128, 160), (3, "c2", 0, 7)], "id long, chrom string, start long, end long")
    got = {r.id: r.seq for r in formats.subsequences(ranges, genome.read_genome(spark, path, 32), 32).collect()}
    assert got == {1: wanted["c1"][100:165], 2: wanted["c1"][128:160], 3: wanted["c2"]}
    plain = tmp_path / "plain.fa"
    plain.write_text(f">c1\n{wanted['c1']}\n")
    assert sorted((r.chunk_no, r.seq) for r in genome.read_genome(spark, str(plain), 32, ("c1", 100, 165)).collect()) == sorted((r.chunk_no, r.seq) for r in part.collect())


def test_wrong_index(spark, tmp_path):
    path, _ = write(tmp_path, 50)
    with open(path + ".fai", "a") as file:
        file.write("c9\t1000\t900\t50\t51\n")
    with pytest.raises(Exception, match="index differ"):
        genome.read_genome(spark, path).count()


def test_a_genome_is_never_broadcast(spark):
    from pyspark.sql import functions as F

    from spanweave.sources.formats import subsequences

    genome = spark.range(50).select(F.lit("c").alias("chrom"), F.col("id").alias("chunk_no"), F.repeat(F.lit("ACGT"), 2).alias("seq"))
    ranges = spark.range(3).select(F.col("id").cast("string").alias("id"), F.lit("c").alias("chrom"), (F.col("id") * 8 + 6).alias("start"), (F.col("id") * 8 + 10).alias("end"))
    found = subsequences(ranges, genome, 8)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["seq"] for r in found.collect()} == {"GTAC"}
