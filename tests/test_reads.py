from pyspark.sql import functions as F

from spanweave.functions import isoforms as iso
from spanweave.operators import paths, reads
from spanweave.sources import formats

CIGAR = "array<struct<op:int,len:bigint>>"


def test_junction_needs_flanks(spark):
    ops = [(0, 20), (3, 20), (0, 20), (1, 1), (0, 1), (3, 20), (0, 20), (2, 10), (0, 5), (3, 20), (0, 20)]
    df = spark.createDataFrame([(100, ops)], f"rs long, cigar {CIGAR}")
    got = df.select(reads.junctions(F.col("cigar"), F.col("rs"), 10).alias("j")).first().j
    assert [(x.start, x.end) for x in got] == [(120, 140)]


def test_blocks_introns_cigar(spark):
    df = spark.createDataFrame([(100, [(0, 20), (3, 20), (0, 20), (2, 5), (0, 5)])], f"rs long, cigar {CIGAR}")
    df = df.withColumn("blocks", reads.cigar_blocks(F.col("cigar"), F.col("rs")))
    row = df.select("blocks", reads.introns(F.col("blocks")).alias("i"), reads.blocks_to_cigar(F.col("blocks")).alias("c")).first()
    assert [tuple(b) for b in row.blocks] == [(100, 120), (140, 160), (165, 170)]
    assert [tuple(b) for b in row.i] == [(120, 140), (160, 165)] and row.c == "20M20N20M5N5M"


def test_names_sites_and_sequences(spark):
    df = spark.createDataFrame([("c1/f12p3/900",), ("x",), (None,)], "n string")
    assert [r[0] for r in df.select(reads.full_length_count(F.col("n"))).collect()] == [12, 1, 1]
    df = spark.createDataFrame([("gt", "AG"), ("GC", "ag"), ("AT", "AC"), ("AA", "AG")], "a string, b string")
    assert [r[0] for r in df.select(reads.splice_priority(F.col("a"), F.col("b"))).collect()] == [3, 2, 1, 0]
    assert spark.range(1).select(reads.reverse_complement(F.lit("aACGn"))).first()[0] == "NCGTT"


def test_formats(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@SQ\tSN:Chr01\tLN:7000\n" + "r1\tpPr1\tChr01\t11\t60\t5S10M20N10M\t=\t1\t0\tACGT\t*\n" + "c/f7p0/9\t256\tChr01\t11\t60\t10M\t=\t1\t0\tACGT\t*\n")
    assert [tuple(r) for r in formats.sam_sizes(spark, str(tmp_path / "a.sam")).collect()] == [("Chr01", 7000)]
    rows = formats.read_sam(spark, str(tmp_path / "a.sam"), "TGS").orderBy("order").collect()
    assert (rows[0].flag, rows[0].rs, rows[0].re, rows[0].qlen, rows[0].strand) == (83, 10, 50, 25, "-")
    assert [tuple(b) for b in rows[0].blocks] == [(10, 20), (40, 50)] and (rows[1].flag, rows[1].fl) == (256, 7)
    (tmp_path / "g.fa").write_text(">c1 x\nACGTAC\nGTTT\n>c2\nGG\n")
    genome = formats.read_fasta(spark, str(tmp_path / "g.fa"), 4)
    ranges = spark.createDataFrame([(1, "c1", 2, 9), (2, "c2", 0, 2)], "id long, chrom string, start long, end long")
    assert sorted((r.id, r.seq) for r in formats.subsequences(ranges, genome, 4).collect()) == [(1, "GTACGTT"), (2, "GG")]
    (tmp_path / "b.bed").write_text("c1\t100\t400\tg\t0\t+\t100\t100\t0,0,0\t2\t50,100,\t0,200,\n")
    bed = formats.read_bed12(spark, str(tmp_path / "b.bed"))
    row = bed.select("blocks", "transcript_len", formats.genomic_position(F.col("blocks"), F.lit(60)).alias("at")).first()
    assert [tuple(b) for b in row.blocks] == [(100, 150), (300, 400)] and row.transcript_len == 300 and row.at == 310
    assert paths.bed12_lines(bed.select("chrom", "strand", "name", "blocks")).first().line == "c1\t100\t400\tg\t0\t+\t100\t100\t0,0,0\t2\t50,100,\t0,200,"


def test_library_flip(spark):
    df = spark.createDataFrame([(64 + 16,), (128,)], "flag int")
    assert [r.flag for r in reads.library_flip(df, 1).collect()] == [64 + 32, 128]
    assert [r.flag for r in reads.library_flip(df, 2).collect()] == [64 + 16, 128 + 48]


GENE = iso.Gene(7, frozenset({0}), frozenset({6}), frozenset({(1, 1), (3, 3), (5, 5)}), frozenset())


def test_runs_and_gaps():
    assert iso.runs_of([1, 2, 3, 5, 6, 8]) == [(1, 3), (5, 6), (8, 8)]
    assert iso.inner_gaps((0, 1, 0, 1, -2, 1, 0)) == [(2, 2), (4, 4)]


def test_marks_and_validity():
    assert iso.mark_errors((1, 0, 1, 0, 1, 0, 1), GENE) == (1, 0, 1, 0, 1, 0, 1)
    assert iso.mark_errors((1, 0, 0, 1, 1, 0, 1), GENE) == (1, -2, -2, 1, 1, 0, 1)
    assert iso.is_valid((1, 0, 1, 1, 1, 0, 1), GENE) and not iso.is_valid((1, 0, 0, 1, 1, 1, 1), GENE)


def test_cascade():
    full = iso.Iso((1, 0, 1, 0, 1, 0, 1), fl=3)
    left, right = iso.Iso((1, 0, 1, 1, 0, 0, 0)), iso.Iso((0, 0, 1, 1, 1, 0, 1))
    out = {(x.path, x.label) for x in iso.assemble([full, left, right], GENE)}
    assert (full.path, "F") in out and ((1, 0, 1, 1, 1, 0, 1), "M") in out
    assert len({p for p, _ in out}) == len(out)
    assert {x.path for x in iso.predict(iso.Iso((0, 0, 1, 0, 1, 0, 0)), GENE)} == {(1, 0, 1, 0, 1, 0, 1), (1, 1, 1, 0, 1, 0, 1), (1, 0, 1, 0, 1, 1, 1), (1, 1, 1, 0, 1, 1, 1)}


def test_grouped_steps(spark):
    path = [1, 0, 1, 0, 1, 0, 1]
    rows = [("g", "read", path, path, path, 0, 0, 2, 7, "+", 0, 0), ("g", "start", None, None, None, 0, 0, 0, 7, "+", 0, 0), ("g", "stop", None, None, None, 6, 6, 0, 7, "+", 0, 0)]
    rows += [("g", kind, None, None, None, i, i, 0, 7, "+", 0, 4) for i in (1, 3, 5) for kind in ("intron", "link")]
    df = spark.createDataFrame(rows, "gene string, kind string, path array<int>, covers_first array<int>, covers_last array<int>, first int, last int, fl long, n_segs int, strand string, sample int, n int")
    assert [(r.label, r.fl, r.cluster) for r in paths.assemble(df, ["gene"]).collect()] == [("F", 2, 1)]
    found = paths.assemble(df, ["gene"]).selectExpr("'c' AS chrom", "'+' AS strand", "gene", "path", "label", "fl", "cluster")
    segs = spark.createDataFrame([("c", "+", "g", i, 10 * i, 10 * i + 10) for i in range(7)], "chrom string, strand string, gene string, seg_idx int, start long, end long")
    assert paths.isoform_lines(found, segs, ["chrom", "strand", "gene"], "gene", ["path"]).first().line == "c\t0\t70\tg_g_1_isoF_1\t0\t+\t0\t0\t0,0,0\t4\t10,10,10,10,\t0,20,40,60,"
    tagged = paths.tag(spark.createDataFrame([([0, 1, 0, 1, 0],), ([0, -2, 0],)], "segary array<int>"))
    assert [(r.sidx, r.eidx, r.invalid) for r in tagged.collect()] == [(1, 3, False), (None, None, True)]
