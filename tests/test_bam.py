"""Binary alignments against the same records as text, however the file is split; regions, an index, broken files."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spanweave.sources import bam, formats

REFS = [("Chr01", 70000), ("Chr02", 8000)]
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
COLUMNS = ["source", "sample", "qname", "flag", "chrom", "rs", "re", "mapq", "cigar", "mate_start", "seq", "qlen", "blocks", "strand", "fl"]


def records(n):
    rng = random.Random(3)
    out = []
    for i in range(n):
        ref = i * len(REFS) // n
        pos = (i % (n // 2)) * REFS[ref][1] // n
        cigar = [(rng.randint(1, 90), "M"), (rng.randint(1, 3000), "N"), (rng.randint(1, 9), rng.choice("MID=X")), (rng.randint(1, 40), "S")][: rng.choice([1, 2, 3, 4])]
        bases = sum(k for k, op in cigar if op in "MIS=X")
        out.append((f"c{i}/f{i % 7}p0/{bases}", rng.choice([0, 16, 83, 99, 147, 256, 1024, 4 if i % 5 else 1]), ref, pos, rng.randint(0, 60), cigar, pos // 2 - 1, "".join(rng.choice(BASES[1:]) for _ in range(bases))))
    out += [("unplaced", 4, -1, -1, 0, [], -1, "ACGTN"), ("no_bases", 4, -1, -1, 255, [], -1, "")]
    return out


def write_text(rows, path):
    head = ["@HD\tVN:1.6\tSO:coordinate"] + [f"@SQ\tSN:{n}\tLN:{k}" for n, k in REFS]
    lines = ["\t".join(map(str, [q, f, REFS[r][0] if r >= 0 else "*", p + 1, m, "".join(f"{k}{op}" for k, op in c) or "*", "=", mp + 1, 0, s or "*", "*"])) for q, f, r, p, m, c, mp, s in rows]
    path.write_text("\n".join(head + lines) + "\n")


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_binary(rows, path, size, sort="coordinate"):
    """The file, and the place of each record (its block's first byte)."""
    text = f"@HD\tVN:1.6\tSO:{sort}\n".encode()
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(REFS))
    for name, k in REFS:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", k)
    starts = []
    for q, f, r, p, m, c, mp, s in rows:
        starts.append(len(data))
        codes = [BASES.index(x) for x in s] + [0]
        body = struct.pack("<iiBBHHHiiii", r, p, len(q) + 1, m, 0, len(c), f, len(s), r, mp, 0) + q.encode() + b"\0"
        body += b"".join(struct.pack("<I", k << 4 | OPS.index(op)) for k, op in c) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(s), 2)) + b"\xff" * len(s)
        data += struct.pack("<i", len(body)) + body
    out, at = b"", []
    for i in range(0, len(data), size):
        at.append(len(out))
        out += block(data[i : i + size])
    path.write_bytes(out + block(b""))
    return [at[x // size] for x in starts]


def rows_of(df, columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("alignments"), records(400)
    write_text(rows, folder / "a.sam")
    at = write_binary(rows, folder / "a.bam", 700)
    write_binary(rows, folder / "wide.bam", 60000)
    return folder, rows, at


@pytest.mark.parametrize("split", [150, 1000, 7777, 1 << 30])
def test_same_rows_as_text_however_split(spark, files, split):
    folder, rows, _ = files
    text = formats.read_sam(spark, str(folder / "a.sam"), "TGS", "s", letters=False).withColumn("seq", F.when(F.col("seq") != "*", F.col("seq")).otherwise(""))
    found = bam.read_bam(spark, str(folder / "a.bam"), "TGS", "s", split=split)
    assert rows_of(found, COLUMNS) == rows_of(text, COLUMNS)
    assert [r.qname for r in found.orderBy("order").collect()] == [r[0] for r in rows]
    assert found.rdd.getNumPartitions() == -(-(folder / "a.bam").stat().st_size // split)


def test_long_blocks_batches_and_records_over_blocks(spark, files):
    folder, rows, _ = files
    assert bam.read_bam(spark, str(folder / "wide.bam"), "NGS", split=5000).count() == len(rows)
    whole = bam.Range(str(folder / "a.bam"), 0, 1 << 30)
    small = list(bam._owned(whole, None, True, 900))
    assert len(small) > 20 and [q for b in small for q in b.column("qname").to_pylist()] == [r[0] for r in rows]


def test_regions_columns_and_index(spark, files, tmp_path):
    folder, rows, at = files
    region = ("Chr02", 500, 900)
    whole = bam.read_bam(spark, str(folder / "a.bam"), "TGS", split=1000).where("chrom = 'Chr02' and rs < 900 and re > 500")
    part = bam.read_bam(spark, str(folder / "a.bam"), "TGS", region=region, bases=False, split=1000)
    lean = [c for c in COLUMNS if c != "seq"]
    assert "seq" not in part.columns and rows_of(part, lean) == rows_of(whole, lean) and part.count() > 3
    copy = tmp_path / "b.bam"
    copy.write_bytes((folder / "a.bam").read_bytes())
    index = b"BAI\x01" + struct.pack("<i", 2)
    for ref in (0, 1):
        windows = [[a for a, r in zip(at, rows) if r[2] == ref and r[3] + sum(k for k, op in r[5] if op in "MDN=X") > w << 14] for w in range(5 if ref == 0 else 1)]
        index += struct.pack("<iIi", 1, 4681, 1) + struct.pack("<QQ", 0, 0) + struct.pack("<i", len(windows)) + b"".join(struct.pack("<Q", min(w, default=0) << 16) for w in windows)
    (tmp_path / "b.bam.bai").write_bytes(index)
    found = bam.read_bam(spark, str(copy), "TGS", region=region, split=1000)
    assert rows_of(found, COLUMNS) == rows_of(whole, COLUMNS) and found.rdd.getNumPartitions() < part.rdd.getNumPartitions()
    late = ("Chr01", 34000, 34500)
    assert rows_of(bam.read_bam(spark, str(copy), "TGS", region=late, split=1000), lean) == rows_of(bam.read_bam(spark, str(folder / "a.bam"), "TGS", region=late), lean)
    assert bam.read_bam(spark, str(copy), "TGS", region=("none", 0, 10)).count() == 0


def test_folders_sizes_and_broken_files(spark, files, tmp_path):
    folder, rows, _ = files
    assert bam.read_bam(spark, str(folder), "NGS").count() == 2 * len(rows)
    assert [tuple(r) for r in bam.bam_sizes(spark, str(folder / "a.bam")).collect()] == REFS
    write_binary([], tmp_path / "none.bam", 100)
    assert bam.read_bam(spark, str(tmp_path / "none.bam"), "NGS", split=50).count() == 0
    (tmp_path / "bad.bam").write_bytes(block(b"BAD\x01" + b"\0" * 20))
    with pytest.raises(Exception, match="no binary alignment"):
        bam.read_bam(spark, str(tmp_path / "bad.bam"), "NGS").count()
    with pytest.raises(ValueError):
        bam.read_bam(spark, str(folder / "a.bam"), "XYZ")


def test_flags_of_text_files(spark, tmp_path):
    flags = ["4", "0", "16", "1", "2", "8", "77", "pPr1", "s"]
    (tmp_path / "f.sam").write_text("".join(f"r{i}\t{f}\tc\t{0 if f == '4' else 5}\t9\t{'*' if f == '4' else '4M'}\t=\t0\t0\tACGT\t*\n" for i, f in enumerate(flags)))
    rows = formats.read_sam(spark, str(tmp_path / "f.sam"), "NGS").orderBy("order").collect()
    assert [r.flag for r in rows] == [4, 0, 16, 1, 2, 8, 77, 83, 256]
    assert (rows[0].rs, rows[0].re, rows[0].mate_start) == (None, None, None) and (rows[1].rs, rows[1].re) == (4, 8)
    lettered = formats.read_sam(spark, str(tmp_path / "f.sam"), "NGS", letters=True).orderBy("order").collect()
    assert [r.flag for r in lettered][3:5] == [64, 128]
