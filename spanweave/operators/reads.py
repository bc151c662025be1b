"""Reads: cleaning, library orientation, blocks, introns, junction evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings

SECONDARY, REVERSE, MATE_REVERSE, READ1, READ2 = 256, 16, 32, 64, 128


def has_flag(flag: str, bit: int) -> Column:
    return F.col(flag).bitwiseAND(F.lit(bit)) != 0


def clean_reads(df: DataFrame, paired: bool = True, settings: Settings = DEFAULT) -> DataFrame:
    """Primary reads without a huge gap; read and mate on opposite strands where paired."""
    kept = df.where(~has_flag("flag", SECONDARY) & F.col("rs").isNotNull() & F.col("re").isNotNull() & (F.col("re") - F.col("rs") - F.col("qlen") < settings.max_intron))
    return kept.where(has_flag("flag", REVERSE) != has_flag("flag", MATE_REVERSE)) if paired else kept


def library_flip(df: DataFrame, read: int) -> DataFrame:
    """Flip both strand bits, its own and its mate's, of read 1 or of read 2; the other read stays.

    The stranded-library rules name the read to flip: 2 where read 1 points along the transcript,
    1 where read 2 does. Whether read and mate differ in strand does not change."""
    flag = F.col("flag")
    return df.withColumn("flag", F.when(has_flag("flag", READ1 if read == 1 else READ2), flag.bitwiseXOR(F.lit(REVERSE | MATE_REVERSE))).otherwise(flag))


def full_length_count(name: str) -> Column:
    """The count after /f in names like c1/f12p3/900; 1 where there is none."""
    return F.coalesce(F.regexp_extract(name, r"[+\w]+/f(\d+)p\d+/\d+", 1).try_cast("long"), F.lit(1))


def introns(blocks: Column) -> Column:
    """Gaps between consecutive blocks (arrays of start, end)."""
    return F.when(F.size(blocks) < 2, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(blocks) - 2), lambda i: F.struct(blocks[i]["end"].cast("long").alias("start"), blocks[i + 1]["start"].cast("long").alias("end"))))


def blocks_to_cigar(blocks: Column) -> Column:
    """Blocks to a text of M and N runs."""
    part = lambda b, i: F.concat(F.when(i > 0, F.concat((b["start"] - blocks[i - 1]["end"]).cast("string"), F.lit("N"))).otherwise(F.lit("")), (b["end"] - b["start"]).cast("string"), F.lit("M"))
    return F.array_join(F.transform(blocks, part), "")


def cigar_blocks(cigar: Column, start: Column) -> Column:
    """Aligned blocks of an array of (op, len), ops coded 0 M, 1 I, 2 D, 3 N, 4 S, 5 H, 6 P."""
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"))

    def step(acc, c):
        to = acc["at"] + c["len"]
        return F.when(c["op"] == 0, F.struct(to.alias("at"), F.concat(acc["blocks"], F.array(F.struct(acc["at"].alias("start"), to.alias("end")))).alias("blocks"))).when(c["op"].isin(2, 3), F.struct(to.alias("at"), acc["blocks"].alias("blocks"))).otherwise(acc)

    return F.aggregate(cigar, zero, step)["blocks"]


def junctions(cigar: Column, start: Column, flank: int = DEFAULT.junction_flank) -> Column:
    """Gaps (op 3) whose both sides have ``flank`` matched bases before any op but match or gap
    is met; a side that ends sooner is accepted. Returns an array of start, end."""
    steps = F.transform(cigar, lambda c, i: F.struct(c["op"].alias("op"), c["len"].alias("len"), (start + F.aggregate(F.slice(cigar, 1, i), F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin(0, 2, 3), x["len"]).otherwise(0))).alias("at"), i.alias("i")))

    def side(part):  # walk outwards: matched bases so far, and whether another op came too early
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("ok"))
        step = lambda a, c: F.when((a["n"] >= flank) | ~a["ok"], a).otherwise(F.struct((a["n"] + F.when(c["op"] == 0, c["len"]).otherwise(0)).alias("n"), c["op"].isin(0, 3).alias("ok")))
        return F.aggregate(part, zero, step)["ok"]

    good = F.filter(steps, lambda s: (s["op"] == 3) & (s["i"] > 0) & (s["i"] < F.size(cigar) - 1) & side(F.reverse(F.slice(cigar, 1, s["i"]))) & side(F.slice(cigar, s["i"] + 2, F.size(cigar))))
    return F.transform(good, lambda s: F.struct(s["at"].alias("start"), (s["at"] + s["len"]).alias("end")))


def junction_support(df: DataFrame, by: list[str], paired_name: str | None = None) -> DataFrame:
    """Reads behind each donor and acceptor; each name counts once where a name is given."""
    n = F.countDistinct(paired_name) if paired_name else F.count(F.lit(1))
    return df.groupBy(*by, "donor", "acceptor").agg(n.alias("support"))


def filter_pass(edges: DataFrame, by: list[str], least_edge: int, least_node: int, ratio: float) -> DataFrame:
    """One simultaneous pass over junction edges: support, node degree, and share of each node."""
    kept = edges.where(F.col("support") >= least_edge)
    for node in ("donor", "acceptor"):
        degree = kept.groupBy(*by, node).agg(F.sum("support").alias(f"{node}_degree"))
        kept = kept.join(degree, [*by, node])
    share = F.col("support") / F.greatest("donor_degree", "acceptor_degree")
    return kept.where((F.col("donor_degree") >= least_node) & (F.col("acceptor_degree") >= least_node) & (share >= ratio)).drop("donor_degree", "acceptor_degree")


def splice_priority(left: Column, right: Column) -> Column:
    """3, 2, 1 for the usual splice-site pairs, otherwise 0."""
    pair = F.concat(F.upper(left), F.lit("-"), F.upper(right))
    return F.when(pair == "GT-AG", 3).when(pair == "GC-AG", 2).when(pair == "AT-AC", 1).otherwise(0)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), "ACGTN", "TGCAN"))
