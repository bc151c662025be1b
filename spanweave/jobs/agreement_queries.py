"""Queries on introns that short and long reads place differently: decisions by letters and votes, introns, moved reads.

The genome's letters come from the parts' keys; reads of odd lines are short, of even ones long and placed a few bases
apart; some of both have the bases that the other border would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..sources.formats import subsequences
from ..storage import cut
from .tables import ALN, aln, table

SITE = ["chrom", "strand"]
HEX, LETTERS, CHUNK = "0123456789abcdef", "AAGGTTCCAAAGTTAC", 128


def _genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk of 128 letters for each part, on three chromosomes."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*(F.lit(f"Chr{c}") for c in "ANR"))).alias("chrom"))
    text = F.concat(*(F.md5(F.concat("chrom", F.col("p_partkey").cast("string"), F.lit(f":{i}")).cast("binary")) for i in range(4)))
    return rows.select("chrom", F.col("p_partkey").alias("chunk_no"), F.translate(text, HEX, LETTERS).alias("seq"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with start and end of their intron, and whether they are long."""
    rows = aln(spark, sf_dir).withColumn("long", F.col("fl") % 2 == 0)
    shift = F.expr("(donor div 100 + sample % 4) % 5 - 2 + if(fl = 6, 1, 0)")
    off = F.when(F.col("long"), shift).otherwise(0)
    return rows.withColumn("start", F.col("donor") + off).withColumn("end", F.col("acceptor") + off)


def _with_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, chrom, strand, rs, blocks, cigar, seq, long: eight bases on both sides of the intron are real."""
    rows = _placed(spark, sf_dir)
    places = rows.select("chrom", F.explode(F.array("start", "end")).alias("p")).distinct()
    ranges = places.select(F.concat_ws("\t", "chrom", "p").alias("id"), "chrom", (F.col("p") - 8).alias("start"), (F.col("p") + 8).alias("end"))
    around = cut(subsequences(ranges, _genome(spark, sf_dir), CHUNK).select("chrom", (F.col("start") + 8).alias("p"), "seq"), "letters-around")
    for side in ("start", "end"):
        rows = rows.join(around.select("chrom", F.col("p").alias(side), F.col("seq").alias(f"{side}_seq")), ["chrom", side])
    odd = F.expr("cast(substr(name, 2) as bigint) % 4 < (donor div if(long, 200, 100)) % 5")
    before = F.when(odd, F.substring("end_seq", 1, 8)).otherwise(F.substring("start_seq", 1, 8))
    after = F.when(odd, F.substring("start_seq", 9, 8)).otherwise(F.substring("end_seq", 9, 8))
    fill = lambda n: F.repeat(F.lit("N"), n.cast("int"))
    seq = F.concat(fill(F.col("start") - F.col("rs") - 8), before, after, fill(F.col("re") - F.col("end") - 8))
    op = lambda code, n: F.struct(F.lit(code).alias("op"), n.cast("long").alias("len"))
    cigar = F.array(op(0, F.col("start") - F.col("rs")), op(3, F.col("end") - F.col("start")), op(0, F.col("re") - F.col("end")))
    pair = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    read = F.xxhash64("chrom", "strand", "rs", "start", "end", "re").alias("read")  # equal reads move alike
    found = rows.select(read, "chrom", "strand", "rs", F.array(pair("rs", "start"), pair("end", "re")).alias("blocks"), cigar.alias("cigar"), seq.alias("seq"), "long", F.col("start").alias("was"))
    return cut(found, "reads-with-bases")


def _introns(spark: SparkSession, sf_dir: str, long: bool) -> DataFrame:
    rows = _placed(spark, sf_dir).where(F.col("long") == long).groupBy(*SITE, "start", "end").agg(F.count(F.lit(1)).alias("support"))
    return rows.withColumn("spliced", F.lit(False) if long else F.col("support") > 5)


def _decided(spark: SparkSession, sf_dir: str, reads: DataFrame | None = None) -> DataFrame:
    reads = _with_bases(spark, sf_dir) if reads is None else reads
    return ag.decisions(_introns(spark, sf_dir, False), _introns(spark, sf_dir, True), reads.where("not long"), reads.where("long"), _genome(spark, sf_dir), CHUNK)


def q_intron_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a short and a long intron with the rule that settles it."""
    return _decided(spark, sf_dir)


def _text(i: int) -> str:
    return f"md5(c || CAST(p_partkey AS VARCHAR) || ':{i}')"


def _priority(start: str, end: str) -> str:
    first, last = f"substr(g, {start} + 1, 2)", f"substr(g, {end} - 1, 2)"
    turned = [f"reverse(translate({x}, 'ACGT', 'TGCA'))" for x in (last, first)]
    return f"CASE (CASE WHEN strand = '-' THEN {' || '.join(turned)} ELSE {first} || {last} END) WHEN 'GTAG' THEN 3 WHEN 'GCAG' THEN 2 WHEN 'ATAC' THEN 1 ELSE 0 END"


def _votes_sql(side: str) -> str:
    at_end = "s_start < l_start" if side == "s" else "s_start > l_start"
    first, last = f"CASE WHEN {at_end} THEN least(s_end, l_end) ELSE least(s_start, l_start) END", f"CASE WHEN {at_end} THEN greatest(s_end, l_end) ELSE greatest(s_start, l_start) END"
    bases = f"substr(seq, ({first}) - rs + 1 - CASE WHEN {at_end} THEN p.{side}_end - p.{side}_start ELSE 0 END, ({last}) - ({first}))"
    return f"""{side}v AS (SELECT p.chrom, p.strand, s_start, s_end, l_start, l_end, count(*) AS {side}_reads, sum(CASE WHEN {at_end} THEN {bases} = low AND {bases} <> high ELSE {bases} <> low AND {bases} = high END::INT) AS {side}_votes
 FROM apart p JOIN b ON b.chrom = p.chrom AND b.start = p.{side}_start AND b.stop = p.{side}_end AND {"NOT long" if side == "s" else "long AND b.strand = p.strand"} GROUP BY 1, 2, 3, 4, 5, 6)"""


_DECIDED = f"""WITH {ALN}, genome AS (SELECT c AS chrom, string_agg(translate({" || ".join(map(_text, range(4)))}, '{HEX}', '{LETTERS}'), '' ORDER BY p_partkey) AS g FROM part, (VALUES ('ChrA'), ('ChrN'), ('ChrR')) t(c) GROUP BY 1),
q AS (SELECT chrom, strand, rs, re, fl, name, donor, fl % 2 = 0 AS long, donor + o AS start, acceptor + o AS stop FROM (SELECT *, CASE WHEN fl % 2 = 0 THEN (donor // 100 + sample % 4) % 5 - 2 + CASE WHEN fl = 6 THEN 1 ELSE 0 END ELSE 0 END AS o FROM aln)),
b AS (SELECT *, repeat('N', start - rs - 8) || CASE WHEN odd THEN substr(g, stop - 7, 8) ELSE substr(g, start - 7, 8) END || CASE WHEN odd THEN substr(g, start + 1, 8) ELSE substr(g, stop + 1, 8) END || repeat('N', re - stop - 8) AS seq
 FROM (SELECT *, CAST(substr(name, 2) AS BIGINT) % 4 < (donor // CASE WHEN long THEN 200 ELSE 100 END) % 5 AS odd FROM q JOIN genome USING (chrom))),
i AS (SELECT chrom, strand, start, stop, long, count(*) AS support FROM q GROUP BY ALL),
p AS (SELECT s.chrom, s.strand, s.start AS s_start, s.stop AS s_end, l.start AS l_start, l.stop AS l_end FROM i s JOIN i l ON NOT s.long AND l.long AND s.chrom = l.chrom AND s.strand = l.strand AND s.stop - s.start = l.stop - l.start AND abs(s.start - l.start) < 20 AND s.start < l.stop AND l.start < s.stop),
m AS (SELECT *, bool_or(s_start = l_start) OVER (PARTITION BY chrom, strand, s_start, s_end) AS settled FROM p),
t AS (SELECT m.*, substr(g, s_start - 19, 20 + l_start - s_start) || substr(g, l_end + 1, s_end + 20 - l_end) = substr(g, s_start - 19, 20) || substr(g, s_end + 1, 20) AS same,
 substr(g, least(s_start, l_start) + 1, abs(s_start - l_start)) AS low, substr(g, least(s_end, l_end) + 1, abs(s_end - l_end)) AS high, {_priority("s_start", "s_end")} AS s_rank, {_priority("l_start", "l_end")} AS l_rank
 FROM m JOIN genome USING (chrom) WHERE NOT settled),
apart AS (SELECT * FROM t WHERE NOT same), {_votes_sql("s")}, {_votes_sql("l")},
voted AS (SELECT chrom, strand, s_start, s_end, l_start, l_end, sv > 0 AND coalesce(sv / nullif(sr, 0) > 0.5, false) AND (lv = 0 OR coalesce(lv / nullif(lr, 0) < 0.5, false)) AS drop_short,
 lv > 0 AND coalesce(lv / nullif(sr, 0) > 0.5, false) AND (sv = 0 OR coalesce(sv / nullif(lr, 0) < 0.5, false)) AS drop_long
 FROM (SELECT chrom, strand, s_start, s_end, l_start, l_end, coalesce(s_reads, 0) AS sr, coalesce(s_votes, 0) AS sv, coalesce(l_reads, 0) AS lr, coalesce(l_votes, 0) AS lv FROM apart LEFT JOIN sv USING (chrom, strand, s_start, s_end, l_start, l_end) LEFT JOIN lv USING (chrom, strand, s_start, s_end, l_start, l_end))),
z AS (SELECT t.*, EXISTS (SELECT 1 FROM voted v WHERE (v.drop_short OR v.drop_long) AND (v.chrom, v.strand, v.s_start, v.s_end) = (t.chrom, t.strand, t.s_start, t.s_end)) AS fixed FROM t WHERE same),
y AS (SELECT *, max(l_rank) OVER w AS top FROM z WINDOW w AS (PARTITION BY chrom, strand, s_start, s_end)),
x AS (SELECT *, sum((l_rank = top)::INT) OVER w AS n FROM y WINDOW w AS (PARTITION BY chrom, strand, s_start, s_end)),
d AS (SELECT chrom, strand, s_start, s_end, l_start, l_end, 'same' AS rule, false AS drop_short, false AS drop_long, false AS heir FROM m WHERE settled
 UNION ALL SELECT chrom, strand, s_start, s_end, l_start, l_end, CASE WHEN drop_short OR drop_long THEN 'votes' ELSE 'open' END, drop_short, drop_long, false FROM voted
 UNION ALL SELECT chrom, strand, s_start, s_end, l_start, l_end, CASE WHEN fixed THEN 'open' ELSE 'letters' END, NOT fixed AND top >= s_rank, NOT fixed AND (top < s_rank OR l_rank < top), NOT fixed AND top >= s_rank AND l_rank = top AND n = 1 FROM x)"""
Q_INTRON_DECISIONS = f"{_DECIDED} SELECT * FROM d"


def q_agreed_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The introns that are left, with their evidence."""
    return ag.agreed_introns(_introns(spark, sf_dir, False), _introns(spark, sf_dir, True), _decided(spark, sf_dir))


_LEFT = """sk AS (SELECT chrom, strand, start, stop, support, support > 5 AS spliced FROM i WHERE NOT long AND NOT EXISTS (SELECT 1 FROM d WHERE drop_short AND (d.chrom, d.strand, d.s_start, d.s_end) = (i.chrom, i.strand, i.start, i.stop))),
gift AS (SELECT d.chrom, d.strand, l_start AS start, l_end AS stop, max(row(support, support > 5)) AS given FROM d JOIN i ON heir AND NOT long AND (d.chrom, d.strand, d.s_start, d.s_end) = (i.chrom, i.strand, i.start, i.stop) GROUP BY 1, 2, 3, 4),
lk AS (SELECT chrom, strand, start, stop, coalesce(given[1], support) AS support, coalesce(given[2], false) AS spliced FROM i LEFT JOIN gift USING (chrom, strand, start, stop) WHERE long AND NOT EXISTS (SELECT 1 FROM d WHERE drop_long AND (d.chrom, d.strand, d.l_start, d.l_end) = (i.chrom, i.strand, i.start, i.stop)))"""
Q_AGREED_INTRONS = f'{_DECIDED}, {_LEFT} SELECT chrom, strand, start, stop AS "end", support, spliced FROM sk UNION ALL SELECT chrom, strand, start, stop, support, spliced FROM lk ANTI JOIN sk USING (chrom, strand, start, stop)'


def q_union_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a genome all introns of both sides, the short ones first."""
    return ag.agreed_introns(_introns(spark, sf_dir, False), _introns(spark, sf_dir, True))


Q_UNION_INTRONS = f'{_DECIDED} SELECT chrom, strand, start, stop AS "end", support, NOT long AND support > 5 AS spliced FROM i WHERE NOT long OR NOT EXISTS (SELECT 1 FROM i o WHERE NOT o.long AND (o.chrom, o.strand, o.start, o.stop) = (i.chrom, i.strand, i.start, i.stop))'


def q_moved_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long reads of which a vote has moved the intron, at their new place."""
    reads = _with_bases(spark, sf_dir)
    decided = _decided(spark, sf_dir, reads).where("rule = 'votes'")
    moved = ag.agreed_reads(reads.where("long"), decided).select("chrom", "was", F.col("blocks")[0]["end"].alias("start"), F.col("blocks")[1]["start"].alias("end"))
    return moved.where("was <> start").groupBy("chrom", "was", "start", "end").agg(F.count(F.lit(1)).alias("n"))


Q_MOVED_READS = f"""{_DECIDED}, w AS (SELECT chrom, strand, l_start AS start, l_end AS stop, arg_max(s_start, s_start) AS to_start, arg_max(s_end, s_start) AS to_end, count(*) AS k FROM d WHERE rule = 'votes' AND drop_long GROUP BY 1, 2, 3, 4)
SELECT chrom, start AS was, to_start AS start, to_end AS "end", count(*) AS n FROM b JOIN w USING (chrom, strand, start, stop) WHERE long AND rs < to_start AND to_end < re AND start <> to_start GROUP BY ALL"""

QUERIES = [q_intron_decisions, q_agreed_introns, q_union_introns, q_moved_reads]
SQL = {f.__name__: globals()[f.__name__.upper()] for f in QUERIES}
