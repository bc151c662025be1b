"""Indexed sequences as a Spark data source: chunks are read by the byte ranges that the index gives.

The index (``.fai`` beside the file) has for each sequence its name, length, first byte, and the bases and bytes of a line.
A chunk is a run of whole lines or parts of them, so no task ever holds more than ``split`` bytes of the file, however
long a chromosome is. A region (chrom, start, end) reads the chunks it touches only.

The rows are those of read_fasta, which reads files without an index. An empty sequence is one empty chunk; an index that
points beyond its file is an error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import is_file, opened
from .formats import read_fasta

CHUNK = 1 << 16
SPLIT = 16 << 20


@dataclass(frozen=True)
class Sequence:
    name: str
    length: int
    offset: int
    bases: int
    width: int

    def byte(self, pos: int) -> int:
        """Where in the file a base stands."""
        return self.offset + pos // self.bases * self.width + pos % self.bases if self.bases else self.offset


@dataclass
class Chunks(InputPartition):
    sequence: Sequence
    first: int
    end: int


def index(path: str) -> list[Sequence]:
    """The sequences of the index beside a file, in its order."""
    system, name = opened(path + ".fai")
    rows = (line.split("\t") for line in system.open_input_file(name).read().decode().splitlines() if line)
    return [Sequence(r[0], *map(int, r[1:5])) for r in rows]


class GenomeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk, self.split = options["path"], int(options.get("chunk", CHUNK)), int(options.get("split", SPLIT))
        self.region = (options["chrom"], int(options["start"]), int(options["end"])) if "chrom" in options else None

    def partitions(self) -> list[Chunks]:
        found, each = [], max(1, self.split // self.chunk)
        for s in index(self.path):
            first, end = 0, max(1, -(-s.length // self.chunk))
            if self.region:
                chrom, low, high = self.region
                first, end = (max(first, low // self.chunk), min(end, -(-high // self.chunk))) if s.name == chrom else (0, 0)
            found += [Chunks(s, at, min(at + each, end)) for at in range(first, end, each)]
        return found

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        system, name = opened(self.path)
        s = partition.sequence
        with system.open_input_file(name) as file:
            for number in range(partition.first, partition.end):
                low, high = number * self.chunk, min((number + 1) * self.chunk, s.length)
                text = file.read_at(s.byte(high - 1) + 1 - s.byte(low), s.byte(low)).replace(b"\n", b"").replace(b"\r", b"") if high > low else b""
                if len(text) != high - low:
                    raise ValueError(f"{self.path} and its index differ at {s.name}")
                yield pa.RecordBatch.from_pydict({"chrom": [s.name], "chunk_no": pa.array([number], pa.int64()), "seq": [text.decode()]})


class GenomeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "genome"

    def schema(self) -> str:
        return "chrom string, chunk_no long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return GenomeReader(dict(self.options))


def read_genome(spark: SparkSession, path: str, chunk: int = CHUNK, region: tuple[str, int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """chrom, chunk_no, seq: by the index where there is one, else by records; of a region, the chunks that it touches."""
    system, name = opened(path + ".fai")
    if not is_file(system, name):
        found = read_fasta(spark, path, chunk)
        return found.where((found.chrom == region[0]) & (found.chunk_no >= region[1] // chunk) & (found.chunk_no * chunk < region[2])) if region else found
    spark.dataSource.register(GenomeSource)
    options = {"chunk": str(chunk), "split": str(split)}
    if region:
        options |= {"chrom": region[0], "start": str(region[1]), "end": str(region[2])}
    return spark.read.format("genome").options(**options).load(path)
