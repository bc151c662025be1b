"""Binary alignments as a Spark data source: partitions are byte ranges of the compressed file.

The file is a chain of compressed blocks, records may lie across blocks. A partition owns the blocks that start in its
range and the records that start in these: it looks for the first block (a header whose size leads to
another one), then for the first record (several in a row with fields that fit), and reads on
until its last record is whole. Fields are gathered from the decompressed bytes with numpy, a batch of blocks at a time.

Files are opened through Arrow's file systems, so that a path may be local or a store's address; a folder gives
all its ``.bam`` files. A region (chrom, start, end) is pushed down: other records are left out before
their names, operations and bases are decoded, a sorted file is read no further than the region, and where an
index file lies beside it (``.bai``), ranges before the region get no partition. ``bases=False`` leaves bases undecoded.

Memory: a batch of ``BATCH`` decompressed bytes, or one record. Unplaced reads have null chrom and rs. Operations of over 65,535 are
as the file's fields say (a placeholder). A file without records gives none; a broken one is an error."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import formats
from .files import is_file, opened

SPLIT = 32 << 20
BATCH = 8 << 20
#: The magic of a block, of a file and of an index, the letters of four-bit bases, and the header of a block.
BLOCK, MAGIC, INDEX = b"\x1f\x8b\x08\x04", b"BAM\x01", b"BAI\x01"
BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)
HEAD = 18
#: Records in a row that must fit for the first of them to count as one.
CHAIN = 5
FIXED = struct.Struct("<iiiBBHHHiiii")
CIGAR = "array<struct<op:int,len:bigint>>"


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


def _files(path: str) -> list[tuple[str, int]]:
    system, name = opened(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(name)) if i.path.endswith(".bam")]
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return [(prefix + i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


def _block_size(head: bytes) -> int | None:
    """The size of the block that starts with head, or None where none does."""
    if len(head) < HEAD or head[:4] != BLOCK or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


class Blocks:
    """The blocks of a file from a position on, as (start, decompressed bytes)."""

    def __init__(self, path: str, at: int = 0):
        system, name = opened(path)
        self.file, self.at = system.open_input_file(name), at
        self.size = self.file.size()

    def seek_block(self, low: int, high: int) -> bool:
        """Go to the first block that starts in [low, high); False where none does."""
        window = self.file.read_at(min(high - low + (1 << 17), self.size - low), low) if low < self.size else b""
        place = window.find(BLOCK)
        while 0 <= place < high - low:
            size = _block_size(window[place : place + HEAD])
            if size and (low + place + size == self.size or _block_size(window[place + size : place + size + HEAD])):
                self.at = low + place
                return True
            place = window.find(BLOCK, place + 1)
        return False

    def next(self) -> tuple[int, bytes] | None:
        if self.at >= self.size:
            return None
        head = self.file.read_at(min(1 << 16, self.size - self.at), self.at)
        size = _block_size(head)
        if size is None or size > len(head):
            raise ValueError(f"no block at byte {self.at}")
        start, self.at = self.at, self.at + size
        return start, zlib.decompress(head[HEAD : size - 8], -15)


def header(path: str) -> tuple[list[tuple[str, int]], str, tuple[int, int]]:
    """Names and lengths of the sequences, the header's text, and where the first record starts (block, place in it)."""
    blocks, data, starts = Blocks(path), b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            found = blocks.next()
            if found is None:
                raise ValueError(f"{path} ends within its header")
            starts.append((len(data), found[0]))
            data += found[1]

    need(12)
    if data[:4] != MAGIC:
        raise ValueError(f"{path} is no binary alignment file")
    (length,) = struct.unpack_from("<i", data, 4)
    need(12 + length)
    text, at = data[8 : 8 + length].split(b"\0")[0].decode(), 12 + length
    refs = []
    for _ in range(struct.unpack_from("<i", data, 8 + length)[0]):
        need(at + 4)
        (n,) = struct.unpack_from("<i", data, at)
        need(at + 8 + n)
        refs.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    place, block = max(x for x in starts if x[0] <= at)
    return refs, text, (block, at - place)


def _fits(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record at a place ends if its fields fit, 0 if they don't, None if more bytes are needed."""
    if at + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_ops, _, n_bases, mate, mate_pos, _ = FIXED.unpack_from(data, at)
    if not (32 <= size and n_name and -1 <= ref < len(lengths) and -1 <= mate < len(lengths) and n_bases >= 0):
        return 0
    if pos < -1 or mate_pos < -1 or (ref >= 0 and pos >= lengths[ref]) or 32 + n_name + 4 * n_ops + (n_bases + 1) // 2 + n_bases > size:
        return 0
    if at + 36 + n_name > len(data):
        return None
    name = data[at + 36 : at + 36 + n_name]
    return at + 4 + size if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def _first_record(data: bytes, lengths: list[int], limit: int, ended: bool) -> int | None:
    """The first place before limit where a chain of records starts; limit if there is none, None if more bytes are needed."""
    for at in range(limit):
        end = at
        for _ in range(CHAIN):
            if ended and end == len(data):
                break
            found = _fits(data, end, lengths)
            if found is None and not ended:
                return None
            if not found or (ended and found > len(data)):
                end = 0
                break
            end = found
        if end:
            return at
    return limit


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes of all runs, one after another, and the runs' bounds in them."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1]), bounds


def _texts(letters: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(letters.astype(np.uint8).tobytes()))


class Decoder:
    """Batches of rows from decompressed bytes and the places of records in them."""

    def __init__(self, refs: list[tuple[str, int]], region: tuple[str, int, int] | None, bases: bool):
        self.names, self.region, self.bases = [n for n, _ in refs], region, bases
        self.ref = self.names.index(region[0]) if region and region[0] in self.names else -2

    def beyond(self, data: bytes, at: int) -> bool:
        """Whether the record of a sorted file, and so all after it, lies behind the region."""
        ref, pos = struct.unpack_from("<ii", data, at + 4)
        return self.region is not None and (ref == -1 or ref > self.ref or (ref == self.ref and pos >= self.region[2]))

    def rows(self, data: bytes, starts: list[int], order: np.ndarray) -> pa.RecordBatch:
        raw, at = np.frombuffer(data, np.uint8), np.asarray(starts, np.int64)

        def number(offset: int, kind: str) -> np.ndarray:
            width = np.dtype(kind).itemsize
            return raw[at[:, None] + offset + np.arange(width)].view(kind).ravel() if len(at) else np.zeros(0, kind)

        if self.region:
            keep = (number(4, "<i4") == self.ref) & (number(8, "<i4") < self.region[2])
            at, order = at[keep], order[keep]
        ref, pos, mate = number(4, "<i4"), number(8, "<i4").astype(np.int64), number(28, "<i4").astype(np.int64)
        n_name, n_ops, n_bases = number(12, "u1").astype(np.int64), number(16, "<u2").astype(np.int64), number(20, "<i4").astype(np.int64)
        places, bounds = _ragged(at + 36, n_name - 1)
        names = _texts(raw[places], bounds)
        places, bounds = _ragged(at + 36 + n_name, 4 * n_ops)
        words = raw[places].view("<u4")
        codes = np.where((words & 15) > 6, 0, words & 15).astype(np.int32)
        ops = pa.StructArray.from_arrays([pa.array(codes), pa.array((words >> 4).astype(np.int64))], ["op", "len"])
        cigar = pa.ListArray.from_arrays(pa.array((bounds // 4).astype(np.int32)), ops)
        chrom = pa.DictionaryArray.from_arrays(pa.array(ref, mask=ref < 0), pa.array(self.names, pa.string())).cast(pa.string())
        columns = [pa.array(order), names, pa.array(number(18, "<u2").astype(np.int32)), chrom, pa.array(pos, mask=pos < 0), pa.array(number(13, "u1").astype(np.int32)), cigar, pa.array(mate, mask=mate < 0)]
        if self.bases:
            places, bounds = _ragged(at + 36 + n_name + 4 * n_ops, (n_bases + 1) // 2)
            both = np.stack([BASES[raw[places] >> 4], BASES[raw[places] & 15]], axis=1).ravel()
            places, letters = _ragged(2 * bounds[:-1], n_bases)
            columns.append(_texts(both[places], letters))
        return pa.RecordBatch.from_arrays(columns, ["order", "qname", "flag", "chrom", "rs", "mapq", "cigar", "mate_start", "seq"][: len(columns)])


def _owned(part: Range, region: tuple[str, int, int] | None, bases: bool, batch: int = BATCH) -> Iterator[pa.RecordBatch]:
    """The records that start in the blocks of a range."""
    refs, text, (first_block, first_place) = header(part.path)
    lengths, decoder = [n for _, n in refs], Decoder(refs, region, bases)
    ordered = "SO:coordinate" in text.split("\n")[0]
    blocks = Blocks(part.path, first_block)
    known = part.low <= first_block < part.high
    if part.high <= first_block or not (known or blocks.seek_block(part.low, part.high)):
        return
    data, starts, owned, ended, at = b"", [], 0, False, None  # owned: how many bytes lie in blocks of this range

    def more() -> None:
        nonlocal data, owned, ended
        found = blocks.next()
        if found is None:
            ended = True
            return
        starts.append((len(data), found[0]))
        data += found[1]
        if found[0] < part.high:
            owned = len(data)

    while at is None:
        more()
        if known:
            at = first_place if len(data) >= first_place or ended else None
        elif owned < len(data) or ended:  # all own blocks are here
            at = _first_record(data, lengths, owned, ended)
        elif len(data) >= 1 << 18:
            found = _first_record(data, lengths, owned, False)
            at = found if found is not None and found < owned else None
    done = False
    while not done:
        while not ended and len(data) < at + batch and owned == len(data):
            more()
        places = []
        while at < owned or (owned == len(data) and not ended):
            if at + 4 > len(data) or at + 4 + struct.unpack_from("<i", data, at)[0] > len(data):
                if ended and at < len(data):
                    raise ValueError(f"{part.path} ends within a record")
                if ended or (places and owned == len(data) and len(data) >= batch):
                    break
                more()
                continue
            if ordered and decoder.beyond(data, at):
                done = True
                break
            places.append(at)
            at += 4 + struct.unpack_from("<i", data, at)[0]
        if places:
            bounds = np.array(starts, np.int64).reshape(-1, 2)
            block = np.searchsorted(bounds[:, 0], places, side="right") - 1
            yield decoder.rows(data, places, (bounds[block, 1] << 16) + (np.asarray(places) - bounds[block, 0]))
        done = done or at >= owned and (owned < len(data) or ended)
        gone = max((i for i, x in enumerate(starts) if x[0] <= at), default=0)
        cut = starts[gone][0] if starts else 0
        data, at, owned = data[cut:], at - cut, max(owned - cut, 0)
        starts = [(p - cut, b) for p, b in starts[gone:]]


def index_start(path: str, ref: int, start: int) -> int:
    """The first block that can hold a record over start, by the index beside the file; 0 without one."""
    system, name = opened(path)
    name = next((n for n in (f"{name}.bai", f"{name[:-4]}.bai") if is_file(system, n)), None)
    if name is None:
        return 0
    data = system.open_input_file(name).read()
    if data[:4] != INDEX:
        raise ValueError(f"{name} is no index")
    at = 8
    for i in range(struct.unpack_from("<i", data, 4)[0]):
        (n_bins,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n_bins):
            at += 8 + 16 * struct.unpack_from("<i", data, at + 4)[0]
        (n,) = struct.unpack_from("<i", data, at)
        if i == ref:
            return int(np.frombuffer(data, "<u8", n, at + 4)[min(start >> 14, n - 1)] >> 16) if n else 0
        at += 4 + 8 * n
    return 0


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        chrom = options.get("chrom")
        self.region = (chrom, int(options["start"]), int(options["end"])) if chrom else None
        self.bases = options.get("bases", "true") == "true"

    def partitions(self) -> list[Range]:
        found = []
        for path, size in _files(self.path):
            names = [n for n, _ in header(path)[0]]
            low = index_start(path, names.index(self.region[0]), self.region[1]) if self.region and self.region[0] in names else 0
            found += [Range(path, at, min(at + self.split, size)) for at in range(0, size, self.split) if at + self.split > low]
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _owned(partition, self.region, self.bases)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        bases = ", seq string" if self.options.get("bases", "true") == "true" else ""
        return f"order long, qname string, flag int, chrom string, rs long, mapq int, cigar {CIGAR}, mate_start long{bases}"

    def reader(self, schema) -> DataSourceReader:
        return BamReader(dict(self.options))


def read_bam(spark: SparkSession, path: str, kind: str, sample: str = "", region: tuple[str, int, int] | None = None, bases: bool = True, split: int = SPLIT) -> DataFrame:
    """Alignment rows as read_sam gives them (without seq where bases is off); of a region, the rows that overlap it.

    order is the record's place in its file: its block's first byte and its place in the block."""
    spark.dataSource.register(BamSource)
    options = {"split": str(split), "bases": "true" if bases else "false"}
    if region:
        options |= {"chrom": region[0], "start": str(region[1]), "end": str(region[2])}
    rows = formats.aligned(spark.read.format("bam").options(**options).load(path), kind, sample)
    return rows.where((F.col("re") > region[1]) & (F.col("rs") < region[2])) if region else rows


def bam_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of the header, in its order."""
    return spark.createDataFrame(header(_files(path)[0][0])[0], "chrom string, length long")

