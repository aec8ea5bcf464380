"""Aligned reads in BAM files: a splittable reader with a region index, and a sorted writer.

A BAM file is a row of gzip blocks of at most 64 KiB (BGZF). A split looks for the first block
that begins in it, and in that block's data for the first place where a chain of plausible
records begins; it then decodes records up to the first one that begins in a block of the next
split. Every record begins in exactly one split. With a region, the index next to the file
(.bai) names the stretches of blocks to read, and splits are made of those alone.

Records are decoded with NumPy: one pass finds where they begin, then all fixed fields are
gathered at once. Files are opened through pyarrow.fs, so any store that it reaches will do.

    spark.dataSource.register(BamSource)
    spark.read.format("bam").option("region", "chr2:1000-2000").load(folder)

Defined results: reads without a place have a null chromosome and pos -1; a file without
records gives no rows; a folder stands for the .bam files in it; a file cut short raises. A
reference of 2^31 places or more, which no record can hold, is written as pieces, references
named NAME~at0, NAME~at536870912 and so on by their first place, and is read as NAME again.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "chromosome string, pos long, aligned_len int, query_len int, mapq int, flag int, is_duplicate boolean, is_secondary boolean, is_unmapped boolean, is_qcfail boolean, name string, cigar string"
# Fixed values of the format: the empty last block, letters of alignment steps, which use up the reference and the read, bits of the flag.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
STEPS, OF_REFERENCE, OF_READ = "MIDNSHP=X", (1, 0, 1, 1, 0, 0, 0, 1, 1), (1, 1, 0, 0, 1, 0, 0, 1, 1)
UNMAPPED, SECONDARY, QCFAIL, DUPLICATE = 0x4, 0x100, 0x200, 0x400
#: Bits of a position in bins of each level of the index, from the whole reference to 16 KiB.
SHIFTS = (29, 26, 23, 20, 17, 14)
#: Bytes of records in a block, of a file in a split, and records in an Arrow batch; records that must chain where a split begins.
BLOCK_BYTES, SPLIT_BYTES, BATCH, CHAIN = 60_000, 32 << 20, 20_000, 4
#: Places that a record can hold, and places of a piece of a longer reference.
MOST, PIECE = 1 << 31, 1 << 29
FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("steps", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("length", "<i4")])


# -- blocks -------------------------------------------------------------------------------------


def block(data: bytes) -> bytes:
    """data (less than 64 KiB) as a BGZF block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(raw: bytes, at: int) -> int:
    """Bytes of the block that begins at a place of raw; 0 where none does."""
    if raw[at : at + 4] != b"\x1f\x8b\x08\x04" or len(raw) < at + 18:
        return 0
    extra = struct.unpack_from("<H", raw, at + 10)[0]
    i, stop = at + 12, at + 12 + extra
    while i + 4 <= min(stop, len(raw)):
        size = struct.unpack_from("<H", raw, i + 2)[0]
        if raw[i : i + 2] == b"BC" and size == 2 and i + 6 <= len(raw):
            return struct.unpack_from("<H", raw, i + 4)[0] + 1
        i += 4 + size
    return 0


class Blocks:
    """The blocks of an open file from a place on: (place, size, data)."""

    def __init__(self, file, size: int):
        self.file, self.size, self.read = file, size, 0

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        self.read += n
        return self.file.read(n)

    def first(self, at: int) -> int:
        """Where the first block at or after a place begins: a header whose block is followed by another, or ends the file."""
        if at == 0:
            return 0
        while at < self.size:
            raw = self._bytes(at, 1 << 17)
            i = raw.find(b"\x1f\x8b\x08\x04")
            while i >= 0:
                n = block_size(raw, i) if i + 18 <= len(raw) else 0
                follows = raw[i + n : i + n + 4] if i + n + 4 <= len(raw) else self._bytes(at + i + n, 4)
                if n and (at + i + n == self.size or follows == b"\x1f\x8b\x08\x04"):
                    return at + i
                i = raw.find(b"\x1f\x8b\x08\x04", i + 1)
            at += max(len(raw) - 3, 1)
        return self.size

    def walk(self, at: int, until: int | None = None) -> Iterator[tuple[int, int, bytes]]:
        """All blocks from a place on; what is read ahead goes little beyond until."""
        held, begin = b"", at
        while begin < self.size or held:
            n = block_size(held, 0)
            if not n or n > len(held):
                place = begin + len(held)
                ahead = 1 << 19 if until is None else min(1 << 19, max(until - place, 0) + (1 << 14))
                more = self._bytes(place, ahead) if place < self.size else b""
                if not more:
                    if held:
                        raise ValueError("the file ends inside a block")
                    return
                held += more
                if len(held) >= 18 and not block_size(held, 0):
                    raise ValueError(f"no block begins at byte {begin}")
                continue
            data = zlib.decompress(held[18 : n - 8], -15)
            if zlib.crc32(data) != struct.unpack_from("<I", held, n - 8)[0]:
                raise ValueError(f"the block at byte {begin} is damaged")
            yield begin, n, data
            held, begin = held[n:], begin + n


# -- references ---------------------------------------------------------------------------------


def pieces(references: list[tuple[str, int]]) -> list[tuple[str, int, str, int]]:
    """name, first place, name in the file and size of each reference, or of each piece of one that is too long."""
    out = []
    for n, size in references:
        out += [(n, 0, n, size)] if size < MOST else [(n, at, f"{n}~at{at}", min(PIECE, size - at)) for at in range(0, size, PIECE)]
    return out


def home_of(name: str) -> tuple[str, int]:
    """The reference, and the first place in it, of a name in a file."""
    m = re.fullmatch(r"(.+)~at(\d+)", name)
    return (m[1], int(m[2])) if m else (name, 0)


# -- records ------------------------------------------------------------------------------------


def parse_header(data: bytes) -> tuple[list[tuple[str, int]], int] | None:
    """The references (name, length) and the bytes of the header; None where data is too short."""
    try:
        if data[:4] != b"BAM\x01":
            raise ValueError("not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        n = struct.unpack_from("<i", data, at)[0]
        at, out = at + 4, []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            length = struct.unpack_from("<i", data, at + 4 + size)[0]
            out.append((data[at + 4 : at + 3 + size].decode(), length))
            at += 8 + size
        return (out, at) if at <= len(data) else None
    except struct.error:
        return None


def read_header(blocks: Blocks) -> tuple[list[tuple[str, int]], int, int]:
    """The references, and where records begin: block, and place in its data."""
    data, before = b"", 0
    for at, n, more in blocks.walk(0, 0):
        before, data = len(data), data + more
        known = parse_header(data)
        if known:
            refs, size = known
            return (refs, at, size - before) if size < len(data) else (refs, at + n, 0)
    raise ValueError("the header does not end")


def plausible(data: bytes, at: int, references: int) -> int:
    """The place after the record that seems to begin at a place; 0 where none can."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, name, _, _, steps, _, bases, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    least = 32 + name + 4 * steps + (bases + 1) // 2 + bases
    fits = name > 0 and bases >= 0 and least <= size < 1 << 29
    if not fits or not -1 <= ref < references or not -1 <= mate < references or pos < -1 or mate_pos < -1:
        return 0
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] != 0 or any(not 33 <= c <= 126 for c in text[:-1])):
        return 0
    return at + 4 + size


def first_record(data: bytes, references: int, whole: bool) -> int:
    """Where the first record of data begins, seen by a chain of CHAIN of them (or up to the end, where data is whole); -1 where none does."""
    for at in range(max(len(data) - 35, 0)):
        place, links = at, 0
        while links < CHAIN:
            after = plausible(data, place, references)
            if not after:
                break
            place, links = after, links + 1
            if place >= len(data) - 36:
                break
        if links == CHAIN or (links and (place == len(data) if whole else place >= len(data) - 36)):
            return at
    return -1


def decode(data: bytes, starts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """The records that begin at starts (each after its size)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    fixed = raw[starts[:, None] + np.arange(FIXED.itemsize)].copy().view(FIXED)[:, 0]
    steps, at = fixed["steps"].astype(np.int64), starts + FIXED.itemsize + fixed["name"]
    owner = np.repeat(np.arange(len(starts)), steps)
    nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    place = at[owner] + 4 * nth
    codes = raw[place[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(place) else np.zeros(0, dtype=np.uint32)
    kind, size = np.minimum(codes & 15, 8), (codes >> 4).astype(np.int64)
    total = lambda of: np.bincount(owner, np.array(of)[kind] * size, len(starts)).astype(np.int64)
    written = np.char.add(size.astype(str), np.array(list(STEPS))[kind]) if len(size) else np.zeros(0, dtype=str)
    ends = np.cumsum(steps)
    cigar = ["".join(written[e - n : e]) or "*" for e, n in zip(ends, steps)]
    name = [data[s + FIXED.itemsize : s + FIXED.itemsize + n - 1].decode() for s, n in zip(starts.tolist(), fixed["name"].tolist())]
    flag, bases = fixed["flag"].astype(np.int32), fixed["bases"].astype(np.int64)
    homes = [home_of(n) for n in names]
    chromosome = pa.array([n for n, _ in homes], pa.string()).take(pa.array(fixed["ref"], mask=fixed["ref"] < 0)) if names else pa.nulls(len(starts), pa.string())
    offset = np.array([*[at for _, at in homes], 0], dtype=np.int64)  # the last is of reads without a reference (-1)
    columns = [
        chromosome, pa.array(fixed["pos"] + offset[fixed["ref"]]), pa.array(total(OF_REFERENCE).astype(np.int32)), pa.array(np.where(bases > 0, bases, total(OF_READ)).astype(np.int32)),
        pa.array(fixed["mapq"].astype(np.int32)), pa.array(flag), *[pa.array((flag & bit) > 0) for bit in (DUPLICATE, SECONDARY, UNMAPPED, QCFAIL)], pa.array(name, pa.string()), pa.array(cigar, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def records(blocks: Blocks, at: int, inside: int, stop: tuple[int, int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the records from a virtual place (block, place in its data) up to those that begin at or after stop."""
    held, spans = b"", []  # spans: (place in held, block, skipped bytes) of each block that held has data of
    base = 0

    def begun(place):  # the virtual place of a place in held
        own = next(s for s in reversed(spans) if s[0] <= place)
        return own[1], place - own[0] + own[2]

    for begin, _, data in blocks.walk(at, stop[0]):
        skip = inside if begin == at else 0
        spans.append((len(held), begin, skip))
        held += data[skip:]
        starts, done = [], False
        while base + 4 <= len(held):
            if begun(base) >= stop:
                done = True
                break
            size = struct.unpack_from("<i", held, base)[0]
            if base + 4 + size > len(held):
                break
            starts.append(base + 4)
            base += 4 + size
        for i in range(0, len(starts), BATCH):
            yield decode(held, np.array(starts[i : i + BATCH], dtype=np.int64), names)
        if done:
            return
        keep = [s for s in spans if s[0] <= base]
        spans = [(s[0] - base, *s[1:]) if s[0] > base else (0, s[1], s[2] + base - s[0]) for s in [keep[-1], *[s for s in spans if s[0] > base]]]
        held, base = held[base:], 0
    if held:
        raise ValueError("the file ends inside a record")


# -- index --------------------------------------------------------------------------------------


def bins_of(start: int, end: int) -> list[int]:
    """The bins that may hold reads in a region; the first holds reads that fit no other, wherever they lie."""
    out, first = [0], 1
    for level, shift in list(enumerate(SHIFTS))[1:]:
        out += range(first + (start >> shift), first + (max(end - 1, start) >> shift) + 1)
        first += 1 << 3 * level
    return out


def bin_of(start, end):
    """The smallest bin that holds a read, of numbers or arrays."""
    last = np.maximum(end - 1, start)
    out, first = np.zeros_like(last), 1
    for level, shift in list(enumerate(SHIFTS))[1:]:
        out = np.where(start >> shift == last >> shift, first + (start >> shift), out)
        first += 1 << 3 * level
    return out


class Index:
    """A .bai from the blocks of sorted reads. It grows with the bins that hold reads and the blocks, not with the reads: a bin has one stretch of a block."""

    def __init__(self, references: int):
        self.of = [({}, {}) for _ in range(references)]

    def add(self, ref: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray, after: np.ndarray) -> None:
        """Reference, start, end, virtual begin and virtual end of each read of a block in order."""
        ref, start, end, begin, after = (a[ref >= 0] for a in (ref, start, end, begin, after))
        bins = ref << 32 | bin_of(start, end)
        kinds, first = np.unique(bins, return_index=True)
        last = len(bins) - 1 - np.unique(bins[::-1], return_index=True)[1]
        for k, a, z in zip(kinds.tolist(), begin[first].tolist(), after[last].tolist()):
            chunks = self.of[k >> 32][0].setdefault(k & 0xFFFFFFFF, [])
            if chunks and chunks[-1][1] >> 16 == a >> 16:
                chunks[-1][1] = z
            else:
                chunks.append([a, z])
        low = start >> SHIFTS[-1]
        n = (np.maximum(end - 1, start) >> SHIFTS[-1]) - low + 1
        own = np.repeat(np.arange(len(n)), n)
        windows, first = np.unique(ref[own] << 32 | low[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), return_index=True)
        for k, a in zip(windows.tolist(), begin[own[first]].tolist()):
            self.of[k >> 32][1].setdefault(k & 0xFFFFFFFF, a)

    def to_bytes(self) -> bytes:
        out = [b"BAI\x01", struct.pack("<i", len(self.of))]
        for bins, windows in self.of:
            out.append(struct.pack("<i", len(bins)))
            for b in sorted(bins):
                out.append(struct.pack("<Ii", b, len(bins[b])) + b"".join(struct.pack("<QQ", *c) for c in bins[b]))
            line, last = [], 0
            for w in range(max(windows) + 1 if windows else 0):
                last = windows.get(w, last)
                line.append(last)
            out.append(struct.pack("<i", len(line)) + struct.pack(f"<{len(line)}Q", *line))
        return b"".join(out)


def region_chunks(index: bytes, ref: int, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of virtual places that may hold reads of a region, in order, joined where they meet."""
    at = 8
    for r in range(struct.unpack_from("<i", index, 4)[0]):
        n = struct.unpack_from("<i", index, at)[0]
        at += 4
        found: dict[int, list[tuple[int, int]]] = {}
        for _ in range(n):
            b, chunks = struct.unpack_from("<Ii", index, at)
            if r == ref:
                found[b] = [struct.unpack_from("<QQ", index, at + 8 + 16 * i) for i in range(chunks)]
            at += 8 + 16 * chunks
        windows = struct.unpack_from("<i", index, at)[0]
        if r == ref:
            line = struct.unpack_from(f"<{windows}Q", index, at + 4)
            least = line[min(start >> 14, windows - 1)] if windows else 0
            # reads wholly in a window after the region begin after all reads of the region
            after_region = sum(1 << 3 * level for level in range(len(SHIFTS) - 1)) + ((end - 1) >> SHIFTS[-1])
            most = min((chunks[0][0] for b, chunks in found.items() if b > after_region), default=1 << 63)
            held = sorted((c[0], min(c[1], most)) for b in bins_of(start, end) for c in found.get(b, []) if c[1] > least and c[0] < most)
            out: list[tuple[int, int]] = []
            for begin, after in held:
                if out and begin <= out[-1][1]:
                    out[-1] = (out[-1][0], max(after, out[-1][1]))
                else:
                    out.append((max(begin, least), after))
            return out
        at += 4 + 8 * windows
    return []


# -- source -------------------------------------------------------------------------------------


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


class Split(InputPartition):
    def __init__(self, path: str, begin: int, end: int, inside: int = -1, stop: int = 0):
        self.path, self.begin, self.end, self.inside, self.stop = path, begin, end, inside, stop


def parse_region(region: str) -> tuple[str, int, int]:
    """chr, chr:start-end (from 1, both inside) as (chromosome, start from 0, end)."""
    m = re.fullmatch(r"(.+?)(?::([\d,]+)(?:-([\d,]+))?)?", region.strip())
    number = lambda x: int(x.replace(",", ""))
    return m[1], number(m[2]) - 1 if m[2] else 0, number(m[3]) if m[3] else 1 << 29


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.region = parse_region(options["region"]) if options.get("region") else None
        if self.region and not re.fullmatch(r".+:[\d,]+-[\d,]+", options["region"].strip()):
            self.region = *self.region[:2], 1 << 62  # to the end, wherever it is

    def partitions(self) -> list[Split]:
        store, path = store_of(self.path)
        top = store.get_file_info(path)
        files = store.get_file_info(fs.FileSelector(path)) if top.type == fs.FileType.Directory else [top]
        out = []
        for f in sorted((f for f in files if f.path.endswith(".bam")), key=lambda f: f.path):
            if self.region is None:
                out += [Split(f.path, at, min(at + self.split, f.size)) for at in range(0, f.size, self.split)]
                continue
            with store.open_input_file(f.path) as file:
                homes = [home_of(n) for n, _ in read_header(Blocks(file, f.size))[0]]
            name, start, end = self.region
            mine = [(i, at) for i, (n, at) in enumerate(homes) if n == name and at < end]
            if not mine:
                continue
            with store.open_input_file(f"{f.path}.bai") as file:
                index = file.read()
            chunks = [c for i, at in mine for c in region_chunks(index, i, max(start - at, 0), min(end - at, MOST)) if start - at < MOST]
            out += [Split(f.path, c[0] >> 16, c[1] >> 16, c[0] & 0xFFFF, c[1] & 0xFFFF) for c in chunks]
        return out or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(split.path) as file:
            blocks = Blocks(file, file.size())
            refs, at, inside = read_header(blocks)
            names = [n for n, _ in refs]
            if split.inside >= 0:
                yield from self._of_region(records(blocks, split.begin, split.inside, (split.end, split.stop), names))
                return
            if split.begin > 0 and split.begin > at:
                at = blocks.first(split.begin)
                data, whole, sizes = b"", False, []
                for begin, n, more in blocks.walk(at) if at < split.end else ():
                    data += more
                    sizes.append((begin, len(more)))
                    whole = begin + n + len(END_BLOCK) >= blocks.size
                    if len(data) >= 4 * BLOCK_BYTES:
                        break
                inside = first_record(data, len(names), whole)
                while sizes and inside >= sizes[0][1]:  # the record may begin in a later block
                    inside -= sizes.pop(0)[1]
                if inside < 0 or not sizes:
                    return
                at = sizes[0][0]
            if at < split.end:
                yield from records(blocks, at, inside, (split.end, 0), names)

    def _of_region(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, start, end = self.region
        for batch in batches:
            pos, size = batch.column("pos").to_numpy(), batch.column("aligned_len").to_numpy()
            inside = (pos < end) & (pos + np.maximum(size, 1) > start)
            yield batch.filter(pa.array(inside & np.array([c == name for c in batch.column("chromosome").to_pylist()], dtype=bool)))


class BamSource(DataSource):
    """Options: path (a file or a folder), region, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(self.options)


def read_bam(spark, path: str, region: str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Reads of BAM files, of one region where given (which needs their indexes)."""
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("splitBytes", str(split_bytes))
    return (reader.option("region", region) if region else reader).load(path)


# -- sink ---------------------------------------------------------------------------------------


def steps_of(cigar: str) -> tuple[bytes, int]:
    """The steps of a record, and the length of its reference."""
    steps = [(int(n), STEPS.index(s)) for n, s in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    return b"".join(struct.pack("<I", n << 4 | s) for n, s in steps), sum(n for n, s in steps if OF_REFERENCE[s])


def encode(frame: pd.DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Rows as records without bases, and the reference, start and end of each (a row of the array for each of the three)."""
    which, kinds = pd.factorize(frame["cigar"], use_na_sentinel=False)
    known = [steps_of(c) for c in kinds]
    steps = [known[k][0] for k in which]
    name = [n.encode() + b"\0" for n in frame["name"]]
    size = np.array([len(n) for n in name], dtype=np.int64)
    ref, pos = frame["_ref"].fillna(-1).to_numpy(dtype=np.int64), frame["pos"].to_numpy(dtype=np.int64)
    start = np.maximum(pos, 0)
    end = start + np.maximum(np.array([n for _, n in known], dtype=np.int64)[which], 1)
    own = bin_of(start, end) & 0xFFFF  # places after 2^29 have bins that do not fit; the index has them
    count = np.array([len(s) for s in steps], dtype=np.int64) // 4
    values = {"size": 32 + size + 4 * count, "ref": ref, "pos": pos, "name": size, "mapq": frame["mapq"].to_numpy(), "bin": own, "steps": count, "flag": frame["flag"].to_numpy(), "mate": -1, "mate_pos": -1}
    fixed = np.zeros(len(frame), dtype=[("size", "<i4"), *FIXED.descr])
    for field, value in values.items():
        fixed[field] = value
        if not (fixed[field] == value).all():
            raise ValueError(f"a BAM file cannot hold a read's {field}: {value[fixed[field] != value][0]}")
    raw, n = fixed.tobytes(), fixed.itemsize
    return [raw[n * i : n * i + n] + a + b for i, (a, b) in enumerate(zip(name, steps))], np.array([ref, start, end])


def write_bam(df: DataFrame, folder: str, references: list[tuple[str, int]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """name, flag, chromosome, pos, mapq and cigar written as sorted BAM files with indexes; (path, reads, bytes) of each.

    A task writes a file of its range of places, under a name of its own until it is whole, so
    a task that is run again leaves one file. Reads without a known chromosome come last.
    """
    parts = pieces(references)
    names, long_ = [n for n, *_ in parts], [n for n, size in references if size >= MOST]
    place = {n: names.index(n) for n, _ in references}
    references = [(n, size) for _, _, n, size in parts]
    text = "".join(["@HD\tVN:1.6\tSO:coordinate\n", *[f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references]]).encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
    number = F.element_at(F.create_map(*[x for n, i in place.items() for x in (F.lit(n), F.lit(i))]), F.col("chromosome"))
    which = F.lit(0)
    for n in long_:
        which = F.when((F.col("chromosome") == n) & (F.col("pos") >= 0), F.least(F.floor(F.col("pos") / PIECE), F.lit(names.count(n) - 1))).otherwise(which)
    order = [F.col("_ref").asc_nulls_last(), "pos", "name"]
    ranged = df.select("name", "flag", (number + which).alias("_ref"), (F.col("pos") - which * F.lit(PIECE).cast("long")).alias("pos"), "mapq", "cigar").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def write(frames):
        store, base = store_of(folder)
        store.create_dir(base)
        out, part, count, at, index = None, None, 0, 0, Index(len(references))

        def flush(raw: list[bytes], places: np.ndarray) -> None:
            nonlocal at
            data = b"".join(raw)  # more than a block only where one record is
            made = b"".join(block(data[i : i + BLOCK_BYTES]) for i in range(0, len(data), BLOCK_BYTES))
            inside = np.cumsum([0, *map(len, raw)])
            after = at << 16 | np.minimum(inside[1:], 0xFFFF)
            after[-1] = (at + len(made)) << 16  # the next record begins in the next block
            index.add(*places, at << 16 | inside[:-1], after)
            out.write(made)
            at += len(made)

        held, places = [], np.zeros((3, 0), dtype=np.int64)  # records of a block that more may go into
        for frame in frames:
            if out is None and len(frame):
                part = f"{base}/part-{frame['_part'].iloc[0]:05d}.bam"
                out = store.open_output_stream(f"{part}.writing")
                for i in range(0, len(head), BLOCK_BYTES):
                    made = block(head[i : i + BLOCK_BYTES])
                    out.write(made)
                    at += len(made)
            raw, more = encode(frame)
            held, places, count, i = held + raw, np.concatenate([places, more], axis=1), count + len(raw), 0
            total = np.cumsum([0, *map(len, held)])
            while (j := max(int(np.searchsorted(total, total[i] + block_bytes, "right")) - 1, i + 1)) < len(held):
                flush(held[i:j], places[:, i:j])
                i = j
            held, places = held[i:], places[:, i:]
        if out is not None:
            flush(held, places)
            out.write(END_BLOCK)
            out.close()
            with store.open_output_stream(f"{part}.bai") as file:
                file.write(index.to_bytes())
            store.move(f"{part}.writing", part)
            yield pd.DataFrame({"path": [part], "reads": [count], "bytes": [at + len(END_BLOCK)]})

    return ranged.mapInPandas(write, "path string, reads long, bytes long")
