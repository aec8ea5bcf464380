"""Token ids in files: canonical length-limited Huffman codes from global counts.

A file holds whole documents in ascending id order and stands alone: code lengths, document
ids, which of them are null, and sizes, a bit offset for every BLOCK ids, and the code bits.
Blocks are decoded by table, many blocks in step. Files are rows of a table, so any store that
Spark can write holds them and a lost task's files are written again.

Defined results: a null text has only the end id; a null document id comes first and is null
when read back; an empty table has no files; documents with one id are ordered by a hash of
their content; other columns are not written. Texts are encoded, packed and unpacked a bounded
stretch at a time, so a very long one costs its ids in memory and little more.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored
from .tokens import encoded, forget

MAGIC = b"TSRH"
VERSION = 2
HEADER = struct.Struct("<4sHHIIQQQ")  # magic, version, longest code, documents, blocks, ids, bits, bytes of code lengths
LONGEST = 18
BLOCK = 512
FILE_IDS = 1 << 20
#: Ids packed or unpacked at a time; a multiple of BLOCK.
STRETCH = 1 << 19
END_ID = 2


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most longest bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    items = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(longest):
        both = np.concatenate([items, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(np.cumsum(rank < n))  # items among the first k
        both = both[rank]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for own in reversed(levels):
        if take == 0:
            break
        single = int(own[take - 1])
        lengths[order[:single]] += 1
        take = 2 * (take - single)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by length, then by symbol, counting up."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    code = last = 0
    for s in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        codes[s] = code
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """(code bits, bit offset of every BLOCK-th id, bits)."""
    out, offsets, bits, carry = [], [], 0, 0
    for k in range(0, len(ids), STRETCH):
        part = ids[k : k + STRETCH]
        size = lengths[part].astype(np.int64)
        ends = np.cumsum(size) + (bits & 31)
        starts = ends - size
        offsets.append(starts[::BLOCK] + (bits & ~31))
        word, room = starts >> 5, 64 - (starts & 31) - size
        wide = codes[part] << room.astype(np.uint64)  # in the 64 bits from its 32-bit word on
        n = (int(ends[-1]) >> 5) + 2
        total = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n)
        total += np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
        total[0] += carry  # what the stretch before left in its last word
        bits = (bits & ~31) + int(ends[-1])
        whole = int(ends[-1]) >> 5
        carry = total[whole]
        out.append(total[:whole].astype(">u4").tobytes())
    out.append(np.array([carry, 0, 0]).astype(">u4").tobytes())
    return b"".join(out), np.concatenate(offsets) if offsets else np.zeros(0, dtype=np.int64), bits


def decode_table(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of longest bits the symbol it begins with and that symbol's length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (longest - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << longest, dtype=np.uint32)
    widths = np.ones(1 << longest, dtype=np.int64)
    filled = int(spans.sum())
    symbols[:filled] = np.repeat(order, spans)
    widths[:filled] = np.repeat(lengths[order], spans)
    return symbols, widths


def unpack_bits(payload: memoryview | bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    """n ids; the blocks are decoded in step, each from its own offset."""
    symbols, widths = table
    out = np.zeros(n, dtype=np.uint16 if len(symbols) and symbols.max() < 1 << 16 else np.uint32)
    step = STRETCH // BLOCK
    for first in range(0, len(offsets), step):
        at = offsets[first : first + step].astype(np.int64)
        byte = int(at[0]) >> 3
        stop = (int(offsets[first + step]) >> 3) + 8 if first + step < len(offsets) else len(payload)
        raw = np.frombuffer(payload[byte:stop], dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        at -= 8 * byte
        here = min(n - first * BLOCK, len(at) * BLOCK)  # ids of this stretch
        got = np.zeros((len(at), BLOCK), dtype=out.dtype)
        for k in range(min(BLOCK, here)):
            live = len(at) if (len(at) - 1) * BLOCK + k < here else len(at) - 1
            place = at[:live]
            key = (window[place >> 3] << (place & 7).astype(np.uint32)) >> np.uint32(32 - longest)
            got[:live, k] = symbols[key]
            at[:live] = place + widths[key]
        out[first * BLOCK : first * BLOCK + here] = got.reshape(-1)[:here]
    return out


def write_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, longest: int = LONGEST) -> bytes:
    """doc_ids may hold None."""
    payload, offsets, bits = pack_bits(ids, codes, lengths)
    book = zlib.compress(lengths.tobytes(), 6)
    missing = np.packbits([d is None for d in doc_ids]).tobytes()
    docs = np.asarray([0 if d is None else d for d in doc_ids], dtype="<i8")
    head = HEADER.pack(MAGIC, VERSION, longest, len(docs), len(offsets), len(ids), bits, len(book))
    return b"".join([head, book, docs.tobytes(), missing, sizes.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), payload])


def read_file(image: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(document ids, their numbers of ids, all ids)."""
    magic, version, longest, docs, blocks, n, _bits, book = HEADER.unpack_from(image)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file")
    at = HEADER.size
    lengths = np.frombuffer(zlib.decompress(image[at : at + book]), dtype=np.uint8)
    at += book
    doc_ids = np.frombuffer(image, "<i8", docs, at)
    at += 8 * docs
    missing = np.unpackbits(np.frombuffer(image, np.uint8, -(-docs // 8), at))[:docs].astype(bool)
    at += -(-docs // 8)
    sizes = np.frombuffer(image, "<u8", docs, at).astype(np.int64)
    offsets = np.frombuffer(image, "<u8", blocks, at + 8 * docs)
    payload = memoryview(image)[at + 8 * docs + 8 * blocks :]
    return pa.array(doc_ids, mask=missing), sizes, unpack_bits(payload, offsets, n, decode_table(lengths, longest), longest)


def tokenized(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the ids of each text and end_id, as unsigned 16-bit integers where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, before in encoded(batch, "text", path):
                n = len(before) - 1
                ids = np.insert(ids, before[1:], end_id)
                before = before + np.arange(n + 1)
                width = 2 if ids.dtype == np.uint16 else 4
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((width * before).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), raw.cast(pa.binary()), pa.array(np.full(n, width, dtype=np.int32))], names=["doc_id", "ids", "width"])

    small_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, ids binary, width int")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw, width in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(np.frombuffer(raw, f"<u{width}"))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # one row for each id of the vocabulary
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, dtype=np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def written(tokens: DataFrame, longest: int = LONGEST, file_ids: int = FILE_IDS) -> DataFrame:
    """The files, in order of (part, file): part, file, ids before it in its part, ids, image."""
    counts = id_counts(tokens)
    lengths = code_lengths(counts, longest)
    codes = canonical_codes(lengths)
    parts = max(1, tokens.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part = TaskContext.get().partitionId()
        held, docs, n, file, before = [], [], 0, 0, 0

        def flush():
            nonlocal held, docs, n, file, before
            image = write_file(docs, np.asarray([len(x) for x in held], dtype=np.int64), np.concatenate(held), codes, lengths, longest)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([file], pa.int64()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([image], pa.binary())],
                names=["part", "file", "before", "n_ids", "image"],
            )
            held, docs, n, file, before = [], [], 0, file + 1, before + n
            return row

        for batch in batches:
            rows = batch.column(1)
            for i, (doc, width) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                held.append(np.frombuffer(rows[i].as_buffer(), f"<u{width}"))
                docs.append(doc)
                n += len(held[-1])
                if n >= file_ids:
                    yield flush()
            held = [x.copy() for x in held]  # else a file in the making keeps whole batches
        if held:
            yield flush()

    # rows alike in id and content are told apart by their place, so that no id is too large for a task
    order = ["doc_id", "_content", "_row"]
    placed = tokens.withColumns({"_content": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids", "width")
    return ordered.mapInArrow(run, "part int, file long, before long, n_ids long, image binary")


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files."""
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row for each part
    starts, at = [], 0
    for part in range(max(totals, default=-1) + 1):
        starts.append(at)
        at += totals.get(part, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(batch.num_rows):
                docs, sizes, ids = read_file(batch.column(2)[i].as_buffer().to_pybytes())
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[a:b].astype("<u4").data) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                start = starts[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return files.select("part", "before", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> DataFrame:
    """Tokenise once, write the files to the shared folder, and return them."""
    tokens = stored(tokenized(df, path, id_column, text_column, end_id), "tokens")
    files = stored(written(tokens), "token-files")
    discard(tokens)
    return files
