"""Token-id files in patched frame-of-reference blocks.

One file (an *image*) holds consecutive documents; all integers are little-endian:

    magic ``PFOR1``, version byte, 2 zero bytes
    uint64   documents, ids, blocks, ids in a block
    bytes    one bit per document: set where its doc_id is null
    int64[]  doc_id of each document
    uint64[] number of ids of each document
    uint64[] start of each block, counted from the first block; one more for the end
    blocks   uint32 minimum, uint32 exceptions, uint8 width; the packed low bits;
             uint32[] exception places; uint32[] exception high bits

A block subtracts its minimum and packs the low ``width`` bits of every id, 32 lanes to a
row. Ids that need more bits are exceptions: their high bits stand in a list. The width is
the percentile of the block's bit lengths that gives the fewest bytes. The block index lets
a reader decode any range of ids without the blocks before it.

Images are written as rows of a Parquet dataset, whose committer makes them safe against
lost and repeated tasks and lets them lie in any store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetloom.llm.common import id_and_text, map_arrow, ready_workers
from fleetloom.llm.tokens import END_ID, word_ids

MAGIC = b"PFOR1\x01\x00\x00"
BLOCK_IDS = 8192
IMAGE_IDS = 2_000_000
PERCENTILES = (50, 75, 90, 95, 98, 99.5, 100)
_HEAD = struct.Struct("<IIB")


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, 32 lanes to a row of ``width`` words."""
    rows = -(-len(values) // 32)
    lanes = np.zeros((rows, 32), dtype=np.uint32)
    lanes.reshape(-1)[: len(values)] = values
    lanes &= np.uint32((1 << width) - 1)
    words = np.zeros((rows, width), dtype="<u4")
    for lane in range(32):
        word, shift = divmod(lane * width, 32)
        if width:
            words[:, word] |= lanes[:, lane] << np.uint32(shift)
            if shift + width > 32:
                words[:, word + 1] |= lanes[:, lane] >> np.uint32(32 - shift)
    return words.tobytes()


def _unpack(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    rows = -(-n // 32)
    words = np.frombuffer(data, "<u4", rows * width, at).reshape(rows, width)
    lanes = np.zeros((rows, 32), dtype=np.uint32)
    mask = np.uint32((1 << width) - 1)
    for lane in range(32):
        word, shift = divmod(lane * width, 32)
        if width:
            lanes[:, lane] = words[:, word] >> np.uint32(shift)
            if shift + width > 32:
                lanes[:, lane] |= words[:, word + 1] << np.uint32(32 - shift)
            lanes[:, lane] &= mask
    return lanes.reshape(-1)[:n]


def encode_block(values: np.ndarray) -> bytes:
    """One block: minimum, exceptions, width, packed low bits, exception list."""
    values = values.astype(np.uint32)
    least = values.min() if len(values) else np.uint32(0)
    rest = values - least
    bits = np.where(rest > 0, np.floor(np.log2(np.maximum(rest, 1).astype(np.float64))).astype(np.int64) + 1, 0)
    widths = sorted({int(w) for w in np.percentile(bits, PERCENTILES, method="higher")}) if len(bits) else [0]
    width = min(widths, key=lambda w: len(bits) * w / 8 + 8 * int((bits > w).sum()))
    places = np.flatnonzero(bits > width)
    high = rest[places] >> np.uint32(width)
    return _HEAD.pack(int(least), len(places), width) + _pack(rest, width) + places.astype("<u4").tobytes() + high.astype("<u4").tobytes()


def decode_block(data: bytes, at: int, n: int) -> np.ndarray:
    """The ``n`` ids of the block that starts at byte ``at``."""
    least, exceptions, width = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    values = _unpack(data, at, n, width)
    at += 4 * width * -(-n // 32)
    places = np.frombuffer(data, "<u4", exceptions, at)
    values[places] |= np.frombuffer(data, "<u4", exceptions, at + 4 * exceptions) << np.uint32(width)
    return values + np.uint32(least)


def encode_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """The image of consecutive documents; ``ids`` are those of all of them, one after another."""
    blocks = [encode_block(ids[at : at + block_ids]) for at in range(0, len(ids), block_ids)]
    starts = np.zeros(len(blocks) + 1, dtype="<u8")
    np.cumsum([len(b) for b in blocks], out=starts[1:])
    return b"".join([
        MAGIC,
        struct.pack("<QQQQ", len(doc_ids), len(ids), len(blocks), block_ids),
        np.packbits([d is None for d in doc_ids]).tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array(lengths, dtype="<u8").tobytes(),
        starts.tobytes(),
        *blocks,
    ])


class Image:
    """A read view of an image: its documents at once, ids of any range on demand."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self._data, at = data, len(MAGIC)
        n_docs, self.n_ids, n_blocks, self._block_ids = struct.unpack_from("<QQQQ", data, at)
        at += 32
        null = np.unpackbits(np.frombuffer(data, np.uint8, -(-n_docs // 8), at), count=n_docs)
        at += -(-n_docs // 8)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(data, "<i8", n_docs, at), null)]
        at += 8 * n_docs
        self.lengths = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        self._starts = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self._at = at + 8 * (n_blocks + 1)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``start`` up to ``end`` (default: all that follow); decodes only the blocks these lie in."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self._block_ids, (end - 1) // self._block_ids
        parts = [
            decode_block(self._data, self._at + int(self._starts[b]), min(self._block_ids, self.n_ids - b * self._block_ids))
            for b in range(first, last + 1)
        ]
        return np.concatenate(parts)[start - first * self._block_ids : end - first * self._block_ids]


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None = END_ID, image_ids: int = IMAGE_IDS,
    id_column: str = "doc_id", text_column: str = "text",
) -> None:
    """Encode all documents in ascending order of id and write them as token files below ``path``.

    Rows are dealt by ranges of the id and sorted in their range, so files follow one another
    as ``(part, seq)``. A null id comes first; repeated ids stand by a hash of their text. Null and empty texts
    are written with the end id alone. A file closes at ``image_ids`` ids, between documents.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), word_ids(vocabulary)
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        data: list[bytes] = []
        held, seq = 0, 0

        def image() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([encode_image(doc_ids, lengths, ids)], pa.binary())],
                names=["part", "seq", "n_ids", "image"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                encoded = words.encode(text.as_py(), end_id)
                doc_ids.append(doc_id)
                lengths.append(len(encoded) // 4)
                data.append(encoded)
                held += lengths[-1]
                if held >= image_ids:
                    yield image()
                    doc_ids, lengths, data, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield image()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id may be very many, those without one as well: they are dealt by a hash of their text
    keyed = id_and_text(docs, id_column, text_column).withColumn("_hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    map_arrow(ordered.select("doc_id", "text"), encode, "part long, seq long, n_ids long, image binary").write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Read the files below ``path`` back: ``doc_id, start, n_tokens, ids_crc32`` of each document.

    ``start`` counts the ids of all documents before it; the checksum is over the decoded ids as
    little-endian unsigned 32-bit integers. Files are decoded block by block.
    """
    ready_workers(spark)
    files = spark.read.parquet(path)
    sizes = files.select("part", "seq", "n_ids")
    # one row per write task; the sum over these is the only step that one task takes alone
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    parts = parts.select("part", (F.sum("_ids").over(Window.orderBy("part")) - F.col("_ids")).alias("_base"))
    in_part = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.select("part", "seq", in_part.alias("_before")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("_before") + F.col("_base")).alias("file_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                image = Image(data.as_py())
                ends = np.cumsum(image.lengths)
                crc, ids, at = [], image.ids().astype("<u4"), 0
                for end in ends.tolist():
                    crc.append(zlib.crc32(ids[at:end]))
                    at = end
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(image.doc_ids, pa.int64()),
                     pa.array(ends - image.lengths, pa.int64()), pa.array(image.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "in_file", "n_tokens", "ids_crc32"],
                )

    schema = "part long, seq long, doc_id long, in_file long, n_tokens long, ids_crc32 long"
    read = files.select("part", "seq", "image").mapInArrow(decode, schema)
    return read.join(starts, ["part", "seq"]).select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")
