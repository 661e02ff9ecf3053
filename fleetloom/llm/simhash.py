"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in no bit are one row from the start, so a group of copies costs what
one text costs. The distinct ones are dealt into tiles by the population counts of their four
quarters. Two fingerprints within the radius have
counts whose differences add up to at most the radius, so only tiles that near are compared:
exclusive-or and bit counts over whole tiles with numpy. From every pair of tiles comes a
forest of links, not all links, which connects the same fingerprints. Work within a tile grows
with the square of its rows; a tile is cut into blocks of ``BLOCK``, so no task holds more
than two of these.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.common import id_and_text, map_arrow
from fleetloom.llm.components import connected_components
from fleetloom.session import durable_copy

SEED = 42
BLOCK = 8192
_AT_ONCE = 1 << 21  # comparisons held in memory at once
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """A further 64-bit hash made of ``h`` (the finaliser of a common generator); turn 0 is ``h`` itself."""
    if not turn:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(turn) * _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of every shingle of ``text`` in order, repeats included.

    A-Z are lower-cased; words are runs of anything but the six ASCII white spaces. Shingles are
    ``shingle`` words joined by one space; a shorter text is one shingle, one without words has none.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def _vote(hashes: np.ndarray, bits: int, chunk: int = 1 << 15) -> bytes:
    """A bit is set if over half of ``hashes`` have it (big-endian)."""
    n = len(hashes)
    found = np.zeros(bits, dtype=np.int64)
    for at in range(0, n, chunk):
        part = hashes[at : at + chunk]
        for turn in range(bits // 64):
            each = np.unpackbits(_mixed(part, turn).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            found[64 * turn : 64 * turn + 64] += each.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * found > n).tobytes()


def fingerprint(text: str | None, shingle: int, bits: int = 64, chunk: int = 1 << 15) -> tuple[bytes, int]:
    """The fingerprint of ``text`` and its number of shingles, repeats included (see ``shingle_hashes``); zero without words."""
    hashes = shingle_hashes(text, shingle)
    return _vote(hashes, bits, chunk), len(hashes)


def fingerprints(docs: DataFrame, shingle: int, bits: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp`` (binary), ``size`` (shingles) and ``text_hash`` of every row; null text is an empty one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle, bits) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64()), batch.column(2)],
                names=["doc_id", "fp", "size", "text_hash"],
            )

    rows = id_and_text(docs, id_column, text_column).withColumn("text_hash", F.xxhash64("text"))
    return map_arrow(rows, each, "doc_id long, fp binary, size long, text_hash long")


def _quarter_counts(fp: str, bits: int) -> list[Column]:
    """Population counts of the four quarters of a binary fingerprint."""
    digits = bits // 16  # hexadecimal digits in a quarter
    quarters = [F.substring(F.hex(fp), 1 + q * digits, digits) for q in range(4)]
    piece = min(digits, 8)  # conv() is sure up to 32 bits
    return [
        sum((F.bit_count(F.conv(F.substring(q, 1 + at, piece), 16, 10).cast("long")) for at in range(0, digits, piece)), F.lit(0))
        for q in quarters
    ]


def _near_tiles(dimensions: int, radius: int, count_limit: int) -> list[tuple[int, ...]]:
    """Steps from a tile to the tiles that may hold fingerprints within ``radius``, one of each opposite pair."""
    reach = min(radius, count_limit)
    steps = itertools.product(range(-reach, reach + 1), repeat=dimensions)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * dimensions]


def links(distinct: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """A forest of links ``u, v`` between fingerprints of ``distinct`` (``fp``) that differ in at most ``radius`` bits.

    It connects exactly the fingerprints that all such links connect.
    """
    parts = _quarter_counts("fp", bits)
    steps = _near_tiles(4, radius, bits // 4)
    base = bits + 64  # larger than any count and step
    code = lambda values: sum((v * base**k for k, v in enumerate(values)), F.lit(0).cast("long"))

    tiled = distinct.select("fp", code([p.cast("long") for p in parts]).alias("tile"))
    counts = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    # tiles are few: 17 ** 4 counts of four quarters of 16 bits; rows then go to their block, not to their tile
    few = bits <= 64
    blocked = tiled.join(F.broadcast(counts) if few else counts, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    blocks = durable_copy(
        blocked.groupBy("tile", "block", "blocks").agg(F.array_join(F.collect_list(F.hex("fp")), "").alias("fps")), "tiles"
    ).withColumn("fps", F.unhex("fps"))

    near = F.explode(F.lit([int(sum(v * base**k for k, v in enumerate(s))) for s in steps]))
    left = blocks.select("tile", "block", "blocks", F.col("fps").alias("a"), near.alias("step"))
    left = left.select((F.col("tile") + F.col("step")).alias("tile"), "block", "a", "step")
    right = blocks.select("tile", F.col("block").alias("other"), F.col("fps").alias("b"))
    pairs = left.join(right, "tile").filter((F.col("step") != 0) | (F.col("other") >= F.col("block")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_forest(a.as_py(), b.as_py(), bits, radius) for a, b in zip(batch.column(0), batch.column(1))]
            u, v = (np.concatenate([f[k] for f in found]) if found else np.zeros((0, bits // 8), np.uint8) for k in (0, 1))
            as_binary = lambda x: pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(bits // 8), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([as_binary(u), as_binary(v)], names=["u", "v"])

    # a number of its own: few bytes, much work, so these partitions are not to be merged by size
    n_parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("a", "b").repartition(n_parts, F.xxhash64("a", "b"))
    return dealt.mapInArrow(compare, "u binary, v binary")


def _forest(a: bytes, b: bytes, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links between two blocks connect: each node to the least node it is joined with."""
    width = bits // 64
    x, y = (np.frombuffer(t, ">u8").astype(np.uint64).reshape(-1, width) for t in (a, b))
    label = np.arange(len(x) + len(y))
    same = a == b
    step = max(1, _AT_ONCE // max(1, len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        apart = np.zeros((len(part), len(y)), dtype=np.uint16)
        for w in range(width):
            apart += np.bitwise_count(part[:, w, None] ^ y[None, :, w])
        i, j = np.nonzero(apart <= radius)
        if same:
            i, j = i[at + i < j], j[at + i < j]
        if len(i):
            _join(label, at + i, len(x) + j)
    if same:  # both halves of the labels are the same nodes
        _join(label, np.arange(len(x)), len(x) + np.arange(len(x)))
    node = np.flatnonzero(label != np.arange(len(label)))
    both = np.concatenate([x, y]).astype(">u8").view(np.uint8).reshape(-1, bits // 8)
    return both[node], both[label[node]]


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give all nodes that the links ``i - j`` and the present labels connect their least label."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def near_duplicate_classes(
    docs: DataFrame, shingle: int = 3, bits: int = 64, radius: int = 3, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, fp`` (binary), ``component_id, root, text_hash`` for every row of ``docs``.

    Fingerprints (of all shingles, repeats included) within ``radius`` are linked.
    ``component_id`` is the least id of all rows that are linked, directly or over others; ``root``
    stands for the class. Null text is an empty one; empty texts have
    fingerprint zero and are linked to each other. Repeated rows share a class. A row with a null
    id takes part; a class of such rows only has a null id.
    """
    each = durable_copy(fingerprints(docs, shingle, bits, id_column, text_column), "fingerprints")
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(durable_copy(links(nodes, radius, bits).distinct(), "links"))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    rooted = durable_copy(rooted.select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    # written before it is joined: a join of two plain sides can be split where a class holds very many fingerprints
    least = durable_copy(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "classes")
    of_fingerprint = rooted.join(least, "root").select("fp", "component_id", "root")
    return each.join(of_fingerprint, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """Rows of ``docs``, one of each class, with their columns unchanged.

    The row with the least id stays, of equal ids the one whose text has the least hash, of
    repeated rows one. A class of rows with null ids keeps one of them.
    """
    last = F.lit((1 << 63) - 1)  # a null id comes after all others
    classes = near_duplicate_classes(docs, id_column=id_column, text_column=text_column, **how)
    first = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
    keep = first.agg(F.coalesce(F.min("doc_id"), last).alias("_id"), F.min("text_hash").alias("_hash")).drop("root")
    row = docs.select(
        F.struct(*docs.columns).alias("_row"), F.coalesce(docs[id_column].cast("long"), last).alias("_id"),
        F.xxhash64(F.coalesce(docs[text_column], F.lit(""))).alias("_hash"),
    )
    one = Window.partitionBy("_id", "_hash").orderBy(F.lit(0))
    kept = row.join(keep, ["_id", "_hash"], "left_semi").withColumn("_n", F.row_number().over(one))
    return kept.filter(F.col("_n") == 1).select("_row.*")
