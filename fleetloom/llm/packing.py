"""Best-fit packing of documents into sequences, after a Martello-Toth reduction.

Token counts are whole numbers up to the capacity, so documents of equal length are
interchangeable: the instance is fully stated by how many pieces there are of each length.
Spark counts them; the reduction and the best fit run on that table of at most ``capacity``
numbers, whatever the size of the corpus, and yield patterns with multiplicities. Spark then
ranks the pieces of each length and looks the rank up in the patterns. No piece passes
through the driver, and no length (a third of all pieces may be full ones) through one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.common import id_and_text, map_arrow
from fleetloom.llm.tokens import END_ID, word_ids
from fleetloom.session import durable_copy

CAPACITY = 4096
RANKED_TOGETHER = 256  # pieces of one length that are ranked in one group, unless a length fills more than MOST_GROUPS
MOST_GROUPS = 4096

Pattern = tuple[int, tuple[int, ...]]  # multiplicity, lengths in the order they stand in the sequence


def cut_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int | None = END_ID,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32``.

    Only documents of more than ``capacity`` ids are cut; the last piece may be shorter. Null
    text is an empty document (the end id alone). Repeated rows give repeated pieces; a null id
    stays null. Columns other than the two named are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                encoded = ids.encode(text.as_py(), end_id)
                for piece, at in enumerate(range(0, len(encoded), 4 * capacity)):
                    part = encoded[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_arrow(id_and_text(docs, id_column, text_column), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets of at most two pieces that dominate every other set holding their larger piece.

    ``counts[l]`` is the number of pieces of length ``l``; fixed pieces are taken out of it. A
    set dominates if every other feasible set with its larger piece can be exchanged for it
    without a further sequence: (a) nothing fits beside the piece, (b) a partner fills the rest
    exactly, (c) only one more piece can fit, then the longest that does, (d) at most two more
    can fit and the longest single partner is at least as long as the longest pair.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for x in np.flatnonzero(counts)[::-1].tolist():
            while counts[x]:
                counts[x] -= 1
                left = np.flatnonzero(counts[: capacity - x + 1])
                partner = _dominating(counts, left, capacity - x) if len(left) else 0
                counts[x] += 1
                if partner is None:
                    break
                times = int(counts[x] if not partner else counts[x] // 2 if partner == x else min(counts[x], counts[partner]))
                counts[x] -= times
                if partner:
                    counts[partner] -= times
                fixed.append((times, (x, partner) if partner else (x,)))
                changed = True
    return fixed


def _dominating(counts: np.ndarray, left: np.ndarray, room: int) -> int | None:
    """The one partner that dominates, or None if none is proven to."""
    longest, least = int(left[-1]), int(left[0])
    if longest == room:
        return longest
    smallest = np.repeat(left[:3], np.minimum(counts[left[:3]], 3))[:3]
    if len(smallest) < 2 or smallest[:2].sum() > room:
        return longest
    if longest < 2 * least or (len(smallest) == 3 and smallest.sum() <= room):
        return None
    return _if_pairs_are_shorter(counts, left, room)


def _if_pairs_are_shorter(counts: np.ndarray, left: np.ndarray, room: int) -> int | None:
    mate = np.searchsorted(left, room - left, side="right") - 1
    same = (mate >= 0) & (left[mate] == left) & (counts[left] < 2)
    mate = np.where(same, mate - 1, mate)
    pairs = left[mate[mate >= 0]] + left[mate >= 0]
    return int(left[-1]) if not len(pairs) or pairs.max() <= left[-1] else None


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing over counts: the longest piece left, then again and again the longest that still fits.

    A pattern is repeated as long as its pieces last, so the number of steps depends on the
    number of lengths, not on the number of pieces. Empties ``counts``.
    """
    patterns: list[Pattern] = []
    present = np.flatnonzero(counts)
    while len(present):
        used: dict[int, int] = {}
        pattern: list[int] = []
        room, top = capacity, len(present)
        while top and room >= present[0]:
            top = int(np.searchsorted(present[:top], room, side="right"))
            if not top:
                break
            length = int(present[top - 1])
            times = min(room // length, int(counts[length]))
            used[length] = times
            pattern += [length] * times
            room -= times * length
            top -= 1
        times = min(int(counts[length]) // k for length, k in used.items())
        for length, k in used.items():
            counts[length] -= times * k
        patterns.append((times, tuple(pattern)))
        present = present[counts[present] > 0]
    return patterns


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns for all pieces counted: the dominating sets first, then best fit over what they leave."""
    left = np.array(counts, dtype=np.int64)
    return [*reduce_instance(left, capacity), *best_fit(left, capacity)]


def segments(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, which ranks go where: arrays sorted by length and first rank.

    The ranks of a length from ``first`` on go to sequences from ``sequence`` on, ``each`` of
    them to every sequence, the first of these at ``offset``.
    """
    rows, taken, sequence = [], {}, 0
    for times, pattern in patterns:
        offset = 0
        for length, each in _runs(pattern):
            rows.append((length, taken.get(length, 0), sequence, each, offset))
            taken[length] = taken.get(length, 0) + times * each
            offset += length * each
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "each", "offset"), table.T))


def _runs(pattern: tuple[int, ...]) -> list[tuple[int, int]]:
    return [(length, pattern.count(length)) for length in sorted(set(pattern), reverse=True)]


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0) and ``offset``; needs ``doc_id, piece, length``, keeps all columns.

    ``pieces`` is evaluated several times and must give the same rows each time. Lengths run
    from 1 to ``capacity``. Equal lengths are told apart by id and piece; repeated rows are
    each placed. An empty table gives an empty table.
    """
    found = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in found:
        counts[row["length"]] = row["count"]
    plan = segments(plan_sequences(counts, capacity))
    groups = np.clip(-(-counts // RANKED_TOGETHER), 1, MOST_GROUPS).tolist()

    names = pieces.columns
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(F.lit(groups), (F.col("length") + 1).cast("int")))
    grouped = pieces.withColumn("_group", group)
    before = (
        grouped.groupBy("length", "_group").count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_group")) - F.col("count"))
        .drop("count")
    )
    within = Window.partitionBy("length", "_group").orderBy(*[F.col(c) for c in names if c != "length"])
    ranked = grouped.withColumn("_rank", F.row_number().over(within).cast("long") - 1).join(before, ["length", "_group"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_rank")).alias("_rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan["length"] << 44) + plan["first"]
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            turn, place_in = np.divmod(rank - plan["first"][at], plan["each"][at])
            added = [pa.array(plan["sequence"][at] + turn), pa.array(plan["offset"][at] + place_in * length)]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)] + added, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(look_up, schema)


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int | None = END_ID,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids: a row per piece.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Texts are
    encoded once; the narrow table of pieces is kept in the shared folder. See ``cut_pieces``
    for nulls, empty texts and repeated rows.
    """
    return place(durable_copy(cut_pieces(docs, vocabulary, capacity, end_id, id_column, text_column), "pieces"), capacity)
