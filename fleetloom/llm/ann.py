"""Approximate nearest neighbours by multi-index hashing.

A rotation learned from a bounded sample (principal axes, then alternating between codes and
the rotation that fits them best) turns every vector into a binary code. Codes are cut into
substrings, and every block of rows holds for each substring which rows have which value. A
code within ``radius`` of the query's differs in at most ``radius // m`` bits (one less in some)
of at least one of the ``m`` substrings, so probing those values finds all of them; they are
then ranked by the cosine of the original vectors. The radius is learned on the sample, as
the distance within which nearly all true neighbours lie. Every row is indexed.

Queries and rows meet in blocks: a task reads some stored blocks of either side and compares
each pair of them. No block is copied by a shuffle, and none passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.llm.common import map_arrow
from fleetloom.session import durable_copy

SAMPLE_ROWS = 10_000
SAMPLE_QUERIES = 256
SUBSTRING = 8  # bits
COVERED = 0.97  # share of the sample's true neighbours that the radius covers
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
FILE_BLOCKS = 16  # in one file of the index, about
SEED = 11


@dataclass(frozen=True)
class Hashing:
    """A learned code: bits are the signs of ``(unit vector - mean) @ rotation``; ``radius`` of a search."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def width(self) -> int:
        return len(self.mean)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A byte for each substring; rows of ``x`` are not zero."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.rotation > 0, axis=1)

    def reach(self, radius: int) -> list[int]:
        """How many bits each substring may differ in: by the pigeonhole principle one of them differs in no more."""
        m = self.bits // SUBSTRING
        least, rest = divmod(radius, m)
        return [least if j <= rest else least - 1 for j in range(m)]


def learn(x: np.ndarray, neighbours: int = 5, turns: int = 30, seed: int = SEED) -> Hashing:
    """Learn a code and radius from sample rows ``x``; there are as many bits as the width, to whole bytes."""
    width = x.shape[1]
    bits = max(SUBSTRING, -(-width // SUBSTRING) * SUBSTRING)
    draw = np.random.default_rng(seed)
    if len(x) <= neighbours:
        return Hashing(np.zeros(width), draw.normal(size=(width, bits)), bits)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    plain = np.zeros((width, bits))
    plain[:, :width] = axes[:, ::-1]
    plain[:, width:] = draw.normal(size=(width, bits - width))
    turn = np.linalg.qr(draw.normal(size=(bits, bits)))[0]
    projected = centred @ plain
    for _ in range(turns):
        codes = np.where(projected @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ projected)
        turn = (left @ right).T
    found = Hashing(mean, plain @ turn, bits)
    ask = draw.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
    near = unit[ask] @ unit.T
    near[np.arange(len(ask)), ask] = -np.inf
    best = np.argpartition(-near, neighbours - 1, axis=1)[:, :neighbours]
    codes = found.codes(x)
    apart = np.bitwise_count(codes[ask][:, None, :] ^ codes[best]).sum(axis=2)
    return Hashing(mean, found.rotation, int(np.quantile(apart, COVERED, method="higher")))


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of the rows that take part.

    Rows with a null id, and vectors that are null, empty, zero or hold a null or non-finite
    component, take no part.
    """
    v = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v")).dropna()
    finite = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    return v.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda a: a != 0))


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """Of the ``most`` rows of least hash of id, then least id, the vectors of the commonest width; and the number of all rows.

    Were each task to send its own least rows, the driver would get the sample once for every task. So rows
    are counted by the first 16 bits of the hash, those of the first bins that hold enough meet in one
    task, and the driver reads what that task chose.
    """
    spread = rows.withColumn("hash", F.xxhash64("vec_id"))
    first = F.shiftright("hash", 48)
    held = sorted(tuple(r) for r in spread.groupBy(first.alias("bin")).count().collect())
    total, cut = 0, -(1 << 15)
    for part, n in held:
        cut = part if total < most else cut
        total += n
    found = durable_copy(spread.filter(first <= cut).orderBy("hash", "vec_id").limit(most), "sample").select("hash", "vec_id", "v").toArrow()
    found = found.sort_by([("hash", "ascending"), ("vec_id", "ascending")])
    v = found["v"].combine_chunks()
    lengths = np.asarray(pa.compute.list_value_length(v))
    widths, times = np.unique(lengths, return_counts=True)
    width = int(widths[times.argmax()]) if len(widths) else 1
    return v.filter(pa.array(lengths == width, pa.bool_())).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), total


def _blocks(rows: DataFrame, hashing: Hashing, size: int) -> DataFrame:
    """Rows as blocks: ids, vectors, codes and their ``SubstringIndex`` as bytes. Vectors of another width than the learned one are left out."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        xs: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            x = np.concatenate(xs)
            held = SubstringIndex.of(hashing.codes(x))
            parts = [np.concatenate(ids).astype("<i8"), x.astype("<f8"), held.codes, held.rows, held.starts]
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], names=_names)

        for batch in batches:
            lists = batch.column(1)
            fits = np.asarray(pa.compute.list_value_length(lists)) == hashing.width
            flat = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, hashing.width)
            here = batch.column(0).to_numpy(zero_copy_only=False)[fits]
            for at in range(0, len(here), size):
                ids.append(here[at : at + size])
                xs.append(flat[at : at + size])
                held += len(ids[-1])
                if held >= size:
                    yield block()
                    ids, xs, held = [], [], 0
        if held:
            yield block()

    _names = ["ids", "vectors", "codes", "rows", "starts"]
    return map_arrow(rows, build, ", ".join(f"{n} binary" for n in _names))


class SubstringIndex:
    """For each substring, the row numbers of a block in order of its value, and where each value begins."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray, starts: np.ndarray):
        self.codes, self.rows, self.starts = codes, rows, starts

    @classmethod
    def of(cls, codes: np.ndarray) -> SubstringIndex:
        rows = np.argsort(codes, axis=0, kind="stable").T.astype(np.int32)
        starts = [np.searchsorted(codes[r, j], np.arange(257)) for j, r in enumerate(rows)]
        return cls(codes, rows, np.array(starts, dtype=np.int32).reshape(-1, 257))

    def probe(self, code: np.ndarray, reach: list[int], radius: int) -> np.ndarray:
        """Rows within ``radius`` of ``code``: those that a substring's probed values hold, then checked in full."""
        found = np.zeros(len(self.codes), dtype=bool)
        for j, most in enumerate(reach):
            if most >= 0:
                values = np.flatnonzero(_APART[code[j]] <= most)
                # values side by side make one run of rows
                runs = np.split(values, np.flatnonzero(np.diff(values) > 1) + 1)
                for run in runs:
                    found[self.rows[j, self.starts[j, run[0]] : self.starts[j, run[-1] + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


#: How many bits two values of a substring differ in.
_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def _nearest(ids, x, q_ids, q, within, k) -> tuple[list, list, list]:
    """The ``k`` rows of largest cosine for each query among its rows of ``within``; equal ones by id. No other row's cosine is worked out."""
    out: tuple[list, list, list] = ([], [], [])
    lengths = np.sqrt(np.multiply(x, x).sum(axis=1))
    for i, rows in enumerate(within):
        rows = rows[ids[rows] != q_ids[i]]
        if not len(rows):
            continue
        if len(rows) > 4 * k:
            about = (x[rows] @ q[i]) / (lengths[rows] * np.linalg.norm(q[i]))
            rows = rows[about >= np.partition(about, len(rows) - k)[len(rows) - k] - 1e-9]
        # each cosine on its own, so that equal vectors have equal scores wherever they stand
        score = np.multiply(x[rows], q[i]).sum(axis=1) / (lengths[rows] * np.sqrt(np.multiply(q[i], q[i]).sum()))
        best = np.lexsort((ids[rows], -score))[:k]
        out[0].extend([int(q_ids[i])] * len(best))
        out[1].extend(ids[rows][best].tolist())
        out[2].extend(score[best].tolist())
    return out


def _search(index: DataFrame, queries: DataFrame, hashing: Hashing, k: int, radius: int) -> DataFrame:
    """``query_id, vec_id, score``: the best ``k`` of some blocks of rows for every query.

    Every task has a share of either side, read where it is stored. The more shares the queries have, the fewer
    the rows are in, so that tasks are about as many as shuffle partitions and a query's candidates few.
    """
    width, m, reach = hashing.width, hashing.bits // SUBSTRING, hashing.reach(radius)
    slots = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = -(-slots // max(1, queries.rdd.getNumPartitions()))
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "codes")])
    # a plain cross join may broadcast a side
    pairs = index.coalesce(shares).hint("shuffle_replicate_nl").crossJoin(asked)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, x, codes, places, starts, q_ids, q, q_codes = (c[n].as_py() for c in batch.columns)
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                x, q = np.frombuffer(x, "<f8").reshape(-1, width), np.frombuffer(q, "<f8").reshape(-1, width)
                codes, q_codes = np.frombuffer(codes, np.uint8).reshape(-1, m), np.frombuffer(q_codes, np.uint8).reshape(-1, m)
                held = SubstringIndex(codes, np.frombuffer(places, np.int32).reshape(m, -1), np.frombuffer(starts, np.int32).reshape(m, -1))
                found = _nearest(ids, x, q_ids, q, [held.probe(c, reach, radius) for c in q_codes], k)
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(meet, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, radius: int | None = None, sample_rows: int = SAMPLE_ROWS,
    id_column: str = "vec_id", column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest rows of ``vectors`` for every row of ``queries``, by cosine.

    A query's own id is no candidate; equal cosines go by id. Rows that share an id are rows of their own,
    and queries that share one are answered together. The code is learned from at most
    ``sample_rows`` rows (least hash of id). ``radius`` bounds the Hamming distance of rows looked
    at; by default it is learned. A query that finds fewer than ``k`` rows in it is asked again
    without a bound. Rows that ``usable`` leaves out take no part on either side. No usable row or
    query gives an empty table.
    """
    rows = usable(vectors, id_column, column)
    sample, total = _sample(rows, sample_rows)
    hashing = learn(sample, k)
    blocks = -(-total // BLOCK_ROWS)
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = durable_copy(_blocks(rows.repartition(max(1, min(blocks, slots), -(-blocks // FILE_BLOCKS))), hashing, BLOCK_ROWS), "index")
    asked = usable(queries, id_column, column)
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.repartition(parts, "vec_id")
    q_blocks = durable_copy(_blocks(asked, hashing, QUERY_ROWS), "queries")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = durable_copy(top(_search(index, q_blocks, hashing, k, hashing.radius if radius is None else radius)), "found")
    enough = first.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    again = durable_copy(_blocks(asked.join(enough, "vec_id", "left_anti"), hashing, QUERY_ROWS), "queries")
    whole = top(_search(index, again, hashing, k, hashing.bits))
    done = first.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi")
    return done.unionByName(whole).select("query_id", "rank", "vec_id", "score")
