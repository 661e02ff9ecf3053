"""Repeated passages by difference-cover anchors, exact to the word.

A cover of a period ``V`` is a set of residues such that for any two starts some step below
``V`` takes both to residues of the set. Two equal passages of ``length`` words, wherever they
start, hence share a window of ``length - V + 1`` words at a cover position of both. So only
windows at cover positions are hashed (5 in 21). Where such an anchor is repeated, the windows
of full length around it are hashed in full (128 bits) and counted; those counted twice are
repeats. All rows are hashes and keys: nothing is paired with anything, so a passage that very
many documents share costs a row for each.

Equal texts are one text here, and within a text a hash is stated once, so copies and lists of
one word cost no more than others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import kept_on_disk, map_arrow, release_shuffles
from fleetloom.session import scratch_path

LENGTH = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd
_PACKED = 7  # bytes of a word that fit into a number beside its length
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(_PACKED + 1)], dtype=np.uint64)


def _white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


class WordHashes:
    """64-bit hashes of the words of a text.

    A word of up to seven bytes is a number by itself, made of its bytes and its length, and is only
    mixed, which keeps different ones different. Longer words are hashed one by one.
    """

    def words(self, text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text's bytes, and where each word starts and ends; words are runs of anything but ASCII white space."""
        raw = (text or "").encode("utf-8", "replace")
        white = np.ones(len(raw) + 2, dtype=bool)
        white[1:-1] = _white(np.frombuffer(raw, np.uint8))
        turn = np.flatnonzero(white[1:] != white[:-1])
        return raw, turn[0::2], turn[1::2]

    def hashes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        import xxhash

        size = ends - starts
        # the eight bytes from each place on
        eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
        out = (eights[starts] & _MASKS[np.minimum(size, _PACKED)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
        with np.errstate(over="ignore"):
            for shift in (31, 27, 33):  # each step can be undone
                out = (out ^ (out >> np.uint64(shift))) * np.uint64(_BASES[which])
        long = np.flatnonzero(size > _PACKED)
        if len(long):
            digest = (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest)[which]
            out[long] = np.fromiter((digest(raw[a:b], which) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
        return out ^ (out >> np.uint64(29))


def rolled(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """The hash of every run of ``width`` words, put together from runs of powers of two."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, size, base = np.zeros(n, np.uint64), 0, h, 1, np.uint64(_BASES[1 - which])
    with np.errstate(over="ignore"):
        rest = width
        while rest:
            if rest & 1:  # runs of this size stand next
                out = out * base + run[done : done + n]
                done += size
            rest >>= 1
            if rest:
                run = run[: len(run) - size] * base + run[size:]
                base, size = base * base, 2 * size
        return out ^ (out >> np.uint64(31))


def anchors(h: np.ndarray, length: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions and the hashes of the windows of ``length - period + 1`` words that start there."""
    found = rolled(h, length - period + 1)
    at = np.arange(len(found))
    at = at[np.isin(at % period, cover)]
    return at, found[at]


def candidates(at: np.ndarray, repeated: np.ndarray, n_words: int, length: int, period: int) -> np.ndarray:
    """Starts of the windows of ``length`` words that hold a repeated anchor where a cover can stand."""
    n = n_words - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    reach = np.zeros(n_words + 1, dtype=np.int64)
    here = at[repeated]
    np.add.at(reach, np.maximum(here - period + 1, 0), 1)
    np.add.at(reach, np.minimum(here + 1, n_words), -1)
    return np.flatnonzero(np.cumsum(reach)[:n] > 0)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes once each, and 2 for those that occur more than once, else 1."""
    values, counts = np.unique(h, return_counts=True)
    return values, np.minimum(counts, 2)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


def _spread(length: int, period: int, cover: tuple[int, ...]) -> None:
    apart = {(a - b) % period for a in cover for b in cover}
    if apart != set(range(period)) or period > length:
        raise ValueError(f"{cover} is no difference cover of {period} for passages of {length} words")


def distinct_texts(keyed: DataFrame, n: int) -> DataFrame:
    """One row ``k1, k2, text`` of each text of ``keyed``, as a table bucketed by ``k1`` in the shared folder.

    Copies are dropped in the reading task before the shuffle, so a group of copies sends one row
    from each task. Later joins by ``k1`` find the texts in place.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fresh.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    kind = "k1 long, k2 long, text string"
    dealt = map_arrow(keyed.select("k1", "k2", "text"), once, kind).repartition(n, "k1").mapInArrow(once, kind)
    name = f"texts_{uuid.uuid4().hex}"
    path = scratch_path(keyed.sparkSession, "texts")
    dealt.write.bucketBy(n, "k1").option("compression", "zstd").option("path", path).saveAsTable(name)
    del dealt
    release_shuffles(keyed.sparkSession)
    return keyed.sparkSession.table(name)


def _stated(texts: DataFrame, length: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``h, k1, n`` of every text's anchors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHashes()
        for batch in batches:
            keys, hs, ns = [], [], []
            for k1, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                h, n = _distinct(anchors(of.hashes(*of.words(text.as_py())), length, period, cover)[1])
                keys.append(np.full(len(h), k1, np.int64))
                hs.append(h)
                ns.append(n)
            if hs:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(hs)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(ns).astype(np.int32))], names=["h", "k1", "n"]
                )

    return map_arrow(texts.select("k1", "text"), each, "h long, k1 long, n int")


def _hits(stated: DataFrame, keys: list[str]) -> DataFrame:
    """``k1, hs``: of each text those first hashes that are stated more than once in all. Summed up before the shuffle."""
    again = stated.groupBy(*keys).agg(F.sum("n").alias("_all")).filter("_all > 1").select(*keys)
    found = stated.join(again.hint("shuffle_hash"), keys, "left_semi")
    return found.groupBy("k1").agg(F.collect_list(keys[0]).alias("hs"))


def _windows(texts: DataFrame, hits: DataFrame, length: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``h, h2, k1, n`` of every text's windows of full length around a repeated anchor."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHashes()
        for batch in batches:
            rows: list[list[np.ndarray]] = [[], [], [], []]
            for k1, text, hs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw, starts, ends = of.words(text.as_py())
                h = of.hashes(raw, starts, ends)
                at, anchor = anchors(h, length, period, cover)
                mine = np.isin(anchor.view(np.int64), hs.values.to_numpy(zero_copy_only=False))
                start = candidates(at, mine, len(h), length, period)
                if not len(start):
                    continue
                full, second = rolled(h, length), rolled(of.hashes(raw, starts, ends, 1), length, 1)
                h, first, n = np.unique(full[start], return_index=True, return_counts=True)
                for held, new in zip(rows, (h, second[start][first], np.full(len(h), k1, np.int64), np.minimum(n, 2).astype(np.int32))):
                    held.append(new)
            if rows[0]:
                h, h2, k, n = (np.concatenate(r) for r in rows)
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(h2), pa.array(k), pa.array(n)], names=["h", "h2", "k1", "n"])

    joined = texts.join(hits.hint("shuffle_hash"), "k1").select("k1", "text", "hs")
    return map_arrow(joined, each, "h long, h2 long, k1 long, n int")


def _kept(texts: DataFrame, hits: DataFrame, copied: DataFrame, length: int) -> DataFrame:
    """``k1, k2, n_words, n_removed, kept`` (the words that no repeated window covers, joined by one space).

    All windows of a copied text start elsewhere, too.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for text, hs, copy in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                raw, starts, ends = of.words(text.as_py())
                left = np.ones(len(starts), dtype=bool)
                if copy and len(starts) >= length:
                    left[:] = False
                elif hs.is_valid and len(starts) >= length:
                    full = rolled(of.hashes(raw, starts, ends), length).view(np.int64)
                    edge = np.zeros(len(starts) + 1, dtype=np.int64)
                    here = np.flatnonzero(np.isin(full, hs.values.to_numpy(zero_copy_only=False)))
                    np.add.at(edge, here, 1)
                    np.add.at(edge, here + length, -1)
                    left = np.cumsum(edge)[:-1] == 0
                words = raw.split()
                kept = words if left.all() else [w for w, k in zip(words, left.tolist()) if k]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["k1", "k2", "n_words", "n_removed", "kept"],
            )

    joined = texts.join(hits.hint("shuffle_hash"), "k1", "left").join(copied.hint("shuffle_hash"), "k1", "left")
    is_copy = F.coalesce(F.array_contains("copies", F.col("k2")), F.lit(False))
    return map_arrow(joined.select("k1", "k2", "text", "hs", is_copy), each, "k1 long, k2 long, n_words long, n_removed long, kept string")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_column: str = "doc_id", text_column: str = "text",
    of_kept=None,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs``.

    Words are runs of anything but ASCII white space, unchanged. A word is removed if a window of
    ``length`` words that covers it starts anywhere else too, in the same row or another; windows
    are judged on the input. ``kept`` is what is left, joined by one space. Null and empty texts
    have no words; rows with the same text, also repeated rows, are repeats of each other. Ids are
    carried along only, so null and repeated ones do no harm. ``of_kept`` turns the column of kept
    text into another (a digest, say) before texts meet their rows.
    """
    _spread(length, period, cover)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs[text_column], F.lit(""))
    keyed = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(length), text).alias("k2"), text.alias("text"))
    texts = distinct_texts(keyed, n)
    hits = kept_on_disk(_hits(_stated(texts, length, period, cover), ["h"]), "anchors")
    repeated = kept_on_disk(_hits(_windows(texts, hits, length, period, cover), ["h", "h2"]), "windows")
    keys = keyed.select("doc_id", "k1", "k2")
    copied = keys.groupBy("k1", "k2").count().filter("count > 1").groupBy("k1").agg(F.collect_list("k2").alias("copies"))
    per_text = _kept(texts, repeated, copied, length)
    if of_kept:
        per_text = per_text.withColumn("kept", of_kept(F.col("kept")))
    # a join of its own, which adaptive execution can split where very many rows have one text
    return keys.join(per_text, ["k1", "k2"]).select("doc_id", "n_words", "n_removed", "kept")
