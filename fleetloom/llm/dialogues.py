"""Repair of conversations: the cheapest edits that leave turns in order, by survivor-coalescence Viterbi.

Roles that are left must read: perhaps a system turn, then user and assistant in turn. Four states
tell how far that has got, and each keeps one survivor: its cost and its edits. Survivors are leaves
of a tree of backpointers whose nodes count their children. A node without any is let go; one with a
single child takes over that child's edits; what stands in the root is shared by all survivors and is
emitted at once. At most seven nodes are ever held, whose edits are one byte each.

Ties go to the edits that come first as text, over the whole conversation. Survivors of one step
have edited the same rows, so none is the beginning of another, and what is appended later cannot
change their order. The order of their complete unresolved edits is therefore carried along as
ranks, and a tie compares two ranks, then the new edits. A state that another one beats whatever
follows is dropped, so that survivors meet soon.

Faults are found on narrow rows: hashes of texts, equal rows counted in the task that read them.
Sorted narrow rows pass through one task a conversation as a stream, for each row's edit depends on
those before it; the edits come out in pieces, which meet the texts in a second sorted stream.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import map_arrow

WHITE = " \t\n\x0b\x0c\r"
RETURNED = "user", "assistant"
# fixed values: what each edit costs
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
PIECE = 4096  # edits of a conversation in one row

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ENDS = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}  # insertions that reach a legal end
#: ``(p, q)``: what it costs at most to go on from ``p`` as a survivor in ``q`` would, by deleting or adding a turn where the two differ.
_CATCH_UP = {
    (START, SYSTEM): 0, (START, USER): DELETE, (START, ASSISTANT): 0,
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): DELETE,
    (USER, START): INSERT, (USER, SYSTEM): DELETE, (USER, ASSISTANT): INSERT,
}
_LEGAL = {"su", "ua", "au"}


def _steps(initial: str, truncated: bool) -> list[tuple[int, list[tuple[int, int, bytes]]]]:
    """For each state, how a row may lead to it: from which state, at which cost, by which edits."""
    into: dict[int, list[tuple[int, int, bytes]]] = {q: [(q, DELETE, b"D")] for q in range(4)}
    extra = TRUNCATED if truncated else 0
    kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
    for source in range(4):
        state = source
        for inserted in range(3):
            before = b"I" * inserted, INSERT * inserted + extra
            into[_NEXT[state]].append((source, before[1] + REROLE, before[0] + b"R"))
            if kept is not None and (state == START if kept == SYSTEM else _NEXT[state] == kept):
                into[kept].append((source, before[1] + KEEP, before[0] + b"K"))
            state = _NEXT[state]
    return list(into.items())


_STEPS = {(initial, truncated): _steps(initial, truncated) for initial in ("s", "u", "a", "") for truncated in (False, True)}


class _Node:
    __slots__ = ("parent", "children", "edits")

    def __init__(self, parent: _Node | None, edits: bytes = b""):
        self.parent, self.children, self.edits = parent, [], bytearray(edits)


class Survivors:
    """The cheapest edits of a conversation whose rows are given one after another; what is settled goes to ``emit``."""

    def __init__(self, emit: Callable[[bytes], None]):
        self._emit = emit
        self._root = _Node(None)
        self.cost = {START: 0}
        self._leaf = {START: self._root}
        self._rank = {START: 0}

    @property
    def nodes(self) -> int:
        """Nodes held at present."""
        count = lambda node: 1 + sum(map(count, node.children))
        return count(self._root)

    def delete(self, times: int = 1) -> None:
        """Rows that must go."""
        for state, leaf in self._leaf.items():
            self.cost[state] += DELETE * times
            leaf.edits += b"D" * times
        self._settle()

    def row(self, initial: str, truncated: bool) -> None:
        """A row that may be kept, given another role or deleted."""
        cost, rank = self.cost, self._rank
        chosen: dict[int, tuple[int, int, bytes, int]] = {}
        for state, ways in _STEPS[initial if initial in ("s", "u", "a") else "", truncated]:
            best = None
            for source, price, edits in ways:
                if source in cost:
                    way = (cost[source] + price, rank[source], edits, source)
                    if best is None or way < best:
                        best = way
            if best is not None:
                chosen[state] = best
        for q in list(chosen):
            if any(p in chosen and chosen[p][0] + gap < chosen[q][0] for (p, other), gap in _CATCH_UP.items() if other == q):
                del chosen[q]
        self._advance(chosen)

    def end(self) -> int:
        """The cost of all; the rest is emitted."""
        _, _, _, state = min((c + INSERT * _ENDS[q], self._rank[q], q, q) for q, c in self.cost.items())
        total = self.cost[state] + INSERT * _ENDS[state]
        self._advance({state: (total, 0, b"I" * _ENDS[state], state)})
        return total

    def _advance(self, chosen: dict[int, tuple[int, int, bytes, int]]) -> None:
        uses: dict[int, list[int]] = {}
        for state, way in chosen.items():
            uses.setdefault(way[3], []).append(state)
        leaves: dict[int, _Node] = {}
        for source, leaf in self._leaf.items():
            states = uses.get(source, [])
            if len(states) == 1:
                leaf.edits += chosen[states[0]][2]
                leaves[states[0]] = leaf
            for state in states if len(states) > 1 else ():
                leaves[state] = _Node(leaf, chosen[state][2])
                leaf.children.append(leaves[state])
        gone = [leaf for source, leaf in self._leaf.items() if source not in uses]
        self._leaf, self.cost = leaves, {state: way[0] for state, way in chosen.items()}
        self._rank = {state: k for k, state in enumerate(sorted(chosen, key=lambda q: chosen[q][1:3]))}
        for leaf in gone:
            self._drop(leaf)
        self._settle()

    def _drop(self, leaf: _Node) -> None:
        """Let a leaf go; a parent that is left with one child becomes one with it."""
        parent = leaf.parent
        parent.children.remove(leaf)
        if len(parent.children) > 1:
            return
        (child,) = parent.children
        if len(parent.edits) < len(child.edits):
            child.edits[:0] = parent.edits
        else:
            parent.edits += child.edits
            child.edits = parent.edits
        child.parent = parent.parent
        if child.parent is None:
            self._root = child
        else:
            siblings = child.parent.children
            siblings[siblings.index(parent)] = child

    def _settle(self) -> None:
        if self._root.edits:
            self._emit(bytes(self._root.edits))
            self._root.edits.clear()


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` with the faults of a fixed rule, for trials; null roles and texts are one space."""
    one_space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", one_space("conv_id"), one_space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one_space("text"), "[.!?]", "")).otherwise(one_space("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.filter(kind != 0).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(kind == 4, "user").otherwise(one_space("role")).alias("role"), text.alias("text"), F.explode(copies)
    )
    return rows.select("conv_id", "turn", "role", "text")


def _with_faults(rows: DataFrame) -> DataFrame:
    """Rows with ``digest``, ``blank`` and ``truncated``; null roles and texts are one space."""
    numbers = [F.col(name).cast("long").alias(name) for name in ("conv_id", "turn")]
    filled = rows.select(*numbers, *[F.coalesce(name, F.lit(" ")).alias(name) for name in ("role", "text")])
    end: Column = F.rtrim(F.col("text"), F.lit(WHITE))
    last = F.substring(end, -1, 1)
    return filled.select(
        "conv_id", "turn", "role", "text", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"),
        (end == "").alias("blank"), ((end != "") & ~last.isin(".", "!", "?")).alias("truncated"),
    )


_KEY = ("conv_id", "turn", "role", "digest")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECES = "conv_id long, turn long, role string, digest binary, kind int, piece long, text string, " + ", ".join(f"{c} long" for c in _COUNTS)


def _sorted(df: DataFrame, *then: str) -> DataFrame:
    """Conversations dealt to tasks, each as one run of rows in order."""
    return df.repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (*_KEY, *then)])


def _narrow(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn as one with their number ``n``; ``again`` where the first of them stood in an earlier turn, too."""
    groups = rows.groupBy(*_KEY, "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeated = groups.filter(~F.col("blank")).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns"))
    first = repeated.filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = groups.join(first, groups["conv_id"].eqNullSafe(F.col("c")) & (groups["role"] == F.col("r")) & (groups["digest"] == F.col("d")), "left")
    again = F.coalesce(~F.struct(F.col("turn").isNotNull().alias("known"), "turn").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return met.select(*_KEY, "blank", "truncated", "n", again.alias("again"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the edits of sorted narrow rows, each at the key of the row that it begins with, and counts behind the last row."""
    out: list[tuple] = []
    schema = pa.schema([
        ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("kind", pa.int32()), ("piece", pa.int64()), ("text", pa.string()),
        *[(c, pa.int64()) for c in _COUNTS],
    ])

    def flushed() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    talk: _Talk | None = None
    for batch in batches:
        for conv, turn, role, digest, blank, truncated, n, again in zip(*[c.to_pylist() for c in batch.columns]):
            if talk is None or conv != talk.conv:
                if talk is not None:
                    talk.close()
                talk = _Talk(conv, out)
            talk.rows((conv, turn, role, digest), blank, truncated, n, again)
            if len(out) >= 1024:
                yield flushed()
    if talk is not None:
        talk.close()
    if out:
        yield flushed()


class _Talk:
    """Counts and edits of one conversation."""

    def __init__(self, conv: int | None, out: list[tuple]):
        self.conv, self._out = conv, out
        self._counts = dict.fromkeys(_COUNTS, 0)
        self._first: int | None = None
        self._turn: int | None = None
        self._turns = 0
        self._initial: str | None = None
        self._marks: deque[tuple[int, tuple]] = deque()  # places and keys of rows, ``PIECE`` apart, from the last one before the next edit on
        self._rows_in = self._rows_out = self._piece = 0
        self._settled = bytearray()
        self._key: tuple = ()
        self._survivors = Survivors(self._settled.extend)

    def rows(self, key: tuple, blank: bool, truncated: bool, n: int, again: bool) -> None:
        """``n`` equal rows."""
        _, turn, role, _ = key
        counts, initial = self._counts, role[:1]
        if turn is not None and turn != self._turn:
            self._first = turn if self._first is None else self._first
            self._turn, self._turns = turn, self._turns + 1
        if self._initial is not None:
            counts["illegal"] += self._initial + initial not in _LEGAL
        counts["illegal"] += n - 1  # no role may follow itself
        self._initial = initial
        self._key = key
        if not self._marks or self._rows_in >= self._marks[-1][0] + PIECE:
            self._marks.append((self._rows_in, key))
        self._rows_in += n
        if blank:
            counts["blank"] += n
            self._survivors.delete(n)
        elif again:
            counts["duplicate"] += n
            self._survivors.delete(n)
        else:
            counts["truncated"] += truncated
            counts["duplicate"] += n - 1
            self._survivors.row(initial, truncated)
            if n > 1:
                self._survivors.delete(n - 1)
        if len(self._settled) >= PIECE:
            self._put()

    def _put(self) -> None:
        """What is settled, at the key of a row at most ``PIECE`` before the one that it begins with."""
        for at in range(0, len(self._settled), PIECE):
            piece = self._settled[at : at + PIECE]
            while len(self._marks) > 1 and self._marks[1][0] <= self._rows_out:
                self._marks.popleft()
            self._out.append((*self._marks[0][1], 0, self._piece, piece.decode(), *[None] * len(_COUNTS)))
            self._rows_out += len(piece) - piece.count(b"I")
            self._piece += 1
        self._settled.clear()

    def close(self) -> None:
        self._counts["cost"] = self._survivors.end()
        if self._turn is not None:
            self._counts["gaps"] = self._turn - self._first + 1 - self._turns
        self._put()
        self._out.append((*self._key, 2, 0, None, *self._counts.values()))


def _stream(rows: DataFrame, of: DataFrame | None) -> DataFrame:
    """Pieces of edits, then texts, in the order of the conversation; a row of kind -1 for each of ``of``."""
    faulty = _with_faults(rows)
    narrow = _sorted(_narrow(faulty)).select(*_KEY, "blank", "truncated", "n", "again")
    pieces = map_arrow(narrow, _edits, _PIECES)
    empty = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    texts = faulty.select(*_KEY, F.lit(1).alias("kind"), F.lit(0).cast("long").alias("piece"), F.when(~F.col("blank"), F.col("text")).alias("text"), *empty)
    stream = pieces.unionByName(texts)
    if of is not None:
        key = F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest")
        asked = of.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        stream = stream.unionByName(asked.select("conv_id", *key, F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("piece"), F.lit(None).cast("string").alias("text"), *empty))
    return _sorted(stream, "kind", "piece")


class _Replay:
    """The repaired turns of one conversation, from its edits and texts in order."""

    def __init__(self) -> None:
        self._waiting = bytearray()
        self._at = 0
        self._state = START

    def learn(self, edits: str) -> None:
        del self._waiting[: self._at]
        self._at = 0
        self._waiting += edits.encode()

    def _returned(self) -> str:
        self._state = _NEXT[self._state]
        return RETURNED[self._state - USER]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self._at < len(self._waiting) and self._waiting[self._at] == 73:  # I
            self._at += 1
            yield "I", self._returned(), ""

    def turn(self, role: str, text: str | None) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what comes of one row."""
        yield from self.inserted()
        edit = chr(self._waiting[self._at])
        self._at += 1
        if edit == "K":
            self._state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield edit, role, text or ""
        elif edit == "R":
            yield edit, self._returned(), text or ""
        else:
            yield edit, role, ""


def _walk(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """``(conv, what)`` of a sorted stream: ``None`` as a conversation begins, its turns ``(edit, role, text)``, its counts as a dict."""
    conv, replay = object(), _Replay()
    for batch in batches:
        table = dict(zip(columns, batch.columns))
        kinds = [table[c].to_pylist() for c in ("conv_id", "role", "kind", "text")]
        counts = None
        for at, (key, role, kind, text) in enumerate(zip(*kinds)):
            if key != conv:
                conv, replay = key, _Replay()
                yield conv, None
            if kind == 0:
                replay.learn(text)
            elif kind == 1:
                for said in replay.turn(role, text):
                    yield conv, said
            elif kind == 2:
                for said in replay.inserted():
                    yield conv, said
                counts = counts or {c: table[c] for c in _COUNTS}
                yield conv, {c: counts[c][at].as_py() for c in _COUNTS}


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, position`` (from 0), ``role, text, edit`` (Keep, Rerole or Insert, by initial).

    ``rows`` has ``conv_id, turn`` (numbers), ``role, text``; other columns are not read. Null roles and texts are one
    space, rows of a null conversation make one conversation. Rows go by turn, nulls first, equal turns by
    role and then by the digest of the text, so equal rows of a turn stand together. A row is
    blank without any character beyond ASCII white space, a duplicate if its role and text stood
    before, truncated if its last such character is none of ``.!?``; the first fault counts.
    """
    stream = _stream(rows, None)
    columns = stream.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        position = 0
        names = ["conv_id", "position", "role", "text", "edit"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        for conv, what in _walk(batches, columns):
            if what is None:
                position = 0
            elif isinstance(what, tuple) and what[0] != "D":
                out.append((conv, position, what[1], what[2], what[0]))
                position += 1
                if len(out) >= 500:
                    yield flushed()
                    out.clear()
        if out:
            yield flushed()

    return map_arrow(stream, each, "conv_id long, position long, role string, text string, edit string")


def audit(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """What the cheapest repair of each conversation takes: counts of faults, ``cost``, the edits as ``audit`` and ``repaired_sha256``.

    ``of`` has the ``conv_id`` of all that are to be reported, also those without rows: zeros, no edits and the digest
    of nothing. The digest is of ``role:text`` of the repaired turns, joined by line feeds. See ``repaired``.
    """
    stream = _stream(rows, of)
    columns = stream.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
        kinds = [pa.int64()] * (1 + len(_COUNTS)) + [pa.string()] * 2
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        started, conv, counts, edits, digest, any_turn = False, None, dict.fromkeys(_COUNTS, 0), bytearray(), hashlib.sha256(), False
        row = lambda: (conv, *counts.values(), edits.decode(), digest.hexdigest())
        for key, what in _walk(batches, columns):
            if what is None:
                if started:
                    out.append(row())
                    if len(out) >= 500:
                        yield flushed()
                        out.clear()
                started, conv, counts, edits, digest, any_turn = True, key, dict.fromkeys(_COUNTS, 0), bytearray(), hashlib.sha256(), False
            elif isinstance(what, dict):
                counts = what
            else:
                edit, role, text = what
                edits += edit.encode()
                if edit != "D":
                    digest.update(("\n" if any_turn else "").encode() + f"{role}:{text}".encode())
                    any_turn = True
        if started:
            out.append(row())
            yield flushed()

    return map_arrow(stream, each, "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")
