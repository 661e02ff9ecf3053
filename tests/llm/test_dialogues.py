"""Conversation repair against strings kept whole, all edits of short talks, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from fleetloom.llm import dialogues
from fleetloom.llm.queries import QUERIES

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """First fault of each ``(role, text)``."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_viterbi(rows):
    """Cost, edits and roles, by keeping the least whole strings of each beginning of the grammar."""
    best = {"": (0, "", ())}

    def closed(states):
        for _ in range(3):
            for end, (cost, edits, roles) in list(states.items()):
                new = "u" if end != "u" else "a"
                way = (cost + 5, edits + "I", (*roles, (new, None)))
                if new not in states or way[:2] < states[new][:2]:
                    states[new] = way
        return states

    for n, ((role, text), fault) in enumerate(zip(rows, faults(rows))):
        now = {}

        def offer(end, way):
            if end not in now or way[:2] < now[end][:2]:
                now[end] = way

        for end, (cost, edits, roles) in best.items():
            offer(end, (cost + 2, edits + "D", roles))
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault else 0
            for end, (cost, edits, roles) in closed(dict(best)).items():
                new = "u" if end != "u" else "a"
                offer(new, (cost + 1 + extra, edits + "R", (*roles, (new, n))))
                if role[:1] == new or role[:1] == "s" and end == "" and not roles:
                    offer(role[0], (cost + extra, edits + "K", (*roles, (role, n))))
        best = now
    cost, edits, roles = min((way for end, way in closed(best).items() if end in ("", "a")), key=lambda way: way[:2])
    long = {"u": "user", "a": "assistant"}
    said = [(long.get(role, role) if at is None or edits else role, "" if at is None else rows[at][1]) for role, at in roles]
    return cost, edits, said


def every_edit(rows):
    """The cheapest and least of all edits with at most two insertions between rows."""
    marks = faults(rows)
    best = None
    gaps = [("", 0), ("u", 5), ("a", 5), ("ua", 10), ("au", 10)]

    def options(n):
        role, fault = rows[n][0], marks[n]
        yield "D", 2, ""
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault else 0
            yield "K", extra, role[:1] or "?"
            yield "R", 1 + extra, "u"
            yield "R", 1 + extra, "a"

    for chosen in itertools.product(*[list(options(n)) for n in range(len(rows))]):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            roles = "".join(g + c[2] for (g, _), c in zip(inserted, chosen)) + inserted[-1][0]
            if GRAMMAR.match(roles):
                edits = "".join("I" * len(g) + c[0] for (g, _), c in zip(inserted, chosen)) + "I" * len(inserted[-1][0])
                cost = sum(c[1] for c in chosen) + sum(g[1] for g in inserted)
                best = min(best or (cost, edits), (cost, edits))
    return best


def survivors(rows):
    got = []
    talk = dialogues.Survivors(got.append)
    most = 0
    for (role, _), fault in zip(rows, faults(rows)):
        talk.delete() if fault in ("blank", "duplicate") else talk.row(role[:1], fault == "truncated")
        most = max(most, talk.nodes)
    return talk.end(), b"".join(got).decode(), most


def talk(rng, n, roles=("user", "assistant", "system", "tool", "")):
    return [(rng.choice(roles), rng.choice(["one.", "two!", "", "cut off", f"text {k}.", f"end {k}"])) for k in range(n)]


def test_edits_are_the_cheapest_of_all():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 3, 3):
        for _ in range(12):
            rows = talk(rng, n)
            assert survivors(rows)[:2] == every_edit(rows) if rows else survivors(rows)[:2] == (0, ""), rows


def test_edits_equal_whole_strings():
    rng = random.Random(6)
    for _ in range(3000):
        rows = talk(rng, rng.randrange(1, 14), rng.choice([("user",), ("user", "assistant"), ("user", "assistant", "system"), ("system", "assistant"), ("user", "assistant", "tool")]))
        cost, edits, _ = plain_viterbi(rows)
        got = survivors(rows)
        assert got[:2] == (cost, edits), rows
        assert got[2] <= 7


def test_long_talks_hold_little():
    """Talks that agree settle at once; one whose first edit depends on its length keeps a byte for each row and branch."""
    emitted = []
    talk = dialogues.Survivors(emitted.append)
    for k in range(20_000):
        talk.row("ua"[k % 2], False)
        if k > 10:
            assert sum(len(n.edits) for n in talk._leaf.values()) <= 8
    assert talk.end() == 0 and b"".join(emitted) == b"K" * 20_000
    emitted.clear()
    talk = dialogues.Survivors(emitted.append)
    for _ in range(20_001):
        talk.row("u", False)
    assert talk.nodes <= 7
    assert talk.end() == 2 + 10_000 and b"".join(emitted) == b"D" + b"KR" * 10_000


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        sp = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return out


def expected(rows):
    out = []
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        known = {t for t, _, _ in turns if t is not None}
        said = [t[1:] for t in turns]
        marks = faults(said)
        cost, edits, left = plain_viterbi(said)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        initials = [r[:1] for r, _ in said]
        out.append((
            conv, max(known) - min(known) + 1 - len(known) if known else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, digest,
        ))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_query_equals_brute_force(spark, data):
    table = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_conversation_repair"](spark, data)) == expected(table)


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_odd_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(dialogues, "PIECE", piece)
    rng = random.Random(7)
    texts = ["Well.", "So?", None, "", " \t", "no end", "a.b", "x" * 50_000 + ".", "Ünïcode!", "\x1f"]
    rows = [
        (rng.choice([None, 1, 2, 3, 70]), rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts))
        for _ in range(150)
    ] + [(8, k, "user", f"turn {k}.") for k in range(90)] + [(9, 3, "user", "same.")] * 40
    schema = "conv_id long, turn long, role string, text string"
    source = spark.createDataFrame([(*r, "x", 1, True) for r in rows], schema + ", digest string, kind int, blank boolean")
    assert got(dialogues.audit(dialogues.damage(source), of=source)) == expected(rows)
    empty = spark.createDataFrame([], schema)
    assert got(dialogues.audit(empty, of=empty)) == [] and dialogues.repaired(empty).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(dialogues.audit(empty, of=source.filter("conv_id = 8"))) == [(8, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_repaired_turns_have_the_digest(spark):
    rng = random.Random(8)
    rows = [(c, t, r, x) for c in range(20) for t, (r, x) in enumerate(talk(rng, rng.randrange(1, 9)))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = {}
    for r in sorted(dialogues.repaired(df).collect(), key=lambda r: (r["conv_id"], r["position"])):
        turns.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
        assert r["edit"] in "KRI"
    for r in dialogues.audit(df).collect():
        left = turns.get(r["conv_id"], [])
        assert [p for p, _ in left] == list(range(len(left)))
        assert hashlib.sha256("\n".join(t for _, t in left).encode()).hexdigest() == r["repaired_sha256"]
        assert GRAMMAR.match("".join(t[0] for _, t in left))
