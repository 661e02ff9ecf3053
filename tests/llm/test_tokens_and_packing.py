"""Token ids, packing (operator 2) and token files (operator 9)."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetloom.llm import packing, tokenfiles
from fleetloom.llm.tokens import word_ids
from fleetloom.session import scratch_path

SCHEMA = "doc_id long, text string, length string"
ROWS = [(5, "Hello, world. It's 12 km!", "x"), (1, None, "x"), (2, "", None), (3, "word " * 60, "y"), (3, "word " * 60, "y"), (None, "no id", "z"), (9, "Éa ǅ ﬁ İ. 日本", "q")]


@pytest.fixture(scope="module")
def library(vocabulary):
    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def ids_of(text, vocabulary):
    return np.frombuffer(word_ids(vocabulary).encode(text), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcABZéÉßΣİǅ .,'!?-_|12²½\n\t\r\x0b\x1c\x85\xa0 ́日<>")), max_size=40))
def test_words_one_by_one_give_the_ids_of_the_text(vocabulary, library, text):
    assert ids_of(text, vocabulary) == library(text)


def test_every_character_before_a_stop_or_comma(vocabulary, library):
    """A mark, a control character among them, forms one run with the stop behind it."""
    for c in map(chr, range(256)):
        for text in (f"a{c}. b", f"a{c}, b", f"{c}. b", f"one{c}.", f"{c},{c}. x", f"a.{c} b", f"a {c}, b"):
            assert ids_of(text, vocabulary) == library(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab1 .,")), st.characters(max_codepoint=255)), max_size=30))
def test_any_text_of_the_first_characters(vocabulary, library, text):
    assert ids_of(text, vocabulary) == library(text)


def test_documents_give_the_ids_of_the_library(spark, data, vocabulary, library):
    for row in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect():
        assert ids_of(row["text"], vocabulary) == library(row["text"])


def best_number_of_bins(lengths, capacity):
    """Exact by search; for a few pieces."""
    best = len(lengths)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity and bins[i] not in bins[:i]:
                place(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_loses_no_sequence(lengths):
    counts = np.bincount(lengths, minlength=21)
    left = counts.copy()
    fixed = packing.reduce_instance(left, 20)
    rest = [n for n in range(21) for _ in range(left[n])]
    assert sum(times for times, _ in fixed) + best_number_of_bins(rest, 20) == best_number_of_bins(lengths, 20)
    assert (counts - left == sum((times * np.bincount(p, minlength=21) for times, p in fixed), np.zeros(21, int))).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_every_piece_has_one_place(lengths):
    counts = np.bincount(lengths, minlength=51)
    placed = np.zeros(51, int)
    for times, pattern in packing.plan_sequences(counts, 50):
        assert times > 0 and sum(pattern) <= 50
        placed += times * np.bincount(pattern, minlength=51)
    assert (placed == counts).all()


def test_packing_of_odd_rows(spark, vocabulary, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.pack(docs, vocabulary, capacity=40).collect()
    texts = {i: t for i, t, _ in ROWS}
    assert sum(r["length"] for r in rows) == sum(len(library(t)) for _, t, _ in ROWS)
    by_sequence = {}
    for r in rows:
        part = library(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["start"] == 40 * r["piece"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 40
    assert packing.pack(docs.limit(0), vocabulary).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400))
def test_blocks_round_trip(values):
    block = tokenfiles.encode_block(np.array(values, dtype=np.uint32))
    assert tokenfiles.decode_block(b"xx" + block, 2, len(values)).tolist() == values


def test_images_give_any_range():
    ids = np.random.default_rng(0).integers(0, 49408, 1000).astype(np.uint32)
    image = tokenfiles.Image(tokenfiles.encode_image([7, None, -3], [0, 990, 10], ids, block_ids=64))
    assert image.doc_ids == [7, None, -3] and image.lengths.tolist() == [0, 990, 10]
    for start, end in ((0, 1000), (63, 65), (64, 64), (990, 2000), (128, 192)):
        assert (image.ids(start, end) == ids[start:end]).all()
    with pytest.raises(ValueError):
        tokenfiles.Image(b"something else")


def test_files_read_back_what_was_written(spark, vocabulary, library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    path = scratch_path(spark, "tokens")
    tokenfiles.write_token_files(docs, path, vocabulary, image_ids=20)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read_token_files(spark, path).collect())
    start, expected = 0, []
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library(text)
        expected.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    empty = scratch_path(spark, "tokens")
    tokenfiles.write_token_files(docs.limit(0), empty, vocabulary)
    assert tokenfiles.read_token_files(spark, empty).count() == 0
