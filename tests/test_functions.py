import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetloom.functions import text
from fleetloom.functions import values as v


def run(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_sanitize_keeps_printable_ascii_only(spark):
    assert run(spark, text.sanitize("x"), [("ma\x1b[31mra\nBAD",), ("é x~",), (None,)]) == ["ma[31mraBAD", " x~", None]


def test_type_list_trims_drops_blanks_and_keeps_first(spark):
    got = run(spark, text.parse_type_list("x"), [(" a.l , b.l,,a.l ,",), ("",), (" , ",), (None,)])
    assert got == [["a.l", "b.l"], [], [], []]


@pytest.mark.parametrize(
    "deployed, age",
    [
        ("24-July-2026", "30m"), ("23-July-2026", "24h"), ("22-July-2026", "2d"), ("4-July-2026", "20d"), ("04-July-2026", "20d"),
        ("2026-07-20", "?"), ("31-June-2026", "?"), ("", "?"), (None, "?"), ("25-July-2026", "-1410m"),
    ],
)
def test_age_label(spark, deployed, age):
    assert run(spark, v.age_label("x", "2026-07-24 00:30:00"), [(deployed,)]) == [age]


@pytest.mark.parametrize("raw, number", [("12", 12), (" 7 ", 7), ("1.5", 0), ("abc", 0), (None, 0), ("-3", -3), ("", 0)])
def test_to_int(spark, raw, number):
    assert run(spark, v.to_int("x"), [(raw,)]) == [number]


def test_to_bool_by_kind(spark):
    assert run(spark, v.to_bool("x"), [("TRUE",), ("true",), ("1",), ("yes",), (None,)]) == [True, True, False, False, None]
    assert run(spark, v.to_bool("x", "int"), [(2,), (0,), (None,)], "x int") == [True, False, None]
    assert run(spark, v.to_bool("x", "boolean"), [(True,), (False,)], "x boolean") == [True, False]


def test_to_list_keeps_duplicates_and_array_blanks(spark):
    assert run(spark, v.to_list("x"), [("a, ,b,a",), (None,)]) == [["a", "b", "a"], []]
    assert run(spark, v.to_list("x", "array"), [(["a", None, "", "b\x07"],), (None,)], "x array<string>") == [["a", "", "b"], []]


def test_clamp_reports_adjustment(spark):
    got = run(spark, v.clamp("x", 1, 500), [(0,), (1,), (500,), (501,), (None,)], "x int")
    assert [tuple(r) for r in got] == [(1, True), (1, False), (500, False), (500, True), (None, None)]


GPUS = "x array<struct<manufacturer:string,count:int>>"


@pytest.mark.parametrize(
    "gpus, count",
    [([("NVIDIA", 8)], 8), ([("AMD", 4)], 0), ([("AMD", 2), ("Nvidia", 4)], 4), ([("NVIDIA", None)], 0), ([(None, 3)], 0), ([], 0), (None, 0)],
)
def test_nvidia_gpu_count(spark, gpus, count):
    assert run(spark, v.nvidia_gpu_count("x"), [(gpus,)], GPUS) == [count]


@pytest.mark.parametrize(
    "vcpus, threads, on, usable",
    [(72, 2, True, 72), (72, 2, False, 36), (8, 1, False, 8), (128, 4, False, 32), (16, None, False, 16), (16, 0, False, 16), (None, 2, False, 0)],
)
def test_usable_vcpus(spark, vcpus, threads, on, usable):
    df = spark.createDataFrame([(vcpus, threads)], "v int, t int")
    assert df.select(v.usable_vcpus("v", "t", on)).first()[0] == usable


def test_price_labels(spark):
    df = spark.createDataFrame([(2.552, 2.552), (1.0, 2.5), (1.0, 1.0009), (None, None)], "lo double, hi double")
    assert [r[0] for r in df.select(v.price_range_label("lo", "hi")).collect()] == ["$2.552/hr", "$1.000–$2.500/hr", "$1.000/hr", None]
    assert df.select(v.price_range_label("lo", "hi", spot=True)).first()[0] == "~$2.552/hr spot"


def test_run_cost_of_a_short_run(spark):
    df = spark.createDataFrame([(0.17, 3, 25), (0.17, 3, 40)], "rate double, n int, minutes int")
    assert [round(r[0], 4) for r in df.select(v.run_cost("rate", "n", "minutes")).collect()] == [0.2125, 0.34]


def test_keys_in_names(spark):
    serial = run(spark, text.parse_serial("x"), [("alpha-two-05304110072026",), ("alpha-05301110072026",)])
    assert serial[0]["cluster"] == "alpha-two" and serial[0]["built_at"] is None
    assert str(serial[1]["built_at"]) == "2026-07-10 11:30:05"
    runs = run(spark, text.parse_run_id("x"), [("20260720_101112_55",), ("latest",)])
    assert (str(runs[0]["started_at"]), runs[0]["pid"]) == ("2026-07-20 10:11:12", 55)
    assert (runs[1]["started_at"], runs[1]["pid"]) == (None, None)
    path = run(spark, text.parse_results_path("x", "results"), [("s3://b/results/c1/c1-55/20260720_1/osu/latency.txt",)])[0]
    assert tuple(path) == ("c1", "c1-55", "20260720_1", "osu/latency.txt")


@pytest.mark.parametrize(
    "pattern, value, hit",
    [
        ("logs:*", "logs:DeleteLogGroup", True), ("logs:Delete*", "logs:DeleteLogGroup", True), ("logs:Create*", "logs:DeleteLogGroup", False),
        ("logs.DeleteLogGroup", "logs:DeleteLogGroup", False), ("a?c", "abc", True), ("a?c", "ac", False), ("a+(b)*", "a+(b)x", True), ("*", "a/b\nc", True),
    ],
)
def test_wildcards(spark, pattern, value, hit):
    df = spark.createDataFrame([(pattern, value)], "p string, v string")
    assert df.select(F.rlike("v", text.glob_to_regex("p"))).first()[0] is hit
    assert df.select(text.glob_match("v", text.glob_parts("p"))).first()[0] is hit


def test_wildcards_equal_their_expressions(spark):
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    rows = [(draw("ab*?é\n", 7), draw("abé\n", 9).rstrip("\n")) for _ in range(3000)]  # an expression lets a last line feed pass + [("", ""), ("*", ""), ("?", ""), ("**", "a"), ("a**b", "ab"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "p string, v string")
    both = df.select("p", "v", F.rlike("v", text.glob_to_regex("p")).alias("regex"), text.glob_match("v", text.glob_parts("p")).alias("glob"))
    assert both.where("NOT (regex <=> glob)").collect() == [] and both.where("glob").count() > 200


@pytest.mark.parametrize(
    "raw, number", [("12.5", 12.5), ("12abc", 12.0), ("abc", 0.0), ("-3e2x", -300.0), (".5", 0.5), ("NaN", 0.0), ("Infinity", 0.0), (None, 0.0), ("  7", 7.0)]
)
def test_leading_number(spark, raw, number):
    assert run(spark, text.leading_number("x"), [(raw,)]) == [number]


OK_STATES = [
    "idle", "mix", "mixed", "alloc", "allocated", "comp", "completing", "future", "resv", "reserved", "power_up", "powering_up",
    "power_down", "powering_down", "powered_down", "planned",
]
BAD_STATES = ["down", "drain", "drained", "draining", "fail", "failing", "unknown", "unk", "inval", "error", "maint", ""]


def test_flags_never_change_the_class_of_a_state(spark):
    for flag in ["", *"*+~#!%$@^-", "*~"]:
        got = run(spark, text.usable_state("x"), [(f" {s.upper()}{flag} ",) for s in OK_STATES + BAD_STATES])
        assert got == [True] * len(OK_STATES) + [False] * len(BAD_STATES), flag


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00\x85"), max_size=30), min_size=1, max_size=20))
def test_fields_split_like_any_white_space_reader(spark, lines):
    got = run(spark, text.fields("x"), [(line,) for line in lines])
    assert got == [line.split() for line in lines]
