"""Operators on small tables with results worked out by hand."""

import pytest
from helpers import one, values
from pyspark.sql import functions as F

from fleetloom.operators import benchmarks, cost, health, inventory, kernels, logs, policy, pricing, quality, queues


# --- cost ------------------------------------------------------------------------------


def cost_lines(spark):
    rows = [
        ("2026-06-24", "a", "12.34"), ("2026-07-23", "a", "5.00"), ("2026-07-24", "a", "99"), ("2026-06-23", "a", "99"),
        ("2026-07-01", "b", "not-a-number"), ("2026-07-02", "b", "5.00"), ("2026-07-03", "c", None), ("2026-07-04", "d", "0.0"),
    ]
    df = spark.createDataFrame(rows, "day string, tag string, amount string")
    return df.select(F.to_timestamp("day").alias("ts"), F.create_map(F.lit("ClusterID"), F.col("tag")).alias("tags"), "amount")


def test_cost_window_is_half_open_and_bad_amounts_drop_out(spark):
    got = cost.cost_by_tag(cost_lines(spark), key=F.col("tags")["ClusterID"], amount="amount", ts="ts", days=30, as_of="2026-07-24")
    assert {r["cluster"]: float(r["total"]) for r in got.collect()} == {"a": 17.34, "b": 5.0, "c": 0.0, "d": 0.0}


def test_cost_by_month_splits_the_same_total(spark):
    got = cost.cost_by_tag_month(cost_lines(spark), key=F.col("tags")["ClusterID"], amount="amount", ts="ts", days=30, as_of="2026-07-24")
    assert {(r["cluster"], str(r["month"])): float(r["total"]) for r in got.where("cluster = 'a'").collect()} == {
        ("a", "2026-06-01"): 12.34, ("a", "2026-07-01"): 5.0,
    }


@pytest.mark.parametrize("days", [0, -1, 366])
def test_days_out_of_range_are_an_error(spark, days):
    with pytest.raises(ValueError):
        cost.lookback_days(cost_lines(spark), "ts", days, "2026-07-24")


def test_days_without_a_limit(spark):
    assert cost.lookback_days(cost_lines(spark), "ts", 10**4, "2026-07-24", most=None).count() >= 1


def test_hours_reach_as_far_as_asked(spark):
    lines = cost_lines(spark)
    with pytest.raises(ValueError):
        cost.lookback_hours(lines, "ts", 0, "2026-07-24")
    old = spark.createDataFrame([("2020-01-01",)], "d string").select(F.to_timestamp("d").alias("ts"))
    assert cost.lookback_hours(old, "ts", 10**6, "2026-07-24").count() == 1


def test_cost_report_statuses(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "cluster string")
    records = spark.createDataFrame([("a", "ann", "r1"), ("b", "bob", "r1"), ("c", "ann", "r2")], "cluster string, owner string, region string")
    spend = spark.createDataFrame([("a", 3.5), ("b", 0.0)], "cluster string, total double")
    errors = spark.createDataFrame([("c", "denied")], "cluster string, error string")
    got = values(cost.cost_report(names, records, spend, errors), "cluster", "owner", "region", "total", "status")
    assert got == [
        ("a", "ann", "r1", 3.5, "value"), ("b", "bob", "r1", 0.0, "zero"), ("c", "ann", "r2", None, "unavailable"),
        ("x", "unknown", "unknown", 0.0, "zero"),
    ]
    assert values(cost.cost_report(names, records, spend, owner="ann"), "cluster") == [("a",), ("c",)]


def test_cost_labels(spark):
    df = spark.createDataFrame([(12.345, None), (0.0, None), (None, "denied")], "total double, error string")
    labels = [r[0] for r in df.select(cost.cost_label("total", "error")).collect()]
    assert labels[1:] == ["$0.00 *", "unavailable — denied"] and labels[0] in ("$12.34", "$12.35")
    assert spark.range(1).select(cost.period_label(30, "2026-07-24")).first()[0] == "2026-06-24 – 2026-07-24"


def test_tag_active_has_three_answers(spark):
    probes = spark.createDataFrame([(1, "k1", True), (2, "k2", True), (3, "k3", True), (4, "k1", False)], "probe int, key string, readable boolean")
    tags = spark.createDataFrame([("k1", "Inactive"), ("k1", "Active"), ("k2", "Inactive")], "tag string, status string")
    got = cost.tag_active(probes, tags, probe="probe", tag_key="key", key_column="tag", status="status")
    assert values(got, "probe", "active") == [(1, True), (2, False), (3, False), (4, None)]


# --- prices ----------------------------------------------------------------------------

DOC = '{"terms": {"OnDemand": {"T1": {"priceDimensions": {"D1": {"pricePerUnit": {"USD": "%s"}}}}}}}'


def test_ondemand_price_and_reasons(spark):
    wanted = spark.createDataFrame(
        [("c8g.2xlarge", "us-east-1"), ("m5.large", "us-east-1"), ("c8g.2xlarge", "mars-1"), ("bad.json", "us-east-1"), ("no.terms", "us-east-1")],
        "instance_type string, region string",
    )
    place = "US East (N. Virginia)"
    base = ("Linux", "NA", "Shared", "Used")
    catalog = spark.createDataFrame(
        [
            ("s2", "c8g.2xlarge", place, *base, DOC % "9.9"), ("s1", "c8g.2xlarge", place, *base, DOC % "0.3190400000"),
            ("s0", "c8g.2xlarge", place, "Windows", "NA", "Shared", "Used", DOC % "5"),
            ("s3", "bad.json", place, *base, "{nope"), ("s4", "no.terms", place, *base, '{"terms": {"OnDemand": {}}}'),
        ],
        "sku string, instance_type string, location string, operating_system string, preinstalled_sw string, tenancy string, capacity_status string, doc string",
    )
    got = {(r["instance_type"], r["region"]): (r["od_price"] and float(r["od_price"]), r["reason"]) for r in pricing.ondemand_price(wanted, catalog).collect()}
    assert got[("c8g.2xlarge", "us-east-1")] == (0.31904, None)
    assert got[("m5.large", "us-east-1")] == (None, "not found in price catalog")
    assert got[("c8g.2xlarge", "mars-1")] == (None, "region not in location map")
    assert got[("bad.json", "us-east-1")][1] == got[("no.terms", "us-east-1")][1] == "unexpected price document"


def test_location_map_has_no_empty_entry():
    from fleetloom.functions.fixed_values import REGION_LOCATIONS

    assert len(REGION_LOCATIONS) == 29 and all(REGION_LOCATIONS.values())


FLEET_SCHEMA = (
    "cluster_name string, region string, cluster_type string, headnode_instance_type string, cpu_instance_types array<string>, gpu_instance_types array<string>,"
    " enable_cpu_queue string, enable_gpu_queue string, max_cpu_queue_size int, max_gpu_queue_size int"
)


def fleet(spark, **change):
    row = dict(
        cluster_name="c", region="r", cluster_type="ondemand", headnode_instance_type="h", cpu_instance_types=["a"], gpu_instance_types=["g"],
        enable_cpu_queue="true", enable_gpu_queue="false", max_cpu_queue_size=8, max_gpu_queue_size=2,
    )
    row.update(change)
    return spark.createDataFrame([tuple(row.values())], FLEET_SCHEMA)


def priced(spark, inventory_df, od, spot=()):
    ondemand = spark.createDataFrame([(k, "r", p) for k, p in od.items()], "instance_type string, region string, od_price double")
    spots = spark.createDataFrame([(k, "r", p) for k, p in spot], "instance_type string, region string, spot_price double")
    return {r["role"]: r for r in pricing.fleet_hourly_cost(inventory_df, ondemand, spots).collect()}


def test_fleet_cost_scales_with_the_largest_size(spark):
    got = priced(spark, fleet(spark), {"h": 0.1, "a": 0.31904})
    assert set(got) == {"head", "cpu"}
    assert (got["head"]["od_low"], got["cpu"]["count"]) == (0.1, 8)
    assert got["cpu"]["od_low"] == got["cpu"]["od_high"] == pytest.approx(2.55232)
    assert got["cpu"]["spot_low"] is None and got["cpu"]["note"] is None


def test_fleet_cost_range_note_and_collapse(spark):
    two = fleet(spark, cpu_instance_types=["a", "b"], max_cpu_queue_size=1)
    assert priced(spark, two, {"a": 1.0, "b": 2.0})["cpu"]["od_high"] == 2.0
    assert priced(spark, two, {"a": 1.0, "b": 1.0005})["cpu"]["od_high"] == 1.0
    partial = priced(spark, two, {"a": 1.0})["cpu"]
    assert (partial["od_low"], partial["note"]) == (1.0, "1 type(s) unavailable")
    nothing = priced(spark, two, {"z": 1.0})["cpu"]
    assert (nothing["od_low"], nothing["note"]) == (None, None)


def test_spot_counts_only_types_with_an_ondemand_price(spark):
    two = fleet(spark, cluster_type="spot", cpu_instance_types=["a", "b"], max_cpu_queue_size=10)
    got = priced(spark, two, {"a": 1.0}, [("a", 0.4), ("b", 0.1)])["cpu"]
    assert (got["spot_low"], got["spot_high"]) == (4.0, 4.0)


@pytest.mark.parametrize("change", [{"enable_cpu_queue": "false"}, {"cpu_instance_types": []}, {"max_cpu_queue_size": 0}])
def test_queue_that_cannot_exist_has_no_row(spark, change):
    assert set(priced(spark, fleet(spark, **change), {"h": 1.0})) == {"head"}


def test_spot_prices_are_those_of_the_region(spark):
    both = fleet(spark, cluster_name="east", region="east", cluster_type="spot").unionByName(fleet(spark, cluster_name="west", region="west", cluster_type="spot"))
    types = "instance_type string, region string, {} double"
    ondemand = spark.createDataFrame([("a", "east", 1.0), ("a", "west", 1.0)], types.format("od_price"))
    rows = [("a", "us-east-1a", "east", "0.1", 1), ("a", "us-west-1b", "west", "0.9", 1)]
    history = spark.createDataFrame(rows, "instance_type string, availability_zone string, region string, spot_price string, ts int").withColumn("product", F.lit("Linux/UNIX"))
    spot = pricing.latest_spot_price(history, key=["instance_type", "region"], tiebreak="availability_zone")
    spot = spot.withColumn("spot_price", F.col("spot_price").cast("double"))
    got = {(r["cluster_name"], r["role"]): r["spot_low"] for r in pricing.fleet_hourly_cost(both, ondemand, spot).collect()}
    assert (got["east", "cpu"], got["west", "cpu"]) == (pytest.approx(0.8), pytest.approx(7.2))
    zones = {r[0] for r in history.select(pricing.region_of_zone("availability_zone")).collect()}
    assert zones == {"us-east-1", "us-west-1"}


def test_duplicate_types_count_twice_in_the_failures(spark):
    q = spark.createDataFrame([(1, ["a", "x", "x"])], "queue int, types array<string>")
    od = spark.createDataFrame([("a", 1.0)], "instance_type string, od_price double")
    spot = spark.createDataFrame([], "instance_type string, spot_price double")
    got = one(pricing.queue_price_range(q, od, spot, keys=["queue"], types="types", is_spot=F.lit(False)))
    assert (got["types_found"], got["types_failed"], got["note"]) == (1, 2, "2 type(s) unavailable")


def test_latest_spot_price_filters_before_picking(spark):
    rows = [("a", "z1", "VPC", "0.5", 1), ("a", "z1", "VPC", "0.6", 2), ("a", "z2", "VPC", "0.7", 3), ("a", "z1", "Other", "0.8", 4)]
    h = spark.createDataFrame(rows, "instance_type string, availability_zone string, product string, spot_price string, ts int")
    ties = "availability_zone"
    assert one(pricing.latest_spot_price(h, product="VPC", zone="z1", tiebreak=ties))["spot_price"] == "0.6"
    assert one(pricing.latest_spot_price(h, product=None, tiebreak=ties))["spot_price"] == "0.8"
    assert pricing.latest_spot_price(h, tiebreak=ties).count() == 0


# --- node states and health --------------------------------------------------------------


def node_counts(spark, lines, rc=0):
    rows = [("c", rc, n, line) for n, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "cluster string, rc int, line_no int, line string")
    return one(health.slurm_verdict(health.node_state_counts(df, key="cluster", rc="rc")))


@pytest.mark.parametrize(
    "lines, usable, unusable, verdict",
    [
        (["2 idle"], 2, 0, "PASS"), (["1 mixed", "3 allocated"], 4, 0, "PASS"), (["4 down*"], 0, 4, "FAIL"), (["2 idle", "3 down"], 2, 3, "PASS"),
        (["10 idle~"], 10, 0, "PASS"), (["  ", "", "1 idle"], 1, 0, "PASS"), (["slurm_load_partitions: Unable to contact"], 0, 1, "FAIL"),
        (["garbage"], 0, 1, "FAIL"), (["x idle", "2 idle extra"], 2, 1, "PASS"), (["", " "], 0, 0, "FAIL"),
    ],
)
def test_node_lines(spark, lines, usable, unusable, verdict):
    got = node_counts(spark, lines)
    assert (got["usable"], got["unusable"], got["verdict"]) == (usable, unusable, verdict)


def test_verdict_reasons_come_in_order(spark):
    assert node_counts(spark, ["4 idle"], rc=1)["detail"] == "sinfo returned rc=1"
    assert node_counts(spark, [" "])["detail"] == "sinfo reported no partitions"
    assert node_counts(spark, ["4 down"])["detail"].startswith("no usable nodes: 4")
    assert node_counts(spark, ["2 idle", "3 down"])["detail"] == "2 node(s) usable, 3 down/drained"
    assert node_counts(spark, ["2 idle"])["detail"] is None


def test_annotation_follows_the_header(spark):
    lines = [
        "Fri Jul 10 down", "NODELIST NODES PARTITION STATE CPUS", "down-1 1 gpu idle 4", "n2 1 cpu drained* 4", "n3 1", "n4 1 down mixed- 4", "n5 1 cpu STATE 3",
    ]
    df = spark.createDataFrame([("c", n, line) for n, line in enumerate(lines)], "cluster string, line_no int, line string")
    got = health.annotate_nodes(df, key="cluster")
    assert [r["marked"] for r in got.orderBy("line_no").collect()] == [False, False, False, True, False, False, True]


def test_lines_without_header_stay_unmarked(spark):
    df = spark.createDataFrame([("c", 0, "n1 down"), ("c", 1, "n2 down")], "cluster string, line_no int, line string")
    assert {r["marked"] for r in health.annotate_nodes(df, key="cluster").collect()} == {False}


def rollup(spark, monitoring=True, **checks):
    state = {c: True for c in health.CHECKS}
    state.update(checks)
    rows = [("c", name, ok, monitoring) for name, ok in state.items()]
    df = spark.createDataFrame(rows, "cluster string, check string, ok boolean, monitoring boolean")
    return one(health.check_rollup(df, key="cluster", monitoring="monitoring")).asDict()


def test_all_checks_pass(spark):
    got = rollup(spark)
    assert got["healthy"] and got["failures"] == 0 and all(got[c] == "PASS" for c in health.CHECKS)


def test_missing_record_stops_everything(spark):
    got = rollup(spark, record=False, storage=False)
    assert (got["record"], got["failures"], got["healthy"]) == ("FAIL", 1, False)
    assert all(got[c] is None for c in health.CHECKS if c != "record")


def test_failed_ssh_skips_the_node_checks(spark):
    got = rollup(spark, ssh=False, slurm=False, postinstall=False)
    assert [got[c] for c in ("ssh", "slurm", "postinstall", "grafana", "storage")] == ["FAIL", "SKIP", "SKIP", "SKIP", "PASS"]
    assert got["failures"] == 1


def test_head_address_states(spark):
    assert [rollup(spark, head_ip=False)[c] for c in ("head_ip", "ssh", "slurm")] == ["FAIL", "SKIP", "SKIP"]
    unknown = rollup(spark, stack=False, head_ip=None)
    assert [unknown[c] for c in ("stack", "head_ip", "ssh")] == ["FAIL", "SKIP", "SKIP"] and unknown["failures"] == 1


def test_grafana_only_with_monitoring(spark):
    got = rollup(spark, monitoring=False, grafana=False)
    assert got["grafana"] is None and got["healthy"]


def test_job_failures_leave_out_steps_and_old_jobs(spark):
    rows = [
        ("1", "FAILED", "2026-07-24 00:00:00"), ("2", "COMPLETED", "2026-07-24 00:00:00"), ("3.batch", "FAILED", "2026-07-24 00:00:00"),
        ("4", "NODE_FAIL", "2026-07-22 23:59:59"), ("5", "TIMEOUT", "2026-07-23 12:00:00"), ("6", "CANCELLED", "2026-07-24 11:00:00"),
    ]
    jobs = spark.createDataFrame(rows, "job_id string, state string, s string").withColumn("start", F.to_timestamp("s"))
    got = health.job_failures(jobs, hours=24, as_of="2026-07-24 12:00:00", columns=("job_id", "state"))
    assert values(got, "job_id") == [("1",), ("5",), ("6",)]
    assert health.job_failures(jobs, hours=1, as_of="2027-01-01", columns=("job_id",)).count() == 0


def test_cleanup_headline_and_orphans_are_independent(spark):
    steps = spark.createDataFrame(
        [("a", "keypair", True, False), ("a", "bucket", False, True), ("b", "role", False, False), ("c", "role", True, True)],
        "cluster string, resource string, failed boolean, retained boolean",
    )
    stack = spark.createDataFrame(
        [("a", "DELETE_COMPLETE"), ("b", "DELETE_IN_PROGRESS"), ("c", "DELETE_FAILED"), ("d", "Cluster d does not exist"), ("e", None)],
        "cluster string, text string",
    )
    got = {r["cluster"]: r for r in health.cleanup_report(steps, stack, key="cluster").collect()}
    assert (got["a"]["orphaned"], got["a"]["retained"], got["a"]["headline"], got["a"]["exit_failing"]) == (["keypair"], ["bucket"], "deleted", True)
    assert (got["b"]["headline"], got["b"]["exit_failing"]) == ("not confirmed", True)
    assert (got["c"]["headline"], got["c"]["orphaned"], got["c"]["retained"]) == ("DELETE_FAILED", ["role"], [])
    assert (got["d"]["headline"], got["d"]["exit_failing"]) == ("deleted", False)
    assert got["e"]["headline"] == "not confirmed"


# --- inventory -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, ok",
    [("alpha", True), ("a", True), ("a-1", True), ("1a", False), ("a-", False), ("a--b", False), ("Alpha", False), ("a" * 27, True), ("a" * 28, False), ("", False)],
)
def test_cluster_names(spark, name, ok):
    df = spark.createDataFrame([(name,)], "name string")
    assert inventory.valid_keys(df, "name").count() == int(ok)


def test_live_status_texts(spark):
    fleet_df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cluster_name string")
    snaps = spark.createDataFrame(
        [("a", 1, 0, "OLD", "OLD"), ("a", 2, 0, "CREATE_COMPLETE", None), ("b", 1, 0, None, None), ("c", 1, 1, "X", "Y")],
        "cluster_name string, ts int, rc int, cluster_status string, stack_status string",
    )
    got = dict(values(inventory.with_live_status(fleet_df, snaps, tiebreak=("rc",)), "cluster_name", "status"))
    assert got == {"a": "CREATE_COMPLETE / ?", "b": "? / ?", "c": "ERR", "d": "ERR"}
    assert {r["status"] for r in inventory.with_live_status(fleet_df, None).collect()} == {"LOCAL"}


def test_listed_architecture_beats_the_family(spark):
    df = spark.createDataFrame(
        [("c6gn.large", None), ("c5.large", ["arm64"]), ("c6g.large", ["x86_64"]), ("p5.48xlarge", None), ("g4ad.large", None), ("a1", None)],
        "t string, archs array<string>",
    )
    got = [(r["arch"], r["is_gpu"], r["needs_gdr"]) for r in inventory.family_flags(df, "t", "archs").collect()]
    assert got == [
        ("arm64", False, False), ("arm64", False, False), ("x86_64", False, False), ("x86_64", True, True), ("x86_64", True, False), ("x86_64", False, False),
    ]


def test_missing_records(spark):
    names = spark.createDataFrame([("a",), ("b",)], "cluster_name string")
    assert values(inventory.missing_records(names, names.where("cluster_name = 'a'")), "cluster_name") == [("b",)]


# --- logs ------------------------------------------------------------------------------


def test_log_group_needs_exactly_twelve_digits(spark):
    names = [
        "/logs/alpha-202601010000", "/logs/alpha-202607010000", "/logs/alpha-test-202608010000", "/logs/alpha-20260901000", "/logs/alpha-2026090100000",
        "/logs/alpha-20260901000x", "/logs/alpha-", "/other/alpha-202609010000",
    ]
    got = logs.latest_log_group(spark.createDataFrame([(n,) for n in names], "name string"), prefix="/logs/")
    assert values(got, "cluster", "log_group") == [("alpha", "/logs/alpha-202607010000"), ("alpha-test", "/logs/alpha-test-202608010000")]


def test_streams_match_by_content_and_last_event(spark):
    df = spark.createDataFrame([("g", "ip-1.cfn-init", 5), ("g", "ip-2.cfn-init", 9), ("g", "ip-1.slurmctld", 7)], "group string, stream string, last_event int")
    got = logs.match_streams(df, ["cfn-init", "slurmctld", "absent"], key="group")
    assert values(got, "token", "stream") == [("cfn-init", "ip-2.cfn-init"), ("slurmctld", "ip-1.slurmctld")]


def test_tail_is_exact_for_a_hot_stream(spark):
    events = spark.range(5000).select(F.when(F.col("id") < 4990, "hot").otherwise("cold").alias("stream"), (F.col("id") % 97).alias("ts"), "id")
    kept = logs.log_tail(events, key="stream", ts="ts", n=7, tiebreak="id", salts=8)
    rows = [tuple(r) for r in events.collect()]
    for stream in ("hot", "cold"):
        expected = sorted((r for r in rows if r[0] == stream), key=lambda r: (r[1], r[2]))[-7:]
        got = [tuple(r) for r in kept.where(F.col("stream") == stream).orderBy(F.desc("rank")).select("stream", "ts", "id").collect()]
        assert got == expected


@pytest.mark.parametrize("n, kept", [(2, ["b", "c"]), (0, []), (-3, []), (9, ["a", "b", "c"])])
def test_tail_of_nonblank_lines(spark, n, kept):
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(["a", " ", "b", "", "c", "\t"])], "file string, line_no int, line string")
    assert [r["line"] for r in logs.tail_nonblank(df, key="file", n=n).orderBy("line_no").collect()] == kept


def test_last_command_line(spark):
    lines = [("f", 1, "serial-1"), ("f", 2, "./build.py -N x  "), ("f", 3, "python build.py"), ("f", 4, "note"), ("g", 1, "nothing")]
    df = spark.createDataFrame(lines, "file string, line_no int, line string")
    got = logs.last_matching_line(df, logs.rebuild_line("line", "build.py"), key="file")
    assert values(got, "file", "last_line") == [("f", "python build.py"), ("g", None)]
    assert values(logs.first_line(df, key="file"), "file", "line") == [("f", "serial-1"), ("g", "nothing")]


# --- benchmarks ------------------------------------------------------------------------


def bench_lines(spark):
    files = {
        "cmd.txt": ["./bench.sh run --tests stream,osu,hpcg --nodes 2 --ppn 4 --hpcg-time 1800 --ior-size 1g"],
        "stream.txt": ["STREAM version", "Copy:   91000.5  0.1", "Triad:  92000.1  0.01 0.01 0.01", "Triad:  1.0"],
        "osu/latency.txt": ["# OSU latency", "1  1.20", "8  1.55", "8  9.99"],
        "osu/bandwidth.txt": ["# Size  Bandwidth (MB/s)", "1 5.0", "4096 120.5", "8192 120.5", "16384 -1", "x 7 8"],
        "ior.txt": ["access bw(MiB/s)", "write 1234.5 0.1", "read  2000.25 0.1"],
        "hpcg/HPCG-Benchmark_2.txt": ["Final: GFLOP/s rating of=99=x"],
        "hpcg/HPCG-Benchmark_1.txt": ["other", "Final Summary::HPCG result is VALID with a GFLOP/s rating of=12.3"],
        "hpcg/log.txt": ["GFLOP/s rating of=1"],
    }
    rows = [("c", "s", "20260720_1_1", f, n, line) for f, lines in files.items() for n, line in enumerate(lines)]
    rows.append(("c", "s", "20260721_1_1", "cmd.txt", 0, "./bench.sh run --tests stream --nodes 1 --ppn 1 --hpcg-time 60"))
    return spark.createDataFrame(rows, "cluster string, serial string, run_id string, relpath string, line_no int, line string")


def test_summary_of_a_full_and_an_empty_run(spark):
    got = {r["run_id"]: r for r in benchmarks.run_facts(benchmarks.benchmark_summary(bench_lines(spark))).collect()}
    full, bare = got["20260720_1_1"], got["20260721_1_1"]
    assert (full["stream_copy_mbs"], full["stream_triad_mbs"], full["stream_add_mbs"]) == (91000.5, 92000.1, None)
    assert (full["latency_us"], full["bandwidth_mbs"], full["bandwidth_size"]) == (1.55, 120.5, "4096")
    assert (full["ior_write_mibs"], full["ior_read_mibs"], full["hpcg_rating"]) == (1234.5, 2000.25, "12.3")
    assert (full["latency_gpu_us"], full["bandwidth_gpu_mbs"]) == (None, None)
    assert (full["total_ranks"], full["hpcg_valid"], full["osu_possible"], full["tests"]) == (8, True, True, "stream,osu,hpcg")
    assert (bare["bandwidth_mbs"], bare["hpcg_rating"], bare["total_ranks"], bare["hpcg_valid"], bare["osu_possible"]) == (None, None, 1, False, False)


def test_device_files_and_a_first_file_without_a_rating(spark):
    files = {
        "osu/latency_cuda.txt": ["8  2.5"], "osu/bandwidth_cuda.txt": ["1 5.0", "2 7.5", "4 7.5"], "stream.txt": ["Scale: 3.0", "Add: 4.0"],
        "hpcg/HPCG-Benchmark_1.txt": ["Setup"], "hpcg/HPCG-Benchmark_2.txt": ["GFLOP/s rating of=9"],
    }
    rows = [("c", "s", "1", f, n, line) for f, lines in files.items() for n, line in enumerate(lines)]
    got = one(benchmarks.benchmark_summary(spark.createDataFrame(rows, "cluster string, serial string, run_id string, relpath string, line_no int, line string")))
    assert (got["latency_gpu_us"], got["bandwidth_gpu_mbs"], got["bandwidth_gpu_size"], got["hpcg_rating"]) == (2.5, 7.5, "2", None)
    assert (got["stream_scale_mbs"], got["stream_add_mbs"], got["latency_us"]) == (3.0, 4.0, None)


def test_stack_verdict(spark):
    rows = [
        ("ok", 0, '{"clusterStatus": "CREATE_COMPLETE", "headNode": {"publicIpAddress": "1.1.1.1", "privateIpAddress": "10.0.0.1"}}'),
        ("private", 0, '{"clusterStatus": "UPDATE_COMPLETE", "cloudFormationStackStatus": "X", "headNode": {"privateIpAddress": "10.0.0.1"}}'),
        ("bare", 0, "{}"), ("broken", 0, "oops"), ("failed", 2, None), ("mute", None, None), ("null", 0, None),
    ]
    verdicts = health.stack_verdict(spark.createDataFrame(rows, "cluster string, rc int, text string"), key="cluster")
    got = {r["cluster"]: (r["ok"], r["detail"], r["head_ip"]) for r in verdicts.collect()}
    assert got == {
        "ok": (True, "clusterStatus=CREATE_COMPLETE", "1.1.1.1"),
        "private": (False, "clusterStatus=UPDATE_COMPLETE cloudFormationStackStatus=X", "10.0.0.1"),
        "bare": (False, "clusterStatus=UNKNOWN cloudFormationStackStatus=UNKNOWN", ""),
        "broken": (False, "unexpected describe response", None), "failed": (False, "describe call failed (rc=2)", None),
        "mute": (False, "describe call failed (rc=none)", None), "null": (False, "unexpected describe response", None),
    }
    both = health.stack_verdict(spark.createDataFrame(rows[:2], "cluster string, rc int, text string"), key="cluster", ok_statuses=("CREATE_COMPLETE", "UPDATE_COMPLETE"))
    assert {r["ok"] for r in both.collect()} == {True}
    checks = values(health.stack_checks(verdicts, key="cluster").where("cluster in ('ok', 'bare', 'failed')"), "cluster", "check", "ok")
    assert checks == [("bare", "head_ip", False), ("bare", "stack", False), ("failed", "head_ip", None), ("failed", "stack", False), ("ok", "head_ip", True), ("ok", "stack", True)]


def test_log_tail_is_not_cut(spark):
    events = spark.range(2000).select(F.lit("s").alias("stream"), "id", F.col("id").alias("ts"))
    assert logs.log_tail(events, key="stream", ts="ts", n=1000, tiebreak="id").count() == 1000
    with pytest.raises(ValueError):
        logs.log_tail(events, key="stream", ts="ts", n=0, tiebreak="id")


def test_unknown_layers_do_not_count(spark):
    df = spark.createDataFrame([("k", "elsewhere", "1"), ("k", "hard", "2"), ("only", "elsewhere", "3")], "key string, layer string, value string")
    assert values(quality.layered_resolve(df, key="key"), "key", "layer", "value") == [("k", "hard", "2")]


def test_peak_takes_the_first_maximum(spark):
    lines = bench_lines(spark).where("relpath = 'osu/bandwidth.txt'")
    got = one(benchmarks.peak(lines, key="run_id"))
    assert (got["size"], got["peak_text"], got["peak"]) == ("4096", "120.5", 120.5)


def test_latest_run_is_a_text_maximum(spark):
    runs = spark.createDataFrame([("d", "20260720_1_9"), ("d", "20260720_1_10"), ("d", "tmp"), ("e", "x")], "results_dir string, run_id string")
    assert values(benchmarks.latest_run(runs, key="results_dir"), "results_dir", "run_id") == [("d", "20260720_1_9")]


def test_bands_match_brute_force(spark):
    numbers = [-1.0, 0.0, 0.5, 1.999, 2.0, 19.9, 20.0, 49.99, 50.0, 100.0, 1e9, float("inf"), float("nan")]
    measured = spark.createDataFrame([(m, v) for m in ("latency_us", "bandwidth_gbs") for v in numbers], "metric string, value double")
    bands = benchmarks.documented_bands(spark)
    got = values(benchmarks.expected_band(measured, bands), "metric", "value", "band")
    from fleetloom.functions.fixed_values import BENCHMARK_BANDS

    expected = [
        (m, v, label) for m in ("latency_us", "bandwidth_gbs") for v in numbers for metric, label, lo, hi in BENCHMARK_BANDS
        if metric == m and v >= lo and (hi is None or v < hi)
    ]
    assert got == sorted(expected, key=repr)


def test_range_match_with_many_overlapping_ranges(spark):
    points = spark.range(400).select(F.lit("k").alias("k"), (F.col("id") * 1.7 - 100).alias("value"))
    ranges = spark.range(60).select(
        F.lit("k").alias("k"), (F.col("id") * 9.3 - 120).alias("low"), F.when(F.col("id") % 7 != 0, F.col("id") * 11.1 - 90).alias("high"), F.col("id").alias("n")
    )
    matched = kernels.range_match(points, ranges, key="k", value="value", bins=8)
    assert "SortMergeJoin" in matched._jdf.queryExecution().executedPlan().toString()
    got = {(r["value"], r["n"]) for r in matched.collect()}
    spans = [(r["low"], r["high"], r["n"]) for r in ranges.collect()]
    assert got == {(v, n) for (v,) in points.select("value").collect() for lo, hi, n in spans if v >= lo and (hi is None or v < hi)}


def test_ranges_of_skewed_values_and_open_ends(spark):
    """Most values lie close together; open ranges are never copied, closed ones at most once for each part."""
    rows = [("a", 1000.0 + k / 1000) for k in range(500)] + [("a", v) for v in (-5.0, 0.0, 1e12, float("nan"), None)] + [("b", 7.0)] * 3 + [("c", 1.0)]
    spans = [("a", 1000.1, 1000.2, 0), ("a", 1000.0, None, 1), ("a", -1e300, None, 2), ("a", 3.0, 3.0, 3), ("a", 5.0, 4.0, 4), ("a", None, 9.0, 5), ("a", 2000.0, None, 6), ("b", 7.0, 7.5, 7), ("b", 7.1, None, 8), ("d", 0.0, None, 9)]
    spans += [("a", 1000.0 + k / 100, 1000.0 + k / 100 + 0.05, 10 + k) for k in range(50)]
    points = spark.createDataFrame(rows, "k string, value double")
    ranges = spark.createDataFrame(spans, "k string, low double, high double, n int")
    matched = kernels.range_match(points, ranges, key="k", value="value")
    assert "CartesianProduct" not in (plan := matched._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    got = sorted((r["k"], r["value"], r["n"]) for r in matched.collect())
    assert got == sorted((k, v, n) for k, v in rows if v is not None and v == v for of, lo, hi, n in spans if of == k and lo is not None and v >= lo and (hi is None or v < hi))
    assert kernels.range_match(points.limit(0), ranges, key="k", value="value").count() == 0
    assert kernels.range_match(points, ranges.limit(0), key="k", value="value").count() == 0


def test_a_part_with_many_pairs_is_split(spark, monkeypatch):
    """Equal values lie in one part, which one task would compare with all ranges."""
    monkeypatch.setattr(kernels, "GROUP_PAIRS", 20, raising=False)
    monkeypatch.setattr(kernels, "TASK_PAIRS", 10, raising=False)
    points = spark.createDataFrame([("k", 5.0, n) for n in range(300)], "k string, value double, row int")
    ranges = spark.createDataFrame([("k", 1.0, 9.0 if n % 2 == 0 else None, n) for n in range(40)], "k string, low double, high double, n int")
    got = kernels.range_match(points, ranges, key="k", value="value").withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["row"], r["n"]) for r in got) == [(p, n) for p in range(300) for n in range(40)]
    assert len({r["task"] for r in got if r["high"]}) > 1 and len({r["task"] for r in got if not r["high"]}) > 1


# --- quality ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "rule, good, bad",
    [
        (quality.owner_ok, ["ann", "7up", "a-b"], ["Ann", "-a", "a-", "a--b", ""]),
        (quality.zone_ok, ["us-east-1a", "us-gov-west-1a", "us-iso-east-1b"], ["us-east-1", "useast1a", ""]),
        (quality.region_ok, ["us-east-1", "us-gov-west-1"], ["us-east-1a", "us_east_1"]),
        (quality.base_os_ok, ["ubuntu2404", "rhel9arm", "alinux2023"], ["rhel8", "rhel10", "ubuntu"]),
        (quality.queue_name_ok, ["q", "gpu-1", "a" * 16], ["default", "a" * 17, "1q", "q-", "a--b", "Q"]),
        (quality.instance_type_ok, ["c5.2xlarge", "u-6tb1.56xlarge", "c8g.metal-24xl"], ["c5", "c5.2x large", "c5.;rm", ".x", "a.b."]),
        (quality.shared_dir_ok, ["/shared", "/a b"], ["shared", "/", "/a$b", "/a;b", '/a"b', "/a\\b", "/a\nb", "/a`b", "/a|b"]),
        (quality.email_ok, ["a@b.c"], ["a@b", "a b@c.d", "a@@b.c"]),
        (quality.checksum_ok, ["sha256:" + "aF" * 32], ["sha256:" + "a" * 63, "md5:" + "a" * 64, "sha256:" + "g" * 64, "sha256:" + "a" * 65]),
        (quality.version_ok, ["v1.2", "v1.2.3"], ["1.2", "v1", "v1.2.3.4"]),
        (quality.ranks_ok, ["0", "1", "9999999"], ["01", "10000000", "-1", "x", ""]),
        (quality.bucket_name_ok, ["a" * 63], ["a" * 64]),
    ],
)
def test_rules(spark, rule, good, bad):
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert [r[0] for r in df.select(rule("v")).collect()] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(
    "size, ok", [(1200, True), (2400, True), (4800, True), (7200, True), (3600, False), (6000, False), (8400, False), (0, False), (-2400, False), (600, False)]
)
def test_lustre_size(spark, size, ok):
    df = spark.createDataFrame([(size, True, False)], "s int, on boolean, off boolean")
    got = df.select(quality.fsx_size_ok("s", "on"), quality.fsx_size_ok("s", "off")).first()
    assert tuple(got) == (ok, True)


def test_queue_sizes_and_arch_rules(spark):
    df = spark.createDataFrame([(0, 0, 1), (-1, 5, 1), (6, 5, 1), (1, 5, 0), (1, 5, 1)], "i int, m int, idle int")
    assert [r[0] for r in df.select(quality.queue_sizes_ok("i", "m", "idle")).collect()] == [True, False, False, False, True]
    assert df.select(quality.queue_sizes_ok("i", "m", "idle", added=True)).first()[0] is False
    pairs = spark.createDataFrame([("ubuntu2404", "c8g.x"), ("ubuntu2404arm", "c8g.x"), ("ubuntu2404arm", "c5.x"), ("rhel9", "c5.x")], "os string, t string")
    assert [r[0] for r in pairs.select(quality.os_arch_ok("os", "t")).collect()] == [False, True, False, True]
    kinds = spark.createDataFrame([(["g5.x", "p5.x"], True), (["g5.x", "c5.x"], True), (["g5.x"], False), (["c5.x", "c8g.x"], False)], "t array<string>, gpu boolean")
    assert [r[0] for r in kinds.select(quality.queue_kind_ok("t", "gpu")).collect()] == [True, False, False, False]


def test_absent_value_breaks_its_rule(spark):
    df = spark.createDataFrame([(1, None), (2, "us-east-1a")], "id int, az string")
    assert values(quality.rule_violations(df, {"zone": quality.zone_ok("az")}, key="id"), "id", "rule") == [(1, "zone")]


@pytest.mark.parametrize(
    "kind, size, iops, throughput, first",
    [
        ("gp3", 100, 3000, 125, None), ("gp3", 0, 1, 1, "size_min"), ("gp3", 16385, 3000, 125, "size_max"), ("gp3", 100, 2999, 125, "iops_range"),
        ("gp3", 10, 6000, 125, "iops_per_gib"), ("gp3", 100, 3000, 124, "throughput_range"), ("gp3", 100, 3000, 1000, "throughput_per_iops"),
        ("gp3", 100, 4000, 1000, None), ("io1", 3, 100, 0, "size_min"), ("io1", 4, 201, 0, "iops_per_gib"), ("io1", 4, 200, 0, None),
        ("io2", 65536, 256000, 0, None), ("gp2", 16384, 0, 0, None), ("st1", 499, 0, 0, "size_min"), ("standard", 1025, 0, 0, "size_max"), ("new9", 20000, 0, 0, "size_max"),
    ],
)
def test_volume_limits(spark, kind, size, iops, throughput, first):
    df = spark.createDataFrame([(kind, size, iops, throughput)], "k string, s long, i long, t long")
    got = df.select(quality.volume_violation(F.col("s"), F.col("k"), F.col("i"), F.col("t"))).first()[0]
    assert got == first


def test_volume_of_a_disabled_queue_is_not_checked(spark):
    columns = {f"{v}_{m}": ("gp2" if m == "type" else 0) for v in quality.VOLUMES for m in ("type", "size", "iops", "throughput")}
    columns.update(id="c", enable_cpu_queue=False, enable_gpu_queue=True, headnode_size=10)
    got = quality.volume_bounds(spark.createDataFrame([columns]), key="id")
    assert values(got, "volume", "violation") == [("gpu", "size_min"), ("shared", "size_min")]


def test_bucket_pairs(spark):
    rows = [("UNDEFINED", "b", "i", "e"), ("b", "UNDEFINED", "i", "e"), ("b", "c", "i", "e"), ("b", "b", "i", "i"), ("b", "b", "i", "e")]
    df = spark.createDataFrame(rows, "import_bucket string, export_bucket string, import_path string, export_path string")
    assert [(r["status"], r["effective_bucket"], r["effective_path"]) for r in quality.bucket_pair_status(df).collect()] == [
        ("error_no_import", None, None), ("warn_export_defaults_to_import", "b", "i"), ("error_buckets_differ", None, None), ("warn_same_path", "b", "i"), ("ok", "b", "e"),
    ]


def test_layers(spark):
    rows = [
        ("cli", "a", "1"), ("file", "a", "2"), ("hard", "a", "3"), ("cli", "b", None), ("file", "b", None), ("hard", "b", "3"), ("hard", "c", "10"),
        ("file", "d", "0"), ("hard", "d", "10"), ("file", "e", "x"), ("cli", "f", "x"), ("cli", "g", None), ("hard", "g", "7"),
    ]
    df = spark.createDataFrame(rows, "layer string, key string, value string")
    got = {r["key"]: (r["layer"], r["value"], r["typed"], r["invalid"]) for r in quality.layered_resolve(df, key="key", cast="int").collect()}
    assert got == {
        "a": ("cli", "1", 1, False), "b": ("file", None, None, False), "c": ("hard", "10", 10, False), "d": ("file", "0", 0, False),
        "e": ("file", "x", None, True), "f": ("cli", "x", None, False), "g": ("hard", "7", 7, False),
    }


# --- queues ----------------------------------------------------------------------------

QUEUE = "struct<name:string,capacity_type:string,resources:array<struct<min:int,max:int,instances:array<string>>>>"


def test_queue_summary_does_not_multiply_sizes(spark):
    q = ("gpu", "SPOT", [(1, 10, ["g5.x", "c5.x", "c5.x"]), (2, 5, None), (None, None, ["c5.x"])])
    df = spark.createDataFrame([("c", 0, q), ("c", 1, ("bare", "ONDEMAND", None))], f"cluster string, pos int, queue {QUEUE}")
    got = queues.queue_summary(df).orderBy("pos").collect()
    assert (got[0]["min_count"], got[0]["max_count"], got[0]["kind"], got[0]["types"]) == (3, 15, "gpu", ["g5.x", "c5.x", "c5.x", "c5.x"])
    assert (got[1]["min_count"], got[1]["max_count"], got[1]["kind"], got[1]["types"]) == (0, 0, "compute", [])


@pytest.mark.parametrize("types, ranks, devices", [(["a", "b", "c"], 8, 8), (["a", "zz"], 1, 0), ([], 0, 0), (None, 0, 0), (["a"], 32, 32)])
def test_ranks(spark, types, ranks, devices):
    q = spark.createDataFrame([(1, types)], "queue int, types array<string>")
    info = spark.createDataFrame([("a", 32), ("b", 8), ("c", 16)], "instance_type string, n int")
    assert one(queues.ranks_per_queue(q, info, key="queue", type_list="types", count="n"))["ranks"] == ranks
    assert one(queues.ranks_per_queue(q, info, key="queue", type_list="types", count="n", floor=None))["ranks"] == devices


def test_architecture_of_clusters(spark):
    rows = [("arm", "c8g.x", "arm64"), ("arm", "m7g.x", "arm64"), ("mix", "c8g.x", "arm64"), ("mix", "c5.x", "x86_64"), ("mix", "c5.x", "x86_64"), ("none", None, "x86_64")]
    got = {r["cluster"]: r for r in queues.arch_consistency(spark.createDataFrame(rows, "cluster string, instance_type string, arch string"), key="cluster").collect()}
    assert (got["arm"]["arch"], got["arm"]["mixed"], got["arm"]["detail"]) == ("arm64", False, None)
    assert (got["mix"]["arch"], got["mix"]["mixed"], got["mix"]["detail"]) == (None, True, "c5.x=x86_64, c8g.x=arm64")
    assert (got["none"]["arch"], got["none"]["mixed"]) == (None, False)


def test_capability_falls_back_only_when_the_live_set_is_empty(spark):
    table = lambda *ts: spark.createDataFrame([(t,) for t in ts], "instance_type string")
    wanted, static = table("a", "b", "c"), table("a", "b")
    assert values(queues.not_capable(wanted, table("c"), static), "instance_type") == [("a",), ("b",)]
    assert values(queues.not_capable(wanted, table(), static), "instance_type") == [("c",)]


def test_first_member_and_ambiguity(spark):
    df = spark.createDataFrame([("v", "z1", "s2", True), ("v", "z1", "s1", False), ("v", "z2", "s3", True)], "vpc string, zone string, subnet_id string, private boolean")
    assert values(queues.first_per_group(df, key=["vpc", "zone"], order="subnet_id"), "zone", "subnet_id", "ambiguous") == [("z1", "s1", True), ("z2", "s3", False)]
    assert values(queues.first_per_group(df, key=["vpc", "zone"], order="subnet_id", private="private"), "zone", "subnet_id") == [("z1", "s2"), ("z2", "s3")]


@pytest.mark.parametrize(
    "private_compute, private_gpu, override, gpu_zones, expected",
    [
        (False, False, [], [], {"compute": "s1", "gpu": "s1"}), (False, True, [], [], {"compute": "s1", "gpu": "s2"}),
        (True, True, [], [], {"compute": "s2", "gpu": "s2"}), (True, True, ["mine"], [], {"compute": "mine", "gpu": "s2"}),
        (False, False, ["mine"], [], {"compute": "mine", "gpu": "mine"}), (False, False, [], ["z2"], {"compute": "s1", "gpu": "s3"}),
    ],
)
def test_gpu_subnets(spark, private_compute, private_gpu, override, gpu_zones, expected):
    df = spark.createDataFrame([("v", "z1", "s2", True), ("v", "z1", "s1", False), ("v", "z2", "s3", True)], "vpc string, zone string, subnet_id string, private boolean")
    request = spark.createDataFrame(
        [("c", "v", ["z1"], gpu_zones, private_compute, private_gpu, override)],
        "cluster string, vpc string, compute_zones array<string>, gpu_zones array<string>, private_compute boolean, private_gpu boolean, compute_override array<string>",
    )
    assert dict(values(queues.first_subnets(request, df), "role", "subnet_id")) == expected


def test_inherit_first_in_document_order(spark):
    df = spark.createDataFrame([("c", 0, None, False), ("c", 1, "s1", False), ("c", 2, "s2", True), ("d", 0, None, False)], "cluster string, pos int, subnet string, gpu boolean")
    assert values(queues.inherit_first(df, F.col("subnet"), key="cluster"), "cluster", "inherited") == [("c", "s1"), ("d", None)]
    preferred = queues.inherit_first(df, F.col("subnet"), key="cluster", prefer=F.col("gpu"), default=F.lit("none"))
    assert values(preferred, "cluster", "inherited") == [("c", "s2"), ("d", "none")]


def test_queue_changes(spark):
    have = spark.createDataFrame([("c", "q1"), ("c", "q2"), ("d", "q1")], "cluster string, queue string")
    changes = spark.createDataFrame(
        [("c", 1, "q3", "add"), ("c", 2, "q1", "add"), ("c", 3, "q2", "remove"), ("c", 4, "q9", "remove"), ("d", 1, "q1", "remove"), ("e", 1, "q1", "add")],
        "cluster string, position int, queue string, action string",
    )
    new, rejected = queues.queue_apply(have, changes)
    assert values(new, "cluster", "queue") == [("c", "q1"), ("c", "q3"), ("d", "q1"), ("e", "q1")]
    assert values(rejected, "cluster", "queue", "action", "reason") == [
        ("c", "q1", "add", "already exists"), ("c", "q9", "remove", "not found"), ("d", "q1", "remove", "last queue"),
    ]


def test_queue_changes_are_judged_in_order(spark):
    have = spark.createDataFrame([("two", "q1"), ("two", "q2"), ("one", "q1"), ("still", "q1")], "cluster string, queue string")
    changes = spark.createDataFrame(
        [("two", 1, "q1", "remove"), ("two", 2, "q2", "remove"), ("one", 1, "q2", "add"), ("one", 2, "q1", "remove"), ("one", 3, "q2", "remove"),
         ("new", 1, "q", "add"), ("new", 2, "q", "add"), ("new", 3, "r", "add"), ("new", 4, "q", "remove")],
        "cluster string, position int, queue string, action string",
    )
    new, rejected = queues.queue_apply(have, changes)
    assert values(new, "cluster", "queue") == [("new", "r"), ("one", "q2"), ("still", "q1"), ("two", "q2")]
    assert values(rejected, "cluster", "position", "reason") == [("new", 2, "already exists"), ("one", 3, "last queue"), ("two", 2, "last queue")]


def test_a_million_changes_of_one_cluster(spark):
    """One cluster holds all changes: they stream past the names that are present. Queues 0 to 999 are added, added again and removed, in turn."""
    n = 1_000_000
    turn = F.col("id") / 3
    changes = spark.range(n).select(
        F.lit("c").alias("cluster"), F.col("id").alias("position"), F.concat(F.lit("q"), F.pmod(F.floor(turn), F.lit(1000))).alias("queue"),
        F.element_at(F.array(*map(F.lit, ("add", "add", "remove"))), (F.col("id") % 3 + 1).cast("int")).alias("action"),
    )
    have = spark.createDataFrame([("c", "first"), ("c", "first"), ("d", "alone"), ("c", None)], "cluster string, queue string")
    new, rejected = queues.queue_apply(have, changes)
    # the last change adds the queue of its turn
    assert values(new, "cluster", "queue") == [("c", "first"), ("c", f"q{n // 3 % 1000}"), ("d", "alone")]
    assert values(rejected.groupBy("reason").count(), "reason", "count") == [("already exists", n // 3)]


def test_odd_changes(spark):
    have = spark.createDataFrame([], "cluster int, queue string")
    changes = spark.createDataFrame(
        [(1, 2, "b", "add"), (1, None, "a", "add"), (1, 2, "a", "remove"), (1, 3, "b", "rename"), (1, 4, None, "add"), (None, 1, "x", "add"), (1, 5, "a", "remove")],
        "cluster int, position int, queue string, action string",
    )
    new, rejected = queues.queue_apply(have, changes)
    assert values(new, "cluster", "queue") == [(1, "b")]  # without a position first; of equal ones by queue
    assert values(rejected, "position", "queue", "reason") == [(2, "a", "last queue")]
    none = changes.limit(0)
    assert [d.count() for d in queues.queue_apply(have, none)] == [0, 0]


# --- policies and sets -------------------------------------------------------------------


def test_wildcard_grants_are_found(spark):
    rows = [("p", "s1", ["logs:*", "logs:Put*"]), ("p", "s2", ["logs:DeleteLogGroup"]), ("q", "s3", ["logs:CreateLogGroup"])]
    docs = spark.createDataFrame(rows, "doc string, sid string, actions array<string>")
    got = policy.action_grants(docs, ["logs:DeleteLogGroup"])
    assert values(got, "sid", "pattern") == [("s1", "logs:*"), ("s2", "logs:DeleteLogGroup")]


def test_scope_of_a_statement(spark):
    docs = spark.createDataFrame(
        [("d", "Attach", ["arn:policy/x-1-*", "arn:policy/y-?"]), ("d", "Other", ["*"])], "doc string, sid string, condition_patterns array<string>"
    )
    names = ["arn:policy/x-1-a/b", "arn:policy/x-2-a", "arn:policy/y-1", "arn:policy/y-12"]
    got = policy.arn_scope(docs, spark.createDataFrame([("d", n) for n in names], "doc string, arn string"), sid="Attach")
    assert dict(values(got, "arn", "allowed")) == dict(zip(names, [True, False, True, False]))


def test_no_pattern_of_a_column_is_compiled(spark):
    docs = spark.createDataFrame([("p", "s", ["a*", "?"])], "doc string, sid string, actions array<string>")
    for df in (policy.action_grants(docs, ["ab"]), policy.arn_scope(docs.withColumnRenamed("actions", "condition_patterns"), spark.createDataFrame([("p", "ab")], "doc string, arn string"), sid="s")):
        assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString().upper()


def test_prefixes_of_many_lengths(spark, monkeypatch):
    """Five hundred lengths: a task passes on each prefix that it meets once, whatever the number of keys."""
    asked = [("b", "x" * n, True) for n in range(1, 501)] + [("b", "x" * 3 + "y", True), ("b", "zz", True), ("c", "", True), ("b", "é", True), (None, "x", True), ("b", None, True)]
    prefixes = spark.createDataFrame(asked, "bucket string, prefix string, required boolean")
    keys = [("b", "x" * 40 + "y"), ("b", "x" * 3 + "yes"), ("b", "zy"), ("b", "zzz"), ("c", "any"), ("b", "ép"), ("b", None), (None, "x")] * 50
    listing = spark.createDataFrame(keys, "bucket string, key string").repartition(3)
    expected = {(b, p, "nonempty" if any(k is not None and b == o and k.startswith(p) for o, k in keys[:8]) else "empty") for b, p, _ in asked if b and p is not None}
    for size in (policy.DICTIONARY_BYTES, 0):
        monkeypatch.setattr(policy, "DICTIONARY_BYTES", size)
        got = policy.prefix_status(prefixes, listing)
        assert {(r["bucket"], r["prefix"], r["status"]) for r in got.collect() if r["bucket"] and r["prefix"] is not None} == expected
    met = policy._met(listing, [r[:2] for r in asked if r[0] and r[1] is not None])
    assert met.count() <= 3 * sum(s == "nonempty" for *_, s in expected) == 3 * 44


def test_policy_size_counts_minified_bytes(spark):
    templates = spark.createDataFrame([("t", '{ "a" :  "<NAME>" }'), ("bad", "{ <NAME>")], "template string, text string")
    use = spark.createDataFrame([(1, "t", "é"), (2, "t", "x" * 6137), (3, "t", "x" * 6136), (4, "bad", "x"), (5, "gone", "x")], "id int, template string, name string")
    got = policy.policy_size(use, templates, {"<NAME>": "name"})
    assert values(got, "id", "bytes", "fits") == [(1, 10, True), (2, 6145, False), (3, 6144, True), (4, None, False), (5, None, False)]
    left = spark.createDataFrame([("t", '{"a": "<NAME>", "b": "<VPC_ID>"}')], "template string, text string")
    assert values(policy.policy_size(use, left, {"<NAME>": "name"}), "id", "unfilled") == [(1, True), (2, True), (3, True), (4, False), (5, False)]


def test_policies_are_rendered_by_many_tasks(spark, monkeypatch):
    """Small rows that cost much are dealt by their number, not by their bytes."""
    monkeypatch.setattr(policy, "RENDERED_A_TASK", 10, raising=False)
    templates = spark.createDataFrame([("t", '{"a": "<NAME>"}')], "template string, text string")
    use = spark.range(95).select("id", F.when(F.col("id") > 0, "t").alias("template"), F.lit("é").alias("name")).coalesce(1)
    got = policy.policy_size(use, templates, {"<NAME>": "name"}).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["id"], r["bytes"]) for r in got) == [(n, 10 if n else None) for n in range(95)]
    assert len({r["task"] for r in got}) == 10


def test_cleanup_items_are_rows(spark):
    rows = [("c", "r1", True, True), ("c", "r1", True, True), ("c", "r2", False, True), ("c", "r3", False, False)]
    steps = spark.createDataFrame(rows, "cluster string, resource string, failed boolean, retained boolean")
    assert values(health.cleanup_items(steps, key="cluster"), "resource", "kind") == [("r1", "orphaned"), ("r2", "retained")]


def test_drift_and_coverage(spark):
    table = lambda *ps: spark.createDataFrame([("r", p) for p in ps], "role string, policy string")
    got = policy.drift(table("a", "b"), table("b", "c", "x", "x"), table("a", "b", "c"), keys=["role", "policy"])
    assert values(got, "policy", "drift") == [("a", "missing"), ("c", "stale")]
    assert policy.drift(table("a"), table("a", "foreign"), table("a"), keys=["role", "policy"]).count() == 0
    assert values(policy.coverage_diff(table("a", "b"), table("b", "c"), keys=["policy"]), "policy", "side") == [("a", "left_only"), ("c", "right_only")]


def test_prefixes(spark):
    listing = spark.createDataFrame([("b", "in/1"), ("b", "in/2"), ("b", "other"), ("c", "x")], "bucket string, key string")
    prefixes = spark.createDataFrame(
        [("b", "in/", True), ("b", "in/12345", True), ("b", "out/", False), ("c", "in/", True), ("d", "x", True), ("c", "", True)],
        "bucket string, prefix string, required boolean",
    )
    answers = spark.createDataFrame([("x", "403"), ("y", "404"), ("b", None)], "bucket string, code string")
    more = spark.createDataFrame([("x", "in/", True), ("y", "out/", False), ("UNDEFINED", "in/", True)], "bucket string, prefix string, required boolean")
    judged = policy.prefix_status(more.unionByName(prefixes), listing, answers)
    assert values(judged.where("bucket in ('x', 'y', 'UNDEFINED')"), "bucket", "status") == [("UNDEFINED", "skipped"), ("x", "access_denied"), ("y", "bucket_not_found")]
    assert judged.where("bucket = 'b' and status = 'nonempty'").count() == 1
    got = policy.prefix_status(prefixes, listing)
    assert values(got, "bucket", "prefix", "status") == [
        ("b", "in/", "nonempty"), ("b", "in/12345", "empty"), ("b", "out/", "exempt"), ("c", "", "nonempty"), ("c", "in/", "empty"), ("d", "x", "empty"),
    ]
