import hashlib
import os
from types import SimpleNamespace

import pytest
from helpers import one, values
from pyspark.sql import functions as F

from bindings import source_queries
from fleetloom.operators import benchmarks, logs
from fleetloom.session import scratch_path, shared_dir
from fleetloom.sources import readers, sinks


def test_sparse_record_takes_defaults(spark):
    raw = spark.createDataFrame([("alpha", "ann", "us-east-1")], "cluster_name string, cluster_owner string, region string")
    got = one(readers.normalize_records(raw)).asDict()
    assert len(got) == 19
    assert (got["cluster_type"], got["ec2_user"], got["enable_cpu_queue"], got["enable_monitoring"]) == ("ondemand", "ubuntu", "false", "false")
    assert (got["cpu_instance_types"], got["max_cpu_queue_size"], got["deployment_date"]) == ([], 0, "")


def test_record_fields_are_cleaned_and_coerced(spark):
    raw = spark.createDataFrame(
        [(None, "d1", "ma\x1b[31mra\nX", "a.l, b.l,,a.l", ["g.l", None, "h\x07.l"], "12", "x")],
        "cluster_name string, dir string, cluster_owner string, cpu_instance_types string, gpu_instance_types array<string>, max_cpu_queue_size string, max_gpu_queue_size string",
    )
    got = one(readers.normalize_records(raw, directory="dir"))
    assert (got["cluster_name"], got["cluster_owner"]) == ("d1", "ma[31mraX")
    assert (got["cpu_instance_types"], got["gpu_instance_types"]) == (["a.l", "b.l", "a.l"], ["g.l", "h.l"])
    assert (got["max_cpu_queue_size"], got["max_gpu_queue_size"]) == (12, 0)


def test_tool_text_lines_are_numbered_across_splits(spark, tmp_path):
    expected = []
    for run, count in (("20260720_1_1", 5), ("20260721_1_1", 4000)):
        folder = tmp_path / "results" / "c1" / "c1-55" / run / "osu"
        os.makedirs(folder)
        lines = [f"{run} line {n}\r" if n % 5 == 0 else f"{run} line {n}" for n in range(1, count + 1)]
        (folder / "latency.txt").write_text("\n".join(lines) + "\n", newline="")
        expected += [("c1", "c1-55", run, "osu/latency.txt", n, line) for n, line in enumerate(lines, 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        scanned = readers.scan_tool_text(spark, str(tmp_path / "results"), root="results")
        assert scanned.select("block").distinct().count() > 2
        numbered = readers.number_lines(scanned)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert values(numbered, "cluster", "serial", "run_id", "relpath", "line_no", "line") == sorted(expected, key=repr)


def test_operators_take_the_place_of_scanned_lines(spark, tmp_path):
    folder = tmp_path / "results" / "c1" / "s1" / "20260720_1_1"
    os.makedirs(folder / "osu")
    (folder / "stream.txt").write_text("".join(f"noise {n}\n" for n in range(3000)) + "Copy: 5.0 x\nCopy: 7.0 x\nTriad: 8.0 x\n")
    (folder / "osu" / "bandwidth.txt").write_text("".join(f"{n} {n % 700}.5\n" for n in range(1, 3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        scanned = readers.scan_tool_text(spark, str(tmp_path / "results"), root="results")
        got = one(benchmarks.benchmark_summary(scanned, pos="place"))
        last = one(logs.last_matching_line(scanned.where("relpath = 'stream.txt'"), F.col("line").startswith("Copy"), key="run_id", pos="place"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (got["stream_copy_mbs"], got["stream_triad_mbs"], got["bandwidth_mbs"], got["bandwidth_size"]) == (5.0, 8.0, 699.5, "699")
    assert last["last_line"] == "Copy: 7.0 x"


def test_broken_document_gives_nulls(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}}',), ("{oops",), ('{"a": 5}',), (None,)], "j string")
    got = readers.parse_snapshot(df, "j", "struct<a:struct<b:int>>")
    assert [r["b"] for r in got.select(F.col("doc.a.b").alias("b")).collect()] == [1, None, None, None]


def test_pages_with_missing_columns(spark):
    pages = [spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2,)], "a int"), spark.createDataFrame([("z", 3)], "b string, a int")]
    assert values(readers.paged_union(*pages), "a", "b") == [(1, "x"), (2, None), (3, "z")]


def test_manifest_statuses(spark):
    sha = hashlib.sha256(b"data").hexdigest()
    objects = spark.createDataFrame([("ok", bytearray(b"data")), ("bad", bytearray(b"other")), ("empty", bytearray(b"")), ("none", bytearray(b"data"))], "key string, content binary")
    manifest = spark.createDataFrame([("ok", sha), ("bad", sha), ("empty", sha), ("gone", sha), ("none", None), ("blank", "")], "key string, expected string")
    got = dict(values(readers.verify_manifest(manifest, objects), "key", "status"))
    assert got == {"ok": "ok", "bad": "mismatch", "empty": "empty", "gone": "missing", "none": "no_expected", "blank": "no_expected"}


def test_files_verify_against_their_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"data")
    objects = readers.read_objects(spark, str(tmp_path))
    key = objects.first()["key"]
    manifest = spark.createDataFrame([(key, hashlib.sha256(b"data").hexdigest())], "key string, expected string")
    assert one(readers.verify_manifest(manifest, objects))["status"] == "ok"


def test_report_is_written_in_order_and_never_over_another(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "name string, n int").repartition(3)
    path = scratch_path(spark, "report")
    sinks.write_report(df, path, "json", order="name")
    assert [r["name"] for r in sinks.ordered_report(df, "name").collect()] == ["a", "b", "c"]
    assert values(readers.read_pages(spark, path, schema="name string, n int"), "name", "n") == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(Exception):
        sinks.write_report(df, path, "json")
    with pytest.raises(ValueError):
        sinks.write_report(df, path + "x", "csv")


def test_results_accumulate_by_build(spark):
    path = scratch_path(spark, "results")
    first = spark.createDataFrame([("c", "s1", "r1", 1.0), ("c", "s2", "r1", 2.0)], "cluster string, serial string, run_id string, v double")
    sinks.append_results(first, path)
    sinks.append_results(first, path)  # a repeated write adds nothing
    sinks.append_results(first.where("serial = 's2'").withColumn("run_id", F.lit("r2")), path)
    stored = spark.read.parquet(path)
    assert values(stored, "cluster", "serial", "run_id", "v") == [("c", "s1", "r1", 1.0), ("c", "s2", "r1", 2.0), ("c", "s2", "r2", 2.0)]
    assert "PartitionFilters: [isnotnull(serial" in stored.where("serial = 's1'")._jdf.queryExecution().executedPlan().toString()


def test_an_append_reads_only_builds_of_its_batch(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/results"
    kind = "cluster string, serial string, run_id string, v double"
    everything = spark.createDataFrame([(f"c{k % 3}", f"00{k}", f"r{n}", float(n)) for k in range(6) for n in range(4)], kind)
    sinks.append_results(everything.where("run_id < 'r2'"), path)  # a job that was cut short
    os.makedirs(f"{path}/_temporary/0")  # and left this behind
    sinks.append_results(everything, path)
    sinks.append_results(everything, path)
    assert values(spark.read.schema(kind).parquet(path), "cluster", "serial", "run_id", "v") == values(everything, "cluster", "serial", "run_id", "v")
    batch = everything.where("cluster = 'c1' AND serial = '001'")
    there = sinks.stored_runs(batch, path)
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cluster" in (filters := plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]) and "001" in filters
    assert values(there, "serial", "run_id") == [("001", f"r{n}") for n in range(4)]  # its folder name is text
    monkeypatch.setattr(sinks, "NAMED_BUILDS", 2)
    sinks.append_results(everything.withColumn("v", F.col("v") + 1), path)
    assert spark.read.parquet(path).count() == everything.count()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_records_and_broken_files_come_from_one_read(spark, tmp_path):
    files = {
        "alpha": '{"cluster_name": "alpha", "region": "eu", "max_cpu_queue_size": 7, "cpu_instance_types": ["a", "b"], "extra": {"x": 1}}',
        "beta": '{\n  "cluster_owner": "ann",\n  "cpu_instance_types": "c, d"\n}', "cut": '{"cluster_name": "cut", "region": "e', "list": '[{"cluster_name": "list"}]',
        "text": '"words"', "number": "5", "empty": "", "blank": " \n", "two": '{"region": "a"} {"region": "b"', "other": "{}",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    names = spark.createDataFrame([(n,) for n in [*files, "gone", "alpha"] if n != "other"], "cluster_name string")
    scan = readers.scan_inventory(spark, str(tmp_path), names)
    assert str(scan._jdf.queryExecution().executedPlan()).count("FileScan") == 1
    good = {r["cluster_name"]: r for r in readers.records_of(scan).collect()}
    assert set(good) == {"alpha", "beta"} and len(readers.records_of(scan).columns) == 19
    assert (good["alpha"]["region"], good["alpha"]["max_cpu_queue_size"], good["alpha"]["cpu_instance_types"]) == ("eu", 7, ["a", "b"])
    assert (good["beta"]["cluster_owner"], good["beta"]["cpu_instance_types"], good["beta"]["ec2_user"]) == ("ann", ["c", "d"], "ubuntu")
    broken = {"cut", "list", "text", "number", "blank", "two"}
    assert values(readers.unreadable_names(scan), "cluster", "problem") == sorted([(n, "unreadable") for n in broken] + [("gone", "missing"), ("empty", "missing")])
    every = readers.scan_inventory(spark, str(tmp_path))
    assert readers.records_of(every).count() == 3 and readers.unreadable_names(every).count() == len(broken)


def walk(pages):
    """Pages of one chain by a sequential walk: number of each token, and how it ends."""
    by_token = {}
    for token, after in pages:
        by_token[token] = min(after, by_token.get(token, after))
    numbers, token = {}, ""
    while token in by_token and token not in numbers:
        numbers[token] = len(numbers) + 1
        token = by_token[token]
        if not token:
            break
    if not numbers:
        return numbers, "no_start", None
    return numbers, "complete" if not token else "cyclic" if token in numbers else "missing", token or None


def test_pages_are_ordered_as_a_walk_goes(spark):
    import random

    rng = random.Random(4)
    chains = {
        "long": [(str(k) if k else "", str(k + 1) if k < 200 else "") for k in range(201)], "one": [("", "")], "loop": [("", "a"), ("a", "b"), ("b", "a")], "self": [("", "a"), ("a", "a")],
        "lost": [("", "a"), ("a", "x"), ("b", "")], "headless": [("a", "b"), ("b", "")], "twice": [("", "a"), ("a", "b"), ("a", "b"), ("b", "")], "home": [("", "a"), ("a", "")],
        **{f"r{n}": [(rng.choice(["", *"abcdefgh"]), rng.choice(["", *"abcdefgh"])) for _ in range(9)] for n in range(30)},
    }
    rows = [(c, t or rng.choice([None, ""]), a or rng.choice([None, ""]), n) for c, pages in chains.items() for n, (t, a) in enumerate(pages)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "c string, token string, next_token string, body int")
    ordered = readers.order_pages(pages, chain="c").cache()
    got = {}
    for r in ordered.collect():
        got.setdefault(r["c"], []).append((r["token"] or "", r["page_no"], r["defect"]))
    ends = {r["c"]: (r["pages"], r["ending"], r["stopped"], r["repeated"], r["unreached"]) for r in readers.page_walks(ordered, chain="c").collect()}
    for chain, of in chains.items():
        numbers, ending, stopped = walk(of)
        first = {t: n for t, n, d in got[chain] if d != "repeated"}
        assert first == {t: numbers.get(t) for t, _ in of}, chain
        assert len(got[chain]) == len(of) and all((d == "unreached") == (n is None) for _, n, d in got[chain] if d != "repeated")
        unreached = sum(n is None for n in first.values())
        assert ends[chain] == (len(numbers), ending, stopped, len(of) - len(first), unreached), chain


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    written = []
    plain = readers.durable_copy
    monkeypatch.setattr(readers, "durable_copy", lambda df, label: (written.append(label), plain(df, label))[1])
    n = 3000
    pages = spark.range(n).select(F.lit(1).alias("c"), F.when(F.col("id") > 0, F.col("id")).alias("token"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("next_token"))
    ordered = readers.order_pages(pages, chain="c")
    assert ordered.where("page_no = coalesce(token, 0) + 1").count() == n
    assert written.count("reached") <= 15
    assert readers.order_pages(pages.limit(0), chain="c").count() == 0


def test_only_files_with_metrics_are_opened(spark, tmp_path):
    run = tmp_path / "results" / "c" / "s" / "20260701_1"
    texts = {"stream.txt": "Copy: 5.0 x", "osu/latency.txt": "8 1.5", "osu/other.txt": "8 9.9", "hpcg/HPCG-Benchmark_3.1.txt": "GFLOP/s rating of=7.0", "log.txt": "x" * 1000, "hpcg/notes.txt": "n"}
    for name, text in texts.items():
        (run / name).parent.mkdir(parents=True, exist_ok=True)
        (run / name).write_text(text + "\n")
    scan = readers.scan_tool_text(spark, str(tmp_path / "results"), root="results", files=benchmarks.METRIC_FILES)
    wanted = {"stream.txt", "osu/latency.txt", "hpcg/HPCG-Benchmark_3.1.txt"}
    assert {f.split("/20260701_1/")[1] for f in scan.inputFiles()} == wanted
    got = one(benchmarks.benchmark_summary(scan, pos="place"))
    assert (got["stream_copy_mbs"], got["latency_us"], got["hpcg_rating"]) == (5.0, 1.5, "7.0")


def test_records_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(source_queries, "FILES_A_TASK", 10, raising=False)
    supplier = spark.range(1, 101).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("n"), "id").alias("s_name"), (F.col("id") % 25).alias("s_nationkey"))
    path = source_queries.record_files(SimpleNamespace(spark=spark, supplier=supplier)).removeprefix("file:")
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files) == sum(k % 13 != 2 for k in range(1, 101))
    assert len({f[:10] for f in files}) > 5
