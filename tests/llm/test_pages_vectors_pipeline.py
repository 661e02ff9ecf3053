"""URL filter (6), neighbours (7), archives (10), the pipeline, and the entry point's guard."""

import gzip
import hashlib
import io
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetloom.llm import ann, urlgraph, warc
from fleetloom.session import scratch_path

PAGES = "page_id long, url string, html string, host string"


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/x?q#f", "https://example.net/En/", "x://sub.example.com/de/", "http://badexample.com/de/", "http://org", "http://a.org/fr/1", "no-scheme", "", None,
        "http://net?x", "ftp://a://b/c", "http://x.net/",
    ]
    got = urlgraph.judge(spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], PAGES)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/En/", "net/"), ("sub.example.com", "/de/", "example.com/de/"), ("badexample.com", "/de/", None),
        ("org", "", None), ("a.org", "/fr/1", "org/fr/"), ("", "", None), ("", "", None), ("", "", None), ("net", "", None), ("a:", "//b/c", None), ("x.net", "/", "net/"),
    ]
    assert [r["verdict"] for r in got if r["rule"]] == ["allow", "block", "block", "allow", "block"]


def test_ranks_equal_plain_iteration(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "c", 1.0), ("e", "d", 1.0)]
    seeds = [("a", 3, 0), ("b", 1, 0), ("c", 0, 2)]
    got = urlgraph.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted long, blocked long"), tolerance=1e-4)
    names = "abcde"
    forward, backward = np.zeros((5, 5)), np.zeros((5, 5))
    for s, d, w in edges:
        forward[names.index(d), names.index(s)] += w
        backward[names.index(s), names.index(d)] += w
    for column, matrix, at in (("trust", forward, 1), ("distrust", backward, 2)):
        start = np.array([sum(s[at] for s in seeds if s[0] == n) for n in names], float)
        start /= sum(t + b for _, t, b in seeds)
        share = matrix / np.where(matrix.sum(axis=0) > 0, matrix.sum(axis=0), 1)
        rank = start
        for _ in range(300):
            rank = 0.85 * share @ rank + 0.15 * start
        for r in got.collect():
            assert r[column] == pytest.approx(rank[names.index(r["host"])], rel=1e-3, abs=1e-12)


def plain_verdicts(pages):
    """Rule and verdict of every page, and how near its host is to the threshold, by plain dictionaries."""
    import re
    from collections import defaultdict

    lower = lambda t: t.translate(str.maketrans(urlgraph._UPPER, urlgraph._LOWER))
    parsed, seeds, edges = [], {"trust": defaultdict(float), "distrust": defaultdict(float)}, defaultdict(float)
    hosts = set()
    for key, url, html in pages:
        rest = (url or "").partition("://")[2]
        host = lower(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [(len(t), v, t) for v, t in urlgraph.RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, default=(0, None, None))
        parsed.append((key, host, path, rule[2], rule[1]))
        if host:
            hosts.add(host)
            if rule[1]:
                seeds["trust" if rule[1] == "allow" else "distrust"][host] += 1
            for found in re.findall(r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)""", html or ""):
                if lower(found) != host:
                    edges[host, lower(found)] += 1
    for host in list(hosts):
        while host.count(".") > 1:
            above = host.partition(".")[2]
            hosts |= {above}
            edges[host, above], edges[above, host] = edges.get((host, above), 0) or 0, edges.get((above, host), 0) or 0
            host = above
    kin = {(h, h.partition(".")[2]) for h in hosts if h.count(".") > 1}
    for a, b in kin:
        edges[a, b] += 1
        edges[b, a] += 1
    total = sum(seeds["trust"].values()) + sum(seeds["distrust"].values())
    ranks = {}
    for kind in seeds:
        steps = defaultdict(dict)
        for (a, b), w in edges.items():
            if w:
                x, y = (a, b) if kind == "trust" else (b, a)
                steps[x][y] = w
        start = {h: n / total for h, n in seeds[kind].items()}
        rank = start
        for _ in range(200):
            new = defaultdict(float, {h: 0.15 * v for h, v in start.items()})
            for x, v in rank.items():
                out = sum(steps[x].values())
                for y, w in steps[x].items():
                    new[y] += 0.85 * v * w / out
            rank = new
        ranks[kind] = rank
    for key, host, path, rule, action in parsed:
        t, d = (ranks[k].get(host, 0.0) for k in ("trust", "distrust"))
        share = (t - d) / (t + d) if t + d else 0.0
        yield key, host, path, rule, action or ("block" if share < -1e-9 else "allow"), share


def test_host_query_equals_plain_propagation(spark, data):
    from fleetloom.llm.queries import QUERIES

    pages = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in QUERIES["op6_host_trust"](spark, data).collect()}
    judged = list(plain_verdicts(pages))
    assert set(got) == {key for key, *_ in judged}
    for key, host, path, rule, verdict, share in judged:
        assert got[key][:3] == (host, path, rule)
        assert got[key][3] == verdict or rule is None and 1e-9 < abs(share) < 3e-3, (host, share)


def test_far_and_small_hosts_are_reached(spark):
    """A chain of thirty hosts behind a blocked page, and a thousand hosts that share what little its domain has."""
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = [(0, "http://bad.net/", "", "x")] + [(k, f"http://h{k}.test/", link("bad.net" if k == 1 else f"h{k - 1}.test"), "x") for k in range(1, 31)]
    pages += [(1000 + k, f"http://s{k}.many.test2/", link("many.test2") if k else link("h30.test"), "x") for k in range(300)]
    got = {r["page_id"]: r["verdict"] for r in urlgraph.judge(spark.createDataFrame(pages, PAGES)).collect()}
    assert set(got.values()) == {"block"}


def test_links_carry_trust_and_distrust(spark):
    to = lambda *hosts: "".join(f'<a HREF="https://{h}/x">x</a>' for h in hosts)
    pages = [
        (1, "http://good.org/fr/1", to("fine.test", "Fine.Test"), "x"), (2, "http://bad.net/", None, "x"), (3, "http://fine.test/", "", "x"),
        (4, "http://shady.test2/", to("bad.net"), "x"), (5, "http://lone.test3/", "/relative <a href=/x>", "x"), (3, "http://fine.test/", "", "x"),
    ]
    got = {r["page_id"]: r["verdict"] for r in urlgraph.judge(spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow"}
    assert urlgraph.judge(spark.createDataFrame(pages, PAGES).limit(0)).count() == 0


# --- neighbours --------------------------------------------------------------------------


def exact(vectors, queries, k):
    out = {}
    for q_id, q in queries:
        near = sorted(((-float(np.dot(v, q) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(q, q))), i) for i, v in vectors if i != q_id))
        out[q_id] = near[:k]
    return out


def test_pigeonhole_probing_retrieves_every_code():
    draw = np.random.default_rng(0)
    codes = draw.integers(0, 256, (500, 8)).astype(np.uint8)
    hashing = ann.Hashing(np.zeros(64), np.eye(64), 0)
    for radius in (0, 3, 17, 26, 64):
        held = ann.SubstringIndex.of(codes)
        for code in codes[:40]:
            assert held.probe(code, hashing.reach(radius), radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius).tolist()


def test_recall_of_the_query(spark, data):
    from fleetloom.llm.queries import QUERIES

    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    expected = exact(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = {}
    for r in QUERIES["op7_multi_index_neighbours"](spark, data).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    hits = [len({i for _, i in expected[q]} & {i for i, _ in got[q]}) / 5 for q in expected]
    assert np.mean(hits) >= 0.9


def test_odd_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [1.0, 1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]),
        (8, [inf, 1.0, 0.0]), (9, [1.0, None, 0.0]), (10, [-1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (11, [1.0, 2.0]),
    ]
    vectors = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = ann.nearest(vectors, vectors.filter("vec_id in (0, 4, 6)"), k=5).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 10)]
    assert [r["score"] for r in got] == pytest.approx([1.0, 0.5**0.5, 0.5**0.5, -1.0])
    assert ann.nearest(vectors, vectors.limit(0)).count() == ann.nearest(vectors.limit(0), vectors).count() == 0


def test_probing_looks_at_few_rows_within_a_small_radius():
    """Rows far from the query are neither compared nor scored."""
    draw = np.random.default_rng(2)
    codes = draw.integers(0, 256, (20_000, 8)).astype(np.uint8)
    held = ann.SubstringIndex.of(codes)
    looked = sum(int(held.starts[j, v + 1] - held.starts[j, v]) for j in range(8) for v in np.flatnonzero(ann._APART[codes[0, j]] <= 0))
    assert looked < 20_000 // 20
    assert 0 in held.probe(codes[0], ann.Hashing(np.zeros(64), np.eye(64), 7).reach(7), 7)


def test_repeated_ids_are_rows_of_their_own(spark):
    """Rows that share an id are candidates each; none is a neighbour of a query of that id."""
    rows = [(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, vectors.filter("vec_id = 3"), k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 1, 2, 1]
    got = ann.nearest(vectors, vectors.filter("vec_id = 1").limit(1), k=5).collect()
    assert {r["vec_id"] for r in got} == {2, 3} and len(got) == 3


def test_tasks_do_not_send_a_sample_each(spark):
    """The driver gets the sample once, however many tasks read the vectors; it is that of the least hashes."""
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=64).tolist()) for i in range(8000)] + [(5, [1.0] * 64), (7, [1.0] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(16)
    least = [r["vec_id"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(500).collect()]
    conf = spark.sparkContext._jsc.sc().conf()
    usual = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")  # 16 samples of 500 vectors are over 4 MB
    try:
        sample, total = ann._sample(ann.usable(vectors), 500)
        found = ann.nearest(vectors, vectors.filter("vec_id in (11, 13)"), k=5, sample_rows=500).count()
    finally:
        conf.set("spark.driver.maxResultSize", usual)
    assert total == 8002 and found == 10
    assert not {5, 7} & set(least) and np.array_equal(sample, np.array([rows[i][1] for i in least]))


def test_every_block_of_queries_meets_every_block_of_rows(spark, monkeypatch):
    """Shares of many blocks give the rows of a full search, and no side is broadcast."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 32)
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=8)) for i in range(400)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    found = ann.nearest(vectors, vectors, k=3, radius=8)
    expected = exact(rows, rows, 3)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found.collect()} == {(q, n, i) for q, near in expected.items() for n, (_, i) in enumerate(near, 1)}
    hashing = ann.learn(np.array([v for _, v in rows]), 3)
    blocks = ann.durable_copy(ann._blocks(vectors, hashing, 32), "blocks")
    plan = ann._search(blocks, blocks, hashing, 3, 8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Exchange" not in plan


def test_a_narrow_radius_still_finds_enough(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=16).tolist()) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, vectors.filter("vec_id < 20"), k=5, radius=1).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {5} and len(got) == 20


# --- archives ----------------------------------------------------------------------------

LONG = "x" * 200
WEB = [
    (1, "http://a/?q=%41", LONG), (2, "http://b", LONG), (3, None, None), (None, "http://c\r\nX: y", LONG), (2, "http://b", LONG), (5, "u", ""), (6, "u", "y" * 99), (7, "u", "y" * 99),
    (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 30),
]


@pytest.fixture(scope="module")
def archives(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in WEB], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    return path


def test_records_read_back_what_was_written(spark, archives):
    got = warc.read_archives(spark, archives).collect()
    assert len(got) == len(WEB)
    for r in got:
        html = next(h or "" for i, _, h in WEB if i == r["page_id"]).encode()
        revisit = r["page_id"] == 2
        assert (r["record_type"], r["payload_bytes"]) == ("revisit" if revisit else "response", len(html))
        assert bytes(r["payload"]) == (b"" if revisit else html) and r["payload_digest"] == "sha256:" + hashlib.sha256(html).hexdigest()
        assert r["refers_to"] == ("<urn:page:1>" if revisit else None)
    uris = {r["page_id"]: r["target_uri"] for r in got}
    assert uris[1] == "http://a/?q=%41" and uris[3] is None and uris[None] == "http://c%0D%0AX: y"


def test_types_headers_and_columns_are_pushed_down(spark, archives):
    types = warc.read_archives(spark, archives, "page_id long, record_type string").filter("record_type = 'revisit'")
    assert "record_type" not in types._jdf.queryExecution().executedPlan().toString().split("Filter")[-1].split("\n")[0].replace("isnotnull(record_type", "")
    assert sorted(r["page_id"] for r in types.collect()) == [2, 2]
    by_option = warc.read_archives(spark, archives, "page_id long", record_types="revisit", **{"header.WARC-Target-URI": "http://b"})
    assert by_option.count() == 2
    with pytest.raises(Exception, match="no such columns"):
        warc.read_archives(spark, archives, "nothing long").collect()


def test_unwanted_blocks_are_passed_over():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counting.taken += len(got)
            return got

    record = lambda kind, data: warc.record_bytes({"record_type": kind, "page_id": 1, "payload": data, "payload_bytes": len(data)})
    stream = Counting(record("response", b"p" * 10**5) + record("revisit", b"") + record("response", b"tail"))
    found = list(warc.read_records(stream, {"WARC-Type": {"revisit"}}, payload=False))
    assert [h["warc-type"] for h, _ in found] == ["revisit"] and Counting.taken == 0
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(record("response", b"p" * 100)[:-80]), {}, payload=True))


def test_compressed_archives_and_nothing(spark, tmp_path):
    data = [warc.record_bytes({"record_type": "response", "page_id": n, "payload": b"abc", "payload_bytes": 3}) for n in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    read = warc.read_archives(spark, str(tmp_path))
    assert sorted((r["page_id"], bytes(r["payload"])) for r in read.collect()) == [(0, b"abc"), (1, b"abc"), (2, b"abc")]
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archive_query(spark, data):
    from fleetloom.llm.queries import QUERIES

    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    first = {}
    for page_id in sorted(html):
        first.setdefault(html[page_id], page_id)
    expected = {}
    for page_id, h in html.items():
        again = len(h) >= 100 and first[h] != page_id
        expected[page_id] = (len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None)
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op10_warc_archives"](spark, data).collect()} == expected


@pytest.mark.parametrize("name", ["op3_repeated_passages", "op10_warc_archives", "op12_conversation_repair"])
def test_query_equals_its_sql(spark, data, name):
    from fleetloom.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())


# --- pipeline and entry point --------------------------------------------------------------


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, before, data).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        old, new = ({r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (before, after))
        gone = set(old) - set(new)
        assert set(new) <= set(old) and after.count() == len(new)
        if name == "quality":
            judged = [d for d in old if d in labels]
            assert np.mean([(d in new) == (labels[d] == 1) for d in judged]) >= 0.9
        elif name == "near duplicates":
            assert len(set(new.values())) == len(new)
            shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
            kept = {d: shingles(t) for d, t in new.items()}
            for d in gone:
                mine = shingles(old[d])
                assert max(len(mine & s) / len(mine | s) for s in kept.values()) > 0.5
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert not any(i in t for i in items for t in new.values())
        elif name == "secrets":
            assert set(new) == set(old) and not any("password=" in t or "AKIA" in t for t in new.values())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert packed.select("doc_id").distinct().count() == before.count()
    whole = corpus_pipeline.run(spark, data)
    assert sorted(whole.select("doc_id", "piece", "ids_crc32").collect()) == sorted(packed.select("doc_id", "piece", "ids_crc32").collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_native_queries_have_no_python_in_their_plans(spark, data):
    from fleetloom.llm.queries import QUERIES

    for name in ("op1_template_leaks", "op6_host_trust", "op8_secret_scan"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        for banned in ("Python", "Arrow", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert banned not in plan, (name, banned)


def test_entry_point_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for item in ("__spark_entry__.py", "bindings", "fleetloom"):
        target = os.path.join(tmp_path, item)
        os.symlink(os.path.join(root, item), target) if item != "fleetloom" else os.mkdir(target)
    for item in os.listdir(os.path.join(root, "fleetloom")):
        if item != "llm":
            os.symlink(os.path.join(root, "fleetloom", item), os.path.join(tmp_path, "fleetloom", item))
    code = "import __spark_entry__ as e; print(sum(n.startswith('op') and n[2].isdigit() for n in e.queries()), len(e.queries()) > 90, 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split() == ["0", "True", "False"], said.stderr
