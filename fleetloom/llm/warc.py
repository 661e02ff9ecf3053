"""WARC archives as a Spark data source, read and written by record.

Reading plans a partition for each archive or for several small ones. Record types and header
values to keep are pushed down, as options or as filters on the columns ``record_type`` and
``target_uri``. A record's headers are parsed first; where they exclude the record, or where
the schema asks for no payload, its block is skipped without being read.

Writing makes archives of bounded size, one task after the other its own; a file appears under
its final name only when Spark commits the task, so lost and repeated tasks leave no records.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").option("record_types", "response").load(path)
    records.write.format("warc").mode("append").save(path)
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from fleetloom.session import durable_copy, let_workers_import

VERSION = b"WARC/1.1"
SCHEMA = (
    "page_id long, record_type string, target_uri string, record_id string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary"
)
#: Header of each column that has one of its own. ``Page-Id`` and ``Payload-Length`` are extension fields.
HEADERS = {
    "page_id": "Page-Id", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_id": "WARC-Record-ID",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "Payload-Length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NUMBERS = ("page_id", "payload_bytes")
ARCHIVE_BYTES = 64 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
_DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time


def _filesystem(path: str):
    """The store and the path in it; Spark's local paths may have one slash only."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _safe(value: object) -> str:
    """A header value; control characters, which would break the header, are percent-encoded and stay so."""
    return "".join(quote(c) if c < " " or c == "\x7f" else c for c in str(value))


def record_bytes(row: dict) -> bytes:
    """One record. A response holds an HTTP head and the payload, a revisit the head alone."""
    payload = row.get("payload") or b""
    revisit = row["record_type"] == "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [(HEADERS[c], _safe(row[c])) for c in HEADERS if row.get(c) is not None]
    fields += [("WARC-Date", _DATE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if revisit:
        fields.append(("WARC-Profile", PROFILE))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def read_records(file, wanted: dict[str, set[str]], payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and, if asked for, payload of each record of an open binary file that ``wanted`` admits.

    Field names are matched in any case; folded lines are joined. A block that isn't wanted is
    passed over. A file that ends within a record raises ``EOFError``.
    """
    wanted = {k.lower(): v for k, v in wanted.items()}
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        name = None
        while (line := file.readline()).strip():
            if line[:1] in b" \t" and name:
                headers[name] += " " + line.decode("utf-8", "replace").strip()
            else:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        size = int(headers.get("content-length", 0))
        if all(headers.get(k) in v for k, v in wanted.items()):
            if not payload:
                file.seek(size, 1)
                yield headers, None
                continue
            block = file.read(size)
            if len(block) < size:
                raise EOFError("an archive ends within a record")
            http = headers.get("content-type", "").startswith("application/http")
            yield headers, block.partition(b"\r\n\r\n")[2] if http else block
        else:
            file.seek(size, 1)


@dataclass
class Archives(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        unknown = set(self.names) - {*HEADERS, "payload"}
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        self.schema_ = schema
        self.path = options["path"]
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: dict[str, set[str]] = {}
        if "record_types" in options:
            self.wanted["WARC-Type"] = {t.strip() for t in options["record_types"].split(",")}
        for key, value in options.items():  # header.<name>: only records with this value
            if key.lower().startswith("header."):
                self.wanted[key[7:]] = {value}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS and column not in NUMBERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                before = self.wanted.get(HEADERS[column], values)
                self.wanted[HEADERS[column]] = before & values
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        store, root = _filesystem(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        groups: list[list[str]] = []
        held = self.bytes
        for path, size in files:
            if held + size > self.bytes:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Archives(tuple(g)) for g in groups] or [Archives(())]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(self.path)
        payload = "payload" in self.names
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                file = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else _Buffered(raw)
                for headers, data in read_records(file, self.wanted, payload):
                    row = []
                    for name in self.names:
                        value = data if name == "payload" else headers.get(HEADERS[name].lower())
                        row.append(int(value) if name in NUMBERS and value is not None else value)
                    rows.append(tuple(row))
                    size += len(data or b"") + 200
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary() if n == "payload" else pa.int64() if n in NUMBERS else pa.string() for n in self.names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=self.names)


class _Buffered:
    """Lines, reads and relative seeks over a store's file, which has no cheap ``readline``."""

    def __init__(self, raw, block: int = 1 << 20):
        self._raw, self._block, self._data, self._at = raw, block, b"", 0

    def _more(self) -> bool:
        new = self._raw.read(self._block)
        self._data, self._at = self._data[self._at :] + new, 0
        return bool(new)

    def readline(self) -> bytes:
        while (end := self._data.find(b"\n", self._at)) < 0:
            if not self._more():
                end = len(self._data) - 1
                break
        line, self._at = self._data[self._at : end + 1], end + 1
        return line

    def read(self, size: int) -> bytes:
        while len(self._data) - self._at < size and self._more():
            pass
        out = self._data[self._at : self._at + size]
        self._at += len(out)
        return out

    def seek(self, size: int, _whence: int) -> None:
        held = len(self._data) - self._at
        if size <= held:
            self._at += size
        else:
            self._raw.seek(self._raw.tell() + size - held)
            self._data, self._at = b"", 0


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # name while being written, final name


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.bytes = int(options.get("archive_bytes", ARCHIVE_BYTES))
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        files: list[tuple[str, str]] = []
        out, held = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    final = f"{root}/part-{self.job}-{context.partitionId():05d}-{len(files):04d}.warc"
                    files.append((f"{final}.{uuid.uuid4().hex}.tmp", final))
                    out, held = store.open_output_stream(files[-1][0]), 0
                data = record_bytes(row)
                out.write(data)
                held += len(data)
                if held >= self.bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _filesystem(self.path)
        for message in messages:
            for temporary, final in message.files if message else ():
                store.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _filesystem(self.path)
        for message in messages:
            for temporary, _ in message.files if message else ():
                store.delete_file(temporary)


class WarcDataSource(DataSource):
    """``format("warc")``: options ``path``, ``record_types``, ``header.<name>``, ``partition_bytes``, ``archive_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: use mode('append')")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known, and let Spark push filters into it."""
    let_workers_import(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def as_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """A record of each row of ``pages`` (``page_id, url, html``), with copies as revisits.

    Null html is an empty payload. Of equal payloads of ``least_bytes`` or more, rows with the
    least id are responses (all of them, if that row is repeated), the others revisits of it;
    smaller payloads are all responses. Rows without an id are responses and are never referred to.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"),
        F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    # digests alone, summed up before the shuffle; only those that repeat come back
    again = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    again = again.agg(F.min("page_id").alias("first"), F.count("page_id").alias("n")).filter("n > 1").select("payload_digest", "first")
    again = durable_copy(again, "digests")  # its size is known before the join: payloads are shuffled only if it is large
    joined = rows.join(again, "payload_digest", "left")
    revisit = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``as_records(pages)`` as archives below ``path``."""
    register(pages.sparkSession)
    as_records(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """Records of the archives below ``path``; without ``payload`` in ``columns`` no block is read."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def page_of(urn) -> F.Column:
    """The page id in a record id."""
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
