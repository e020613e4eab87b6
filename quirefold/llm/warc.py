"""WARC archives as a Spark data source.

Writing: one gzip member a record, one file a task, through pyarrow's file systems (local paths, HDFS, object
stores). Payload digests come from JVM functions; of equal payloads the row with the largest id
is the response and the others become revisit records that carry no payload. Only (id, digest) pairs
shuffle for that, with map-side combine, and the revisits' ids are joined back.

Reading: `spark.read.format("warc")` plans one partition per SPLIT_BYTES of files. Filters on `warc_type`, `warc_record_id`, `target_uri`
and `content_type` are pushed down: a record's headers are parsed first, and the payload of a record that
fails them, or of any record if the payload column isn't asked for, is skipped, not decoded.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

# The base-32 alphabet of RFC 4648, and WARC 1.1 header names by column.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADERS = {
    "warc_type": "WARC-Type",
    "warc_record_id": "WARC-Record-ID",
    "warc_date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
    "payload_length": "WARC-Payload-Length",  # an extension field: the full payload's bytes, on revisits too
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
DATE = "1970-01-01T00:00:00Z"  # records of a table carry no crawl time
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 16 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 SHA-1 by JVM functions: five hex digits give four letters."""
    digits = F.sha1(data)
    letters = F.lit(ALPHABET)
    parts = []
    for i in range(8):
        value = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(letters, F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode()
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(head) + press.compress(payload) + press.compress(b"\r\n\r\n") + press.flush()


def _clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", " ").replace("\n", " ")


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class WarcWriter(DataSourceArrowWriter):
    """Writes rows as records; a task's file appears under its final name when the task succeeds."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _file_system(self.path)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in HEADERS]
                payloads = batch.column(batch.schema.get_field_index("payload"))
                for i in range(batch.num_rows):
                    values = {h: v for h, c in zip(HEADERS.values(), columns, strict=True) if (v := c[i].as_py()) is not None}
                    if values.get("WARC-Type") == "revisit":
                        values["WARC-Profile"] = PROFILE
                    out.write(record({k: _clean(v) for k, v in values.items()}, payloads[i].as_py() or b""))
        fs.move(f"{root}/_{name}", f"{root}/{name}")
        return Written(f"{root}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of attempts that didn't win are removed."""
        fs, root = _file_system(self.path)
        won = {m.file for m in messages if m is not None}
        fs.create_dir(root, recursive=True)
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.path.endswith(".warc.gz") and info.path not in won:
                fs.delete_file(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _file_system(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.file).type == pafs.FileType.File:
                fs.delete_file(m.file)


class Written(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def read_records(stream, wanted: dict[str, set[str]], with_payload: bool) -> Iterator[tuple]:
    """Records of a WARC stream whose headers have the wanted values. Payloads are read only for those."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers.get("content-length", 0))
        row = [headers.get(h.lower()) for h in HEADERS.values()]
        fits = all(headers.get(h.lower()) in values for h, values in wanted.items())
        if fits and with_payload:
            yield (*row, length, stream.read(length))
        else:
            left = length
            while left and (piece := len(stream.read(min(left, 1 << 20)))):
                left -= piece
            if fits:
                yield (*row, length, None)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool, split_bytes: int):
        self.path, self.with_payload, self.split_bytes = path, with_payload, split_bytes
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                header = HEADERS[f.attribute[0]]
                self.wanted[header] = self.wanted[header] & values if header in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = _file_system(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")) and ".warc" in i.base_name)
        groups, size = [], 0
        for path, n in files:
            if not groups or size + n > self.split_bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.path)
        names = [*HEADERS, "payload_bytes", "payload"]
        schema = pa.schema([*((c, pa.string()) for c in HEADERS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(zip(*rows, strict=True), names, strict=True)], schema=schema)

        rows, size = [], 0
        for path in getattr(partition, "paths", ()) or ():
            with fs.open_input_stream(path, compression=None) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                for row in read_records(io.BufferedReader(stream, 1 << 20) if path.endswith(".gz") else stream, self.wanted, self.with_payload):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcSource(DataSource):
    """Options: path, payload (true), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        o = self.options
        return WarcReader(o["path"], o.get("payload", "true").lower() != "false", int(o.get("splitbytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make format("warc") known, with filter push-down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Write a record per page. Equal payloads of at least `least` bytes: the largest id responds, the rest revisit it.

    A null html is an empty payload. Rows that repeat the largest id
    with one payload are all responses. Rows without an id are written as responses of their own. Other columns are ignored.
    """
    register(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # Only digests that repeat matter; the largest id is a map-side combined aggregate, so hot payloads are no burden.
    keys = rows.where((F.octet_length("payload") >= least) & F.col("id").isNotNull()).select("id", "digest")
    first = keys.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keys.join(first, "digest").where("id < first").distinct()
    again = again.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "first")
    joined = rows.join(again, (F.col("id") == F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("first").isNotNull()
    joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        name(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("warc_record_id"),
        F.lit(DATE).alias("warc_date"),
        F.col("url").alias("target_uri"),
        name(F.col("first")).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.octet_length("payload").cast("string").alias("payload_length"),
        F.when(revisit, 0).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under a path."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that write_pages wrote.

    A response's length and digest are those of the payload that was read back; a revisit has no payload, so
    both come from its headers.
    """
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1).try_cast("long")
    response = F.col("warc_type") == "response"
    return records.select(
        number(F.col("warc_record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.substring("payload_digest", 6, 32)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )
