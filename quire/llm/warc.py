"""WARC archives as a Spark data source, and a deduplicating archive writer.

Reading (``spark.read.format("warc").load(folder)``, after ``register``): the
driver plans partitions of whole files, packed to ``partition_bytes``. Filters
on the header columns (record type, id, URI, date, digest, lengths) are pushed
into the reader, which parses a record's headers first, drops the record if one
does not hold, and inflates the block only if the ``payload`` column was asked
for (``columns``). A member written here names its own compressed length in
the gzip ``sl`` extra field, so an unwanted one is passed over with a seek;
members without it are inflated and thrown away. Plain, member-per-record and
single-member gzip files are read alike.

Writing (``df.write.format("warc").mode("append").save(folder)``): every task
writes its own files (a new name for each attempt, a new file from
``max_file_bytes``), and the commit names the files of the successful attempts
in ``_manifest.json``. Readers take only these, so what a lost executor left
behind is never read. Files are reached through ``pyarrow.fs``, in whatever
store the folder's URI names.

``archive`` writes one record per page. Of rows with equal payloads of at least
``min_bytes`` bytes the one with the largest id is a ``response`` and the others
are ``revisit`` records that refer to it and hold no payload; smaller payloads
are always responses. The payload goes through one shuffle, after a map-side
maximum by digest; revisits are decided on rows without payload.

Edge cases: NULL payload: empty. NULL id: an empty key, NULL again when read; it
is smaller than any other. Of rows equal in id and payload the largest URI is
the response (NULL least), and of wholly equal rows one. NULL URI: no URI
header. Control characters of header values are percent-encoded. Empty table: an
archive without records. A record that is cut off or malformed is an error that
names file and position. Other columns of the input are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import uuid
import zlib
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

from quire.llm.common import ship
from quire.session import checkpoint_dir

ship(__name__)

SCHEMA = ("file string, position long, record_type string, record_id string, target_uri string, warc_date string, "
          "refers_to string, payload_sha1 string, content_type string, content_length long, payload_bytes long, "
          "headers map<string,string>, payload binary")
WRITE_SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_sha1 string, "
                "payload_bytes long, payload binary")
HEADER_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
                  "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_sha1": "warc-payload-digest",
                  "content_type": "content-type", "content_length": "content-length"}
MANIFEST = "_manifest.json"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64 << 20
MAX_FILE_BYTES = 128 << 20
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
MAX_HEAD = 1 << 20                      # a record's headers are refused beyond this
DATE = "2026-01-01T00:00:00Z"


def _store(uri: str):
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


# -- byte streams -----------------------------------------------------------

class _Window:
    """Random reads of a file through a buffer."""

    def __init__(self, f, size: int, step: int = 1 << 20):
        self.f, self.size, self.step, self.lo, self.buf = f, size, step, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if n <= 0:
            return b""
        if pos < self.lo or pos + n > self.lo + len(self.buf):
            self.lo, self.buf = pos, self.f.read_at(min(max(n, self.step), self.size - pos), pos)
        return self.buf[pos - self.lo:pos - self.lo + n]


class _Plain:
    """Bytes of an uncompressed file."""

    def __init__(self, window: _Window):
        self.w, self.pos = window, 0

    def start(self) -> int | None:
        """Position of the record that starts here; None at the end."""
        return self.pos if self.pos < self.w.size else None

    def peek(self, n: int) -> bytes:
        return self.w.get(self.pos, n)

    def take(self, n: int) -> bytes:
        got = self.w.get(self.pos, n)
        self.pos += len(got)
        return got

    def skip(self, n: int) -> int:
        n = min(n, self.w.size - self.pos)
        self.pos += n
        return n

    def pass_over(self, length: int) -> bool:
        return False


class _Gzip:
    """Inflated bytes of a gzip file, across its members."""

    def __init__(self, window: _Window):
        self.w, self.pos, self.member, self.d, self.out = window, 0, 0, None, b""

    def _fill(self, n: int) -> None:
        """At least ``n`` inflated bytes at hand, or the end of the file."""
        parts, held = [self.out], len(self.out)
        while held < n:
            if self.d is None or self.d.eof:
                if self.d is not None:
                    self.pos -= len(self.d.unused_data)
                    self.d = None
                if self.pos >= self.w.size:
                    break
                if held:                # never run on into the next member unasked
                    break
                self.member, self.d = self.pos, zlib.decompressobj(31)
            src = self.d.unconsumed_tail
            if not src:
                src = self.w.get(self.pos, 1 << 16)
                self.pos += len(src)
                if not src:
                    raise ValueError(f"gzip member at {self.member} is cut off")
            try:
                got = self.d.decompress(src, max(n - held, 1 << 12))
            except zlib.error as e:
                raise ValueError(f"gzip member at {self.member}: {e}") from e
            parts.append(got)
            held += len(got)
        self.out = b"".join(parts)

    def start(self) -> int | None:
        if not self.out:
            self._fill(1)
        return self.member if self.out else None

    def peek(self, n: int) -> bytes:
        if len(self.out) < n:
            self._fill(n)
        return self.out[:n]

    def take(self, n: int) -> bytes:
        if len(self.out) < n:
            self._fill(n)
        got, self.out = self.out[:n], self.out[n:]
        while len(got) < n and self.start() is not None:
            more = self.take(n - len(got))
            got += more
        return got

    def skip(self, n: int) -> int:
        left = n
        while left:
            got = len(self.take(min(left, 1 << 18)))
            if not got:
                break
            left -= got
        return n - left

    def pass_over(self, length: int) -> bool:
        """Go to the next member without inflating this one, where its header
        names its compressed length and that it holds ``length`` bytes, the
        record alone."""
        head = self.w.get(self.member, 12)
        if len(head) < 12 or not head[3] & 4:
            return False
        extra = self.w.get(self.member + 12, int.from_bytes(head[10:12], "little"))
        while len(extra) >= 4:
            n = int.from_bytes(extra[2:4], "little")
            if extra[:2] == b"sl" and n == 8 and int.from_bytes(extra[8:12], "little") == length:
                self.pos, self.d, self.out = self.member + int.from_bytes(extra[4:8], "little"), None, b""
                return True
            extra = extra[4 + n:]
        return False


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member that names its compressed length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    if whole < 1 << 32 and len(record) < 1 << 32:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (12).to_bytes(2, "little") + b"sl\x08\0" \
            + whole.to_bytes(4, "little") + len(record).to_bytes(4, "little")
    else:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


# -- records ----------------------------------------------------------------

def _head(stream, what: str) -> bytes:
    """Bytes up to and with the next empty line."""
    n = 1 << 10
    while True:
        got = stream.peek(n)
        at = got.find(b"\r\n\r\n")
        if at >= 0:
            return stream.take(at + 4)
        if len(got) < n or n > MAX_HEAD:
            raise ValueError(f"{what} without an end")
        n *= 2


def _fields(head: bytes) -> dict[str, str]:
    """Header lines (the first line left out) by lower-case name; folded lines
    belong to the one before, of repeated names the first counts."""
    lines: list[str] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line:
            lines.append(line)
    out: dict[str, str] = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if sep:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _sha1_hex(digest: str | None) -> str | None:
    """Bare lower-case hex of a labelled digest in hex or base 32; None for
    another algorithm."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    if re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return None


def _value(column: str, fields: dict[str, str]):
    got = fields.get(HEADER_COLUMNS[column])
    if column == "payload_sha1":
        return _sha1_hex(got)
    if column == "content_length":
        return int(got)
    if got is not None and column in ("record_id", "refers_to") and got[:1] == "<" and got[-1:] == ">":
        return got[1:-1]
    return got


def records(stream, wanted=lambda fields: True, http: bool = True, payload: bool = True):
    """``(position, fields, payload_bytes, payload)`` of every record whose
    fields are wanted. Without ``http`` and ``payload`` no block is looked at."""
    while (at := stream.start()) is not None:
        head = _head(stream, "a record's head")
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}: {head[:20]!r}")
        fields = _fields(head)
        left = int(fields["content-length"])
        length = len(head) + left + 4
        n_bytes = body = None
        if wanted(fields):
            n_bytes = left
            if (http or payload) and fields.get("content-type", "").startswith("application/http") and left:
                first = _head(stream, "an HTTP head")
                left -= len(first)
                n_bytes = left
                if fields.get("warc-type") == "revisit":
                    length = _fields(first).get("content-length", "")
                    n_bytes = int(length) if length.isdigit() else None
            if payload and fields.get("warc-type") != "revisit":
                body = stream.take(left)
                if len(body) < left:
                    raise ValueError(f"the record at {at} is cut off")
                left = 0
            yield at, fields, n_bytes, body
        elif stream.pass_over(length):
            continue
        if not (left and not payload and stream.pass_over(length)):
            if stream.skip(left) < left or stream.take(4) != b"\r\n\r\n":
                raise ValueError(f"the record at {at} is cut off")


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(kind: str, record_id: str, date: str, uri: str | None = None, refers_to: str | None = None,
                 sha1: str | None = None, n_bytes: int | None = None, payload: bytes | None = None) -> bytes:
    """A response with ``payload``, or a revisit of the payload with that digest and length."""
    if kind == "response":
        payload = payload or b""
        sha1, n_bytes = hashlib.sha1(payload).hexdigest(), len(payload)
    else:
        payload = b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_clean(refers_to)}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


# -- pushed filters ---------------------------------------------------------

def _holds(f, x):
    """SQL value (True, False, None) of a pushed filter for a column's value."""
    if isinstance(f, ds.Not):
        got = _holds(f.child, x)
        return None if got is None else not got
    if isinstance(f, ds.IsNull):
        return x is None
    if isinstance(f, ds.IsNotNull):
        return x is not None
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    if x is None:
        return None
    if isinstance(f, ds.In):
        return True if x in f.value else (None if None in f.value else False)
    if f.value is None:
        return None
    return _TESTS[type(f)](x, f.value)


_TESTS = {
    ds.EqualTo: lambda x, v: x == v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.StringContains: lambda x, v: v in x}


def _column(f) -> str | None:
    """The header column a filter reads, if the reader can decide the filter."""
    inner = f.child if isinstance(f, ds.Not) else f
    known = (*_TESTS, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.In)
    if not isinstance(inner, known) or len(inner.attribute) != 1 or inner.attribute[0] not in HEADER_COLUMNS:
        return None
    return inner.attribute[0]


# -- the data source --------------------------------------------------------

@dataclass
class Files(ds.InputPartition):
    """Whole files for one task."""

    names: list


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        unknown = set(self.names) - set(c.split()[0] for c in SCHEMA.split(", "))
        if unknown:
            raise ValueError(f"no such columns of a record: {sorted(unknown)}")
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow, self.path, self.filters = to_arrow_schema(schema), options["path"], []
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if _column(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        store, at = _store(self.path)
        out, held = [], 0
        for name, size in archive_files(store, at):
            if not out or held + size > self.partition_bytes:
                out.append(Files([]))
                held = 0
            out[-1].names.append(name)
            held += size
        return out or [Files([])]

    def read(self, partition):
        store, at = _store(self.path)
        tests = [(_column(f), f) for f in self.filters]
        columns = {name: [] for name in self.names}
        n = held = 0

        def wanted(fields):
            return all(_holds(f, _value(c, fields)) is True for c, f in tests)

        def batch():
            arrays = [pa.array(columns[f.name], f.type) for f in self.arrow]
            for c in columns.values():
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=self.arrow)

        for name in partition.names:
            with store.open_input_file(f"{at}/{name}") as f:
                window = _Window(f, f.size())
                stream = _Gzip(window) if window.get(0, 2) == b"\x1f\x8b" else _Plain(window)
                found = records(stream, wanted, "payload_bytes" in columns, "payload" in columns)
                while True:
                    try:
                        got = next(found, None)
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e
                    if got is None:
                        break
                    position, fields, n_bytes, payload = got
                    for c, values in columns.items():
                        values.append(name if c == "file" else position if c == "position" else n_bytes
                                      if c == "payload_bytes" else payload if c == "payload" else list(fields.items())
                                      if c == "headers" else _value(c, fields))
                    n, held = n + 1, held + len(payload or b"")
                    if n >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch()
                        n = held = 0
        if n:
            yield batch()


def archive_files(store, at: str) -> list[tuple[str, int]]:
    """Names and sizes of an archive's files: those its manifest names, or, in a
    folder written by others, all that end as archives do."""
    from pyarrow import fs

    there = {i.base_name: i.size for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File}
    if MANIFEST in there:
        with store.open_input_stream(f"{at}/{MANIFEST}") as f:
            return [(n, there[n]) for n in json.loads(f.read())]
    return sorted((n, s) for n, s in there.items() if n.endswith((".warc", ".warc.gz")))


@dataclass
class Written(ds.WriterCommitMessage):
    names: list


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.max_file_bytes = int(options.get("max_file_bytes", MAX_FILE_BYTES))
        self.level, self.date = int(options.get("level", 6)), options.get("date", DATE)

    def write(self, iterator):
        store, at = _store(self.path)
        task, names, out, size = TaskContext.get(), [], None, 0
        store.create_dir(at, recursive=True)
        for batch in iterator:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                kind, rid, uri, refers, sha1, n_bytes, payload = (
                    column[c.split()[0]][i].as_py() for c in WRITE_SCHEMA.split(", "))
                if out is not None and size >= self.max_file_bytes:
                    out.close()
                    out = None
                if out is None:
                    names.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{len(names)}.warc.gz")
                    out = store.open_output_stream(f"{at}/{names[-1]}", compression=None)
                    size = self._put(out, self._info(names[-1]))
                size += self._put(out, record_bytes(kind, rid, self.date, uri, refers, sha1, n_bytes, payload))
        if out is not None:
            out.close()
        return Written(names)

    def _put(self, out, record: bytes) -> int:
        got = member(record, self.level)
        out.write(got)
        return len(got)

    def _info(self, name: str) -> bytes:
        block = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
        return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {self.date}\r\n"
                f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
                ).encode() + block + b"\r\n\r\n"

    def commit(self, messages):
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        before = [] if not self._committed(store, at) else [n for n, _ in archive_files(store, at)]
        names = [n for m in messages if m is not None for n in m.names]
        with store.open_output_stream(f"{at}/{MANIFEST}") as f:
            f.write(json.dumps(([] if self.overwrite else before) + names).encode())
        if self.overwrite:
            for n in before:
                store.delete_file(f"{at}/{n}")

    def _committed(self, store, at) -> bool:
        from pyarrow import fs

        return store.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.File

    def abort(self, messages):
        store, at = _store(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                store.delete_file(f"{at}/{n}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the ``warc`` format known to the session, with filter pushdown."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_archive(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The records of an archive; only the named columns are read."""
    register(spark)
    kinds = {c.split()[0]: c for c in SCHEMA.split(", ")}
    return spark.read.format("warc").schema(", ".join(kinds[c] for c in columns or kinds)).load(folder)


# -- the archive of a table of pages ----------------------------------------

def _copies(df: DataFrame, n: Column, step: int = 4096) -> DataFrame:
    """Every row ``n`` times; a row with very many copies is dealt over tasks."""
    parts = df.withColumn("__n", n).where("__n > 0") \
        .withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / step).cast("long"))))
    return parts.repartition("payload_sha1", "__id", "__part") \
        .withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col("__n") - F.col("__part") * step)))) \
        .drop("__n", "__part", "__k")


def _record_id(key: str, suffix: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(F.col(key).cast("string")), F.lit("")), F.lit(":"), suffix)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000, id_col: str = "page_id",
            uri: str = "url", payload: str = "html", **options) -> str:
    """Write one record per page into ``folder`` (a new one in the shared
    checkpoint folder if none is named); returns the folder."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or os.path.join(checkpoint_dir(spark), "warc", uuid.uuid4().hex)
    base = pages.select(F.col(id_col).alias("__id"), F.col(uri).alias("target_uri"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")) \
        .withColumn("payload_sha1", F.sha1("payload")) \
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = F.col("payload_bytes") >= min_bytes
    columns = [c.split()[0] for c in WRITE_SCHEMA.split(", ")]
    none = F.lit(None).cast("string").alias("refers_to")

    small = base.where(~large).withColumn("record_type", F.lit("response")).withColumn("refers_to", none) \
        .withColumn("record_id", _record_id("__id", F.uuid()))
    first = base.where(large).groupBy("payload_sha1", "payload_bytes") \
        .agg(F.max(F.struct("__id", "target_uri", "payload")).alias("w")) \
        .select("payload_sha1", "payload_bytes", "w.*").withColumn("record_type", F.lit("response")) \
        .withColumn("refers_to", none).withColumn("record_id", _record_id("__id", F.col("payload_sha1")))
    narrow = base.where(large).select("payload_sha1", "payload_bytes", "__id", "target_uri")
    best = narrow.groupBy("payload_sha1").agg(F.max(F.struct("__id", "target_uri")).alias("w"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("payload_sha1", F.col("w.__id").alias("__wid"), F.col("w.target_uri").alias("__wuri"))
    rows = narrow.groupBy("payload_sha1", "payload_bytes", "__id", "target_uri").agg(F.count(F.lit(1)).alias("__c"))
    is_first = F.col("__id").eqNullSafe(F.col("__wid")) & F.col("target_uri").eqNullSafe(F.col("__wuri"))
    others = _copies(rows.join(best, "payload_sha1"), F.col("__c") - is_first.cast("long")) \
        .withColumn("record_type", F.lit("revisit")).withColumn("payload", F.lit(None).cast("binary")) \
        .withColumn("record_id", _record_id("__id", F.uuid())) \
        .withColumn("refers_to", _record_id("__wid", F.col("payload_sha1")))
    whole = small.select(*columns).unionByName(first.select(*columns)).unionByName(others.select(*columns))
    whole.write.format("warc").mode("append").options(**options).save(folder)
    return folder


def key_of(record_id: str) -> Column:
    """The page key that ``archive`` put into a record id; NULL if it was."""
    got = F.regexp_extract(record_id, "^urn:page:([^:]*):", 1)
    return F.when(got != "", F.url_decode(got))


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of an archive by ``archive``, from its records: a response's
    length and digest are those of the payload read, a revisit's those it states."""
    rows = read_archive(spark, folder, "record_type", "record_id", "refers_to", "payload_sha1", "payload_bytes", "payload") \
        .where(F.col("record_type").isin("response", "revisit"))
    own = F.col("record_type") == "response"
    return rows.select(
        key_of("record_id").alias("page_key"),
        F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("payload")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        "record_type", key_of("refers_to").alias("refers_to"))
