"""Legacy archive converter: ARC files to WARC files.

An ARC file begins with a version block (``filedesc://``), whose declared
length spans a line with the version and a line with the field names.  Version
1 records have five fields (URL, IP, date, type, length), version 2 records ten
(URL, IP, date, type, result code, checksum, location, offset, file name,
length).  The declared length says how many bytes of the block follow.

Conversion synthesises what WARC asks for: a ``urn:uuid`` of the archive's name
and the record's offset, an ISO timestamp of the 14-digit date, SHA-256 digests
of block and payload, and the type: ``warcinfo`` for the version block,
``response`` or ``revisit`` for records.  Of records with equal payloads of at
least LEAST bytes that with the smallest key (then archive and offset) is the
response and the others revisit it without repeating the payload.

Archives are written by Spark's text writer to a shared folder, record by
record with the terminator as line separator, and read as whole files whose
records are streamed by their declared lengths; a payload may hold anything.

Defined cases: a null payload is empty and is written as such; a null URL is
``-``; null keys are written as ``-`` and sort last; repeated rows are separate
records; a record cut short or with a broken header gives a row with ``error``
and ends the reading of that file; an empty table gives no records; other
columns do not matter.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressgraph.session import materialise, scratch_path

LEAST = 100
#: Field lines of the two ARC versions, in the order of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of records handed on together.
HOLD = 8_000_000
KEY = b"X-Archive-Key"


def _line_safe(url: str | None) -> str:
    """ARC fields are parted by spaces, so white space and controls are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as gzipped ARC files, one per partition, versions 1 and 2 in turn."""
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("-")).alias("key"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("html"),
        # The tables have no capture time; one that follows from the key stands in for it.
        F.date_format(F.timestamp_seconds(F.lit(978307200) + F.pmod(F.xxhash64(F.col(id_col)), F.lit(86400 * 365))), "yyyyMMddHHmmss").alias("date"))

    def records(batches):
        number = TaskContext.get().partitionId()
        version, name, offset, started = 1 + number % 2, f"pages-{number:06d}.arc", 0, False
        for batch in batches:
            out, held = [], 0

            def add(record: bytes):
                nonlocal offset, held
                out.append(record)
                offset += len(record) + 1
                held += len(record)

            if not started:
                started = True
                block = f"{version} 0 pressgraph\n{FIELDS[version]}\n".encode()
                tail = "" if version == 1 else f" 200 - - 0 {name}"
                add(f"filedesc://{name} 0.0.0.0 20010101000000 text/plain{tail} {len(block)}\n".encode() + block)
            for key, url, html, date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = (f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{KEY.decode()}: {key}\r\n"
                        f"Content-Length: {len(html)}\r\n\r\n").encode()
                tail = "" if version == 1 else f" 200 - - {offset} {name}"
                add(f"{_line_safe(url)} 0.0.0.0 {date} text/html{tail} {len(head) + len(html)}\n".encode() + head + html)
                if held > HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out.clear()
                    held = 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (rows.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\n").option("compression", "gzip").text(path))


def _open(content: bytes):
    """A stream of a file's bytes, gzipped (one member or many) or plain."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else io.BufferedReader(raw)


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and the entity."""
    at = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)


def _said(line: bytes) -> str:
    """A header line as text: UTF-8 as this module writes, else one character a byte."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _http_key(head: bytes) -> str | None:
    found = re.search(rb"(?im)^" + KEY + rb":[ \t]*([^\r\n]*)", head)
    return _said(found[1]) if found and found[1] != b"-" else None


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def parse_arc(stream):
    """Rows of an ARC stream: dicts of the fields that ARC_ROW names but ``archive``'s payload columns."""
    name, version, offset = None, None, 0
    while True:
        line = stream.readline()
        if not line:
            return
        at, offset = offset, offset + len(line)
        if line in (b"\n", b"\r\n"):
            continue
        field = _said(line.rstrip(b"\r\n")).split(" ")
        row = {"archive": name, "offset": at, "kind": "record", "url": field[0], "error": None, "head": b"", "payload": b""}
        try:
            size = int(field[-1])
            if version is None:
                if not line.startswith(b"filedesc://"):
                    raise ValueError("no version block")
                name = row["archive"] = field[0].removeprefix("filedesc://")
            elif len(field) != len(FIELDS[version].split(" ")):
                raise ValueError(f"{len(field)} fields in a header of version {version}")
            block = stream.read(size)
            if size < 0 or len(block) < size:
                raise ValueError(f"{size} bytes declared, {len(block)} there")
            row |= {"ip": field[1], "date": field[2], "mime": field[3]}
            if not re.fullmatch(r"\d{14}", field[2]):
                raise ValueError("date is not 14 digits")
            if version is None:
                version = int(block.split(b" ", 1)[0])
                if version not in FIELDS:
                    raise ValueError(f"version {version}")
                row |= {"kind": "filedesc", "payload": block}
            else:
                row["head"], row["payload"] = _split_http(block)
            offset += size
        except ValueError as e:
            yield row | {"error": str(e)}
            return
        yield row


ARC_ROW = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("archive", "kind", "url", "ip", "date", "mime", "key", "digest", "error")),
    T.StructField("offset", T.LongType()), T.StructField("payload_bytes", T.LongType())])
CONTENT = [T.StructField("head", T.BinaryType()), T.StructField("payload", T.BinaryType())]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _rows(files: DataFrame, parse, schema: T.StructType) -> DataFrame:
    """Rows that ``parse`` finds in each file, as columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for row in parse(_open(content.as_py())):
                    out.append({n: row.get(n) for n in arrow.names})
                    held += len(row.get("payload") or b"") + 500
                    if held > HOLD:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, arrow)

    return files.mapInArrow(read, schema)


def read_arc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Records of the ARC files below ``path``; ``content`` adds HTTP head and payload."""
    def parse(stream):
        for row in parse_arc(stream):
            yield row | {"key": _http_key(row["head"]), "digest": _sha(row["payload"]), "payload_bytes": len(row["payload"])}

    return _rows(_files(spark, path), parse, T.StructType([*ARC_ROW.fields, *(CONTENT if content else [])]))


def record_id():
    h = F.md5(F.concat_ws("\n", F.lit("arc"), "archive", F.col("offset").cast("string")).cast("binary"))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *part))


def iso_date():
    return F.regexp_replace("date", r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")


def revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """(archive, offset, refers_id, refers_url, refers_date) of the records that revisit another.

    Works on rows without payload: per digest the least record, then the others joined to it.
    """
    known = records.filter(F.col("error").isNull() & (F.col("kind") == "record") & (F.col("payload_bytes") >= least))
    number = F.expr("try_cast(key AS BIGINT)")
    first = F.struct(
        number.isNull().alias("no_number"), number.alias("number"), F.col("key").isNull().alias("no_key"), "key",
        "archive", "offset", record_id().alias("id"), "url", iso_date().alias("iso"))
    best = known.groupBy("digest").agg(F.min(first).alias("best"), F.count("*").alias("n")).filter("n > 1")
    pairs = known.join(best, "digest")
    return pairs.filter(~((F.col("archive") == F.col("best.archive")) & (F.col("offset") == F.col("best.offset")))).select(
        "archive", "offset", F.col("best.id").alias("refers_id"), F.col("best.url").alias("refers_url"), F.col("best.iso").alias("refers_date"))


def to_warc(records: DataFrame, revisited: DataFrame) -> DataFrame:
    """One column ``value``: a WARC record of each ARC record, without its last two line ends."""
    r = records.filter("error IS NULL").join(revisited, ["archive", "offset"], "left")
    again = F.col("refers_id").isNotNull()
    info = F.col("kind") == "filedesc"
    block = F.when(info, F.col("payload")).when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    r = r.withColumn("block", block)

    def line(name: str, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    none = F.lit(None).cast("string")
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(info, "warcinfo").when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), record_id(), F.lit(">"))),
        line("WARC-Date", iso_date()),
        line("WARC-Filename", F.when(info, F.concat("archive", F.lit(".warc")))),
        line("WARC-Target-URI", F.when(~info, F.col("url"))),
        line("WARC-IP-Address", F.when(~info, F.col("ip"))),
        line("WARC-Profile", F.when(again, F.lit(PROFILE)).otherwise(none)),
        line("WARC-Refers-To", F.when(again, F.concat(F.lit("<"), "refers_id", F.lit(">"))).otherwise(none)),
        line("WARC-Refers-To-Target-URI", F.col("refers_url")), line("WARC-Refers-To-Date", F.col("refers_date")),
        line("WARC-Payload-Digest", F.when(~info, F.concat(F.lit("sha256:"), "digest"))),
        line("X-Payload-Length", F.when(~info, F.col("payload_bytes").cast("string"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        line("Content-Type", F.when(info, "application/warc-fields").when(
            F.length("head") > 0, "application/http; msgtype=response").otherwise(F.col("mime"))),
        line("Content-Length", F.length("block").cast("string")), F.lit("\r\n"))
    return r.select(F.concat(header.cast("binary"), F.col("block")).cast("string").alias("value"))


def convert(spark: SparkSession, arc: str, warc: str, least: int = LEAST) -> None:
    """Read the ARC files below ``arc`` and write WARC files below ``warc``."""
    narrow = materialise(read_arc(spark, arc, content=False), "arc-records")
    decided = materialise(revisits(narrow, least), "revisits")
    (to_warc(read_arc(spark, arc), decided).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc))


def parse_warc(stream):
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        row = {"error": None}
        try:
            if not line.startswith(b"WARC/"):
                raise ValueError("no WARC version line")
            head = {}
            while (line := stream.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
            row |= {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"),
                    "date": head.get("warc-date"), "refers_id": head.get("warc-refers-to")}
            size = int(head["content-length"])
            block = stream.read(size)
            if len(block) < size:
                raise ValueError(f"{size} bytes declared, {len(block)} there")
            http, payload = _split_http(block)
            row["key"] = _http_key(http)
            if row["record_type"] == "revisit":
                row |= {"payload_digest": head["warc-payload-digest"].removeprefix("sha256:"), "payload_bytes": int(head["x-payload-length"])}
            else:
                row |= {"payload": payload, "payload_digest": _sha(payload), "payload_bytes": len(payload)}
            row["intact"] = "warc-block-digest" not in head or head["warc-block-digest"] == f"sha256:{_sha(block)}"
        except (ValueError, KeyError) as e:
            yield row | {"error": repr(e)}
            return
        yield row


WARC_ROW = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "uri", "date", "refers_id", "key", "payload_digest", "error")),
    T.StructField("payload_bytes", T.LongType()), T.StructField("intact", T.BooleanType())])


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records of the WARC files below ``path``; digests of responses are computed anew."""
    return _rows(_files(spark, path), parse_warc, T.StructType([*WARC_ROW.fields, *(CONTENT[1:] if payload else [])]))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back, with the key that revisits refer to."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    found = materialise(read_warc(spark, warc), "warc-records")
    first = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_key"))
    return found.filter("record_type IS NULL OR record_type <> 'warcinfo'").join(first, "refers_id", "left")
