"""WARC files and a content-addressed archive of their records.

``archive`` keeps a payload's bytes once, under their SHA-256, and each record's exact header bytes
(WARC fields and HTTP header) in a table of their own; ``restore`` joins them to the original records,
byte for byte. A digest is trusted only after checks: payloads of one SHA-256 must agree in length and
SHA-1 when they are stored, and stored bytes must have their SHA-256 again when they are read.

``revisits`` decides which of the records with equal payloads keeps them; ``write_warc`` writes records
as gzipped WARC files by Spark's own writer (so retried tasks leave no halves, and any file system will
do), ``read_warc`` reads WARC files, plain or gzipped, other tools' included.

A payload that a third of all records share is stored by one row, after each task has kept one copy, and
dealt to as many joining tasks as its records need; only headers and digests are grouped by payload.

Cases: a null payload counts as empty; a null id or URL leaves its field out; of equal payloads the
smallest id keeps them, records without id last; repeated rows are records of their own, with different
record ids; of records with equal payloads and ids the smallest record id keeps them; control characters
and blanks in a URL are percent-encoded; an empty table gives an empty archive; a WARC file that ends
early or breaks the format raises an error that names file and place; a file is read by one task, and
files are written at about ``FILE_BYTES`` (one larger record is a file of its own; Spark reads files
up to 2 GB); further columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import checkpoint_folder, meet, scaled_partitions, small_batches, stored, tidy

FILE_BYTES = 16 << 20
HEAD_BYTES = 600  # about, of a page's record
ROWS_BYTES = 4 << 20  # of records handed to Spark at once
#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def base32(hexed: Column) -> Column:
    """40 hex digits as 32 of base 32."""
    digits = [F.lpad(F.conv(F.substring(hexed, start, n), 16, 32), n * 4 // 5, "0") for start, n in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Per page: page_id, url, record_id and payload (binary)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    url = F.col(url_col).cast("string")
    for code in [*range(33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"))
    unique = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.monotonically_increasing_id().cast("string")))
    return rows.withColumn("record_id", F.regexp_replace(unique, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>"))


def http_head(size: Column) -> Column:
    """The HTTP header of an HTML page of ``size`` bytes."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def record_head(kind: Column, digest: Column, size: Column, refers_to: Column, date: str = "2000-01-01T00:00:00Z") -> Column:
    """A page's header bytes; ``digest`` is the payload's in base 32, ``size`` its bytes, ``refers_to`` a record id or null."""
    http = http_head(size)
    block = F.octet_length(http) + F.when(kind == "revisit", F.lit(0)).otherwise(size)
    fields = [
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _field("WARC-Profile", F.when(refers_to.isNotNull(), F.lit(SAME_PAYLOAD))),
        _field("WARC-Refers-To", refers_to),
        _field("X-Page-ID", F.col("page_id")),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block),
    ]
    return F.concat(*fields, F.lit("\r\n"), http).cast("binary")


def archive(records: DataFrame, folder: str, payload_col: str = "payload", extend: bool = False) -> None:
    """Store ``records`` (any columns and a binary payload) in ``folder``: payloads once each, all else beside them.

    With ``extend`` the folder holds an archive already; payloads that it has are not stored again.
    """
    mode = "append" if extend else "errorifexists"
    keyed = records.withColumns({"size": F.octet_length(payload_col).cast("long"), "digest": F.sha2(payload_col, 256), "sha1": F.sha1(payload_col)})
    check = F.struct("size", "sha1")
    once = keyed.groupBy("digest").agg(F.min(check).alias("low"), F.max(check).alias("high"), F.first(payload_col).alias("payload"))
    differ = F.raise_error(F.concat(F.lit("payloads differ under the digest "), F.col("digest")))
    once = once.select(F.when(F.col("low") == F.col("high"), F.col("digest")).otherwise(differ).alias("digest"), F.col("low.size").alias("size"), F.col("low.sha1").alias("sha1"), "payload")
    if extend:
        once = once.join(records.sparkSession.read.parquet(f"{folder}/payloads").select("digest"), "digest", "left_anti")
    once.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/payloads")
    keyed.drop(payload_col).write.mode(mode).option("compression", "zstd").parquet(f"{folder}/heads")


def with_payloads(heads: DataFrame, folder: str, by: str = "record_id") -> DataFrame:
    """``heads`` (with ``digest``) with their payloads, whose bytes are checked again.

    A payload that many heads need is dealt out: ``by`` spreads its heads over copies of it.
    """
    share = 4 * scaled_partitions(heads.sparkSession)
    counts = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = heads.count()
    crowded = F.broadcast(counts.filter(F.col("n") * share >= max(total, 1)).select("digest", F.expr(f"cast(n * {share}L div {max(total, 1)}L + 1 as int)").alias("copies")))  # at most ``share`` rows
    dealt = heads.join(crowded, "digest", "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64(by), F.col("copies")).cast("int"), F.lit(0))).drop("copies")
    payloads = heads.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "payload").join(crowded, "digest", "left")
    payloads = payloads.select("digest", "payload", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    broken = F.raise_error(F.concat(F.lit("stored bytes do not have the digest "), F.col("digest")))
    joined = dealt.join(payloads, ["digest", "copy"]).drop("copy")
    return joined.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(broken))


def restore(spark: SparkSession, folder: str, by: str = "record_id") -> DataFrame:
    """The records of an archive with their columns, payload and ``record``, their exact bytes."""
    heads = spark.read.parquet(f"{folder}/heads")
    return with_payloads(heads, folder, by).withColumn("record", F.concat("head", "payload", F.lit(END)))


def revisits(heads: DataFrame, least: int = 0, id_col: str = "page_id") -> DataFrame:
    """``heads`` with record_type and the response's id and record id for revisits.

    Of equal payloads of at least ``least`` bytes the record with the smallest id is the response.
    """
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("record_id").alias("record"))
    firsts = heads.groupBy("digest").agg(F.min(order).alias("first_"), F.count(F.lit(1)).alias("n_same"))
    again = (F.col("size") >= least) & (F.col("record_id") != F.col("first_.record"))
    return (
        meet(heads, firsts, ["digest"], "n_same")
        .withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first_.id")), "refers_to_record": F.when(again, F.col("first_.record"))})
        .drop("first_", "n_same")
    )


def write_warc(records: DataFrame, folder: str, average: float) -> None:
    """Write ``head`` and ``payload`` as gzipped WARC files of about ``FILE_BYTES``; ``average``: bytes of a record."""
    lines = records.select(F.concat("head", F.coalesce("payload", F.lit(b""))).cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(FILE_BYTES / max(average, 1)))).text(folder)


def parsed(name: str, raw: bytes) -> Iterator[tuple[int, bytes, bytes, dict[str, str]]]:
    """Place, header bytes, payload and fields (lower-case names) of a WARC file's records."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    stream = io.BufferedReader(stream)
    while first := stream.readline():
        at = stream.tell() - len(first)
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{name}: no record begins at byte {at}")
        lines, fields, last = [first], {}, ""
        while (line := stream.readline()).strip(b"\r\n"):
            lines.append(line)
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.decode("utf-8", "replace").strip()
            else:
                key, _, value = line.decode("utf-8", "replace").partition(":")
                last = key.strip().lower()
                fields[last] = value.strip()
        lines.append(line)
        if not line or not fields.get("content-length", "").isdigit():
            raise ValueError(f"{name}: the record at byte {at} has no header")
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != END:
            raise ValueError(f"{name}: the record at byte {at} ends early")
        head = b"".join(lines)
        if fields.get("content-type", "").lower().startswith("application/http"):
            cut = block.find(END) + 4
            cut = cut if cut > 3 else len(block)
            head, block = head + block[:cut], block[cut:]
        yield at, head, block, fields


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all WARC files below ``folder``: file, at, head, payload and fields (a map, names in lower case)."""
    small_batches(spark)
    schema = "file string, at long, head binary, payload binary, fields map<string,string>"
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.map_(pa.string(), pa.string())]
    names = ["file", "at", "head", "payload", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1)):
                for at, head, payload, fields in parsed(name.as_py(), raw.as_py()):
                    rows.append((name.as_py(), at, head, payload, list(fields.items())))
                    size += len(head) + len(payload)
                    if size > ROWS_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter("length > 0")
    return files.select("path", "content").mapInArrow(tidy(run), schema)


def described(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Pages by the records that ``read_warc`` gave: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id."""
    field = F.col("fields").getItem
    digest = base32(F.sha1("payload"))
    wrong = F.raise_error(F.concat(F.lit("a payload read does not have its digest in "), F.col("file")))
    kind, said = field("warc-type"), field("warc-payload-digest")
    rows = records.select(
        field("x-page-id").cast(id_type).alias("page_id"),
        kind.alias("record_type"),
        field("warc-record-id").alias("record_id"),
        field("warc-refers-to").alias("refers_to_record"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when((kind == "revisit") | (said == F.concat(F.lit("sha1:"), digest)), F.substring(said, 6, 32)).otherwise(wrong).alias("payload_digest"),
    )
    rows = stored(rows, "warc-read")
    full = rows.filter("record_type = 'response'")
    again = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "record_id", "refers_to_record")
    asked = again.groupBy("refers_to_record").agg(F.count(F.lit(1)).alias("n_asked"))
    named = full.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    named = named.join(asked, "refers_to_record")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    return full.withColumn("refers_to", F.lit(None).cast(id_type)).select(*out).unionByName(meet(again, named, ["refers_to_record"], "n_asked").select(*out))


def archived_pages(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Archive ``pages``, write them as WARC files, read those back, and describe every page by what was read.

    Per page: page_id, payload_bytes, payload_digest (base 32 SHA-1), record_type, refers_to, record_id.
    Revisits have no payload of their own in the files; theirs is their response's, by record id.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    records = page_records(pages)
    digest, size = base32(F.sha1("payload")), F.octet_length("payload").cast("long")
    archive(records.withColumn("head", record_head(F.lit("response"), digest, size, F.lit(None))), f"{folder}/archive")
    heads = spark.read.parquet(f"{folder}/archive/heads").drop("head")  # made again of the same columns, so not shuffled
    marked = stored(revisits(heads, least), "warc-marked")  # read several times below
    head = record_head(F.col("record_type"), base32(F.col("sha1")), F.col("size"), F.col("refers_to_record"))
    again = marked.filter("record_type = 'revisit'").select(head.alias("head"), F.lit(None).cast("binary").alias("payload"))
    full = with_payloads(marked.filter("record_type = 'response'"), f"{folder}/archive").withColumn("head", head)
    kept = marked.filter("record_type = 'response'").agg(F.avg("size").alias("bytes")).first()
    write_warc(full.select("head", "payload"), f"{folder}/warc/responses", HEAD_BYTES + (kept.bytes or 0))
    write_warc(again, f"{folder}/warc/revisits", HEAD_BYTES)
    return described(read_warc(spark, f"{folder}/warc"), pages.schema["page_id"].dataType.simpleString())
