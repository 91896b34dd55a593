"""WARC archives with revisit records, written, read and resolved.

``archive`` shuffles the headers of records (digest, size, key: no payloads) by
payload digest, finds for each payload of at least ``least`` bytes the record
with the smallest key, and writes that one as ``response`` and those with equal
payloads as ``revisit``, all with fresh headers, to gzipped WARC/1.1 files.
``read`` parses archives, checks responses' digests, and joins revisit records
to the original responses by digest, whichever file they are in.  ``records``
does so with payloads, in the form that ``archive`` takes: archives that hold
copies are so rewritten without.  Archives of other writers may have SHA-1 or
SHA-256 digests, in base 32 or hexadecimal, or none, several responses of one
payload, records of other types (they are passed over), and no manifest: then all
``.warc`` and ``.warc.gz`` files of the folder are read, and keys are null.

A payload held by a third of all records is one row of the digest table; that
table goes to the tasks by broadcast if it has at most ``BROADCAST`` rows, else
by a shuffle join that Spark splits where it is skewed.

A task writes one file, under a name of its own, and only files in the manifest
count, so tasks may run again.

Nulls: a null payload counts as empty; a null address leaves out the header; a
null key is kept and ranks last among equal payloads.  Of records equal in
payload and key one is the response.  Payloads below ``least`` bytes are always
responses.  Line breaks in an address are percent-encoded.  A revisit whose
response isn't there keeps its declared digest, without size and payload.  Very
long payloads are held one at a time.  Extra columns are not looked at.  An empty
table gives an empty manifest.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of 40 bytes or so that are broadcast at most.
BROADCAST = 500_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = str.maketrans({"\r": "%0D", "\n": "%0A"})


def _record_id(*parts) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def _fields(pairs) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def record(key, url: str | None, payload: bytes, digest: str, original, date: str, level: int = 6) -> bytes:
    """One gzipped record; ``original``: a (key,) of the response that it revisits, or None."""
    url = url.translate(_BREAKS) if url is not None else None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if original is None else http
    kind = "response" if original is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(kind, key, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if original is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id("response", original[0], digest)), ("WARC-Refers-To-Date", date)]
    head += [("WARC-Source-Key", key), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return gzip.compress(b"WARC/1.1\r\n" + _fields(head) + b"\r\n" + block + b"\r\n\r\n", level, mtime=0)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record in an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a record's block is cut short")
        yield head, block


def archive(pages: DataFrame, out_dir: str, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 100) -> DataFrame:
    """Write ``pages`` to deduplicated archives below ``out_dir``; returns the manifest: file, records."""
    spark = pages.sparkSession
    # one time for all records and all runs of a task
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    data = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(pages[key].alias("key"), pages[url].cast("string").alias("url"), data.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload"))
    rank = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"))
    heads = common.written(rows.where(F.col("n") >= least).select("key", "digest"), "headers")
    firsts = heads.groupBy("digest").agg(F.count("*").alias("copies"), F.min(rank).alias("first")).where("copies > 1").select(F.col("digest").alias("d"), F.col("first.key").alias("first"))
    firsts = common.written(firsts, "originals")
    side = F.broadcast(firsts) if firsts.count() <= BROADCAST else firsts
    rows = rows.join(side, (F.col("digest") == F.col("d")) & (F.col("n") >= least), "left")
    same = F.col("d").isNotNull() & F.col("key").eqNullSafe(F.col("first"))
    # more than one record with the smallest key: one of them is the response
    ties = heads.join(side, F.col("digest") == F.col("d")).where(same).groupBy("digest").count().where("count > 1")
    if ties.isEmpty():
        rows = rows.withColumn("original", F.col("d").isNull() | same)
    else:
        nth = F.row_number().over(Window.partitionBy("digest", "key").orderBy("url"))
        rows = rows.withColumn("same", same)
        rest = rows.where(~F.col("same")).withColumn("original", F.col("d").isNull())
        rows = rest.unionByName(rows.where("same").withColumn("original", nth == 1))
    rows = rows.select("key", "url", "digest", "original", "first", F.col("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, folder = common.filesystem(out_dir)
        fs.create_dir(folder, recursive=True)
        name, out, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for key_, url_, digest, own, first, data in zip(*batch.columns):
                if out is None:
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(record(key_.as_py(), url_.as_py(), data.as_py(), digest.as_py(), None if own.as_py() else (first.as_py(),), date))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    rows.mapInArrow(write, "file string, records long").write.parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def declared(head: dict[str, str]) -> str | None:
    """A record's payload digest as algorithm and lower-case hexadecimal digits; None if it has none that is known."""
    name, _, value = head.get("warc-payload-digest", "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    size = {"sha1": 20, "sha256": 32}.get(name)
    if size is None:
        return None
    if len(value) == 2 * size:
        return f"{name}:{value.lower()}"
    try:
        data = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return f"{name}:{data.hex()}" if len(data) == size else None


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """What a response's block holds: the body of a message, or the block itself of a resource."""
    if "http" in head.get("content-type", "") and head["warc-type"] == "response":
        return block.partition(b"\r\n\r\n")[2]
    return block


def _files(spark: SparkSession, out_dir: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifest")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(f"{out_dir}/manifest").select("file")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(out_dir)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"))


def _parsed(spark: SparkSession, out_dir: str, payloads: bool) -> DataFrame:
    files = _files(spark, out_dir)
    n = max(1, files.count())
    schema = "source_key string, url string, type string, declared string, digest string, n long, payload binary"

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = common.filesystem(out_dir)
        names = ["source_key", "url", "type", "declared", "digest", "n", "payload"]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as raw, (gzip.open(raw) if name.endswith(".gz") else io.BufferedReader(raw)) as stream:
                    for head, block in parse(stream):
                        kind, told = head["warc-type"], declared(head)
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        about = head.get("warc-source-key"), head.get("warc-target-uri")
                        if kind == "revisit":
                            rows.append((*about, kind, told, told and told.partition(":")[2], None, None))
                        else:
                            data = payload_of(head, block)
                            digest = hashlib.sha256(data).hexdigest()
                            if told and told not in (f"sha256:{digest}", f"sha1:{hashlib.sha1(data).hexdigest()}" if told.startswith("sha1") else None):
                                raise ValueError(f"{name}: a payload doesn't have its digest")
                            rows.append((*about, "response", told or f"sha256:{digest}", digest, len(data), data if payloads else None))
                            held += len(data) if payloads else 0
                        if len(rows) >= 5000 or held > 1 << 24:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return files.repartition(n, "file").mapInArrow(load, schema)


def read(spark: SparkSession, out_dir: str, *, key_type: str = "long", payloads: bool = False, least: int = 100) -> DataFrame:
    """Every record: key, url, payload_bytes, payload_digest, record_type, refers_to, and with ``payloads`` the payload."""
    found = _parsed(spark, out_dir, payloads)
    if not payloads:
        found = common.written(found.drop("payload"), "parsed").withColumn("payload", F.lit(None).cast("binary"))
    key = F.col("source_key").cast(key_type)
    out = [F.col("url"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type")]
    more = [F.col("payload")] if payloads else []
    first = found.where("type = 'response'").select(key.alias("key"), *out, F.lit(None).cast(key_type).alias("refers_to"), *more)
    again = found.where("type = 'revisit'").select(key.alias("key"), "url", "declared", F.col("digest").alias("told"))
    # of several responses of a payload that is revisited, that with the smallest key
    sought = again.select("declared").distinct()
    source = found.where(F.col("type") == "response").where(F.col("n") >= least).join(sought, "declared", "left_semi")
    source = source.select(F.col("declared").alias("d"), F.struct(key.isNull(), key.alias("k"), "url", "n", "digest", *more).alias("s")).groupBy("d").agg(F.min("s").alias("s"))
    joined = again.join(source, F.col("declared") == F.col("d"), "left")
    joined = joined.select("key", "url", F.col("s.n").alias("payload_bytes"), F.coalesce("s.digest", "told").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("s.k").alias("refers_to"), *[F.col("s.payload").alias("payload") for _ in more])
    return first.unionByName(joined)


def records(spark: SparkSession, out_dir: str, **options) -> DataFrame:
    """Archives' records with their full payloads, as ``archive`` takes them: page_id, url, html (binary)."""
    found = read(spark, out_dir, payloads=True, **options)
    return found.select(F.col("key").alias("page_id"), "url", F.col("payload").alias("html"))
