"""Deterministic sharded WARC writer and its reader.

Payloads become gzip members, one record each, with regenerated headers and digests. Of records with equal payloads of
at least ``MIN_REVISIT`` bytes that with the smallest page id is the response, the others are revisits of it. Records
are range-sorted by page id; files are rolled by the running compressed size, which does not depend on how Spark cut the
ranges, so equal input gives equal files. Sizes and places are settled on narrow rows first, so records are compressed
twice, but moved only once. Files are written under a temporary name, renamed, and become valid with the
manifest that lists them, which is renamed last; the reader takes listed files only. All files go through Spark's
writers and Hadoop's renames, so any shared store will do.

Defined cases: null html is an empty payload; a null url becomes ``about:blank``; blanks and line breaks in urls are
percent-encoded; rows without an id come last; rows that repeat an id and payload are written each, and count as pages of
their own (of equal ones of at least ``MIN_REVISIT`` bytes one is the response, by url); very long payloads are one record
of one task; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from hazlake.llm.common import NO_ID, doc_id_of, stored
from hazlake.operators.postings import join_terms

MIN_REVISIT, ROLL = 100, 16 << 20
#: Groups of files whose first keys (some 100 bytes each) every task holds.
GROUPS = 4096
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member: ends each file, since Spark's text writer ends each row with a separator.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def record_id(page: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}:{digest}'.encode()).digest()[:16], version=5)}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    fixed = [("WARC-Date", DATE), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers + fixed) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # its gzip header holds no time
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def response(page: int, url: str | None, payload: bytes, digest: str) -> bytes:
    own = [("WARC-Type", "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Target-URI", _uri(url)),
           ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page), ("X-Payload-Length", len(payload))]
    return _member(own, _http(len(payload)) + payload)


def revisit(page: int, url: str | None, length: int, digest: str, first: int) -> bytes:
    own = [("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Target-URI", _uri(url)), ("WARC-Profile", PROFILE),
           ("WARC-Refers-To", record_id(first, digest)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page),
           ("X-Payload-Length", length), ("X-Refers-To-Page", first)]
    return _member(own, _http(length))


def _payload(html: str | None) -> tuple[bytes, str]:
    payload = (html or "").encode("utf-8", "surrogatepass")
    return payload, hashlib.sha256(payload).hexdigest()


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The narrow facts of each row: its digest, and the sizes of its payload and of its record as a response."""
    for pdf in batches:
        rows = []
        for page, url, html in zip(pdf["page"], pdf["url"], pdf["html"]):
            payload, digest = _payload(html)
            rows.append((page, url, digest, len(payload), len(response(page, url, payload, digest))))
        yield pd.DataFrame(rows, columns=["page", "url", "digest", "length", "own"])


def _sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes that all rows of a page, payload and url take: of a shared payload one is a response, the others revisits."""
    for pdf in batches:
        size = []
        for page, url, digest, length, own, n, first, answers in zip(*(pdf[c] for c in ("page", "url", "digest", "length", "own", "n", "first", "answers"))):
            again = len(revisit(page, url, length, digest, first)) if first >= 0 else 0
            size.append(own * n if first < 0 else own + again * (n - 1) if answers else again * n)
        yield pdf.assign(size=size)[["page", "digest", "n", "first", "size"]]


def _records(starts: list[tuple[int, str]]):
    """Each row's compressed response and the group it falls into."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, url, html in zip(pdf["page"], pdf["url"], pdf["html"]):
                payload, digest = _payload(html)
                group = bisect.bisect_right(starts, (page, digest)) - 1
                rows.append((group, page, digest, 1, url, len(payload), response(page, url, payload, digest)))
            yield pd.DataFrame(rows, columns=["group", "page", "digest", "kind", "url", "length", "record"])

    return run


def _files(offsets: list[int], roll: int):
    """Records, sorted by group, page, digest and kind, joined to one row a file.

    A marker (kind 0) before the records of a page and payload names the page that the payload is first found on.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, key, file, parts, offset, first = None, None, None, [], 0, None

        def done() -> pd.DataFrame:
            return pd.DataFrame({"file": [file], "content": [b"".join(parts)]})

        for pdf in batches:
            for g, page, digest, kind, url, length, record in zip(*(pdf[c] for c in ("group", "page", "digest", "kind", "url", "length", "record"))):
                if g != group:
                    group, offset = g, offsets[g]
                if (page, digest) != key:
                    key, first, seen = (page, digest), None, 0
                    if offset // roll != file and parts:
                        yield done()
                        parts = []
                    file = offset // roll
                if not kind:
                    first = int(length)
                    continue
                if first is not None and (first < page or seen):
                    record = revisit(page, url, int(length), digest, first)
                seen += 1
                parts.append(record)
                offset += len(record)
        if parts:
            yield done()

    return run


def placement(pages: DataFrame) -> DataFrame:
    """page, digest, n (rows), first (page whose response its revisits refer to, -1 if none), size (bytes of its records),
    before (bytes of all records before them in the order of page and digest)."""
    base = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    facts = base.mapInPandas(_measured, "page long, url string, digest string, length long, own long")
    facts = stored(facts, "facts")
    keys = stored(facts.groupBy("page", "digest", "url").agg(F.max("length").alias("length"), F.max("own").alias("own"), F.count("*").alias("n")), "keys")
    total = keys.count()
    large = keys.where(F.col("length") >= MIN_REVISIT)
    shared = large.groupBy("digest").agg(F.min(F.struct("page", "url")).alias("head"), F.sum("n").alias("rows"), F.count("*").alias("uses")).where("rows > 1")
    shared = stored(shared.select("digest", F.col("head.page").alias("first"), F.col("head.url").alias("first_url"), "uses"), "shared")
    # a payload that a great part of the pages has is joined by broadcast
    found = join_terms(large, shared, ["digest"], "uses", total)
    found = found.withColumn("answers", (F.col("page") == F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))).drop("uses", "first_url")
    rest = keys.join(found.select("page", "digest").distinct(), ["page", "digest"], "left_anti")
    rest = rest.withColumns({"first": F.lit(-1).cast("bigint"), "answers": F.lit(True)})
    sized = found.unionByName(rest).mapInPandas(_sized, "page long, digest string, n long, first long, size long")
    sized = sized.groupBy("page", "digest").agg(F.sum("n").alias("n"), F.max("first").alias("first"), F.sum("size").alias("size"))
    ranges = stored(sized.repartitionByRange("page", "digest").withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("range").agg(F.sum("size").alias("n"))
    before = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))  # a row for each partition
    own = F.sum("size").over(Window.partitionBy("range").orderBy("page", "digest")) - F.col("size")
    return ranges.withColumn("own", own).join(F.broadcast(before), "range").select("page", "digest", "n", "first", "size", (F.col("own") + F.col("start")).alias("before"))


def write(pages: DataFrame, out: str, roll: int = ROLL) -> DataFrame:
    """Writes the archive to a new folder; returns its manifest: file, records, bytes, sha256.

    What a record's place depends on is narrow: digests, sizes and first pages. From them follow all files, and at most
    ``GROUPS`` groups of neighbouring files whose first keys and offsets every task knows. So a record is moved once, to its
    group, where running sizes give its file again.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    places = stored(placement(pages), "places").withColumn("file", F.floor(F.col("before") / roll).cast("bigint"))
    last = places.agg(F.max("file")).first()[0]
    per_group = (0 if last is None else last) // GROUPS + 1
    head = F.min(F.struct("page", "digest", "before"))
    heads = places.groupBy(F.floor(F.col("file") / per_group).alias("g")).agg(head.alias("h")).orderBy("g").select("g", "h.*").collect()
    starts, offsets = [(r["page"], r["digest"]) for r in heads], [r["before"] for r in heads]
    base = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "group int, page long, digest string, kind int, url string, length long, record binary"
    wide = base.mapInPandas(_records(starts), schema)
    group = F.floor(F.floor(F.col("before") / roll) / per_group)
    numbered = spark.createDataFrame([(r["g"], i) for i, r in enumerate(heads)], "g long, group int")
    marked = places.where("first >= 0").select("page", "digest", "first", group.alias("g")).join(F.broadcast(numbered), "g")
    markers = marked.select("group", "page", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("first").alias("length"), F.lit(None).cast("binary").alias("record"))
    moved = wide.unionByName(markers).repartition("group").sortWithinPartitions("group", "page", "digest", "kind", "url")
    made = moved.mapInPandas(_files(offsets, roll), "file long, content binary")
    temporary = f"{out}/_temporary-{uuid.uuid4().hex}"
    made.select("file", F.col("content").cast("string").alias("value")).write.partitionBy("file").option(
        "encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(f"{temporary}/files")
    size = places.groupBy("file").agg(F.sum("n").alias("records"), (F.sum("size") + len(EMPTY_MEMBER)).alias("bytes"))
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{temporary}/files")
    written = written.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("found"))
    checked = size.join(written, "file", "left")
    broken = checked.where(F.col("found").isNull() | (F.col("found") != F.col("bytes")))
    if not broken.isEmpty():
        raise OSError("an archive is not as long as its records")
    name = F.format_string("archive-%08d.warc.gz", F.col("file"))
    checked.select(name.alias("file"), "records", "bytes", "sha256").write.json(f"{temporary}/manifest")
    _commit(spark, temporary, out)
    return manifest(spark, out)


def _commit(spark: SparkSession, temporary: str, out: str) -> None:
    """Renames the finished files, then the manifest: until that the archive does not exist for readers."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(hadoop.Path(f"{temporary}/files/file=*/part-*")) or []:
        number = int(found.getPath().getParent().getName().partition("=")[2])
        if not fs.rename(found.getPath(), hadoop.Path(f"{out}/archive-{number:08d}.warc.gz")):
            raise OSError(f"archive {number} cannot be renamed in {out}")
    if not fs.rename(hadoop.Path(f"{temporary}/manifest"), hadoop.Path(f"{out}/manifest")):
        raise OSError(f"the manifest cannot be renamed in {out}")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("file string, records long, bytes long, sha256 string").json(f"{out}/manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a decompressed archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[key] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    for pdf in batches:
        for content, sha in zip(pdf["content"], pdf["sha256"]):
            if hashlib.sha256(content).hexdigest() != sha:
                raise ValueError("an archive differs from its manifest")
            rows = []
            for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                if f"sha256:{hashlib.sha256(block).hexdigest()}" != h["WARC-Block-Digest"]:
                    raise ValueError("a block differs from its digest")
                kind, digest, payload = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:"), None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload differs from its digest")
                first = h.get("X-Refers-To-Page")
                rows.append((int(h["X-Page-ID"]), len(payload) if payload is not None else int(h["X-Payload-Length"]), digest, kind, int(first) if first else None, payload))
                if len(rows) == 1000:
                    yield pd.DataFrame(rows, columns=columns).astype({"refers_to": "Int64"})
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({"refers_to": "Int64"})


def read(spark: SparkSession, out: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), all digests checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest(spark, out).select("file", "sha256"), "file")
    rows = named.select("content", "sha256").mapInPandas(_parsed, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return rows.select(doc_id_of(F.col("page")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", doc_id_of(F.col("refers_to")).alias("refers_to"), "payload")
