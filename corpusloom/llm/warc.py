"""WARC archives: a deterministic sharded writer and a reader.

Pages are range-sorted by id into shards of about equal bytes. A shard's records are written in order
to gzip files that roll at a compressed size; each file is written under a temporary name and renamed
when whole, and only the manifest, a table written last, makes files part of the archive. Headers,
record ids and digests are made anew from the contents, so reruns give the same bytes.

Defined results: null html is an empty payload; null urls have no target header; a null page_id comes
last among equal payloads and has no id header; of rows with one id and payload the first written is
the response and the others revisit it; an empty table gives an archive without files; columns that are
not named are ignored. Payloads of at least revisit_bytes may be revisited, smaller ones never.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.sharding import numbered
from corpusloom.session import Scratch, running_sum, salted_join

PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SHARD_BYTES = 64 << 20
FILE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard long, file string, records long, bytes long, sha256 string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload_digest: str, nth: int = 0) -> str:
    """nth tells rows apart that have all else in common."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{payload_digest}' + (f'|{nth}' if nth else ''))}>"


def printable(url: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, first_url: str | None, revisit: bool, nth: int, date: str) -> bytes:
    """One WARC record; a revisit has only the HTTP headers as its block, and names the response of page first at first_url."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, url, sha, nth)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", printable(url)))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, first_url, sha)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(first))]
        if first_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", printable(first_url)))
    fields += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class Files:
    """The files of one shard, rolled by compressed size."""

    def __init__(self, root: str, shard: int, file_bytes: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.done, self.out = shard, file_bytes, [], None

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{len(self.done):04d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None


def shard_starts(spark: SparkSession, keys: DataFrame, scratch: Scratch, shard_bytes: int) -> list[tuple]:
    """The first (null, page_id, sha) of each shard: the sorted pages cut where their bytes pass multiples of shard_bytes.

    Ids may lie anywhere in their range, be null or be one for all pages: cuts follow the bytes, and a key with more
    than a shard's bytes starts several shards.
    """
    narrow = keys.select(F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "sha", (F.col("size") + 500).alias("bytes"))
    rows = scratch.save(numbered(spark, narrow, scratch, "none", "page_id", "sha")[0], "summed")
    summed = running_sum(rows, "bytes", "row").withColumn("shard", F.floor(F.col("upto") / shard_bytes))
    found = summed.groupBy("shard").agg(F.min(F.struct("none", "page_id", "sha")).alias("first")).orderBy("shard").collect()
    scratch.drop("ranges")
    return [tuple(r["first"]) for r in found]


def shard_of(starts: list[tuple], page_id: str | None, sha: str, salt: int) -> tuple[int, int]:
    """The shard of a page and which of its key's shards that is; a key at which shards start is dealt over these and the one before them by salt."""
    key = (page_id is None, int(page_id or 0), sha)
    last = bisect_right(starts, key) - 1
    begun = max(0, bisect_left(starts, key) - 1) if starts[last] == key else last
    piece = salt % (last - begun + 1)
    return begun + piece, piece


def write_warc(spark: SparkSession, pages: DataFrame, root: str, scratch: Scratch, revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write pages(page_id, url, html) under root, a folder that driver and executors share; returns the manifest."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    keys = scratch.save(pages.select("page_id", "url", "sha", "size"), "keys")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    equal = keys.where(F.col("size") >= revisit_bytes).groupBy("sha").agg(first.alias("f"), F.count("*").alias("rows")).where("rows > 1 and f is not null")
    equal = scratch.save(equal.select("sha", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url"), "rows"), "equal")
    starts = shard_starts(spark, keys, scratch, shard_bytes)

    @F.pandas_udf("shard long, piece long")
    def dealt(page_id: pd.Series, sha: pd.Series, salt: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shard_of(starts, i, x, n) for i, x, n in zip(page_id, sha, salt)], columns=["shard", "piece"])

    joined = salted_join(pages, equal, "sha", "rows", F.col("page_id"))
    joined = joined.withColumn("at", dealt(F.col("page_id").cast("string"), "sha", F.xxhash64(F.monotonically_increasing_id())))
    # a range for each shard: hash partitions would put several shards into one task and none into others
    ordered = joined.select("at.shard", "at.piece", "page_id", "url", "html", "first", "first_url").repartitionByRange(max(1, len(starts)), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "url", "html")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, done, led, last, nth = None, [], set(), None, 0
        for f in frames:
            for shard, piece, page_id, url, text, first, first_url in zip(f["shard"], f["piece"], f["page_id"], f["url"], f["html"], f["first"], f["first_url"]):
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        done += files.done
                    files, led = Files(root, int(shard), file_bytes), set()
                page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                payload = text.encode("utf-8", "surrogatepass")
                sha = hashlib.sha1(payload).digest()
                revisit = first is not None and (page_id != first or sha in led or piece > 0)
                if first is not None and page_id == first:
                    led.add(sha)
                url, first_url = (x if isinstance(x, str) else None for x in (url, first_url))
                # rows come sorted, equal ones in a row
                nth = nth + 1 if last == (shard, page_id, url, sha) else int(piece) << 40
                last = (shard, page_id, url, sha)
                files.add(record(page_id, url, payload, first, first_url, revisit, nth, date))
        if files is not None:
            files.close()
            done += files.done
        yield pd.DataFrame(done, columns=["shard", "file", "records", "bytes", "sha256"])

    ids = ordered.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})
    ids.mapInPandas(write, MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest")
    scratch.drop("keys", "equal", "summed")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record of a stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of an archive's manifest: page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Files are streamed; a response whose payload does not have its digest raises ValueError.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        for f in frames:
            for name in f["file"]:
                rows, held = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in parsed(stream):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        sha, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                        if kind == "response" and (len(payload) != size or digest(payload) != sha):
                            raise ValueError(f"{name}: a payload does not have its digest")
                        rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), payload.decode("utf-8", "surrogatepass") if kind == "response" else None, size, sha, kind, fields.get("x-refers-to-page-id")))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=READ)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=READ)

    n = max(1, files.count())
    found = files.select("file").repartition(n, "file").mapInPandas(read, "page_id string, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


READ = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archive"), scratch)
    return read_warc(spark, scratch.path("archive")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
