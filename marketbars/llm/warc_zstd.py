"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

write_archives() has each task write archives of bounded size to a folder that all executors share. Names hold the
task's attempt, and a table of those that Spark committed lies beside the archives: what a lost, repeated or speculative
attempt left is never read. read_archives() takes the archives of that table or, in a folder without one, all files by
Spark's binary reader; it loads the dictionary from the skippable frame, decodes frame by frame and checks headers,
lengths and digests.

Of records with equal payloads of at least `least_bytes` bytes, that with the smallest page_id is a response and the
others are revisits without a payload. Digests that over `1/HOT` of the pages share are matched by a broadcast of at
most HOT rows (a proven bound), the rest by an ordinary join, so no hot page meets in one task.

Cases: null html is an empty payload; null page_id is a response, or a revisit if a page with an id has the same
payload; rows with equal page_id and payload get the same record type; an empty table writes no archive and gives an
empty result; other columns than page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, new_dir

LEAST_BYTES = 100
HOT = 200
ARCHIVE_BYTES = 8 << 20
#: Tasks that read a list of archives, at most.
TASKS = 20_000
DICT_SAMPLES, DICT_BYTES = 200, 16 << 10
DICT_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, error string"


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, digest, n_bytes, refers_to (null for a response) and payload (null for a revisit)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("n_bytes"))
    refs = keep(rows.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "refs")
    total = pages.count()
    hot = refs.where(F.col("n") > total / HOT).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    rest = refs.where(F.col("n") <= total / HOT).select(F.col("digest").alias("key"), "first")
    rows = rows.join(F.broadcast(hot), rows["digest"] == hot["hot_digest"], "left")
    # rows already matched get keys of their own, so that they spread in the second join
    rows = rows.withColumn("key", F.when(F.col("hot_first").isNotNull(), F.concat(F.lit("-"), F.col("page_id").cast("string"))).otherwise(F.col("digest")))
    first = F.coalesce("hot_first", "first")
    ref = F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), first)
    rows = rows.withColumn("payload", F.when(F.col("hot_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot_first")), F.lit(None)).otherwise(F.col("payload")))
    rows = rows.join(rest, "key", "left").select("page_id", "url", "digest", "n_bytes", ref.alias("refers_to"), "payload")
    return rows.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def record(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, payload: bytes | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload or b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"\s", "%20", url or ""))]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Archive:
    """Collects records in memory until the archive is full; the first records train its dictionary."""

    def __init__(self):
        import zstandard

        self.z, self.wait, self.out, self.size, self.cctx = zstandard, [], [], 0, None

    def add(self, data: bytes) -> None:
        if self.cctx:
            self.put(self.cctx.compress(data))
        else:
            self.wait.append(data)
            if len(self.wait) >= DICT_SAMPLES or sum(map(len, self.wait[-1:])) > ARCHIVE_BYTES // 4:
                self.start()

    def put(self, frame: bytes) -> None:
        self.out.append(frame)
        self.size += len(frame)

    def start(self) -> None:
        try:
            d = self.z.train_dictionary(DICT_BYTES, [x[:4096] for x in self.wait]).as_bytes()
        except self.z.ZstdError:  # too few or too small samples to train on
            d = self.wait[0][:DICT_BYTES]
        frame = self.z.ZstdCompressor(level=3).compress(d)
        self.put(struct.pack("<II", DICT_MAGIC, len(frame)) + frame)
        self.cctx = self.z.ZstdCompressor(level=3, dict_data=self.z.ZstdCompressionDict(d), write_content_size=True, write_checksum=True)
        for x in self.wait:
            self.put(self.cctx.compress(x))
        self.wait = []

    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES

    def bytes(self) -> bytes:
        if self.wait:
            self.start()
        return b"".join(self.out)


#: The table of the archives that belong to a folder.
LIST = "_archives"


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        task, n, archive, done = TaskContext.get(), 0, Archive(), []
        mine = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:12]}"

        def flush() -> None:
            nonlocal n, archive
            name = f"{mine}-{len(done):04d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:  # the frames are ours, whatever the name says
                f.write(archive.bytes())
            done.append((name, n))
            n, archive = 0, Archive()

        for b in batches:
            for row in zip(*(b.column(x) for x in ("page_id", "url", "digest", "n_bytes", "refers_to", "payload")), strict=True):
                archive.add(record(*(x.as_py() for x in row)))
                n += 1
                if archive.full():
                    flush()
        if n:
            flush()
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["name", "n_records"])

    return run


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write the records of plan_records() under path (a URI) and return the list of archives: name, n_records."""
    rows = records.select("page_id", "url", "digest", "n_bytes", "refers_to", "payload")
    return keep(rows.mapInArrow(_write(path), "name string, n_records long"), "archives", f"{path.rstrip('/')}/{LIST}")


def _frames(data: memoryview) -> Iterator[bytes]:
    """The records of an archive, one frame each; a dictionary in a leading skippable frame is loaded first."""
    import zstandard

    at, d = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("the dictionary frame is cut off")
        raw = bytes(data[8 : 8 + size])
        d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
        at = 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    while at < len(data):
        one, out = decoder.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut off")
            piece = data[at : at + 16384]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> tuple:
    """The columns of COLUMNS; error says what is wrong with the record, or is null."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n"))}
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha256:")
    errors = [f"no {k}" for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not h.get(k)]
    errors += ["not a WARC record"] * (not gap or not re.fullmatch(rb"WARC/1\.[01]", version))
    size = int(h["content-length"]) if re.fullmatch(r"\d+", h.get("content-length", "")) else -1
    if size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        errors.append("wrong length")
    http, _, payload = rest[: max(size, 0)].partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    n = int(said[1]) if said else -1
    if kind == "response":
        errors += ["wrong payload length"] * (n != len(payload)) + ["wrong digest"] * (hashlib.sha256(payload).hexdigest() != digest)
    elif kind == "revisit":
        errors += ["no refers-to"] * (page(h.get("warc-refers-to")) is None) + ["wrong payload length"] * (n < 0 or len(payload) > 0)
    else:
        errors.append("unknown type")
    return page(h.get("warc-record-id")), n, digest, kind, page(h.get("warc-refers-to")), h.get("warc-target-uri"), "; ".join(errors) or None


def _parsed(archives: Iterator[memoryview]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("error", pa.string())])
    for data in archives:
        rows = []
        try:
            for x in _frames(data):
                rows.append(parse_record(x))
        except Exception as e:  # a damaged archive: what stands before the damage is kept, the damage is told
            rows.append((None, None, None, None, None, None, f"damaged archive: {e}"))
        yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path; a file that can't be decoded further ends in an error row."""
    path = path.rstrip("/")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{LIST}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
        return files.mapInArrow(lambda batches: _parsed(memoryview(x.as_buffer()) for b in batches for x in b.column(0)), COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)

        def content(name: str) -> memoryview:
            with store.open_input_file(f"{root}/{name}") as f:
                return memoryview(f.read())

        yield from _parsed(content(name) for b in batches for name in b.column(0).to_pylist())

    names = spark.read.schema("name string").parquet(f"{path}/{LIST}")
    return names.repartition(max(1, min(names.count(), TASKS))).mapInArrow(run, COLUMNS)


def op10(pages: DataFrame, path: str | None = None) -> DataFrame:
    path = path or new_dir(pages.sparkSession, "warc")
    write_archives(plan_records(pages), path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
