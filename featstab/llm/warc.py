"""Deterministic sharded WARC archives.

Records are range-sorted by page id and digest into shards whose bounds follow from the data alone; a shard is a partition, written as
files that roll at a compressed size, one gzip member per record, with headers and digests made anew. Tasks write under temporary
names; the files of the attempts that succeeded are renamed and committed by a manifest, written last. Equal payloads are stored once: the record
of the largest page id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featstab.functions.prefix import running

from .common import forget, keep, shared_dir, small_batches, table
from .files import of


@dataclass(frozen=True)
class Layout:
    """``roll`` compressed bytes after which a file ends, ``shard`` payload bytes of a shard (about), fewer where there would be less than
    ``shards`` of them, but not under ``small``; ``least`` payload bytes from which equal payloads are stored once; ``date`` of the
    records."""

    roll: int = 64 << 20
    shard: int = 256 << 20
    small: int = 4 << 20
    shards: int = 64
    least: int = 0
    level: int = 6
    date: str = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


#: Up to so many bounds stand in the plan; more are a table, which is broadcast if it has no more than MOST rows.
LITERAL, MOST = 1024, 1 << 20


def _at_most(bounds: Column, x: Column) -> Column:
    """How many of an array of bounds are at most x."""
    return F.size(F.filter(bounds, lambda b: b <= x))


def _literal(bounds: list[tuple[int | None, str]]) -> Column:
    return F.array(*(F.struct(F.lit(i).cast("long").alias("page_id"), F.lit(d).alias("digest")) for i, d in bounds))


def bounds_of(ids: DataFrame, size: int) -> list[tuple[int | None, str]]:
    """The first (page id, digest) of every shard but the first: shards of about ``size`` payload bytes along the order of the pairs.

    Running sums of bytes decide, so shards are even whatever the ids are, however many there are, and depend on the data alone. A pair's
    rows stay together."""
    pairs = ids.groupBy("page_id", "digest").agg(F.sum("n").alias("n"))
    through = running(pairs, [F.asc_nulls_first("page_id"), F.asc("digest")], position=None, through=("sum", "n"))
    shard = F.floor((F.col("through") - F.col("n")) / F.lit(size))
    found = through.groupBy(shard.alias("shard")).agg(F.min(F.struct("page_id", "digest")).alias("first")).orderBy("shard").collect()  # a row a shard
    return [(r["first"]["page_id"], r["first"]["digest"]) for r in found[1:]]


def with_shard(rows: DataFrame, bounds: list[tuple[int | None, str]]) -> DataFrame:
    """Adds ``shard``: how many bounds are at most the row's (page_id, digest), nulls first; looked up over two levels."""
    x = F.struct(F.col("page_id").alias("page_id"), F.col("digest").alias("digest"))
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if len(bounds) <= LITERAL:
        if not bounds:
            return rows.withColumn("shard", F.lit(0))
        part = _at_most(_literal([p[0] for p in parts]), x)
        return rows.withColumn("shard", F.when(part == 0, 0).otherwise((part - 1) * step + _at_most(F.get(F.array(*map(_literal, parts)), part - 1), x)))
    kind = "array<struct<page_id:bigint,digest:string>>"
    fine = rows.sparkSession.createDataFrame([(i + 1, p) for i, p in enumerate(parts)], f"part int, bounds {kind}")
    fine = F.broadcast(fine) if len(bounds) <= MOST else fine
    coarse = rows.withColumn("part", _at_most(_literal([p[0] for p in parts]), x))
    return coarse.join(fine, "part", "left").withColumn("shard", F.when(F.col("part") == 0, 0).otherwise((F.col("part") - 1) * step + _at_most(F.col("bounds"), x))).drop("part", "bounds")


def _identity(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes, layout: Layout) -> bytes:
    """One gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {layout.date}", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(layout.level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, layout: Layout) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    digest = base32(hashlib.sha1(payload).digest())
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"
    headers = [("WARC-Record-ID", _identity(page_id, digest, revisit)), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _identity(refers_to, digest, False))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page", str(refers_to)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload, layout)


class Roller:
    """Writes one shard's records to files under temporary names."""

    def __init__(self, folder: str, shard: int, layout: Layout):
        self.folder, self.shard, self.layout, self.number, self.done = folder, shard, layout, 0, []
        self.stream = None

    def add(self, page_id: int | None, member: bytes) -> None:
        if self.stream is None:
            self.system, path = of(self.folder)
            self.name = f"part-{self.shard:06d}-{self.number:06d}.warc.gz"
            self.temporary = f"{path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.system.create_dir(f"{path}/_temporary", recursive=True)
            self.stream, self.bytes, self.records, self.digest, self.first = self.system.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256(), page_id
            info = f"software: featstab\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
            self._put(record("warcinfo", [("WARC-Record-ID", _identity(self.name)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info, self.layout))
        self._put(member)
        self.records, self.last = self.records + 1, page_id
        if self.bytes >= self.layout.roll:
            self.close()

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.digest.update(member)
        self.bytes += len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append({"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.digest.hexdigest(), "first": self.first, "last": self.last})
            self.stream, self.number = None, self.number + 1


FILES = "name string, temporary string, records long, bytes long, sha256 string, first long, last long"


def write(pages: DataFrame, folder: str, layout: Layout = Layout(), key: str = "page_id", url: str = "url", html: str = "html") -> dict:
    """Write ``pages`` to the new ``folder`` and return its manifest, which is also the file manifest.json there.

    Null html is an empty payload, null url a urn of the page id. Payloads are equal if their SHA-1 and length are. Rows that repeat a
    page id are records of their own; of equal rows one is the response and the others revisit it. Null ids sort first and are the
    least; a group of null ids alone refers to null. Other columns are not read. An empty table gives a manifest without files. The
    same table gives the same files whatever its partitions and order, but for the order of rows equal in id and payload."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    ids = keep(rows.select("page_id", "digest", F.octet_length("payload").alias("n")), "ids")  # payloads are read for this, and to be written
    size = ids.agg(F.sum("n")).first()[0] or 0
    bounds = bounds_of(ids, max(layout.small, min(layout.shard, size // layout.shards)))
    shared = ids.where(F.col("n") >= layout.least).groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    equal = ids.join(shared, ["digest", "n"]).select("page_id", "digest", "refers_to").distinct()
    # what is known of a page's payload travels to its shard by itself and comes before the page, so payloads are shuffled once
    known = equal.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    whole = rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    every = with_shard(whole.unionByName(known), bounds).select("shard", *whole.columns)
    dealt = every.repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, told, before = None, None, None
        files: list[dict] = []
        for batch in batches:
            for shard_id, page_id, digest, kind, link, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if roller is None or roller.shard != shard_id:
                    if roller is not None:
                        roller.close()
                        files += roller.done
                    roller = Roller(folder, shard_id, layout)
                if kind == 0:
                    told = (page_id, digest, refers_to)
                    continue
                same = told is not None and told[:2] == (page_id, digest)
                again = same and (told[2] != page_id or before == (page_id, digest))
                roller.add(page_id, page_record(page_id, link, payload, told[2] if again else None, again, layout))
                before = (page_id, digest)
        if roller is not None:
            roller.close()
            files += roller.done
        if files:
            yield pa.RecordBatch.from_pylist(files, pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in FILES.split(", "))]))

    found = sorted((r.asDict() for r in dealt.mapInArrow(run, FILES).collect()), key=lambda r: r["name"])  # a row per file
    forget(ids)
    system, path = of(folder)
    system.create_dir(path, recursive=True)
    with ThreadPoolExecutor(32) as pool:
        list(pool.map(lambda r: system.move(r.pop("temporary"), f"{path}/{r['name']}"), found))
    system.create_dir(f"{path}/_temporary")
    system.delete_dir(f"{path}/_temporary")
    manifest = {"folder": folder, "files": found}
    with system.open_output_stream(f"{path}/manifest.json.tmp") as out:
        out.write(json.dumps(manifest, indent=1).encode())
    system.move(f"{path}/manifest.json.tmp", f"{path}/manifest.json")
    return manifest


def members(folder: str, name: str) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one at a time."""
    system, path = of(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
        unpacker, parts = zlib.decompressobj(31), []
        while chunk := stream.read(1 << 20):
            while chunk:
                parts.append(unpacker.decompress(chunk))
                chunk = unpacker.unused_data
                if unpacker.eof:
                    yield b"".join(parts)
                    unpacker, parts = zlib.decompressobj(31), []
        if any(parts):
            raise ValueError(f"{name} ends within a record")


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (``WARC-Type`` and so on) and block of a record, its length and block digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"broken record {headers.get('WARC-Record-ID')}")
    return headers, block


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the folder's manifest lists, every digest checked; a revisit's payload is null.

    A folder without a manifest isn't committed and can't be read."""
    small_batches(spark)
    system, path = of(folder)
    with system.open_input_stream(f"{path}/manifest.json") as stream:
        files = json.loads(stream.read())["files"]
    names = spark.createDataFrame([(f["name"], f["records"]) for f in files], "name string, records long").repartition(max(1, len(files)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in READ.split(", ")]
        schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in fields])
        for batch in batches:
            for name, expected in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                for raw in members(folder, name):
                    headers, block = parsed(raw)
                    if (kind := headers["WARC-Type"]) == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
                        raise ValueError(f"broken payload in {name}")
                    number = lambda h: int(headers[h]) if h in headers else None  # noqa: B023, E731
                    rows.append((number("X-Page-Id"), headers["WARC-Target-URI"], payload if payloads and kind == "response" else None, size, digest, kind, number("X-Refers-To-Page"), name))
                    if len(rows) == 256:
                        n += len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if n + len(rows) != expected:
                    raise ValueError(f"{name} has {n + len(rows)} records, not {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return names.mapInArrow(run, READ)


def op7_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    folder = shared_dir(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, list_reduce(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(hex, i + 1, 1)) - 1) + 1, 4)), lambda x, y: x || y) AS bits FROM d)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS BIGINT) << (4 - j)), lambda x, y: x + y) + 1, 1)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY hex, payload_bytes)
"""
