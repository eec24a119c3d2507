"""Web archives: writing WARC files with revisit records, reading them back, and an ordered index of all captures.

Writing. Records with equal payloads (of at least min_bytes) are found by the payloads' digests alone; the one with the
smallest id is a response, the others are revisit records that refer to it and carry no payload. Each task writes files
of bounded size into a shared folder, a gzip member per record, under names of its own; a table of the files that
finished tasks wrote is what counts, so files of failed or repeated tasks are never read.

Index. Each archive's captures, sorted by URL key, time and id, are written as a run: a file of small batches. The first
keys of batches, one of BATCH_ROWS captures, say which batches a range of keys may need; a bounded sample of them cuts the
ranges. For each range a loser tree merges all runs, reading a batch of each at a time. More than FAN_IN runs are first
merged into longer ones, FAN_IN at a time. So neither a range nor a run is ever in memory as a whole, and the ranges one
after the other give all captures in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.llm.common import map_batches, scratch, slices, stored

#: Bounds of a file: payload bytes and records.
FILE_BYTES, FILE_RECORDS = 64 << 20, 20_000
#: Captures of a batch of a run, runs merged at once, and first keys that cut ranges.
BATCH_ROWS, FAN_IN, CUTS = 512, 256, 20_000
#: The time of captures that have none.
UNDATED = "1970-01-01T00:00:00.000000Z"
GZIP_LEVEL = 3
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Hex digits (a multiple of five of them) as base32, by DataFrame functions: 20 bits at a time."""
    part = lambda i: F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digests(pages: DataFrame, id_col: str, url_col: str, body_col: str, date_col: str | None) -> DataFrame:
    payload = F.coalesce(F.encode(F.col(body_col).cast("string"), "utf-8"), F.lit(b""))
    at = F.to_utc_timestamp(F.col(date_col).cast("timestamp"), F.current_timezone()) if date_col else F.lit(None).cast("timestamp")
    date = F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(UNDATED))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), date.alias("date"))
    return rows.withColumn("digest", base32(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))


def url_key(url: str | None) -> str:
    """The host's parts from the last to the first, then path and query: captures of a site sort together."""
    if not url:
        return ")"
    try:
        at = urlsplit(url.strip())
        host, port = at.hostname or "", at.port
    except ValueError:
        return f"){url.lower()}"
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (None, 80, 443) else f":{port}"
    query = f"?{at.query.lower()}" if at.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(at.path or '/').lower()}{query}"


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = UNDATED) -> bytes:
    """One record, not compressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URI)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI = "!#$%&'()*+,/:;=?@[]-._~"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), HTTP head and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the block of {headers.get('warc-record-id')} hasn't the length that its header gives")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return headers, http, payload


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """offset, length and content of each gzip member of a stream; one record is in memory at a time."""
    held, at, begin = b"", 0, 0
    d, parts = zlib.decompressobj(31), []
    while True:
        if not held:
            held = stream.read(chunk)
            if not held:
                break
        parts.append(d.decompress(held))
        if d.eof:
            at += len(held) - len(d.unused_data)
            yield begin, at - begin, b"".join(parts)
            held, begin = d.unused_data, at
            d, parts = zlib.decompressobj(31), []
        else:
            at += len(held)
            held = b""
    if at != begin:
        raise ValueError(f"the gzip member at {begin} isn't complete")


class Writer:
    """Files of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.uri, self.name, self.out = folder, "", None
        self.records = self.bytes = 0
        self.done: list[tuple[str, int]] = []

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        packed = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        self.out.write(packed.compress(raw) + packed.flush())
        self.records += 1
        self.bytes += len(raw)
        if self.records >= FILE_RECORDS or self.bytes >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.uri}/{self.name}", self.records))
            self.out, self.records, self.bytes = None, 0, 0


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date_col: str | None = None) -> DataFrame:
    """file, records: the archives written into a shared folder, one record for each row of pages.

    date_col is the time of capture; without it, and where it is null, a record is UNDATED. A null or empty body is an
    empty payload; a body of any length is one record; a null URL has no target. Rows that share the smallest id of a
    payload are responses all (so a repeated row is repeated); a row without an id is a revisit wherever a row with an id
    has its payload. Other columns are ignored, whatever their names; an empty table gives no archive.
    """
    rows = with_digests(pages, id_col, url_col, body_col, date_col)
    again = rows.filter(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = stored(again.select("_digest", "first"), "payloads")  # its size is known before the pages are joined with it
    joined = rows.join(again, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder)
        for batch in batches:
            for part in slices(batch, 64):
                for page, url, payload, digest, first, date in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                    out.add(record(page, url, payload, digest, first, date))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out.done]), pa.array([n for _, n in out.done], pa.int64())], ["file", "records"])

    return stored(map_batches(joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), "date"), run, "file string, records long"), "archives")


CAPTURE = "url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"
_CAPTURE_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def captures(file: str) -> list[tuple]:
    """The captures in one archive, sorted by URL key, time and id: a run. Payloads are checked against their digests."""
    fs, path = pa.fs.FileSystem.from_uri(file)
    out = []
    with fs.open_input_stream(path, compression=None) as stream:
        for offset, length, raw in members(stream):
            headers, http, payload = parsed(raw)
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            revisit = headers["warc-type"] == "revisit"
            size = int(re.search(rb"(?im)^Content-Length: *(\d+)", http)[1])
            if not revisit and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"{file} at {offset}: the payload isn't what its digest says")
            refers = page_of(headers["warc-refers-to"]) if revisit else None
            out.append((url_key(headers.get("warc-target-uri")), headers["warc-date"], page_of(headers["warc-record-id"]), headers["warc-type"], size, digest, refers, file, offset, length))
    return sorted(out, key=order)


def order(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0, c[7], c[8]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so one path is replayed per item."""

    def __init__(self, runs: Iterable[Iterator], key):
        self.runs, self.key = list(runs), key
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k:
            i = self.losers[0]
            if self.heads[i] is None:
                return
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            self._replay(i)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _CAPTURE_KINDS, strict=True)], _NAMES)


#: A capture's place in the order: its key, and a number that ranges share.
FENCE = "run string, batch int, url_key string, captured string, page_id long, file string, offset long"


def put_run(folder: str, rows: Iterable[tuple]) -> pa.RecordBatch | None:
    """Write sorted captures as a run; the first capture of each of its batches, as FENCE."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    name, fences, held = uuid.uuid4().hex, [], []
    with fs.open_output_stream(f"{path}/{name}.arrow") as out, pa.ipc.new_file(out, pa.schema(list(zip(_NAMES, _CAPTURE_KINDS, strict=True)))) as sink:

        def put():
            fences.append((f"{folder}/{name}.arrow", len(fences), held[0][0], held[0][1], held[0][2], held[0][7], held[0][8]))
            sink.write_batch(batch_of(held))
            held.clear()

        for row in rows:
            held.append(row)
            if len(held) == BATCH_ROWS:
                put()
        if held:
            put()
    if not fences:
        return None
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*fences, strict=True), kinds, strict=True)], [x.split()[0] for x in FENCE.split(", ")])


def get_run(uri: str, batches: Iterable[int]) -> Iterator[tuple]:
    """The captures in some batches of a run, one batch in memory at a time."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        source = pa.ipc.open_file(f)
        for i in batches:
            yield from zip(*(c.to_pylist() for c in source.get_batch(i).columns), strict=True)


def fence_key(row: tuple) -> tuple:
    """order() of the first capture of a batch, from its FENCE."""
    _, _, key, captured, page, file, offset = row
    return order((key, captured, page, None, None, None, None, file, offset))


def merged_runs(files: DataFrame, folder: str, group: int) -> DataFrame:
    """FENCE of the runs that come of merging FAN_IN runs (a column run) each."""
    spark = files.sparkSession
    runs = files.groupBy("run").agg(F.count("*").alias("batches"))
    dealt = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(group))).repartition(min(group, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True))
        for _, members in groupby(rows, lambda r: r[2]):
            out = put_run(folder, LoserTree([get_run(uri, range(n)) for uri, n, _ in members], order))
            if out is not None:
                yield out

    return stored(map_batches(dealt.select("run", "batches", "group"), run, FENCE), "runs")


def index(archives: DataFrame) -> DataFrame:
    """CAPTURE rows of all archives (a column file), ordered by URL key, time and id over partitions and within each.

    Ties go by file and offset. No archives give no rows; an archive listed twice gives its captures twice.
    """
    spark = archives.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "runs")
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                if (out := put_run(folder, captures(file))) is not None:
                    yield out

    files = archives.count()
    if not files:
        return spark.createDataFrame([], CAPTURE)
    fences = stored(map_batches(archives.select("file").repartition(min(files, 4 * n)), runs, FENCE), "fences")
    while (many := fences.select("run").distinct().count()) > FAN_IN:
        fences = merged_runs(fences, folder, -(-2 * many // FAN_IN))  # hashed groups vary in size: half of FAN_IN on average
    total = fences.count()
    picked = fences.sample(min(1.0, CUTS / total), seed=5).limit(2 * CUTS).collect() if total > CUTS else fences.collect()
    firsts = sorted(fence_key(tuple(r)) for r in picked)
    cuts = sorted({firsts[k * len(firsts) // n] for k in range(1, n)})  # range r has the captures from cuts[r - 1] on and before cuts[r]
    shared = spark.sparkContext.broadcast(cuts)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range that a batch's captures may be in: from its own first key to the next batch's."""
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for uri, group in groupby(rows, lambda r: r[0]):
            at = [(r[1], bisect_right(shared.value, fence_key(r))) for r in group]
            ends = [*(r for _, r in at[1:]), len(shared.value)]
            out = [(r, uri, k) for (k, lo), hi in zip(at, ends, strict=True) for r in range(lo, hi + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out]), pa.array([x[2] for x in out], pa.int32())], ["range", "run", "batch"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for at, part in groupby(rows, lambda r: r[0]):
            lists = [(uri, [k for *_, k in x]) for uri, x in groupby(part, lambda r: r[1])]  # numbers of batches, not batches
            lo = shared.value[at - 1] if at else None
            hi = shared.value[at] if at < len(shared.value) else None
            held = []
            for row in LoserTree([get_run(uri, x) for uri, x in lists], order):
                if (lo is None or order(row) >= lo) and (hi is None or order(row) < hi):
                    held.append(row)
                    if len(held) == 4096:
                        yield batch_of(held)
                        held = []
            if held:
                yield batch_of(held)

    sorted_fences = fences.repartition(n, "run").sortWithinPartitions("run", "batch")
    pieces = map_batches(sorted_fences, ranges, "range int, run string, batch int")
    return map_batches(pieces.repartitionByRange(n, "range").sortWithinPartitions("range", "run", "batch"), merge, CAPTURE)


def archive(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", folder: str | None = None, date_col: str | None = None) -> DataFrame:
    """Write pages as archives (see write()) and read them back: one CAPTURE row per page, in the index's order."""
    return index(write(pages, folder or scratch(pages.sparkSession, "warc"), min_bytes, id_col, url_col, body_col, date_col))


#: DuckDB: digests and first pages by payload.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
x AS (SELECT page_id, n, h, array_to_string([lpad(upper(to_base(('0x' || substr(h, 5 * i + 1, 5))::BIGINT, 32)), 4, '0') FOR i IN range(8)], '') AS q, min(page_id) OVER (PARTITION BY h) AS f FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, translate(q, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM x
"""
