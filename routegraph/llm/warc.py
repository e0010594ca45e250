"""WARC archives of pages, and capture histories merged from sorted runs of their index.

Writing: a page becomes one WARC/1.1 record, an HTTP response with the page as its payload,
or, where an equal payload of at least ``MIN_SHARED`` bytes has a page with a larger key, a
revisit record that refers to it and holds the HTTP headers alone. Tasks put records into
pieces of about a megabyte and Spark's text writer puts a bounded number of pieces into each
file (the blank lines behind a record are the writer's line separator), so archives lie on
any file system Spark writes to, with whole files only from tasks that ended.

Reading: a task reads whole archives (bounded files), walks them by Content-Length, checks
the digests of payloads and yields the captures of each archive as a run, sorted by URL key
and timestamp. Runs are dealt to ranges of the key; in a range the slices of the runs are
merged by a loser tree, and the ranges follow each other: the result is in global order.
Cut points include the place of a record, so a URL with any share of the captures is cut too.

Defined results: a null payload is empty; a null key or URL comes back null; characters no URI
may hold come back percent-encoded; rows that share the largest key and the payload are all responses; the payload may hold anything, record
heads included; extra columns are ignored; an empty table gives no captures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routegraph.llm.packed import rows_of
from routegraph.operators.lineage import RoundTables, row_count

MIN_SHARED = 1000
#: Bytes of a piece, pieces of a file, entries of a range of the merged index.
PIECE_BYTES, FILE_PIECES, RANGE_ROWS = 1 << 20, 8, 1 << 16
GAP = "\r\n\r\n"
CRLF = b"\r\n"
#: First second of derived capture times: 2020-01-01T00:00:00Z.
EPOCH = 1577836800


# ---- records -----------------------------------------------------------------------------


def record(key: str | None, url: str | None, date: str, digest: str, payload: bytes, refers: tuple | None) -> bytes:
    """A record without the blank lines behind it. ``refers``: (key, URL) of the response."""
    name = lambda k: f"<urn:page:{quote(k, safe='')}>" if k is not None else "<urn:page>"
    target = lambda u: quote(u, safe="!#$%&'()*+,/:;=?@[]~")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name(key)}", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {target(url)}")
    if refers:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {name(refers[0])}")
    else:
        http += payload
    head.append(f"Content-Length: {len(http)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in head.split(CRLF)[1:])
    return {k.decode().strip().lower(): v.decode().strip() for k, v in pairs}


def _named(value: str | None) -> str | None:
    body = (value or "").removeprefix("<urn:page").removesuffix(">")
    return unquote(body[1:]) if body.startswith(":") else None


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], memoryview]]:
    """(offset, length, fields, HTTP fields, payload) of the records of an archive, in order."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        if not archive.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        fields = _fields(archive[at:end])
        block = end + 4
        stop = block + int(fields["content-length"])
        if archive[stop : stop + 4] != GAP.encode():
            raise ValueError(f"the record at byte {at} does not end at byte {stop}")
        body = archive.index(b"\r\n\r\n", block, stop)
        yield at, stop - at, fields, _fields(archive[block:body]), view[body + 4 : stop]
        at = stop + 4


def url_key(url: str | None) -> str:
    """Sort key of a URL: host backwards, then port, path and query; no scheme, www, fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:  # a malformed host or port: the text itself is the key
        return url.strip().lower()
    host = host.removeprefix("www.")
    tail = f":{port}" if port not in (None, 80, 443) else ""
    query = f"?{parts.query.lower()}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path.lower() or "/") + query


# ---- writing -----------------------------------------------------------------------------


def responses(pages: DataFrame, key: str, payload: Column) -> DataFrame:
    """(_sha, _largest): payloads of at least ``MIN_SHARED`` bytes that several rows have, and
    the largest key among them. Rows with a payload are counted before they are shuffled."""
    sized = pages.select(F.col(key).alias("_key"), payload.alias("_payload"))
    large = sized.filter(F.octet_length("_payload") >= MIN_SHARED)
    sums = large.groupBy(F.unhex(F.sha2("_payload", 256)).alias("_sha")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_key").alias("_largest")
    )
    return sums.filter("_n > 1").select("_sha", "_largest")


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    date: Column | None = None, t: RoundTables | None = None,
    piece_bytes: int = PIECE_BYTES, file_pieces: int = FILE_PIECES,
) -> None:
    """Write one record per row of ``pages`` to archives under ``path``.

    ``date`` is the capture time as text; without it, it is derived from a numeric key.
    """
    own = t or RoundTables(pages.sparkSession, "warc")
    try:
        body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
        shared, m = own.write(responses(pages, key, body), "shared", row_count())
        if date is None:
            seconds = F.coalesce(F.expr(f"try_cast(`{key}` AS bigint)"), F.lit(0)) % 1_000_000_000
            date = F.date_format(F.timestamp_seconds(seconds + EPOCH).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        rows = pages.select(
            F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), date.alias("_date"), body.alias("_payload"),
        )
        refers = F.lit(None).cast(rows.schema["_key"].dataType)
        if m["n"]:
            rows = rows.withColumn("_sha", F.when(F.octet_length("_payload") >= MIN_SHARED, F.unhex(F.sha2("_payload", 256))))
            rows = rows.join(shared, "_sha", "left")
            refers = F.when(~F.col("_key").eqNullSafe(F.col("_largest")), F.col("_largest"))
        text = [F.col("_key").cast("string"), F.col("_url"), F.col("_date"), refers.cast("string").alias("_refers")]

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[bytes] = []
            size = 0
            for batch in batches:
                for k, u, d, r, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    digest = hashlib.sha1(p, usedforsecurity=False).hexdigest()
                    held.append(record(k, u, d, digest, p, None if r is None else (r,)))
                    size += len(held[-1])
                    if size >= piece_bytes:
                        yield pa.record_batch({"value": pa.array([GAP.encode().join(held)], pa.binary())})
                        held, size = [], 0
            if held:
                yield pa.record_batch({"value": pa.array([GAP.encode().join(held)], pa.binary())})

        text_rows = rows.select(*text, "_payload").mapInArrow(pieces, "value binary")
        # bytes stay as they are: a cast to string does not check them, and the writer copies them
        text_rows.select(F.col("value").cast("string")).write.option("lineSep", GAP).option("maxRecordsPerFile", file_pieces).text(path)
    finally:
        if t is None:
            own.drop()


# ---- reading -----------------------------------------------------------------------------

_ENTRY = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
     ("key", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.string())]
)
_DDL = (
    "url_key string, captured string, archive string, offset long, length long, key string, url string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to string"
)
#: The order of the merged index; the place of a record makes it total.
ORDER = ["url_key", "captured", "archive", "offset"]


def captures(archive: bytes, name: str) -> list[tuple]:
    """The run of an archive: its captures in the order of the index."""
    run = []
    for at, length, fields, http, payload in records(archive):
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and hashlib.sha1(payload, usedforsecurity=False).hexdigest() != digest:
            raise ValueError(f"{name}: the payload at byte {at} does not have its digest")
        url = fields.get("warc-target-uri")
        run.append(
            (url_key(url), fields["warc-date"], name, at, length, _named(fields["warc-record-id"]), url, kind,
             int(http["content-length"]), digest, _named(fields.get("warc-refers-to")))
        )
    run.sort(key=lambda e: e[:4])
    return run


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``: (run, at, and the index's columns)."""
    schema = pa.schema([("run", pa.string()), ("at", pa.int64()), *_ENTRY])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = name.rsplit("/", 1)[-1]
                run = captures(content.as_py(), file)
                yield rows_of([(file, i, *entry) for i, entry in enumerate(run)], schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, f"run string, at long, {_DDL}")


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """The entries of sorted runs in order, by a loser tree.

    Leaf ``k + i`` stands for run ``i``; an inner node holds the run that lost the match
    there, and only the matches between the last winner's leaf and the root are played again.
    """
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else ())
        return
    at = [0] * k

    def less(a: int, b: int) -> bool:
        """Does run ``a`` win against run ``b``? An exhausted run loses."""
        if at[a] == len(runs[a]) or at[b] == len(runs[b]):
            return at[a] < len(runs[a])
        return runs[a][at[a]][:4] <= runs[b][at[b]][:4]

    winner = list(range(-k, k))  # of the matches below each node; leaves win theirs
    loser = [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if less(a, b) else (b, a)
    best = winner[1]
    while at[best] < len(runs[best]):
        yield runs[best][at[best]]
        at[best] += 1
        node = (k + best) // 2
        while node:
            if not less(best, loser[node]):
                best, loser[node] = loser[node], best
            node //= 2


def histories(runs: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The globally ordered index: partitions follow each other by URL key and timestamp."""
    least = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(least, rows), -(-rows // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slices.setdefault(row[0], []).append(row[1:])
        for run in slices.values():  # the blocks of a run may arrive in any order
            run.sort()
        out: list[tuple] = []
        for entry in merged([[e[1:] for e in run] for run in slices.values()]):
            out.append(entry)
            if len(out) == 4096:
                yield rows_of(out, _ENTRY)
                out = []
        yield rows_of(out, _ENTRY)

    return runs.repartitionByRange(ranges, *ORDER).mapInArrow(merge, _DDL)


def capture_index(pages: DataFrame, t: RoundTables, **options) -> DataFrame:
    """Archive ``pages``, read the archives back and merge their captures: partitions in order."""
    spark, path = pages.sparkSession, t.path("archives")
    write_archives(pages, path, t=t, **options)
    runs, m = t.write(read_runs(spark, path), "runs", row_count())
    t.delete("shared")
    return histories(runs, m["n"])


def op13_warc(pages: DataFrame) -> DataFrame:
    t = RoundTables(pages.sparkSession, "warc")
    try:
        index = capture_index(pages, t)
        t.delete("archives")
        t.drop_at_exit()
    except BaseException:
        t.drop()
        raise
    kind = pages.schema["page_id"].dataType
    return index.select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "captured",
    )


OP13_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS size FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS kept FROM p)
SELECT page_id, size AS payload_bytes, payload_digest,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to,
  strftime(make_timestamp((coalesce(page_id, 0) % 1000000000 + {EPOCH}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM g
"""
