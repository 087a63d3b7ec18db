"""WARC archives with an externally merged capture index.

Pages are written as WARC/1.1 records, one gzip member each, into archives of bounded size in the shared folder. Of
records with equal payloads of at least ``MIN_PAYLOAD`` bytes, that of the smallest page id is the response and the
others are revisits that refer to it. The archives are then read back: each yields a run of its captures, sorted by URL
key, time and id. The runs are cut at common splitters (from a bounded sample of keys) and each range of keys is merged
by a k-way loser tree, which gives the globally ordered capture histories.

Tasks write through ``pyarrow.fs``, so the shared folder may be any file system that it opens. An archive's name is new
in each attempt, and only archives in the manifest that Spark committed are read, so lost executors and repeated
attempts leave nothing in the index. Pages move once, in the join to the first page of their payload; a task holds one
record of an archive at a time. A run is cut into segments only for the ranges that it has captures in, so there are
never more segments than captures.

Defined cases: a null payload is empty; payloads below the limit, empty ones among them, are all responses; a null URL
is left out of the record and has an empty key; rows that repeat a page id and a payload are each a response or refer to
the same id; a null page id takes no part in deduplication; captures of one key and time are ordered by page id; an
empty table gives no rows; other columns are not read. Without a capture time the id in seconds from ``EPOCH`` is it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rlab.llm.shared import fresh_dir, stored

MIN_PAYLOAD = 100
ARCHIVE_BYTES = 8 << 20
#: Captures of one range, captures of one part of a run, and the most keys that the driver draws to cut the ranges: four for
#: each range, so beyond 250 million captures ranges grow (to 200,000 captures at 10 thousand million).
RANGE_ROWS, RUN_ROWS, SAMPLED_KEYS = 5_000, 1_000, 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host parts in reverse, then path and query; no scheme, `www.`, port, fragment or last slash."""
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(\?[^#]*)?", (url or "").strip(), re.IGNORECASE)
    if not found:
        return (url or "").strip().lower()
    host = re.sub(r"^www\d*\.", "", re.sub(r":\d*$", "", found[1].rpartition("@")[2].lower()))
    query = "&".join(sorted(found[3][1:].split("&"))) if found[3] else ""
    return ",".join(reversed(host.split("."))) + ")" + (found[2].rstrip("/") or "/") + (f"?{query}" if query else "")


def _date(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP head of the full payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {_date(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + squeeze.flush()


def members(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of an archive, one at a time."""
    data, at = stream.read(chunk), 0
    while data:
        unzip, parts, size = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not data:
                raise ValueError("the archive ends inside a record")
            parts.append(unzip.decompress(data))
            size += len(data) - len(unzip.unused_data)
            data = unzip.unused_data or stream.read(chunk)
        yield at, size, b"".join(parts)
        at += size


def read_record(data: bytes) -> dict:
    """Headers and payload of a record; length and digest of the payload are checked where it is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    number = lambda x: int(x) if (x := (x or "").removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "captured_at": fields["warc-date"], "record_type": fields["warc-type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": number(fields.get("warc-refers-to")), "payload": payload,
    }


def revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, digest, first): the pages whose payload a smaller id has. Only ids and digests move; the first pages are a
    written table, so that Spark can split the pages of a very common payload in the join."""
    slim = pages.where(F.octet_length("html") >= min_payload).select("page_id", F.sha2("html", 256).alias("digest")).where("page_id is not null")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    firsts = stored(firsts, "firsts")
    return slim.join(firsts, "digest").where("page_id > first").distinct()


def write_archives(pages: DataFrame, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row of (page_id, url, html); the manifest (path, n_records, n_bytes)."""
    known = revisits(pages, min_payload).withColumnRenamed("page_id", "_id")
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.sha2("html", 256).alias("_sha"))
    rows = keyed.join(known, (keyed["page_id"] == known["_id"]) & (keyed["_sha"] == known["digest"]), "left").select("page_id", "url", "html", "first")
    folder = fresh_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, first = (batch.column(c)[k].as_py() for c in range(4))
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                data = record(page_id, url, (html or "").encode(), first)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        columns = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "n_records", "n_bytes"])

    return stored(rows.mapInArrow(run, "path string, n_records long, n_bytes long").withColumn("folder", F.lit(folder)), "manifest")


_ENTRY = pa.struct(
    [("key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]
)
_ENTRY_SQL = "struct<key:string,captured_at:string,page_id:bigint,payload_bytes:bigint,payload_digest:string,record_type:string,refers_to:bigint,start:bigint,length:bigint>"


def _order(entry: dict) -> tuple:
    return entry["key"], entry["captured_at"], -1 if entry["page_id"] is None else entry["page_id"]


def read_runs(manifest: DataFrame) -> DataFrame:
    """(run, part, entries): the captures of every archive as a run sorted by key, time and id, in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                files, _ = fs.FileSystem.from_uri(folder)
                entries = []
                with files.open_input_stream(path, compression=None) as stream:
                    for start, length, data in members(stream):
                        found = read_record(data)
                        entries.append({"key": url_key(found["url"]), "start": start, "length": length} | {f.name: found[f.name] for f in _ENTRY if f.name in found})
                entries.sort(key=_order)
                parts = [entries[k : k + RUN_ROWS] for k in range(0, len(entries), RUN_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(_ENTRY))], names=["run", "part", "entries"])

    n = manifest.count()
    dealt = manifest.select("path", "folder").repartition(max(1, min(n, 4 * manifest.sparkSession.sparkContext.defaultParallelism)), "path")
    return stored(dealt.mapInArrow(run, f"run string, part int, entries array<{_ENTRY_SQL}>"), "runs")


class LoserTree:
    """Merges k sorted runs. Inner nodes hold the losers of their matches, so that replacing the winner takes one match
    for each level and no match between siblings."""

    def __init__(self, sources: list[Iterator[dict]]):
        self.sources = [iter(s) for s in sources]
        self.k = len(self.sources)
        self.heads: list[dict | None] = [next(s, None) for s in self.sources]
        self.keys = [self._key(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _key(self, i: int) -> tuple:
        head = self.heads[i]
        return (1,) if head is None else (0, *_order(head), i)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) >> 1
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self.keys[other] < self.keys[winner]:
                self.losers[node], winner = winner, other
            node >>= 1
        self.losers[0] = winner

    def __iter__(self) -> Iterator[dict]:
        while self.k and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.sources[winner], None)
            self.keys[winner] = self._key(winner)
            self._play(winner)


def _merge_range(table: pa.Table) -> pa.Table:
    runs: dict[str, list] = {}
    for row in sorted(zip(table.column("run").to_pylist(), table.column("part").to_pylist(), table.column("entries").to_pylist(), strict=True), key=lambda r: r[:2]):
        runs.setdefault(row[0], []).extend(row[2])
    merged = list(LoserTree([iter(r) for r in runs.values()]))
    place = pa.array(range(len(merged)), pa.int64())
    return pa.table({"range": pa.array([table.column("range")[0].as_py()] * len(merged), pa.int32()), "place": place, "entry": pa.array(merged, _ENTRY)})


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS, sampled_keys: int = SAMPLED_KEYS) -> DataFrame:
    """All captures with ``capture_pos``, their place in the global order by key, time and id."""
    spark = runs.sparkSession
    total = runs.agg(F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()[0]
    n = max(1, min(-(-total // range_rows), sampled_keys // 4))
    keys = runs.select(F.explode("entries").alias("e")).select("e.key", "e.captured_at", F.coalesce("e.page_id", F.lit(-1)).alias("id"))
    sample = sorted(tuple(r) for r in keys.orderBy(F.xxhash64("id", "key")).limit(min(sampled_keys, 40 * n)).collect()) if n > 1 else []
    cuts = spark.sparkContext.broadcast([sample[len(sample) * k // n] for k in range(1, n)])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for run, part, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = None
                for entry in entries:
                    at = bisect_right(cuts.value, _order(entry))
                    if at != last:
                        out.append((at, run, part, []))
                        last = at
                    out[-1][3].append(entry)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(_ENTRY))], names=["range", "run", "part", "entries"])

    dealt = runs.select("run", "part", "entries").mapInArrow(split, f"range int, run string, part int, entries array<{_ENTRY_SQL}>")
    counts = dealt.groupBy("range").agg(F.sum(F.size("entries")).alias("_n"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ahead = counts.select("range", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_ahead"))
    merged = dealt.groupBy("range").applyInArrow(_merge_range, f"range int, place long, entry {_ENTRY_SQL}")
    return merged.join(ahead, "range").select("entry.*", (F.col("_ahead") + F.col("place")).alias("capture_pos"))


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url_key,
    captured_at, capture_pos) of every record."""
    captures = merge_runs(read_runs(write_archives(pages)))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("key").alias("url_key"), "captured_at", "capture_pos")


ORACLE = r"""
WITH p AS (SELECT page_id, trim(coalesce(url, '')) AS url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY digest),
u AS (
  SELECT *, regexp_matches(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//') AS full_url,
         regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www[0-9]*\.', '') AS host,
         regexp_replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM p
), k AS (
  SELECT *, CASE WHEN NOT full_url THEN lower(url) ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
         || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS url_key,
         strftime(make_timestamp(1704067200000000 + (page_id % 3000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM u
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to,
       url_key, captured_at, row_number() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS capture_pos
FROM k LEFT JOIN f USING (digest)
"""
