"""WARC archives with revisit records, and a globally ordered capture index.

Writing stays in the JVM: equal payloads are found by digest (the summed
groups, not the payloads, are compared), each record is one text row and the
text writer's line separator is the empty line that ends a record, so every
part file is an archive, compressed as a whole, in whatever store Spark
writes.  Reading streams the same files and follows Content-Length, so a
payload may hold empty lines and an archive is never in memory whole.

Index: each archive's captures are sorted locally and stored as runs; the key
space (URL key, timestamp, id) is cut into ranges, and inside a range the runs
are merged by a loser tree, so ranges in order give every URL's history in
order of time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import materialize
from ..session import scratch_path, shuffle_parts

END = "\r\n\r\n"  # fixed value: ends a header block, and a record
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)  # capture time of id 0 where pages have no time
RUN_CAPTURES = 20_000  # captures of a sorted run
RANGE_CAPTURES = 100_000  # captures aimed at in a range


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a hex SHA-1: four times ten hex digits are eight base32 digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            time_col: str | None = None) -> DataFrame:
    """One WARC record per row in column ``value``, without the empty line that ends it.

    Of equal payloads of ``least`` bytes or more the largest id is the
    response (a null id is below all others) and the others revisit it; rows
    that share that id are all responses.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("body"),
                        (F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")).alias("time"))
    rows = rows.withColumns({"n": F.octet_length("body"), "key": F.unhex(F.sha2("body", 256))})
    # groups of more than one row, summed inside the tasks before their digests are shuffled
    groups = rows.where(F.col("n") >= least).groupBy("key").agg(F.max(F.struct("id", "url")).alias("r"), F.count(F.lit(1)).alias("many"))
    groups = groups.where("many > 1").select(F.col("key").alias("gkey"), F.col("r.id").alias("rid"), F.col("r.url").alias("rurl"), F.lit(True).alias("grouped"))
    # stored, so that both sides of the join are plain shuffles, of which Spark splits a hot payload's partition
    groups = materialize(groups, "equal")
    told = rows.join(groups, (F.col("key") == F.col("gkey")) & (F.col("n") >= least), "left")
    revisit = F.coalesce(F.col("grouped"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("rid"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("body"))
    when = F.date_format(F.coalesce(F.col("time"), F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce(
        F.expr("try_cast(id as bigint)"), F.lit(0)) % F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("id")), F.lit("\r\nWARC-Date: "), when,
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), _one_line(F.col("url")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.sha1("body")),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("rid")),
            F.when(F.col("rurl").isNotNull(), F.concat(F.lit("\r\nWARC-Refers-To-Target-URI: "), _one_line(F.col("rurl")))).otherwise(""))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit(END))
    return told.select(F.concat(head.cast("binary"), http.cast("binary"), body).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0, **columns) -> None:
    """Write the records of ``pages`` as compressed archives below ``path``, one for each partition."""
    records(pages, least, **columns).write.option("lineSep", END).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query, lower case; no scheme, ``www.`` or fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#:]*)(?::(\d*))?([^#]*)", url.strip().lower(), re.S)
    host, port, rest = m[1].rsplit("@", 1)[-1], m[2], m[3]
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port not in (None, "", "80", "443") else "") + ")" + (rest or "/")


class Reader:
    """Reassembles records from the pieces between empty lines of one archive after another."""

    def __init__(self):
        self.file, self.offset, self.head, self.block, self.missing, self.start = None, 0, None, [], 0, 0

    def feed(self, file: str, piece: bytes):
        """The record that ends with this piece (or at its start, before the next header), as ``(file, offset, headers, block)``, else None."""
        if file != self.file:
            self.close()
            self.file, self.offset = file, 0
        at, self.offset, got, end = self.offset, self.offset + len(piece) + len(END), None, END.encode()
        if self.block and self.missing < len(end):
            # a block that ends in CR LF and the record's end were cut one CR LF early: the rest of the end comes first here
            both = end[:self.missing] + end
            if not both.startswith(end) or not piece.startswith(both[len(end):]):
                raise ValueError(f"a record at byte {self.start} of {file} is longer than its Content-Length")
            self.block.append(end[:self.missing])
            at, piece, got = at + self.missing, piece[self.missing:], self._record()
            if not piece:  # the end of the archive
                return got
        if self.head is None:
            lines = piece.decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at} of {file}")
            self.head = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
            self.start, self.block, self.missing = at, [], int(self.head["Content-Length"])
            return got
        if self.block:
            piece = end + piece  # the separator belongs to the block
        self.block.append(piece)
        self.missing -= len(piece)
        if self.missing < 0:
            raise ValueError(f"a record at byte {self.start} of {file} is longer than its Content-Length")
        return None if self.missing else self._record()

    def _record(self) -> tuple:
        got = (self.file, self.start, self.head, b"".join(self.block))
        self.head, self.block = None, []
        return got

    def close(self):
        if self.head is not None:
            raise ValueError(f"{self.file} ends inside a record")


_CAPTURE = pa.schema([("page", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                      ("refers", pa.string()), ("url", pa.string()), ("url_key", pa.string()), ("time", pa.string()),
                      ("archive", pa.string()), ("at_byte", pa.int64()), ("run", pa.string()), ("seq", pa.int64())])
_CAPTURE_DDL = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in _CAPTURE)


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:x-page:"):-1] or None if urn else None


def _capture(file: str, at: int, head: dict, block: bytes) -> tuple:
    http, _, body = block.partition(END.encode())
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError(f"the payload at byte {at} of {file} is not that of its digest")
    url = head.get("WARC-Target-URI")
    return (_page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), url,
            url_key(url or ""), head["WARC-Date"], file, at)


def _order(capture: tuple) -> tuple:
    page = capture[0]
    return capture[6], capture[7], len(page or ""), page or ""


def captures(spark, path: str, run_captures: int = RUN_CAPTURES) -> DataFrame:
    """Captures of all archives below ``path``, as locally sorted runs (``run``, ``seq``).  Payloads are checked
    against their digests; a broken archive is an error."""
    lines = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def run(batches):
        reader, found, number = Reader(), [], 0

        def sorted_run():
            found.sort(key=_order)
            name = f"{found[0][8]}#{found[0][9]}"
            rows = [(*c, name, i) for i, c in enumerate(found)]
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_CAPTURE)], schema=_CAPTURE)

        for batch in batches:
            pieces, files = batch.column(0), batch.column(1).to_pylist()
            for i, file in enumerate(files):
                got = reader.feed(file, pieces[i].as_py())
                if got is not None:
                    if found and (len(found) >= run_captures or found[0][8] != file):
                        yield sorted_run()
                        found = []
                    found.append(_capture(*got))
        reader.close()
        if found:
            yield sorted_run()

    return lines.mapInArrow(run, _CAPTURE_DDL)


class LoserTree:
    """K-way merge of sorted lists: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head = [0] * self.k
        self.keys = [key(r[0]) if r else None for r in runs]
        self.node = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int):
        at = (i + self.k) // 2
        while at > 0:
            if self.node[at] < 0:  # the first to come waits for the other side
                self.node[at] = i
                return
            if self._before(self.node[at], i):
                self.node[at], i = i, self.node[at]
            at //= 2
        self.node[0] = i

    def __iter__(self):
        while self.k and self.keys[i := self.node[0]] is not None:
            yield self.runs[i][self.head[i]]
            self.head[i] += 1
            self.keys[i] = self.key(self.runs[i][self.head[i]]) if self.head[i] < len(self.runs[i]) else None
            self._play(i)


def merged(runs: DataFrame, n: int, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """The captures of sorted runs in global order of (URL key, time, id): partitions are ranges, merged inside."""
    parts = max(shuffle_parts(runs.sparkSession), -(-n // range_captures))
    dealt = runs.repartitionByRange(parts, "url_key", "time", F.length(F.coalesce("page", F.lit(""))), F.coalesce("page", F.lit("")))

    def run(batches):
        by_run: dict[str, list] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                by_run.setdefault(row[10], []).append(row)
        out: list = []
        for row in LoserTree([by_run[k] for k in sorted(by_run)], _order):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(_CAPTURE)], schema=_CAPTURE)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(_CAPTURE)], schema=_CAPTURE)

    return dealt.sortWithinPartitions("run", "seq").mapInArrow(run, _CAPTURE_DDL)


def archive_index(pages: DataFrame, least: int = 0, id_col: str = "page_id", path: str | None = None, **columns) -> DataFrame:
    """Write ``pages`` as archives (below ``path``, or the shared folder), read them back, and return one row per
    page in global order of URL key and time: ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, url_key, time, archive, at_byte`` (offset in the uncompressed archive).

    A null payload is empty; a null url has the key of an empty one; without
    ``time_col`` the time is the id in seconds after 2000.  Repeated rows are
    repeated records.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, least, id_col=id_col, **columns)
    runs = materialize(captures(spark, path), "runs")
    kind = pages.schema[id_col].dataType
    return merged(runs, runs.count()).select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers").cast(kind).alias("refers_to"), "url", "url_key", "time", "archive", "at_byte")
