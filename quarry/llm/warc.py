"""WARC archives of pages, and an index of captures merged from sorted runs.

``write`` makes one WARC/1.1 record per page: a ``response`` with the page as
its payload, or, where an equal payload of ``min_revisit`` bytes or more stands
under a smaller id, a ``revisit`` of that record without payload. Spark's text
writer puts the records one after the other into gzipped files of about
``ARCHIVE_BYTES``: the two line ends that close a record are the writer's line
separator.

``read`` parses the archives by their length fields (payloads may hold anything,
also what looks like a record) and gives each archive's captures as a run sorted
by URL key and time. ``merge`` deals the runs out by ranges of key, time and id
and merges the k runs of a range with a loser tree, so that the partitions one
after the other are the captures of every URL in order. A range holds index rows
only, and captures of one URL can fill many ranges.

Rows: a null page is an empty payload; a null URL an empty one. A null id stands
after all others and is read back as null. Rows repeated under the smallest id
are all responses. Control characters and blanks in URLs are percent-encoded.
Without a time column the capture time is the id in seconds after ``EPOCH``.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import session
from quarry.llm import common

ARCHIVE_BYTES = 16 << 20
SLICE_BYTES = 4 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
NO_ID = 2 ** 63 - 1
END = "\r\n"

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?", re.I)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the last to the first, then the path;
    without scheme, port, leading www and fragment."""
    m = _HOST.match(url)
    host, rest = (m[1].lower(), url[m.end():]) if m else ("", url)
    host = re.sub(r"^www\d*\.", "", host)
    return ",".join(reversed(host.split("."))) + ")" + (rest.split("#", 1)[0] or "/")


def capture_time(page_id: int) -> str:
    seconds = page_id % (200 * 365 * 86400)  # stays within the calendar
    return (EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _name(page_id: int) -> str:
    return f"<urn:x-page:{page_id}>"


def record(page_id: int, url: str, captured: str, payload: str, first: int | None) -> str:
    """Header and block of a record, without the two line ends that close it."""
    raw = common.encode(payload)
    http = END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                     f"Content-Length: {len(raw)}", "", ""])
    revisit = first is not None and first != page_id
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {_UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha1:{digest(raw)}"]
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: {_name(first)}"]
    block = http if revisit else http + (payload or "")
    fields += ["Content-Type: application/http; msgtype=response",
               f"Content-Length: {len(common.encode(block))}", "", ""]
    return END.join(fields) + block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "html", SLICE_BYTES):
            out = [record(i, u, t or capture_time(i), h, f) for i, u, t, h, f in
                   zip(*(part.column(c).to_pylist() for c in ("id", "url", "at", "html", "first")))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
          page: str = "html", captured: str | None = None, min_revisit: int = 0) -> None:
    """Write the archives of all pages into the folder ``path``. ``captured``
    names a timestamp column in UTC."""
    at = F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'") if captured else F.lit(None)
    rows = pages.select(common.long_id(page_id).alias("id"),
                        F.coalesce(url, F.lit("")).alias("url"), at.cast("string").alias("at"),
                        F.coalesce(page, F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    sizes = pages.agg(F.count("*"), F.sum(F.octet_length(page))).first()
    each = ((sizes[1] or 0) + 500 * sizes[0]) // max(1, sizes[0])
    firsts = rows.where(F.octet_length("html") >= min_revisit) \
        .groupBy("sha").agg(F.min("id").alias("first"))
    rows.join(firsts, "sha", "left").select("id", "url", "at", "html", "first") \
        .mapInArrow(_records, "value string") \
        .write.option("lineSep", END * 2).option("compression", "gzip") \
        .option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // max(1, each))).text(path)


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, block, offset and length of each record of an archive."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        lines = archive[at:head].decode("utf-8", "replace").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = head + 4 + int(fields["content-length"])
        yield fields, archive[head + 4:end], at, end + 4 - at
        at = end + 4


_CAPTURES = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured", pa.string()),
                       ("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()),
                       ("refers_to", pa.int64()), ("at", pa.int64()), ("length", pa.int64())])
_DDL = ("run string, url_key string, captured string, id long, url string, payload_bytes long, "
        "payload_digest string, record_type string, refers_to long, at long, length long")


def _id_of(name: str) -> int:
    return int(name.removeprefix("<urn:x-page:").removesuffix(">"))


def captures(run: str, archive: bytes) -> list[tuple]:
    """An archive's captures, sorted by URL key, time and id."""
    out = []
    for fields, block, at, length in parse(archive):
        head, _, payload = block.partition(b"\r\n\r\n")
        named = fields["warc-payload-digest"].removeprefix("sha1:")
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        if fields["warc-type"] == "response" and (digest(payload), len(payload)) != (named, size):
            raise ValueError(f"{run}: the payload at byte {at} doesn't match its digest")
        refers = fields.get("warc-refers-to")
        url = fields["warc-target-uri"]
        out.append((run, url_key(url), fields["warc-date"], _id_of(fields["warc-record-id"]), url,
                    size, named, fields["warc-type"], _id_of(refers) if refers else None,
                    at, length))
    return sorted(out, key=lambda r: r[1:4])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_CAPTURES)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _CAPTURES)], schema=_CAPTURES)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            raw = zlib.decompress(content.as_py(), wbits=zlib.MAX_WBITS | 16)
            rows = captures(path.as_py().rsplit("/", 1)[-1], raw)
            for i in range(0, len(rows), 4096):
                yield _table(rows[i:i + 4096])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in a folder; each archive is a sorted run."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path) \
        .select("path", "content").mapInArrow(_runs, _DDL)


class LoserTree:
    """Merge sorted lists: each inner node keeps the loser of its match, so the
    next smallest row takes one match per level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.place = [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.loser = [-1] * len(runs)
        self.winner = -1
        for run in range(len(runs)):
            self._play(run)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _play(self, run: int) -> None:
        """Send a run up from its leaf; the first at an empty match waits there."""
        node = (run + len(self.runs)) // 2
        while node:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = run
                return
            if self._before(other, run):
                self.loser[node], run = run, other
            node //= 2
        self.winner = run

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.place[run]]
            self.place[run] += 1
            rows, at = self.runs[run], self.place[run]
            self.heads[run] = self.key(rows[at]) if at < len(rows) else None
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[0], []).append(row)
    key = lambda r: r[1:4]
    for name, rows in runs.items():
        # blocks of a run may have come in any order
        if any(key(a) > key(b) for a, b in zip(rows, rows[1:])):
            rows.sort(key=key)
    out: list[tuple] = []
    for row in LoserTree([runs[n] for n in sorted(runs)], key) if runs else ():
        out.append(row)
        if len(out) == 4096:
            yield _table(out)
            out = []
    if out:
        yield _table(out)


def merge(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, time and id."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # reading archives is dear: the runs are written once, ranges are sampled from them
    return common.staged(runs).repartitionByRange(parts, "url_key", "captured", "id") \
        .mapInArrow(_merge, _DDL)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{session.checkpoint_dir(spark)}/quarry-warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages"), path)
    known = F.when(F.col("id") < NO_ID, F.col("id"))
    return merge(read(spark, path)).select(
        known.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


# The digest's 40 hexadecimal digits are 8 groups of 20 bits: 4 characters each.
OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(p.x, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS BIGINT)
                   >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (x)
"""
