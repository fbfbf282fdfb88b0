"""WARC archives of pages and their globally ordered capture index.

Tasks write gzip-per-record archives and, with each, a locally sorted run of index rows (url key,
timestamp, place in the archive). The runs are merged by key range: every range takes a slice of each
run, and a loser tree merges the slices. Reading goes through the merged index.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from tracemill.llm.scratch import Scratch

# Equal payloads below this size are not worth a revisit record.
REVISIT_BYTES = 1000
# Payload bytes per archive file, and index rows per merged range.
ARCHIVE_BYTES = 32 << 20
# Bytes of archives that one reading task takes, about; a small set is spread over the cores instead.
READ_BYTES = 64 << 20
RANGE_ROWS = 1 << 16
_SALTS = 16
_FIRST_CAPTURE = 1_700_000_000  # seconds; captures are a second apart, in order of page_id


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner moves up.

    Taking the next row replays one path, so a row costs one comparison per level.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * max(1, k)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.losers[0] = winners[1] if k > 1 else 0 if k else -1

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return (self.heads[a], a) < (self.heads[b], b)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k and self.heads[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + k) // 2
            while node >= 1:
                if self._before(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def _timestamp(page_id: int | None) -> str:
    seconds = _FIRST_CAPTURE + (page_id or 0) % (1 << 33)
    return (dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record(kind: str, url: str | None, page_id: int | None, refers_to: int | None, payload: bytes, sha1: bytes) -> bytes:
    """One gzip member. A revisit has the HTTP header of its page, without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>",
        f"WARC-Date: {_timestamp(page_id)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}')}>",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _parsed(member: bytes) -> dict:
    """What a record says. The payload of a response is measured and hashed as it was read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if name in fields else None
    found = {"page_id": number("X-Page-ID"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")}
    if found["record_type"] == "revisit":
        length = next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        return found | {"payload_bytes": int(length[16:]), "payload_digest": digest}
    return found | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


def url_key(url: str | None) -> str:
    """Host labels in reverse, port, path and query, lower-cased: ``org,example:81)/path?x``. Null sorts as ''."""
    rest = (url or "").partition("://")[2] if "://" in (url or "") else url or ""
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    (host, colon, port), path = rest[:cut].partition(":"), rest[cut:]
    return (",".join(reversed(host.split("."))) + colon + port + ")" + path).lower()


def roles(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with the payload and whether it is a revisit of another page.

    The largest page_id of each payload is summed up before the shuffle. Only payloads that repeat
    are joined back, with salted keys, so that a payload of a third of all pages is spread.
    """
    digests = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).where(
        F.octet_length("html") >= REVISIT_BYTES).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    groups = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(
        "n > 1 and refers_to is not null").drop("n")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int")
    revisits = digests.withColumn("salt", salt).join(salted, ["digest", "salt"]).where(
        "page_id < refers_to or page_id is null").select("page_id", "digest", "refers_to").distinct()
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html")).withColumn(
        "digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1(F.col("html").cast("binary"))))
    return keyed.join(revisits.withColumnsRenamed({"page_id": "p", "digest": "d"}), (
        F.col("page_id").eqNullSafe(F.col("p"))) & (F.col("digest") == F.col("d")), "left").select(
        "page_id", "url", "html", "refers_to")


_RUN = "archive string, run_row int, url_key string, captured string, page_id bigint, offset bigint, length bigint"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of ``roles(pages)`` rows into ``folder`` and returns their sorted index runs.

    Files carry a name of their own per attempt, and only the files named by the returned rows count,
    so a repeated or speculative task does no harm. Memory: one batch of rows and one archive's index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, rows, name, held = None, [], None, 0

        def finished() -> pa.RecordBatch:
            out.close()
            ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3]))
            columns = [[name] * len(rows), range(len(rows)), *zip(*ordered)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(
                arrays, ["archive", "run_row", "url_key", "captured", "page_id", "offset", "length"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "html", "refers_to"))):
                if out is None:
                    name, rows, held = f"{uuid.uuid4().hex}.warc.gz", [], 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                kind = "response" if refers_to is None else "revisit"
                member = _record(kind, url, page_id, refers_to, payload, hashlib.sha1(payload).digest())
                rows.append((url_key(url), _timestamp(page_id), page_id, out.tell(), len(member)))
                out.write(member)
                held += len(payload)
                if held >= archive_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return pages.mapInArrow(run, _RUN)


def merged_index(runs: DataFrame, scratch: Scratch, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(range, place, url_key, captured, page_id, archive, offset, length)`` in global order.

    Ranges are ordered by (url_key, captured, page_id, archive, offset), places inside a range by the
    same; keys are cut in the middle if needed, so a url with a third of all captures takes many
    ranges. A range holds a slice of each run, in the run's own order, and merges them.
    """
    order = ["url_key", "captured", "page_id", "archive", "offset"]
    n_rows = runs.count()
    ranges = max(1, -(-n_rows // range_rows))
    slices = runs.repartitionByRange(ranges, *order).sortWithinPartitions("archive", "run_row")
    slices = slices.withColumn("range", F.spark_partition_id())
    names = ["range", *order[:4], "offset", "length"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list] = {}
        which = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*order, "length", "range"))):
                which = row[6]
                by_run.setdefault(row[3], []).append(
                    (row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4], row[5]))
        if which is None:
            return
        rows = list(LoserTree(list(by_run.values())))
        columns = list(zip(*rows))
        ids = [i if known else None for known, i in zip(columns[2], columns[3])]
        yield pa.RecordBatch.from_arrays([
            pa.array([which] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()),
            pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(ids, pa.int64()),
            pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.int64())],
            ["range", "place", "url_key", "captured", "page_id", "archive", "offset", "length"])

    return scratch.keep(slices.select(*names).mapInArrow(
        merge, "range int, place int, url_key string, captured string, page_id bigint, archive string, "
               "offset bigint, length bigint"), "index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every indexed record.

    Index rows are gathered by archive and read in the order of their offsets. The number of tasks follows the
    bytes of the archives; those of the index, by which Spark would choose it, are a hundredth of them.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, system.open_input_file(f"{base}/{archive}")
                rows.append(_parsed(source.read_at(length, offset)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
        if source:
            source.close()

    size = index.agg(F.sum("length").alias("bytes"), F.approx_count_distinct("archive").alias("archives")).first()
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-(size.bytes or 0) // READ_BYTES), min(2 * cores, size.archives or 1))
    return index.select("archive", "offset", "length").repartition(tasks, "archive").sortWithinPartitions(
        "archive", "offset").mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_and_read(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Archives ``pages``, merges the index and reads every record back through it.

    Of equal payloads of at least REVISIT_BYTES bytes the one with the largest page_id is stored; the
    others refer to it (repeated rows of that page_id are stored again). Null html is an empty payload;
    a null page_id is written without one, sorts first, and refers to others but is never referred to;
    a null url has an empty key. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    runs = scratch.keep(write_archives(roles(slim), folder, archive_bytes), "runs")
    return read_records(merged_index(runs, scratch, range_rows), folder)
