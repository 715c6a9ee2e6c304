"""WARC archives with a two-level capture index.

Archives. Every page is a WARC/1.1 record. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes that with the smallest id is
a response, the others are revisits of it without a body; smaller payloads are always responses. Records are text (headers and
UTF-8 html), so Spark's text writer stores them, with the two line breaks that end a record as its line separator: the part files
are plain archives, in any store.

Index. Archives are scanned for (capture key, archive, offset, length). The key is the reversed host and path of the URL and the page id. Keys
are range-sorted and cut into blocks of ``BLOCK_LINES`` lines, compressed; the directory keeps the first key of each block, and
the parts of the sort (at most ``MOST_PARTS``) the first key of their first block. A lookup finds the part by its bounds, the block by binary search in the
part's directory, the line by binary search in the block, and reads only the record's range of the archive.

Range reads. Spark has no ranged read of its own, so tasks open archives with pyarrow's file systems (local and shared folders, HDFS, object
stores): the index scan reads headers and seeks past bodies, a lookup seeks to its ranges. So no archive is ever
held whole, however large it is. Where pyarrow has no file system for the folder's scheme, archives are read as values by Spark instead.

Defined results: a null html is empty (0 bytes, digest of nothing); a null url is indexed under ")"; line breaks in a url are percent-encoded;
a null page id sorts before all others and is written as an empty field; pages with equal ids have equal keys and are all
found; pages with the response's id are responses too; an empty table gives no archives, and an empty result. Columns other than
the three named are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharegate.llm.common import quoted, stored, text_of
from sharegate.operators.joins import lookup_join

MIN_REVISIT, ARCHIVE_BYTES, BLOCK_LINES, PART_LINES, MOST_PARTS = 100, 16 << 20, 256, 50_000, 2_000
GAP_BYTES, RUN_BYTES, MOST_TASKS = 1 << 16, 4 << 20, 20_000  # ranges this near are read at once, up to so many bytes
DATE = "2024-01-01T00:00:00Z"
BREAK, END = "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: Column) -> Column:
    """``http://b.example.com:80/x?y`` to ``com,example,b)/x?y``; without a host the whole after ``)``."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def clean_url(url: Column) -> Column:
    return F.replace(F.replace(F.coalesce(url.cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def capture_key(url: Column, page_id: Column) -> Column:
    """Sorts by SURT, then by page id (shifted to 20 digits; a null id before all)."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.expr("9223372036854775809BD")).cast("string"), 20, "0")
    return F.concat(surt(url), F.lit(" "), F.coalesce(number, F.lit("0" * 20)))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    rows = pages.select(F.col(quoted(page_id)).cast("long").alias("page_id"), clean_url(F.col(quoted(url))).alias("url"), text_of(html).alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"))
    # payloads that occur more than once, aggregated before they are shuffled
    order = F.struct(F.col("page_id").isNotNull(), "page_id")
    again = stored(rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.min(order)["page_id"].alias("_first"))
                   .where("_n > 1").select("digest", "_first", F.lit(True).alias("_again")))
    rows = lookup_join(rows, again, ["digest"], "left", spread_by="page_id")
    revisit = F.col("_again").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))

    def urn(page: Column) -> Column:
        h = F.md5(F.concat_ws(" ", F.lit("page"), page.cast("string"), F.col("digest")))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))

    def head(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit(BREAK))

    record = F.concat(
        F.lit(f"WARC/1.1{BREAK}"), head("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        head("WARC-Record-ID", urn(F.col("page_id"))), head("WARC-Date", DATE), head("WARC-Target-URI", F.col("url")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), head("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        head("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(head("WARC-Refers-To", urn(F.col("_first"))), head("X-Refers-To-Page", F.coalesce(F.col("_first").cast("string"), F.lit(""))),
                                 head("WARC-Profile", REVISIT_PROFILE))).otherwise(F.lit("")),
        head("Content-Type", "application/http; msgtype=response"), head("Content-Length", F.octet_length(block).cast("string")), F.lit(BREAK), block)
    # each task writes the pages it has read, without a shuffle, in archives of about ARCHIVE_BYTES
    size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(quoted(html)).cast("string")))).first()
    most = max(1, ARCHIVE_BYTES * size[0] // max(1, size[1] or 0))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split(BREAK)
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def records(archive):
    """(offset, length without the closing breaks, headers) of each record of an open archive; bodies are skipped."""
    at = 0
    while line := archive.readline():
        head = [line]
        while (line := archive.readline()) not in (b"\r\n", b""):
            head.append(line)
        fields = _headers(b"".join(head)[:-2])
        end = archive.tell() + int(fields["content-length"])
        yield at, end - at, fields
        at = archive.seek(end + len(END))


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (the body after the HTTP head)."""
    head = raw.index(b"\r\n\r\n")
    block = raw[head + 4:]
    return _headers(raw[:head]), block[block.index(b"\r\n\r\n") + 4:]


def _archives(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("archive"), *columns)


def file_system(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str] | None:
    """pyarrow's file system and folder for a folder of archives, or None where it has none for the scheme."""
    first = _archives(spark, path, "path").first()
    if first is None:
        return None
    folder = first["path"].rsplit("/", 1)[0]
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    try:
        return fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def _opened(place: tuple[fs.FileSystem, str], archive: str) -> io.BufferedReader:
    return io.BufferedReader(place[0].open_input_file(f"{place[1]}/{archive}"), GAP_BYTES)


def write_index(spark: SparkSession, archives: str, path: str) -> None:
    """Scan the archives' headers and write the sorted, compressed blocks."""
    place = file_system(spark, archives)

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(place, row["archive"]) if place else io.BytesIO(row["content"]) as archive:
                    found = [(f["warc-target-uri"], int(f["x-page-id"]) if f["x-page-id"] else None, at, n) for at, n, f in records(archive)]
                url, page, at, n = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"url": pa.array(url, pa.string()), "page_id": pa.array(page, pa.int64()),
                                                  "archive": pa.array([row["archive"]] * len(at), pa.string()),
                                                  "offset": pa.array(at, pa.int64()), "length": pa.array(n, pa.int64())})

    files = _archives(spark, archives, *([] if place else ["content"]))
    lines = stored(files.mapInArrow(scan, "url string, page_id long, archive string, offset long, length long")
                   .select(capture_key(F.col("url"), F.col("page_id")).alias("key"), "archive", "offset", "length"))
    n_parts = max(1, min(MOST_PARTS, -(-lines.count() // PART_LINES)))
    ordered = lines.repartitionByRange(n_parts, "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset") \
                   .withColumn("part", F.spark_partition_id())

    def pack(batches):
        held, part, block = [], 0, 0

        def done(some):
            raw = "\n".join(f"{k}\t{a}\t{o}\t{n}" for k, a, o, n in some)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "first_key": [some[0][0]], "n_lines": pa.array([len(some)], pa.int32()),
                "payload": pa.array([zlib.compress(raw.encode("utf-8", "surrogatepass"))], pa.binary())})

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "archive", "offset", "length")), strict=True)
            while len(held) >= BLOCK_LINES:
                yield done(held[:BLOCK_LINES])
                held, block = held[BLOCK_LINES:], block + 1
        if held:
            yield done(held)

    # the key's tabs and line breaks cannot end a field
    safe = ordered.withColumn("key", F.replace(F.replace("key", F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A")))
    safe.mapInArrow(pack, "part int, block int, first_key string, n_lines int, payload binary").write.parquet(path)


def lookup(queries: DataFrame, index: str) -> DataFrame:
    """(key, archive, offset, length) of each distinct ``key`` of the queries that the index has."""
    spark = queries.sparkSession
    blocks = spark.read.parquet(index)
    bounds = sorted((r["k"], r["part"]) for r in blocks.groupBy("part").agg(F.min("first_key").alias("k")).collect())  # at most MOST_PARTS
    keys, parts = [k for k, _ in bounds], [p for _, p in bounds]

    def route(batches):
        """Each key to the part it would lie in, and to earlier ones as long as they may end with the same key."""
        for batch in batches:
            key, part = [], []
            for k in batch.column("key").to_pylist():
                last = bisect.bisect_right(keys, k) - 1
                first = max(0, bisect.bisect_left(keys, k) - 1)
                for p in range(first, last + 1):
                    key.append(k)
                    part.append(parts[p])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(part, pa.int32())], names=["key", "part"])

    def find(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("block")
        directory, payloads, out, opened = there["first_key"].tolist(), there["payload"].tolist(), [], {}
        for k in sorted(asked["key"]):
            at = max(0, bisect.bisect_left(directory, k) - 1)
            while at < len(directory) and directory[at] <= k:
                if at not in opened:
                    lines = [x.split("\t") for x in zlib.decompress(payloads[at]).decode("utf-8", "surrogatepass").split("\n")]
                    opened = {at: (lines, [x[0] for x in lines])}  # queries come in order: one open block is enough
                lines, names = opened[at]
                for i in range(bisect.bisect_left(names, k), bisect.bisect_right(names, k)):
                    out.append((k, lines[i][1], int(lines[i][2]), int(lines[i][3])))
                at += 1
        return pd.DataFrame(out, columns=["key", "archive", "offset", "length"]).astype({"offset": np.int64, "length": np.int64})

    asked = queries.select(F.replace(F.replace("key", F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A")).alias("key")).distinct().mapInArrow(route, "key string, part int")
    return asked.groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(find, "key string, archive string, offset long, length long")


CAPTURES = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string"
_KINDS = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _captures(raws: list[bytes]) -> pa.RecordBatch:
    out = []
    for raw in raws:
        f, payload = read_record(raw)
        page, refers = f["x-page-id"], f.get("x-refers-to-page")
        full = f["warc-type"] == "response"
        out.append((int(page) if page else None, f["warc-target-uri"], f["warc-type"], int(refers) if refers else None,
                    len(payload) if full else int(f["x-payload-length"]),
                    hashlib.sha256(payload).hexdigest() if full else f["warc-payload-digest"].removeprefix("sha256:"),
                    payload.decode("utf-8", "surrogatepass") if full else None))
    columns = zip(*out, strict=True) if out else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[c.split()[0] for c in CAPTURES.split(", ")])


def runs(ranges):
    """Neighbouring (archive, offset, length), put together to be read at once: no gap above GAP_BYTES, no more than
    RUN_BYTES unless one range alone is longer. Ranges come in order of archive and offset."""
    run: list[tuple[str, int, int]] = []
    for archive, at, n in ranges:
        if run and (archive != run[0][0] or at > run[-1][1] + run[-1][2] + GAP_BYTES or at + n - run[0][1] > RUN_BYTES):
            yield run
            run = []
        run.append((archive, at, n))
    if run:
        yield run


def read_captures(found: DataFrame, archives: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (of the full payload), html (null for revisits).

    Ranges are dealt out by archive and offset, so that tasks hold about ARCHIVE_BYTES each and read neighbours at once; a
    response's digest is taken from the bytes that were read."""
    spark = found.sparkSession
    place = file_system(spark, archives)
    wanted = stored(found.select("archive", "offset", "length"))

    def ranged(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
        name, archive = None, io.BytesIO()
        for run in runs(rows):
            if run[0][0] != name:
                archive.close()
                name, archive = run[0][0], _opened(place, run[0][0])
            start = archive.seek(run[0][1])
            held = archive.read(max(at + n for _, at, n in run) - start)
            yield _captures([held[at - start:at - start + n] for _, at, n in run])
        archive.close()

    def sliced(batches):
        for batch in batches:
            for content, ranges in zip(batch.column("content"), batch.column("ranges").to_pylist(), strict=True):
                held = content.as_py()
                yield _captures([held[r["offset"]:r["offset"] + r["length"]] for r in ranges])

    if not place:
        lists = wanted.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
        return _archives(spark, archives, "content").join(lists, "archive").select("content", "ranges").mapInArrow(sliced, CAPTURES)
    tasks = min(MOST_TASKS, -(-(wanted.agg(F.sum("length")).first()[0] or 1) // ARCHIVE_BYTES))
    return wanted.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(ranged, CAPTURES)
