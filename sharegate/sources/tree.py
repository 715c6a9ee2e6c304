"""Directory trees as a Spark source.

Spark's own file sources skip names that start with a dot or underscore, so ``.env`` or
``_netrc`` would vanish before any rule sees them. This source lists every regular file.
Listing and reading are separate steps: listing is metadata only, and reading is spread
over all tasks, so a folder that holds a third of all files is no single task's work.
"""

from __future__ import annotations

import datetime as dt
import functools
import os
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharegate import policy
from sharegate.functions.paths import basename, suffix
from sharegate.operators.ignore import gather_ignore_rules, ignore_files, mark_ignored
from sharegate.operators.joins import lookup_join
from sharegate.operators.settings import complete_overrides
from sharegate.policy import ShareSettings
from sharegate.session import materialize

LISTING = "share_id string, path string, length long, modified timestamp, read_error string"
FILES = "share_id string, path string, content binary, length long, modified timestamp, read_error string"
BATCH_BYTES, BATCH_ROWS, ENTRIES = 32 * 1024 * 1024, 10_000, 20_000
MAX_CELL_BYTES = 1024 * 1024 * 1024  # one value must stay clear of the 2 GiB limit of a cell


def _name(rel: str) -> tuple[str, str | None]:
    """A path as text, and an error if its bytes are not UTF-8: those are escaped as \\xNN."""
    try:
        rel.encode()
    except UnicodeEncodeError:
        return os.fsencode(rel).decode("utf-8", "backslashreplace"), "stat:name is not UTF-8"
    return rel, None


def _entry(share: str, root: str, path: str) -> tuple:
    rel, error = _name(os.path.relpath(path, root).replace(os.sep, "/"))
    if error:
        return share, rel, None, None, error
    try:
        st = os.stat(path)
    except OSError as e:
        return share, rel, None, None, f"stat:{type(e).__name__}: {e.strerror or e}"
    return share, rel, st.st_size, dt.datetime.fromtimestamp(st.st_mtime, dt.timezone.utc), None


def _entries(folder: str):
    """Entries of a folder, and an error where it cannot be read (any further)."""
    try:
        with os.scandir(folder) as entries:
            yield from entries
    except OSError as e:
        yield e


_LISTED = [("share_id", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")),
           ("read_error", pa.string()), ("folder", pa.binary())]


def _walk(root: str, share: str, most: int):
    """Folders (column ``folder``) to rows of their files, and of the folders left over (``folder`` set) once a task has ``most`` entries."""
    def read(batches):
        pending: deque[str] = deque()
        for batch in batches:
            pending.extend(map(os.fsdecode, batch.column("folder").to_pylist()))
        seen, rows = 0, []
        while pending:
            folder = pending.popleft()
            if seen >= most:
                rows.append((None,) * 5 + (os.fsencode(folder),))
            else:
                for e in _entries(folder):
                    seen += 1
                    if isinstance(e, OSError):  # a folder that cannot be listed must not look empty
                        rel = _name(os.path.relpath(folder, root).replace(os.sep, "/"))[0]
                        rows.append((share, rel, None, None, f"stat:{type(e).__name__}: {e.strerror}", None))
                    elif e.is_dir(follow_symlinks=False):
                        pending.append(e.path)
                    elif not e.is_dir():
                        rows.append((*_entry(share, root, e.path), None))
                    if len(rows) >= BATCH_ROWS:
                        yield _listed(rows)
                        rows = []
            if len(rows) >= BATCH_ROWS:
                yield _listed(rows)
                rows = []
        if rows:
            yield _listed(rows)

    return read


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _LISTED, strict=True)], names=[n for n, _ in _LISTED])


def list_tree(spark: SparkSession, root: str, share_id: str = "", partitions: int = 64, most: int = ENTRIES) -> DataFrame:
    """Listing of all files below ``root``, a folder every executor can read.

    The tree is listed in Spark stages of at most ``partitions`` tasks. A task walks down from its folders until it has
    ``most`` entries; folders it has not opened by then are dealt out again in the next stage. So a small tree takes one stage, a deep or uneven one
    spreads, and the driver sees only whether folders are left. Links to folders are not followed."""
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    level = spark.createDataFrame([(bytearray(os.fsencode(root)),)], "folder binary")
    found, spread = [], 1
    while True:
        stage = materialize(level.repartition(spread).mapInArrow(_walk(root, share_id, most), LISTING + ", folder binary"))
        found.append(stage.where("folder IS NULL").drop("folder"))
        level = stage.where("folder IS NOT NULL").select("folder")
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, found).coalesce(partitions)
        spread = partitions


def _load(path: str, length: int) -> bytes:
    if length > MAX_CELL_BYTES:
        raise OSError(f"larger than {MAX_CELL_BYTES} bytes")
    with open(path, "rb") as fh:
        return fh.read()


def _reader(root: str):
    def read(batches):
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                wanted, row["content"] = row.pop("wanted"), None
                if wanted:
                    try:
                        row["content"] = _load(os.path.join(root, row["path"]), row["length"])
                        size += len(row["content"])
                    except OSError as e:
                        row["read_error"] = type(e).__name__
                rows.append(row)
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return read


_ARROW = pa.schema([("share_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("length", pa.int64()),
                    ("modified", pa.timestamp("us", tz="UTC")), ("read_error", pa.string())])


_MARKS = [("ign_file", pa.bool_()), ("ign_depth", pa.int32())]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    marked = "ign_depth" in rows[0]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*_ARROW, *(pa.field(*m) for m in _MARKS)]) if marked else _ARROW)


def read_files(listing: DataFrame, root: str, tasks: int | None = None, *, max_bytes: int | None = policy.MAX_SCAN_BYTES,
               allow: tuple[str, ...] = ()) -> DataFrame:
    """Listed files with their whole content, dealt out over ``tasks`` (default:
    ``spark.sql.shuffle.partitions``).

    Files that an ignore decision on the listing settles (``ignore.mark_ignored``) are not read, unless their path is in ``allow``.
    Files above ``max_bytes`` (the run's ``max_scan_bytes``) are only read if their kind is scanned at any size or their path is in ``allow``. A file
    too large for one value counts as unreadable, so it is withheld."""
    safe = suffix(basename(F.col("path"))).isin(policy.BINARY_SAFE_EXTS)
    wanted = F.col("length").isNotNull()
    if max_bytes is not None:
        small = (F.col("length") <= max_bytes) | safe
        wanted &= small if not allow else small | F.col("path").isin(*allow)
    marks = [c for c, _ in _MARKS] if "ign_depth" in listing.columns else []
    if marks:
        wanted &= F.col("ign_depth").isNull() & (~F.coalesce("ign_file", F.lit(False)) | F.col("path").isin(*allow))
    rows = listing.select("share_id", "path", "length", "modified", "read_error", *marks,
                          F.coalesce(wanted, F.lit(False)).alias("wanted"))
    tasks = tasks or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks).mapInArrow(_reader(os.path.abspath(root)), FILES + (", ign_file boolean, ign_depth int" if marks else ""))


def read_share(listing: DataFrame, root: str, settings: ShareSettings, *, overrides: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Listed files for ``classify``: ignore files are read first, decide on the listing, and what they ignore is not read."""
    if not settings.respect_ignore:
        return read_files(listing, root, tasks, max_bytes=settings.max_scan_bytes, allow=settings.allow)
    sources = ignore_files(listing, settings.ignore_files, overrides).drop("name_ord")
    rules = gather_ignore_rules(read_files(sources, root, tasks), settings.ignore_files, overrides)
    depth = settings.focus.strip("/").count("/") + 1 if settings.focus else 0
    marked = mark_ignored(listing, rules, min_depth=depth)
    if overrides is not None:  # a share may allow a file that is ignored
        allowed = complete_overrides(overrides).select("share_id", F.explode("allow").alias("path")).distinct().withColumn("_allowed", F.lit(True))
        marked = lookup_join(marked, allowed, ["share_id", "path"]).withColumn("ign_file", F.col("ign_file") & F.col("_allowed").isNull()).drop("_allowed")
    return read_files(marked, root, tasks, max_bytes=settings.max_scan_bytes, allow=settings.allow)
