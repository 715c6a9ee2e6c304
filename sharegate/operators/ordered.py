"""Order-dependent operators that never gather a whole group.

The common step is *segments*: rows are range-partitioned by (group, order), so a group
of any size is cut into consecutive, similar-sized pieces, and the piece number is kept as
a column. What must flow from piece to piece is then a small summary per piece.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharegate.session import materialize

CHUNK_BYTES = 16 * 1024
PIECE_ROWS = 1_000_000  # what one task holds at a time
MIN_ROWS = 1_000  # below this, cutting further gains nothing
FAN = 32  # summaries that one task puts together


def segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a ``seg`` number that rises with the keys, at most about ``PIECE_ROWS`` each.

    Range bounds come from a sample, which reads the input a second time, and two readers of
    the result must see the same pieces. So the narrow input is checkpointed and counted,
    then cut and checkpointed again; the texts behind it are scanned once."""
    rows = materialize(df)
    total = rows.count()
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, min(cores, math.ceil(total / MIN_ROWS)), math.ceil(total / PIECE_ROWS))
    return materialize(rows.repartitionByRange(pieces, *keys).withColumn("seg", F.spark_partition_id()))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str = "before") -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group.

    Inside a piece a window does it; across pieces only one total per (group, piece) is
    summed, and their number is bounded by the partition count, not by the rows."""
    cut = segments(df, [*group, *order])
    totals = cut.groupBy(*group, "seg").agg(F.sum(value).alias("_total"))
    across = Window.partitionBy(*group).orderBy("seg") if group else Window.partitionBy(F.lit(0)).orderBy("seg")
    offsets = totals.withColumn(
        "_offset", F.coalesce(F.sum("_total").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_total")
    within = Window.partitionBy(*group, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (cut.join(offsets, [*group, "seg"])
               .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0)))
               .drop("_offset", "seg"))


# -- greedy packing ----------------------------------------------------------

def _next_starts(lens: np.ndarray, limit: int) -> np.ndarray:
    """For each item, the first later item that no longer fits a bin started at it."""
    ends = np.cumsum(lens)
    before = ends - lens
    return np.maximum(np.searchsorted(ends, before + limit, side="right"), np.arange(len(lens)) + 1)


def _piece_summary(group: str):
    """What a piece does to the fill level of the bin that is open when it begins.

    The open bin breaks at the first item that does not fit. From a break on, the rest of
    the piece is settled, so the piece is a step function of the incoming fill: one row
    per step, (fill above which it applies, bins opened, fill left at the end)."""

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, limit = pdf.sort_values(["size", "path"], key=_code_points), int(pdf["_limit"].iloc[0])
        lens = pdf["n"].to_numpy(np.int64)
        ends, nxt, n = np.cumsum(lens), _next_starts(lens, limit), len(lens)
        opened, left = np.ones(n, np.int64), ends[-1] - (ends - lens)
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                opened[i] += opened[nxt[i]]
                left[i] = left[nxt[i]]
        reach = min(n, int(np.searchsorted(ends, limit, side="right")) + 1)
        above = limit - ends[:reach]
        same = (opened[1:reach] == opened[:reach - 1]) & (left[1:reach] == left[:reach - 1])
        last = np.append(~same, True)
        return pd.DataFrame({
            group: pdf[group].iloc[0], "seg": pdf["seg"].iloc[0], "total": ends[-1], "above": above[last],
            "opened": opened[:reach][last], "left": left[:reach][last],
            "first_opened": opened[0], "first_left": left[0]})

    return summarize


def _code_points(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s.encode("utf-8")) if values.dtype == object else values


@dataclass
class Step:
    """What consecutive items do to an open bin with some fill: nothing up to ``above[0]`` but adding ``total``; from above ``above[i]`` on
    they open ``opened[i]`` bins and leave the last one filled to ``left[i]``. Without an open bin they start with ``first``."""

    total: int
    above: np.ndarray
    opened: np.ndarray
    left: np.ndarray
    first: tuple[int, int]

    @staticmethod
    def of(pdf: pd.DataFrame) -> Step:
        pdf = pdf.sort_values("above")
        return Step(int(pdf["total"].iloc[0]), *(pdf[c].to_numpy(np.int64) for c in ("above", "opened", "left")), (int(pdf["first_opened"].iloc[0]), int(pdf["first_left"].iloc[0])))

    def after(self, number: int, fill: int) -> tuple[int, int]:
        """Bin number and fill behind the items, from those before them (number 0: no bin yet)."""
        if number == 0:
            return self.first
        i = int(np.searchsorted(self.above, fill, side="left")) - 1
        return (number, fill + self.total) if i < 0 else (number + int(self.opened[i]), int(self.left[i]))

    def then(self, other: Step) -> Step:
        """Both in a row, again a step function: below its first step the fill only moves the steps of ``other``, above it each step has one outcome."""
        moved = other.above - self.total
        early = moved < self.above[0]
        ends = [other.after(o, f) for o, f in zip(self.opened.tolist(), self.left.tolist(), strict=True)]
        above = np.concatenate([moved[early], self.above])
        opened = np.concatenate([other.opened[early], np.array([o for o, _ in ends], np.int64)])
        left = np.concatenate([other.left[early], np.array([f for _, f in ends], np.int64)])
        new = np.append(True, (opened[1:] != opened[:-1]) | (left[1:] != left[:-1]))
        return Step(self.total + other.total, above[new], opened[new], left[new], other.after(*self.first))

    def rows(self, group: str, name, seg: int) -> pd.DataFrame:
        return pd.DataFrame({group: name, "seg": seg, "total": self.total, "above": self.above, "opened": self.opened, "left": self.left,
                             "first_opened": self.first[0], "first_left": self.first[1]})


def _in_order(pdf: pd.DataFrame) -> list[tuple[int, Step]]:
    return [(int(seg), Step.of(rows)) for seg, rows in pdf.groupby("seg", sort=True)]


def _joined(group: str):
    """Neighbouring summaries of one block put together into one."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = [step for _, step in _in_order(pdf)]
        return functools.reduce(Step.then, steps).rows(group, pdf[group].iloc[0], int(pdf["block"].iloc[0]))

    return join


def _carry(group: str):
    """Fill level and bin number at the start of each piece of one block, from those at the start of the block."""

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, number, fill = [], int(pdf["number"].iloc[0]), int(pdf["fill"].iloc[0])
        for seg, step in _in_order(pdf):
            rows.append((pdf[group].iloc[0], seg, fill, number))
            number, fill = step.after(number, fill)
        return pd.DataFrame(rows, columns=[group, "seg", "fill", "number"])

    return carry


def _starts(steps: DataFrame, group: str, pieces: int) -> DataFrame:
    """(group, seg, fill, number) at the start of every piece: a parallel prefix over step functions. Blocks of ``FAN`` neighbours
    are put together, level by level, until a group has one block; then the starts come back down. No task reads more than
    ``FAN`` summaries of a group."""
    kind = dict(steps.dtypes)[group]
    schema = f"{group} {kind}, seg int, total long, above long, opened long, left long, first_opened long, first_left long"
    levels, most = [steps], pieces
    while most > FAN:
        levels[-1] = materialize(levels[-1])  # read on the way up and down
        blocks = levels[-1].withColumn("block", F.floor(F.col("seg") / FAN).cast("int"))
        levels.append(blocks.groupBy(group, "block").applyInPandas(_joined(group), schema))
        most = math.ceil(most / FAN)
    starts = None
    for level in reversed(levels):
        rows = level.withColumn("block", F.floor(F.col("seg") / FAN).cast("int"))
        if starts is None:
            rows = rows.withColumns({"fill": F.lit(0).cast("long"), "number": F.lit(0).cast("long")})
        else:
            rows = rows.join(starts.withColumnRenamed("seg", "block"), [group, "block"])
        starts = rows.groupBy(group, "block").applyInPandas(_carry(group), f"{group} {kind}, seg int, fill long, number long")
    return starts


def _assign(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, limit = pdf.sort_values(["size", "path"], key=_code_points), int(pdf["_limit"].iloc[0])
    lens, fill, number = pdf["n"].to_numpy(np.int64), int(pdf["fill"].iloc[0]), int(pdf["number"].iloc[0])
    ends = np.cumsum(lens)
    nxt, n = _next_starts(lens, limit), len(lens)
    start = 0 if number == 0 else int(np.searchsorted(ends, limit - fill, side="right"))
    out = np.full(n, number, np.int64)
    while start < n:
        number += 1
        out[start:nxt[start]] = number
        start = int(nxt[start])
    return pdf.assign(bin=out)[[*[c for c in pdf.columns if c not in ("seg", "fill", "number", "bin", "_limit")], "bin"]]


def greedy_bins(df: DataFrame, group: str, limit: int | str) -> DataFrame:
    """Adds ``bin`` (from 1): items in (size, path) order, a new bin whenever the open one
    is not empty and the next item of length ``n`` would exceed ``limit`` (a number, or the name of a column that holds the
    group's own).

    Takes (group, size, path, n). Greedy filling restarts at each bin, so it is no running
    sum; but each piece is a small step function (see ``_piece_summary``), and those are put together as a parallel prefix
    (see ``_starts``). A summary holds at most limit / shortest item steps, whatever the number of items."""
    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    cut = segments(df.select(group, "size", "path", "n", most.cast("long").alias("_limit")), [group, "size", "path"])
    kind = dict(df.dtypes)[group]
    steps = cut.groupBy(group, "seg").applyInPandas(
        _piece_summary(group),
        f"{group} {kind}, seg int, total long, above long, opened long, left long, "
        "first_opened long, first_left long")
    pieces = cut.rdd.getNumPartitions()
    return (cut.join(_starts(steps, group, pieces), [group, "seg"]).groupBy(group, "seg")
               .applyInPandas(_assign, f"{group} {kind}, size long, path string, n long, bin long"))


# -- one hash over an ordered list -------------------------------------------

def _chunks(batches):
    """Joins consecutive lines of a group into byte chunks, in the order they arrive."""
    group, lines, size, number, seg = None, [], 0, 0, 0

    def flush():
        return pa.RecordBatch.from_pydict(
            {"g": pa.array([group], pa.string()), "seg": pa.array([seg], pa.int32()),
             "chunk": pa.array([number], pa.int64()), "bytes": pa.array([b"".join(lines)], pa.binary())})

    for batch in batches:
        cols = batch.to_pydict()
        for g, s, line in zip(cols["g"], cols["seg"], cols["line"]):
            data = line.encode("utf-8")
            if lines and (g != group or size + len(data) > CHUNK_BYTES):
                yield flush()
                lines, size, number = [], 0, number + 1
            group, seg = g, s
            lines.append(data)
            size += len(data)
    if lines:
        yield flush()


def _fold(batches):
    """SHA-256 over the chunks of each group; keeps one hash state, whatever the size."""
    group, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"g": pa.array([group], pa.string()),
                                           "sha256": pa.array([state.hexdigest()], pa.string())})

    for batch in batches:
        for g, data in zip(batch.column("g").to_pylist(), batch.column("bytes").to_pylist()):
            if state is None or g != group:
                if state is not None:
                    yield done()
                group, state = g, hashlib.sha256()
            state.update(data)
    if state is not None:
        yield done()


def ordered_sha256(df: DataFrame, group: str, order: list[str], line: Column, out: str) -> DataFrame:
    """(group, hash): SHA-256 over the group's lines in the given order.

    One SHA-256 stream cannot be split, so its last step reads a group's lines in sequence.
    It is kept cheap: sorting is a range sort over all tasks (of checkpointed narrow rows,
    as range partitioning reads its input twice), lines travel as 16 KiB chunks, and the
    last step holds one hash state and one batch in memory."""
    ranged = (materialize(df.select(F.col(group).alias("g"), *order, line.alias("line")))
                .repartitionByRange("g", *order).sortWithinPartitions("g", *order)
                .select("g", F.spark_partition_id().alias("seg"), "line"))
    chunks = ranged.mapInArrow(_chunks, "g string, seg int, chunk long, bytes binary")
    return (chunks.repartition("g").sortWithinPartitions("g", "seg", "chunk")
                  .mapInArrow(_fold, "g string, sha256 string")
                  .select(F.col("g").alias(group), F.col("sha256").alias(out)))
