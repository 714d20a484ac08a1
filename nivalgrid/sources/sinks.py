"""Sinks, partitioned caches, published versions and materialise-or-reuse.

A published table is a folder of versions: ``path/versions/<name>`` holds the data of one version,
``path/manifest`` one row per published version, appended when its data is complete. Readers take
the newest row, so a version that failed half-way is never seen, and one that is
being replaced stays readable, also for the build that replaces it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits per axis of the space-filling key: rows and columns up to 1,048,575, days up to the year 4840.
CLUSTER_BITS = 20


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (as in tests) gets a folder of its own; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/nivalgrid/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a result table.

    With ``partition_by`` the rows are rebalanced on it first: small partitions
    get one file, and a partition that holds most rows is split over many tasks.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_cube(cells: DataFrame, path: str) -> None:
    """Daily cell table partitioned by source and water year, sorted for row-group pruning by date and cell."""
    (cells.hint("rebalance", "source", "water_year")
     .sortWithinPartitions("source", "water_year", "date", "row", "col")
     .write.mode("overwrite").partitionBy("source", "water_year").parquet(path))


def scratch_table(name: str) -> str:
    """A table name that no other call uses."""
    return f"nivalgrid_{name}_{uuid.uuid4().hex}"


def write_bucketed(cells: DataFrame, table: str, path: str, by: Sequence[str] = ("row", "col"), buckets: int | None = None,
                   order: Sequence[str] = ("water_year", "date")) -> DataFrame:
    """Store a cube in buckets of its cell and read it back as ``table``.

    Reading the table brings the partitioning along: aggregations, windows and joins whose keys hold
    ``by`` need no exchange. One task writes one bucket, so there is one file each.
    """
    spark, by = cells.sparkSession, list(by)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = [c for c in (*by, *order) if c in cells.columns]
    (cells.repartition(buckets, *by).write.mode("errorifexists").option("path", path)
     .bucketBy(buckets, *by).sortBy(*inner).format("parquet").saveAsTable(table))
    return spark.table(table)


def cluster_key(row="row", col="col", day="date", bits: int = CLUSTER_BITS) -> Column:
    """Place of (row, col, day) on a Z curve: the bits of the three numbers interleaved.

    Days count from 1970; numbers beyond ``bits`` bits share the last place of their axis.
    """
    top = (1 << bits) - 1
    axes = [F.greatest(F.lit(0), F.least(F.lit(top), v)).cast("bigint") for v in (F.col(row), F.col(col), F.unix_date(F.col(day)))]
    out = F.lit(0).cast("bigint")
    for low in range(0, bits, 10):
        for a, axis in enumerate(axes):
            ten = F.shiftright(axis, low).bitwiseAND(F.lit(1023).cast("bigint"))
            out = out + F.shiftleft(_spread_ten(ten), 3 * low + 2 - a)
    return out


def _spread_ten(v: Column) -> Column:
    """Bits 0 to 9 moved to 0, 3, ... 27: each product adds a copy of the bits beside them, each mask keeps half of either."""
    for times, mask in ((65537, 0x030000FF), (257, 0x0300F00F), (17, 0x030C30C3), (5, 0x09249249)):
        v = (v * F.lit(times)).bitwiseAND(F.lit(mask).cast("bigint"))
    return v


def cluster_ranges(low: Sequence[int], high: Sequence[int], bits: int = CLUSTER_BITS, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of :func:`cluster_key` that cover the box ``low .. high`` (inclusive), at most about ``most`` of them.

    The cube of all places is halved along each axis in turn. Parts outside the box are left, parts inside it are taken
    whole; once there are ``most`` parts the remaining ones are taken as they are, which only adds rows to read.
    """
    top = (1 << bits) - 1
    low, high = [max(0, min(top, x)) for x in low], [max(0, min(top, x)) for x in high]
    done, open_ = [], [((0, 0, 0), bits)]
    while open_ and len(done) + len(open_) * 2 < most:
        at, level = open_.pop(0)
        if level == 0:
            done.append((at, level))
            continue
        half = 1 << (level - 1)
        for k in range(8):
            corner = tuple(x + half * (k >> (2 - a) & 1) for a, x in enumerate(at))
            if all(c <= h and c + half - 1 >= lo for c, lo, h in zip(corner, low, high)):
                inside = all(c >= lo and c + half - 1 <= h for c, lo, h in zip(corner, low, high))
                (done if inside else open_).append((corner, level - 1))

    def first(at: tuple[int, ...]) -> int:
        return sum((x >> i & 1) << (3 * i + 2 - a) for a, x in enumerate(at) for i in range(bits))

    out: list[list[int]] = []
    for lo, hi in sorted((first(at), first(at) + (1 << 3 * level) - 1) for at, level in done + open_):
        if out and lo == out[-1][1] + 1:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def write_clustered(cells: DataFrame, path: str, row_group_bytes: int = 8 << 20, key: str = "cluster_key") -> None:
    """Cube sorted by a space-filling key of (row, col, date), in small row groups, so that box reads skip most of them.

    The range exchange splits crowded places of the curve by (row, col, date) as well.
    """
    keyed = cells.withColumn(key, cluster_key())
    (keyed.repartitionByRange(key, "row", "col", "date").sortWithinPartitions(key, "row", "col", "date")
     .write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path))


def read_box(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], days: tuple[str, str],
             key: str = "cluster_key") -> DataFrame:
    """Rows of a clustered cube in the half-open cell box and the closed period; the box reaches the scan as key ranges."""
    from datetime import date

    number = [(date.fromisoformat(d) - date(1970, 1, 1)).days for d in days]
    ranges = cluster_ranges((rows[0], cols[0], number[0]), (rows[1] - 1, cols[1] - 1, number[1]))
    near = F.lit(False)
    for lo, hi in ranges:
        near = near | F.col(key).between(lo, hi)
    inside = (F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1)
              & F.col("date").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
    return spark.read.parquet(path).where(near & inside).drop(key)


def read_if_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at a path, or None where there is nothing; any other problem is raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


MANIFEST = "sequence bigint, version string, format string"


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """Published versions, oldest first: (sequence, folder, format); one short row each."""
    listed = read_if_exists(spark, f"{path}/manifest")
    rows = [] if listed is None else listed.collect()
    return [(r["sequence"], f"{path}/versions/{r['version']}", r["format"]) for r in sorted(rows, key=lambda r: (r["sequence"], r["version"]))]


def publish(spark: SparkSession, path: str, write: Callable[[str], None], fmt: str = "parquet") -> str:
    """Let ``write`` fill the folder of a new version and publish it; returns the folder.

    The manifest row is appended by Spark's own committer after the data is complete. If ``write``
    fails nothing is published. Versions are never overwritten.
    """
    sequence = max((v[0] for v in versions(spark, path)), default=0) + 1
    name = f"{sequence:08d}-{uuid.uuid4().hex}"
    folder = f"{path}/versions/{name}"
    write(folder)
    spark.createDataFrame([(sequence, name, fmt)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return folder


def published(spark: SparkSession, path: str, back: int = 0) -> DataFrame | None:
    """The newest published version, or the one ``back`` versions before it; None where there is none."""
    found = versions(spark, path)
    if len(found) <= back:
        return None
    _, folder, fmt = found[-1 - back]
    reader = spark.read.format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(folder)


def publish_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """:func:`write_table` as a new version of ``path``; ``df`` may read an earlier one."""
    return publish(df.sparkSession, path, lambda folder: write_table(df, folder, fmt, partition_by), fmt)


def publish_cube(cells: DataFrame, path: str) -> str:
    """:func:`write_cube` as a new version of ``path``; ``cells`` may read an earlier one."""
    return publish(cells.sparkSession, path, lambda folder: write_cube(cells, folder))


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], expected: DataFrame,
                   keys: Sequence[str] = ("date",), mode: str = "exact") -> tuple[DataFrame, bool]:
    """Read the published table when it answers the request, else build and publish it.

    ``exact``: its keys equal the expected keys. ``covers``: it has every expected key; only rows
    of the expected keys are returned. An empty request is covered by any published table.
    ``build`` may read the published table, and the table outlives a build that fails.
    """
    if mode not in ("exact", "covers"):
        raise ValueError("mode must be 'exact' or 'covers'")
    keys = list(keys)
    stored = published(spark, path)
    if stored is not None:
        have, want = stored.select(*keys).distinct(), expected.select(*keys).distinct()
        complete = want.join(have, keys, "left_anti").isEmpty()
        if mode == "covers" and complete:
            return stored.join(want, keys, "left_semi"), True
        if complete and have.join(want, keys, "left_anti").isEmpty():
            return stored, True
    publish(spark, path, lambda folder: build().write.parquet(folder))
    return published(spark, path), False
