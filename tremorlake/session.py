"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIMENSIONS: dict[tuple[str, str], DataFrame] = {}
#: Bytes up to which Spark may choose by itself to send a side of a join to all tasks.
BROADCAST_MOST = 256 << 10


def prepare(spark: SparkSession) -> SparkSession:
    """Use UTC, bound broadcasts that are not asked for, and make sure a checkpoint folder is known."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    bound_broadcasts(spark)
    scratch_root(spark)
    return spark


def bound_broadcasts(spark: SparkSession) -> None:
    """Keep event-sized sides of joins off the driver.

    Spark judges by compressed bytes: 10 MB of files or shuffle output are a million events,
    hundreds of MB as a hash table on the driver, and several joins build theirs at once.
    Grid-sized sides are hinted and not concerned; a lower limit of the session stays.
    """
    first, later = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    for key in (first, later):
        # without a default: conf.get(key, None) answers None for a limit nobody has set, though Spark's 10 MB hold
        if (now := spark.conf.get(key)) and size_bytes(now) > BROADCAST_MOST:
            spark.conf.set(key, str(BROADCAST_MOST))


def event_sized(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the events: merged, whatever limit holds when the join is planned.

    Spark judges a side by column widths and compressed bytes and does not see what ``explode`` adds,
    and a lazy result is planned under the limits of the session that writes it.
    """
    return side.hint("merge")


def size_bytes(text: str) -> int:
    """Bytes of a size as Spark's settings write it."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)[a-z]*\s*", text.lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(unit, 0)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may do without: it
    gets a private folder. On a cluster a missing name is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="tremorlake-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dimension(spark: SparkSession, name: str, build) -> DataFrame:
    """Build a grid-sized dimension once per application and keep it checkpointed.

    Only for tables whose size is set by the grid (at most a few hundred thousand
    rows), never for tables that grow with the catalog.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _DIMENSIONS:
        scratch_root(spark)
        _DIMENSIONS[key] = build(spark).coalesce(1).checkpoint()
    return _DIMENSIONS[key]


def inline(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A small fixed table as a local relation (no Python workers involved)."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def struct_array(rows, names) -> Column:
    """A literal array of structs, parsed from text (one call, not one per value)."""
    body = ", ".join(
        "struct(" + ", ".join(f"{literal(v)} as {n}" for v, n in zip(row, names)) + ")" for row in rows)
    return F.expr(f"array({body})")


def literal(value) -> str:
    """A SQL literal that Spark and DuckDB read the same way."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}" if "e" in repr(value) else f"{value!r}e0"
    return "'" + str(value).replace("'", "''") + "'"
