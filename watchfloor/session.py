"""Session settings, the shared checkpoint folder, and the size check in front of every broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Above this many rows a dimension is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 200_000

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a skewed partition may cost one more shuffle; a task holding a third of the data costs more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app_name: str = "watchfloor") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Where a local session without a configured folder keeps its own.
SCRATCH_SETTING = "watchfloor.scratch.dir"


def configured_folder(spark: SparkSession) -> str | None:
    """What ``spark.checkpoint.dir`` says."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor must reach.

    Only a session whose executors are threads of the driver may do without: it gets a scratch folder of its own.
    """
    folder = configured_folder(spark) or spark.conf.get(SCRATCH_SETTING, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="watchfloor-")
        spark.conf.set(SCRATCH_SETTING, folder)
    return folder


def ready(spark: SparkSession) -> SparkSession:
    """Check, at the entry of a whole job, the settings its results rest on; the others only cost time."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT"):
        raise ValueError("the session's time zone must be UTC: call watchfloor.session.tune(spark) first")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: the result survives the loss of any executor."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again. Unlike after a checkpoint, the planner then knows their
    size: its guesses for chains of joins multiply, and a loop that checkpoints carries them on."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; stops counting one row past the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_dimension(
    facts: DataFrame, dimension: DataFrame, on: str, how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a large table with a dimension whose size is checked first.

    Within the bound the dimension is broadcast and the facts are not shuffled. Beyond it both sides are shuffled on
    the key and AQE's skew join splits the partition of a hot key into tasks of even size (see ``tune``).
    """
    if fits_broadcast(dimension, max_rows):
        return facts.join(F.broadcast(dimension), on, how)
    return facts.join(dimension, on, how)


def sql_string(text: str) -> str:
    """``text`` as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Constant map lookup that stays inside generated code; null for unknown keys."""
    pairs = ", ".join(sql_string(part) for pair in mapping.items() for part in pair)
    return F.try_element_at(F.expr(f"map({pairs})"), key)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return sql_string(value)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return repr(value)


def inline_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A small constant table as a local relation: the optimiser knows its exact size."""
    select = ", ".join(f"CAST(`{name}` AS {kind}) AS `{name}`" for name, kind in columns.items())
    if not rows:
        empty = ", ".join(f"CAST(NULL AS {kind}) AS `{name}`" for name, kind in columns.items())
        return spark.sql(f"SELECT {empty} WHERE false")
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"`{name}`" for name in columns)
    return spark.sql(f"SELECT {select} FROM VALUES {values} AS t({names})")
