"""Session helpers shared by all operators: table access, lineage cuts and partition sizing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from importlib import metadata
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session: they need not start where it can be imported.

    Nothing is sent if the package is installed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_crawlquarry_shipped", False):
        return
    sc._crawlquarry_shipped = True
    try:
        metadata.version("crawlquarry")
    except metadata.PackageNotFoundError:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="crawlquarry-")) / "crawlquarry.zip"  # on the driver, which serves it
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted([*root.rglob("*.py"), *root.rglob("*.toml")]):
                z.write(f, f"crawlquarry/{f.relative_to(root)}")
        sc.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory; columns and filters push down into the scan."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: `spark.checkpoint.dir` of the session, else (tests only) a local one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = os.path.join(tempfile.gettempdir(), "crawlquarry-checkpoints")
    sc.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably: the rows are written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def default_parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, if the scan has fewer partitions than these: a small input would keep one core busy.

    A large input has many splits a core and stays where it is read.
    """
    cores = default_parallelism(df.sparkSession)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# -- bit tables: sets of rows with a fixed size bound, looked up without a join --------------------------------------

TABLE_LEAST, TABLE_MOST = 1 << 16, 1 << 26


def bit_table(rows: DataFrame, *key: Column, bits: int | None = None) -> tuple[bytes, int]:
    """A table with one bit set for each key of the rows, and its number of bits.

    Executors build it; the driver gets its bits: 16 a row, TABLE_LEAST at least and TABLE_MOST at most.  A row whose bit is
    set may be one of these rows, any other row is none.
    """
    if bits is None:
        n, bits = rows.count(), TABLE_LEAST
        while bits < min(16 * n, TABLE_MOST):
            bits *= 2
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    parts = rows.select(place.alias("p")).groupBy((F.col("p") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()
    table = bytearray(bits >> 3)
    for r in parts:
        table[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = r["bits"]
    return bytes(table), bits


def in_table(table: bytes, bits: int, *key: Column) -> Column:
    """Is the bit of a key set?  The table becomes a literal of the plan, so nothing is joined."""
    here = F.pmod(F.xxhash64(*key), F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.lit(table), F.shiftright(here, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2.0), F.pmod(here, F.lit(8))).cast("int")) > 0


def rows_once(df: DataFrame, key: str) -> DataFrame:
    """Each key once; null keys are left out.

    Which keys come twice is counted on the key alone.  Rows whose bit isn't set in the table of these keys are unique and go
    straight on; only the others are shuffled with all their columns.
    """
    keyed = df.where(F.col(key).isNotNull())
    twice = cut(keyed.select(key).groupBy(key).count().where("count > 1").select(key))
    table, bits = bit_table(twice, F.col(key))
    if not any(table):
        return keyed
    here = in_table(table, bits, F.col(key))
    return keyed.where(~here).unionByName(keyed.where(here).dropDuplicates([key]))


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: computed once, read by column as often as needed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
