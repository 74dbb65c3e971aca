"""What the operators share: table access, staged tables, joins that spread hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a local
    master, as in tests, gets one of its own if that setting is missing."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: list[str] = []  # paths of this process


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: the lineage is cut, a lost
    executor costs only its own tasks, and a result used twice is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for `release`: how many tables this process has staged."""
    return len(_written)


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the tables staged since a mark but for the last `keep`, once nothing will read them."""
    done = _written[since: len(_written) - keep]
    for path in done:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written[since: since + len(done)]


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay until the driver has collected the plans that made them, which may be long after
    the last use where little else fills its heap. Called after steps that shuffle much."""
    gc.collect()
    spark._jvm.System.gc()


def runs_for(rows: int, rows_per_run: int = 8192, most: int = 4096) -> int:
    """A power of two that grows with the rows; a key that holds all rows is spread over so many."""
    n = 4
    while n < most and n * rows_per_run < rows:
        n *= 2
    return n


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], salt: Column, n_salts: int) -> DataFrame:
    """rows left-joined with facts, which has one row for each key. A key that many rows share is
    split by salt: facts meet the distinct (key, salt) pairs first, then each row joins on both,
    so no task gets all rows of a hot key. Keys are not null: a null one would find no facts."""
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(n_salts)).cast("int"))
    spread = salted.select(*keys, "_salt").distinct()
    per_salt = spread.join(facts.hint("merge"), keys, "left")
    return salted.join(per_salt.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of docs, so that none can clash with others), id, text (null as empty) and
    k1, k2: 128 bits of hashes of the id and the text. Rows with the same keys repeat both."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.select("row", F.col("row")[id_col].alias("id"), F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"))
    both = F.struct(F.col("id").isNull().alias("none"), "id", "text")
    return rows.select("*", F.xxhash64(both, F.lit(11)).alias("k1"), F.xxhash64(F.lit(29), both).alias("k2"))


def keep_keyed(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The columns of `row` of those rows (from `keyed`) whose keys are in kept, one of each. Rows that
    repeat become one in each task before the shuffle, so that a document which is there a million
    times reaches the join as a row a task at most; the join needs no further shuffle."""
    return rows.select("row", "k1", "k2").dropDuplicates(["k1", "k2"]).join(kept.hint("merge"), ["k1", "k2"], "left_semi").select("row.*")
