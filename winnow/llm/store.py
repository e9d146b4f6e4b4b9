"""Where intermediate tables live: the folder that the driver and all executors share; and joins that stand hot keys.

The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset, only a local master may use a folder of
this process; on a cluster that would lose rows, so it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-winnow-")
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/winnow/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/winnow/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def narrow_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold about 4 MB at most, unless a limit is set already: a task has several copies of a batch at a time, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(4 << 20))


def is_small(df: DataFrame, most: int = 32 << 20) -> bool:
    """Whether a saved table holds at most ``most`` bytes."""
    sizes = [F.lit(8) if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) + 16 for f in df.schema]
    return df.agg(F.coalesce(F.sum(sum(sizes, F.lit(16)).cast("long")), F.lit(0))).first()[0] <= most


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A broadcast hint for a saved table of at most ``most`` bytes; a larger one is left to a shuffled join."""
    return F.broadcast(df) if is_small(df, most) else df


def hot_keys(df: DataFrame, key: str, most: int = 1000) -> list:
    """The keys that hold more than one in ``most`` rows each; so there are fewer than ``most``."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    total = df.count()
    return [r[0] for r in counts.where(F.col("rows") * most > max(total, 100 * most)).select(key).collect()]


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows, left-joined with table (one row for each key, of numbers). Hot keys, few by definition, are broadcast; null keys meet nothing and are not shuffled."""
    hot = hot_keys(rows, key)
    if not hot and rows.where(F.col(key).isNull()).isEmpty():
        return rows.join(table, key, "left")
    at_once = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    some = table.where(F.col(key).isin(hot)) if hot else table.where(F.lit(False))
    return rows.where(~at_once).join(table, key, "left").unionByName(rows.where(at_once).join(F.broadcast(some), key, "left"))


def matching(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that table (one narrow row for each key) has the key of, with its other columns as struct ``met``. The first key is a long.

    Hot keys, fewer than a thousand, meet their rows by broadcast, and these rows are dealt at random in the shuffled join of the others.
    """
    value = F.struct(F.lit(True).alias("hit"), *[c for c in table.columns if c not in keys])
    name = F.xxhash64(*keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("held")).where(F.col("held") > 1000)
    total = rows.count()
    hot = [r[0] for r in counts.where(F.col("held") * 1000 > total).select(name).collect()]
    if not hot:
        return rows.join(table.select(*keys, value.alias("met")), keys)
    large = F.broadcast(table.where(name.isin(hot)).select(*keys, value.alias("large")))
    other = table.where(~name.isin(hot)).select(F.col(keys[0]).alias("spread"), *keys[1:], value.alias("other"))
    out = rows.join(large, keys, "left").withColumn("spread", F.when(name.isin(hot), F.xxhash64(*rows.columns)).otherwise(F.col(keys[0])))
    out = out.join(other, ["spread", *keys[1:]], "left").withColumn("met", F.when(name.isin(hot), F.col("large")).otherwise(F.col("other")))
    return out.where("met IS NOT NULL").select(*rows.columns, "met")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever their names, take no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
