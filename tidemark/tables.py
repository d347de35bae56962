"""Written tables between the steps of an operator."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset, in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        found = _own["dir"]
    return found.rstrip("/")


def _steady() -> None:
    """On the driver, which lives long: blocks of 256 KiB and more are mapped and so go back to the system when freed."""
    if not _own.get("steady"):
        _own["steady"] = "yes"
        if hasattr(libc := ctypes.CDLL(None), "mallopt"):
            libc.mallopt(-3, 1 << 18)


#: Seconds between two calls of ``trim`` from ``stage``.
TRIM_EVERY = 10.0
_trimmed = [0.0]


def trim(spark: SparkSession) -> None:
    """Let the driver's JVM give freed native memory back to the system, where it can (HotSpot on glibc). Its compilers
    allocate and free much of it for the plans of a long session, and the allocator keeps that otherwise."""
    _trimmed[0] = time.monotonic()
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    of = jvm.java.lang.Class.forName

    def call(method: str, kinds: list[str], values: list[object]) -> object:
        """Through the public interface, as the server's own class is not open to reflection."""
        types, args = new(jvm.java.lang.Class, len(kinds)), new(jvm.java.lang.Object, len(kinds))
        for i, (kind, value) in enumerate(zip(kinds, values)):
            types[i], args[i] = of(kind), value
        return of("javax.management.MBeanServer").getMethod(method, types).invoke(server, args)

    one = ["javax.management.ObjectName"]
    if call("isRegistered", one, [name]) and any(x.getName() == "systemTrimNativeHeap" for x in call("getMBeanInfo", one, [name]).getOperations()):
        call("invoke", [*one, "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"], [name, "systemTrimNativeHeap", None, None])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, for every executor."""
    _steady()
    spark = df.sparkSession
    if time.monotonic() - _trimmed[0] > TRIM_EVERY:
        trim(spark)
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()  # every plan that reads the table holds this very object
    _tables.setdefault(spark.sparkContext.applicationId, []).append((path, spark._jvm.java.lang.ref.WeakReference(index)))
    return out


#: By application: written tables, and weak references by which the JVM tells whether a plan still reads them.
_tables: dict[str, list[tuple[str, object]]] = {}


def sweep(spark: SparkSession) -> None:
    """Delete the written tables that no plan reads any more. An RDD of a DataFrame does not count as its plan: keep the
    DataFrame as long as its RDD is used."""
    jvm, kept = spark.sparkContext._jvm, []
    own = spark.sparkContext.applicationId
    for path, plan in _tables.get(own, []):
        if plan.refersTo(None):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        else:
            kept.append((path, plan))
    _tables[own] = kept


#: Bits of a filter of ids (4 MiB), whatever the number of ids.
FILTER_BITS = 1 << 25


def maybe_in(ids: DataFrame, column: str) -> Callable[[DataFrame, str, str], DataFrame]:
    """A filter of ids[column], of a fixed size: (df, col, name) gives df with a boolean column ``name``, true where
    df[col] is in ids and for few other values as long as there are fewer ids than ``FILTER_BITS``. The filter is
    broadcast as at most FILTER_BITS / 32768 rows of 4 KiB and tested natively; joins behind it stay exact."""
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FILTER_BITS)) + 1
    places = ids.select(slot(column).alias("s"))
    bits = stage(places.groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits")), "filter")

    def mark(df: DataFrame, col: str, name: str) -> DataFrame:
        at = F.bitmap_bit_position(slot(col))
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
        joined = df.join(F.broadcast(bits), F.bitmap_bucket_number(slot(col)) == F.col("_bucket"), "left")
        return joined.select(*[df[c] for c in df.columns], F.when(df[col].isNull(), F.lit(False)).otherwise(hit).alias(name))

    return mark


def near(df: DataFrame, column: str, ids: DataFrame, of: str) -> DataFrame:
    """The rows of df whose column, of any type, is in ids[of], and few others (see ``maybe_in``): what a join with ids needs."""
    marked = maybe_in(ids.select(F.xxhash64(of).alias("_id")), "_id")(df.withColumn("_id", F.xxhash64(column)), "_id", "_near")
    return marked.where("_near").drop("_id", "_near")
