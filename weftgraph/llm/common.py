"""What the operators share: Arrow batches, broadcasts of checked size, cut lineage."""

from __future__ import annotations

import ctypes
import gc
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import cut, forget, stored  # noqa: F401  the operators take them from here

#: Rows and bytes of one Arrow batch: a bound on what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns cannot clash with results."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(name: str, *used: list[str]) -> str:
    """The name, with as many underscores more as it takes to differ from the columns in use."""
    taken = {c.lower() for columns in used for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, close: Callable[[], None] | None = None) -> DataFrame:
    """One call of fn for each Arrow batch; fn must not keep state that results depend on.

    close is called when a task ends, to free what fn has kept for it.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if resident_mb() > 300:  # what an earlier task left behind may hold itself in cycles
            gc.collect()
            give_back()
        try:
            for batch in batches:
                out = fn(batch)
                if out is not None:
                    yield out
        finally:
            if close is not None:
                close()
            give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds on Arrow batches, by rows and by bytes; never raise them.

    Spark reads them from the session when it plans, so they hold for it from then on.
    """
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
        now = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)
        if not 0 < now <= bound:
            spark.conf.set(key, str(bound))


def resident_mb() -> float:
    """Memory of this process, or 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6
    except (OSError, ValueError, IndexError):
        return 0.0


def give_back() -> None:
    """Return free memory to the system: Python workers live on and serve later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without a pass through str."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def checked_broadcast(spark: SparkSession, value, n_bytes: int, limit: int = 64 << 20):
    """Broadcast a value whose size has been measured; refuse it beyond the limit."""
    if n_bytes > limit:
        raise ValueError(f"{n_bytes} bytes exceed the broadcast limit of {limit}")
    return spark.sparkContext.broadcast(value)


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """A small table made local and marked for broadcast; refused beyond the limit."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows to broadcast")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files and checkpoints that nothing refers to any more.

    It works when the driver collects its garbage, which a long job may put off
    until the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(column, modulus: int, remainder: int):
    """crc32 of the id as text, modulo: the fold of a document."""
    return (F.crc32(column.cast("string")) % modulus) == remainder


def crc_fold(doc_id: int | None, modulus: int) -> int:
    """The same fold in plain Python (null ids: -1)."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


#: Slots of 512 words of 64 bits in the filter of hash_filter(): 4 MB whatever the input.
SLOTS = 1024


def hash_filter(values: DataFrame) -> DataFrame:
    """A table of at most SLOTS rows that holds a bit for each 64-bit hash in values.h.

    Its size does not grow with the values; with more of them more bits are set.
    It is built with map-side combining.
    """
    h = F.col("h")
    slot = F.pmod(F.shiftright(h, 15), F.lit(SLOTS)).cast("int").alias("__slot")
    word, bit = F.expr("CAST(shiftright(h, 6) & 511L AS INT)").alias("w"), F.expr("shiftleft(1L, CAST(h & 63L AS INT))").alias("b")
    words = values.where(h.isNotNull()).select(slot, word, bit).groupBy("__slot", "w").agg(F.bit_or("b").alias("b"))
    full = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long")))
    return cut(words.groupBy("__slot").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m")).select("__slot", full.alias("__words")))


def maybe_in(rows: DataFrame, hash_col: str, table: DataFrame, flag: str) -> DataFrame:
    """rows with a flag that is true wherever the hash is in the hash_filter() table.

    It may flag others too, never misses one, and spares shuffles; an exact join
    or grouping has to follow. The table is broadcast, its size is fixed.
    """
    slot, words = fresh("__slot", rows.columns), fresh("__words", rows.columns)
    c, h = F.col(f"`{hash_col}`"), f"`{hash_col}`"
    found = F.expr(f"shiftrightunsigned(get({words}, CAST(shiftright({h}, 6) & 511L AS INT)), CAST({h} & 63L AS INT)) & 1L")
    joined = rows.join(F.broadcast(table.toDF(slot, words)), F.pmod(F.shiftright(c, 15), F.lit(SLOTS)).cast("int") == F.col(slot), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(found == 1, F.lit(False)).alias(flag))


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in gone (one column); null ids compare as equal.

    Only rows that may be in gone meet it in a shuffled join; the rest stay where
    they are. All columns and repeated rows are kept.
    """
    id_hash, gone_id, maybe = (fresh(n, docs.columns) for n in ("__id_hash", "__gone_id", "__maybe"))
    ids = gone.select(F.col(f"`{gone.columns[0]}`").alias(gone_id)).distinct()
    hashed = docs.withColumn(id_hash, F.xxhash64(F.col(f"`{id_col}`")))
    marked = maybe_in(hashed, id_hash, hash_filter(ids.select(F.xxhash64(gone_id).alias("h"))), maybe)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = marked.where(F.col(maybe)).join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)), "left_anti")
    return marked.where(~F.col(maybe)).select(*columns).unionByName(left.select(*columns))
