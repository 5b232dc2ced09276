"""What the operators of this subpackage share: the shared folder, word splitting on Arrow columns, and the split of labels."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that a Python worker holds at a time, in bytes. A longer single text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20
#: A table of at most so many bytes, as Spark estimates it, is a single input split.
SPLIT_BYTES = 16 << 20


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well as by rows: documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if it is less than one input split, which would be one task; larger tables stay where they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPLIT_BYTES else df


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the cluster shares; a temporary one only where that is unset and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that they share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="lintel-shared-")
        _own[app] = base
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below this application's own in the shared one."""
    return f"{shared_dir(spark)}/lintel-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._lintel_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a materialized df, once nothing that will still run reads it; other frames are left alone."""
    if path := getattr(df, "_lintel_path", None):
        _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder, once its results are stored elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/lintel-{spark.sparkContext.applicationId}")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add, whatever their case: a clashing input column is replaced."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def map_rows(df: DataFrame, needs: list[str], fn, added: list[tuple[str, T.DataType]], keep: bool | list[str] = True) -> DataFrame:
    """Run fn over slices of df's rows in Python workers.

    fn maps a dict of the needed Arrow columns to a dict of the added columns (Arrow or numpy, a value per row) and may
    return "_keep", a mask of the rows that stay. The other columns (with `keep`: those, or none) pass through untouched; a column of an added name is
    replaced.
    """
    left = without(df, *[n for n, _ in added])
    passed = [f for f in left.schema.fields if keep is True or keep and f.name in keep]
    schema = T.StructType([*passed, *[T.StructField(n, t) for n, t in added]])
    # Plain names on the way in: those of input columns may hold dots. A column that is needed and passes through goes once.
    places = {f.name: f"p{i}" for i, f in enumerate(passed)}
    names = {n: places.get(n, f"n{i}") for i, n in enumerate(needs)}
    columns = {f"p{i}": f.name for i, f in enumerate(passed)} | {p: n for n, p in names.items()}
    src = df.select(*[F.col(f"`{n}`").alias(p) for p, n in columns.items()])
    arrow = pa.schema([(n, _arrow(t)) for n, t in added])

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, names[needs[-1]]):
                out = fn({n: part.column(p) for n, p in names.items()})
                mask = out.pop("_keep", None)
                cols = [part.column(f"p{i}") for i in range(len(passed))]
                for f in arrow:
                    v = out[f.name]
                    v = v if isinstance(v, pa.Array) else pa.array(v, type=f.type)
                    cols.append(v if v.type == f.type else v.cast(f.type))
                res = pa.RecordBatch.from_arrays(cols, names=[*[f.name for f in passed], *arrow.names])
                yield res if mask is None else res.filter(pa.array(mask))
        release()

    return src.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def byte_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Cut a batch so that each part holds at most `most` bytes of the column, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: (offsets, of length rows + 1; a code per word; the distinct words).

    Null and empty texts have none.
    """
    n = len(texts)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        ends = np.concatenate([[0], np.cumsum(full)])[ends - ends[0]].astype(np.int64)
        flat = flat.filter(pa.array(full))
    else:
        ends = ends - ends[0]
    coded = flat.dictionary_encode()
    return ends, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 5, is 0. A null id counts as held out: nothing is learnt from it."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int):
    """At most per_class labelled documents of each class, of at most max_chars characters, as (texts, 0/1 array).

    The bound is 2 * per_class rows and 2 * per_class * max_chars characters at any size of the corpus. Rows are taken by a hash of their id
    from those that have a usable text here and aren't held out, so a filtered table or a shard gives as many as it holds. The chosen ids are
    broadcast: their number has that bound. Of repeated ids one text counts, the least, and of several labels 1.
    """
    import warnings

    spark = documents.sparkSession
    short = documents.select("doc_id", "text").filter((F.length("text") <= max_chars) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    lab = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    usable = materialize(lab.join(short.select("doc_id"), "doc_id", "left_semi"), "labelled")
    picks = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect() for y in (0, 1)]
    discard(usable)
    for y, found in enumerate(picks):
        if not found:
            warnings.warn(f"no usable document of label {label} = {y}: the model is a constant", stacklevel=2)
    ids = {r[0]: r[1] for p in picks for r in p}
    if not ids:
        return [], np.zeros(0, np.int64)
    chosen = F.broadcast(spark.createDataFrame(list(ids.items()), "doc_id long, y int"))
    one = short.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    seen = {r[0]: (r[1], r[2]) for r in one.select("doc_id", "text", "y").collect()}
    rows = [seen[k] for k in sorted(seen)]
    return [t for t, _ in rows], np.array([y for _, y in rows], np.int64)
