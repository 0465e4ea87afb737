"""What the operators of this folder share: scratch tables, size-checked joins, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path

#: Rows of a one-column id table that may be broadcast (about 50 MB as a hashed relation).
BROADCAST_IDS = 1_000_000


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage.

    Columns whose type Parquet cannot hold are not expected.  The files go when the
    JVM ends, or earlier through :func:`release`.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._bidlens_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_bidlens_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join on a one-column id table: broadcast when counted small, shuffled otherwise.

    ``ids`` is counted, so hand in a materialised table.
    """
    side = F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids
    return rows.join(side, key, how)


def join_sized(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int, parts: int = 5_000) -> DataFrame:
    """rows joined to keyed, one row a key, whose column ``size`` counts the rows of the key out of ``total``.

    Keys that hold at least one in ``parts`` of all rows are at most ``parts`` many: these are broadcast, so that no
    task gets all rows of such a key.  The others meet in a shuffle.  ``keyed`` is read twice: hand in a table.
    """
    bound = max(1, total // parts)
    hot, cold = F.broadcast(keyed.where(F.col(size) >= bound)), keyed.where(F.col(size) < bound)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def unused(df: DataFrame, *names: str) -> list[str]:
    """A name of its own for each of names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Alternate large-star and small-star steps until the edges form stars.

    edges: (src, dst) longs, any direction, nulls absent.  Returns (node, root) with
    root the smallest node of the component; nodes that are their own root are left out.
    Every step is a min-aggregate with map-side combine and an equi-join, so a node
    with very many neighbours never meets in one task as a list.
    """
    e = materialize(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), tag
    )
    before = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or mark["n"] == 0:
            break
        before = mark
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
        low2 = large.groupBy("src").agg(F.min("dst").alias("m"))
        met = large.join(low2, "src")
        small = met.select("src", F.col("m").alias("dst")).unionByName(met.select(F.col("dst").alias("src"), F.col("m").alias("dst")))
        new = materialize(small.where("src <> dst").distinct(), tag)
        release(e)
        e = new
    return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a task's Python objects stay few whatever the session's batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


#: Rows of an Arrow batch: texts are long, and a worker that many stages share keeps the memory of its largest batch.
BATCH_ROWS = 1_000


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text), handed to Python workers in small batches."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
