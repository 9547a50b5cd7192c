"""The chunk index: scans, whole-document replacement, deletes and status rows.

Layout: Parquet partitioned by dataset and a hash bucket of the document, so
that a change rewrites only the buckets of the documents it names, also in a
dataset that holds a third of the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from grantseek.common import cut_lineage

DOC_BUCKETS = 64
DOCUMENT = ["dataset_id", "document_id"]


def with_bucket(chunks: DataFrame, buckets: int = DOC_BUCKETS) -> DataFrame:
    return chunks.withColumn("doc_bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))


def write_index(chunks: DataFrame, path: str, buckets: int = DOC_BUCKETS) -> None:
    """Write an index from scratch. Rows of a partition meet in one file, sorted by document."""
    rows = with_bucket(chunks, buckets)
    (rows.repartition("dataset_id", "doc_bucket").sortWithinPartitions("dataset_id", "doc_bucket", "document_id", "ordinal")
     .write.mode("overwrite").partitionBy("dataset_id", "doc_bucket").parquet(path))


def save_bucketed(df: DataFrame, table: str, path: str | None = None, buckets: int = 64, by: str = "document_id") -> None:
    """Save chunks or postings as a table bucketed by document.

    Keyword sums and joins with documents then need no shuffle of the index.
    """
    writer = df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(by)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index. Folder names are read as text: a dataset may be called ``007``, ``1e5`` or ``2024-01-01``."""
    found = spark.read.parquet(path).schema
    kinds = {"dataset_id": StringType(), "doc_bucket": IntegerType()}
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType), f.nullable) for f in found])
    return spark.read.schema(schema).parquet(path)


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether a bucket has been written below ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dataset_id=*/doc_bucket=*")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return found is not None and len(found) > 0


def scan_index(
    index: DataFrame, dataset_ids: Sequence[str] | None = None, documents: DataFrame | None = None,
) -> DataFrame:
    """Chunks of some datasets (a partition filter) and documents (a semi-join)."""
    rows = index if dataset_ids is None else index.where(F.col("dataset_id").isin(*dataset_ids))
    if documents is not None:
        rows = rows.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return rows


def replace_document_chunks(index: DataFrame, new: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The index after whole documents are replaced; old chunks never mix with new ones.

    ``documents`` names replaced documents that may have no new chunk at all. A document is known by dataset and id; to move
    one to another dataset, name it in the old one as well.
    """
    touched = (new if documents is None else documents).select(*DOCUMENT).distinct()
    return index.join(touched, DOCUMENT, "left_anti").select(index.columns).unionByName(
        new, allowMissingColumns=True)


def _buckets_of(df: DataFrame) -> DataFrame:
    return df.select("dataset_id", "doc_bucket").distinct()


def replace_on_disk(
    spark: SparkSession, path: str, new: DataFrame, documents: DataFrame, buckets: int = DOC_BUCKETS,
) -> None:
    """Replace documents (dataset_id, document_id) in the stored index.

    Only the buckets of these documents are read and rewritten, by dynamic
    partition overwrite, from rows that were written to the checkpoint folder
    first. A repeated call gives the same index.
    """
    touched = with_bucket(documents.select("dataset_id", "document_id").distinct(), buckets)
    fresh = with_bucket(new, buckets)
    if not index_exists(spark, path):  # the first batch
        write_index(new, path, buckets)
        return
    old = read_index(spark, path)
    affected = old.join(_buckets_of(touched), ["dataset_id", "doc_bucket"], "left_semi").select(old.columns)
    left = affected.join(touched.select(*DOCUMENT).distinct(), DOCUMENT, "left_anti").select(old.columns)
    rows = cut_lineage(left.unionByName(fresh, allowMissingColumns=True))
    emptied = cut_lineage(_buckets_of(affected).join(_buckets_of(rows), ["dataset_id", "doc_bucket"], "left_anti"))
    (rows.repartition("dataset_id", "doc_bucket").sortWithinPartitions("dataset_id", "doc_bucket", "document_id", "ordinal")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset_id", "doc_bucket").parquet(path))
    drop_buckets(spark, path, emptied)


def drop_buckets(spark: SparkSession, path: str, emptied: DataFrame) -> None:
    """Remove the folders of buckets that hold no row any more (names only reach the driver)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in emptied.toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/dataset_id={row['dataset_id']}/doc_bucket={row['doc_bucket']}")
        folder.getFileSystem(conf).delete(folder, True)


def delete_documents(ids: DataFrame, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (chunks, postings, status ...) without the documents, and removed chunks per document."""
    gone = ids.select("document_id").distinct()
    left = {name: df.join(gone, "document_id", "left_anti") for name, df in tables.items()}
    return left, removed_counts(tables["chunks"], gone, "document_id")


def delete_datasets(ids: DataFrame, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The same by dataset."""
    gone = ids.select("dataset_id").distinct()
    left = {name: df.join(gone, "dataset_id", "left_anti") for name, df in tables.items()}
    return left, removed_counts(tables["chunks"], gone, "dataset_id")


def removed_counts(chunks: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return chunks.join(gone, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("removed"))


def upsert_document_status(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert status rows or replace name, state, message and time; a missing path or extension keeps the old."""
    fields = ["dataset_id", "name", "state", "message", "source_path", "ext", "updated_at"]
    fresh = updates.select("document_id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    both = current.join(fresh, "document_id", "full")
    new = F.coalesce("_new", F.lit(False))
    out = {c: F.when(new, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("name", "state", "message", "updated_at")}
    out |= {c: F.coalesce(f"_{c}", c) for c in ("source_path", "ext")}
    out["dataset_id"] = F.coalesce("dataset_id", "_dataset_id")
    out |= {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in
            (("progress", "double"), ("chunk_count", "bigint"), ("token_count", "bigint"), ("char_count", "bigint"))
            if c in current.columns}
    return both.withColumns(out).select(current.columns)


def set_document_state(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Update state by document_id; null counts keep the old value, the message is always replaced."""
    kept = ["chunk_count", "token_count", "char_count", "progress"]
    given = set(updates.columns)
    fresh = updates.select(
        "document_id", F.col("state").alias("_state"),
        (F.col("message") if "message" in given else F.lit(None).cast("string")).alias("_message"),
        F.col("updated_at").alias("_updated_at"), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_{c}") for c in kept if c in given])
    both = current.join(fresh, "document_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("state", "message", "updated_at")}
    out |= {c: F.coalesce(f"_{c}", c) for c in kept if c in given}
    return both.withColumns(out).select(current.columns)
