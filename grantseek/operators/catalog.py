"""Collections, documents, users and their housekeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantseek.functions.text import like_filter, strip

# Index state, its run word and the document status it leads to.
RUN_WORD = {"pending": "UNSTART", "parsing": "RUNNING", "done": "DONE", "failed": "FAIL"}
STATUS = {"UNSTART": "parsing", "RUNNING": "parsing", "DONE": "ready", "FAIL": "failed"}


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> tuple[DataFrame, int]:
    """Rows of one page (from 1) and the total. The order should end in a unique column."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size), df.count()


def list_kbs(
    readable: DataFrame, uploadable: DataFrame, users: DataFrame, kbs: DataFrame, keyword: str | None = None,
    include_inactive: bool = False,
) -> DataFrame:
    """Collections each user sees, with flags; admins see all. Managing means admin or may upload."""
    shown = kbs if include_inactive else kbs.where("is_active")
    if keyword:
        shown = shown.where(like_filter(F.col("name"), keyword))
    can_read = readable.select("user_id", "kb_id", F.lit(True).alias("can_read"))
    can_upload = uploadable.select("user_id", "kb_id", F.lit(True).alias("can_upload"))
    admin = users.where("role = 'admin'").select("user_id", "role")
    every = admin.join(shown.select("kb_id", F.lit("admin").alias("role")), "role").select(
        "user_id", "kb_id", F.lit(True).alias("is_admin"))
    granted = can_read.join(admin, "user_id", "left_anti").select("user_id", "kb_id", F.lit(False).alias("is_admin"))
    rows = every.unionByName(granted).join(shown, "kb_id")
    rows = rows.join(can_read, ["user_id", "kb_id"], "left").join(can_upload, ["user_id", "kb_id"], "left")
    no = F.lit(False)
    return rows.select("user_id", "kb_id", "name", "is_active", F.coalesce("can_read", no).alias("can_read"),
                       F.coalesce("can_upload", no).alias("can_upload"),
                       (F.col("is_admin") | F.coalesce("can_upload", no)).alias("can_manage"))


def list_documents(
    documents: DataFrame, kb_id: int | None = None, keyword: str | None = None, status: str | None = None,
    visibility: str | None = None, category: str | None = None, folder_id: int | None = None,
) -> DataFrame:
    """Documents meeting every given condition; folder 0 is the root."""
    rows = documents
    if keyword:
        rows = rows.where(like_filter(F.col("name"), keyword))
    for name, value in (("kb_id", kb_id), ("status", status), ("visibility", visibility), ("category", category)):
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    if folder_id is not None:
        rows = rows.where(F.col("folder_id").isNull() if folder_id == 0 else F.col("folder_id") == folder_id)
    return rows


def list_chunks(chunks: DataFrame, document_id: str, keyword: str | None = None, limit: int = 200) -> DataFrame:
    """First ``limit`` chunks of a document; the keyword then filters those, case-sensitively."""
    rows = chunks.where(F.col("document_id") == document_id).orderBy("ordinal").limit(limit)
    if keyword:
        rows = rows.where(F.col("content").contains(keyword))
    return rows.select("chunk_id", "document_id", "content", F.col("ordinal").alias("index"),
                       F.col("tokens").alias("token_count"))


def list_index_chunks(chunks: DataFrame, document_id: str, keyword: str | None = None) -> DataFrame:
    """All chunks of a document, the keyword matched case-blind; page them with ``page``."""
    rows = chunks.where(F.col("document_id") == document_id)
    return rows.where(like_filter(F.col("content"), keyword)) if keyword else rows


def kb_counters(kbs: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and chunks per collection, failed documents left out."""
    live = documents.where("status <> 'failed'").groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("chunk_count").alias("chunk_count"))
    zero = F.lit(0)
    return kbs.select("kb_id").join(live, "kb_id", "left").select(
        "kb_id", F.coalesce("doc_count", zero).alias("doc_count"), F.coalesce("chunk_count", zero).alias("chunk_count"))


def sync_status(documents: DataFrame, index_documents: DataFrame) -> DataFrame:
    """Copy state, progress and counts of the index into the catalogue."""
    run = lookup(RUN_WORD, F.col("state"))
    info = index_documents.select(
        "document_id", run.alias("_run"), F.coalesce("progress", F.lit(0.0)).alias("_progress"),
        F.coalesce("chunk_count", F.lit(0)).alias("_chunks"), F.coalesce("token_count", F.lit(0)).alias("_tokens"),
        F.when(F.length("message") > 0, F.col("message")).alias("_message"), F.lit(True).alias("_found"))
    found = F.coalesce("_found", F.lit(False))
    message = (F.when(F.col("_run") == "DONE", F.lit(None).cast("string"))
               .when(F.col("_run") == "FAIL", F.coalesce("_message", F.lit("parse failed")))
               .otherwise(F.col("error_message")))
    return documents.join(info, "document_id", "left").withColumns({
        "status": F.when(found, F.coalesce(lookup(STATUS, F.col("_run")), "status")).otherwise(F.col("status")),
        "error_message": F.when(found, message).otherwise(F.col("error_message")),
        "progress": F.when(found, F.col("_progress")).otherwise(F.col("progress")),
        "chunk_count": F.when(found, F.col("_chunks")).otherwise(F.col("chunk_count")),
        "token_count": F.when(found, F.col("_tokens")).otherwise(F.col("token_count")),
    }).drop("_run", "_progress", "_chunks", "_tokens", "_message", "_found")


def pending_documents(index_documents: DataFrame) -> DataFrame:
    """Documents whose parsing is not finished, oldest first."""
    return index_documents.where(F.col("state").isin("pending", "parsing")).orderBy("updated_at", "document_id")


def queue_status(index_documents: DataFrame) -> DataFrame:
    """One row: queued, running, done, failed and the newest error."""
    state = lambda s: F.count_if(F.col("state") == s)
    failed = F.when(F.col("state") == "failed", F.struct("updated_at", "document_id"))
    return index_documents.agg(
        state("pending").alias("queued"), state("parsing").alias("running"), state("done").alias("done"),
        state("failed").alias("failed"), F.max_by("message", failed).alias("last_error"))


def index_stats(index_documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks per dataset; the row without a dataset is the whole index."""
    docs = index_documents.rollup("dataset_id").agg(F.count(F.lit(1)).alias("documents"), F.grouping_id().alias("_g"))
    parts = chunks.rollup("dataset_id").agg(F.count(F.lit(1)).alias("chunks"), F.grouping_id().alias("_g"))
    same = docs["dataset_id"].eqNullSafe(parts["dataset_id"]) & (docs["_g"] == parts["_g"])
    return docs.join(parts, same, "full").select(
        F.coalesce(docs["dataset_id"], parts["dataset_id"]).alias("dataset_id"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def system_overview(users: DataFrame, kbs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of totals. Each table is counted once; the counts meet in one sum."""
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")

    def part(df: DataFrame, column: str, value: Column) -> DataFrame:
        names = ["users", "kbs", "documents", "chunks"]
        return df.select(*[(value if n == column else zero).alias(n) for n in names])
    docs = documents.select(zero.alias("users"), zero.alias("kbs"), one.alias("documents"),
                            F.coalesce(F.col("chunk_count").cast("bigint"), zero).alias("chunks"))
    rows = part(users, "users", one).unionByName(part(kbs, "kbs", one)).unionByName(docs)
    return rows.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in ("users", "kbs", "documents", "chunks")])


PATCH_FIELDS = ("name", "category", "visibility", "tags", "original_url", "remark")


def update_documents(documents: DataFrame, patch: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overwrite the non-null fields of a patch (document_id, kb_id, ...): (documents, rejected).

    ``folder_id`` in a patch row is applied where ``set_folder`` is true: 0 or
    null is the root, a folder of another collection rejects the whole row.
    """
    fields = [c for c in PATCH_FIELDS if c in patch.columns and c in documents.columns]
    moves = "folder_id" in patch.columns
    rejected = patch.limit(0)
    good = patch
    if moves:
        wants = F.col("set_folder") & F.col("folder_id").isNotNull() & (F.col("folder_id") != 0)
        known = folders.select("folder_id", "kb_id")
        rejected = patch.where(wants).join(known, ["folder_id", "kb_id"], "left_anti").select(patch.columns)
        good = patch.where(~F.coalesce(wants, F.lit(False))).unionByName(
            patch.where(wants).join(known, ["folder_id", "kb_id"], "left_semi").select(patch.columns))
    renamed = good.select("document_id", "kb_id", *[F.col(c).alias(f"_{c}") for c in fields],
                          *([F.expr("nullif(folder_id, 0)").alias("_folder"), F.col("set_folder").alias("_move")] if moves else []))
    out = documents.join(renamed, ["document_id", "kb_id"], "left").withColumns(
        {c: F.coalesce(f"_{c}", c) for c in fields})
    if moves:
        out = out.withColumn("folder_id", F.when(F.col("_move"), F.col("_folder")).otherwise(F.col("folder_id")))
    return out.select(documents.columns), rejected


def resolve_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """All tags after the given names were asked for: existing rows and new ones once, without id."""
    asked = names.select(strip(F.col("name")).alias("name")).where("name <> ''").distinct()
    return tags.unionByName(asked.join(tags, "name", "left_anti"), allowMissingColumns=True)


def list_users(
    users: DataFrame, keyword: str | None = None, role: str | None = None, active: bool | None = None,
) -> DataFrame:
    rows = users
    if keyword:
        rows = rows.where(like_filter(F.col("username"), keyword))
    if role is not None:
        rows = rows.where(F.col("role") == role)
    if active is not None:
        rows = rows.where(F.col("is_active") == active)
    return rows


def list_tags(users: DataFrame) -> DataFrame:
    return users.select(F.explode("tags").alias("name")).distinct().orderBy("name")


def last_admin_check(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Per proposed change (user_id, new_role, new_active): active admins that would remain.

    The total is one number; each change only asks whether its own user counted.
    """
    is_admin = (F.col("role") == "admin") & F.col("is_active")
    total = users.where(is_admin).count()
    asked = changes.join(users.select("user_id", is_admin.alias("_before")), "user_id")
    after = (F.col("new_role") == "admin") & F.col("new_active")
    left = F.lit(total) - F.col("_before").cast("int") + after.cast("int")
    return asked.select("user_id", "new_role", "new_active", left.cast("bigint").alias("admins_left"),
                        (left > 0).alias("allowed"))


def cascade_delete_kbs(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Tables with kb_id after their collections are deleted."""
    gone = ids.select("kb_id").distinct()
    return {name: df.join(gone, "kb_id", "left_anti") for name, df in tables.items()}


def cascade_delete_users(
    ids: DataFrame, *, owned: dict[str, DataFrame], authored: dict[str, tuple[DataFrame, str]],
) -> dict[str, DataFrame]:
    """Rows a deleted user owns go; columns naming them as author become null."""
    gone = ids.select("user_id").distinct()
    out = {name: df.join(gone, "user_id", "left_anti") for name, df in owned.items()}
    for name, (df, column) in authored.items():
        left = gone.select(F.col("user_id").alias(column), F.lit(True).alias("_gone"))
        out[name] = df.join(left, column, "left").withColumn(
            column, F.when(F.col("_gone").isNull(), F.col(column))).select(df.columns)
    return out


def bulk_register(files: DataFrame, kb_id: int, tags: str = "", url_prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Document rows for scanned files, and the number of successes and failures.

    ``files`` comes from ``file_identity`` after ``validate_files``.
    """
    tag_list = [t.strip() for t in tags.split(",") if t.strip()]
    stem = F.regexp_replace(F.col("name"), r"\.[^.]*$", "")
    url = F.concat(F.lit(url_prefix.rstrip("/") + "/"), stem) if url_prefix else F.lit(None).cast("string")
    ok = F.col("reject_reason").isNull()
    rows = files.where(ok).select(
        F.sha2(F.concat_ws("|", F.lit(str(kb_id)), "path"), 256).substr(1, 32).alias("document_id"),
        F.lit(kb_id).cast("bigint").alias("kb_id"), F.lit(None).cast("bigint").alias("folder_id"), "name",
        F.lit("public").alias("visibility"), F.lit("pending").alias("status"),
        F.array(*[F.lit(t) for t in tag_list]).cast("array<string>").alias("tags"), url.alias("original_url"),
        F.col("path").alias("source_path"), "ext", "mime", F.col("size").alias("size_bytes"), "checksum")
    counts = files.groupBy(ok.alias("success")).agg(F.count(F.lit(1)).alias("files"))
    return rows, counts
