"""Folder trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.common import cut_lineage


def ancestor_closure(folders: DataFrame) -> DataFrame:
    """(folder_id, ancestor_id, distance): self, parent, grandparent and so on.

    Every round doubles the distance covered, so a tree of depth d takes log2(d)
    joins, each written out. Only least distances are kept: a cycle ends at the
    first folder met twice. A missing parent row ends the chain.
    """
    own = folders.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    parents = folders.where("parent_id <> folder_id").select("folder_id", F.col("parent_id").alias("ancestor_id"))
    known = folders.select(F.col("folder_id").alias("ancestor_id"))
    above = parents.join(known, "ancestor_id", "left_semi").select("folder_id", "ancestor_id", F.lit(1).alias("distance"))
    closure = cut_lineage(own.unionByName(above))
    reach = 1
    while not (far := closure.where(F.col("distance") == reach)).isEmpty():
        jumps = far.select("folder_id", F.col("ancestor_id").alias("_via"))
        beyond = closure.where("distance > 0").select(
            F.col("folder_id").alias("_via"), "ancestor_id", (F.col("distance") + reach).alias("distance"))
        further = jumps.join(beyond, "_via").select("folder_id", "ancestor_id", "distance")
        closure = cut_lineage(closure.unionByName(further).groupBy("folder_id", "ancestor_id").agg(
            F.min("distance").alias("distance")))
        reach *= 2
    return closure


def materialize_paths(folders: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Add ``path`` (ids from the root to the parent, between slashes) and ``depth``."""
    closure = ancestor_closure(folders) if closure is None else closure
    chain = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("distance", "ancestor_id")))),
                        lambda s: s["ancestor_id"].cast("string"))
    above = closure.where("distance > 0").groupBy("folder_id").agg(
        F.concat(F.lit("/"), F.array_join(chain, "/"), F.lit("/")).alias("path"),
        F.count(F.lit(1)).cast("int").alias("depth"))
    return folders.drop("path", "depth").join(above, "folder_id", "left").withColumns({
        "path": F.coalesce("path", F.lit("/")), "depth": F.coalesce("depth", F.lit(0))})


def subtree(closure: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_id, folder_id, distance) for the roots and everything below them.

    ``roots`` has root_id. An equi-join on the closure, not a path-prefix join.
    """
    return closure.join(roots.select(F.col("root_id").alias("ancestor_id")).distinct(), "ancestor_id").select(
        F.col("ancestor_id").alias("root_id"), "folder_id", "distance")


def folder_counts(folders: DataFrame, documents: DataFrame, acl: DataFrame) -> DataFrame:
    """Add the number of documents, child folders and rules of every folder."""
    docs = documents.where("folder_id IS NOT NULL").groupBy("kb_id", "folder_id").agg(
        F.count(F.lit(1)).alias("doc_count"))
    rules = acl.where("folder_id IS NOT NULL").groupBy("kb_id", "folder_id").agg(F.count(F.lit(1)).alias("acl_count"))
    children = folders.where("parent_id IS NOT NULL").groupBy("kb_id", F.col("parent_id").alias("folder_id")).agg(
        F.count(F.lit(1)).alias("child_count"))
    key = ["kb_id", "folder_id"]
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("doc_count", "child_count", "acl_count")}
    return folders.join(docs, key, "left").join(children, key, "left").join(rules, key, "left").withColumns(zero)


def root_document_counts(documents: DataFrame) -> DataFrame:
    """Documents per collection that lie in no folder."""
    return documents.groupBy("kb_id").agg(F.count_if(F.col("folder_id").isNull()).alias("root_doc_count"))


def folder_tree(
    folders: DataFrame, documents: DataFrame, acl: DataFrame, closure: DataFrame, access: DataFrame | None = None,
) -> DataFrame:
    """Tree rows with counts; with ``access`` (``open_folders``, or folder visibility), one pruned tree per scope.

    A folder shows only if it and every ancestor are visible. Counts include
    hidden folders. Order rows by depth, sort_order, folder_id to display them.
    Lists of scopes (``open_folders``) meet the counts as lists; folder visibility meets every ancestor.
    """
    counted = folder_counts(materialize_paths(folders, closure), documents, acl)
    if access is None:
        return counted
    if "scopes" in access.columns:
        return access.join(counted, "folder_id").withColumn("scope_id", F.explode("scopes")).drop("scopes")
    chain = closure.select("folder_id", F.col("ancestor_id"))
    shown = access.select("scope_id", F.col("folder_id").alias("ancestor_id"), "visible")
    whole = shown.join(chain, "ancestor_id").groupBy("scope_id", "folder_id").agg(F.min("visible").alias("shown"))
    return whole.where("shown").drop("shown").join(counted, "folder_id")


def move_folder(folders: DataFrame, moves: DataFrame, closure: DataFrame) -> DataFrame:
    """Apply moves (folder_id, new_parent_id) to folders with path and depth.

    Rejected without change: a move to itself, into its own subtree, or to a
    folder of another collection. All descendants get the new prefix and depth.
    One call moves folders whose subtrees are disjoint.
    """
    target = folders.select(F.col("folder_id").alias("new_parent_id"), F.col("kb_id").alias("_t_kb"),
                            F.col("path").alias("_t_path"), F.col("depth").alias("_t_depth"))
    asked = moves.join(folders.select("folder_id", "kb_id", "path", "depth"), "folder_id").join(
        target, "new_parent_id", "left")
    inside = closure.select(F.col("folder_id").alias("new_parent_id"), F.col("ancestor_id").alias("folder_id"))
    legal = asked.where("new_parent_id IS NULL OR _t_kb = kb_id").join(
        inside, ["new_parent_id", "folder_id"], "left_anti")
    plan = legal.select(
        F.col("folder_id").alias("moved_id"), "new_parent_id",
        F.concat(F.col("path"), F.col("folder_id").cast("string"), F.lit("/")).alias("_old"),
        F.coalesce(F.concat("_t_path", F.col("new_parent_id").cast("string"), F.lit("/")), F.lit("/")).alias("_parent_path"),
        (F.coalesce(F.col("_t_depth") + 1, F.lit(0)) - F.col("depth")).alias("_delta"))
    affected = subtree(closure, plan.select(F.col("moved_id").alias("root_id"))).select(
        F.col("root_id").alias("moved_id"), "folder_id").join(plan, "moved_id")
    new_prefix = F.concat("_parent_path", F.col("moved_id").cast("string"), F.lit("/"))
    is_self = F.col("folder_id") == F.col("moved_id")
    return folders.join(affected, "folder_id", "left").withColumns({
        "path": F.when(F.col("moved_id").isNull(), F.col("path")).when(is_self, F.col("_parent_path")).otherwise(
            F.concat(new_prefix, F.substr("path", F.char_length("_old") + 1))),
        "parent_id": F.when(is_self, F.col("new_parent_id")).otherwise(F.col("parent_id")),
        "depth": (F.col("depth") + F.coalesce("_delta", F.lit(0))).cast("int"),
    }).drop("moved_id", "new_parent_id", "_old", "_parent_path", "_delta")


def move_documents(documents: DataFrame, moves: DataFrame, folders: DataFrame) -> DataFrame:
    """Apply moves (document_id, kb_id, new_folder_id); null or 0 is the root.

    Rows naming another collection's document or folder change nothing.
    """
    asked = moves.withColumn("new_folder_id", F.expr("nullif(new_folder_id, 0)"))
    exists = folders.select(F.col("folder_id").alias("new_folder_id"), "kb_id")
    legal = asked.where("new_folder_id IS NULL").unionByName(
        asked.where("new_folder_id IS NOT NULL").join(exists, ["new_folder_id", "kb_id"], "left_semi").select(asked.columns))
    target = legal.select("document_id", "kb_id", "new_folder_id", F.lit(True).alias("_moved"))
    return documents.join(target, ["document_id", "kb_id"], "left").withColumn(
        "folder_id", F.when(F.col("_moved"), F.col("new_folder_id")).otherwise(F.col("folder_id"))
    ).drop("new_folder_id", "_moved")


def deletable_folders(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Folders without child folders and without documents."""
    parents = folders.select("kb_id", F.col("parent_id").alias("folder_id"))
    used = documents.select("kb_id", "folder_id")
    return folders.join(parents, ["kb_id", "folder_id"], "left_anti").join(used, ["kb_id", "folder_id"], "left_anti")


def delete_folders(folders: DataFrame, documents: DataFrame, acl: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the requested folders that are empty, and their rules: (folders, rules) left."""
    gone = deletable_folders(folders, documents).join(ids.select("folder_id").distinct(), "folder_id", "left_semi")
    gone = gone.select("folder_id")
    return folders.join(gone, "folder_id", "left_anti"), acl.join(gone, "folder_id", "left_anti")


def create_folders(folders: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new folders (folder_id, kb_id, parent_id, name, ...) into accepted and rejected rows.

    Rejected: a blank name, a parent of another collection, or a name already
    taken beside it. Accepted rows carry path and depth from their parent.
    """
    parent = folders.select(F.col("folder_id").alias("parent_id"), "kb_id", F.col("path").alias("_p_path"),
                            F.col("depth").alias("_p_depth"), F.lit(True).alias("_found"))
    taken = folders.select("kb_id", F.col("parent_id").alias("_at"), F.trim("name").alias("_name"),
                           F.lit(True).alias("_taken")).distinct()
    named = new.withColumn("name", F.trim("name")).join(parent, ["parent_id", "kb_id"], "left")
    checked = named.join(taken.withColumnRenamed("kb_id", "_kb"),
                         (F.col("kb_id") == F.col("_kb")) & F.col("parent_id").eqNullSafe(F.col("_at"))
                         & (F.col("name") == F.col("_name")), "left")
    reason = (F.when(F.col("name") == "", "name is empty")
              .when(F.col("parent_id").isNotNull() & F.col("_found").isNull(), "parent not in this collection")
              .when(F.col("_taken"), "name already used at this level"))
    out = checked.withColumns({
        "reject_reason": reason,
        "path": F.when(F.col("parent_id").isNull(), "/").otherwise(
            F.concat("_p_path", F.col("parent_id").cast("string"), F.lit("/"))),
        "depth": F.coalesce(F.col("_p_depth") + 1, F.lit(0)),
    }).select(*new.columns, "path", "depth", "reject_reason")
    return out.where("reject_reason IS NULL").drop("reject_reason"), out.where("reject_reason IS NOT NULL")


def sibling_name_conflicts(folders: DataFrame) -> DataFrame:
    """Names used more than once under one parent; folders at the root count as siblings."""
    return folders.groupBy("kb_id", "parent_id", "name").agg(
        F.count(F.lit(1)).alias("copies"), F.min("folder_id").alias("first_id")).where("copies > 1")
