"""Who may see what: collections, folders, documents and single chunks.

A *scope* is what one user may use for one request. Functions take a ``scopes``
table (scope_id, user_id, role, tags, kb_ids) so that a whole batch of requests
is resolved at once.

What a scope sees follows from its collection alone, except where a rule names
a folder or a document. So decisions are kept as one row per scope and
collection, corrected by one row per scope and folder under a rule, corrected by
one row per scope and document under a rule. A search never builds a table of
scopes x folders or scopes x documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantseek.common import PASS_QUERIES, cut_lineage, spread_join

SHOWN_BY = ("rule_allow", "admin", "folder_allow", "public")
ROOT, DANGLING = 0, -1  # places outside any folder, and in a folder the collection does not have


# ---------------------------------------------------------------- collections

def kb_capabilities(pairs: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, kb_id) with can_read, can_upload, can_manage; admins may do everything."""
    held = pairs.join(users.select("user_id", "role"), "user_id").join(grants, ["user_id", "kb_id"], "left")
    flag = lambda c: ((F.col("role") == "admin") | F.coalesce(c, F.lit(False))).alias(c)
    return held.select("user_id", "kb_id", flag("can_read"), flag("can_upload"), flag("can_manage"))


def _all_active(users: DataFrame, kbs: DataFrame) -> DataFrame:
    """The admin role holds every active collection, as if granted."""
    held = kbs.where("is_active").select("kb_id", F.lit("admin").alias("role"))
    return users.where("role = 'admin'").select("user_id", "role").join(held, "role").select("user_id", "kb_id")


def readable_kbs(users: DataFrame, kbs: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, kb_id) every user may read."""
    active = kbs.where("is_active").select("kb_id")
    granted = grants.where("can_read").join(users.where("role <> 'admin'").select("user_id"), "user_id").join(
        active, "kb_id", "left_semi").select("user_id", "kb_id")
    return _all_active(users, kbs).unionByName(granted)


def uploadable_kbs(users: DataFrame, kbs: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, kb_id) every user may add documents to; plain users none."""
    active = kbs.where("is_active").select("kb_id")
    granted = grants.where("can_upload").join(users.where("role = 'collaborator'").select("user_id"), "user_id").join(
        active, "kb_id", "left_semi").select("user_id", "kb_id")
    return _all_active(users, kbs).unionByName(granted)


# ---------------------------------------------------------------- scopes

def assign_scopes(requests: DataFrame) -> DataFrame:
    """Add scope_id: requests of one user for the same collections share one scope."""
    kb_ids = F.col("kb_ids") if "kb_ids" in requests.columns else F.lit(None).cast("array<bigint>")
    asked = F.array_sort(F.array_distinct(F.coalesce(kb_ids, F.array().cast("array<bigint>"))))
    same = Window.partitionBy("user_id", "kb_ids")
    return requests.withColumn("kb_ids", asked).withColumn("scope_id", F.min("query_id").over(same))


def scopes_of(requests: DataFrame, users: DataFrame) -> DataFrame:
    """One row per scope with the user's role and tags."""
    scopes = requests.select("scope_id", "user_id", "kb_ids").dropDuplicates(["scope_id"])
    return scopes.join(users.select("user_id", "role", "tags"), "user_id")


def user_scopes(users: DataFrame) -> DataFrame:
    """One scope per user over all their collections; scope_id is the user_id."""
    return users.select(F.col("user_id").alias("scope_id"), "user_id", "role", "tags",
                        F.array().cast("array<bigint>").alias("kb_ids"))


def requested_scope(scopes: DataFrame, kbs: DataFrame, grants: DataFrame) -> DataFrame:
    """(scope_id, kb_id, dataset_id, is_admin): readable collections, cut to the requested ones.

    No request means all readable collections.
    """
    who = scopes.select("user_id", "role").dropDuplicates(["user_id"])
    readable = readable_kbs(who, kbs, grants)
    held = scopes.join(readable, "user_id").where(
        (F.size("kb_ids") == 0) | F.array_contains("kb_ids", F.col("kb_id")))
    return held.join(kbs.select("kb_id", "dataset_id"), "kb_id").select(
        "scope_id", "kb_id", "dataset_id", (F.col("role") == "admin").alias("is_admin"))


# ---------------------------------------------------------------- rules

def expand_subjects(scopes: DataFrame) -> DataFrame:
    """(scope_id, subject_type, subject_id): the user, the role and every tag."""
    subject = lambda kind, ident: F.struct(F.lit(kind).alias("subject_type"), ident.alias("subject_id"))
    own = F.array(subject("user", F.col("user_id").cast("string")), subject("role", F.col("role")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: subject("tag", t))
    return scopes.select("scope_id", F.explode(F.concat(own, tags)).alias("s")).select("scope_id", "s.*").distinct()


def _given(c: str) -> Column:
    """A target column, with empty strings and 0 read as not set."""
    return F.expr(f"nullif(cast({c} as string), '')") if c != "folder_id" else F.expr("nullif(folder_id, 0)")


def rule_targets(acl: DataFrame) -> DataFrame:
    """Rules by their most specific target, copies of one target merged.

    Merging comes before any user is joined, so repeated rules cost nothing later.
    """
    chunk, document, folder = _given("chunk_id"), _given("document_id"), _given("folder_id")
    kind = (F.when(chunk.isNotNull(), "chunk").when(document.isNotNull(), "document")
            .when(folder.isNotNull(), "folder").otherwise("kb"))
    typed = acl.select(
        "subject_type", "subject_id", "kb_id", kind.alias("target"),
        F.when(kind.isin("chunk", "document"), document).alias("document_id"),
        F.when(kind == "chunk", chunk).alias("chunk_id"),
        F.when(kind == "folder", folder).alias("folder_id"), "effect")
    return typed.groupBy("subject_type", "subject_id", "kb_id", "target", "document_id", "chunk_id", "folder_id").agg(
        F.max(F.col("effect") == "allow").alias("allow"), F.max(F.col("effect") == "deny").alias("deny"))


def applicable_rules(scopes: DataFrame, scope_kbs: DataFrame, acl: DataFrame) -> DataFrame:
    """Rules that bear on each scope: scope_id, kb_id, target, ids, allow, deny.

    Rules of other subjects, and of collections that none of a subject's scopes holds, fall out first. A role or tag may own
    a large share of the rules; its copies are merged and the join with its scopes is salted. A rule meets the
    scopes that hold its collection only, not every scope of its subject.
    """
    key = ["subject_type", "subject_id", "kb_id"]
    subjects = cut_lineage(expand_subjects(scopes).join(scope_kbs.select("scope_id", "kb_id").distinct(), "scope_id"))
    mine = acl.join(subjects.select(*key).distinct(), key, "left_semi")
    targets = rule_targets(mine).withColumn("_spread", F.xxhash64("kb_id", "document_id", "chunk_id", "folder_id"))
    return spread_join(targets, subjects, key, by="_spread").groupBy("scope_id", "kb_id", "target", "document_id", "chunk_id", "folder_id").agg(
        F.max("allow").alias("allow"), F.max("deny").alias("deny"))


def _shared(targets: DataFrame) -> DataFrame:
    """Rules that many scopes may have in common."""
    return targets.where("target <> 'chunk' AND subject_type <> 'user'")


def access_signatures(scopes: DataFrame, scope_kbs: DataFrame, acl: DataFrame, closure: DataFrame, places: DataFrame,
                      documents: DataFrame) -> DataFrame:
    """scope_kbs with ``signature``, the (subject, rule's collection) pairs whose shared rules can bear on this collection, and
    ``own_allow`` and ``own_deny``, what the user's own rules say of the whole collection.

    Scopes of one collection, role kind, signature and flags see the same of it, but for their ``own_rules``.
    A rule counts for the collection that its document or folder lies in, which
    may be another than the one it was written for; it then bears only on scopes that hold both.
    A signature is no longer than the scope's roles and tags times the collections their rules come from. Signatures are made
    for each set of roles and tags, then cut to what a scope holds.
    """
    who = ["subject_type", "subject_id"]
    subjects = expand_subjects(scopes)
    common = subjects.where("subject_type <> 'user' AND subject_id IS NOT NULL")
    profiles = cut_lineage(common.groupBy("scope_id").agg(F.sort_array(F.collect_set(F.struct(*who))).alias("profile")))
    known = profiles.select("profile").distinct().select("profile", F.explode("profile").alias("_s")).select("profile", "_s.*")
    targets = _shared(rule_targets(acl.join(known.select(*who).distinct(), who, "left_semi")))
    of_folder = closure.join(places.select(F.col("place").alias("folder_id"), "kb_id"), "folder_id").select(
        F.col("ancestor_id").alias("folder_id"), F.col("kb_id").alias("within")).distinct()
    of_document = documents.select("document_id", F.col("kb_id").alias("within"))
    named = [targets.where("target = 'kb'").select(*who, "kb_id", F.col("kb_id").alias("within")),
             targets.where("target = 'document'").join(of_document, "document_id").select(*who, "kb_id", "within"),
             targets.where("target = 'folder'").join(of_folder, "folder_id").select(*who, "kb_id", "within")]
    bearing = cut_lineage(named[0].unionByName(named[1]).unionByName(named[2]).distinct())
    marks = cut_lineage(known.join(bearing, who).groupBy("profile", F.col("within").alias("kb_id")).agg(
        F.sort_array(F.collect_set(F.struct(*who, F.col("kb_id").alias("of_kb")))).alias("_marks")))
    none = F.array().cast(marks.schema["_marks"].dataType)
    held = scope_kbs.groupBy("scope_id").agg(F.collect_set("kb_id").alias("_held"))
    own = kb_rules_of(scopes, acl)
    signed = scope_kbs.join(profiles.join(held, "scope_id"), "scope_id", "left").join(own, ["scope_id", "kb_id"], "left")
    signed = spread_join(signed, marks, ["profile", "kb_id"], by="scope_id", how="left")
    kept = F.filter("_marks", lambda m: (m["of_kb"] == F.col("kb_id")) | F.array_contains("_held", m["of_kb"]))
    return signed.select(*scope_kbs.columns, F.coalesce(kept, none).alias("signature"),
                         F.coalesce("own_allow", F.lit(False)).alias("own_allow"), F.coalesce("own_deny", F.lit(False)).alias("own_deny"))


def kb_rules_of(scopes: DataFrame, acl: DataFrame) -> DataFrame:
    """(scope_id, kb_id, own_allow, own_deny): rules of a scope's user alone on whole collections."""
    who = scopes.select("scope_id", F.col("user_id").cast("string").alias("subject_id"))
    return rule_targets(acl.where("subject_type = 'user'")).where("target = 'kb'").join(who, "subject_id").groupBy("scope_id", "kb_id").agg(
        F.max("allow").alias("own_allow"), F.max("deny").alias("own_deny"))


def access_classes(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (scope_id, kb_id, dataset_id, is_admin, signature, own_allow, own_deny; scope_id is a number of the class) and members
    (scope_id, kb_id, is_admin, class_id).

    A class may hold a third of all scopes, so joins with it are salted by scope.
    """
    key = ["kb_id", "is_admin", "signature", "own_allow", "own_deny"]
    classes = cut_lineage(signed.select("dataset_id", *key).distinct().withColumn("scope_id", F.monotonically_increasing_id()))
    known = classes.select(*key, F.col("scope_id").alias("class_id"))
    members = spread_join(signed.drop("dataset_id"), known, key, by="scope_id")
    return classes, cut_lineage(members.drop("signature", "own_allow", "own_deny"))


def class_access(classes: DataFrame, rules: DataFrame) -> DataFrame:
    """``kb_access`` of the classes, with what their members' own rules say of the whole collection."""
    access = kb_access(classes.drop("signature"), rules)
    return access.withColumns({"kb_allow": F.col("kb_allow") | F.col("own_allow"), "kb_deny": F.col("kb_deny") | F.col("own_deny")}).select(
        "scope_id", "kb_id", "dataset_id", "is_admin", "kb_allow", "kb_deny")


def class_rules(classes: DataFrame, acl: DataFrame) -> DataFrame:
    """``applicable_rules`` of the classes, read from their signatures. Rules on chunks decide no document and are left out."""
    pair = ["subject_type", "subject_id", "kb_id"]
    held = classes.select("scope_id", F.explode("signature").alias("_s")).select(
        "scope_id", "_s.subject_type", "_s.subject_id", F.col("_s.of_kb").alias("kb_id"))
    mine = acl.join(held.select(*pair).distinct(), pair, "left_semi")
    targets = _shared(rule_targets(mine)).withColumn("_spread", F.xxhash64("kb_id", "document_id", "folder_id"))
    return spread_join(targets, held, pair, by="_spread").groupBy(
        "scope_id", "kb_id", "target", "document_id", "chunk_id", "folder_id").agg(
        F.max("allow").alias("allow"), F.max("deny").alias("deny"))


def own_rules(scopes: DataFrame, scope_kbs: DataFrame, acl: DataFrame) -> DataFrame:
    """``applicable_rules`` that a scope's user holds alone, on folders and documents: what its class does not know."""
    who = scopes.select("scope_id", F.col("user_id").cast("string").alias("subject_id"))
    held = rule_targets(acl.where("subject_type = 'user'")).where("target IN ('folder', 'document')").join(who, "subject_id")
    return held.join(scope_kbs.select("scope_id", "kb_id"), ["scope_id", "kb_id"], "left_semi").select(
        "scope_id", "kb_id", "target", "document_id", "chunk_id", "folder_id", "allow", "deny")


def found_rules(found: DataFrame, scopes: DataFrame, scope_kbs: DataFrame, acl: DataFrame, placed: DataFrame,
                closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, hits): ``applicable_rules`` and ``folder_hits`` as far as they bear on chunks found (scope_id, chunk_id, document_id).

    For very many scopes that each found little: a rule of a role meets the rows found in its document, chunk or folder, never all
    users of the role. Folder rules of roles and tags go down to the folders below, places found go up to the folder rules of users.
    """
    who = ["subject_type", "subject_id"]
    subjects = cut_lineage(expand_subjects(scopes).where("subject_id IS NOT NULL"))
    targets = cut_lineage(rule_targets(acl.join(subjects.select(*who).distinct(), who, "left_semi")))
    columns = ["scope_id", "kb_id", "target", "document_id", "chunk_id", "folder_id", "allow", "deny"]
    on_item = targets.where("target IN ('chunk', 'document')")

    def met(items: DataFrame, rules: DataFrame, key: str) -> DataFrame:
        return items.join(rules.select(key).distinct(), key, "left_semi").join(subjects, "scope_id").join(rules, [*who, key]).select(*columns)
    of_chunk = met(found.select("scope_id", "chunk_id").distinct(), on_item.where("target = 'chunk'"), "chunk_id")
    of_document = met(found.select("scope_id", "document_id").distinct(), on_item, "document_id")
    on_kb = targets.where("target = 'kb'")
    of_kb = spread_join(scope_kbs.select("scope_id", "kb_id").join(subjects, "scope_id"), on_kb, [*who, "kb_id"], by="scope_id").select(*columns)
    held = scope_kbs.select("scope_id", "kb_id")
    rules = of_chunk.unionByName(of_document).unionByName(of_kb).join(held, ["scope_id", "kb_id"], "left_semi").groupBy(
        "scope_id", "kb_id", "target", "document_id", "chunk_id", "folder_id").agg(F.max("allow").alias("allow"), F.max("deny").alias("deny"))

    on_folder = targets.where("target = 'folder'").select(*who, "kb_id", F.col("folder_id").alias("ancestor_id"), "allow", "deny")
    at = cut_lineage(found.select("scope_id", "document_id").distinct().join(placed, "document_id").select("scope_id", "place").distinct())
    down = on_folder.where("subject_type <> 'user'").join(closure.select("folder_id", "ancestor_id"), "ancestor_id").groupBy(
        *who, "kb_id", F.col("folder_id").alias("place")).agg(F.max("allow").alias("allow"), F.max("deny").alias("deny"))
    shared = at.join(subjects.where("subject_type <> 'user'"), "scope_id").join(down, [*who, "place"])
    own = on_folder.where("subject_type = 'user'").join(subjects, who)
    up = at.join(own.select("scope_id").distinct(), "scope_id", "left_semi").join(
        closure.select(F.col("folder_id").alias("place"), "ancestor_id"), "place").join(own, ["scope_id", "ancestor_id"])
    hit = ["scope_id", "kb_id", "place", "allow", "deny"]
    hits = shared.select(*hit).unionByName(up.select(*hit)).join(held, ["scope_id", "kb_id"], "left_semi")
    return rules, hits.groupBy("scope_id", "place").agg(F.max("allow").alias("f_allow"), F.max("deny").alias("f_deny"))


def kb_access(scope_kbs: DataFrame, rules: DataFrame) -> DataFrame:
    """scope_kbs with the collection's own rules: kb_allow and kb_deny."""
    ruled = rules.where("target = 'kb'").select(
        "scope_id", "kb_id", F.col("allow").alias("_allow"), F.col("deny").alias("_deny"))
    return scope_kbs.join(ruled, ["scope_id", "kb_id"], "left").select(
        *scope_kbs.columns, F.coalesce("_allow", F.lit(False)).alias("kb_allow"),
        F.coalesce("_deny", F.lit(False)).alias("kb_deny"))


def folder_hits(rules: DataFrame, closure: DataFrame) -> DataFrame:
    """(scope_id, place, f_allow, f_deny) for folders with a rule on themselves or an ancestor."""
    on_folder = rules.where("target = 'folder'").groupBy("scope_id", F.col("folder_id").alias("ancestor_id")).agg(
        F.max("allow").alias("allow"), F.max("deny").alias("deny"))
    below = spread_join(closure.select("folder_id", "ancestor_id"), on_folder, ["ancestor_id"], by="folder_id")
    return below.groupBy("scope_id", F.col("folder_id").alias("place")).agg(
        F.max("allow").alias("f_allow"), F.max("deny").alias("f_deny"))


def folder_places(folders: DataFrame, closure: DataFrame) -> DataFrame:
    """(place, kb_id, shut): shut folders are restricted or lie below a restricted one."""
    restricted = folders.where("visibility = 'restricted'").select(F.col("folder_id").alias("ancestor_id"))
    shut = closure.join(restricted, "ancestor_id", "left_semi").select("folder_id").distinct()
    return folders.select("folder_id", "kb_id").join(shut.withColumn("_shut", F.lit(True)), "folder_id", "left").select(
        F.col("folder_id").alias("place"), "kb_id", F.coalesce("_shut", F.lit(False)).alias("shut"))


def placed_documents(documents: DataFrame, places: DataFrame) -> DataFrame:
    """(document_id, kb_id, place, shut, is_public)."""
    known = places.select(F.col("place").alias("folder_id"), "kb_id", "shut")
    outside = F.col("folder_id").isNull()
    return documents.select("document_id", "kb_id", "folder_id", "visibility").join(
        known, ["folder_id", "kb_id"], "left").select(
        "document_id", "kb_id",
        F.when(outside, ROOT).when(F.col("shut").isNull(), DANGLING).otherwise(F.col("folder_id")).cast("bigint").alias("place"),
        F.when(outside, False).otherwise(F.coalesce("shut", F.lit(True))).alias("shut"),
        (F.col("visibility") == "public").alias("is_public"))


def decision(hit: bool = False, document: bool = False) -> Column:
    """The rule that decides a document, the first that applies.

    Reads kb_allow, kb_deny, is_admin, shut and is_public; with ``hit`` also
    f_allow and f_deny of the folder, with ``document`` d_allow and d_deny.
    """
    flag = lambda name, given: F.coalesce(F.col(name), F.lit(False)) if given else F.lit(False)
    f_allow, f_deny = flag("f_allow", hit), flag("f_deny", hit)
    return (F.when(F.col("kb_deny") | flag("d_deny", document), "rule_deny")
            .when(F.col("kb_allow") | flag("d_allow", document), "rule_allow")
            .when(f_deny, "folder_deny")
            .when(F.col("is_admin"), "admin")
            .when(F.col("shut") & ~f_allow, "folder_hidden")
            .when(f_allow, "folder_allow")
            .when(F.col("is_public"), "public")
            .otherwise("restricted"))


def shown(by: Column) -> Column:
    return by.isin(*SHOWN_BY)


def _passes(access: DataFrame) -> int:
    """Parts the scopes are dealt into, so that a list of scopes is no longer than a pass."""
    return max(1, -(-access.select("scope_id").distinct().count() // PASS_QUERIES))


def _dealt(df: DataFrame, passes: int) -> DataFrame:
    return df.withColumn("_pass", F.pmod(F.xxhash64("scope_id"), F.lit(passes)))


def _listed(rows: DataFrame, passes: int, *sides: tuple[DataFrame, str, Sequence[str]]) -> DataFrame:
    """``rows`` once a pass, with lists of the scopes that have a flag there: of each side (rows of scopes, key, flags).

    A listing of scopes x rows reads its flags from these lists, so it is not shuffled to meet the rules.
    """
    out = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)).cast("array<bigint>")))
    for side, key, flags in sides:
        lists = _dealt(side, passes).groupBy(key, "_pass").agg(*[F.collect_set(F.when(F.col(f), F.col("scope_id"))).alias(f"_of_{f}") for f in flags])
        out = out.join(lists, [key, "_pass"], "left")
    return out


def _flag(name: str) -> Column:
    """Whether the row's scope is in the list of ``name``."""
    return F.coalesce(F.array_contains(f"_of_{name}", F.col("scope_id")), F.lit(False))


def folder_visibility(access: DataFrame, places: DataFrame, hits: DataFrame) -> DataFrame:
    """(scope_id, kb_id, folder_id, denied, visible, granted) for every folder of every scope.

    The full listing, for reports; searches use ``folder_hits`` alone. Folders meet the lists of scopes that have a rule
    there before they meet their scopes: the listing itself is never shuffled.
    """
    passes = _passes(access)
    marked = _listed(places, passes, (hits, "place", ["f_allow", "f_deny"]))
    every = spread_join(marked, _dealt(access.select("scope_id", "kb_id", "is_admin"), passes), ["kb_id", "_pass"], by="place")
    deny, allow = _flag("f_deny"), _flag("f_allow")
    return every.select("scope_id", "kb_id", F.col("place").alias("folder_id"), deny.alias("denied"),
                        (~deny & (allow | F.col("is_admin") | ~F.col("shut"))).alias("visible"),
                        (~deny & allow).alias("granted"))


def open_folders(access: DataFrame, places: DataFrame, hits: DataFrame, closure: DataFrame) -> DataFrame:
    """(folder_id, scopes): who sees a folder and every folder above it, as lists of scopes no longer than a pass.

    Rules and shut folders act on all that lies below. So a rule that denies a folder above denies the folder too, and of the shut
    folders above it the topmost of each collection tells whether all of them are opened. A folder may have several lists; no scope is in two.
    """
    passes = _passes(access)
    none = F.array().cast("array<bigint>")
    dealt = _dealt(access.select("scope_id", "kb_id", "is_admin").distinct(), passes)
    held = dealt.groupBy("kb_id", "_pass").agg(
        F.collect_set("scope_id").alias("_all"), F.collect_set(F.when(~F.col("is_admin"), F.col("scope_id"))).alias("_plain"))
    shut = places.where("shut").select(F.col("place").alias("ancestor_id"), "kb_id").distinct()
    tops = closure.join(shut, "ancestor_id").groupBy("folder_id", "kb_id").agg(F.max_by("ancestor_id", "distance").alias("place"))
    tops = _listed(tops, passes, (hits, "place", ["f_allow"])).join(held, ["kb_id", "_pass"])
    closed = tops.select(F.col("folder_id").alias("place"), "_pass", F.array_except("_plain", F.coalesce("_of_f_allow", none)).alias("_closed"))
    closed = closed.groupBy("place", "_pass").agg(F.flatten(F.collect_list("_closed")).alias("_closed"))
    own = places.where("place IS NOT NULL").select("place", "kb_id").distinct()
    marked = _listed(own, passes, (hits, "place", ["f_deny"])).join(closed, ["place", "_pass"], "left").join(held, ["kb_id", "_pass"])
    seen = F.array_except(F.array_except("_all", F.coalesce("_of_f_deny", none)), F.coalesce("_closed", none))
    return marked.groupBy(F.col("place").alias("folder_id"), "_pass").agg(
        F.array_distinct(F.flatten(F.collect_list(seen))).alias("scopes")).drop("_pass")


def _document_rules(rules: DataFrame) -> DataFrame:
    return rules.where("target = 'document'").groupBy("scope_id", "document_id").agg(
        F.max("allow").alias("d_allow"), F.max("deny").alias("d_deny"))


def _decide(pairs: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Decision of placed documents joined with ``kb_access``: one row per (scope, document)."""
    flags = pairs.join(hits, ["scope_id", "place"], "left").join(
        _document_rules(rules), ["scope_id", "document_id"], "left")
    return flags.select("scope_id", "kb_id", "document_id", decision(hit=True, document=True).alias("decided_by")).withColumn(
        "visible", shown(F.col("decided_by")))


def document_visibility(placed: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Every document of every scope's collections: decided_by and visible.

    The result is scopes x documents by definition; a search uses ``audience``
    and ``visible_pairs`` instead. Hot collections are salted by document; documents meet the lists of scopes under a rule first,
    so the result is never shuffled.
    """
    passes = _passes(access)
    marked = _listed(placed, passes, (hits, "place", ["f_allow", "f_deny"]), (_document_rules(rules), "document_id", ["d_allow", "d_deny"]))
    every = spread_join(marked, _dealt(access.drop("dataset_id"), passes), ["kb_id", "_pass"], by="document_id")
    flagged = every.withColumns({f: _flag(f) for f in ("f_allow", "f_deny", "d_allow", "d_deny")})
    return flagged.select("scope_id", "kb_id", "document_id", decision(hit=True, document=True).alias("decided_by")).withColumn(
        "visible", shown(F.col("decided_by")))


def visible_pairs(pairs: DataFrame, placed: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """The same decision for given (scope_id, document_id) pairs only."""
    at = pairs.select("scope_id", "document_id").distinct().join(placed, "document_id")
    return _decide(at.join(access.drop("dataset_id"), ["scope_id", "kb_id"]), hits, rules)


def opened_documents(rules: DataFrame) -> DataFrame:
    """(scope_id, document_id) with an allowed chunk: searched, and shown by whitelist."""
    return rules.where("target = 'chunk' AND allow AND document_id IS NOT NULL").select(
        "scope_id", "document_id").distinct()


def search_documents(visible: DataFrame, rules: DataFrame) -> DataFrame:
    """(scope_id, document_id) a search may touch: visible ones and those with an allowed chunk."""
    return visible.where("visible").select("scope_id", "document_id").unionByName(opened_documents(rules)).distinct()


def _kinds(access: DataFrame) -> DataFrame:
    """kb_access once per kind of place (shut or not) and document (public or not): four rows each."""
    kinds = F.array(*[F.struct(F.lit(s).alias("shut"), F.lit(p).alias("is_public")) for s in (False, True) for p in (False, True)])
    return access.withColumn("_kind", F.explode(kinds)).select("*", "_kind.*").drop("_kind", "dataset_id")


def _folder_changes(access: DataFrame, places: DataFrame, hits: DataFrame) -> DataFrame:
    """Where a folder rule changes a decision: scope_id, kb_id, place, is_public, before, after."""
    at = hits.join(places, "place").join(access.drop("dataset_id"), ["scope_id", "kb_id"])
    both = at.withColumn("is_public", F.explode(F.array(F.lit(False), F.lit(True))))
    return both.select("scope_id", "kb_id", "place", "is_public", decision().alias("before"),
                       decision(hit=True).alias("after")).where("before <> after")


def audience(placed: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_id, audience): the scopes that may search each document, as a list.

    For one pass of requests, so a list is never longer than the pass. Scopes
    are gathered per collection and kind of document, corrected per folder under
    a rule, corrected per document under a rule. Work is proportional to
    documents + rules, not to scopes x documents.
    """
    scopes_where = lambda cond: F.collect_set(F.when(cond, F.col("scope_id")))
    kind = ["kb_id", "shut", "is_public"]
    base = _kinds(access).groupBy(*kind).agg(scopes_where(shown(decision())).alias("_base"))
    moved = _folder_changes(access, places, hits).withColumns({"_was": shown(F.col("before")), "_is": shown(F.col("after"))})
    by_folder = moved.where("_was <> _is").groupBy("place", "is_public").agg(
        scopes_where(F.col("_is")).alias("_f_add"), scopes_where(F.col("_was")).alias("_f_drop"))
    opened = opened_documents(rules)
    ruled = rules.where("target = 'document'").select("scope_id", "document_id").unionByName(opened)
    exact = visible_pairs(ruled, placed, access, hits, rules).join(
        opened.withColumn("_opened", F.lit(True)), ["scope_id", "document_id"], "left")
    on = F.col("visible") | F.coalesce("_opened", F.lit(False))
    by_document = exact.groupBy("document_id").agg(
        scopes_where(on).alias("_d_add"), scopes_where(~on).alias("_d_drop"))

    def corrected(base_list: Column, add: str, drop: str) -> Column:
        return F.when(F.col(add).isNull(), base_list).otherwise(F.array_union(F.array_except(base_list, drop), add))
    listed = spread_join(placed, base, kind, by="document_id", how="left")
    listed = spread_join(listed, by_folder, ["place", "is_public"], by="document_id", how="left")
    listed = listed.join(by_document, "document_id", "left")
    none = F.array().cast("array<bigint>")
    final = corrected(corrected(F.coalesce("_base", none), "_f_add", "_f_drop"), "_d_add", "_d_drop")
    return listed.select("document_id", final.alias("audience")).where(F.size("audience") > 0)


def _chunk_rules(rules: DataFrame) -> DataFrame:
    return rules.where("target = 'chunk'").groupBy("scope_id", "chunk_id").agg(
        F.max("allow").alias("c_allow"), F.max("deny").alias("c_deny"))


def _chunk_seen(document: Column) -> Column:
    """From c_allow, c_deny, opened (the document has an allowed chunk) and whether the document is visible."""
    no = F.lit(False)
    return (F.when(F.coalesce("c_deny", no), no).when(F.coalesce("c_allow", no), F.lit(True))
            .when(F.coalesce("opened", no), no).otherwise(F.coalesce(document, no)))


def chunk_visibility(found: DataFrame, placed: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``visible`` to chunks found (scope_id, chunk_id, document_id): the last word before a prompt.

    ``found`` may be chunks (chunk_id, document_id, kb_id) instead, kb_id that of their document: each is then judged for every scope
    that holds the collection, and scope_id is added. Rows of chunks then meet lists of scopes under a rule; the listing is never shuffled.
    """
    listed = opened_documents(rules).withColumn("opened", F.lit(True))
    if "scope_id" not in found.columns:
        return _every_chunk(found, placed, access, hits, rules, listed)
    docs = visible_pairs(found, placed, access, hits, rules).select(
        "scope_id", "document_id", F.col("visible").alias("_doc"))
    key = ["scope_id", "document_id"]
    flags = found.join(_chunk_rules(rules), ["scope_id", "chunk_id"], "left").join(listed, key, "left").join(docs, key, "left")
    return flags.withColumn("visible", _chunk_seen(F.col("_doc"))).drop("c_allow", "c_deny", "opened", "_doc")


def _every_chunk(chunks: DataFrame, placed: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    passes = _passes(access)
    at = chunks.join(placed.withColumnRenamed("kb_id", "_kb"), "document_id")
    marked = _listed(at, passes, (hits, "place", ["f_allow", "f_deny"]), (_document_rules(rules), "document_id", ["d_allow", "d_deny"]),
                     (listed, "document_id", ["opened"]), (_chunk_rules(rules), "chunk_id", ["c_allow", "c_deny"]))
    holders = _dealt(access.select("scope_id", "kb_id"), passes)
    every = spread_join(marked, holders, ["kb_id", "_pass"], by="chunk_id").join(
        access.drop("dataset_id").withColumnRenamed("kb_id", "_kb"), ["scope_id", "_kb"])
    flagged = every.withColumns({f: _flag(f) for f in ("f_allow", "f_deny", "d_allow", "d_deny", "opened", "c_allow", "c_deny")})
    return flagged.select("scope_id", *chunks.columns, _chunk_seen(shown(decision(hit=True, document=True))).alias("visible"))


def permission_filter(found: DataFrame, placed: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Only the chunks the scope may see."""
    return chunk_visibility(found, placed, access, hits, rules).where("visible").drop("visible")


# ---------------------------------------------------------------- reports

def _changes(placed: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame):
    """How decisions move away from those of the collection: by folder (with its documents counted) and by document."""
    sizes = placed.groupBy("place", "is_public").agg(F.count(F.lit(1)).alias("n_docs"))
    by_folder = _folder_changes(access, places, hits).join(sizes, ["place", "is_public"])
    ruled = rules.where("target = 'document'").select("scope_id", "document_id").distinct()
    at = ruled.join(placed, "document_id").join(access.drop("dataset_id"), ["scope_id", "kb_id"]).join(
        hits, ["scope_id", "place"], "left").join(_document_rules(rules), ["scope_id", "document_id"], "left")
    by_document = at.select("scope_id", "document_id", decision(hit=True).alias("before"),
                            decision(hit=True, document=True).alias("after")).where("before <> after")
    return by_folder, by_document


def visible_counts(placed: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(scope_id, n_visible) from document counts per collection and kind, corrected where rules act."""
    sizes = placed.groupBy("kb_id", "shut", "is_public").agg(F.count(F.lit(1)).alias("n_docs"))
    base = _kinds(access).where(shown(decision())).join(sizes, ["kb_id", "shut", "is_public"]).select(
        "scope_id", F.col("n_docs").alias("n"))
    by_folder, by_document = _changes(placed, places, access, hits, rules)
    step = shown(F.col("after")).cast("bigint") - shown(F.col("before")).cast("bigint")
    fixes = by_folder.select("scope_id", (step * F.col("n_docs")).alias("n")).unionByName(
        by_document.select("scope_id", step.alias("n")))
    return base.unionByName(fixes).groupBy("scope_id").agg(F.sum("n").alias("n_visible"))


def _own_places(members: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, own_hits: DataFrame) -> DataFrame:
    """Folders below a scope's own rules, with what its class (c_) and its own rules (o_) say of them."""
    mine = own_hits.select("scope_id", "place", F.col("f_allow").alias("o_allow"), F.col("f_deny").alias("o_deny"))
    at = mine.join(places, "place").join(members.drop("is_admin"), ["scope_id", "kb_id"])
    return _of_class(at, access, hits)


def _of_class(at: DataFrame, access: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows with class_id, kb_id and place, with the collection's flags and the folder rules (c_allow, c_deny) of the class."""
    flags = access.drop("dataset_id").withColumnRenamed("scope_id", "class_id")
    shared = hits.select(F.col("scope_id").alias("class_id"), "place", F.col("f_allow").alias("c_allow"), F.col("f_deny").alias("c_deny"))
    return at.join(flags, ["class_id", "kb_id"]).join(shared, ["class_id", "place"], "left")


def _either(left: str, right: str) -> Column:
    return F.coalesce(F.col(left), F.lit(False)) | F.coalesce(F.col(right), F.lit(False))


def _seen(df: DataFrame, name: str, folder: bool, document: str = "") -> DataFrame:
    """Add ``name``: 1 if the document is shown by the class, with ``folder`` also by the scope's own folder
    rules; rules on the document count as ``document`` says: none, those of the ``class``, or ``all``."""
    no = F.lit(False)
    both = {f"f_{e}": _either(f"c_{e}", f"o_{e}") if folder else F.col(f"c_{e}") for e in ("allow", "deny")}
    rules = {"": lambda e: no, "class": lambda e: F.col(f"cd_{e}"), "all": lambda e: _either(f"cd_{e}", f"od_{e}")}[document]
    flagged = df.withColumns(both | {f"d_{e}": rules(e) for e in ("allow", "deny")})
    return flagged.withColumn(name, shown(decision(hit=True, document=True)).cast("bigint")).drop("f_allow", "f_deny", "d_allow", "d_deny")


def own_visible_counts(members: DataFrame, placed: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame,
                       own_hits: DataFrame, own: DataFrame) -> DataFrame:
    """(scope_id, n_visible): what scopes see more (or less, below 0) than their classes, by their own rules.

    Documents of a folder below an own rule are counted by kind. Single documents are looked at where an own rule names them, and
    where a rule of the class names one in such a folder.
    """
    at = cut_lineage(_own_places(members, places, access, hits, own_hits))
    kinds = at.withColumn("is_public", F.explode(F.array(F.lit(False), F.lit(True))))
    moved = _seen(_seen(kinds, "before", False), "after", True).where("before <> after")
    sizes = placed.groupBy("place", "is_public").agg(F.count(F.lit(1)).alias("n_docs"))
    by_folder = moved.join(sizes, ["place", "is_public"]).select(
        "scope_id", ((F.col("after") - F.col("before")) * F.col("n_docs")).alias("n_visible"))

    ruled = lambda df, who, mark: _document_rules(df).select(F.col("scope_id").alias(who), "document_id", F.col("d_allow").alias(f"{mark}_allow"),
                                                             F.col("d_deny").alias(f"{mark}_deny"))
    of_class, of_scope = ruled(rules, "class_id", "cd"), ruled(own, "scope_id", "od")
    beside = of_class.select("class_id", "document_id").join(placed.select("document_id", "place"), "document_id").join(
        at.select("scope_id", "class_id", "place"), ["class_id", "place"]).select("scope_id", "document_id")
    pairs = of_scope.select("scope_id", "document_id").unionByName(beside).distinct()
    each = pairs.join(placed, "document_id").join(members.drop("is_admin"), ["scope_id", "kb_id"])
    mine = own_hits.select("scope_id", "place", F.col("f_allow").alias("o_allow"), F.col("f_deny").alias("o_deny"))
    each = _of_class(each, access, hits).join(mine, ["scope_id", "place"], "left").join(
        of_class, ["class_id", "document_id"], "left").join(of_scope, ["scope_id", "document_id"], "left")
    for name, folder, document in (("all", True, "all"), ("bare", True, ""), ("shared", False, "class"), ("plain", False, "")):
        each = _seen(each, f"_{name}", folder, document)
    by_document = each.select("scope_id", (F.col("_all") - F.col("_bare") - F.col("_shared") + F.col("_plain")).alias("n_visible"))
    return by_folder.unionByName(by_document)


def own_folder_counts(members: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, own_hits: DataFrame) -> DataFrame:
    """(scope_id, total_folders, visible_folders, folder_granted): likewise for folders."""
    at = _own_places(members, places, access, hits, own_hits)
    no = F.lit(False)
    def counts(allow: Column, deny: Column) -> tuple[Column, Column]:
        seen = ~deny & (allow | F.col("is_admin") | ~F.col("shut"))
        return seen.cast("bigint"), (~deny & allow).cast("bigint")
    before = counts(F.coalesce("c_allow", no), F.coalesce("c_deny", no))
    after = counts(_either("c_allow", "o_allow"), _either("c_deny", "o_deny"))
    return at.select("scope_id", F.lit(0).cast("bigint").alias("total_folders"),
                     (after[0] - before[0]).alias("visible_folders"), (after[1] - before[1]).alias("folder_granted"))


def total_by_scope(members: DataFrame, of_classes: DataFrame, own: DataFrame) -> DataFrame:
    """Counts of classes handed to their members, added up with what the members' own rules change."""
    names = [c for c in own.columns if c != "scope_id"]
    each = spread_join(members.select("scope_id", "class_id"), of_classes.withColumnRenamed("scope_id", "class_id"), ["class_id"], by="scope_id")
    return each.drop("class_id").unionByName(own).groupBy("scope_id").agg(*[F.sum(c).alias(c) for c in names])


def folder_counts_of(access: DataFrame, places: DataFrame, hits: DataFrame) -> DataFrame:
    """(scope_id, total_folders, visible_folders, folder_granted) without listing folders per scope."""
    sizes = places.groupBy("kb_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("shut")).alias("n_open"))
    base = access.join(sizes, "kb_id").select(
        "scope_id", F.col("n").alias("total"), F.when(F.col("is_admin"), F.col("n")).otherwise(F.col("n_open")).alias("visible"),
        F.lit(0).cast("bigint").alias("granted"))
    at = hits.join(places, "place").join(access.drop("dataset_id"), ["scope_id", "kb_id"])
    before = F.col("is_admin") | ~F.col("shut")
    after = ~F.col("f_deny") & (F.col("f_allow") | before)
    fixes = at.select("scope_id", F.lit(0).cast("bigint").alias("total"),
                      (after.cast("bigint") - before.cast("bigint")).alias("visible"),
                      (~F.col("f_deny") & F.col("f_allow")).cast("bigint").alias("granted"))
    return base.unionByName(fixes).groupBy("scope_id").agg(
        F.sum("total").alias("total_folders"), F.sum("visible").alias("visible_folders"), F.sum("granted").alias("folder_granted"))


def scope_stats(
    scopes: DataFrame, access: DataFrame, documents: DataFrame, placed: DataFrame, places: DataFrame, hits: DataFrame,
    rules: DataFrame,
) -> DataFrame:
    """Eleven counts per scope, none of them from a table of scopes x documents."""
    kb = access.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("kb_count"), F.count_distinct("dataset_id").alias("dataset_count"))
    sizes = documents.groupBy("kb_id").agg(F.count(F.lit(1)).alias("_n"))
    totals = access.join(sizes, "kb_id").groupBy("scope_id").agg(F.sum("_n").alias("total_documents"))
    seen_docs = visible_counts(placed, places, access, hits, rules).withColumnRenamed("n_visible", "visible_documents")
    opened = opened_documents(rules)
    seen = visible_pairs(opened, placed, access, hits, rules).where("visible").select("scope_id", "document_id")
    extra = opened.join(seen, ["scope_id", "document_id"], "left_anti").groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("_extra"))
    white = opened.groupBy("scope_id").agg(F.count(F.lit(1)).alias("documents_in_whitelist_mode"))
    chunk = rules.where("target = 'chunk'").groupBy("scope_id", "chunk_id").agg(
        F.max("allow").alias("allow"), F.max("deny").alias("deny")).groupBy("scope_id").agg(
        F.count_if("allow").alias("chunk_allow_rules"), F.count_if("deny").alias("chunk_deny_rules"))
    out = scopes.select("scope_id")
    for part in (kb, totals, seen_docs, extra, white, chunk, folder_counts_of(access, places, hits)):
        out = out.join(part, "scope_id", "left")
    out = out.withColumn("searchable_documents", F.coalesce("visible_documents", F.lit(0)) + F.coalesce("_extra", F.lit(0)))
    names = ["kb_count", "dataset_count", "visible_documents", "searchable_documents", "total_documents",
             "chunk_allow_rules", "chunk_deny_rules", "documents_in_whitelist_mode", "total_folders",
             "visible_folders", "folder_granted"]
    return out.select("scope_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names])


def _once(rows: DataFrame, access: DataFrame, key: str, facts: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``facts(rows, access)`` without repeats. Where a key stands in one row, and a scope holds its collection in one,
    nothing repeats; only the others are compared."""
    number = lambda df, *by: df.distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    rows, access = number(rows, key), number(access.drop("dataset_id"), "scope_id", "kb_id")
    one, more = (rows.where(c).drop("_n") for c in ("_n = 1", "_n > 1"))
    single, several = (access.where(c).drop("_n") for c in ("_n = 1", "_n > 1"))
    return facts(one, single).unionByName(facts(one, several).unionByName(facts(more, access.drop("_n"))).distinct())


def diagnose(placed: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Why somebody can or cannot find something: (scope_id, kind, item), one row per fact."""
    def of_documents(rows: DataFrame, by: DataFrame) -> DataFrame:
        kind = F.when(F.col("visible"), "visible_document").otherwise("hidden_document")
        return document_visibility(rows, by, hits, rules).select("scope_id", kind.alias("kind"), F.col("document_id").alias("item"))

    def of_folders(rows: DataFrame, by: DataFrame) -> DataFrame:
        seen = F.when(F.col("visible"), "visible_folder").otherwise("hidden_folder")
        kinds = F.when(F.col("granted"), F.array(seen, F.lit("granted_folder"))).otherwise(F.array(seen))
        return folder_visibility(by, rows, hits).select("scope_id", F.explode(kinds).alias("kind"), F.col("folder_id").cast("string").alias("item"))
    chunk = rules.where("target = 'chunk'")
    fact = lambda df, kind, item: df.select("scope_id", F.lit(kind).alias("kind"), F.col(item).alias("item"))
    of_chunks = fact(chunk.where("allow"), "allowed_chunk", "chunk_id").unionByName(fact(chunk.where("deny"), "denied_chunk", "chunk_id")).distinct()
    opened = fact(opened_documents(rules), "whitelist_document", "document_id")
    out = _once(placed, access, "document_id", of_documents)
    for facts in (_once(places, access, "place", of_folders), of_chunks, opened):
        out = out.unionByName(facts)
    return out


def visibility_matrix(placed: DataFrame, places: DataFrame, access: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_id, decided_by, n_scopes): how many scopes each rule decides, per document.

    Scopes are counted per collection and kind, then per folder and document
    under a rule; users x documents is never built.
    """
    kind = ["kb_id", "shut", "is_public"]
    base = _kinds(access).groupBy(*kind, decision().alias("decided_by")).agg(F.count(F.lit(1)).alias("n"))
    by_kb = spread_join(placed, base, kind, by="document_id").select("document_id", "decided_by", "n")

    def moves(df: DataFrame, *key: str) -> DataFrame:
        one = F.lit(1).cast("bigint")
        steps = F.array(F.struct(F.col("before").alias("decided_by"), (-one).alias("n")),
                        F.struct(F.col("after").alias("decided_by"), one.alias("n")))
        return df.select(*key, F.explode(steps).alias("_m")).groupBy(*key, "_m.decided_by").agg(F.sum("_m.n").alias("n"))
    at_folder = moves(_folder_changes(access, places, hits), "place", "is_public")
    by_folder = spread_join(placed, at_folder, ["place", "is_public"], by="document_id").select("document_id", "decided_by", "n")
    by_document = moves(_changes(placed, places, access, hits, rules)[1], "document_id")
    return by_kb.unionByName(by_folder).unionByName(by_document).groupBy("document_id", "decided_by").agg(
        F.sum("n").alias("n_scopes")).where("n_scopes <> 0")


# ---------------------------------------------------------------- changes

def grant_kb(grants: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace grants, key (user_id, kb_id)."""
    flags = ["can_read", "can_upload", "can_manage"]
    fresh = new.dropDuplicates(["user_id", "kb_id"]).select(
        "user_id", "kb_id", *[F.col(c).alias(f"_{c}") for c in flags])
    return grants.join(fresh, ["user_id", "kb_id"], "full").select(
        "user_id", "kb_id", *[F.coalesce(f"_{c}", c).alias(c) for c in flags])


def revoke_kb(grants: DataFrame, acl: DataFrame, who: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove grants (user_id, kb_id) and the users' own rules there: (grants, rules, removed per pair).

    A pair without a grant removes nothing.
    """
    found = who.select("user_id", "kb_id").distinct().join(grants, ["user_id", "kb_id"], "left_semi")
    own = found.select("kb_id", F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"))
    key = ["kb_id", "subject_type", "subject_id"]
    counts = acl.join(own, key, "left_semi").groupBy("kb_id", "subject_id").agg(F.count(F.lit(1)).alias("_n"))
    removed = found.join(counts.withColumn("user_id", F.col("subject_id").cast("bigint")), ["user_id", "kb_id"], "left")
    return (grants.join(found, ["user_id", "kb_id"], "left_anti"), acl.join(own, key, "left_anti"),
            removed.select("user_id", "kb_id", F.coalesce("_n", F.lit(0)).alias("removed_rules")))


def add_acl(acl: DataFrame, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append rules; those naming a document outside their collection come back as rejected."""
    has_doc = F.length(F.coalesce("document_id", F.lit(""))) > 0
    known = documents.select("document_id", "kb_id")
    bad = new.where(has_doc).join(known, ["document_id", "kb_id"], "left_anti").select(new.columns)
    good = new.where(~has_doc).unionByName(
        new.where(has_doc).join(known, ["document_id", "kb_id"], "left_semi").select(new.columns))
    return acl.unionByName(good, allowMissingColumns=True), bad


def add_acl_batch(acl: DataFrame, new: DataFrame) -> DataFrame:
    """Append one rule per entry of ``chunk_ids``, without checking the document."""
    rows = new.withColumn("chunk_id", F.explode("chunk_ids")).drop("chunk_ids")
    return acl.unionByName(rows, allowMissingColumns=True)


def remove_acl(acl: DataFrame, ids: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """Remove rules by acl_id, or all rules of (kb_id, document_id)."""
    if ids is not None:
        acl = acl.join(ids.select("acl_id").distinct(), "acl_id", "left_anti")
    if documents is not None:
        acl = acl.join(documents.select("kb_id", "document_id").distinct(), ["kb_id", "document_id"], "left_anti")
    return acl


def grant_folder_acl(acl: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the rules of (kb, folder, subject) by the new ones; asking twice changes nothing more."""
    cleaned = new.withColumn("subject_id", F.trim("subject_id")).where("subject_id <> ''")
    key = ["kb_id", "folder_id", "subject_type", "subject_id"]
    return acl.join(cleaned.select(*key).distinct(), key, "left_anti").select(acl.columns).unionByName(
        cleaned, allowMissingColumns=True)


def revoke_folder_acl(acl: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove rules by (kb_id, folder_id, acl_id)."""
    key = ["kb_id", "folder_id", "acl_id"]
    return acl.join(ids.select(*key).distinct(), key, "left_anti").select(acl.columns)


def list_folder_acls(acl: DataFrame, folders: DataFrame) -> DataFrame:
    """Rules of the given folders (kb_id, folder_id), newest first."""
    return acl.join(folders.select("kb_id", "folder_id").distinct(), ["kb_id", "folder_id"], "left_semi").orderBy(
        F.desc("acl_id"))


def list_acl(acl: DataFrame, kb_id: int, document_id: str | None = None) -> DataFrame:
    """Rules of a collection, or of one document in it, newest first, with their scope."""
    rows = acl.where(F.col("kb_id") == kb_id)
    if document_id:
        rows = rows.where(F.col("document_id") == document_id)
    scope = (F.when(_given("chunk_id").isNotNull(), "chunk").when(_given("document_id").isNotNull(), "document")
             .when(_given("folder_id").isNotNull(), "folder").otherwise("knowledge_base"))
    return rows.withColumn("scope", scope).orderBy(F.desc("acl_id"))


def list_permissions(grants: DataFrame, users: DataFrame, kb_id: int | None = None) -> DataFrame:
    """Grants with the names of their users; the user may be gone."""
    rows = grants if kb_id is None else grants.where(F.col("kb_id") == kb_id)
    return rows.join(users.select("user_id", "username", "role"), "user_id", "left")


def grant_candidates(users: DataFrame, grants: DataFrame, kb_id: int, keyword: str | None = None) -> DataFrame:
    """Active users with a flag for those who hold a grant already."""
    from grantseek.functions.text import like_filter
    rows = users.where("is_active")
    if keyword:
        match = like_filter(F.col("username"), keyword)
        if "display_name" in users.columns:
            match = match | like_filter(F.col("display_name"), keyword)
        rows = rows.where(match)
    held = grants.where(F.col("kb_id") == kb_id).select("user_id", F.lit(True).alias("_held")).distinct()
    return rows.join(held, "user_id", "left").withColumn("granted", F.coalesce("_held", F.lit(False))).drop("_held")
