"""Questions in, citations out: a batch of requests as one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantseek.common import THRESHOLD, TOP_K, TOP_N, VECTOR_WEIGHT, cut_lineage, split_passes
from grantseek.functions import text
from grantseek.operators import folders as tree
from grantseek.operators import hybrid, lexical
from grantseek.operators import permissions as perm

# Why a request has no citations, in the order the reasons are checked.
NO_KB = "no readable collection"
NO_DOCUMENT = "no visible document"
NO_QUESTION = "empty question"
NOTHING_FOUND = "nothing found"


@dataclass(frozen=True)
class Catalogue:
    """The tables permission decisions are made from."""

    users: DataFrame
    kbs: DataFrame
    grants: DataFrame
    folders: DataFrame
    documents: DataFrame
    acl: DataFrame
    # ancestor_closure and folder_places, if stored; they change only when folders do.
    closure: DataFrame | None = None
    places: DataFrame | None = None


@dataclass(frozen=True)
class Resolved:
    """What a batch of scopes may use: see the permission operators for the columns."""

    scopes: DataFrame
    access: DataFrame
    rules: DataFrame
    hits: DataFrame
    places: DataFrame
    placed: DataFrame

    def decide(self) -> dict[str, DataFrame]:
        """Arguments of a decision about documents."""
        return {"placed": self.placed, "access": self.access, "hits": self.hits, "rules": self.rules}

    def listing(self) -> dict[str, DataFrame]:
        """Arguments of a listing over folders and documents."""
        return self.decide() | {"places": self.places}


def resolve(scopes: DataFrame, cat: Catalogue) -> Resolved:
    """Collections, rules and folders of every scope. What is read many times is written once."""
    closure = tree.ancestor_closure(cat.folders) if cat.closure is None else cat.closure
    scope_kbs = cut_lineage(perm.requested_scope(scopes, cat.kbs, cat.grants))
    rules = cut_lineage(perm.applicable_rules(scopes, scope_kbs, cat.acl))
    hits = cut_lineage(perm.folder_hits(rules, closure))
    places = perm.folder_places(cat.folders, closure) if cat.places is None else cat.places
    access = cut_lineage(perm.kb_access(scope_kbs, rules))  # of a known size: a row for each scope and collection
    return Resolved(scopes, access, rules, hits, places, perm.placed_documents(cat.documents, places))


def resolve_found(found: DataFrame, scopes: DataFrame, cat: Catalogue) -> Resolved:
    """``resolve`` as far as decisions about chunks found (scope_id, chunk_id, document_id) need it: its rules and hits are of those only."""
    closure = tree.ancestor_closure(cat.folders) if cat.closure is None else cat.closure
    places = perm.folder_places(cat.folders, closure) if cat.places is None else cat.places
    scope_kbs = cut_lineage(perm.requested_scope(scopes, cat.kbs, cat.grants))
    placed = perm.placed_documents(cat.documents, places)
    rules, hits = (cut_lineage(df) for df in perm.found_rules(found, scopes, scope_kbs, cat.acl, placed, closure))
    return Resolved(scopes, perm.kb_access(scope_kbs, rules), rules, hits, places, placed)


@dataclass(frozen=True)
class Classes:
    """Scopes grouped by the rules they share: ``of`` decides per class, the scopes' own rules correct that."""

    members: DataFrame
    of: Resolved
    own_rules: DataFrame
    own_hits: DataFrame

    def visible_counts(self) -> DataFrame:
        """(scope_id, n_visible), as ``permissions.visible_counts`` gives it."""
        own = perm.own_visible_counts(self.members, **self.of.listing(), own_hits=self.own_hits, own=self.own_rules)
        return perm.total_by_scope(self.members, perm.visible_counts(**self.of.listing()), own)

    def folder_counts(self) -> DataFrame:
        """As ``permissions.folder_counts_of`` gives it."""
        where = (self.of.places, self.of.access, self.of.hits)
        return perm.total_by_scope(self.members, perm.folder_counts_of(where[1], where[0], where[2]),
                                   perm.own_folder_counts(self.members, *where, self.own_hits))


def resolve_classes(scopes: DataFrame, cat: Catalogue) -> Classes:
    """``resolve`` for very many scopes, such as all users of a system: counts over documents and folders.

    Rules of a role or tag meet the few classes they bear on, not every user of the role. Rules of one user on folders
    and documents are kept beside and correct what that user's class sees; those on a whole collection are two flags of the
    class, so the number of classes doesn't grow with the users.
    """
    closure = tree.ancestor_closure(cat.folders) if cat.closure is None else cat.closure
    places = perm.folder_places(cat.folders, closure) if cat.places is None else cat.places
    scope_kbs = cut_lineage(perm.requested_scope(scopes, cat.kbs, cat.grants))
    signed = cut_lineage(perm.access_signatures(scopes, scope_kbs, cat.acl, closure, places, cat.documents))
    classes, members = perm.access_classes(signed)
    rules = cut_lineage(perm.class_rules(classes, cat.acl))
    hits = cut_lineage(perm.folder_hits(rules, closure))
    own = cut_lineage(perm.own_rules(scopes, scope_kbs, cat.acl))
    own_hits = cut_lineage(perm.folder_hits(own, closure))
    access = perm.class_access(classes, rules)
    decided = Resolved(classes.select("scope_id"), access, rules, hits, places, perm.placed_documents(cat.documents, places))
    return Classes(members, decided, own, own_hits)


def empty_reason(requests: DataFrame, access: DataFrame, searchable: DataFrame, kept: DataFrame) -> DataFrame:
    """(query_id, reason): null where there are citations.

    searchable: scope_id of scopes with at least one document to search.
    kept: query_id of requests with citations.
    """
    has_kb = access.select("scope_id").distinct().withColumn("_kb", F.lit(True))
    has_doc = searchable.select("scope_id").distinct().withColumn("_doc", F.lit(True))
    has_hit = kept.select("query_id").distinct().withColumn("_hit", F.lit(True))
    rows = requests.select("query_id", "scope_id", text.strip(F.coalesce("question", F.lit(""))).alias("_q"))
    rows = rows.join(has_kb, "scope_id", "left").join(has_doc, "scope_id", "left").join(has_hit, "query_id", "left")
    reason: Column = (F.when(F.col("_kb").isNull(), NO_KB).when(F.col("_doc").isNull(), NO_DOCUMENT)
                      .when(F.col("_q") == "", NO_QUESTION).when(F.col("_hit").isNull(), NOTHING_FOUND))
    return rows.select("query_id", reason.alias("reason"))


def searchable_scopes(listed: DataFrame, rules: DataFrame) -> DataFrame:
    """Scopes with at least one document to search; ``listed`` is the audience of every document."""
    shown = listed.select(F.explode("audience").alias("scope_id")).distinct()
    return shown.unionByName(perm.opened_documents(rules).select("scope_id")).distinct()


def retrieve(
    requests: DataFrame, cat: Catalogue, chunks: DataFrame, postings: DataFrame, stats: lexical.CorpusStats, *,
    top: int = TOP_K, top_n: int = TOP_N, weight: float = VECTOR_WEIGHT, threshold: float = THRESHOLD,
    final_threshold: float | None = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(summary, citations) for requests: query_id, user_id, question, qvec, optionally kb_ids and model.

    summary: query_id, raw_candidates, dropped_by_permission, kept, reason.
    A pass of requests is resolved at a time, so the scopes listed beside a
    document are at most one pass long.
    """
    if cat.closure is None:
        cat = replace(cat, closure=tree.ancestor_closure(cat.folders))
    summary = cited = None
    for part in split_passes(requests, "query_id"):
        s, c = _retrieve_pass(part, cat, chunks, postings, stats, top, top_n, weight, threshold, final_threshold)
        summary = s if summary is None else summary.unionByName(s)
        cited = c if cited is None else cited.unionByName(c)
    return summary, cited


def _retrieve_pass(requests, cat, chunks, postings, stats, top, top_n, weight, threshold, final_threshold):
    asked = cut_lineage(perm.assign_scopes(requests))
    resolved = resolve(perm.scopes_of(asked, cat.users), cat)
    listed = cut_lineage(perm.audience(**resolved.listing()))
    live = asked.where(F.length(text.strip(F.col("question"))) > 0)
    picked = hybrid.hybrid_pass(chunks, postings, live, stats, listed, top, weight, threshold)
    # Written once, without text: the counts and the citations both read it. A chunk
    # is picked once per request, so there is nothing to de-duplicate.
    judged = cut_lineage(perm.chunk_visibility(
        picked.join(F.broadcast(live.select("query_id", "scope_id")), "query_id"), **resolved.decide()))
    best = hybrid.final_rank(judged.where("visible"), top_n, final_threshold)
    cited = hybrid.citations(hybrid.late_fetch(best, chunks), cat.documents, cat.kbs)

    counts = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_raw"), F.count_if(~F.col("visible")).alias("_dropped"))
    kept = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_kept"))
    reasons = empty_reason(asked, resolved.access, searchable_scopes(listed, resolved.rules), best)
    zero = lambda c: F.coalesce(c, F.lit(0))
    summary = reasons.join(counts, "query_id", "left").join(kept, "query_id", "left").select(
        "query_id", zero("_raw").alias("raw_candidates"), zero("_dropped").alias("dropped_by_permission"),
        zero("_kept").alias("kept"), "reason")
    return summary, cited


def retrieval_preview(*args, **kwargs) -> DataFrame:
    """The whole answer per request in one row, citations nested (at most top_n)."""
    summary, cited = retrieve(*args, **kwargs)
    fields = [c for c in cited.columns if c != "query_id"]
    nested = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("citations"))
    return summary.join(nested, "query_id", "left")
