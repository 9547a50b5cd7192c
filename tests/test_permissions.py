"""Decisions against a slow, obvious version written for one user at a time."""

import random

import pytest
from pyspark.sql import functions as F

from grantseek.operators import folders as tree
from grantseek.operators import permissions as perm
from grantseek.plans.retrieval import Catalogue, resolve, resolve_classes, resolve_found

USER = "user_id bigint, username string, role string, tags array<string>, is_active boolean"
KB = "kb_id bigint, dataset_id string, name string, is_active boolean"
GRANT = "user_id bigint, kb_id bigint, can_read boolean, can_upload boolean, can_manage boolean"
FOLDER = "folder_id bigint, kb_id bigint, parent_id bigint, name string, visibility string, sort_order bigint"
DOC = "document_id string, kb_id bigint, folder_id bigint, visibility string, name string"
ACL = "acl_id bigint, kb_id bigint, subject_type string, subject_id string, document_id string, chunk_id string, folder_id bigint, effect string"


def catalogue(spark, users, kbs, grants, folders, docs, acl):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Catalogue(make(users, USER), make(kbs, KB), make(grants, GRANT), make(folders, FOLDER), make(docs, DOC), make(acl, ACL))


def slow_scope(user, kbs, grants, folders, docs, acl):
    """Visible documents, allowed, denied and whitelisted things of one user."""
    uid, _name, role, tags, _active = user
    admin = role == "admin"
    mine = {k[0] for k in kbs if k[3] and (admin or any(g[0] == uid and g[1] == k[0] and g[2] for g in grants))}
    tree_of = {f[0]: f for f in folders if f[1] in mine}

    def up(folder):
        seen = []
        while folder is not None and folder not in seen:
            seen.append(folder)
            folder = tree_of[folder][2] if folder in tree_of else None
        return seen
    who = {("user", str(uid)), ("role", role)} | {("tag", t) for t in tags}
    rules = [a for a in acl if a[1] in mine and (a[2], a[3]) in who]
    chunk = [a for a in rules if a[5]]
    doc = [a for a in rules if not a[5] and a[4]]
    fold = [a for a in rules if not a[5] and not a[4] and a[6]]
    whole = [a for a in rules if not a[5] and not a[4] and not a[6]]
    pick = lambda rs, i, e: {a[i] for a in rs if a[7] == e}
    visible = {}
    for did, kb, fid, vis, _n in docs:
        if kb not in mine:
            continue
        chain = up(fid)
        f_deny = any(c in pick(fold, 6, "deny") for c in chain)
        f_allow = any(c in pick(fold, 6, "allow") for c in chain)
        shut = any(tree_of[c][4] == "restricted" for c in chain if c in tree_of)
        if did in pick(doc, 4, "deny") or kb in pick(whole, 1, "deny"):
            visible[did] = False
        elif did in pick(doc, 4, "allow") or kb in pick(whole, 1, "allow"):
            visible[did] = True
        elif f_deny:
            visible[did] = False
        elif admin:
            visible[did] = True
        elif fid is not None and (fid not in tree_of or (shut and not f_allow)):
            visible[did] = False
        elif f_allow:
            visible[did] = True
        else:
            visible[did] = vis == "public"
    return visible, pick(chunk, 5, "allow"), pick(chunk, 5, "deny"), {a[4] for a in chunk if a[7] == "allow" and a[4]}


def slow_chunk(scope, chunk, document):
    visible, allowed, denied, white = scope
    if chunk in denied:
        return False
    if chunk in allowed:
        return True
    return document not in white and visible.get(document, False)


def random_tables(seed):
    rng = random.Random(seed)
    kbs = [(k, f"ds{k}", f"kb{k}", k != 3) for k in range(4)]
    users = [(u, f"u{u}", rng.choice(["admin", "user", "user", "collaborator"]), rng.sample(["a", "b", "c"], rng.randrange(3)), True) for u in range(8)]
    grants = [(u, k, rng.random() < 0.8, False, False) for u in range(8) for k in range(4) if rng.random() < 0.7]
    folders = []
    for f in range(1, 25):
        kb = rng.randrange(4)
        parents = [x[0] for x in folders if x[1] == kb]
        folders.append((f, kb, rng.choice(parents + [None]) if parents else None, f"f{f}", rng.choice(["public"] * 4 + ["restricted"]), 0))
    docs = []
    for d in range(60):
        kb = rng.randrange(4)
        home = [x[0] for x in folders if x[1] == kb] + [None]
        docs.append((f"d{d}", kb, 999 if d == 0 else rng.choice(home), rng.choice(["public", "public", "restricted"]), f"doc{d}"))
    acl = []
    for a in range(120):
        kind, who = rng.choice([("user", str(rng.randrange(8))), ("role", rng.choice(["admin", "user", "collaborator"])), ("tag", rng.choice("abc"))])
        level, doc, fold = rng.random(), rng.choice(docs), rng.choice(folders)
        effect = rng.choice(["allow", "deny"])
        if level < 0.3:
            acl.append((a, doc[1], kind, who, doc[0] if rng.random() < 0.9 else "", f"{doc[0]}-000{rng.randrange(2)}", None, effect))
        elif level < 0.6:
            acl.append((a, doc[1], kind, who, doc[0], "", 0, effect))
        elif level < 0.95:
            acl.append((a, fold[1], kind, who, None, None, fold[0], effect))
        else:
            acl.append((a, rng.randrange(4), kind, who, None, None, None, effect))
    return users, kbs, grants, folders, docs, acl


@pytest.mark.parametrize("seed", range(4))
def test_against_the_slow_version(spark, seed):
    tables = random_tables(seed)
    cat = catalogue(spark, *tables)
    r = resolve(perm.user_scopes(cat.users), cat)
    users, docs = tables[0], tables[4]
    slow = {u[0]: slow_scope(u, *tables[1:]) for u in users}

    decided = {(x["scope_id"], x["document_id"]): x["visible"] for x in perm.document_visibility(**r.decide()).collect()}
    assert decided == {(u, d): v for u, s in slow.items() for d, v in s[0].items()}

    listed = {(s, x["document_id"]) for x in perm.audience(**r.listing()).collect() for s in x["audience"]}
    known = {d[0] for d in docs}
    want = {(u, d) for u, s in slow.items() for d in ({k for k, v in s[0].items() if v} | (s[3] & known))}
    assert listed == want

    counts = {x["scope_id"]: x["n_visible"] for x in perm.visible_counts(**r.listing()).collect() if x["n_visible"]}
    assert counts == {u: sum(s[0].values()) for u, s in slow.items() if any(s[0].values())}

    totals = resolve_classes(perm.user_scopes(cat.users), cat).visible_counts().collect()
    assert {x["scope_id"]: x["n_visible"] for x in totals if x["n_visible"]} == counts

    chunks = [(u[0], f"{d[0]}-000{i}", d[0]) for u in users for d in docs for i in range(2)]
    found = spark.createDataFrame(chunks, "scope_id bigint, chunk_id string, document_id string")
    seen = {(x["scope_id"], x["chunk_id"]): x["visible"] for x in perm.chunk_visibility(found, **r.decide()).collect()}
    assert seen == {(u, c): slow_chunk(slow[u], c, d) for u, c, d in chunks}

    matrix = {}
    for x in perm.visibility_matrix(**r.listing()).collect():
        if x["decided_by"] in perm.SHOWN_BY:
            matrix[x["document_id"]] = matrix.get(x["document_id"], 0) + x["n_scopes"]
    assert matrix == {d: n for d in known if (n := sum(s[0].get(d, False) for s in slow.values()))}

    stats = {x["scope_id"]: x for x in perm.scope_stats(r.scopes, documents=cat.documents, **r.listing()).collect()}
    listing = perm.folder_visibility(r.access, r.places, r.hits).groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("visible").alias("v"), F.count_if("granted").alias("g"))
    for x in listing.collect():
        s = stats[x["scope_id"]]
        assert (s["total_folders"], s["visible_folders"], s["folder_granted"]) == (x["n"], x["v"], x["g"])
    for u, s in slow.items():
        assert stats[u]["visible_documents"] == sum(s[0].values())
        assert stats[u]["searchable_documents"] == len({k for k, v in s[0].items() if v} | s[3])


def test_classes_of_many_users_equal_scopes(spark):
    """Rules written for another collection than that of their target, and users who share everything."""
    users, kbs, grants, folders, docs, acl = random_tables(11)
    users = users + [(u, f"u{u}", "user", ["a"], True) for u in range(8, 60)]
    grants = grants + [(u, k, True, False, False) for u in range(8, 60) for k in range(3) if (u + k) % 3]
    rng = random.Random(5)
    acl = [(*a[:1], rng.randrange(4) if rng.random() < 0.3 else a[1], *a[2:]) for a in acl]
    cat = catalogue(spark, users, kbs, grants, folders, docs, acl)
    scopes = perm.user_scopes(cat.users)
    r, by_class = resolve(scopes, cat), resolve_classes(scopes, cat)
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    assert rows(by_class.visible_counts().where("n_visible > 0")) == rows(
        perm.visible_counts(**r.listing()).where("n_visible > 0"))
    assert rows(by_class.folder_counts()) == rows(
        perm.folder_counts_of(r.access, r.places, r.hits))
    assert by_class.of.access.count() < r.access.count() / 2


def test_scope_rules_by_hand(spark):
    """The worked case: one document with an allowed chunk, a denied chunk, a hidden document."""
    users = [(1, "u", "user", [], True), (2, "boss", "admin", [], True)]
    kbs = [(1, "ds1", "kb", True)]
    docs = [("docA", 1, None, "public", "A"), ("docB", 1, None, "restricted", "B"), ("docC", 1, None, "public", "C")]
    acl = [(1, 1, "user", "1", "docA", "docA-0001", None, "allow"), (2, 1, "user", "1", "docC", "docC-0000", None, "deny"),
           (3, 1, "role", "admin", "docC", None, None, "deny")]
    cat = catalogue(spark, users, kbs, [(1, 1, True, False, False)], [], docs, acl)
    r = resolve(perm.user_scopes(cat.users), cat)
    found = spark.createDataFrame([(u, c, c[:4]) for u in (1, 2) for c in ("docA-0000", "docA-0001", "docB-0000", "docC-0000", "docC-0001")],
                                  "scope_id bigint, chunk_id string, document_id string")
    seen = {(x["scope_id"], x["chunk_id"]) for x in perm.permission_filter(found, **r.decide()).collect()}
    assert seen == {(1, "docA-0001"), (1, "docC-0001"), (2, "docA-0000"), (2, "docA-0001"), (2, "docB-0000")}


def test_requested_collections(spark):
    cat = catalogue(spark, [(1, "u", "user", [], True)], [(1, "a", "a", True), (2, "b", "b", True), (3, "c", "c", True)],
                    [(1, 1, True, True, True), (1, 2, True, False, False)], [], [], [])
    asked = spark.createDataFrame([(10, 1, [1, 3]), (11, 1, None), (12, 1, [3, 1, 1]), (13, 1, [])], "query_id bigint, user_id bigint, kb_ids array<bigint>")
    scoped = perm.assign_scopes(asked)
    ids = {r["query_id"]: r["scope_id"] for r in scoped.collect()}
    assert ids[10] == ids[12] == 10 and ids[11] == ids[13] == 11
    held = perm.requested_scope(perm.scopes_of(scoped, cat.users), cat.kbs, cat.grants)
    assert sorted((r["scope_id"], r["kb_id"]) for r in held.collect()) == [(10, 1), (11, 1), (11, 2)]


def test_closure_survives_cycles_and_missing_parents(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, 8), (8, 9), (9, 7), (10, 7), (11, 11)]
    df = spark.createDataFrame(rows, "folder_id bigint, parent_id bigint")
    got = {}
    for r in tree.ancestor_closure(df).collect():
        got.setdefault(r["folder_id"], {})[r["ancestor_id"]] = r["distance"]
    assert got[5] == {5: 0, 4: 1, 3: 2, 2: 3, 1: 4}
    assert got[6] == {6: 0}
    assert got[7] == {7: 0, 8: 1, 9: 2}
    assert got[10] == {10: 0, 7: 1, 8: 2, 9: 3}
    assert got[11] == {11: 0}


def test_paths_and_moves(spark):
    rows = [(3, 1, None), (7, 1, 3), (12, 1, 7), (5, 1, None), (20, 2, None)]
    df = spark.createDataFrame([(f, k, p, f"n{f}", "public", 0) for f, k, p in rows], FOLDER)
    closure = tree.ancestor_closure(df)
    folders = tree.materialize_paths(df, closure)
    assert {r["folder_id"]: (r["path"], r["depth"]) for r in folders.collect()} == {
        3: ("/", 0), 7: ("/3/", 1), 12: ("/3/7/", 2), 5: ("/", 0), 20: ("/", 0)}
    moves = spark.createDataFrame([(7, 5), (3, 12), (5, 20)], "folder_id bigint, new_parent_id bigint")
    moved = {r["folder_id"]: (r["parent_id"], r["path"], r["depth"]) for r in tree.move_folder(folders, moves, closure).collect()}
    assert moved[7] == (5, "/5/", 1) and moved[12] == (7, "/5/7/", 2)
    assert moved[3] == (None, "/", 0) and moved[5] == (None, "/", 0)


def test_create_folders(spark):
    folders = spark.createDataFrame([(1, 1, None, "a", "/", 0), (2, 1, 1, "b", "/1/", 1)], "folder_id bigint, kb_id bigint, parent_id bigint, name string, path string, depth int")
    new = spark.createDataFrame([(10, 1, None, " a "), (11, 1, 1, "c"), (12, 2, 1, "c"), (13, 1, None, " ")], "folder_id bigint, kb_id bigint, parent_id bigint, name string")
    ok, bad = tree.create_folders(folders, new)
    assert [(r["folder_id"], r["path"], r["depth"]) for r in ok.collect()] == [(11, "/1/", 1)]
    assert {r["folder_id"] for r in bad.collect()} == {10, 12, 13}


def test_rules_on_collections_make_no_class_of_their_own(spark):
    """However many users hold a rule on a whole collection, there are at most four classes of a collection and role."""
    users = [(u, f"u{u}", "user", ["a"], True) for u in range(40)]
    grants = [(u, 0, True, False, False) for u in range(40)]
    docs = [(f"d{d}", 0, None, "public" if d % 2 else "restricted", f"doc{d}") for d in range(6)]
    acl = [(u, 0, "user", str(u), None, None, None, "deny" if u % 3 else "allow") for u in range(30)]
    acl += [(100, 0, "tag", "a", "d1", None, None, "deny"), (101, 0, "role", "user", "d2", None, None, "allow")]
    cat = catalogue(spark, users, [(0, "ds0", "kb0", True)], grants, [], docs, acl)
    scopes = perm.user_scopes(cat.users)
    by_class = resolve_classes(scopes, cat)
    assert by_class.of.access.count() == 3
    want = {u: 3 for u in range(30, 40)} | {u: 5 for u in range(0, 30, 3)}
    assert {r["scope_id"]: r["n_visible"] for r in by_class.visible_counts().collect() if r["n_visible"]} == want


@pytest.mark.parametrize("seed", range(2))
def test_rules_of_what_was_found(spark, seed):
    """Chunks found get the decision of the full resolution, from rules that bear on them alone."""
    users, kbs, grants, folders, docs, acl = random_tables(seed + 20)
    rng = random.Random(seed)
    acl = [(*a[:1], rng.randrange(4) if rng.random() < 0.2 else a[1], *a[2:]) for a in acl]
    cat = catalogue(spark, users, kbs, grants, folders, docs, acl)
    scopes = perm.user_scopes(cat.users)
    some = [(u[0], f"{d[0]}-000{i}", d[0]) for u in users for d in docs for i in range(2) if rng.random() < 0.2]
    found = spark.createDataFrame(some, "scope_id bigint, chunk_id string, document_id string")
    full, part = resolve(scopes, cat), resolve_found(found, scopes, cat)
    rows = lambda r: sorted(tuple(x) for x in perm.chunk_visibility(found, **r.decide()).select("scope_id", "chunk_id", "visible").collect())
    assert rows(part) == rows(full)
    assert part.rules.count() < full.rules.count()


@pytest.mark.parametrize("seed, limit", [(0, 512), (1, 3), (2, 1)])
def test_listings_by_lists_of_scopes(spark, monkeypatch, seed, limit):
    """Trees, chunks and facts of all scopes, also when the scopes are dealt into several passes."""
    monkeypatch.setattr(perm, "PASS_QUERIES", limit)
    tables = random_tables(seed)
    cat = catalogue(spark, *tables)
    r = resolve(perm.user_scopes(cat.users), cat)
    closure = tree.ancestor_closure(cat.folders)
    shown = lambda access: sorted((x["scope_id"], x["folder_id"], x["doc_count"]) for x in tree.folder_tree(
        cat.folders, cat.documents, cat.acl, closure, access).collect())
    seen = perm.folder_visibility(r.access, r.places, r.hits)
    assert shown(perm.open_folders(r.access, r.places, r.hits, closure)) == shown(seen)
    assert max(len(x["scopes"]) for x in perm.open_folders(r.access, r.places, r.hits, closure).collect()) <= max(limit, 8)

    chunks = cat.documents.select(F.concat("document_id", F.lit("-0001")).alias("chunk_id"), "document_id", "kb_id")
    found = chunks.join(r.access.select("scope_id", "kb_id"), "kb_id")
    rows = lambda df: sorted(tuple(x) for x in df.select("scope_id", "chunk_id", "kb_id", "visible").collect())
    assert rows(perm.chunk_visibility(chunks, **r.decide())) == rows(perm.chunk_visibility(found, **r.decide()))

    facts = [tuple(x) for x in perm.diagnose(**r.listing()).collect()]
    assert len(facts) == len(set(facts))
    kinds = lambda df, kind, item: {(x["scope_id"], kind, str(x[item])) for x in df.collect()}
    decided = perm.document_visibility(**r.decide())
    want = set()
    for df, item in ((decided, "document_id"), (seen, "folder_id")):
        name = item[:-3]
        want |= kinds(df.where("visible"), f"visible_{name}", item) | kinds(df.where("NOT visible"), f"hidden_{name}", item)
    want |= kinds(seen.where("granted"), "granted_folder", "folder_id")
    assert {f for f in facts if "chunk" not in f[1] and f[1] != "whitelist_document"} == want


def test_facts_of_repeated_rows(spark):
    """A document in two collections, and rows that stand twice, give each fact once."""
    users, kbs, grants, folders, docs, acl = random_tables(3)
    docs = docs + docs[:20] + [(docs[5][0], (docs[5][1] + 1) % 3, None, "public", "x")]
    cat = catalogue(spark, users, kbs, grants + grants[:9], folders + folders[:7], docs, acl)
    r = resolve(perm.user_scopes(cat.users), cat)
    facts = [tuple(x) for x in perm.diagnose(**r.listing()).collect()]
    assert len(facts) == len(set(facts))
    of_documents = {f for f in facts if f[1] in ("visible_document", "hidden_document")}
    assert of_documents == {(x["scope_id"], "visible_document" if x["visible"] else "hidden_document", x["document_id"])
                            for x in perm.document_visibility(**r.decide()).collect()}


def test_folder_listing_is_not_shuffled(spark):
    """Folders and rules are shuffled, their product with the scopes is not."""
    cat = catalogue(spark, *random_tables(0))
    r = resolve(perm.user_scopes(cat.users), cat)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = perm.folder_visibility(r.access, r.places, r.hits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" in plan and "hashpartitioning(scope_id" not in plan
