import random

import pytest

from grantseek.functions import arrow
from grantseek.operators import chunking


def test_short_text_is_one_piece():
    assert list(arrow.cut_pieces("  hello  ", 400)) == ["hello"]
    assert list(arrow.cut_pieces("   ", 400)) == []


def test_pieces_keep_their_separator():
    assert list(arrow.cut_pieces("aaaa。bbbb。cc", 6)) == ["aaaa。", "bbbb。", "cc"]
    assert list(arrow.cut_pieces("one two three", 5)) == ["one ", "two ", "three"]


def test_hard_cut_when_nothing_separates():
    assert [len(p) for p in arrow.cut_pieces("x" * 1000, 400)] == [400, 400, 200]


def test_merge_carries_the_tail():
    chunks = arrow.split_text("0123456789 " * 10, 44, 11, 5)
    assert chunks[0] == ("0123456789 " * 4).strip()
    assert all(c.startswith("0123456789") for c in chunks)
    assert len(chunks) == 3 or len(chunks) == 4


def test_overlap_is_dropped_when_it_does_not_fit():
    assert arrow.split_text("a" * 100, 40, 10, 5) == ["a" * 40, "a" * 40, "a" * 30]


def test_short_last_chunk_joins_the_one_before():
    assert arrow.split_text("a" * 90, 40, 0, 24) == ["a" * 40, "a" * 50]


@pytest.mark.parametrize("seed", range(20))
def test_invariants_on_random_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice("ab。，\n .;") for _ in range(rng.randrange(1, 3000)))
    size, overlap, least = rng.choice([20, 50, 400]), rng.choice([0, 5, 80]), rng.choice([1, 10, 24])
    chunks = arrow.split_text(text, size, overlap, least)
    assert all(len(c) <= size for c in chunks[:-1])
    assert all(len(c) <= size + least - 1 for c in chunks[-1:])
    if overlap and overlap < least:
        return  # a short last chunk then repeats its tail where it joins the one before
    flat = "".join(text.split())
    assert all("".join(c.split()) in flat for c in chunks)


def test_sections_pages_and_ordinals(spark):
    rows = [("d", [("一" * 900, 1), ("", 2), ("short", 7)])]
    df = spark.createDataFrame(rows, "document_id string, sections array<struct<text:string,page:int>>")
    out = chunking.chunk_sections(df).orderBy("ordinal").collect()
    assert [(r["chunk_id"], r["page"], r["tokens"]) for r in out] == [
        ("d-0000", 1, 400), ("d-0001", 1, 400), ("d-0002", 1, 180), ("d-0003", 7, 1)]


def test_size_zero_and_min_zero_fall_back(spark):
    df = spark.createDataFrame([("d", [("x" * 410, None)])], "document_id string, sections array<struct<text:string,page:int>>")
    assert chunking.chunk_sections(df, 0, 0, 0).count() == 1  # 400 + 10, and 10 < 24 joins


def test_hard_chunks(spark):
    df = spark.createDataFrame([("a", " " + "x" * 10), ("b", "  ")], "id string, text string")
    out = chunking.hard_chunks(df, "text", 4).orderBy("ordinal").collect()
    assert [(r["id"], r["content"]) for r in out] == [("a", "xxxx"), ("a", "xxxx"), ("a", "xx")]


def test_few_texts_are_python_objects_at_once():
    """An Arrow batch of any size is cut slab by slab."""
    import pyarrow as pa
    seen = []

    def fn(part):
        seen.append(len(part))
        return pa.array([[v] for v in part.to_pylist()], pa.list_(pa.string()))
    rows = [str(i) for i in range(2 * arrow.SLAB + 1)]
    out = arrow._by_slab(pa.array(rows), pa.list_(pa.string()), fn)
    assert out.to_pylist() == [[v] for v in rows] and max(seen) == arrow.SLAB
    assert arrow._by_slab(pa.array([], pa.string()), pa.list_(pa.string()), fn).to_pylist() == []


def test_slabs_join_to_whole_batches(spark):
    texts = [None if i % 9 == 0 else f"word{i} " * (i % 70) for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "document_id long, body string").coalesce(1)
    got = {r["document_id"]: r["pieces"] for r in chunking.recursive_split(rows, "body", 50).collect()}
    assert got == {i: None if t is None else list(arrow.cut_pieces(t, 50)) for i, t in enumerate(texts)}
    section = "array(struct(body as text, cast(null as int) as page)) as sections"
    cut = chunking.chunk_sections(rows.selectExpr("cast(document_id as string) as document_id", section), 50, 10, 5).collect()
    assert sorted((int(r["document_id"]), r["ordinal"], r["content"]) for r in cut) == [
        (i, n, c) for i, t in enumerate(texts) for n, c in enumerate(arrow.split_text(t or "", 50, 10, 5))]


def test_merge_overlap_bears_a_document_without_text(spark, tmp_path):
    """A text of blanks has no chunk, hence no last one; long texts are squeezed once, not once a chunk."""
    from workload.registry import QUERIES
    rows = [(0, "some words. " * 200, "en", "web", 2400), (1, "  \n ", "en", "web", 4), (2, None, "en", "web", 0), (3, "short", "en", "web", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(25).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    import workload.q_text  # noqa: F401
    found = QUERIES["c2_merge_overlap"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(str(i), True, True, True) for i in range(4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("regexp_replace(body" not in part.split(") AS ")[0] for part in plan.split("lambdafunction(")[1:])
