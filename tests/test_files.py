import json
import os

from pyspark.sql import functions as F

from grantseek.operators import catalog, embedding, hybrid, lexical
from grantseek.functions import arrow
from grantseek.plans import ingest
from grantseek.sources import audit, files, index


def sample(folder):
    data = {
        "a.txt": "纯文本。第二句。".encode("gb18030"), "b.MD": b"# Title\n\nBody", "sub/c.html": b"<p>Hi</p><script>no()</script>",
        "d.csv": 'x ,"a, b"\n,\ny,z\n'.encode(), "e.json": '{"k": "值"}'.encode(), "f.doc": b"old", "g.pdf": b"%PDF",
        "h.txt": b"", "i.txt": b" \n\t ", "j.exe": b"MZ",
    }
    for name, raw in data.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as fh:
            fh.write(raw)


def test_scan_and_parse(spark, tmp_path):
    sample(str(tmp_path))
    scanned = files.scan_files(spark, str(tmp_path))
    names = {r["name"] for r in scanned.select("name").collect()}
    assert names == {"a.txt", "b.MD", "c.html", "d.csv", "e.json", "f.doc", "g.pdf", "h.txt", "i.txt"}
    assert [r["name"] for r in files.validate_files(scanned).where("reject_reason = 'file is empty'").collect()] == ["h.txt"]
    parsed = {r["name"]: r for r in files.parse_documents(scanned).collect()}
    body = {n: "".join(s["text"] for s in r["sections"]) for n, r in parsed.items()}
    assert body["a.txt"] == "纯文本。第二句。"
    assert body["b.MD"] == "# Title\n\nBody"
    assert body["c.html"] == "Hi"
    assert body["d.csv"] == "x | a, b\ny | z"
    assert body["e.json"] == '{\n "k": "值"\n}'
    assert parsed["f.doc"]["state"] == "failed" and "docx" in parsed["f.doc"]["message"]
    assert parsed["i.txt"]["message"] == "file holds no text"
    assert parsed["h.txt"]["state"] == "failed" and parsed["h.txt"]["message"] == "file is empty"
    assert parsed["a.txt"]["char_count"] == 8


def test_bad_files_and_details_cost_no_row(spark):
    deep = b"[" * 200_000
    df = spark.createDataFrame([("deep.json", bytearray(deep)), ("no.json", bytearray(b"{")), ("x.csv", bytearray(b'a,"b')), ("ok.txt", bytearray(b"fine"))], "name string, content binary")
    rows = {r["name"]: r for r in files.parse_documents(df).collect()}
    assert len(rows) == 4 and rows["ok.txt"]["state"] == "parsed"
    details = ["{", "[" * 200_000, '{"a": ' * 90_000, "x" * 3000, '["Token"]', '{"Token": "s", "in": {"PASSWORD": 1, "t": "' + "y" * 3000 + '"}, "l": [{"token": 2}]}', None]
    out = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(details)], "i int, d string").orderBy("i").select(arrow.sanitize_json(F.col("d"))).collect()]
    assert out[0] == "{" and [len(o) for o in out[1:4]] == [2000] * 3 and out[4] == '["Token"]' and out[6] is None
    assert json.loads(out[5]) == {"Token": "***", "in": {"PASSWORD": "***", "t": "y" * 2000 + "…"}, "l": [{"token": 2}]}


def test_texts_are_cleaned_once_whatever_their_format(spark, monkeypatch):
    cleaned, clean = [], files.text.clean_text
    monkeypatch.setattr(files.text, "clean_text", lambda c: (cleaned.append(c), clean(c))[1])
    rows = [("a.html", "<p>x &amp; y</p>"), ("b.csv", "1, 2\n"), ("c.json", "{\"k\": 1}"), ("d.txt", "\ufb01n  &amp; <p>")]
    given = spark.createDataFrame([(n, bytearray(v, "utf-8")) for n, v in rows], "name string, content binary")
    found = {r["name"]: r["sections"][0]["text"] for r in files.parse_documents(given).collect()}
    assert found == {"a.html": "x & y", "b.csv": "1 | 2", "c.json": '{\n "k": 1\n}', "d.txt": "fin &amp; <p>"}
    assert len(cleaned) == 1


def test_explicit_extension_wins(spark):
    df = spark.createDataFrame([("noname", ".TXT", bytearray(b"hi")), ("x.zip", None, bytearray(b"hi")), ("y.txt", "", bytearray(b""))], "name string, ext string, content binary")
    rows = {r["name"]: r for r in files.parse_documents(df).collect()}
    assert {n: r["state"] for n, r in rows.items()} == {"noname": "parsed", "x.zip": "failed", "y.txt": "failed"}
    assert rows["y.txt"]["message"] == "file is empty"


def test_validate_and_identity(spark):
    rows = [("ok.txt", 5), ("bad.exe", 5), ("none", 5), ("../../x.md", 5), ("e.txt", 0), ("big.pdf", 999 * 1024 * 1024)]
    df = files.validate_files(spark.createDataFrame(rows, "name string, size bigint"))
    assert [r["reject_reason"] for r in df.collect()] == [
        None, "extension not allowed", "no extension", None, "file is empty", "file too large"]
    one = files.file_identity(spark.createDataFrame([("a/b.JSON", bytearray(b"abc"))], "name string, content binary")).first()
    assert (one["mime"], one["display_name"]) == ("application/json", "b.JSON")
    assert one["checksum"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def chunk_rows(spark, rows):
    return spark.createDataFrame(
        [(f"{d}-{o:04d}", d, ds, o, c) for d, ds, o, c in rows], "chunk_id string, document_id string, dataset_id string, ordinal int, content string")


def test_replace_on_disk_is_whole_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "index")
    first = chunk_rows(spark, [("a", "x", 0, "a0"), ("a", "x", 1, "a1"), ("b", "x", 0, "b0"), ("c", "y", 0, "c0")])
    index.replace_on_disk(spark, path, first, first, buckets=4)
    new = chunk_rows(spark, [("a", "x", 0, "A0")])
    gone = chunk_rows(spark, [("a", "x", 0, ""), ("c", "y", 0, "")])  # c has no chunk any more
    for _ in range(2):
        index.replace_on_disk(spark, path, new, gone, buckets=4)
        left = {r["chunk_id"]: r["content"] for r in index.read_index(spark, path).collect()}
        assert left == {"a-0000": "A0", "b-0000": "b0"}


def test_dataset_ids_that_look_like_numbers(spark, tmp_path):
    path = str(tmp_path / "index")
    first = chunk_rows(spark, [(d, ds, 0, f"{ds}/{d}") for ds in ("007", "7", "1e5", "2024-01-01") for d in ("d1", "d2")])
    index.replace_on_disk(spark, path, first, first, buckets=2)
    for _ in range(2):
        index.replace_on_disk(spark, path, chunk_rows(spark, [("d1", "007", 0, "new")]), chunk_rows(spark, [("d1", "007", 0, ""), ("d2", "1e5", 0, "")]), buckets=2)
        left = sorted((r["dataset_id"], r["document_id"], r["content"]) for r in index.read_index(spark, path).collect())
        assert left == sorted([("007", "d1", "new"), ("007", "d2", "007/d2"), ("1e5", "d1", "1e5/d1")] + [(ds, d, f"{ds}/{d}") for ds in ("7", "2024-01-01") for d in ("d1", "d2")])


def test_scan_index_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "index")
    index.write_index(chunk_rows(spark, [("a", "x", 0, "a0"), ("c", "y", 0, "c0")]), path, buckets=2)
    rows = index.scan_index(index.read_index(spark, path), ["y"])
    assert [r["chunk_id"] for r in rows.collect()] == ["c-0000"]
    assert "PartitionFilters: [dataset_id" in rows._jdf.queryExecution().executedPlan().toString().replace("isnotnull(dataset_id", "dataset_id")


def test_ingest_batch_round_trip(spark, tmp_path):
    sample(str(tmp_path))
    scanned = files.scan_files(spark, str(tmp_path)).withColumns({"document_id": F.col("name"), "dataset_id": F.lit("ds")})
    parsed, chunks = ingest.ingest_documents(scanned)
    status = {r["document_id"]: (r["state"], r["chunk_count"]) for r in ingest.ingest_status(parsed, chunks).collect()}
    assert status["a.txt"] == ("done", 1) and status["g.pdf"] == ("failed", 0)
    stats = lexical.corpus_stats(chunks)
    encode = embedding.hashing_encoder()
    question = embedding.unit_rows(encode(["title body"]))[0].tolist()
    queries = spark.createDataFrame([(1, "title body", question)], "query_id bigint, question string, qvec array<double>")
    best = hybrid.hybrid_search(chunks, lexical.build_postings(chunks), queries, stats).orderBy("hybrid_rank").first()
    assert best["chunk_id"] == "b.MD-0000" and best["similarity"] > 0.9


def test_append_audit(spark, tmp_path):
    path = str(tmp_path / "audit")
    row = [(1, "2024-01-02 03:04:05", {"Token": "t", "a": "b"}, "")]
    df = spark.createDataFrame(row, "log_id bigint, created_at string, detail map<string,string>, error string").withColumn("created_at", F.to_timestamp("created_at"))
    audit.append_audit(df, path)
    audit.append_audit(df, path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 2 and rows[0]["detail"] == {"Token": "***", "a": "b"} and rows[0]["error"] is None
    assert os.path.isdir(os.path.join(path, "day=2024-01-02"))


def test_bulk_register(spark, tmp_path):
    sample(str(tmp_path))
    scanned = files.scan_files(spark, str(tmp_path), files.UPLOAD_EXTS + ("exe",))
    checked = files.file_identity(files.validate_files(scanned))
    rows, counts = catalog.bulk_register(checked, 3, "x, y ,", "https://h/")
    assert {r["success"]: r["files"] for r in counts.collect()} == {True: 8, False: 2}
    one = rows.where("name = 'b.MD'").first()
    assert one["tags"] == ["x", "y"] and one["original_url"] == "https://h/b" and one["source_path"].endswith("b.MD")


def test_empty_files_in_hidden_folders_are_left_out(spark, tmp_path):
    for name in ("a.txt", "_logs/b.txt", ".git/c.txt", "x/_y/z/d.txt", "x/_k=1/e.txt", "x/f.txt", "_g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
        (tmp_path / name).with_suffix(".md").write_bytes(b"full")
    empty = {r["name"] for r in files.scan_files(spark, str(tmp_path)).where("size = 0").collect()}
    full = {r["name"] for r in files.scan_files(spark, str(tmp_path)).where("size > 0").collect()}
    assert empty == {n.replace(".md", ".txt") for n in full} == {"a.txt", "e.txt", "f.txt"}


def test_pages_become_files_of_one_folder(spark, tmp_path):
    """Not a folder each, which would be listed one by one; rows of one page are lines of its file."""
    from workload import q_streams
    pages = spark.createDataFrame([(1, "a"), (2, None), (3, "ü"), (3, "ü"), (40, "")], "page_id long, value string")
    q_streams.page_files(pages, str(tmp_path / "in it"))
    assert {p.name: p.read_text() for p in (tmp_path / "in it").iterdir()} == {
        "page_id=1.txt": "a\n", "page_id=2.txt": "\n", "page_id=3.txt": "ü\nü\n", "page_id=40.txt": "\n"}


def test_files_are_parsed_once_for_a_commit(spark, tmp_path, monkeypatch):
    from grantseek.sources.store import IndexStore
    read, chunk_parsed = [], ingest.chunk_parsed
    monkeypatch.setattr(ingest, "chunk_parsed", lambda parsed, *rest: read.extend(parsed.inputFiles()) or chunk_parsed(parsed, *rest))
    rows = spark.createDataFrame([("d1", "s", "a.txt", bytearray(b"some words")), ("d2", "s", "b.txt", bytearray())],
                                 "document_id string, dataset_id string, name string, content binary")
    status = ingest.load_documents(rows, IndexStore(spark, str(tmp_path / "index"), 2))
    assert {r["document_id"]: r["state"] for r in status.collect()} == {"d1": "done", "d2": "failed"}
    assert read and all(f.endswith(".parquet") for f in read)
