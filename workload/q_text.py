"""Text, file and chunk queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grantseek.common import ensure_checkpoint_dir
from grantseek.functions import text
from grantseek.operators import chunking
from grantseek.sources import files
from workload.registry import query


def d_strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def d_clean(c: str) -> str:
    out = f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '[\\x{{200b}}-\\x{{200f}}\\x{{2028}}\\x{{2029}}\\x{{feff}}]', '', 'g')"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    out = f"regexp_replace({out}, '[ \\t\\x{{3000}}]{{2,}}', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return d_strip(out)


def d_html(c: str) -> str:
    out = f"regexp_replace({c}, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(p|div|br|li|tr|h[1-6]|section|article)\\b[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"),
                         ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return d_clean(out)


@query("x1_clean_text", f"SELECT doc_id, {d_clean('text')} AS body FROM documents")
def _(t):
    return t.documents.select("doc_id", text.clean_text(F.col("text")).alias("body"))


@query("x2_html_to_text", f"SELECT page_id, {d_html('html')} AS body FROM pages")
def _(t):
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("x3_bigrams", """
SELECT page_id, array_to_string(list_transform(range(1, greatest(length(url), 2)), lambda i: substring(url, i, 2)), '|') AS pairs FROM pages""")
def _(t):
    return t.pages.select("page_id", F.array_join(text.bigrams(F.col("url")), "|").alias("pairs"))


@query("x4_lex_tokens", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9A-Za-z_]+'), lambda x: lower(x)))), ' ') AS tokens
FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.array_join(F.array_sort(text.lex_tokens(F.col("text"))), " ").alias("tokens"))


@query("x5_query_tokens", "SELECT query_id, token FROM d_term")
def _(t):
    return t.request.select("query_id", F.explode(text.query_tokens(F.col("question"))).alias("token"))


@query("x6_approx_tokens", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


@query("x7_make_chunk_id", """
SELECT conv_id, turn, concat(CAST(conv_id AS STRING), '-', lpad(CAST(turn AS STRING), 4, '0')) AS chunk_id FROM conversations""")
def _(t):
    return t.conversations.select("conv_id", "turn", text.make_chunk_id(
        F.col("conv_id").cast("string"), F.col("turn")).alias("chunk_id"))


@query("x8_file_names", """
SELECT doc_id, substring(regexp_replace(trim(regexp_extract(name, '[^/]*$')), '[^\\p{L}\\p{N}_\\-. ]', '_', 'g'), 1, 200) AS display_name,
 lower(regexp_extract(name, '(?:^|/)[^/]*[^/.][^/]*\\.([^/.]*)$', 1)) AS ext FROM fx_file""")
def _(t):
    return t.file.select("doc_id", text.safe_display_name(F.col("name")).alias("display_name"),
                         text.file_ext(F.col("name")).alias("ext"))


@query("x9_attachment_text", """
SELECT page_id, substring(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), 1, 20000) AS body FROM pages""")
def _(t):
    return t.pages.select("page_id", text.attachment_text(F.col("html").cast("binary"), F.lit("html")).alias("body"))


@query("x10_build_title", f"""
SELECT message_id, CASE WHEN q = '' THEN '新对话' WHEN length(q) > 30 THEN concat(substring(q, 1, 30), '…') ELSE q END AS title
FROM (SELECT message_id, {d_strip("regexp_replace(content, '\\s+', ' ', 'g')")} AS q FROM fx_message)""")
def _(t):
    return t.message.select("message_id", text.build_title(F.col("content")).alias("title"))


@query("x11_needs_history", """
SELECT message_id, length(content) > 30 OR regexp_matches(content, '它|这个|那个|上述|刚才|继续|还有|他|该') AS needed FROM fx_message""")
def _(t):
    return t.message.select("message_id", text.needs_history(F.col("content")).alias("needed"))


@query("x12_sanitize_detail", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '***' ELSE lang END AS first_value,
 CASE WHEN length(text) > 2000 THEN concat(substring(text, 1, 2000), '…') ELSE text END AS second_value FROM documents""")
def _(t):
    key = F.when(F.col("doc_id") % 2 == 0, "Api_Key").otherwise("lang")
    detail = text.sanitize_detail(F.create_map(key, F.col("lang"), F.lit("note"), F.col("text")))
    return t.documents.select("doc_id", detail[key].alias("first_value"), detail["note"].alias("second_value"))


@query("x13_extract_page", """
SELECT event_id, CASE WHEN user_id % 4 = 3 THEN NULL ELSE CAST(nullif(user_id % 7, 0) AS INT) END AS page FROM events""")
def _(t):
    well_formed = F.format_string("[[0, 12, 3, %d]]", F.col("user_id") % 7)
    positions = F.when(F.col("user_id") % 4 == 3, "[[1, 2, 3]]").otherwise(well_formed)
    return t.events.select("event_id", text.extract_page(positions).alias("page"))


@query("x14_client_ip", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('10.0.', CAST(user_id % 256 AS STRING), '.1')
 WHEN event_id % 3 = 1 THEN event_type WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'host' END AS ip FROM events""")
def _(t):
    e = F.col("event_id")
    forwarded = F.when(e % 3 == 0, F.concat(F.lit(" 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1 , 1.1.1.1")))
    real_ip = F.when(e % 3 == 1, F.concat(F.lit(" "), "event_type"))
    host = F.when(e % 5 != 0, F.lit("host"))
    return t.events.select("event_id", text.client_ip(forwarded, real_ip, host).alias("ip"))


@query("x15_version_key", """
SELECT version_id, array_to_string([coalesce(TRY_CAST(p[1] AS INT), 0), coalesce(TRY_CAST(p[2] AS INT), 0), coalesce(TRY_CAST(p[3] AS INT), 0)], '.') AS key
FROM (SELECT version_id, string_split(split_part(ltrim(version, 'vV'), '-', 1), '.') AS p FROM fx_version)""")
def _(t):
    return t.version.select("version_id", F.array_join(
        text.version_key(F.col("version")).cast("array<string>"), ".").alias("key"))


@query("x16_decode_device_name", """
SELECT token_id, replace(device_name, '%20', ' ') AS device FROM fx_token""")
def _(t):
    return t.token.select("token_id", text.decode_device_name(F.col("device_name")).alias("device"))


@query("x17_like_filter", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%r_nG%'")
def _(t):
    return t.part.where(text.like_filter(F.col("p_name"), " r_nG ")).select("p_partkey", "p_name")


# ---------------------------------------------------------------- files

@query("s2_validate_files", """
SELECT doc_id, CASE WHEN ext = '' THEN 'no extension'
 WHEN ext NOT IN ('pdf','doc','docx','txt','md','markdown','xls','xlsx','csv','pptx','ppt','html','htm','json','epub') THEN 'extension not allowed'
 WHEN size <= 0 THEN 'file is empty' WHEN size > 209715200 THEN 'file too large' END AS reject_reason
FROM (SELECT doc_id, size, lower(regexp_extract(trim(regexp_extract(name, '[^/]*$')), '^.*[^.].*\\.([^.]*)$', 1)) AS ext FROM fx_file)""")
def _(t):
    return files.validate_files(t.file).select("doc_id", "reject_reason")


@query("s3_file_identity", """
SELECT doc_id, sha256(text) AS checksum, CASE lower(regexp_extract(name, '(?:^|/)[^/]*[^/.][^/]*\\.([^/.]*)$', 1))
 WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'html' THEN 'text/html'
 WHEN 'epub' THEN 'application/epub+zip' ELSE 'application/octet-stream' END AS mime FROM fx_file""")
def _(t):
    return files.file_identity(t.file.withColumn("content", F.col("text"))).select("doc_id", "checksum", "mime")


@query("s4_checksum_duplicates", """
SELECT checksum, count(*) AS copies, min(doc_id) AS keep FROM (SELECT doc_id, sha256(text) AS checksum FROM documents)
GROUP BY checksum HAVING count(*) > 1""")
def _(t):
    return files.checksum_duplicates(t.documents.withColumn("checksum", F.sha2("text", 256)), "doc_id")


@query("s1_scan_files", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS size, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes_read, min('txt') AS ext FROM documents GROUP BY source")
def _(t):
    """The documents written as one text file for each source and core, then scanned."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/scanned-{uuid.uuid4().hex}"
    t.documents.select("source", "text").write.partitionBy("source").text(folder)
    rows = files.scan_files(t.spark, folder).withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    return rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.length("content")).alias("bytes_read"), F.min("ext").alias("ext"))


@query("s7_parse_html", f"""
SELECT page_id, CASE WHEN body = '' THEN 'failed' ELSE 'parsed' END AS state, CAST(length(body) AS BIGINT) AS char_count, body
FROM (SELECT page_id, {d_html('html')} AS body FROM pages)""")
def _(t):
    rows = files.parse_documents(t.pages.select(
        "page_id", F.lit("page.HTML").alias("name"), F.col("html").cast("binary").alias("content")))
    return rows.select("page_id", "state", "char_count", F.array_join("sections.text", "").alias("body"))


@query("s10_parse_plain", f"""
SELECT doc_id, CASE WHEN body = '' THEN 'failed' ELSE 'parsed' END AS state, CAST(length(body) AS BIGINT) AS char_count, body
FROM (SELECT doc_id, {d_clean('text')} AS body FROM documents)""")
def _(t):
    rows = files.parse_documents(t.documents.select(
        "doc_id", F.lit("note.txt").alias("name"), F.col("text").cast("binary").alias("content")))
    return rows.select("doc_id", "state", "char_count", F.array_join("sections.text", "").alias("body"))


@query("s5_parse_documents", f"""
SELECT document_id, ext, CASE WHEN message IS NULL THEN 'parsed' ELSE 'failed' END AS state, CASE WHEN message IS NULL THEN length(body) ELSE 0 END AS char_count,
 message, CASE WHEN message IS NULL THEN body ELSE '' END AS body
FROM (SELECT *, CASE WHEN ext IN ('pdf', 'zip') THEN concat('no parser for .', ext, '; save it as one of: ', CASE ext WHEN 'pdf' THEN 'txt, html' ELSE 'txt, md, csv, json, html' END)
  WHEN body = '' THEN 'file holds no text' END AS message
 FROM (SELECT concat('d', CAST(doc_id AS STRING)) AS document_id, CASE doc_id % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'md' WHEN 3 THEN 'pdf' ELSE 'zip' END AS ext,
   CASE WHEN doc_id % 5 = 0 THEN concat(lang, ' | ', source, ' | x, y') WHEN doc_id % 10 = 1 THEN concat('{{', chr(10), ' "k": ', CAST(doc_id AS STRING), chr(10), '}}') ELSE {d_clean('text')} END AS body
  FROM documents
  UNION ALL SELECT concat('p', CAST(page_id AS STRING)), 'htm', {d_html('html')} FROM pages))""")
def _(t):
    """Every format at once: documents as CSV, JSON, prose named JSON, Markdown and unreadable types, pages as HTML."""
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("csv", "json", "md", "pdf", "zip")]), (i % 5 + 1).cast("int"))
    body = (F.when(i % 5 == 0, F.concat(F.lit(" "), "lang", F.lit(" ,"), "source", F.lit(',"x, y"\n,,\n')))
            .when(i % 10 == 1, F.concat(F.lit('{"k":'), i.cast("string"), F.lit("}"))).otherwise(F.col("text")))
    docs = t.documents.select(F.concat(F.lit("d"), i.cast("string")).alias("document_id"),
                              F.concat(F.lit("f."), ext).alias("name"), body.cast("binary").alias("content"))
    pages = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("document_id"),
                           F.lit("f.htm").alias("name"), F.col("html").cast("binary").alias("content"))
    return files.parse_documents(docs.unionByName(pages)).select(
        "document_id", "ext", "state", "char_count", "message", F.array_join("sections.text", "").alias("body"))


@query("s8_parse_csv", f"""
SELECT event_id, concat(event_type, ' | ', CAST(user_id AS STRING), ' | x, y') AS body FROM events""")
def _(t):
    raw = F.concat(F.lit(" "), F.col("event_type"), F.lit(" ,"), F.col("user_id").cast("string"), F.lit(',"x, y"\n,,\n'))
    return t.events.select("event_id", files.parse_csv(raw).alias("body"))


@query("s9_parse_json", """
SELECT event_id, concat('{', chr(10), ' "k": ', regexp_extract(props, '[0-9]+'), chr(10), '}') AS body FROM events""")
def _(t):
    return t.events.select("event_id", files.parse_json(F.col("props")).alias("body"))


@query("s6_decode_text", "SELECT doc_id, text AS body FROM documents")
def _(t):
    from grantseek.functions import arrow
    latin = F.encode("text", "UTF-16")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin)
    return t.documents.select("doc_id", arrow.decode_bytes(raw).alias("body"))


@query("s11_unsupported_formats", """
SELECT doc_id, ext, concat('no parser for .', ext, '; save it as one of: ', CASE ext WHEN 'pdf' THEN 'txt, html' WHEN 'epub' THEN 'html, txt' ELSE 'txt, md, csv, json, html' END) AS message
FROM (SELECT doc_id, lower(regexp_extract(name, '(?:^|/)[^/]*[^/.][^/]*\\.([^/.]*)$', 1)) AS ext FROM fx_file)
WHERE ext NOT IN ('txt','md','markdown','csv','json','log','html','htm','text')""")
def _(t):
    return files.unsupported_format_report(t.file).select("doc_id", "ext", "message")


# ---------------------------------------------------------------- chunks

def _sections(t):
    body = text.clean_text(F.col("text"))
    section = F.array(F.struct(body.alias("text"), F.lit(3).alias("page")), F.struct(body.alias("text"), F.lit(None).cast("int").alias("page")))
    return t.document.select("document_id", section.alias("sections"), body.alias("body"))


_squeeze = "regexp_replace({}, '\\\\s', '')"


@query("c1_recursive_split", "SELECT document_id, true AS within_size, true AS nothing_lost FROM fx_document")
def _(t):
    rows = chunking.recursive_split(t.document.withColumn("body", text.clean_text(F.col("text"))), "body")
    return rows.select(
        "document_id", F.coalesce(F.array_max(F.transform("pieces", lambda p: F.char_length(p))) <= 400, F.lit(True)).alias("within_size"),
        (F.regexp_replace(F.array_join("pieces", ""), r"(?U)\s", "") == F.regexp_replace("body", r"(?U)\s", "")).alias("nothing_lost"))


@query("c2_merge_overlap", "SELECT document_id, true AS within_size, true AS in_text, true AS overlaps FROM fx_document")
def _(t):
    """Chunks of one section stay in bounds, come from the text, and never lose it."""
    from grantseek.functions import arrow
    body = text.clean_text(F.col("text"))
    section = F.struct(F.col("body").alias("text"), F.lit(None).cast("int").alias("page"))
    parts = arrow.split_sections(F.array(section), 400, 80, 24)
    rows = t.document.select("document_id", body.alias("body")).withColumn("parts", parts).withColumn("chunks", F.col("parts.content"))
    flat = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    rows = rows.select("document_id", "chunks", flat(F.col("body")).alias("flat"))  # once a text, not once a chunk
    sizes = F.transform("chunks", lambda c: F.char_length(c))
    inner = F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0)))
    return rows.select(
        "document_id",
        (F.coalesce(F.array_max(inner) <= 400, F.lit(True)) & F.coalesce(F.try_element_at(sizes, F.lit(-1)) <= 423, F.lit(True))).alias("within_size"),
        F.forall("chunks", lambda c: F.col("flat").contains(flat(c))).alias("in_text"),
        (F.char_length(flat(F.array_join("chunks", ""))) >= F.char_length("flat")).alias("overlaps"))


@query("c3_chunk_sections", """
SELECT document_id, true AS ordinals_run, true AS within_size, true AS ids_match, true AS pages_in_order FROM fx_document""")
def _(t):
    chunks = chunking.chunk_sections(_sections(t).drop("body"))
    one = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("last"), F.max(F.char_length("content")).alias("longest"),
        F.min(F.col("chunk_id") == text.make_chunk_id(F.col("document_id"), F.col("ordinal"))).alias("ids_match"),
        F.max(F.when(F.col("page") == 3, F.col("ordinal"))).alias("last_paged"),
        F.min(F.when(F.col("page").isNull(), F.col("ordinal"))).alias("first_unpaged"))
    return one.select("document_id", (F.col("n") == F.col("last") + 1).alias("ordinals_run"),
                      (F.col("longest") <= 423).alias("within_size"), "ids_match",
                      (F.col("last_paged") + 1 == F.col("first_unpaged")).alias("pages_in_order"))


# Texts of letters and single spaces: where they are cut follows from the places of the spaces.
SPACED_SQL = "SELECT document_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS body FROM fx_document"
CUTS_SQL = f"""
SELECT * FROM (WITH RECURSIVE spaced AS MATERIALIZED ({SPACED_SQL}),
ends AS MATERIALIZED (SELECT document_id, body, list_concat(list_filter(range(1, length(body) + 1), lambda p: body[p] = ' '), [length(body)]) AS ends FROM spaced WHERE body <> ''),
cut AS (SELECT document_id, 0 AS k, CAST(0 AS BIGINT) AS a, list_max(list_filter(ends, lambda x: x <= 400)) AS b FROM ends
 UNION ALL SELECT document_id, k + 1, a2, list_max(list_filter(ends, lambda x: x <= a2 + 400)) FROM (
  SELECT c.document_id, c.k, e.ends, CASE WHEN list_min(list_filter(e.ends, lambda x: x > c.b)) - greatest(c.a, c.b - 80) <= 400 THEN greatest(c.a, c.b - 80) ELSE c.b END AS a2
  FROM cut c JOIN ends e ON e.document_id = c.document_id WHERE c.b < length(e.body))),
part AS (SELECT c.document_id, c.k, substring(e.body, c.a + 1, c.b - c.a) AS content, c.b - c.a AS size, max(c.k) OVER (PARTITION BY c.document_id) AS last,
  lead(substring(e.body, c.a + 1, c.b - c.a)) OVER (PARTITION BY c.document_id ORDER BY c.k) AS next, lead(c.b - c.a) OVER (PARTITION BY c.document_id ORDER BY c.k) AS next_size
 FROM cut c JOIN ends e ON e.document_id = c.document_id)
SELECT document_id, CAST(k AS INT) AS ordinal, trim(CASE WHEN k = last - 1 AND next_size < 24 THEN concat(content, next) ELSE content END) AS content
FROM part WHERE NOT (k = last AND k > 0 AND size < 24))"""


def _spaced(t):
    return t.document.select("document_id", F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("body"))


@query("c1_piece_texts", f"""
SELECT document_id, CAST(i AS INT) AS place, CASE WHEN i = n - 1 THEN word ELSE concat(word, ' ') END AS piece
FROM (SELECT document_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i
 FROM (SELECT document_id, CASE WHEN length(body) <= 400 THEN [body] ELSE string_split(body, ' ') END AS words FROM ({SPACED_SQL}) WHERE body <> ''))""")
def _(t):
    return chunking.recursive_split(_spaced(t), "body").select("document_id", F.posexplode("pieces").alias("place", "piece"))


@query("c2_chunk_texts", CUTS_SQL)
def _(t):
    section = F.array(F.struct(F.col("body").alias("text"), F.lit(None).cast("int").alias("page")))
    return chunking.chunk_sections(_spaced(t).select("document_id", section.alias("sections"))).select("document_id", "ordinal", "content")


@query("c3_chunk_function", CUTS_SQL)
def _(t):
    """The same through the table function, in SQL."""
    name = chunking.register_chunk_function(t.spark)
    _spaced(t).createOrReplaceTempView("spaced_documents")
    return t.spark.sql(f"SELECT d.document_id, c.ordinal, c.content FROM spaced_documents d, LATERAL {name}(d.body, 400, 80, 24) c")


@query("c4_hard_chunks", f"""
SELECT document_id, CAST(i AS INT) AS ordinal, substring(body, CAST(i * 400 + 1 AS BIGINT), 400) AS content
FROM (SELECT document_id, body, unnest(range(CAST(ceil(length(body) / 400.0) AS BIGINT))) AS i
 FROM (SELECT document_id, {d_strip('text')} AS body FROM fx_document))""")
def _(t):
    return chunking.hard_chunks(t.document.select("document_id", "text"), "text")


@query("c5_chunk_stats", """
SELECT document_id, count(*) AS chunk_count, CAST(sum(floor(length(content) / 4)) AS BIGINT) AS token_count,
 CAST(sum(length(content)) AS BIGINT) AS char_count FROM d_line GROUP BY document_id""")
def _(t):
    return chunking.chunk_stats(chunking.line_chunks(t.document.select("document_id", "text"), "text"))
