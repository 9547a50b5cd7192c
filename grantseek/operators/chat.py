"""Chat history, prompts and what answers reveal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantseek.common import HISTORY_ROUNDS, top_k
from grantseek.functions.text import like_filter, strip
from grantseek.operators.hybrid import UNNAMED_DOCUMENT

# Limits and the wording of the context a prompt is built from.
CONTEXT_CHARS = 24000
MESSAGE_CHARS = 4000
ATTACHMENT_CHARS = 8000
NO_CONTEXT = "（本轮没有检索到任何可用片段）"
BLOCK_SEPARATOR = "\n\n---\n\n"
SOURCE_LABEL = "来源："
CONTEXT_LABEL = "【参考片段】"
QUESTION_LABEL = "【用户问题】"
ATTACHMENTS_LABEL = "【用户附加内容】"
ATTACHMENT_LABEL = "[附件]"
NO_QUESTION = "（用户仅上传了附件，请依据附件内容说明）"

DEFAULT_SYSTEM = "Answer from the numbered passages and cite them as [1], [2]. Say so when they do not hold the answer."
DEFAULT_ATTACHMENT_NOTE = "The user attached files; where they contradict the passages, the files win."
IMAGE_NOTE = "(The question holds images this model cannot read. Answer from the text alone.)"


# ---------------------------------------------------------------- prompts

def context_block(citations: DataFrame, requests: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context): numbered passages in order, cut where the budget ends.

    A request has at most top_n citations, so its passages meet in one row.
    """
    body = strip(F.col("content"))
    rows = citations.withColumn("_body", body).where(F.length("_body") > 0).withColumn("_len", F.char_length("_body"))
    before = Window.partitionBy("query_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    used = rows.withColumn("_used", F.coalesce(F.sum("_len").over(before), F.lit(0))).where(F.col("_used") < budget)
    kb = F.coalesce("kb_name", F.lit(""))
    name = F.when(F.length("document_name") > 0, F.col("document_name")).otherwise(UNNAMED_DOCUMENT)
    origin = F.concat(F.lit(SOURCE_LABEL), name,
                      F.when(kb != "", F.concat(F.lit("（"), kb, F.lit("）"))).otherwise(""))
    cut = F.substr("_body", F.lit(1), (F.lit(budget) - F.col("_used")).cast("int"))
    block = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("] "), origin, F.lit("\n"), cut)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", block.alias("block")))),
                                      lambda s: s["block"]), BLOCK_SEPARATOR)
    blocks = used.groupBy("query_id").agg(joined.alias("_context"))
    return requests.select("query_id").join(blocks, "query_id", "left").select(
        "query_id", F.coalesce("_context", F.lit(NO_CONTEXT)).alias("context"))


def history_window(messages: DataFrame, rounds: int = HISTORY_ROUNDS) -> DataFrame:
    """Last 2 x rounds messages of each session, then cleaned: empty ones fall out, long ones are cut.

    ``position`` counts back from the newest message (1) and orders the result.
    """
    tail = top_k(messages, ["session_id"], [F.desc("message_id")], rounds * 2, rank="position",
                 salts=8)
    body = strip(F.coalesce("content", F.lit("")))
    return tail.withColumn("content", body).where("content <> ''").select(
        "session_id", "message_id", "position", F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"),
        F.substring("content", 1, MESSAGE_CHARS).alias("content"))


def prompt_messages(
    requests: DataFrame, contexts: DataFrame, history: DataFrame | None = None, attachments: DataFrame | None = None,
    images: DataFrame | None = None, *, supports_vision: bool = False, system: str = DEFAULT_SYSTEM,
    attachment_note: str = DEFAULT_ATTACHMENT_NOTE,
) -> DataFrame:
    """(query_id, messages, image_uris): the message list for a language model.

    requests: query_id, question, optionally session_id. attachments: query_id,
    seq, type, name, text. images: query_id, seq, uri. Every list is short: the
    history is cut by ``history_window``, files and images come with one question.
    """
    message = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    rows = requests.join(contexts, "query_id", "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))
    if attachments is not None:
        is_text = (F.col("type") == "file") & (F.length("text") > 0)
        block = F.concat(F.lit(ATTACHMENT_LABEL + " "), F.col("name"), F.lit("\n"),
                         F.substring("text", 1, ATTACHMENT_CHARS))
        files = attachments.groupBy("query_id").agg(
            F.array_join(F.transform(
                F.array_sort(F.collect_list(F.when(is_text, F.struct("seq", block.alias("block"))))),
                lambda s: s["block"]), "\n\n").alias("_files"), F.lit(True).alias("_attached"))
        rows = rows.join(files, "query_id", "left")
    else:
        rows = rows.withColumns({"_files": F.lit(None).cast("string"), "_attached": F.lit(None).cast("boolean")})
    if images is not None:
        uris = images.groupBy("query_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "uri"))), lambda s: s["uri"]).alias("image_uris"))
        rows = rows.join(uris, "query_id", "left")
    else:
        rows = rows.withColumn("image_uris", F.lit(None).cast("array<string>"))
    if history is not None:
        past = history.groupBy("session_id").agg(F.transform(
            F.sort_array(F.collect_list(F.struct("position", "role", "content")), asc=False),
            lambda s: message(s["role"], s["content"])).alias("_past"))
        rows = rows.join(past, "session_id", "left")
    else:
        rows = rows.withColumn("_past", F.lit(None).cast("array<struct<role:string,content:string>>"))

    note = F.when(F.col("_attached"), F.lit("\n" + attachment_note)).otherwise("")
    question = F.when(F.length("question") > 0, F.col("question")).otherwise(NO_QUESTION)
    files_part = F.when(F.length("_files") > 0, F.concat(F.lit(ATTACHMENTS_LABEL + "\n"), F.col("_files")))
    prompt = F.concat_ws("\n\n", files_part, F.concat(F.lit(CONTEXT_LABEL + "\n"), F.col("context")),
                         F.concat(F.lit(QUESTION_LABEL + "\n"), question))
    has_images = F.coalesce(F.size("image_uris") > 0, F.lit(False))
    if not supports_vision:
        prompt = F.when(has_images, F.concat(prompt, F.lit("\n\n" + IMAGE_NOTE))).otherwise(prompt)
    empty = F.array().cast("array<struct<role:string,content:string>>")
    whole = F.concat(F.array(message(F.lit("system"), F.concat(F.lit(system), note))),
                     F.coalesce("_past", empty), F.array(message(F.lit("user"), prompt)))
    sent = F.when(F.lit(supports_vision), F.col("image_uris"))
    return rows.select("query_id", whole.alias("messages"), sent.alias("image_uris"))


# ---------------------------------------------------------------- sessions

def user_stats(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions and messages per user."""
    own = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
    per_session = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    said = per_session.join(sessions.select("session_id", "user_id"), "session_id").groupBy("user_id").agg(
        F.sum("_n").alias("messages"))
    return own.join(said, "user_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


def list_sessions(sessions: DataFrame, keyword: str | None = None, include_archived: bool = False) -> DataFrame:
    """Sessions to show; order them by updated_at, newest first, when paging."""
    rows = sessions if include_archived else sessions.where(~F.col("is_archived"))
    return rows.where(like_filter(F.col("title"), keyword)) if keyword else rows


def session_detail(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The given sessions with their messages, one row each, in order.

    Rows rather than a nested list: a session has no bound.
    """
    cols = [c for c in messages.columns if c not in sessions.columns or c == "session_id"]
    return sessions.join(messages.select(*cols), "session_id", "left").orderBy("session_id", "message_id")


def message_counts(messages: DataFrame) -> DataFrame:
    """Messages per session, counted from the rows."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))


def apply_feedback(messages: DataFrame, feedback: DataFrame, sessions: DataFrame) -> DataFrame:
    """Set up, down or null on messages of the user's own sessions; anything else is ignored."""
    allowed = feedback.where("value IS NULL OR value IN ('up', 'down')")
    own = sessions.select("session_id", F.col("user_id").alias("_owner"))
    marks = allowed.select("message_id", F.col("user_id").alias("_by"), F.col("value").alias("_value"),
                           F.lit(True).alias("_marked")).dropDuplicates(["message_id", "_by"])
    rows = messages.join(own, "session_id", "left").join(
        marks.withColumnRenamed("message_id", "_mid"),
        (F.col("message_id") == F.col("_mid")) & (F.col("_owner") == F.col("_by")), "left")
    current = F.col("feedback") if "feedback" in messages.columns else F.lit(None).cast("string")
    keep = [c for c in messages.columns if c != "feedback"]
    return rows.select(*keep, F.when(F.col("_marked"), F.col("_value")).otherwise(current).alias("feedback"))


def exposure_audit(messages: DataFrame) -> DataFrame:
    """(user_id, chunk_id, first_seen, n): which chunks each user's answers drew on."""
    return messages.select("user_id", "created_at", F.explode("hit_chunk_ids").alias("chunk_id")).groupBy(
        "user_id", "chunk_id").agg(F.min("created_at").alias("first_seen"), F.count(F.lit(1)).alias("n"))


def denied_exposure(exposure: DataFrame, decided: DataFrame) -> DataFrame:
    """Chunks a user once saw and may not see today, for whatever reason.

    ``decided`` is ``chunk_visibility`` of the exposures (scope_id being the user). A chunk that is gone has no decision
    and is not reported.
    """
    hidden = decided.where("not visible").select(F.col("scope_id").alias("user_id"), "chunk_id").distinct()
    return exposure.join(hidden, ["user_id", "chunk_id"], "left_semi")


def retrieval_quality(logs: DataFrame, detail: str = "detail") -> DataFrame:
    """Per day of answers: citations, share dropped by permission, duration, errors.

    ``detail`` is JSON text with raw_candidates, dropped_by_permission and citations.
    """
    schema = "raw_candidates bigint, dropped_by_permission bigint, citations bigint"
    rows = logs.select(F.to_date("created_at").alias("day"), "status", "duration_ms",
                       F.from_json(F.col(detail), schema).alias("d"))
    share = F.sum("d.dropped_by_permission") / F.sum("d.raw_candidates")
    return rows.groupBy("day").agg(
        F.count(F.lit(1)).alias("answers"), F.round(F.avg("d.citations"), 6).alias("mean_citations"),
        F.round(F.when(F.sum("d.raw_candidates") > 0, share), 6).alias("dropped_share"),
        F.round(F.avg("duration_ms"), 6).alias("mean_ms"),
        F.round(F.avg(F.when(F.col("status") == "failed", 1.0).otherwise(0.0)), 6).alias("error_rate"))
