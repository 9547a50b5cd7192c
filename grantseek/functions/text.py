"""Text functions, Column to Column. Everything stays in the JVM unless a value needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantseek.functions import arrow

# Character classes, patterns and word lists of the text rules.
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
         "\u2028\u2029\u202f\u205f\u3000")
INVISIBLE = r"[\u200b-\u200f\u2028\u2029\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BLANK_RUN = r"[ \t\u3000]{2,}"
UNTIDY = r"[\x00-\x09\x0b-\x1f\x7f\u200b-\u200f\u2028\u2029\u3000\ufeff]|  |\n\n\n"
CJK = r"[\u4e00-\u9fff]"
WORD = "[0-9a-z_]+"
SPECIAL = r'^["*():^\-]$'
SILENT_ELEMENT = r"(?is)<(script|style)\b[^>]*>.*?</\1>"
LINE_TAG = r"(?i)</?(p|div|br|li|tr|h[1-6]|section|article)\b[^>]*>"
TAG = "<[^>]+>"
ATTACHED_SCRIPT = r"(?i)<script[\s\S]*?</script>"
ATTACHED_STYLE = r"(?i)<style[\s\S]*?</style>"
MAX_QUERY_TERMS = 32
DEFAULT_TITLE = "新对话"
ANAPHORA = ["它", "这个", "那个", "上述", "刚才", "继续", "还有", "他", "该"]
SENSITIVE_KEYS = [
    "password", "old_password", "new_password", "api_key", "token",
    "refresh_token", "access_token", "secret", "authorization",
]

# All characters but those NFKC leaves alone in any order: ASCII, Latin-1 letters, CJK ideographs, 、 and 。
_NFKC_MAY_CHANGE = r"[\x{80}-\x{bf}\x{100}-\x{3000}\x{3003}-\x{4dff}\x{a000}-\x{10ffff}]"


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def nfkc(c: Column) -> Column:
    """NFKC normal form. Only rows holding a character it may change travel to Python."""
    not_ascii = F.octet_length(c) > F.char_length(c)
    return F.coalesce(arrow.nfkc(F.when(not_ascii & c.rlike(_NFKC_MAY_CHANGE), c)), c)


def clean_text(c: Column) -> Column:
    """Normalised text: one kind of newline, no control or zero-width characters, short gaps.

    Most texts hold nothing to change, which one scan finds out.
    """
    given = nfkc(F.coalesce(c, F.lit("")))
    out = F.regexp_replace(given, "\r\n?", "\n")
    out = F.regexp_replace(out, INVISIBLE, "")
    out = F.regexp_replace(out, BLANK_RUN, " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return strip(F.when(given.rlike(UNTIDY), out).otherwise(given))


def html_to_text(c: Column) -> Column:
    """Readable text of an HTML page."""
    return clean_text(html_words(c))


def html_words(c: Column) -> Column:
    """The same before it is cleaned."""
    out = F.regexp_replace(F.regexp_replace(c, SILENT_ELEMENT, " "), LINE_TAG, "\n")
    return arrow.unescape(F.regexp_replace(out, TAG, " "))


def bigrams(c: Column) -> Column:
    """Overlapping pairs of characters; a single character is its own pair."""
    n = F.char_length(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))
    return F.when(n > 0, pairs).otherwise(F.array().cast("array<string>"))


def _words(c: Column) -> Column:
    """ASCII words in lower case. İ is the one character left whose lower case holds an ASCII letter."""
    return F.regexp_extract_all(F.lower(F.replace(c, F.lit("İ"), F.lit(" "))), F.lit(WORD), F.lit(0))


def lex_tokens(c: Column) -> Column:
    """Distinct index tokens: bigrams for runs with CJK characters, ASCII words otherwise."""
    text = nfkc(F.coalesce(c, F.lit("")))
    words = _words(text)
    mixed = F.flatten(F.transform(
        F.split(text, r"(?U)\s+"),
        lambda run: F.when(run.rlike(CJK), bigrams(F.lower(run))).otherwise(_words(run)),
    ))
    return F.array_distinct(F.when(text.rlike(CJK), mixed).otherwise(words))


def query_tokens(c: Column) -> Column:
    """Search terms of a question: at most the first 32 usable tokens."""
    plain = F.transform(
        F.filter(lex_tokens(c), lambda t: ~t.rlike(SPECIAL)), lambda t: F.replace(t, F.lit('"'), F.lit("")))
    return F.slice(F.filter(plain, lambda t: F.length(t) > 0), 1, MAX_QUERY_TERMS)


def approx_tokens(c: Column) -> Column:
    """Estimated model tokens: one per CJK character, one per four others."""
    text = F.coalesce(c, F.lit(""))
    cjk = F.regexp_count(text, F.lit(CJK))
    return (cjk + F.floor((F.char_length(text) - cjk) / 4)).cast("bigint")


def make_chunk_id(document_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s-%04d", document_id, ordinal)


def safe_display_name(c: Column) -> Column:
    """File name without folders or unusual characters, at most 200 long."""
    base = strip(F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/]*)$", 1))
    base = F.when(base == "", F.lit("unnamed")).otherwise(base)
    base = F.regexp_replace(base, r"\x00", "")
    return F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}_\-. ]", "_"), 1, 200)


def file_ext(c: Column) -> Column:
    """Lower-cased extension without its dot; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:^|/)[^/]*[^/.][^/]*\.([^/.]*)$", 1))


def attachment_text(content: Column, ext: Column, limit: int = 20000) -> Column:
    """Light extraction for a file attached to a question, cut to ``limit`` characters."""
    # The extensions read as plain text.
    readable = ext.isin("txt", "md", "markdown", "csv", "json", "html", "htm")
    raw = arrow.decode_attachment(F.when(readable, F.substring(content, 1, limit * 4)))
    flat = F.regexp_replace(F.regexp_replace(raw, ATTACHED_SCRIPT, " "), ATTACHED_STYLE, " ")
    flat = F.regexp_replace(F.regexp_replace(flat, TAG, " "), r"(?U)\s+", " ")
    text = F.when(ext.isin("html", "htm"), flat).otherwise(raw)
    return F.coalesce(F.substring(text, 1, limit), F.lit(""))


def build_title(c: Column, limit: int = 30) -> Column:
    """Session title from the first question."""
    text = strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return (F.when(text == "", DEFAULT_TITLE)
            .when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…")))
            .otherwise(text))


def needs_history(c: Column) -> Column:
    """Whether a question is long or points back at earlier turns."""
    return (F.char_length(c) > 30) | c.rlike("|".join(ANAPHORA))


def sanitize_detail(c: Column) -> Column:
    """Audit detail (map of strings) with secrets masked and long values cut."""
    return F.transform_values(c, lambda k, v: (
        F.when(F.lower(k).isin(SENSITIVE_KEYS), F.lit("***"))
        .when(F.char_length(v) > 2000, F.concat(F.substring(v, 1, 2000), F.lit("…")))
        .otherwise(v)))


def sanitize_json(c: Column) -> Column:
    """The same for a JSON document of any depth."""
    return arrow.sanitize_json(c)


def extract_page(positions: Column) -> Column:
    """Page number out of ``[[a, b, c, page]]``; zero or anything malformed is null."""
    first = F.get(F.from_json(positions, "array<array<int>>"), F.lit(0))
    page = F.get(first, F.lit(3))
    return F.when(page != 0, page)


def client_ip(forwarded: Column, real_ip: Column, host: Column) -> Column:
    def given(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)
    return F.coalesce(strip(F.split_part(given(forwarded), F.lit(","), F.lit(1))), strip(given(real_ip)), host,
                      F.lit("unknown"))


def version_key(c: Column) -> Column:
    """``v1.2.3-beta`` as [1, 2, 3]; arrays of equal length compare in order."""
    core = F.split_part(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^[vV]+", ""), F.lit("-"), F.lit(1))
    parts = F.split(core, r"\.")
    return F.transform(F.sequence(F.lit(0), F.lit(2)),
                       lambda i: F.coalesce(strip(F.get(parts, i)).try_cast("int"), F.lit(0)))


def decode_device_name(c: Column) -> Column:
    """Percent-decoded device name; a plus sign stays a plus sign."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.when(c.contains("%"), F.coalesce(decoded, c)).otherwise(c)


def like_filter(c: Column, keyword: str) -> Column:
    """Case-blind ``%keyword%`` where % and _ in the keyword stay wildcards."""
    return c.ilike("%" + keyword.strip().replace("\\", "\\\\") + "%")
