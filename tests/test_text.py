from pyspark.sql import functions as F

from grantseek.functions import text


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["out"] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_text(spark):
    raw = ["ＡＢＣ　　１２３", "a\r\nb\rc", "a\n\n\n\n\nb", "a​b﻿c", "a\x00b\x07c", "  x \t y  ", "", None, "éﬁ"]
    assert values(spark, raw, text.clean_text) == [
        "ABC 123", "a\nb\nc", "a\n\nb", "abc", "abc", "x y", "", "", "éfi"]


def test_nfkc_guard_skips_only_stable_text(spark):
    import unicodedata
    raw = ["plain", "Grüße ñ À", "报销制度。、", "ｆｕｌｌ", "①", "á", "½", "ĳ"]
    assert values(spark, raw, text.nfkc) == [unicodedata.normalize("NFKC", r) for r in raw]


def test_html_to_text(spark):
    raw = ["<p>Hello</p><SCRIPT x='1'>var a = '<p>';</SCRIPT><div>A &amp; B &lt;ok&gt;</div><!-- c --><b>bold</b><style>p{}</style>"]
    assert values(spark, raw, text.html_to_text) == ["Hello\n \nA & B <ok>\n  bold".replace("  ", " ")]


def test_bigrams(spark):
    assert values(spark, ["报销制度", "a", "", "ab"], text.bigrams) == [["报销", "销制", "制度"], ["a"], [], ["ab"]]


def test_lex_tokens(spark):
    raw = ["Hello hello WORLD_1, x", "报销制度 OK报 abc", "，。！", "", None, "Café"]
    assert values(spark, raw, text.lex_tokens) == [
        ["hello", "world_1", "x"], ["报销", "销制", "制度", "ok", "k报", "abc"], [], [], [], ["caf"]]


def test_query_tokens_limit_and_quotes(spark):
    many = " ".join(f"w{i}" for i in range(50))
    out = values(spark, [many, '报"销'], text.query_tokens)
    assert out[0] == [f"w{i}" for i in range(32)]
    assert out[1] == ["报", "销"]


def test_approx_tokens(spark):
    assert values(spark, ["报销制度", "abcdefgh", "报a", "", None], text.approx_tokens) == [4, 2, 1, 0, 0]


def test_names(spark):
    names = ["/a/b/报告 v1.PDF", "../../etc/passwd", "  ", "x\x00y?.txt", "a" * 300 + ".md", "noext", ".bashrc", "a.tar.GZ", "a."]
    assert values(spark, names, text.safe_display_name)[:4] == ["报告 v1.PDF", "passwd", "unnamed", "xy_.txt"]
    assert len(values(spark, names, text.safe_display_name)[4]) == 200
    assert values(spark, names, text.file_ext) == ["pdf", "", "", "txt", "md", "", "", "gz", ""]


def test_title_history_and_ids(spark):
    assert values(spark, ["  a\n b ", "x" * 31, "", None], text.build_title) == ["a b", "x" * 30 + "…", "新对话", "新对话"]
    assert values(spark, ["它是什么", "短问题", "x" * 31], text.needs_history) == [True, False, True]
    row = spark.range(1).select(text.make_chunk_id(F.lit("d"), F.lit(7)).alias("a"), text.make_chunk_id(F.lit("d"), F.lit(12345)).alias("b")).first()
    assert (row["a"], row["b"]) == ("d-0007", "d-12345")


def test_sanitize(spark):
    df = spark.createDataFrame([({"Password": "p", "note": "n" * 2001, "ok": "v"},)], "d map<string,string>")
    out = df.select(text.sanitize_detail(F.col("d")).alias("d")).first()["d"]
    assert out == {"Password": "***", "note": "n" * 2000 + "…", "ok": "v"}
    nested = values(spark, ['{"a": {"TOKEN": 1, "b": [1]}, "api_key": "k"}'], text.sanitize_json)[0]
    assert nested == '{"a": {"TOKEN": "***", "b": [1]}, "api_key": "***"}'


def test_small_parsers(spark):
    assert values(spark, ["[[0, 0, 0, 7]]", "[[0,0,0,0]]", "[[1]]", "oops", None], text.extract_page) == [7, None, None, None, None]
    assert values(spark, ["v1.2.3-beta", "2", "1.x.4", "", None, "10.0.1.9"], text.version_key) == [
        [1, 2, 3], [2, 0, 0], [1, 0, 4], [0, 0, 0], [0, 0, 0], [10, 0, 1]]
    assert values(spark, ["My%20PC+1", "100%", "plain+"], text.decode_device_name) == ["My PC+1", "100%", "plain+"]
    ips = spark.createDataFrame([(" 1.1.1.1, 2.2.2.2", "3.3.3.3", "h"), (None, " 3.3.3.3 ", "h"), ("", "", "h"), (None, None, None)],
                                "f string, r string, h string").select(text.client_ip(F.col("f"), F.col("r"), F.col("h")).alias("ip"))
    assert [r["ip"] for r in ips.collect()] == ["1.1.1.1", "3.3.3.3", "h", "unknown"]


def test_attachment_text(spark):
    df = spark.createDataFrame([(bytearray("<p>你好</p><script>x</script> ok".encode()), "html"), (bytearray("中文".encode("gb18030")), "txt"), (bytearray(b"x"), "pdf")],
                               "c binary, e string")
    out = [r["t"] for r in df.select(text.attachment_text(F.col("c"), F.col("e")).alias("t")).collect()]
    assert out == [" 你好 ok", "中文", ""]
