import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions import vectors as V


def value(spark, f, *inputs):
    df = spark.createDataFrame([inputs], ", ".join(f"x{i} string" for i in range(len(inputs))))
    return df.select(f(*[F.col(f"x{i}") for i in range(len(inputs))]).alias("y")).first()["y"]


def both(spark, f, text):
    df = spark.createDataFrame([(text,)], "x string")
    new, n = f(F.col("x"))
    return tuple(df.select(new, n).first())


CASES = [
    (T.is_url, ["https://example.com/foo", "www.example.com", "tenor.com/view/x", "(https://example.com)", "[tenor.com/view/foo]"], ["hello", "tenor.com", "@everyone", ""]),
    (T.is_paren_mention, ["(@1234567890)", "(@&1)", "(#22)", "(t:1778085052:R)", "(id:browse)"], ["(hello)", "(@notdigits)", "(123)", "()", "@1234"]),
    (T.is_emoji_shortcode, [":thumbsup:", ":a_b_c:"], [":", "::", ":a:", ":" + "x" * 34 + ":", ":hello-world:", ":nosuffix"]),
    (T.is_url_dominant, ["https://tenor.com/view/foo lol"], ["check this cool gif https://tenor.com/view/foo", "", "lol"]),
    (T.is_role_ping_only, ["@everyone @here", "@123 @456"], ["@everyone please vote", "hello @here", ""]),
]


@pytest.mark.parametrize("f, true, false", CASES)
def test_predicates(spark, f, true, false):
    rows = spark.createDataFrame([(x,) for x in true + false], "x string").select("x", f(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == {x: True for x in true} | {x: False for x in false}


def test_rewrites(spark):
    assert both(spark, T.rewrite_urls, "https://a.com/x and https://b.com/y") == ("__URL__ and __URL__", 2)
    assert both(spark, T.rewrite_mentions, "(@1) (@&2) (#3) (t:4:R) (id:browse)") == (" ".join(["__MENTION__"] * 5), 5)
    assert both(spark, T.rewrite_mentions, "hello (world)") == ("hello (world)", 0)
    assert both(spark, T.rewrite_emoji, "lol :kek: that's :PanFrown:") == ("lol __EMOJI__ that's __EMOJI__", 2)
    assert both(spark, T.rewrite_emoji, "hi: how are you") == ("hi: how are you", 0)


@pytest.mark.parametrize(
    "raw, new, n",
    [
        ("hello **bold** and **more** text", "hello bold and more text", 4),
        ("hello -- world --- foo", "hello - world - foo", 2),
        (":- another item", "another item", 1),
        ("42. answer", "answer", 1),
        ("yes * no", "yes no", 1),
        ("see __URL__ and __EMOJI__", "see __URL__ and __EMOJI__", 0),
        ("foo__URL__", "foo__URL__", 0),
        ("__URL__, x", "URL , x", 2),
        ("", "", 0),
    ],
)
def test_markdown(spark, raw, new, n):
    assert both(spark, T.strip_markdown, raw) == (new, n)


@pytest.mark.parametrize("raw, new, n", [("hello\\nworld", "hello world", 1), ("C:\\Users\\foo", "C:Usersfoo", 2), ("a\\\\b", "ab", 2), ("the\\", "the", 1), ('say \\"x\\"', 'say "x"', 2)])
def test_escapes(spark, raw, new, n):
    assert both(spark, T.strip_escapes, raw) == (new, n)


def test_plain_texts_are_cut_whole(spark):
    """Tokens and spacing of whole texts, ASCII or not, are those of their words."""
    texts = ["", None, " a\x1cb\x0bC \x85d", "ΑΣ ΟΔΟΣ.", "İI ß 5١ it's", "<PAD> x", "a__b A_b", "__URL__ <", "\u3000a\xa0B\u200bc", "x😀Y"] + [f"{chr(i)}aZ{chr(i)}9 " for i in range(0x250)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    lower = lambda w: F.lower(F.translate(w, "Σ", "σ"))
    t = F.col("text")
    same = T.tokenize(t).eqNullSafe(T._word_by_word(t, lower)) & T.one_spaced(t).eqNullSafe(F.array_join(T.words(t), " "))
    assert rows.where(~same).count() == 0


def test_tokens(spark):
    assert value(spark, T.tokenize, "hello, world!") == ["hello", ",", "world", "!"]
    assert value(spark, T.tokenize, "don't worry it's fine") == ["don't", "worry", "it's", "fine"]
    assert value(spark, T.tokenize, "<PERSON_3> Hi __URL__ </PERSON_3> <PERSON_x>") == ["<PERSON_3>", "hi", "__URL__", "</PERSON_3>", "<", "person", "_", "x", ">"]
    assert value(spark, T.tokenize, "") == []
    assert value(spark, T.tokenize, "ΣΟΦΟΣ ὈΔΥΣΣΕΎΣ, ς") == ["σοφοσ", "ὀδυσσεύσ", ",", "ς"]
    assert value(spark, lambda x: T.detokenize(T.tokenize(x)), "hello , world !") == "hello, world!"


def test_more_text(spark):
    assert value(spark, T.sanitize_chat, "<PERSON_3>hi\tthere https://x.org :kek:") == "(PERSON_3)hi there __URL__ __EMOJI__"
    assert value(spark, T.unescape_tsv, "hello\\nworld a\\\\b a\\tb \\q \\") == "hello\nworld a\\b a\tb \\q \\"
    assert value(spark, T.index_array, "answer: [1,2,3] hope") == [1, 2, 3]
    assert value(spark, T.index_array, "none") == [] and value(spark, T.index_array, "[-1]") == []
    assert value(spark, T.sentences, "Hello world. How are you? I am fine!") == ["Hello world.", "How are you?", "I am fine!"]
    assert value(spark, T.sentences, "no end") == ["no end"]
    assert value(spark, T.string_similarity, "abc", "abc") == 100 and value(spark, T.string_similarity, "abcd", "abx") == 3
    assert value(spark, T.parse_seconds, "2020-01-01T00:00:01.5Z") == 1577836801 and value(spark, T.parse_seconds, "x") is None
    long = "a" * 320 + ". " + "b" * 200
    assert value(spark, T.truncate_at_sentence, long) == "a" * 320 + "."
    assert value(spark, T.truncate_at_sentence, "c" * 500) == "c" * 400
    assert value(spark, lambda a, b: T.keep_tree_text(a, b), "As an AI language model I won't", "assistant") is False
    assert value(spark, T.tag_person, "<PERSON_7>") == 7 and value(spark, T.tag_person, "<PERSON_>") is None


def test_vectors(spark):
    row = spark.range(1).select(
        V.repetition_penalty(F.array(*[F.lit(1.0)] * 4), F.array(F.lit(1), F.lit(3)), 0.5).alias("pen"),
        V.mask(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.1)), F.array(F.lit(1), F.lit(9))).alias("mask"),
        V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        V.window_ids(F.array(F.lit(5), F.lit(6)), 4).alias("win"),
        V.learning_rate(F.lit(1), 1.0, 0.1, 2, 4).alias("warm"),
        V.learning_rate(F.lit(9), 1.0, 0.1, 2, 4).alias("end"),
        V.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("soft"),
    ).first()
    assert row["pen"] == [1, 0.5, 1, 0.5] and row["mask"] == [0.5, 0, 0.1] and row["zero"] == 0
    assert row["win"] == [0, 0, 5, 6] and row["warm"] == 0.5 and row["end"] == 0.1 and row["soft"] == [0.5, 0.5]


def test_functions_without_a_query(spark):
    from parlance.operators import sessions

    row = spark.createDataFrame([("see https://e.org/x now www.a.b", 175928847299117063)], "t string, id long")
    out = row.select(T.strip_urls(F.col("t")).alias("t"), T.snowflake_seconds(F.col("id")).alias("s")).first()
    assert out["t"] == "see now" and out["s"] == 1462015105
    assert [tuple(r) for r in row.select(V.position_feature(F.lit(50)), V.position_feature(F.lit(500))).collect()] == [(0.5, 1.0)]
    window = spark.createDataFrame([([5, 6, 7],), ([],)], "w array<long>")
    assert [r[0] for r in window.select(V.window_ids(F.col("w"), 4, 0)).collect()] == [[0, 5, 6, 7], [0, 0, 0, 0]]
    m = spark.createDataFrame([("c", i, i, i % 2, f"said <{i}>\n here") for i in range(25)], "channel string, id long, ts_secs long, author_id long, content string")
    prompts = {r["window"]: r["prompt"].split("\n") for r in sessions.window_prompt(m).collect()}
    assert len(prompts[0]) == 20 and len(prompts[1]) == 10 and prompts[1][0].startswith("0. 1: said ") and prompts[0][3].endswith("here")
