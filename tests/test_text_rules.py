import pytest
from pyspark.sql import functions as F

from threadlens.functions import lexicons as lx
from threadlens.functions import rules as rl
from threadlens.functions import text as tx
from threadlens.operators import labelling


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("272.0", "272"), (" 272 ", "272"), (None, None), ("10.05", "10.05"), ("2.0.0", "2.0")],
)
def test_norm_id(spark, raw, want):
    assert one(spark, raw, tx.norm_id("c")) == want
    assert one(spark, raw, tx.norm_id("c", empty=True)) == (want or "")


@pytest.mark.parametrize(
    ("raw", "want"), [("True", True), ("tRUE", True), ("false", False), (None, False), ("1", False)]
)
def test_as_bool(spark, raw, want):
    assert one(spark, raw, tx.as_bool("c")) is want


def test_cleaners(spark):
    raw = "RT @émile_1: See\thttps://x.example/é?q=1 &amp; #Big can’t STOP rt  www.a.example ok"
    assert one(spark, raw, tx.clean_basic("c")) == "RT : See &amp; #Big can’t STOP rt www.a.example ok"
    assert one(spark, raw, tx.clean_topic("c")) == "see big can t stop ok"
    assert one(spark, raw, tx.clean_sampling("c")) == "see amp can t stop ok"
    assert one(spark, "a  b\x1c c ", tx.squash_ws("c")) == "a b c"
    for clean in (tx.clean_basic, tx.clean_topic, tx.clean_sampling, tx.squash_ws):
        assert one(spark, None, clean("c")) == ""
        assert one(spark, raw, clean(clean("c"))) == one(spark, raw, clean("c"))


def test_retweet_marker_is_a_word(spark):
    assert one(spark, "rt rt start ért rt", tx.clean_topic("c")) == "start rt"


@pytest.mark.parametrize(
    ("raw", "want"), [("a b c", False), ("aa b cc", True), ("abc def", False), ("", False)]
)
def test_is_useful(spark, raw, want):
    assert one(spark, raw, tx.is_useful("c")) is want


def test_parse_time(spark):
    def shown(raw):
        return one(spark, raw, F.date_format(tx.parse_ts("c"), "yyyy-MM-dd HH:mm:ss"))

    assert shown("Tue Oct 31 22:10:47 +0000 2017") == "2017-10-31 22:10:47"
    assert shown("Tue Oct 31 22:10:47 +0200 2017") == "2017-10-31 20:10:47"
    assert shown("soon") is None and shown(None) is None


def test_counts_and_lists(spark):
    assert one(spark, "", tx.n_words("c")) == 0
    assert one(spark, " a  b ", tx.n_words("c")) == 2
    assert one(spark, "", tx.n_flags("c")) == 0
    assert one(spark, "a|b|c", tx.n_flags("c")) == 3
    assert one(spark, "x http://a b https://c/d?e", tx.urls("c")) == ["http://a", "https://c/d?e"]


def test_tokens_and_pairs(spark):
    assert one(spark, "It is a été-x 42", tx.with_bigrams(tx.tokens("c"))) == [
        "it", "is", "été", "42", "it is", "is été", "été 42",
    ]
    assert one(spark, "one", tx.with_bigrams(tx.tokens("c"))) == ["one"]
    assert one(spark, "", tx.with_bigrams(tx.tokens("c"))) == []
    assert one(spark, "été ñ", tx.strip_accents("c")) == "ete n"


RULES = {"first": ["alpha", "beta"], "second": ["gamma", "delta"], "third": ["eta"]}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("alpha gamma", "first"),  # a tie goes to the label declared first
        ("alpha gamma delta", "second"),
        ("beta", "first"),  # "beta" also holds "eta": tie
        ("nothing", "none"),
        ("", "none"),
    ],
)
def test_label_by_count(spark, text, want):
    assert one(spark, text, rl.label_by_count(F.col("c"), RULES, "none")) == want


def test_substring_and_whole_word(spark):
    assert one(spark, "i have an issue", rl.first_match(F.col("c"), lx.DEMO_RISK)) == "sue"
    assert one(spark, "i have an issue", rl.first_match(F.col("c"), lx.DEMO_RISK, True)) is None
    assert one(spark, "i will sue", rl.first_match(F.col("c"), lx.DEMO_RISK, True)) == "sue"
    assert one(spark, "beta", rl.cascade(F.col("c"), RULES, "none")) == "first"
    assert one(spark, "beta", rl.signals(F.col("c"), RULES)) == ["first", "third"]


def test_silver_order(spark):
    def label(text):
        return one(spark, text, labelling.silver_intent("c"))

    assert label("cancel my refund") == "order_change_cancel"
    assert label("REFUND my card charge") == "return_refund_replacement"
    assert label("a chemist") == "payment_billing"  # "emi" inside a longer word
    assert label(None) == "unknown"


def contextual(spark, *rows):
    return spark.createDataFrame(
        [(m, c, r, 1) for m, c, r in rows],
        "current_customer_message string, conversation_context string, "
        "historical_brand_response string, context_turn_count int",
    )


def test_v2_choice_and_reasons(spark):
    rows = [
        ("kindle", "", ""),  # score 2, margin 2
        ("kindle refund", "", ""),  # two intents tie
        ("", "kindle", ""),  # context only: 1
        ("hello", "", ""),
        ("my kindle device still broken", "one two three four five six seven eight nine ten "
         "eleven twelve thirteen fourteen fifteen sixteen", ""),
    ]
    got = labelling.label_v2(contextual(spark, *rows)).collect()
    assert [r.candidate_intent for r in got] == [
        "product_device_issue", "ambiguous", "ambiguous", "unknown", "product_device_issue",
    ]
    assert got[0].candidate_score == 2 and got[0].candidate_margin == 2
    assert got[0].candidate_matches == "kindle"
    assert got[0].ambiguity_reasons == ["short_message"]
    assert got[1].ambiguity_reasons == ["short_message", "competing_intents"]
    assert got[4].ambiguity_reasons == ["deictic_reference", "context_dependent"]
    assert got[4].ambiguity_candidate


def test_v2_contextual_flag_and_speakers(spark):
    rows = [("still nothing", "Customer: hi\nShopHelp: ok", "")]
    df = contextual(spark, *rows)
    flags = labelling.label_v2(df, ["flags"]).first().escalation_flags
    assert flags == ["contextual_failed_support"]  # the prefix holds "help"
    without = labelling.label_v2(df, ["flags"], speakers=["Customer", "ShopHelp"]).first()
    assert without.escalation_flags == []


@pytest.mark.parametrize(
    ("message", "context", "want"),
    [
        ("a b c", "", 2), ("a b c d", "", 1), ("a b c d e f", "", 1), ("a b c d e f g", "", 0),
        ("say it now please my friend ok then", "", 2), ("items for me to buy in one go", "", 0),
        ("a b c d e f g", "x" * 150, 0), ("a b c d e f g", "x" * 151, 1),
    ],
)
def test_v1_ambiguity(spark, message, context, want):
    df = contextual(spark, (message, context, ""))
    assert labelling.label_v1(df, ["ambiguity"]).first().ambiguity_score == want


def test_parts_are_checked(spark):
    with pytest.raises(ValueError, match="unknown parts"):
        labelling.label_v1(contextual(spark, ("a", "b", "c")), ["mood"])
