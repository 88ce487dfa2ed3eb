from pyspark.sql import functions as F

from threadlens.operators import dedup, history, pairing, profile, threads
from threadlens.operators.sizing import salted_join

SCHEMA = (
    "tweet_id string, author_id string, inbound boolean, created_at timestamp, text string, "
    "response_tweet_id string, in_response_to_tweet_id string"
)


def tweets(spark, rows):
    """(id, author, text, parent)"""
    df = spark.createDataFrame(
        [(i, a, a != "shop", t, p, n) for n, (i, a, t, p) in enumerate(rows)],
        "tweet_id string, author_id string, inbound boolean, text string, "
        "in_response_to_tweet_id string, n int",
    )
    return df.select(
        "tweet_id", "author_id", "inbound", F.timestamp_seconds(F.col("n") + 1000).alias("created_at"),
        "text", F.lit(None).cast("string").alias("response_tweet_id"), "in_response_to_tweet_id",
    )


CHAIN = [
    ("1", "ann", "first", None),
    ("2", "shop", "reply one", "1"),
    ("3", "ann", "  second\n more ", "2"),
    ("4", "shop", "reply two", "3"),
    ("5", "ann", "third", "4"),
    ("6", "shop", "reply three", "5"),
    ("7", "shop", "again", "5"),  # two replies to one message
    ("8", "shop", "lost", "99"),  # missing parent
    ("9", "shop", "to itself", "2"),  # brand parent
    ("10", "shop", "opens", None),
    ("11", "bob", "loop", "12"),
    ("12", "bob", "loop back", "11"),
    ("13", "shop", "caught", "11"),
    ("14", "cat", "selfish", "14"),
    ("15", "shop", "ok", "14"),
    ("16", "dan", "start", None),
    ("17", "shop", "   ", "16"),  # blank: a hop without a turn
    ("18", "dan", "end", "17"),
    ("19", "shop", "bye", "18"),
]


def test_pairs_and_audit(spark):
    t = tweets(spark, CHAIN)
    pairs = pairing.build_pairs(t, "shop")
    got = {(r.customer_tweet_id, r.brand_tweet_id) for r in pairs.collect()}
    assert got == {
        ("1", "2"), ("3", "4"), ("5", "6"), ("5", "7"), ("11", "13"), ("14", "15"),
        ("16", "17"), ("18", "19"),
    }
    assert pairing.pair_audit(t, "shop").first().asDict() == {
        "matched": 8, "missing_parent": 1, "brand_parent": 1,
    }
    assert [r.brand_tweet_id for r in pairing.orphan_replies(t, "shop").collect()] == ["8"]


def test_salting_changes_nothing(spark):
    rows = [("0", "ann", "hub", None)] + [(str(i), "shop", f"r{i}", "0") for i in range(1, 60)]
    rows += [("100", "bob", "q", None), ("101", "shop", "a", "100"), ("102", "shop", "b", "7777")]
    t = tweets(spark, rows)
    plain = pairing.build_pairs(t, "shop")
    salted = pairing.build_pairs(t, "shop", hot_rows=5)
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0
    assert plain.count() == 60
    assert pairing.pair_audit(t, "shop", hot_rows=5).first() == pairing.pair_audit(t, "shop").first()


def test_left_join_keeps_rows_without_key(spark):
    left = spark.createDataFrame(
        [(i, None if i % 3 == 0 else "k") for i in range(30)], "id int, k string"
    )
    right = spark.createDataFrame([("k", 1), (None, 2)], "rk string, v int")
    out = salted_join(left, right, "k", "rk", ["id"], "left", hot_rows=4)
    assert out.count() == 30
    assert out.where("v = 1").count() == 20 and out.where("v is null").count() == 10


def test_chain_context(spark):
    got = {
        r.brand_tweet_id: r
        for r in threads.chain_context(tweets(spark, CHAIN), "shop", 3, "Shop").collect()
    }
    assert got["6"].conversation_context == "Customer: second more\nShop: reply two\nCustomer: third"
    assert got["6"].context_turn_count == 3
    assert got["2"].conversation_context == "Customer: first"
    assert got["13"].conversation_context == "Customer: loop back\nCustomer: loop"  # 2-cycle
    assert got["15"].conversation_context == "Customer: selfish"  # self-reply
    assert got["19"].conversation_context == "Customer: start\nCustomer: end"
    assert got["19"].context_turn_count == 2
    assert got["7"].conversation_context == got["6"].conversation_context


def test_thread_context(spark):
    t = tweets(spark, CHAIN)
    pairs = pairing.build_pairs(t, "shop")
    wide = threads.thread_wide(threads.thread_context(pairs, t))
    assert wide.count() == pairs.count()
    got = {r.brand_tweet_id: r for r in wide.collect()}
    assert got["6"].previous_turn_count == 2
    assert (got["6"].prev_1_customer, got["6"].prev_1_brand) == ("second\n more", "reply two")
    assert (got["6"].prev_2_customer_tweet_id, got["6"].prev_2_brand_tweet_id) == ("1", "2")
    assert got["6"].prev_3_customer == "" and got["2"].previous_turn_count == 0
    assert got["13"].previous_turn_count == 0  # the parent is not a brand reply
    text = wide.where("brand_tweet_id = '6'").select(threads.previous_turns_text(3, "Shop")).first()[0]
    assert text == "Customer: second\n more\nShop: reply two\nCustomer: first\nShop: reply one"


def test_numeric_ids_give_the_same_threads(spark):
    ids = ["tweet_id", "in_response_to_tweet_id"]
    t = tweets(spark, CHAIN)
    numeric = t.withColumns({c: F.col(c).cast("long") for c in ids})
    a = threads.chain_context(t, "shop").select("brand_tweet_id", "conversation_context")
    b = threads.chain_context(numeric, "shop").select(
        F.col("brand_tweet_id").cast("string"), "conversation_context"
    )
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
    audit = pairing.pair_audit(numeric, "shop", hot_rows=1).first()
    assert audit == pairing.pair_audit(t, "shop").first()


def test_pair_walk_ends_on_a_cycle(spark):
    rows = [
        ("1", "ann", "a", "4"), ("2", "shop", "b", "1"), ("3", "ann", "c", "2"),
        ("4", "shop", "d", "3"),
    ]
    t = tweets(spark, rows)
    wide = threads.thread_wide(threads.thread_context(pairing.build_pairs(t, "shop"), t))
    # 3 <- 2 <- 1 <- 4 <- 3: the walk from reply 4 sees 2, then 4 and must stop.
    assert {r.brand_tweet_id: r.previous_turn_count for r in wide.collect()} == {"2": 2, "4": 2}


def _pairs(spark, rows):
    """(customer, message id, reply id, customer second or None, reply second)"""
    df = spark.createDataFrame(
        rows, "customer_author_id string, customer_tweet_id string, brand_tweet_id string, "
        "c long, b long"
    )
    return df.select(
        "customer_author_id", "customer_tweet_id", "brand_tweet_id",
        F.concat(F.lit("m"), "customer_tweet_id").alias("customer_text"),
        F.concat(F.lit("r"), "brand_tweet_id").alias("brand_response"),
        F.timestamp_seconds("c").alias("customer_created_at"),
        F.timestamp_seconds("b").alias("brand_created_at"),
    )


def test_history(spark):
    rows = [("ann", str(i), f"b{i}", 100 + i, 200 + i) for i in range(5)]
    rows += [("bob", "50", "b50", None, 10), ("bob", "51", "b51", 5, 6)]
    rows += [("cat", "60", "b60", 5, 6), ("cat", "60", "b61", 5, 9)]
    got = dict(history.customer_history(_pairs(spark, rows), brand_label="Shop").collect())
    assert got["0"] == "m0"
    assert got["1"] == "Customer: m0\nShop: rb0\nCustomer: m1"
    assert got["4"].split("\n")[0] == "Customer: m1" and got["4"].count("\n") == 6
    assert got["50"].startswith("Customer: m51\n")  # no readable time sorts last
    assert got["60"] == "Customer: m60\nShop: rb60\nCustomer: m60"  # the last reply's context


def test_history_in_slices_equals_plain(spark):
    rows = [("hot", str(i), f"b{i}", None if i % 11 == 0 else 1000 + i // 3, 5000 + i)
            for i in range(400)]
    rows += [(f"u{i % 7}", f"x{i}", f"y{i}", 1000 + i, 2000 + i) for i in range(60)]
    p = _pairs(spark, rows)
    plain = history.customer_history(p)
    sliced = history.customer_history(p, hot_rows=20)
    assert plain.count() == 460
    assert plain.exceptAll(sliced).count() == 0 and sliced.exceptAll(plain).count() == 0


def test_attach_falls_back_to_the_message(spark):
    split = spark.createDataFrame(
        [("1.0", "own", "train"), ("2", "other", "train")],
        "customer_tweet_id string, customer_text string, split string",
    )
    ctx = spark.createDataFrame([("1", "with context")], "customer_tweet_id string, context_text string")
    attached = history.attach_context(split, ctx)
    assert {r.customer_tweet_id: r.context_text for r in attached.collect()} == {
        "1": "with context", "2": "other",
    }
    assert history.context_coverage(attached).first().asDict() == {
        "split": "train", "with_context": 1, "total": 2,
    }


def test_dedup_keeps_first_and_last(spark):
    df = spark.createDataFrame(
        [("k", 2, "b"), ("k", 1, "a"), ("k", None, "n"), ("j", None, "z")], "k string, o int, v string"
    )
    assert dict(dedup.dedup(df, ["k"], ["o", "v"]).select("k", "v").collect()) == {"k": "a", "j": "z"}
    assert dict(dedup.dedup(df, ["k"], ["o", "v"], last=True).select("k", "v").collect()) == {
        "k": "n", "j": "z",
    }
    with_text = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, " ")], "id int, t string")
    kept = dedup.dedup_text(with_text, F.lower(F.regexp_replace(F.trim("t"), " +", " ")), ["id"])
    assert [(r.id, r.clean_text) for r in kept.collect()] == [(1, "a b")]


def test_activity(spark):
    rows = [(str(i), "shop", "x", None) for i in range(4)] + [("9", "ann", "x", None), ("10", None, "x", None)]
    t = tweets(spark, rows)
    got = profile.brand_activity(t.withColumn("inbound", F.col("inbound") & F.col("author_id").isNotNull()), 2)
    assert got.first().asDict() == {
        "brand_author_id": "shop", "total_tweets": 4, "inbound_tweets": 0, "outbound_tweets": 4,
        "outbound_ratio": 1.0,
    }
