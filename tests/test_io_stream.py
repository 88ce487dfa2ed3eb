import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadlens.sources import readers, writers
from threadlens.streaming.triage_stream import read_sink, triage_stream


def test_csv_round_trip(spark, tmp_path):
    rows = [
        ("1.0", "ann", "True", "Tue Oct 31 22:10:47 +0000 2017", 'two\nlines, "quoted"', None, None),
        ("2", "shop", "False", "bad time", " padded ", "3,4", "1.0"),
    ]
    df = spark.createDataFrame(rows, ",".join(f"{c} string" for c in readers.TWEET_COLUMNS))
    writers.write_csv(df, str(tmp_path / "t"))
    back = {r.tweet_id: r for r in readers.typed_tweets(
        readers.read_tweets(spark, str(tmp_path / "t"))).collect()}
    assert back["1"].text == 'two\nlines, "quoted"' and back["1"].inbound is True
    assert back["1"].in_response_to_tweet_id is None
    assert back["2"].created_at is None and back["2"].text == " padded "
    assert back["2"].in_response_to_tweet_id == "1" and back["2"].response_tweet_id == "3,4"
    few = readers.read_tweets(spark, str(tmp_path / "t"), ["tweet_id", "response_tweet_id"])
    assert {tuple(r) for r in few.collect()} == {("1.0", ""), ("2", "3,4")}


def test_jsonl(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    line = {"id": "1", "customer": "c", "intent": "i", "resolution": "r", "brand_reply": "b"}
    path.write_text(json.dumps(line) + "\n\n" + json.dumps({**line, "id": "2"}) + "\n")
    assert readers.read_cases(spark, str(path)).count() == 2


def test_column_checks(spark):
    df = spark.createDataFrame([("t", 1)], "tweet string, other int")
    assert readers.first_existing(df, ["text", "tweet"]) == "tweet"
    assert readers.resolve_text_author(df).first().author == ""
    with pytest.raises(ValueError, match="text column"):
        readers.resolve_text_author(df.drop("tweet"))
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        readers.require_columns(df, ["a", "tweet", "b"])


def test_metrics_json(spark, tmp_path):
    long = spark.createDataFrame(
        [("m", "accuracy", 0.5), ("m", "f1", 0.25), ("n", "x", 1.0)],
        "section string, key string, value double",
    )
    writers.write_metrics_json(long, str(tmp_path / "m"))
    text = spark.read.text(str(tmp_path / "m")).first()[0]
    assert json.loads(text) == {"m": {"accuracy": 0.5, "f1": 0.25}, "n": {"x": 1.0}}


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    schema = "message_id string, message string, context string, created_at timestamp"
    source = str(tmp_path / "in")
    rows = spark.range(40).select(
        F.pmod("id", F.lit(30)).cast("string").alias("message_id"),
        F.lit("hello").alias("message"), F.lit("").alias("context"),
        F.timestamp_seconds(F.lit(1000) + F.pmod("id", F.lit(30))).alias("created_at"),
    )
    rows.repartition(4).write.parquet(source)

    def work(batch):
        return batch.select("message_id", F.upper("message").alias("shout"))

    sink = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    args = (work, sink, str(tmp_path / "checkpoint"))
    triage_stream(stream, *args, available_now=True).awaitTermination()
    want = {tuple(r) for r in work(rows).distinct().collect()}
    got = [tuple(r) for r in read_sink(spark, sink).collect()]
    assert len(got) == 30 and set(got) == want
    triage_stream(stream, *args, available_now=True).awaitTermination()  # nothing new
    assert read_sink(spark, sink).count() == 30


def test_late_messages_are_kept_and_scratch_is_deleted(spark, tmp_path):
    """Three batches: the second arrives two days late, the third repeats both."""
    from threadlens.session import cut_lineage, shared_dir

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "message_id string, message string, created_at timestamp"
    stream = spark.readStream.schema(schema).parquet(source)
    used = []

    def work(batch):
        used.append(cut_lineage(batch.select("message_id", "created_at")))
        return used[-1]

    def left_over():
        base = Path(shared_dir(spark).removeprefix("file://")) / "threadlens"
        return {p.name for p in base.glob("scratch-*")}

    before = left_over()
    for ids, at in ((range(5), 1_000_000), (range(5, 9), 1_000_000 - 2 * 86_400), (range(9), 2_000_000)):
        rows = [(str(i), "hi", datetime.fromtimestamp(at + i)) for i in ids]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        triage_stream(stream, work, sink, str(tmp_path / "check"), available_now=True).awaitTermination()
    got = [r.message_id for r in read_sink(spark, sink).collect()]
    assert sorted(got) == [str(i) for i in range(9)]
    assert len(used) == 3 and left_over() == before


def test_ids_are_kept_in_the_state_not_read_from_the_sink(spark, tmp_path):
    """After a restart repeated ids stay out although the files that held them are gone,
    and a later batch reads no more than its own rows."""
    import shutil

    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    schema = "message_id string, message string"
    stream = spark.readStream.schema(schema).parquet(source)
    read = []

    def work(batch):
        read.append(batch.count())
        return batch

    def arrive(ids):
        rows = [(None if i is None else str(i), "hi") for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        triage_stream(stream, work, sink, check, available_now=True).awaitTermination()

    arrive([*range(50), 3, 4, None, None])
    arrive([*range(40, 60), None])
    shutil.rmtree(f"{sink}/batch=0")
    arrive([*range(70), 69])
    assert read == [51, 10, 10]
    got = sorted(int(r.message_id) for r in read_sink(spark, sink).collect())
    assert got == list(range(50, 70))
    with pytest.raises(ValueError, match="another checkpoint"):
        triage_stream(stream, work, sink, str(tmp_path / "new"), available_now=True)


CSV_ROWS = [
    ("1", "plain"), ("2", "two\nlines"), ("3", 'a "quoted" word'), ("4", '"'), ("5", '""\n""'), ("6", ""),
    ("7", None), ("8", "\n\n\n"), ("9", "a,b\r\nc"), ("10", "ä中\n,\"x\"\n" * 9), ("11", "y" * 700),
    ("12", "\n" + "z\n" * 40), ("13", " padded "), ("14", "id,text"), ("15", "end"),
]


@pytest.mark.parametrize(
    "cut, ending, broadcast",
    [(17, "\n", True), (23, "\r\n", True), (200, "\n", True), (100_000, "\r\n", True), (61, "\n", False)],
)
def test_csv_ranges_equal_the_multi_line_reader(spark, tmp_path, monkeypatch, cut, ending, broadcast):
    """Byte ranges end inside quotes, between doubled quotes, in line ends and in characters."""
    from threadlens.sources import csv_records

    def cell(v):
        return "" if v is None else '"' + v.replace('"', '""') + '"' if v == "" or set(v) & set(',"\r\n') else v

    read = [(i, t or None) for i, t in CSV_ROWS]  # an empty field is null, quoted or not
    for name, rows in (("a", CSV_ROWS), ("b", CSV_ROWS[::-1]), ("c", CSV_ROWS[:1]), ("d", [])):
        text = "".join(f"{cell(i)},{cell(t)}{ending}" for i, t in [("id", "text"), *rows])
        if name == "b":
            text = "\ufeff" + text.rstrip("\r\n")  # a mark at the start, no end of the last line
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    if not broadcast:
        monkeypatch.setattr(csv_records, "BROADCAST_ROWS", 0)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(keys[0], cut)
        spark.conf.set(keys[1], 0)
        found = readers.read_csv_strings(spark, str(tmp_path), ["id", "text"])
        got = sorted(((r.id, r.text) for r in found.collect()), key=str)
        if cut < 50:
            assert found.rdd.getNumPartitions() > 8
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert got == sorted([*read, *read, *read[:1]], key=str)
    if ending == "\r\n":
        return  # Spark's reader changes the line ends inside fields there
    plain = spark.read.csv(str(tmp_path / "a.csv"), header=True, multiLine=True, quote='"', escape='"')
    assert sorted(((r.id, r.text) for r in plain.collect()), key=str) == sorted(read, key=str)


def test_csv_headers_are_checked_and_open_quotes_end_with_the_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,text\n1,"open\n2,b\n')
    rows = readers.read_csv_strings(spark, str(tmp_path / "x.csv"), ["id", "text"]).collect()
    assert [r.id for r in rows] == ["1"] and rows[0].text.startswith("open")
    (tmp_path / "y.csv").write_text("text,id\n1,2\n")
    with pytest.raises(Exception, match="the header is not id,text"):
        readers.read_csv_strings(spark, str(tmp_path / "y.csv"), ["id", "text"]).collect()


@pytest.mark.parametrize("folder", [True, False])
def test_conversation_stream_of_files_and_folders(spark, tmp_path, folder):
    from threadlens.suite import triage as queries

    rows = spark.range(20).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'x' AS text")
    path = tmp_path / "conversations.parquet"
    if folder:
        rows.repartition(3).write.parquet(str(path))
    else:
        rows.toPandas().to_parquet(path)
    job = (
        queries._conversation_stream(spark, str(tmp_path)).writeStream.format("memory")
        .queryName(f"conversations_{folder}").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    assert spark.table(f"conversations_{folder}").count() == 20
