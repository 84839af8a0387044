import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from replyforge.functions.numbers import parse_id, parse_weekday_time
from replyforge.operators import metrics, profiling
from replyforge.plans import jobs, views
from replyforge.schemas import MESSAGES
from replyforge.sources import readers, stages, writers
from replyforge.streaming.route_stream import message_stream, route_stream

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,u1,True,t1,"two
lines, ""quoted""",2,
2,shop,False,t2,fine,,1.0
3,u1,True,t3,too,many,fields,here,9
4,u1,True,t4,too few
x,u2,maybe,t5,bad id,,junk
'''


def _file(text, name="m.csv"):
    path = os.path.join(tempfile.mkdtemp(), name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_scan(spark):
    messages, rejects = readers.read_messages(spark, _file(CSV))
    assert messages.schema == MESSAGES
    got = rows(messages, "tweet_id", "inbound", "text", "response_tweet_id", "in_response_to_tweet_id")
    assert got == [
        (1, True, 'two\nlines, "quoted"', "2", None), (2, False, "fine", None, 1),
        (4, True, "too few", None, None), (None, None, "bad id", None, None),
    ]
    assert messages.select("tweet_id").count() == 4
    assert rows(messages, "tweet_id") == [(1,), (2,), (4,), (None,)]
    assert rows(rejects, "line") == [("3,u1,True,t3,too,many,fields,here,9",)]


def test_csv_round_trip(spark):
    path = tempfile.mkdtemp() + "/out"
    df = spark.createDataFrame(
        [(1, "a", True, "t", ' lead, "q"\n\r tail ', "2", None)], MESSAGES
    )
    writers.export_csv(df, path)
    assert rows(readers.read_messages(spark, path)[0]) == rows(df)


def test_schema_peek_and_missing_columns(spark):
    schema = readers.peek_schema(spark, _file("a,b,c,d\n1,1.5,true,x\n2,,False,y\n"))
    assert schema.simpleString() == "struct<a:bigint,b:double,c:boolean,d:string>"
    df = spark.createDataFrame([], "tweet_id long, text string")
    assert rows(profiling.missing_columns(df)) == [
        ("author_id",), ("created_at",), ("in_response_to_tweet_id",), ("inbound",),
        ("response_tweet_id",),
    ]
    assert rows(profiling.schema_rows(df)) == [(1, "tweet_id", "bigint"), (2, "text", "string")]


def test_taxonomy(spark):
    text = "intents:\n  - name: b_one\n    priority: High\n  - name: a_two\n    examples:\n      - \"name: no\"\n"
    assert rows(readers.read_taxonomy(spark, _file(text, "t.yaml"))) == [(0, "b_one"), (1, "a_two")]


def test_taxonomy_names_of_any_form(spark):
    text = "- priority: High\n  name: tier2_support\n- {name: 'quoted'}\n"
    assert rows(readers.read_taxonomy(spark, _file(text, "t.yaml")), "name") == [
        ("quoted",), ("tier2_support",)]
    with pytest.raises(ValueError):
        readers.read_taxonomy(spark, _file("other: 1\n", "t.yaml"))


def test_ordered_export(spark, tmp_path):
    df = spark.createDataFrame([(5, "e"), (1, "a"), (3, "c, d")], "i long, t string")
    writers.export_csv(df, str(tmp_path / "x"), order_by=("i",))
    lines = []
    for part in sorted((tmp_path / "x").glob("part-*.csv")):
        lines += part.read_text().splitlines()[1:]
    assert lines == ["1,a", '3,"c, d"', "5,e"]


class _Session:
    """Only what ``shared_folder`` asks a session for."""

    def __init__(self, master, folder=None):
        self.conf = type("C", (), {"get": lambda _, key, default=None: folder})()
        self.sparkContext = type("S", (), {
            "master": master, "applicationId": "app",
            "getConf": lambda _: type("C", (), {"get": lambda _, key: folder})(),
        })()


def test_shared_folder():
    assert stages.shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        stages.shared_folder(_Session("yarn"))
    with pytest.raises(ValueError):
        stages.shared_folder(_Session("local-cluster[2,1,1024]"))
    assert stages.shared_folder(_Session("local[4]"))


def test_times_in_several_forms(spark):
    texts = ["2017-10-31 22:10:47", "Tue Oct 31 22:10:47 +0000 2017", "2017-10-31T23:10:47+01:00",
             "2017-10-31 22:10:47+00:00", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = profiling.date_range(df, "t").first()
    assert got["earliest"] == got["latest"] and got["unparsed"] == 2


def test_metrics_record(spark):
    preds = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "true_intent string, predicted_intent string"
    )
    path = tempfile.mkdtemp() + "/metrics"
    writers.write_metrics(metrics.metrics_record(preds), path)
    assert rows(readers.read_metrics(spark, path)) == [(0.5, 0.388889, 0.416667)]


def test_stage_cut_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    again = stages.cut(df, "test")
    assert rows(again) == rows(df) and again.dtypes == df.dtypes
    assert stages.shared_folder(spark) == stages.shared_folder(spark)


def test_partitioned_stage(spark):
    path = tempfile.mkdtemp() + "/stage"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "brand string, n int")
    writers.write_stage(df, path, "brand")
    assert rows(spark.read.parquet(path).where("brand = 'b'"), "n") == [(2,)]


def test_ids_and_times(spark):
    df = spark.createDataFrame(
        [("12.0",), ("12",), ("9007199254740993",), ("x",), ("",), (None,)], "v string"
    )
    assert [r[0] for r in df.select(parse_id(F.col("v"))).collect()] == [
        12, 12, 9007199254740993, None, None, None
    ]
    t = spark.createDataFrame([("Tue Oct 31 22:10:47 +0000 2017",), ("bad",)], "v string")
    shown = t.select(F.date_format(parse_weekday_time(F.col("v")), "yyyy-MM-dd HH:mm:ss")).collect()
    assert [r[0] for r in shown] == ["2017-10-31 22:10:47", None]


def test_inspect_job(spark):
    sf = "/root/testdata/sf0.001"
    report = jobs.inspect(views.messages_with_response(spark, sf))
    assert report["missing_columns"].count() == 0
    assert report["nulls"].count() == 7


def test_stream_splits_blanks_and_equals_batch(spark):
    source = tempfile.mkdtemp() + "/in"
    df = spark.createDataFrame(
        [(1, 0, "my parcel was stolen"), (2, 1, "  "), (3, 2, "refund please"), (4, 3, None)],
        "conv_id long, turn long, customer_text string",
    )
    df.write.parquet(source)
    out, rejects, state = (tempfile.mkdtemp() + "/x" for _ in range(3))
    stream = spark.readStream.schema(df.schema).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        route_stream(
            stream, views.with_model_stand_in, out, rejects, state, keep=("conv_id",)
        ).awaitTermination()
    routed = spark.read.parquet(out)
    assert rows(routed, "conv_id") == [(1,), (3,)]
    assert rows(spark.read.parquet(rejects), "conv_id") == [(2,), (4,)]
    from replyforge.operators.routing import respond, split_blank

    batch = respond(views.with_model_stand_in(split_blank(df)[0]), keep=("conv_id",))
    assert rows(routed, "conv_id", "response") == rows(batch, "conv_id", "response")


@pytest.mark.parametrize("files", [0, 1, 3])
def test_stream_of_a_table_that_is_a_file_or_a_folder(spark, tmp_path, files):
    """``files``: parts in a folder of the table's name; 0: one file of that name."""
    df = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "i long, t string")
    where = tmp_path / ("t.parquet" if files else "made")
    df.repartition(max(files, 1)).write.parquet(str(where))
    if not files:
        next(where.glob("part-*.parquet")).rename(tmp_path / "t.parquet")
    df.write.parquet(str(tmp_path / "other.parquet"))
    out = str(tmp_path / "out")
    message_stream(spark, str(tmp_path), df.schema, "t.parquet").writeStream.option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(df)
