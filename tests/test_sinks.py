"""Byte-exact payloads per sink, kind dispatch, runner error policy and the
custom writer data source."""

import glob
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lagscope import schemas as S
from lagscope.sinks import render as R
from lagscope.sinks import runner as RUN

TS = datetime(2024, 1, 1, 0, 1, 30, tzinfo=timezone.utc)


@pytest.fixture()
def metrics(spark):
    rows = [
        ("meter", S.TOPIC_RATE, "click", TS, (None, None, "click"), None, 60, 12.0, 0.000277, 4.798, None),
        ("gauge", S.LEADER, "click-0", TS, (None, 0, "click"), 2, None, None, None, None, None),
        ("gauge", S.GROUP_LAG, "g-click-1", TS, ("g", 1, "click"), 0, None, None, None, None, None),
        (None, "x", "y", TS, (None, None, None), 1, None, None, None, None, None),
        ("other", "x", "y", TS, (None, None, None), 1, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, S.METRICS)


def lines(df, col):
    return sorted(r[col] for r in df.collect())


def test_kind_dispatch_drops_unknown(metrics):
    # two unknown entries + one meter + two gauges -> three payloads
    assert R.kafka_json(metrics).count() == 3


def test_kafka_json(metrics):
    got = lines(R.kafka_json(metrics), "value")
    assert got == sorted([
        '{"name":"kafka_topic_rate","timestamp":"2024-01-01T00:01:30Z","meta":{"topic":"click"},'
        '"rate1":12,"rate5":0.000277,"rate15":4.798,"count":60}',
        '{"name":"kafka_leader_topic_partition","timestamp":"2024-01-01T00:01:30Z",'
        '"meta":{"partition":0,"topic":"click"},"value":2}',
        '{"name":"kafka_consumer_group_lag","timestamp":"2024-01-01T00:01:30Z",'
        '"meta":{"group":"g","partition":1,"topic":"click"},"value":0}',
    ])
    for line in got:
        json.loads(line)
    assert {r["topic"] for r in R.kafka_json(metrics).collect()} == {"metrics"}


def test_elasticsearch_omits_zero(metrics):
    docs = R.elasticsearch_docs(metrics).collect()
    assert {d["action"] for d in docs} == {'{"index":{"_index":"metrics","_type":"doc"}}'}
    got = sorted(d["document"] for d in docs)
    assert '{"name":"kafka_consumer_group_lag","timestamp":"2024-01-01T00:01:30Z",' \
           '"meta":{"group":"g","partition":1,"topic":"click"}}' in got
    assert '{"name":"kafka_topic_rate","timestamp":"2024-01-01T00:01:30Z","meta":{"topic":"click"},' \
           '"rate1":12,"rate5":0.000277,"rate15":4.798,"count":60}' in got


def test_collectd(metrics):
    got = lines(R.collectd_lines(metrics, "h", 60), "line")
    assert got == sorted([
        "PUTVAL h/kafka/kafka_topic_rate-click interval=60 "
        "1704067290:60,1704067290:12.000000,1704067290:0.000277,1704067290:4.798000,1704067290:U",
        "PUTVAL h/kafka/kafka_leader_topic_partition-click-0 interval=60 1704067290:2",
        "PUTVAL h/kafka/kafka_consumer_group_lag-g-click-1 interval=60 1704067290:0",
    ])


def test_influx(metrics):
    got = lines(R.influx_lines(metrics), "line")
    assert got == sorted([
        "kafka_topic_rate,topic=click count=60i,rate1=12,rate15=4.798,rate5=0.000277 1704067290",
        "kafka_leader_topic_partition,partition=0,topic=click value=2i 1704067290",
        "kafka_consumer_group_lag,group=g,partition=1,topic=click value=0i 1704067290",
    ])


def test_influx_escaping(spark):
    rows = [("gauge", "a b,c", "k", TS, ("g=1", 0, "t t"), 5, None, None, None, None, None)]
    got = R.influx_lines(spark.createDataFrame(rows, S.METRICS)).first()["line"]
    assert got == r"a\ b\,c,group=g\=1,partition=0,topic=t\ t value=5i 1704067290"


def test_log_lines(metrics):
    got = lines(R.log_lines(metrics), "line")
    assert ("consumerGroupOffsetMetrics {BaseMetric:{Name:kafka_leader_topic_partition Key:click-0 "
            "Timestamp:2024-01-01 00:01:30 +0000 UTC Meta:map[partition:0 topic:click]} Gauge:2}") in got
    assert any(x.startswith("offsetMetrics {BaseMetric:{Name:kafka_topic_rate Key:click ") for x in got)


def test_writer_records_have_no_key(metrics):
    rec = R.writer_records(metrics)
    assert "key" not in rec.columns
    m = {r["name"]: r["meta"] for r in rec.collect()}
    assert m[S.GROUP_LAG] == {"group": "g", "partition": "1", "topic": "click"}


def test_runner_policies(metrics):
    calls = []

    def boom(df, bid):
        calls.append(bid)
        raise RuntimeError("down")

    RUN.batch_sink(R.log_lines, boom, on_error="drop")(metrics, 3)
    assert calls == [3]
    with pytest.raises(RuntimeError):
        RUN.batch_sink(R.log_lines, boom, on_error="fail")(metrics, 4)
    with pytest.raises(ValueError):
        RUN.renderer("nope")


def test_runner_delivers_whole_batch(metrics, tmpdir_path):
    out = os.path.join(tmpdir_path, "collectd")
    RUN.batch_sink(RUN.renderer("collectd"), RUN.text_delivery(out))(metrics, 0)
    text = "".join(open(f).read() for f in glob.glob(f"{out}/batch_id=*/part-*"))
    assert text.count("PUTVAL") == 3


def test_custom_writer_source(spark, metrics, tmpdir_path):
    RUN.register_writer_source(spark)
    RUN.writer_delivery("tests.writer_plugin:write", out=tmpdir_path)(R.writer_records(metrics), 0)
    seen = []
    for f in glob.glob(f"{tmpdir_path}/w-*.jsonl"):
        seen += [json.loads(x) for x in open(f)]
    assert sorted(x["name"] for x in seen) == sorted([S.TOPIC_RATE, S.LEADER, S.GROUP_LAG])


def test_json_html_escaping(spark):
    rows = [("gauge", "a<b>&c", "k", TS, (None, 0, "t&t"), 5, None, None, None, None, None)]
    got = R.kafka_json(spark.createDataFrame(rows, S.METRICS)).first()["value"]
    assert got == ('{"name":"a\\u003cb\\u003e\\u0026c","timestamp":"2024-01-01T00:01:30Z",'
                   '"meta":{"partition":0,"topic":"t\\u0026t"},"value":5}')
    assert json.loads(got)["name"] == "a<b>&c"


def test_ndjson_bulk_delivery(metrics, tmpdir_path):
    out = os.path.join(tmpdir_path, "bulk")
    RUN.batch_sink(RUN.renderer("elasticsearch"), RUN.ndjson_delivery(out))(metrics, 0)
    lines = [x.rstrip("\n") for f in sorted(glob.glob(f"{out}/batch_id=*/part-*")) for x in open(f)]
    assert len(lines) == 6
    # every action line is immediately followed by its document
    for action, doc in zip(lines[0::2], lines[1::2]):
        assert json.loads(action) == {"index": {"_index": "metrics", "_type": "doc"}}
        assert "timestamp" in json.loads(doc)


def test_long_and_null_names_give_valid_json(spark):
    long_ = "n" * 12_000
    rows = [(kind, name, "k", TS, (None, 0, "t"), 5 if kind == "gauge" else None, *([1, 0.5, 0.5, 0.5, 0.5] if kind == "meter" else [None] * 5))
            for kind in ("gauge", "meter") for name in (long_, None, "")]
    df = spark.createDataFrame(rows, S.METRICS)
    for out in (R.kafka_json(df).select("value"), R.elasticsearch_docs(df).select("document")):
        docs = [json.loads(r[0]) for r in out.collect()]
        assert sorted(len(d.get("name", "")) for d in docs) == [0, 0, 0, 0, 12_000, 12_000]


def test_replayed_batch_replaces_its_folder(metrics, tmpdir_path):
    out = os.path.join(tmpdir_path, "replay")
    closed = []
    with RUN.batch_sink(RUN.renderer("collectd"), RUN.text_delivery(out), on_close=lambda: closed.append(1)) as sink:
        for batch_id in (7, 7, 8):
            sink(metrics, batch_id)
        assert not closed
    sink.close()
    assert closed == [1]
    lines = [x for f in glob.glob(f"{out}/batch_id=*/part-*") for x in open(f)]
    assert len(lines) == 6
