"""Steps that must not fall to one task, one Python call per key, or one shuffle per counter."""

import re
from collections import defaultdict

from pyspark.sql import Row
from pyspark.sql import functions as F

from runlens.functions import decode as D
from runlens.operators import admission as A
from runlens.sources import documents as DO
from runlens.sources.derived import Derived
from runlens.streaming import stateful as W


def test_messages_of_one_file_are_built_in_many_tasks(spark, tmp_path):
    """A table of one row group is read by one task, and built and decoded by all."""
    rows = [(k, k % 50, f"{k % 5}-X", k) for k in range(400)]
    (spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, t long").withColumn("o_orderdate", F.timestamp_seconds("t"))
          .coalesce(1).write.parquet(str(tmp_path / "orders.parquet")))
    d = Derived(spark, str(tmp_path))
    got = A.decode_messages(d.raw_messages(7))
    used = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == 7
    plain = A.decode_messages(d.raw_messages())
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty() and got.count() == 400


def test_a_task_has_a_bounded_number_of_messages(spark, tmp_path, monkeypatch):
    """More rows are dealt to more tasks, equal rows and null keys too, and the
    one task that reads a file need not sort it before."""
    monkeypatch.setattr("runlens.session.ROWS_PER_TASK", 50)
    rows = [(None if k % 3 == 0 else k // 2, k % 50, f"{k % 5}-X", k // 2) for k in range(400)]
    (spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, t long").withColumn("o_orderdate", F.timestamp_seconds("t"))
          .coalesce(1).write.parquet(str(tmp_path / "orders.parquet")))
    d = Derived(spark, str(tmp_path))
    got = d.raw_messages(2)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) <= 150
    assert "RoundRobinPartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    plain = d.raw_messages()
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_hopeless_texts_are_not_parsed(spark):
    """Only a text that begins with '{' can be an object; the others decode to
    nothing or by base64, as when each was parsed."""
    b64 = "eyJhIjogMX0="   # {"a": 1}
    obj = '{"a": 1}'
    texts = {obj: True, " \n" + obj + "\u00a0": True, "\ufeff" + obj: False, "/**/" + obj: False, "[" + obj + "]": False, '"x"': False,
             "1": False, "": False, "{": False, b64: True, "\t" + b64 + "\n": True, b64[:6] + "\r\n" + b64[6:]: True, b64[:-1]: False,
             "WzFd": False, "\x0b" + obj: True, "{" + b64: True}
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)] + [(-1, None)], "k long, content string")
    out = D.decode_stage(df)
    got = {r.k: (r.v, r.p) for r in out.select("k", F.to_json("_v").alias("v"), F.to_json("_peek").alias("p")).collect()}
    for k, (x, ok) in enumerate(texts.items()):
        assert (got[k][0] == '{"a":1}') == ok and (got[k][0] is None) == (not ok), x
        assert (got[k][1] is not None) == (ok and "\r" not in x and x[:2] != "{e"), x
    assert got[-1] == (None, None)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_parse_json(") == plan.count("THEN try_parse_json(") == 2
    # what is not tried gives no object anyway
    direct = df.where(~F.coalesce(F.btrim("content"), F.lit("")).startswith("{")).select("content", F.try_parse_json("content").alias("v"))
    assert direct.where(D.is_object(F.col("v"))).where(~F.btrim("content", F.lit(" \n\r\t")).startswith("{")).isEmpty()


def test_last_stages_read_narrow_rows(spark):
    """The last status of a compile carries no error text through the aggregate; ties are settled as on whole rows."""
    ev = spark.createDataFrame([("c", "d", "failed", "killed", 5, 1, "E" * 500), ("c", "d", "failed", "timeout", 5, 1, "E"), ("k", "d", "running", "x", 1, 2, None)],
                               "compile_id string, deal_id string, status string, stage string, updated_at long, seq long, error string")
    last = A.last_stages(ev)
    assert {(r.compile_id, r.prev_stage) for r in last.collect()} == {("c", "timeout"), ("k", "x")}
    plan = last._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "max(" in x] and not [x for x in plan.split("\n") if "max(" in x and "error" in x]


class _Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = (value[0], [Row(*x) for x in value[1]])

    def clear(self):
        self.calls += 1
        self.value = None


class _Handle:
    def __init__(self):
        self.state, self.timers = _Value(), []

    def getValueState(self, name, schema):
        return self.state

    def registerTimer(self, t):
        assert t not in self.timers
        self.timers.append(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


class _Time:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_bucket_of_compiles_costs_one_state_entry():
    """A thousand compiles of a bucket: a few calls to the state, rows as by each on its own, and every one forgotten at its own time."""
    p, h = W.Redelivery(300), _Handle()
    p.init(h)
    rows = [Row(compile_id=f"c{i % 1000}", us=(i // 1000) * 200_000_000 + (i % 1000) * 10_000, seq=i) for i in range(3000)]
    said = list(p.handleInputRows((1,), iter(rows), _Time(0)))
    kept = defaultdict(list)
    for r in said:
        kept[r.compile_id].append(r.kept)
    assert len(kept) == 1000 and all(x == [True, False, False] for x in kept.values())
    assert h.state.calls <= 4 and len(h.timers) == 1
    wake = h.timers.pop()
    assert list(p.handleExpiredTimer((1,), _Time(wake + 1), None)) == []
    left = len(h.state.value[1])
    assert 0 < left < 1000 and len(h.timers) == 1
    h.timers.pop()
    list(p.handleExpiredTimer((1,), _Time(10**9), None))
    assert h.state.value is None and h.timers == []


def test_trace_documents_count_calls_without_a_shuffle_each(spark):
    runs = spark.createDataFrame([("c", 5), ("k", 6)], "compile_id string, t long").select(
        "compile_id", F.lit("d").alias("deal_id"), F.lit("w").alias("worker_sha"), F.lit("p").alias("parser_sha"), F.timestamp_seconds("t").alias("started_at"),
        F.timestamp_seconds("t").alias("finished_at"), F.lit(1).alias("entity_count"), F.lit(1).alias("atom_count"))
    timings = spark.createDataFrame([("c", 1, "s", 1.0, 1, 1, 0, 0)], "compile_id string, stage_no long, stage_name string, duration_ms double, input_count long, "
                                    "output_count long, warning_count long, error_count long")
    calls = spark.createDataFrame([("c", i, "verify" if i % 3 else "multi", f"m{i % 2}", 0.5) for i in range(7)],
                                  "compile_id string, call_id long, source string, model string, latency_sec double").select(
        "*", F.timestamp_seconds("call_id").alias("ts"), *[F.lit(1).alias(c) for c in ("prompt_size", "max_tokens", "response_size")])
    docs = DO.trace_documents(runs, timings, calls)
    got = {r.compile_id: r for r in docs.select("compile_id", F.from_json(F.get_json_object("trace", "$.llm_call_summary"),
                                                "total_calls long, by_source map<string,long>, by_model map<string,long>").alias("s")).select("compile_id", "s.*").collect()}
    assert got["c"].by_source == {"multi": 3, "verify": 4} and got["c"].by_model == {"m0": 4, "m1": 3} and got["c"].total_calls == 7
    assert got["k"].by_source == {} and got["k"].by_model == {} and got["k"].total_calls == 0
    assert docs._jdf.queryExecution().executedPlan().toString().count("ObjectHashAggregate(") <= 4


def test_foreign_base64_characters_go_without_a_replacing_expression(spark):
    """Every message that is no JSON object is cleaned once; a replacing
    regular expression took two thirds of the decode."""
    texts = ["", "a b", "aGk=\x00\x00", "\U0001F642aGk=\U0001F642", "日本aG k=", "$1\\aGk=", "\r\n\t-_.", "aéb", None, "====", "--aGk=--é-"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    got = df.select("content", D.base64_chars(F.col("content")).alias("c")).collect()
    assert all(r.c == (None if r.content is None else re.sub("[^A-Za-z0-9+/=]", "", r.content)) for r in got)
    plan = D.decode_stage(df)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("translate(translate(") + plan.count(", translate(") <= 1
    spread = spark.createDataFrame([("eyJk\r\nIjog MX0=",), ("eyJkIjogMX0",), ('{"d": 1}',), ("{broken",)], "content string")
    assert [r.d for r in D.decode_stage(spread).select(F.try_variant_get("_v", "$.d", "int").alias("d")).collect()] == [1, None, 1, None]
