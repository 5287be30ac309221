"""XES files, file formats and streams."""

import gzip
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.operators import events as E
from loomflow.operators import schemas
from loomflow.plans import exploratory as X
from loomflow.sources import digests, files, xes, xes_text
from loomflow.streaming import late, pairing

XES = """<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/">
<trace><string key="concept:name" value="c1"/><boolean key="flag" value="true"/>
<event><string key="concept:name" value="A"/><date key="time:timestamp" value="2018-01-01T10:00:00+01:00"/><string key="lifecycle:transition" value="COMPLETE"/></event>
<event><string key="concept:name" value="X"/><string key="concept:name" value="B"/><date key="time:timestamp" value="2018-01-01T09:30:00Z"/><string key="lifecycle:transition" value="complete"/></event>
<event><string key="concept:name" value="C"/><date key="time:timestamp" value="bad"/><string key="lifecycle:transition" value="complete"/></event>
<event><date key="time:timestamp" value="2018-01-02T00:00:00Z"/><string key="lifecycle:transition" value="complete"/></event>
<event><string key="concept:name" value="D"/><date key="time:timestamp" value="2018-01-03T00:00:00Z"/><string key="lifecycle:transition" value="start"/></event></trace>
<trace><string key="concept:name" value="c2"/><event><string key="concept:name" value="A"/><date key="time:timestamp" value="2018-02-01T00:00:00Z"/></event></trace></log>"""


@pytest.fixture(params=["log.xes", "log.xes.gz"])
def path(tmp_path, request):
    p = tmp_path / request.param
    with gzip.open(p, "wt") if p.suffix == ".gz" else open(p, "w") as f:
        f.write(XES)
    return str(p)


def test_xes(spark, path):
    raw = xes.raw_events(xes.read_traces(spark, path, partitions=2))
    counts = xes.parse_counts(xes.rejected(raw, by_lifecycle=True)).first()
    assert (counts.raw_cases, counts.raw_events, counts.bad_lifecycle, counts.bad_timestamp, counts.bad_activity, counts.kept_events) == (2, 6, 2, 1, 1, 2)
    obs = E.observations(xes.log(xes.rejected(raw, by_lifecycle=True))).orderBy("origin").collect()
    assert [(r.transition, r.delay) for r in obs] == [("A -> B", 0.5), (None, None)]


def test_xes_profile(spark, path):
    got = {(r.scope, r.key, r.tag): (r.n, r.samples) for r in xes.profile(xes.read_traces(spark, path)).collect()}
    assert got[("trace", "flag", "boolean")] == (1, ["true"]) and got[("event", "concept:name", "string")] == (6, ["A", "B", "C", "D", "X"])


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None), ("a", 2.0)], "k string, v double")
    files.write_csv(df, str(tmp_path / "t.csv"))
    catalog = files.Catalog(spark, str(tmp_path), {"t": "k string, v double"})
    assert sorted(map(str, catalog.csv("t").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(PermissionError):
        catalog.csv("later")
    cfg, calls = Config(datetime(2020, 1, 1), datetime(2020, 2, 1), datetime(2020, 3, 1)), []
    make = lambda: calls.append(1) or df
    assert [files.cached(spark, str(tmp_path), "x", c, make).count() for c in (cfg, cfg, cfg.but(kappa=0.5))] == [3, 3, 3] and len(calls) == 2
    files.write_json({"x": float("nan"), "y": [1, float("inf")]}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"x": None, "y": [1, None]}
    assert files.detail(df, 2)[1] and not files.detail(df, 3)[1]
    assert files.provenance(spark, cfg, {"a": df})["outputs"] == files.provenance(spark, cfg, {"a": df.orderBy("v")})["outputs"]


def test_stream_of_pairs_equals_batch(spark, tmp_path):
    rows = [(k % 3, datetime(2024, 1, 1, k), k, "AB"[k % 2]) for k in range(12)]
    df = spark.createDataFrame(rows, "case_id long, ts timestamp, ord long, activity string")
    for k in range(2):
        df.where(F.floor(F.col("ord") / 6) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pairing.stream_pairs(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.case_id, r.origin, r.transition, r.delay) for r in spark.table("pairs").collect()}
    batch = E.observations(df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).where("destination is not null")
    assert got == {(r.case_id, r.origin, r.transition, r.delay) for r in batch.collect()}
    blocks = pairing.stream_blocks(spark.table("pairs"), "2024-01-01", 3).collect()
    assert sum(r.n for r in blocks) == len(got) and {r.window.start for r in blocks} == {datetime(2024, 1, 1)}


def test_two_parses_agree_and_a_difference_fails(spark, path):
    first = xes.parse_counts(xes.rejected(xes.raw_events(xes.read_traces(spark, path)), by_lifecycle=True))
    second = xes.parse_counts(xes.rejected(xes.raw_events(xes_text.second_parse(spark, path)), by_lifecycle=True))
    xes_text.same_parses(first, second)
    assert all(r.equal for r in xes_text.parses_compared(first, second).collect())
    with pytest.raises(ValueError, match="kept_events"):
        xes_text.same_parses(first, second.withColumn("kept_events", F.col("kept_events") + 1))


def test_a_plain_log_is_split(spark, tmp_path):
    trace = '<trace><string key="concept:name" value="c{0}"/><event><string key="concept:name" value="A{0}"/><date key="time:timestamp" value="2018-01-01T10:00:00Z"/></event></trace>\n'
    (tmp_path / "big.xes").write_text("<log>" + "".join(trace.format(k) for k in range(5000)) + "</log>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        own = xes_text.records(spark, str(tmp_path / "big.xes"))
        assert own.rdd.getNumPartitions() > 4 and own.distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_events_of_malformed_traces_are_recovered(spark, tmp_path):
    event = '<event><string key="concept:name" value="{}"/><date key="time:timestamp" value="2018-01-0{}T10:00:00Z"/></event>'
    bad = '<event><string key="concept:name" value="broken><date key="time:timestamp" value="x"/></event>'
    text = f"<log><trace><string key=\"concept:name\" value=\"good\"/>{event.format('A', 1)}{event.format('B', 2)}</trace>" f"<trace><string key=\"concept:name\" value=\"bad\"/>{event.format('A', 3)}{bad}{event.format('C', 4)}</trace></log>"
    (tmp_path / "log.xes").write_text(text)
    rows = xes_text.recovered(spark, str(tmp_path / "log.xes")).orderBy("case_id", "ord").collect()
    assert [(r.case_id, r.ord, r.activity, r.recovered, r.malformed) for r in rows] == [("bad", 0, "A", True, False), ("bad", 1, None, True, True), ("bad", 2, "C", True, False), ("good", 0, "A", False, False), ("good", 1, "B", False, False)]
    assert rows[2].ts == datetime(2018, 1, 4, 10)


def test_digests_see_every_byte(spark, tmp_path):
    data = bytearray(range(256)) * 40
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(data)
    (tmp_path / "in" / "empty.bin").write_bytes(b"")
    got = digests.ranges(spark, str(tmp_path / "in"), 1000)
    assert got.count() == 11
    base = digests.signature(spark, str(tmp_path / "in"), 1000)
    seen = {base}
    for place in (0, 999, 1000, 5000, len(data) - 1):
        other = bytearray(data)
        other[place] ^= 1
        (tmp_path / "in" / "a.bin").write_bytes(other)
        seen.add(digests.signature(spark, str(tmp_path / "in"), 1000))
    (tmp_path / "in" / "a.bin").write_bytes(data[1000:2000] + data[:1000] + data[2000:])
    seen.add(digests.signature(spark, str(tmp_path / "in"), 1000))
    (tmp_path / "in" / "a.bin").write_bytes(data + b"x")
    seen.add(digests.signature(spark, str(tmp_path / "in"), 1000))
    assert len(seen) == 7 + (data[1000:2000] != data[:1000])
    (tmp_path / "in" / "a.bin").write_bytes(data)
    cfg, calls = Config(datetime(2020, 1, 1), datetime(2020, 2, 1), datetime(2020, 3, 1)), []
    make = lambda: calls.append(1) or spark.range(3)
    for change in (False, False, True, False):
        if change:
            (tmp_path / "in" / "a.bin").write_bytes(data[:-1] + b"!")
        assert digests.signed(spark, str(tmp_path), "x", cfg, str(tmp_path / "in"), make).count() == 3
    digests.signed(spark, str(tmp_path), "x", cfg, str(tmp_path / "in"), make, version=2)
    assert len(calls) == 3


def test_schema_of_mixed_json(spark):
    rows = ['{"a": 1, "b": "x", "c": null}', '{"a": 2.5, "b": 3, "d": [1]}', '{"a": null, "d": {"e": 1}}', "not json", None, "[1]", '{"f": true}']
    got = {r.key: r for r in schemas.profile(spark.createDataFrame([(x,) for x in rows], "j string"), "j", "s").collect()}
    assert {k: (r.tag, r.n, r.nulls, r.kinds) for k, r in got.items()} == {"a": ("double", 3, 1, 3), "b": ("string", 2, 0, 2), "c": ("null", 1, 1, 1), "d": ("string", 2, 0, 2), "f": ("boolean", 1, 0, 1)}
    assert got["a"].samples == "1 | 2.5" and got["c"].samples == ""


def test_scans_without_a_filter_are_refused(spark, tmp_path):
    files.write_table(spark.range(10), str(tmp_path / "t"))
    assert files.filtered_only(files.read_table(spark, str(tmp_path / "t"), where=F.col("id") > 5)).count() == 4
    with pytest.raises(PermissionError):
        files.filtered_only(files.read_table(spark, str(tmp_path / "t")))


def test_json_marks_and_provenance(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"n": 3,\n "x": {"y": 1.5}}')
    assert files.read_json(spark, str(tmp_path / "s.json"), "n long, x struct<y: double>").first() == (3, (1.5,))
    (tmp_path / "bad.json").write_text('{"n": ')
    with pytest.raises(Exception):
        files.read_json(spark, str(tmp_path / "bad.json"), "n long").collect()
    files.write_csv_with_mark(spark.createDataFrame([("é", None)], "a string, b double"), str(tmp_path / "m.csv"))
    text = next((tmp_path / "m.csv").glob("part-*")).read_bytes()
    assert text.decode("utf-8-sig").splitlines()[:2] == ["a,b", "é,"] and text.startswith(b"\xef\xbb\xbf")
    cfg = Config(datetime(2020, 1, 1), datetime(2020, 2, 1), datetime(2020, 3, 1))
    ports = spark.createDataFrame([("Mean burden", 3, 1, "a -> b"), ("Mean burden", 3, 2, "b -> c")], "method string, K int, rank int, transition string")
    one, two = files.provenance(spark, cfg, {}, ports), files.provenance(spark, cfg, {}, ports.orderBy("transition"))
    assert one == two and one["portfolios"] != files.provenance(spark, cfg, {}, ports.limit(1))["portfolios"] and len(one["code"]) == 64


def test_tables_agree_by_key(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("y", 2, None), (None, 3, "q"), ("z", 4, "r")], "k string, v int, t string")
    b = spark.createDataFrame([("x", 1, "p"), ("y", 2, None), (None, 3, "other"), ("w", 4, "r")], "k string, v int, t string")
    assert X.agreement(a, b, ["k", "v"], ["t"]).first() == (4, 1, 1, 1) and X.agreement(a, a, ["k", "v"], ["t"]).first() == (4, 0, 0, 0)


def test_late_events_are_counted_and_idle_state_goes(spark, tmp_path):
    """Three files, with a restart between each; the last has an event behind the watermark, and one that moves it on."""
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    parts = [[(1, t(0), 1, "A"), (1, t(3), 3, "C"), (2, t(1), 2, "A")], [(1, t(2), 4, "B"), (1, t(30), 5, "D"), (2, t(29), 6, "B")], [(1, t(4), 7, "late"), (1, t(31), 8, "E"), (3, t(400), 9, "Z")], [(3, t(500), 10, "Y")], [(3, t(900), 11, "X")]]
    schema = "case_id long, ts timestamp, ord long, activity string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", late.PROVIDER)
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = late.paired(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5 hours", timedelta(hours=48))
            q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
            q.processAllAvailable()
            state = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, q.recentProgress)]
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.schema(late.OUTPUT).parquet(str(tmp_path / "out")).collect()
    pairs = {(r.case_id, r.origin, r.destination, r.transition) for r in out if r.kind == "pair"}
    assert {(r.case_id, r.origin, r.transition) for r in out if r.kind == "late"} == {(1, t(4), "late")}
    want = {(1, t(0), t(2), "A -> B"), (1, t(2), t(3), "B -> C"), (1, t(3), t(30), "C -> D"), (1, t(30), t(31), "D -> E"), (2, t(1), t(29), "A -> B")}
    assert want <= pairs and all(p[0] == 3 for p in pairs - want)
    blocks = {r.block: (r.late, r.pairs) for r in late.late_by_block(spark.createDataFrame(out, late.OUTPUT), "2024-01-01", 1).collect()}
    assert blocks[0] == (1, 4) and state[-1] < 12, state
