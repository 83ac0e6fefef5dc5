"""Edges of the trace operators: single documents, files, streams, the command line; and bulk against single."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import tracemill
from tracemill import Trace, TraceError, TraceFormatError, TraceSizeError, TraceSourceError, redact
from tracemill.document import parse_problem, printable, redact_text
from tracemill.functions import sanitise, strict_variant, summary_text
from tracemill.operators import collection, counts, explode_collection, explode_redacted, field, redact_column, redact_leaves, redact_typed, redacted_collection, session_id, trace_version, with_collections
from tracemill.plans.workload import CORPUS
from tracemill.sources import load_traces, scan_traces
from tracemill.streaming import stream_traces

LISTED = {
    "traceVersion": "0.1.0", "sessionId": "sess-A1", "startedAt": "2026-01-01T00:00:00Z", "later": {"unknown": [1, 2]},
    "findings": [{"id": "f1", "kind": "x", "evidence": {"excerpt": "shown"}}, {"id": "f2", "context": {"authorization": "synthetic-bearer"}}, 3],
    "decisions": [{"id": f"d{i}", "verdict": "DENY", "reasons": ["r"]} for i in range(5)],
    "vault": {"handles": ["<SECRET:card:ab12>"], "adapter": "memory", "password": "synthetic-1", "api_key": "synthetic-2", "X-Api-Key": "synthetic-3", "session_cookie": None, "private_key": ["synthetic-4"]},
}
LOGGED = {"session": {"id": "sess-B"}, "events": [{"kind": "finding", "token": "synthetic-5"}, "bare", {"type": "policy_decision"}, {"eventType": "policyDecision"}, {"event_type": "Find-ing"}, {"kind": 5, "type": "x"}, {"kind": "finding", "type": "decision"}]}
FIELDS = [
    '{}', '{"vault":{"b":1.0,"a":' + "9" * 45 + '},"findings":[{"z":1,"a":2.50},1e22,1.0]}', '{"id":7}', '{"id":0}', '{"id":-0}', '{"id":1.0}', '{"id":true}', '{"id":null}', '{"id":""}', '{"id":" "}', '{"sessionId":"","session_id":5}', '{"id":1e22}',
    '{"session":{"id":"a"}}', '{"session":{"id":7}}', '{"id":"t","session":{"sessionId":"n"}}', f'{{"id":{"9" * 45}}}', '{"id":[1]}', '{"version":3,"schema_version":""}', '{"trace_version":"q"}',
    '{"findings":[],"events":[{"kind":"finding"}]}', '{"findings":"x","events":[{"kind":"finding"}]}', '{"findings":{},"events":[{"kind":"finding"}]}', '{"findings":null,"events":[{"kind":"finding"}]}',
    '{"decisions":{},"policyDecisions":[1]}', '{"policy_decisions":[null]}', '{"events":[{"kind":"finding","type":"decision"}]}', '{"events":[{"kind":"indecision"},{"kind":"Find-ing"},{"kind":5,"type":"policyDecision"}]}', '{"events":{"kind":"finding"}}',
    json.dumps(LISTED), json.dumps(LOGGED), '{"sessionId":"a\\u001b[31m\\nb\\u00a0\\u200bc"}', json.dumps({"id": "é" * 128}), json.dumps({"id": "é" * 129}),
]


def test_single_document():
    t = Trace(LISTED)
    assert (t.session_id, t.trace_version, t.event_count, t.finding_count, t.decision_count) == ("sess-A1", "0.1.0", 0, 3, 5)
    assert t.summary() == "Session trace\nSession: sess-A1\nFindings: 3\nDecisions: 5"
    assert t.get("vault")["handles"] == ["<SECRET:card:ab12>"] and t.raw["vault"]["password"] == "synthetic-1"
    for shown in (t.redacted(), t.findings, t.decisions, t.events, t.get("vault"), t.summary(), repr(t)):
        assert "synthetic" not in json.dumps(shown)
    with pytest.raises(TypeError):
        t.raw["x"] = 1
    b = Trace(LOGGED)
    assert (b.session_id, b.event_count, b.finding_count, b.decision_count) == ("sess-B", 7, 3, 3)
    assert Trace({"x": None}).get("x", "d") is None and Trace({}).get("y", "d") == "d" and Trace({}).get("token") is None and Trace({"token": {}}).get("token") == "[redacted]"
    assert Trace({1: 2}).raw["1"] == 2
    with pytest.raises(TraceFormatError):
        Trace([1])
    assert set(tracemill.__all__) <= set(dir(tracemill)) and all(issubclass(e, TraceError) for e in (TraceFormatError, TraceSizeError, TraceSourceError))


def test_redaction_rules():
    assert redact("x", max_depth=0) == "[depth-limited]"
    assert redact({"a": 1, "token": {}}, max_depth=1) == {"a": "[depth-limited]", "token": "[redacted]"}
    assert redact({"password": None, "photo_kennel": 1, "handles": ("<SECRET:x:y>",)}) == {"password": "[redacted]", "photo_kennel": "[redacted]", "handles": ["<SECRET:x:y>"]}
    with pytest.raises(ValueError):
        redact({}, max_depth=-1)
    own = {"a": {"secret": 1}}
    assert redact(own) == {"a": {"secret": "[redacted]"}} and own["a"]["secret"] == 1
    deep = "leaf"
    for _ in range(63):
        deep = {"n": deep}
    t = Trace({"findings": [deep]})
    assert "leaf" not in json.dumps(t.redacted()) and "leaf" in json.dumps(t.findings)
    assert redact_text('{"b":1e999,"a":[1.5,-1e999],"token":NaN}') is None
    assert redact_text('{"b":1e999,"a":[1.5,-1e999],"s":"\\ud800é"}') in ('{"b":1e999,"a":[1.5,-1e999],"s":"\\ud800\\u00e9"}',)
    assert printable("a\x1b  b") == "a?? b" and len(printable("x" * 129)) == 131 and printable("x" * 128) == "x" * 128


def test_strict_corpus_in_one_document():
    for name, text, ok in CORPUS:
        assert (parse_problem(text) is None) == ok, name
    with pytest.raises(TraceFormatError) as e:
        Trace.from_json('{"password":"synthetic", "a":1, "a":2}')
    assert "synthetic" not in str(e.value) and e.value.__cause__ is None and "'a'" in str(e.value)


def test_bulk_equals_single(spark):
    df = spark.createDataFrame(list(enumerate(FIELDS)), "i int, text string").withColumn("doc", strict_variant(F.col("text")))
    doc, text = F.col("doc"), F.col("text")
    n = counts(doc)
    rows = df.select("i", session_id(doc, text).alias("session"), trace_version(doc, text).alias("version"), *[c.alias(k) for k, c in n.items()], summary_text(session_id(doc, text), n["finding_count"], n["decision_count"]).alias("summary"), redact_column(text).alias("masked"), field(text, "vault", '"none"').alias("vault"), redacted_collection(text, "findings").alias("findings"), sanitise(text).alias("shown")).collect()
    for r in rows:
        t = Trace.from_json(FIELDS[r.i])
        assert (r.session, r.version, r.event_count, r.finding_count, r.decision_count, r.summary) == (t.session_id, t.trace_version, t.event_count, t.finding_count, t.decision_count, t.summary()), FIELDS[r.i]
        compact = {"ensure_ascii": False, "separators": (",", ":")}
        assert r.masked == json.dumps(t.redacted(), **compact) and r.vault == json.dumps(t.get("vault", "none"), **compact)
        assert r.findings == [json.dumps(x, **compact) for x in t.findings] and r.shown == printable(FIELDS[r.i])
    one = with_collections(df.where(f"i = {FIELDS.index(json.dumps(LOGGED))}")).first()
    assert (one.event_count, one.finding_count) == (7, 3)
    got = [(r.pos, r.v) for r in explode_collection(df.where(f"i = {FIELDS.index(json.dumps(LOGGED))}"), "events", ["i"]).select("pos", F.to_json("value").alias("v")).collect()]
    assert got[1] == (1, '"bare"') and len(got) == 7
    assert df.select(F.size(collection(doc, "findings"))).where("doc IS NULL").count() == 0


def trees(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind < 3:
        return [rng.randrange(9), "s", None][kind]
    if kind == 3:
        return [trees(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {k: trees(rng, depth - 1) for k in rng.sample(["a", "b.c", "d\"e", "X-Api-Key", "author ization", "nested"], rng.randrange(5))}


def leaves(value, path="$", key=None):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, f"{path}[{json.dumps(k)}]", k)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}[{i}]")]
    return [(path, key, json.dumps(value, separators=(",", ":")))]


def test_session_of_many_thousand_events(spark):
    kinds = ["finding", "policy_decision", "view", "policyDecision", "click"]
    events = [{"id": i, "kind": kinds[i % 5], "authToken": f"synthetic-{i}"} for i in range(20_000)]
    text = json.dumps({"sessionId": "sess-1", "events": events})
    df = spark.createDataFrame([(text,)], "text string").withColumn("doc", strict_variant(F.col("text")))
    n = df.select(*[c.alias(k) for k, c in counts(F.col("doc")).items()]).first().asDict()
    assert n == {"event_count": 20_000, "finding_count": 4_000, "decision_count": 8_000}
    for name, step in (("events", lambda i: True), ("findings", lambda i: i % 5 == 0), ("decisions", lambda i: i % 5 in (1, 3))):
        rows = explode_collection(df, name, []).select("pos", F.expr("variant_get(value, '$.id', 'long')").alias("id")).collect()
        assert sorted(map(tuple, rows)) == list(enumerate(i for i in range(20_000) if step(i)))


def test_leaf_rows_equal_text_redaction(spark):
    rng = random.Random(3)
    docs = [{f"k{i}": trees(rng, 4)} for i in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, text string").withColumn("doc", strict_variant(F.col("text")))
    for depth in (0, 2, 6):
        got = sorted((r.i, r.path, r.value) for r in redact_leaves(df, ["i"], max_depth=depth).collect())
        assert got == sorted((i, p, v) for i, d in enumerate(docs) for p, _, v in leaves(redact(d, max_depth=depth)))
    with pytest.raises(Exception, match="deeper"):
        redact_leaves(df, ["i"], levels=1).collect()


def test_typed_redaction_prunes_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, ("m", "synthetic"), [("synthetic", 2)], {"Cookie": 1, "n": 2})], "id int, vault struct<adapter string, password string>, l array<struct<token string, x int>>, m map<string,int>").write.parquet(path)
    out = redact_typed(spark.read.parquet(path))
    row = out.first()
    assert row.vault.password == "[redacted]" and row.vault.adapter == "m" and row.l[0].token == "[redacted]" and row.l[0].x == 2 and row.m == {"Cookie": "[redacted]", "n": "2"}
    plan = out.select("vault")._jdf.queryExecution().executedPlan().toString()
    assert "password" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert redact_typed(spark.range(1), max_depth=1).first()[0] == "[depth-limited]"


def files(folder):
    put = {"ok.json": b'{"id":1}', "bom.json": b'\xef\xbb\xbf{"id":2}', "bad.json": b"\xff\xfe\x00{", "list.json": b"[1]", "twice.json": b'{"a":1,"a":2}', "_hidden.json": b'{"id":3}', ".dot.json": b"nope", "big.json": b'{"id":"' + b"x" * 40 + b'"}'}
    for name, data in put.items():
        (folder / name).write_bytes(data)
    (folder / "dir.json").mkdir()
    os.mkfifo(folder / "pipe.json")
    return [str(folder / n) for n in [*put, "dir.json", "pipe.json", "missing.json"]]


def test_admission(spark, tmp_path):
    paths = files(tmp_path)
    told = load_traces(spark, paths, max_bytes=30).collect()
    assert sorted(r.source for r in told) == sorted(paths)
    rows = {os.path.basename(r.source): r for r in told}
    want = {"ok.json": "ok", "bom.json": "ok", "bad.json": "format", "list.json": "format", "twice.json": "format", "_hidden.json": "ok", ".dot.json": "format", "big.json": "size", "dir.json": "source", "pipe.json": "source", "missing.json": "source"}
    assert {k: r.status for k, r in rows.items()} == want
    assert "twice" in rows["twice.json"].error and "utf-8" in rows["bad.json"].error and rows["bom.json"].text == '{"id":2}'
    for p in paths:
        try:
            Trace.load(p, max_bytes=30)
            status = "ok"
        except TraceError as e:
            status = e.status
        assert status == want[os.path.basename(p)]
    exact = str(tmp_path / "ok.json")
    assert Trace.load(exact, max_bytes=8).session_id == "1"
    with pytest.raises(TraceSizeError):
        Trace.load(exact, max_bytes=7)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            Trace.load(exact, max_bytes=bad)
        with pytest.raises(ValueError):
            load_traces(spark, [exact], max_bytes=bad)
    with pytest.raises(TraceFormatError):
        Trace.load(exact, encoding="no-such-codec")
    (tmp_path / "wide.json").write_bytes('{"id":"é"}'.encode("utf-16"))
    assert Trace.load(tmp_path / "wide.json", encoding="utf-16").session_id == "é"
    assert load_traces(spark, [tmp_path / "wide.json"], encoding="utf-16").first().status == "ok"
    assert {r.status for r in load_traces(spark, [exact], encoding="no-such-codec").collect()} == {"format"}


def test_folder_scan_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_bytes(b'{"id":1}')
    (folder / "b.json").write_bytes(b"x" * 50)
    (folder / "c.json").write_bytes(b"no")
    assert sorted(r.status for r in scan_traces(spark, str(folder), max_bytes=30).collect()) == ["format", "ok", "size"]
    q = stream_traces(spark, str(folder), max_bytes=30).select("status").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.status for r in spark.table("seen").collect()) == ["format", "ok", "size"]


def test_hidden_files_of_a_folder_are_rows(spark, tmp_path):
    for name in ("a.json", "_b.json", ".c.json", "_d/e.json", "f/.g.txt", "f/h.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b'{"id":1}')
    want = {"a.json": "ok", "_b.json": "source", ".c.json": "source", "_d/e.json": "source", "f/.g.txt": "source", "f/h.json": "ok"}
    assert {r.source.split(f"{tmp_path}/")[1]: r.status for r in scan_traces(spark, str(tmp_path)).collect()} == want
    assert {r.source.split(f"{tmp_path}/")[1]: r.status for r in scan_traces(spark, str(tmp_path), glob="*.json").collect()} == {k: v for k, v in want.items() if k.endswith("json")}


def test_values_keep_order_and_digits(spark):
    text = '{"x":{"b":1.0,"a":' + "1" * 45 + ',"c":1e999,"token":0},"events":[{"z":1,"a":2.50,"secret":[]},-0.0]}'
    df = spark.createDataFrame([(text,), ("[1]",), ("{",), (None,)], "text string")
    want = '{"b":1.0,"a":' + "1" * 45 + ',"c":1e999,"token":"[redacted]"}'
    assert [r[0] for r in df.select(field(F.col("text"), "x")).collect()] == [want, None, None, None]
    assert [(r.pos, r.value) for r in explode_redacted(df, "events", []).collect()] == [(0, '{"z":1,"a":2.5,"secret":"[redacted]"}'), (1, "-0.0")]
    with pytest.raises(ValueError):
        field(F.col("text"), "x", max_depth=-1)


def test_stream_tells_oversize_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.json", b'{"id":1}'), ("b.json", b"x" * 50), ("c.json", b"no")):
        (folder / name).write_bytes(data)

    def go():
        out = stream_traces(spark, str(folder), max_bytes=30).select("source", "size", "status", "error", "text")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r.source[-6:], r.size, r.status, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()))

    first = go()
    assert [r[:3] for r in first] == [("a.json", 8, "ok"), ("b.json", 50, "size"), ("c.json", 2, "format")]
    assert first[1][3] == "more bytes than allowed"
    (folder / "d.json").write_bytes(b"y" * 31)
    assert go() == [*first, ("d.json", 31, "size", "more bytes than allowed")]


def run(*args):
    return subprocess.run([sys.executable, "-m", "tracemill", *args], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_command_line(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(LISTED))
    done = run(str(path))
    assert (done.returncode, done.stdout, done.stderr) == (0, "Session trace\nSession: sess-A1\nFindings: 3\nDecisions: 5\n", "")
    path.write_text('{"secret":"synthetic","a":1,"a":2}')
    done = run(str(path))
    assert done.returncode == 1 and done.stdout == "" and "Traceback" not in done.stderr and "synthetic" not in done.stderr
    assert run(str(tmp_path / "none.json")).returncode == 1 and run(str(tmp_path)).returncode == 1
    assert run(str(path), "--max-bytes", "0").returncode == 2 and run().returncode == 2 and run(str(path), "--max-bytes", "5").returncode == 1
    assert run("--version").stdout.strip() == f"tracemill {tracemill.__version__}"
