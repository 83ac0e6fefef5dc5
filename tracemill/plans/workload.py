"""Queries over traces synthesised from the ``events`` table and over the text tables, each with its SQL.

A session is one user's events within 512 consecutive ids, so no document grows with the data.
"""

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import is_sensitive, normalise, sanitise, strict_variant, summary_text
from ..operators import collection, counts, explode_redacted, field, redact_column, redact_leaves, redact_typed, redacted_collection, session_id, trace_version
from ..sources.files import classify, scan_traces, traces_from_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BLOCK = 512
KIND_SQL = "CASE event_type WHEN 'error' THEN 'finding' WHEN 'purchase' THEN 'policy_decision' WHEN 'signup' THEN 'policyDecision' ELSE event_type END"


def _query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def session_traces(spark: SparkSession, sf: str) -> DataFrame:
    """``source, text``: one JSON document for each user and block of event ids."""
    event = F.struct(F.col("event_id").alias("id"), F.expr(KIND_SQL).alias("kind"), "value", F.concat(F.lit("synthetic-"), F.col("event_id").cast("string")).alias("authToken"))
    grouped = _events(spark, sf).groupBy("user_id", F.expr(f"event_id div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(event)).alias("events"))
    session = F.concat(F.lit("sess-"), F.col("user_id").cast("string"), F.lit("-"), F.col("block").cast("string"))
    return grouped.select(session.alias("source"), F.to_json(F.struct(F.lit("0.1.0").alias("traceVersion"), session.alias("sessionId"), "events")).alias("text"))


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("doc", strict_variant(F.col("text")))


def _event_texts(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    """One synthesised document for each event: ``event_id, text``; no shuffle."""
    return _events(spark, sf).withColumn("K", F.expr(KIND_SQL)).select("event_id", text.alias("text"))


def _event_docs(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    """The same with ``doc``."""
    return _parsed(_event_texts(spark, sf, text))


_SESSION_SQL = f"'sess-' || user_id || '-' || (event_id // {BLOCK})"
_RANKED = f"""SELECT {_SESSION_SQL} AS session_id, event_id, {KIND_SQL} AS kind, event_type,
  row_number() OVER (PARTITION BY user_id, event_id // {BLOCK} ORDER BY event_id) - 1 AS n FROM events"""


@_query(f"""SELECT {_SESSION_SQL} AS session_id, '0.1.0' AS trace_version, count(*) AS event_count,
  count(*) FILTER (event_type = 'error') AS finding_count,
  count(*) FILTER (event_type IN ('purchase', 'signup')) AS decision_count FROM events GROUP BY 1""")
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    t, doc, text = _parsed(session_traces(spark, sf)), F.col("doc"), F.col("text")
    return t.select(session_id(doc, text).alias("session_id"), trace_version(doc, text).alias("trace_version"), *[c.alias(n) for n, c in counts(doc).items()])


@_query(f"""SELECT 'Session trace' || chr(10) || 'Session: ' || {_SESSION_SQL} || chr(10) || 'Findings: ' || count(*) FILTER (event_type = 'error')
  || chr(10) || 'Decisions: ' || count(*) FILTER (event_type IN ('purchase', 'signup')) AS summary FROM events GROUP BY user_id, event_id // {BLOCK}""")
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    t, doc = _parsed(session_traces(spark, sf)), F.col("doc")
    n = counts(doc)
    return t.select(summary_text(session_id(doc, F.col("text")), n["finding_count"], n["decision_count"]).alias("summary"))


@_query(f"""SELECT '<Trace source=''' || {_SESSION_SQL} || ''' findings=' || count(*) FILTER (event_type = 'error') || ' decisions='
  || count(*) FILTER (event_type IN ('purchase', 'signup')) || '>' AS shown FROM events GROUP BY user_id, event_id // {BLOCK}""")
def session_repr(spark: SparkSession, sf: str) -> DataFrame:
    t = _parsed(session_traces(spark, sf))
    n = counts(F.col("doc"))
    return t.select(F.format_string("<Trace source='%s' findings=%d decisions=%d>", "source", n["finding_count"], n["decision_count"]).alias("shown"))


def _rows(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = explode_redacted(session_traces(spark, sf), name, ["source"])
    told = F.from_json("value", "id long, kind string, authToken string")
    return rows.select(F.col("source").alias("session_id"), F.col("pos").cast("long").alias("pos"), told.alias("v")).select("session_id", "pos", F.col("v.id").alias("event_id"), F.col("v.kind").alias("kind"), F.col("v.authToken").alias("auth"))


def _rows_sql(which: str) -> str:
    return f"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY n) - 1 AS pos, event_id, kind, '[redacted]' AS auth
  FROM ({_RANKED}) WHERE {which}"""


@_query(_rows_sql("true"))
def events_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, "events")


@_query(_rows_sql("event_type = 'error'"))
def findings_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, "findings")


@_query(_rows_sql("event_type IN ('purchase', 'signup')"))
def decisions_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, "decisions")


@_query("""SELECT event_id, (event_type = 'error' OR event_id % 2 = 0)::BIGINT AS finding_count,
  (event_type IN ('purchase', 'signup') OR event_id % 3 = 0)::BIGINT AS decision_count FROM events""")
def dual_class_events(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""concat('{"events":["note",{"kind":"', K, '","type":', if(event_id % 2 = 0, '"Find-ing"', '5'),
      ',"event_type":', if(event_id % 3 = 0, '"indecision"', 'null'), '}]}')""")
    n = counts(F.col("doc"))
    return _event_docs(spark, sf, text).select("event_id", n["finding_count"].alias("finding_count"), n["decision_count"].alias("decision_count"))


@_query("""SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE 'v' || event_id END AS trace_version FROM events""")
def version_alias(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""concat('{"', element_at(array('traceVersion', 'trace_version', 'schemaVersion', 'schema_version', 'version', 'other'), cast(event_id % 6 + 1 as int)),
      '":"v', event_id, '"}')""")
    d = _event_docs(spark, sf, text)
    return d.select("event_id", trace_version(F.col("doc"), F.col("text")).alias("trace_version"))


@_query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a' || event_id WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN 't'
  WHEN 3 THEN '0' ELSE '123456789012345678901234567890123456789012345' END AS session_id FROM events""")
def session_alias_precedence(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""CASE event_id % 5 WHEN 0 THEN concat('{"id":"z","sessionId":"a', event_id, '"}')
      WHEN 1 THEN concat('{"sessionId":"","session_id":', event_id, ',"id":"z"}')
      WHEN 2 THEN '{"sessionId":true,"session_id":1.0,"id":"t","session":{"sessionId":"n"}}'
      WHEN 3 THEN '{"sessionId":null,"id":-0}' ELSE '{"id":123456789012345678901234567890123456789012345}' END""")
    return _event_docs(spark, sf, text).select("event_id", session_id(F.col("doc"), F.col("text")).alias("session_id"))


@_query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'n' || event_id WHEN 1 THEN 'b' END AS session_id FROM events""")
def nested_session(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('{"session":{"id":"n', event_id, '"}}')
      WHEN 1 THEN '{"session":{"sessionId":7,"session_id":"","id":"b"}}' ELSE concat('{"session":{"id":', event_id, '}}') END""")
    return _event_docs(spark, sf, text).select("event_id", session_id(F.col("doc"), F.col("text")).alias("session_id"))


def _listed(spark: SparkSession, sf: str, findings: str) -> DataFrame:
    d = _event_docs(spark, sf, F.expr(f"""concat('{{"findings":', {findings}, ',"events":[{{"kind":"', K, '"}}]}}')"""))
    return d.select("event_id", F.size(collection(F.col("doc"), "findings")).cast("long").alias("finding_count"))


@_query("SELECT event_id, 1 + event_id % 3 AS finding_count FROM events")
def explicit_list_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "element_at(array('[1]', '[{},null]', '[\"a\",\"b\",[]]'), cast(event_id % 3 + 1 as int))")


@_query("SELECT event_id, 0::BIGINT AS finding_count FROM events")
def empty_list_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "'[]'")


@_query("SELECT event_id, (event_type = 'error')::BIGINT AS finding_count FROM events")
def wrong_type_falls_back(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf, "element_at(array('\"x\"', '{}', 'null'), cast(event_id % 3 + 1 as int))")


@_query("SELECT event_id, 1 + event_id % 3 AS decision_count FROM events")
def decision_alias_precedence(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN '{"decisions":{},"policyDecisions":[1],"policy_decisions":[1,2]}'
      WHEN 1 THEN '{"policyDecisions":[],"decisions":[1,2]}' ELSE '{"policyDecisions":"x","policy_decisions":[1,2,3]}' END""")
    return _event_docs(spark, sf, text).select("event_id", F.size(collection(F.col("doc"), "decisions")).cast("long").alias("decision_count"))


_FOLD_SQL = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_FRAGMENTS = "apikey|authorization|cookie|credential|passwd|password|privatekey|secret|token"


@_query(f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
  WHERE regexp_matches({_FOLD_SQL.format("word")}, '{_FRAGMENTS}') GROUP BY word""")
def sensitive_words(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", " ")).alias("word"))
    return words.where(is_sensitive(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@_query(f"SELECT event_id, {_FOLD_SQL.format(KIND_SQL)} AS folded FROM events")
def kind_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", normalise(F.expr(KIND_SQL)).alias("folded"))


_CLEAN = r"regexp_replace({0}, '[\p{{C}}\p{{Zl}}\p{{Zp}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', '?', 'g')"


def _clean_sql(column: str, keys: str, table: str) -> str:
    clean = _CLEAN.format(column)
    return f"SELECT {keys}, CASE WHEN length({clean}) > 128 THEN left({clean}, 128) || '...' ELSE {clean} END AS shown FROM {table}"


@_query(_clean_sql("text", "doc_id", "documents"))
def sanitize_documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", sanitise(F.col("text")).alias("shown"))


@_query(_clean_sql("text", "conv_id, turn", "conversations"))
def sanitize_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", sanitise(F.col("text")).alias("shown"))


@_query(_clean_sql("html", "page_id", "pages"))
def sanitize_pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", sanitise(F.col("html")).alias("shown"))


_DOC = """concat('{"id":', event_id, ',"kind":"', K, '","photo_kennel":1,"password":null,"handles":["<SECRET:x:y>",{"X-Api-Key":[1]}],"in":{"authToken":{},"n":', event_id, '}}')"""


@_query(f"""SELECT event_id, '{{"id":' || event_id || ',"kind":"' || {KIND_SQL} || '","photo_kennel":"[redacted]","password":"[redacted]","handles":["<SECRET:x:y>",{{"X-Api-Key":"[redacted]"}}],"in":{{"authToken":"[redacted]","n":' || event_id || '}}}}' AS masked FROM events""")
def redact_events(spark: SparkSession, sf: str) -> DataFrame:
    return _event_docs(spark, sf, F.expr(_DOC)).select("event_id", redact_column(F.col("text")).alias("masked"))


@_query("""SELECT event_id, d AS max_depth, CASE d WHEN 0 THEN '"[depth-limited]"' WHEN 1 THEN '{"a":"[depth-limited]","token":"[redacted]","b":"[depth-limited]"}'
  WHEN 2 THEN '{"a":' || event_id || ',"token":"[redacted]","b":["[depth-limited]"]}' ELSE '{"a":' || event_id || ',"token":"[redacted]","b":[1]}' END AS masked
  FROM events, (VALUES (0), (1), (2), (64)) v(d)""")
def redact_depth(spark: SparkSession, sf: str) -> DataFrame:
    docs = _event_docs(spark, sf, F.expr("""concat('{"a":', event_id, ',"token":{},"b":[1]}')"""))
    each = F.array(*[F.struct(F.lit(d).alias("max_depth"), redact_column(F.col("text"), d).alias("masked")) for d in (0, 1, 2, 64)])
    return docs.select("event_id", F.inline(each))


@_query(f"""SELECT event_id, p.path, p.level, p.key, CASE p.path WHEN '$["id"]' THEN event_id::VARCHAR WHEN '$["in"]["n"]' THEN event_id::VARCHAR
  WHEN '$["kind"]' THEN '"' || {KIND_SQL} || '"' WHEN '$["handles"][0]' THEN '"<SECRET:x:y>"' ELSE '"[redacted]"' END AS value
  FROM events, (VALUES ('$["id"]', 1, 'id'), ('$["kind"]', 1, 'kind'), ('$["photo_kennel"]', 1, 'photo_kennel'), ('$["password"]', 1, 'password'), ('$["handles"][0]', 2, NULL),
  ('$["handles"][1]["X-Api-Key"]', 3, 'X-Api-Key'), ('$["in"]["authToken"]', 2, 'authToken'), ('$["in"]["n"]', 2, 'n')) p(path, level, key)""")
def redact_leaf_rows(spark: SparkSession, sf: str) -> DataFrame:
    return redact_leaves(_event_docs(spark, sf, F.expr(_DOC)), ["event_id"], levels=4)


@_query("""SELECT event_id, user_id, '[redacted]' AS auth_token, '[redacted]' AS secret_handle, value AS shown_value FROM events""")
def redact_typed_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", "user_id", F.col("props").alias("auth_token"), F.struct(F.struct("event_type").alias("Secret"), "value").alias("in"))
    r = redact_typed(e)
    return r.select("event_id", "user_id", "auth_token", F.col("in.Secret").alias("secret_handle"), F.col("in.value").alias("shown_value"))


_FIELDS = """concat('{"x":', if(event_id % 2 = 0, 'null', '{"n":[1],"cookie":2}'), ',"api_key":"s"}')"""


@_query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '{"n":[1],"cookie":"[redacted]"}' END AS x, '"[redacted]"' AS api_key FROM events""")
def get_field(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return _event_texts(spark, sf, F.expr(_FIELDS)).select("event_id", field(text, "x", '"d"').alias("x"), field(text, "api_key").alias("api_key"))


@_query("""SELECT event_id, '"d"' AS y, NULL::VARCHAR AS token FROM events""")
def get_absent_default(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return _event_texts(spark, sf, F.expr(_FIELDS)).select("event_id", field(text, "y", '"d"').alias("y"), field(text, "token").alias("token"))


_DIGITS = "123456789012345678901234567890123456789012345"


@_query(f"""SELECT event_id, '{{"z":1.0,"b":{_DIGITS}' || event_id || ',"a":[1e999,-0.5,' || event_id || '.25]}}' AS x, '["' || event_id || '",2.5]' AS findings FROM events""")
def get_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Values as a single document gives them: key order, every digit of integers, ``1.0`` apart from ``1``, literals beyond a float."""
    text = F.expr(f"""concat('{{"x":{{"z":1.0,"b":{_DIGITS}', event_id, ',"a":[1e999,-0.5,', event_id, '.250]}},"findings":["', event_id, '",2.50]}}')""")
    d = _event_texts(spark, sf, text)
    return d.select("event_id", field(F.col("text"), "x").alias("x"), F.concat(F.lit("["), F.array_join(redacted_collection(F.col("text"), "findings"), ","), F.lit("]")).alias("findings"))


@_query("""SELECT event_id, '{"id":' || event_id || ',"password":"p' || event_id || '","later":[1.50]}' AS raw, '{"id":' || event_id || ',"password":"[redacted]","later":[1.5]}' AS masked FROM events""")
def raw_view(spark: SparkSession, sf: str) -> DataFrame:
    """The document as it came beside its redacted form."""
    rows = _event_texts(spark, sf, F.expr("""concat('{"id":', event_id, ',"password":"p', event_id, '","later":[1.50]}')"""))
    traces = traces_from_text(rows.select("event_id", "text"), source="event_id").where("status = 'ok'")
    return traces.select(F.col("source").cast("long").alias("event_id"), F.col("text").alias("raw"), redact_column(F.col("text")).alias("masked"))


# (case, text, whether it is a strict JSON object)
CORPUS = [
    ("empty object", "{}", True), ("bom", "\ufeff{}", True), ("two boms", "\ufeff\ufeff{}", False), ("array", "[1]", False),
    ("string", '"s"', False), ("number", "42", False), ("null", "null", False), ("true", "true", False), ("cut", '{"sessionId": ', False),
    ("same key", '{"a":1,"a":2}', False), ("same key inside", '{"x":{"a":1,"a":2}}', False), ("same key escaped", '{"a":1,"\\u0061":2}', False),
    ("NaN", '{"v":NaN}', False), ("Infinity", '{"v":Infinity}', False), ("-Infinity", '{"v":-Infinity}', False), ("overflow", '{"v":1e999}', True),
    ("word after", '{"a":1} x', False), ("second", '{"a":1}{"b":2}', False), ("comma", '{"a":1},{"b":2}', False), ("key after comma", '{"a":1},"b":2', False),
    ("bracket", '{"a":1}] x', False), ("brace", '{"a":1}} x', False), ("single quotes", "{'a':1}", False), ("bare key", "{a:1}", False),
    ("leading zero", '{"a":01}', False), ("last comma", '{"a":1,}', False), ("comment", "{/**/}", False), ("newline", '{"a":"x\ny"}', False),
    ("empty", "", False), ("spaces", ' \n{"a" : [ ] }\t', True), ("case", '{"a":1,"A":2}', True),
]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{'ok' if ok else 'format'}')" for c, _, ok in CORPUS) + ") v(name, status)")
def strict_parse_corpus(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(c, t) for c, t, _ in CORPUS], "name string, text string")
    return traces_from_text(rows, source="name").select(F.col("source").alias("name"), "status")


@_query("""SELECT doc_id::VARCHAR AS source, strlen(text) AS size, CASE WHEN strlen(text) > 2000 THEN 'size' ELSE 'format' END AS status FROM documents""")
def size_admission(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw = docs.select(F.col("doc_id").cast("string").alias("source"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))
    return classify(raw, max_bytes=2000).select("source", "size", "status")


_NATION_FILE = """'{"id":' || n_nationkey || ',"name":"' || n_name || CASE n_nationkey % 5 WHEN 0 THEN '","cut":[' WHEN 1 THEN '","pad":"' || repeat('x', 200) || '"}' WHEN 2 THEN '"} {}' ELSE '"}' END"""


@_query(f"""SELECT n_nationkey::BIGINT AS nation, strlen({_NATION_FILE}) + 1 AS size, CASE n_nationkey % 5 WHEN 0 THEN 'format' WHEN 1 THEN 'size' WHEN 2 THEN 'format' ELSE 'ok' END AS status,
  CASE WHEN n_nationkey % 5 > 2 THEN n_nationkey::VARCHAR END AS session_id FROM nation""")
def file_admission(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each nation, written below the shared folder and scanned as a folder of traces: admitted, oversize or refused."""
    folder = f"{_shared(spark)}/file_admission-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("nation"), F.expr(_NATION_FILE).alias("value")).repartition("nation").write.partitionBy("nation").text(folder)
    found = scan_traces(spark, folder, max_bytes=200).where("status <> 'source'")  # the writer's own mark
    nation = F.regexp_extract("source", r"nation=(\d+)/", 1).cast("long")
    return found.select(nation.alias("nation"), "size", "status", session_id(F.col("doc"), F.col("text")).alias("session_id"))


def _shared(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (top or os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")).rstrip("/")
