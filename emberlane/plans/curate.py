"""Queries of sources and sinks, generated rows, contamination, deduplication against others, and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions import obfuscate
from emberlane.operators import curation, folds, generate, metrics
from emberlane.plans.catalog import _REDACT_SQL, ORACLES, QUERIES, _quote, _sel, add
from emberlane.sources import config, hub, tables
from emberlane.sources.dataset import read_dataset
from emberlane.streaming import caches, sinks

ID = "session_id, step"

# ---- sources and sinks: written to the shared folder and read again ----------------------------------


def _folder(d: DataFrame) -> str:
    """A new path in the folder that the cluster shares."""
    import uuid

    return f"{tables.shared_folder(d.sparkSession)}/emberlane-io-{uuid.uuid4().hex}"


_records = lambda d: d.select("action", "label", F.col("session_id").cast("string").alias("session_id"), F.lit("x").alias("attack_type"), F.col("step").cast("int").alias("step_index"), "source_dataset", F.lit(False).alias("augmented"))
_RECORDS = "SELECT session_id::VARCHAR AS session_id, step::INT AS step_index, md5(action) AS action, label FROM actions"
_read = lambda d: d.select("session_id", "step_index", F.md5("action").alias("action"), "label")


def _jsonl(d: DataFrame) -> DataFrame:
    path = _folder(d)
    tables.sink_jsonl(_records(d), path)
    return _read(tables.scan_jsonl(d.sparkSession, path))


def _rebuilt(d: DataFrame) -> DataFrame:
    path = _folder(d)
    tables.sink_jsonl(_records(d), f"{path}/json")
    tables.jsonl_to_parquet(d.sparkSession, f"{path}/json", f"{path}/parquet")
    return _read(d.sparkSession.read.parquet(f"{path}/parquet"))


def _sink_parquet(d: DataFrame) -> DataFrame:
    path = _folder(d)
    _records(d).write.partitionBy("source_dataset").parquet(path)
    return _read(d.sparkSession.read.parquet(path))


def _csv(d: DataFrame) -> DataFrame:
    path = _folder(d)
    tables.sink_csv(d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "layer", F.lit(" "))).alias("Prompt")), path)
    return tables.scan_csv_column(d.sparkSession, path, "Prompt").groupBy("Prompt").agg(F.count(F.lit(1)).alias("n"))


def _results_csv(d: DataFrame) -> DataFrame:
    path = _folder(d)
    tables.sink_csv(d.select("doc_id", "layer", "score", "blocked"), path)
    return d.sparkSession.read.option("header", True).schema("doc_id long, layer string, score double, blocked boolean").csv(path)


def _summary_csv(d: DataFrame) -> DataFrame:
    """Models as rows, metrics as columns."""
    path = _folder(d)
    long = metrics.confusion_metrics(d, ["model"]).select("model", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("fpr", "absr"))), F.array("fpr", "absr"))).alias("metric", "value"))
    tables.sink_csv(long.groupBy("model").pivot("metric", ["absr", "fpr"]).agg(F.first("value")), path)
    return d.sparkSession.read.option("header", True).schema("model string, absr double, fpr double").csv(path)


add("sink_jsonl", "actions", _jsonl, _RECORDS)
add("jsonl_to_parquet", "actions", _rebuilt, _RECORDS)
add("sink_parquet", "actions", _sink_parquet, _RECORDS)
add("scan_csv_column", "predictions", _csv, "SELECT layer AS Prompt, count(*) AS n FROM predictions WHERE doc_id % 5 <> 0 GROUP BY layer")
add("sink_results_csv", "predictions", _results_csv, "SELECT doc_id, layer, score, blocked FROM predictions")
add("sink_summary_csv", "predictions", _summary_csv, "SELECT model, round(100.0 * count(*) FILTER (truth = 1 AND blocked) / count(*) FILTER (truth = 1), 2)::DOUBLE AS absr, round(100.0 * count(*) FILTER (truth = 0 AND blocked) / count(*) FILTER (truth = 0), 2)::DOUBLE AS fpr FROM predictions GROUP BY model")


def _traces(d: DataFrame, old: bool = False) -> DataFrame:
    content = F.col("action") if old else F.array(F.struct(F.lit("text").alias("type"), F.col("action").alias("content")))
    message = F.struct("step", "role", content.alias("content"))
    rows = d.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), F.max("source_dataset").alias("suite_name"))
    return rows.select(F.lit("pipe").alias("pipeline_name"), "suite_name", F.concat(F.lit("user_task_"), F.col("session_id").cast("string")).alias("user_task_id"), F.when(F.col("session_id") % 2 == 0, "direct").alias("attack_type"), F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("injection_task_"), (F.col("session_id") % 4).cast("string"))).alias("injection_task_id"), "messages", F.lit(True).alias("utility"), F.lit(False).alias("security"))


def _traced(d: DataFrame, old: bool = False) -> DataFrame:
    path = _folder(d)
    tables.sink_traces(_traces(d, old), path)
    return tables.scan_traces(d.sparkSession, path)


_first = lambda d: d.select("user_task_id", F.size("messages").cast("bigint").alias("n"), F.md5(F.element_at("messages", 1)["content"][0]["content"]).alias("first"), "attack_type")
_TRACE = "SELECT 'user_task_' || session_id AS user_task_id, count(*) AS n, md5(arg_min(action, step)) AS first, CASE WHEN session_id % 2 = 0 THEN 'direct' ELSE 'none' END AS attack_type FROM actions GROUP BY session_id"
add("trace_sink", "actions", lambda d: _first(_traced(d)), _TRACE)
add("trace_scan", "actions", lambda d: _traced(d).groupBy("suite_name").agg(F.count(F.lit(1)).alias("n")), "SELECT s AS suite_name, count(*) AS n FROM (SELECT max(source_dataset) AS s FROM actions GROUP BY session_id) GROUP BY s")
add("trace_upgrade", "actions", lambda d: _first(_traced(d, old=True)), _TRACE)
add("suite_scan", "actions", lambda d: tables.scan_suite(_traced(d), "src0").select("user_task_id", "injection_task_id"), "SELECT 'user_task_' || session_id AS user_task_id, CASE WHEN session_id % 2 = 0 THEN 'injection_task_' || session_id % 4 ELSE 'none' END AS injection_task_id FROM actions GROUP BY session_id HAVING max(source_dataset) = 'src0'")


#: How many batches a table of decisions arrives in.
_ARRIVALS = 4


def _feedback(d: DataFrame) -> DataFrame:
    """Decisions as a stream of what arrives in a folder, one part of the time after another, redacted and kept as JSON lines.

    The time that the table covers is cut into ``_ARRIVALS`` parts, so that more sessions make larger batches, not more restarts.
    """
    path = _folder(d)
    first, last = d.agg(F.min("ts"), F.max("ts")).first()
    width = -(-((last or 0) - (first or 0) + 1) // _ARRIVALS)
    rows = d.select("session_id", "step", "action", F.coalesce(F.floor((F.col("ts") - (first or 0)) / width), F.lit(0)).alias("arrival"))
    sinks.replay(rows, "arrival", lambda stream: sinks.feedback_sink(stream, f"{path}/out", f"{path}/checkpoint"), path)
    kept = sinks.written_batches(d.sparkSession, f"{path}/out/kept", rows.drop("arrival").schema, "json")
    return kept.select("session_id", "step", F.md5("action").alias("redacted"))


_REDACTED = _REDACT_SQL.replace("doc_id", "session_id, step").replace("(text, ", "(action, ").replace("FROM documents", "FROM actions")
add("feedback_sink", "actions", _feedback, f"SELECT {ID}, redacted FROM ({_REDACTED})")
_settings_text = lambda: F.concat_ws("\n", F.lit("# of a document"), F.concat(F.lit("mode: '"), F.coalesce("lang", F.lit("")), F.lit("'  # its language")), F.lit(""), F.concat(F.lit("log_path: "), F.coalesce("source", F.lit(""))), F.lit("threshold: 1"), F.concat(F.lit("threshold: "), F.col("n_chars").cast("string")))
_DEFAULTS = {"shadow": "0", "threshold": "0.7"}


def _settings(d: DataFrame) -> DataFrame:
    """Each document's settings; one in three has an environment, and one in seven a text that cannot be read."""
    text = F.when(F.col("doc_id") % 7 == 0, F.lit("mode: x\n  nested: 1")).otherwise(_settings_text())
    env = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("FIREWALL_MODE"), F.lit("PERMISSIVE")))
    return d.select("doc_id", config.settings_struct(config.flat_yaml_map(text), env, _DEFAULTS).alias("s")).select("doc_id", "s.*")


add("flat_yaml_config", "documents", lambda d: d.select("doc_id", config.flat_yaml_map(_settings_text()).alias("m")).select("doc_id", F.size("m").alias("n"), *[F.element_at("m", k).alias(k) for k in ("mode", "log_path", "threshold")]),
    "SELECT doc_id, 3 AS n, coalesce(lang, '') AS mode, coalesce(source, '') AS log_path, n_chars::VARCHAR AS threshold FROM documents")
add("load_settings", "documents", _settings,
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'PERMISSIVE' WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(lang, '') END AS mode, '' AS llm_endpoint, '' AS llm_timeout, CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(source, '') END AS log_path, CASE WHEN doc_id % 7 = 0 THEN '0.7' ELSE n_chars::VARCHAR END AS threshold, '0' AS shadow FROM documents")
_HOLES = {"email_body": "nothing new", "to": "nobody"}


def _environment(d: DataFrame) -> DataFrame:
    """Each mail as a template: some rows are given a body, some an address, some what no hole is for."""
    given = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("email_body"), F.col("subject"))).when(F.col("id") % 3 == 1, F.create_map(F.lit("to"), F.col("recipient"))).otherwise(F.create_map(F.lit("cc"), F.col("sender")))
    return d.select("id", config.injected(F.concat("subject", F.lit(": {email_body} for {to}, {to}. {else}")), given, _HOLES).alias("body"))


add("env_template_inject", "emails", _environment, "SELECT id, CASE id % 3 WHEN 0 THEN subject || ': ' || subject || ' for nobody, nobody. {else}' WHEN 1 THEN subject || ': nothing new for ' || recipient || ', ' || recipient || '. {else}' END AS body FROM emails")


def _included(d: DataFrame) -> DataFrame:
    """Each document's environment names its source's file, which names that of its language."""
    files = d.groupBy(F.concat(F.lit("source-"), "source").alias("name")).agg(F.concat(F.lit("all of "), F.min("source"), F.lit(": !include lang-"), F.min("lang")).alias("content"))
    files = files.unionByName(d.groupBy(F.concat(F.lit("lang-"), "lang").alias("name")).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" texts")).alias("content")))
    texts = d.select("doc_id", F.concat(F.lit("a: !include source-"), "source", F.lit("\nb: !include lang-"), "lang", F.lit("\nc: !include none")).alias("text"))
    return config.with_includes(texts, "doc_id", "text", files)


add("yaml_env", "documents", _included,
    """WITH l AS (SELECT lang, count(*) || ' texts' AS content FROM documents GROUP BY lang), s AS (SELECT source, 'all of ' || source || ': ' || l.content AS content FROM (SELECT source, min(lang) AS lang FROM documents GROUP BY source) JOIN l USING (lang))
SELECT doc_id, 'a: ' || s.content || chr(10) || 'b: ' || l.content || chr(10) || 'c: !include none' AS text FROM documents d LEFT JOIN s USING (source) LEFT JOIN l ON l.lang = d.lang""")

# ---- staged public datasets --------------------------------------------------------------------------
_loaded = lambda d: d.select("action", "label", "session_id", "attack_type", "source_dataset").withColumn("action", F.md5("action"))


def _load_sql(source: str, text: str, bad: str, prefix: str, key: str, name: str, where: str = "true") -> str:
    return f"SELECT md5({text}) AS action, CASE WHEN {bad} THEN 'malicious' ELSE 'benign' END AS label, '{prefix}-' || {key} AS session_id, CASE WHEN {bad} THEN 'malicious_single' ELSE 'benign' END AS attack_type, '{name}' AS source_dataset FROM {source} WHERE trim({text}) <> '' AND {where}"


_staged = lambda d: d.select("doc_id", F.col("text").alias("Prompt"), F.when(F.col("lang") == "en", "INJECTION").otherwise("safe").alias("Label"))
add("load_neuralchemy", "documents", lambda d: _loaded(hub.load(_staged(d), hub.NEURALCHEMY, "doc_id")), _load_sql("documents", "text", "coalesce(lang = 'en', false)", "neural", "doc_id", "neuralchemy"))
add("load_prodnull", "documents", lambda d: _loaded(hub.load(_staged(d), hub.PRODNULL, "doc_id")), _load_sql("documents", "text", "coalesce(lang = 'en', false)", "prod", "doc_id", "prodnull"))
_mails = lambda d: d.select(F.col("id"), "body", F.col("status").alias("scenario"), F.col("sender").alias("team_id"))
add("load_llmail", "emails", lambda d: _loaded(hub.load(_mails(d), hub.LLMAIL, "id")), _load_sql("(SELECT *, row_number() OVER (PARTITION BY status, sender ORDER BY md5(id::VARCHAR), id) AS rn FROM emails)", "body", "true", "llmail", "id", "llmail-inject", "rn <= 10"))


def _bipia(spark, sf_dir: str) -> DataFrame:
    """The sources in their order, of which the third is staged here as the turns of conversations; columns are found by parts of their names."""
    copies = dict(zip(hub.BIPIA_SOURCES, ("no_such_table", "nor_this_one", "conversations", "benchmark")))
    turns = read_dataset(spark, [f"{sf_dir}/{copies[s]}.parquet" for s in hub.BIPIA_SOURCES], ["conv_id", "turn", "role", "text"])
    named = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "assistant", F.col("text")).alias("injected_text"), F.when(F.col("role") != "assistant", F.col("text")).alias("context"), F.col("role").alias("task"))
    return _loaded(hub.load_bipia(named, "id"))


QUERIES["load_bipia"] = _bipia
ORACLES["load_bipia"] = """WITH c AS (SELECT conv_id * 1000 + turn AS id, role, text FROM conversations),
a AS (SELECT * FROM c WHERE role = 'assistant' AND lower(trim(text)) NOT IN ('', 'nan')),
b AS (SELECT *, row_number() OVER (ORDER BY md5(id::VARCHAR), id) AS rn FROM c WHERE role <> 'assistant' AND text IS NOT NULL)
SELECT md5(text) AS action, 'malicious' AS label, 'bipia-' || role || '-' || id AS session_id, 'malicious_single' AS attack_type, 'bipia' AS source_dataset FROM a
UNION ALL SELECT md5(text), 'benign', 'bipia-benign-' || id, 'benign', 'bipia' FROM b WHERE rn <= (SELECT count(*) // 2 FROM a) AND lower(trim(text)) NOT IN ('', 'nan')"""


def _hub(spark, sf_dir: str) -> DataFrame:
    """A staged table that is there, and one that is not and falls back."""
    some = hub.staged(spark, (f"{sf_dir}/no_such_table.parquet", f"{sf_dir}/benchmark.parquet"), hub.NEURALCHEMY)
    none = hub.staged(spark, (f"{sf_dir}/no_such_table.parquet",), hub.Spec("fallback", "f", fallback=(("ignore this", "1"), ("hello", "0"))))
    rows = hub.load(some.select("item_id", "text"), hub.Spec("bench", "b", always="benign"), "item_id").unionByName(hub.load(none.withColumn("k", F.col("text")), hub.Spec("fallback", "f"), "k"))
    return rows.groupBy("source_dataset", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES["scan_hub_dataset"] = _hub
ORACLES["scan_hub_dataset"] = "SELECT 'bench' AS source_dataset, 'benign' AS label, count(*) AS n FROM benchmark WHERE trim(text) <> '' UNION ALL SELECT 'fallback', 'malicious', 1 UNION ALL SELECT 'fallback', 'benign', 1"
_goals = lambda: F.to_json(F.struct((F.col("k") > 3).alias("exfil.sent"), F.lit(True).alias("exfil.destination"), (F.col("k") % 2 == 0).alias("exfil.content"), (F.col("k") != 5).alias("defense.undetected")))
add("parse_objectives", "events", lambda d: d.withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))).select("event_id", hub.objectives(F.when(F.col("k") == 7, "{broken").otherwise(_goals())).alias("o")).select("event_id", "o.*"),
    "SELECT event_id, k <> 7 AND k > 3 AND k % 2 = 0 AS exfil_success, k = 5 AS defense_caught FROM (SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, 0) AS k FROM events)")


def _tool_calls(d: DataFrame) -> DataFrame:
    calls = F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("send").alias("name"), F.col("step").cast("string").alias("arguments"))))
    message = F.struct("step", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")).alias("role"), F.col("role").alias("content"), calls.alias("tool_calls"))
    nested = d.groupBy("session_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return hub.tool_calls(nested, "session_id", "messages")


add("extract_tool_calls", "actions", _tool_calls, "SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY step) - 1)::INT AS step_index, CASE WHEN role = 'assistant' THEN 'send(' || step || ')' ELSE 'system' END AS action FROM (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM actions WHERE role IN ('assistant', 'system')) WHERE n >= 2")

# ---- made rows ---------------------------------------------------------------------------------------
def _pick(n: int, name: str) -> str:
    return f"(('0x' || substr(md5('{name}|' || n), 1, 8))::BIGINT % {n})"


def _tuple(values) -> str:
    return "[" + ", ".join(map(_quote, values)) + "]"


_DRAWN = f"""SELECT *, 4 + {_pick(3, 'size')} AS size, {_pick(len(generate.SOURCES), 'source')} AS a, {_pick(len(generate.TRANSFORMS), 'transform')} AS t FROM (SELECT doc_id AS n FROM documents)"""
_DRAWN = f"SELECT *, size > 4 AND {_pick(100, 'second')} < 35 AS second FROM ({_DRAWN})"
_DRAWN = f"SELECT *, size - 2 - second::INT AS room, size - 2 - second::INT >= 2 AND {_pick(2, 'two')} = 1 AS two FROM ({_DRAWN})"
_STEPS = f"""list_filter([{_tuple(generate.SOURCES)}[a + 1], CASE WHEN second THEN {_tuple(generate.SOURCES)}[(a + 1 + {_pick(len(generate.SOURCES) - 1, 'other')}) % {len(generate.SOURCES)} + 1] END,
 {_tuple(generate.TRANSFORMS)}[t + 1], CASE WHEN two THEN {_tuple(generate.TRANSFORMS)}[(t + 1 + {_pick(len(generate.TRANSFORMS) - 1, 'transform2')}) % {len(generate.TRANSFORMS)} + 1] END,
 {_tuple(generate.SINKS)}[{_pick(len(generate.SINKS), 'sink')} + 1], CASE WHEN room - 1 - two::INT > 0 THEN {_tuple(generate.COVERS)}[{_pick(len(generate.COVERS), 'cover')} + 1] END], lambda x: x IS NOT NULL)"""
_CHAINS = f"""SELECT n, 'synthetic-' || n AS session_id, (i - 1)::INT AS step_index, steps[i] AS action, CASE WHEN i = len(steps) THEN 'malicious' ELSE 'benign' END AS label FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM (SELECT n, {_STEPS} AS steps FROM ({_DRAWN})))"""
add("generate_chains", "documents", lambda d: generate.attack_chains(d, "doc_id").drop("attack_type"), f"SELECT session_id, step_index, action, label FROM ({_CHAINS})")
add("build_attack_chain", "documents", lambda d: generate.attack_chains(d, "doc_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("action", "step_index").alias("source"), F.max_by("action", "step_index").alias("last")),
    f"SELECT session_id, count(*) AS n, arg_min(action, step_index) AS source, arg_max(action, step_index) AS last FROM ({_CHAINS}) GROUP BY session_id")
add("load_synthetic", "documents", lambda d: generate.synthetic(d, "doc_id").groupBy("attack_type", "label").agg(F.count(F.lit(1)).alias("steps"), F.countDistinct("session_id").alias("sessions")),
    f"SELECT 'malicious_multistep' AS attack_type, label, count(*) AS steps, count(DISTINCT session_id) AS sessions FROM ({_CHAINS}) WHERE {_pick(28, 'kind')} NOT IN (20, 21, 22) GROUP BY label UNION ALL SELECT 'benign', 'benign', 4 * count(*), count(*) FROM (SELECT doc_id AS n FROM documents) WHERE {_pick(28, 'kind')} IN (20, 21, 22) HAVING count(*) > 0")
_FILL = "t"
for _name, _vals in generate.FILLS.items():
    _FILL = f"replace({_FILL}, '{{{_name}}}', {_tuple(_vals)}[{_pick(len(_vals), _name)} + 1])"
add("augment_benign", "documents", lambda d: generate.benign_commands(d, "doc_id").select("n", "action"), f"SELECT n, {_FILL} AS action FROM (SELECT n, {_tuple(generate.COMMANDS)}[{_pick(len(generate.COMMANDS), 'command')} + 1] AS t FROM (SELECT doc_id AS n FROM documents))")
add("template_cross", "benchmark", lambda d: generate.from_templates(d, "item_id", "text").select("item_id", "template_id", F.md5("prompt").alias("prompt")), "SELECT item_id, i AS template_id, md5(replace(t, '{goal}', text)) AS prompt FROM benchmark, (VALUES " + ", ".join(f"({i}, {_quote(t)})" for i, t in enumerate(generate.PROMPTS)) + ") v(i, t)")
add("obf_base64", "actions", _sel(lambda: [F.md5(obfuscate.encoded(F.col("action"))).alias("out")]),
    rf"""SELECT {ID}, md5(CASE WHEN q = '' THEN action ELSE substr(action, 1, instr(action, q) - 1) || 'b64decode(' || q[1] || base64(encode(substr(q, 2, length(q) - 2))) || q[1] || ')' || substr(action, instr(action, q) + length(q)) END) AS out FROM (SELECT *, regexp_extract(action, {_quote(obfuscate.QUOTED)}) AS q FROM actions)""")
add("obf_leet", "actions", _sel(lambda: [F.md5(obfuscate.leet(F.col("action"))).alias("out")]), f"SELECT {ID}, md5(translate(action, '{obfuscate.LEET_FROM}', '{obfuscate.LEET_TO}')) AS out FROM actions")
add("obf_zero_width", "actions", _sel(lambda: [F.md5(obfuscate.zero_width(F.col("action"), F.col("session_id"), F.col("step"))).alias("out")]),
    f"SELECT {ID}, md5(array_to_string(list_transform(string_split(action, ''), lambda c, i: CASE WHEN regexp_matches(c, '[A-Za-z]') AND ('0x' || substr(md5(session_id || '|' || step || '|' || (i - 1)), 1, 8))::BIGINT % 100 < 25 THEN c || chr(8203) ELSE c END), '')) AS out FROM actions")
add("obf_varnames", "actions", _sel(lambda: [obfuscate.variable_names(F.concat(F.lit("send(data, "), F.col("role"), F.lit(", key, body)")), F.col("session_id"), F.col("step")).alias("out")]),
    f"SELECT {ID}, 'send(_a' || p0 || ', ' || role || ', _k' || p10 || ', _b' || p3 || ')' AS out FROM (SELECT *, " + ", ".join(f"('0x' || substr(md5(session_id || '|' || step || '|{k}'), 1, 8))::BIGINT % 100 AS p{k}" for k in (0, 3, 10)) + " FROM actions)")
add("obf_concat", "actions", _sel(lambda: [F.md5(obfuscate.split_string(F.col("action"), F.col("session_id"), F.col("step"))).alias("out")]),
    rf"""SELECT {ID}, md5(CASE WHEN q = '' THEN action ELSE substr(action, 1, instr(action, q) - 1) || q[1] || substr(q, 2, k) || q[1] || ' + ' || q[1] || substr(q, 2 + k, length(q) - 2 - k) || q[1] || substr(action, instr(action, q) + length(q)) END) AS out FROM (SELECT *, 2 + (('0x' || substr(md5(session_id || '|' || step), 1, 8))::BIGINT % 1073741824) % greatest(length(q) - 5, 1) AS k FROM (SELECT *, regexp_extract(action, {_quote(obfuscate.QUOTED_6)}) AS q FROM actions))""")


def _disguised(d: DataFrame) -> DataFrame:
    made = obfuscate.techniques(F.col("action"), F.col("session_id"), F.col("step"))
    return d.withColumn("technique", F.pmod(F.col("session_id"), F.lit(len(made))).cast("int")).select("session_id", "step", "technique", F.md5(F.get(F.array(*made), F.col("technique"))).alias("out"))


add("augment_obfuscate", "actions", lambda d: _disguised(d).where("technique = 1"), f"SELECT {ID}, 1 AS technique, md5(translate(action, '{obfuscate.LEET_FROM}', '{obfuscate.LEET_TO}')) AS out FROM actions WHERE session_id % 5 = 1")
add("augment_variants", "actions", lambda d: generate.with_variants(d.select("session_id", "step", "action"), "action", ["session_id", "step"]).select("session_id", "step", "variant", "way", F.when(F.col("variant") == 0, F.md5("action")).alias("original")),
    f"SELECT {ID}, variant, CASE WHEN variant = 0 THEN -1 ELSE (('0x' || substr(md5('way|' || session_id || '|' || step || '|' || variant), 1, 8))::BIGINT % 4)::INT END AS way, CASE WHEN variant = 0 THEN md5(action) END AS original FROM actions, (SELECT unnest(range(4))::INT AS variant)")

# ---- curation over several tables --------------------------------------------------------------------
_SHARED = """(SELECT a.s AS l, b.s AS r, a.h AS h FROM k a JOIN k b ON a.h = b.h AND a.s < b.s)"""
add("dedup_cross_dataset", "actions", lambda d: curation.drop_cross_dataset(d.withColumn("t", F.concat("template", F.lit("-"), (F.col("session_id") % 20).cast("string"))), "t", "source_dataset").select("session_id", "step"),
    "SELECT session_id, step FROM (WITH d AS (SELECT *, md5(lower(trim(template || '-' || session_id % 20))) AS h FROM actions), k AS (SELECT DISTINCT source_dataset AS s, h FROM d), z AS (SELECT s, count(*) AS n FROM k GROUP BY s), "
    f"sh AS {_SHARED}, p AS (SELECT l, r, CASE WHEN any_value(zl.n) < any_value(zr.n) THEN l ELSE r END AS s FROM sh JOIN z zl ON zl.s = l JOIN z zr ON zr.s = r GROUP BY l, r HAVING count(*) > 0.2 * least(any_value(zl.n), any_value(zr.n))), g AS (SELECT DISTINCT p.s, sh.h FROM sh JOIN p ON p.l = sh.l AND p.r = sh.r) SELECT * FROM d WHERE (source_dataset, h) NOT IN (SELECT (s, h) FROM g))")
add("nearest_duplicate", "documents", lambda d: folds.nearest_duplicates(d, "doc_id", "text"))
add("layer3_no_balance", "actions", lambda d: curation.whole_sessions(d, F.col("label") == "malicious").select("session_id", "step"), "SELECT session_id, step FROM actions WHERE session_id IN (SELECT session_id FROM actions WHERE label = 'malicious')")


def _contaminated(spark, sf_dir: str) -> DataFrame:
    """Of each document's 8-word grams the share that the benchmark has, too; documents without one are left out."""
    return curation.containment(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"), "doc_id", "text", "text")


QUERIES["contamination"] = _contaminated
_GRAMS = "(SELECT {0} AS id, w[i:i+7] AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {0}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {1})))"
ORACLES["contamination"] = f"SELECT id AS doc_id, count(*) AS shared, any_value(n) AS grams FROM (SELECT DISTINCT id, g, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, array_to_string(g, ' ') AS g FROM {_GRAMS.format('doc_id', 'documents')})) WHERE g IN (SELECT array_to_string(g, ' ') FROM {_GRAMS.format('item_id', 'benchmark')}) GROUP BY id"


def _regressed(d: DataFrame) -> DataFrame:
    """Golden decisions by key, from a stored table, against those of now: what changed, and what is missing on either side."""
    path = _folder(d)
    d.where("doc_id % 11 <> 0").select("doc_id", (F.col("score") >= 0.7).alias("base"), "layer").write.parquet(path)
    golden = d.sparkSession.read.parquet(path).select(F.col("doc_id").alias("_g"), "base", F.col("layer").alias("base_layer"))
    now = d.where("doc_id % 13 <> 0").select("doc_id", "blocked", "layer")
    both = now.join(golden, F.col("doc_id") == F.col("_g"), "full")
    kind = F.when(F.col("_g").isNull(), "new").when(F.col("doc_id").isNull(), "missing").when(F.col("blocked") != F.col("base"), "changed").when(F.col("layer") != F.col("base_layer"), "moved")
    return both.select(F.coalesce("doc_id", "_g").alias("doc_id"), kind.alias("change")).where("change IS NOT NULL")


add("regression_diff", "predictions", _regressed, "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'changed' END AS change FROM predictions WHERE (doc_id % 11 = 0 AND doc_id % 13 <> 0) OR (doc_id % 13 = 0 AND doc_id % 11 <> 0) OR (doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND blocked <> (score >= 0.7))")
_LEGS = {"fpr_ok": ("blocked AND truth = 0", "truth = 0", "<= 0.05"), "absr_ok": ("blocked AND truth = 1", "truth = 1", ">= 0.3"), "latency_ok": ("latency_ms <= 90", "true", ">= 0.5")}
add("quality_gate", "predictions", lambda d: d.agg(*[F.expr(f"count_if({a}) / count_if({b}) {c}").alias(n) for n, (a, b, c) in _LEGS.items()]).withColumn("passed", F.expr("fpr_ok AND absr_ok AND latency_ok")), "SELECT *, fpr_ok AND absr_ok AND latency_ok AS passed FROM (SELECT " + ", ".join(f"count(*) FILTER ({a}) / count(*) FILTER ({b}) {c} AS {n}" for n, (a, b, c) in _LEGS.items()) + " FROM predictions)")
add("delta_analysis", "predictions", lambda d: d.groupBy("layer").pivot("model", ["m0", "m1", "m2"]).agg(F.round(F.avg("score"), 8)).select("layer", F.round(F.col("m1") - F.col("m0"), 7).alias("delta_1"), F.round(F.col("m2") - F.col("m0"), 7).alias("delta_2")), "SELECT layer, round(b - a, 7) AS delta_1, round(c - a, 7) AS delta_2 FROM (SELECT layer, " + ", ".join(f"round(avg(score) FILTER (model = 'm{k}'), 8) AS {n}" for k, n in enumerate("abc")) + " FROM predictions GROUP BY layer)")
_PART = "(SELECT * FROM predictions WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 < 7)"
_RATES = f"(SELECT attack_kind, score, fp / greatest(neg, 1) AS fpr, (pos - tp) / greatest(pos, 1) AS fnr FROM (SELECT attack_kind, score, sum(p) OVER up AS tp, sum(n) OVER up AS fp, sum(p) OVER (PARTITION BY attack_kind) AS pos, sum(n) OVER (PARTITION BY attack_kind) AS neg FROM (SELECT attack_kind, score, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM {_PART} GROUP BY ALL) WINDOW up AS (PARTITION BY attack_kind ORDER BY score DESC)))"
add("calibrate_thresholds", "predictions", lambda d: metrics.calibrate_thresholds(d, "attack_kind", "doc_id"),
    f"SELECT attack_kind, round(greatest(a, b), 4) AS block, round(greatest(0.2, least(a, b)), 4) AS review FROM (SELECT attack_kind, coalesce(arg_min(score, (fnr, score)) FILTER (fpr <= 0.01 AND fnr < 1), 1.0) AS a, coalesce(max(score) FILTER (fnr <= 0.05), 0.35) AS b FROM {_RATES} GROUP BY attack_kind) WHERE attack_kind IN (SELECT attack_kind FROM predictions GROUP BY attack_kind HAVING count(*) FILTER (truth = 0) >= 10 AND count(*) FILTER (truth = 1) >= 10)")


def _cached(d: DataFrame) -> DataFrame:
    """Every event as one use of its user's cache of texts."""
    path, spark = _folder(d), d.sparkSession
    rows = d.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.concat_ws(" ", "event_type", F.expr("get_json_object(props, '$.k') % 4")).alias("text"), F.lit(0).alias("arrival"))

    def run(stream: DataFrame):
        used = caches.session_caches(stream, "user_id", "event_id", "text", "ts", lifetime=_CACHE_LIFE)
        return used.writeStream.foreachBatch(sinks.batch_writer(f"{path}/used")).option("checkpointLocation", f"{path}/checkpoint")

    with caches.state_with_timers(spark):
        sinks.replay(rows, "arrival", run, path)
    return sinks.written_batches(spark, f"{path}/used", _USED)


#: Five days: users come back after some hours, so that texts are held, expire, and whole sessions lapse.
_CACHE_LIFE = 5 * 86400
_USED = caches.OUTPUT
_USES = f"""n AS (SELECT user_id, concat_ws(' ', event_type, json_extract_string(props, '$.k')::INT % 4) AS text, event_id, epoch_us(ts) / 1e6 AS tm FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, text ORDER BY tm, event_id) AS k, coalesce(tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) > {_CACHE_LIFE}, true) AS fresh FROM n),
w AS (SELECT user_id, text, event_id, k, tm AS since, false AS hit FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.text, o.event_id, o.k, CASE WHEN o.tm - w.since < {_CACHE_LIFE} THEN w.since ELSE o.tm END, o.tm - w.since < {_CACHE_LIFE} FROM w JOIN o ON o.user_id = w.user_id AND o.text = w.text AND o.k = w.k + 1)"""
add("ts_embedding_cache", "events", lambda d: _cached(d).select("session", "event", "hit"), f"WITH RECURSIVE {_USES} SELECT user_id::VARCHAR AS session, event_id AS event, hit FROM w")
add("ts_session_lru", "events", lambda d: _cached(d).groupBy("session").agg(F.count_if("fresh").alias("lives"), F.max("held").alias("most_held")),
    f"WITH RECURSIVE {_USES}, l AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS life FROM o) SELECT user_id::VARCHAR AS session, max(life)::BIGINT AS lives, max(held)::INT AS most_held FROM (SELECT user_id, life, count(DISTINCT text) AS held FROM l GROUP BY user_id, life) GROUP BY user_id")
_ARRIVAL = "CAST(floor((CAST(rint(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D) AS BIGINT) + CAST(get_json_object(props, '$.k') AS INT) * 3600) / 432000) AS BIGINT)"


def _kept_in_time(d: DataFrame) -> DataFrame:
    """Events that arrive up to four days after they happened, under a watermark of a day: what is kept and what is dropped of each type."""
    path, spark = _folder(d), d.sparkSession
    rows = d.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.expr(_ARRIVAL).alias("arrival")).where("arrival IS NOT NULL")
    rows = tables.written(rows.withColumn("row", F.monotonically_increasing_id()), "arrivals")  # ids may repeat, rows do not

    def run(stream: DataFrame):
        return sinks.within_watermark(stream, "ts", ["row"], "1 day").writeStream.foreachBatch(sinks.batch_writer(f"{path}/kept")).option("checkpointLocation", f"{path}/checkpoint")

    sinks.replay(rows, "arrival", run, path)
    kept = sinks.written_batches(spark, f"{path}/kept", rows.drop("arrival").schema)
    marked = rows.join(kept.select("row", F.lit(True).alias("kept")), "row", "left")
    return marked.groupBy("event_type").agg(F.count_if(F.col("kept").isNull()).alias("late"), F.count_if("kept").alias("in_time"))


add("ts_late_data", "events", _kept_in_time,
    """WITH b AS (SELECT *, epoch_us(ts) AS us, floor((epoch(ts)::BIGINT + json_extract_string(props, '$.k')::INT * 3600) / 432000) AS arrival FROM events),
w AS (SELECT arrival, max(us) AS top FROM b GROUP BY arrival), m AS (SELECT arrival, (max(top) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 86400000) * 1000 AS mark FROM w)
SELECT event_type, count(*) FILTER (us <= mark) AS late, count(*) FILTER (coalesce(us > mark, true)) AS in_time FROM b JOIN m USING (arrival) GROUP BY event_type""")
