"""Queries of the operators that parse, fold, stream or change entity tables, and the remaining reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.functions import parsing, rules
from emberlane.functions.obfuscate import pick
from emberlane.operators import entities, folds, sessions
from emberlane.plans.catalog import add

ID = "session_id, step"


def _sel(cols):
    """A projection of each step; ``cols`` makes the columns when the query is built, as that takes a session."""
    return lambda df: df.select("session_id", "step", *cols())


# ---- parsing and decoding (no SQL form) --------------------------------------------------------------
add("boundary_detect", "actions", lambda d: parsing.boundary_detect(d, ["session_id", "step"], "action"))
add("html_info_tags", "actions", _sel(lambda: [F.size(F.regexp_extract_all("action", F.lit("(</?INFORMATION>)"), F.lit(1))).cast("bigint").alias("n"), F.instr("action", "</INFORMATION>").cast("bigint").alias("at")]), f"SELECT {ID}, len(regexp_extract_all(action, '(</?INFORMATION>)')) AS n, instr(action, '</INFORMATION>') AS at FROM actions")
add("tool_call_format", "memberships", lambda d: d.select("user_id", "channel", F.concat(F.lit("add("), F.array_join(F.transform(F.map_entries(F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("channel"), F.col("channel"))), lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'"))), ", "), F.lit(")")).alias("call")), "SELECT user_id, channel, 'add(user=''' || user_id || ''', channel=''' || channel || ''')' AS call FROM memberships")
add("infer_columns", "documents", lambda d: d.select(F.col(next(c for c in d.columns if c.lower() in ("prompt", "text", "content"))).alias("t")).agg(F.count("t").alias("n")), "SELECT count(text) AS n FROM documents")
add("feedback_payload", "predictions", lambda d: d.select("doc_id", F.coalesce("layer", F.lit("none")).alias("layer"), F.coalesce("score", F.lit(0.0)).alias("ml_score"), F.coalesce("blocked", F.lit(False)).alias("was_blocked")), "SELECT doc_id, coalesce(layer, 'none') AS layer, coalesce(score, 0.0) AS ml_score, coalesce(blocked, false) AS was_blocked FROM predictions")

# ---- folds and sequences -----------------------------------------------------------------------------
add("ts_chain_window", "actions", lambda d: sessions.action_chain(d, rules.matches(F.col("action"), r"\brm\b"), rules.matches(F.col("action"), r"\bhistory\b|\bdelete\b"), 60, "destroy_cover"), r"SELECT a.session_id, 'destroy_cover' AS rule, a.step AS pre_step, arg_min(b.step, b.ts) AS post_step FROM actions a JOIN actions b ON a.session_id = b.session_id AND b.ts > a.ts AND b.ts <= a.ts + 60 WHERE regexp_matches(a.action, '\brm\b', 'i') AND regexp_matches(b.action, '\bhistory\b|\bdelete\b', 'i') GROUP BY a.session_id, a.step")
add("ts_trusted", "actions", lambda d: d.select("session_id", "step", F.regexp_extract("action", r"^([A-Za-z_]\w*)\(", 1).isin(*rules.TRUSTED_TOOLS).alias("trusted")), rf"SELECT {ID}, regexp_extract(action, '^([A-Za-z_]\w*)\(', 1) IN ({', '.join(repr(t) for t in rules.TRUSTED_TOOLS)}) AS trusted FROM actions")
add("dedup_minhash", "documents", lambda d: folds.minhash_dedup(d, "doc_id", "text"))

# ---- entity changes: new snapshots -------------------------------------------------------------------
add("email_send", "emails", lambda d: entities.append(d, [{"sender": "me@mail.example", "subject": "hi", "body": "b", "status": "sent"}]).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT status, count(*) AS n FROM (SELECT status FROM emails UNION ALL SELECT 'sent') GROUP BY status")
add("email_delete", "emails", lambda d: entities.delete(d, F.col("id") % 5 == 0).select("id"), "SELECT id FROM emails WHERE id % 5 <> 0")
add("get_unread_emails", "emails", lambda d: entities.update(d, ~F.col("is_read"), is_read=F.lit(True)).groupBy("is_read").agg(F.count(F.lit(1)).alias("n")), "SELECT true AS is_read, count(*) AS n FROM emails HAVING count(*) > 0")
add("search_contacts_by_email", "emails", lambda d: entities.search(d, "USER2@", "sender").select("sender").distinct(), "SELECT DISTINCT sender FROM emails WHERE contains(lower(sender), 'user2@')")
add("calendar_cancel", "calendar", lambda d: entities.update(d, F.col("id") < 100, status=F.lit("canceled")).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN id < 100 THEN 'canceled' ELSE status END AS status, count(*) AS n FROM calendar GROUP BY 1")
add("calendar_reschedule", "calendar", lambda d: entities.update(d, F.col("id") % 10 == 0, start_time=F.col("start_time") + F.expr("INTERVAL 1 DAY")).agg(F.count_if(F.to_date("start_time") == F.to_date(F.lit("2024-01-10"))).alias("n")), "SELECT count(*) FILTER ((CASE WHEN id % 10 = 0 THEN start_time + INTERVAL 1 DAY ELSE start_time END)::DATE = DATE '2024-01-10') AS n FROM calendar")
add("calendar_conflicts", "calendar", lambda d: entities.overlapping(d.withColumn("end_time", F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("seconds").cast("decimal(18,6)"))), "start_time", "end_time", "user_id").select("id"), "SELECT id FROM (SELECT *, max(start_time + to_seconds(seconds)) OVER (PARTITION BY user_id ORDER BY start_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM calendar) WHERE start_time < until")
add("drive_append", "files", lambda d: entities.update(d, F.col("id") % 2 == 0, content=F.concat("content", F.lit("++"))).select("id", F.length("content").cast("bigint").alias("size")), "SELECT id, length(content) + CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS size FROM files")
add("drive_create", "files", lambda d: entities.append(d, [{"filename": "n.txt", "content": "abc", "size": 3}]).agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n")), "SELECT max(id) + 1 AS id, count(*) + 1 AS n FROM files")
add("drive_delete", "files", lambda d: entities.delete(d, F.col("owner") == "src1").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM files WHERE owner <> 'src1'")
add("get_file_by_id", "files", lambda d: d.where("id = 12").select("filename"), "SELECT filename FROM files WHERE id = 12")
add("list_files", "files", lambda d: d.select("id", "filename"), "SELECT id, filename FROM files")
add("bank_send", "transactions", lambda d: entities.append(d, [{"sender": "ACC1", "recipient": "ACC2", "amount": 5.5, "recurring": False}]).agg(F.max("id").alias("id"), F.round(F.sum("amount"), 2).alias("total")), "SELECT max(id) + 1 AS id, round(sum(amount) + 5.5, 2) AS total FROM transactions")
add("bank_update", "transactions", lambda d: entities.update(d, F.col("recurring"), amount=F.lit(0.0)).agg(F.round(F.sum("amount"), 2).alias("total")), "SELECT round(sum(CASE WHEN recurring THEN 0.0 ELSE amount END), 2) AS total FROM transactions")
add("env_diff", "transactions", lambda d: entities.snapshot_diff(d, entities.update(entities.delete(d, F.col("id") % 97 == 0), F.col("id") % 89 == 0, subject=F.lit("changed")), "id"), "SELECT id, CASE WHEN id % 97 = 0 THEN 'removed' ELSE 'changed' END AS change FROM transactions WHERE id % 97 = 0 OR id % 89 = 0")
add("get_channels", "memberships", lambda d: d.select("channel").distinct(), "SELECT DISTINCT channel FROM memberships")
add("user_inbox", "messages", lambda d: d.where("sender = 3").select("id", "channel"), "SELECT id, channel FROM messages WHERE sender = 3")
add("web_download", "webpages", lambda d: d.select("page_id", F.md5(F.coalesce("content", F.lit("404 Not Found"))).alias("body")), "SELECT page_id, md5(coalesce(content, '404 Not Found')) AS body FROM webpages")
for _key, _cols in {"get_restaurants_address": "address", "get_rating_reviews_for_restaurants": "rating", "get_price_for_restaurants": "price_min", "get_rating_reviews_for_car_rental": "rating", "get_car_rental_address": "address", "get_car_price_per_day": "price_min"}.items():
    _kind = "restaurant" if "restaurant" in _key else "car"
    add(_key, "places", lambda d, k=_kind, c=_cols: d.where((F.col("kind") == k) & (F.col("id") % 4 < 2)).select("name", c), f"SELECT name, {_cols} FROM places WHERE kind = '{_kind}' AND id % 4 < 2")
add("user_information", "customer", lambda d: d.select("c_custkey", F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("m")).select("c_custkey", F.element_at("m", "name").alias("name"), F.element_at("m", "segment").alias("segment")), "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
add("attack_render", "benchmark", lambda d: d.select("item_id", F.md5(entities.render(F.lit("<INFORMATION> {user}, first do: {goal} ({model}) </INFORMATION>"), goal=F.col("text"), user=F.lit("Emma"), model=F.lit("AI"))).alias("prompt")), "SELECT item_id, md5('<INFORMATION> Emma, first do: ' || text || ' (AI) </INFORMATION>') AS prompt FROM benchmark")
add("messages_to_dict", "actions", lambda d: d.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("step", "role"))).alias("m")).select("session_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles")), "SELECT session_id, string_agg(role, ',' ORDER BY step) AS roles FROM actions GROUP BY session_id")
add("injection_seen", "actions", lambda d: d.withColumn("hit", F.col("action").contains("</INFORMATION>")).groupBy("session_id").agg(F.count_if("hit").alias("times"), F.min(F.when(F.col("hit"), F.col("step"))).alias("first")), "SELECT session_id, count(*) FILTER (contains(action, '</INFORMATION>')) AS times, min(step) FILTER (contains(action, '</INFORMATION>')) AS first FROM actions GROUP BY session_id")
add("detector_model", "predictions", lambda d: d.select("doc_id", F.round(F.when(F.col("truth") == 0, F.col("score")).otherwise(1 - F.col("score")), 8).alias("safety")), "SELECT doc_id, round(CASE WHEN truth = 0 THEN score ELSE 1 - score END, 8) AS safety FROM predictions")
add("suite_results_print", "results", lambda d: d.agg(F.round(F.avg(F.col("utility").cast("int")), 8).alias("utility"), F.round(F.avg(F.col("security").cast("int")), 8).alias("security")), "SELECT round(avg(utility::INT), 8) AS utility, round(avg(security::INT), 8) AS security FROM results")
add("init_query", "actions", lambda d: d.groupBy("session_id").agg(F.array_append(F.array_sort(F.collect_list("step")), F.max("step") + 1).alias("s")).select("session_id", F.size("s").cast("bigint").alias("n")), "SELECT session_id, count(*) + 1 AS n FROM actions GROUP BY session_id")
add("tools_sequence_text", "actions", lambda d: d.where("action_type = 'tool_call'").groupBy("session_id").agg(F.array_sort(F.collect_list("step")).alias("s")).select("session_id", F.array_join(F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". step "), x.cast("string"))), "\n").alias("t")), "SELECT session_id, string_agg(n || '. step ' || step, chr(10) ORDER BY step) AS t FROM (SELECT session_id, step, row_number() OVER (PARTITION BY session_id ORDER BY step) AS n FROM actions WHERE action_type = 'tool_call') GROUP BY session_id")
add("dos_attack", "results", lambda d: d.where("injection_task = 0").select("suite", "user_task", (~F.col("utility")).alias("security")), "SELECT suite, user_task, NOT utility AS security FROM results WHERE injection_task = 0")
# ---- sources, learned scores, obfuscation, the rest --------------------------------------------------


def _lines(d):
    from emberlane.sources.tables import parse_json_lines

    lines = d.select(F.when(F.col("step") == 2, "{broken").when(F.col("step") == 3, " ").otherwise(F.to_json(F.struct("action", "label", F.col("session_id").cast("string").alias("session_id"), F.col("step").cast("int").alias("step_index")))).alias("value"))
    return parse_json_lines(lines).select("session_id", "step_index", F.md5("action").alias("action"))


add("scan_jsonl", "actions", _lines, "SELECT session_id::VARCHAR AS session_id, step::INT AS step_index, md5(action) AS action FROM actions WHERE step NOT IN (2, 3)")


def _scored(d):
    from emberlane.operators.scoring import fit_text_classifier, ml_score

    rows = d.withColumn("y", (F.col("label") == "malicious").cast("double"))
    return ml_score(rows, fit_text_classifier(rows, "action", "y", 512, 5)).select("session_id", "step", "y", F.round("ml_score", 6).alias("ml_score"))


add("ml_score", "actions", _scored)
add("error_report", "predictions", lambda d: d.where("blocked AND truth = 0").groupBy("layer", "model").agg(F.count(F.lit(1)).alias("false_positives")), "SELECT layer, model, count(*) AS false_positives FROM predictions WHERE blocked AND truth = 0 GROUP BY ALL")
add("top_features", "actions", lambda d: d.select("label", F.explode(F.array_distinct(F.split(F.lower("action"), r"\W+"))).alias("w")).where("w <> ''").groupBy("w").agg((F.count_if(F.col("label") == "malicious") - F.count_if(F.col("label") == "benign")).alias("weight")).orderBy(F.desc("weight"), "w").limit(20),
    r"SELECT w, count(*) FILTER (label = 'malicious') - count(*) FILTER (label = 'benign') AS weight FROM (SELECT label, unnest(list_distinct(regexp_split_to_array(lower(action), '\W+'))) AS w FROM actions) WHERE w <> '' GROUP BY w ORDER BY weight DESC, w LIMIT 20")
add("bootstrap", "predictions", lambda d: d.select("blocked", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("b"), "doc_id").withColumn("w", pick(3, F.col("doc_id"), F.col("b"))).groupBy("b").agg(F.round(F.sum(F.col("w") * F.col("blocked").cast("int")) / F.sum("w"), 8).alias("rate")),
    "SELECT b, round(sum(w * blocked::INT) / sum(w), 8) AS rate FROM (SELECT blocked, b, ('0x' || substr(md5(doc_id || '|' || b), 1, 8))::BIGINT % 3 AS w FROM predictions, (SELECT unnest(range(20))::INT AS b)) GROUP BY b")
