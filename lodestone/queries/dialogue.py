"""Queries over dialogue, memory, tasks and rate windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import dialogue as T, memory as M, tasks as K
from lodestone.queries import duck as D
from lodestone.queries.text import describe_sql
from lodestone.registry import query
from lodestone.session import derive, table

LAST = "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)"


def messages(spark, d):
    return table(spark, d, "conversations").withColumnRenamed("text", "content")


@query("last_n", f"SELECT conv_id, turn, role, text AS content FROM conversations QUALIFY {LAST} <= 5")
def last_n(spark, d):
    return T.last_n(messages(spark, d), ["conv_id"], "turn", 5)


@query("sticky_facts", f"""SELECT user_id AS conv_id, 'fact' AS part, event_type AS name, CAST(arg_max(event_id, event_id) AS VARCHAR) AS content FROM events GROUP BY ALL
UNION ALL SELECT conv_id, 'message', CAST(turn AS VARCHAR), text FROM (SELECT * FROM conversations QUALIFY {LAST} <= 5)""")
def sticky_facts(spark, d):
    facts = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_type").alias("name"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("at"))
    return T.sticky_facts(facts, messages(spark, d), ["conv_id"], "turn", 5)


@query("branch_history", """WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'b' || turn % 2 END AS branch FROM conversations), b AS (SELECT DISTINCT conv_id, branch AS name, 3 AS checkpoint FROM m WHERE branch IS NOT NULL)
SELECT b.conv_id, name, turn, false AS own FROM b JOIN m USING (conv_id) WHERE branch IS NULL AND turn <= checkpoint UNION ALL SELECT conv_id, branch, turn, true FROM m WHERE branch IS NOT NULL""")
def branch_history(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.concat(F.lit("b"), (F.col("turn") % 2).cast("string"))).alias("branch"))
    branches = rows.filter("branch IS NOT NULL").select("conv_id", F.col("branch").alias("name"), F.lit(3).alias("checkpoint")).distinct()
    return T.branch_history(rows, branches, "conv_id", "turn").select("conv_id", "name", "turn", "own")


@query("compact_context", f"""SELECT conv_id, turn, role, content FROM (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM (
SELECT conv_id, turn, role, text AS content FROM conversations QUALIFY {LAST} <= 4)) WHERE s <= 1200""")
def compact_context(spark, d):
    return T.compact_context(messages(spark, d), ["conv_id"], "turn", "content")


@query("trim_history", f"""SELECT conv_id, turn, n FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM (
SELECT conv_id, turn, length(text) AS n FROM conversations QUALIFY {LAST} <= 12)) WHERE s <= 900 OR r = 1""")
def trim_history(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return T.trim_history(rows, ["conv_id"], "turn", "n", 12, 900)


ENTRIES = """SELECT event_id AS ord, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id,
  CASE event_id % 3 WHEN 0 THEN 'short-term' WHEN 1 THEN 'working' ELSE 'long-term' END AS layer, CASE WHEN event_id % 3 = 2 THEN 'global' ELSE 'task' || (user_id % 5) END AS scope,
  CASE WHEN event_id % 97 = 0 THEN ' ' ELSE ' ' || event_type || ' ' || CAST(floor(value) AS INT) END AS content, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'tool' END AS role, event_id % 4 = 0 AS optimized, false AS user_placed
  FROM (SELECT *, HASH AS h FROM events)"""
ENTRIES_DUCK = ENTRIES.replace("HASH", "sha256(CAST(event_id - CASE WHEN event_id % 500 = 499 THEN 1 ELSE 0 END AS STRING))")
ENTRIES_SPARK = ENTRIES.replace("HASH", "sha2(CAST(event_id - CASE WHEN event_id % 500 = 499 THEN 1 ELSE 0 END AS STRING), 256)")
UNIQUE_DUCK, UNIQUE_SPARK = ENTRIES.replace("HASH", "sha256(CAST(event_id AS STRING))"), ENTRIES.replace("HASH", "sha2(CAST(event_id AS STRING), 256)")


@query("dedup_memory", f"SELECT ord, id, layer, scope, content FROM ({ENTRIES_DUCK}) QUALIFY row_number() OVER (PARTITION BY layer, scope, trim(content) ORDER BY ord) = 1")
def dedup_memory(spark, d):
    return M.dedup_memory(derive(spark, d, ENTRIES_SPARK), "ord").select("ord", "id", "layer", "scope", "content")


CHANGES = """SELECT event_id AS change_id, CASE event_id % 11 WHEN 0 THEN 'delete' WHEN 1 THEN 'delete' WHEN 2 THEN 'noop' ELSE 'upsert' END AS action, CASE event_id % 7 WHEN 0 THEN 'elsewhere' WHEN 1 THEN 'working' ELSE 'long-term' END AS target,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS id, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE event_type END AS content, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN NULL ELSE '7' END AS confidence FROM events"""
STORE = "SELECT CAST(c_custkey AS STRING) AS id, 'working' AS layer, 'task1' AS scope, c_name AS content FROM customer"


@query("route_changes", f"""WITH c AS (SELECT c.*, s.content AS stored, coalesce(confidence NOT IN ('high', 'medium'), true) AS unsure FROM ({CHANGES}) c LEFT JOIN ({STORE}) s ON c.id = s.id),
r AS (SELECT *, CASE WHEN target = 'elsewhere' THEN 'bad_target' WHEN action = 'noop' THEN 'bad_action' WHEN action = 'upsert' AND trim(content) = '' THEN 'blank_content' WHEN unsure AND action = 'delete' AND stored IS NULL THEN 'unknown_id' END AS reason FROM c)
SELECT change_id, target, id, CASE WHEN unsure AND action = 'delete' AND reason IS NULL THEN 'upsert' ELSE action END AS action, CASE WHEN unsure AND action = 'delete' AND reason IS NULL THEN stored ELSE content END AS content,
CASE WHEN reason IS NOT NULL THEN 'error' WHEN unsure THEN 'pending' ELSE 'apply' END AS route, reason FROM r""")
def route_changes(spark, d):
    return M.route_changes(derive(spark, d, CHANGES), derive(spark, d, STORE))


# Every stored id is changed once at most, so a place that an accepted change takes is held from then on.
@query("apply_memory_changes", f"""WITH e AS MATERIALIZED ({UNIQUE_DUCK}), c AS (
  SELECT v.event_id AS change_id, CASE v.event_id % 5 WHEN 0 THEN 'delete' ELSE 'upsert' END AS action, CASE v.event_id % 2 WHEN 0 THEN 'working' ELSE 'long-term' END AS target,
    CASE WHEN v.event_id % 3 = 0 THEN NULL ELSE e.id END AS id, CASE WHEN v.event_id % 13 = 0 THEN ' ' ELSE v.event_type END AS content, concat('new-', v.event_id) AS new_id FROM events v JOIN e ON e.ord = v.event_id),
n AS (SELECT c.*, e.layer, e.scope, CASE target WHEN 'long-term' THEN 'global' ELSE 'task1' END AS place FROM c LEFT JOIN e ON e.id = c.id),
ups AS MATERIALIZED (SELECT * FROM n WHERE action = 'upsert' AND trim(content) <> '' AND (id IS NULL OR scope IN ('global', 'task1'))),
gone AS (SELECT id FROM n WHERE id IS NOT NULL AND action = 'delete' AND target = layer AND scope IN ('global', 'task1')),
held AS (SELECT target, place, trim(content) AS k, min(change_id) AS first FROM (SELECT target, place, content, change_id FROM ups UNION ALL SELECT layer, scope, content, -1 FROM e) GROUP BY ALL)
SELECT e.id, coalesce(u.target, e.layer) AS layer, coalesce(u.place, e.scope) AS scope, coalesce(u.content, e.content) AS content FROM e LEFT JOIN ups u ON u.id = e.id WHERE e.id NOT IN (SELECT id FROM gone)
UNION ALL SELECT new_id, u.target, u.place, content FROM ups u JOIN held h ON h.target = u.target AND h.place = u.place AND h.k = trim(u.content) WHERE id IS NULL AND first = change_id""")
def apply_memory_changes(spark, d):
    entries = derive(spark, d, UNIQUE_SPARK)
    changes = derive(spark, d, f"""SELECT e.event_id AS change_id, CASE e.event_id % 5 WHEN 0 THEN 'delete' ELSE 'upsert' END AS action, CASE e.event_id % 2 WHEN 0 THEN 'working' ELSE 'long-term' END AS target,
      CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE m.id END AS id, CASE WHEN e.event_id % 13 = 0 THEN ' ' ELSE e.event_type END AS content, concat('new-', e.event_id) AS new_id FROM events e JOIN ({UNIQUE_SPARK}) m ON m.ord = e.event_id""")
    return M.apply_memory_changes(entries, changes, "task1")[0].select("id", "layer", "scope", "content")


# Every event is in one group of its scope: a plan merges the group of an even event and deletes that of an odd one.
PLAN = """SELECT CAST(event_id % 50 AS STRING) AS scope, min(event_id) AS op, CASE WHEN min(event_id) % 2 = 0 THEN 'merge' ELSE 'delete' END AS kind,
  array_sort(collect_list(event_id)) AS items, min(event_type) AS content FROM events GROUP BY event_id % 50, CAST(floor(event_id / 100) AS BIGINT)"""


@query("apply_merge_plan", f"""WITH e AS MATERIALIZED (SELECT CAST(ord % 50 AS VARCHAR) AS scope, ord AS n, content, optimized FROM ({UNIQUE_DUCK})),
p AS MATERIALIZED (SELECT CAST(event_id % 50 AS VARCHAR) AS scope, min(event_id) AS op, CASE WHEN min(event_id) % 2 = 0 THEN 'merge' ELSE 'delete' END AS kind,
  list(event_id ORDER BY event_id) AS items, min(event_type) AS content FROM events GROUP BY event_id % 50, CAST(floor(event_id / 100) AS BIGINT)),
f AS MATERIALIZED (SELECT scope, min(n) AS n FROM e GROUP BY scope, trim(content)),
u AS MATERIALIZED (SELECT scope, op, kind, content, unnest(items) AS n, unnest(range(len(items))) AS i FROM p),
l AS (SELECT u.*, x.optimized FROM u LEFT JOIN (SELECT e.* FROM e SEMI JOIN f USING (scope, n)) x USING (scope, n)),
void AS MATERIALIZED (
  SELECT scope FROM l WHERE optimized IS NULL OR (kind = 'delete' AND optimized) UNION SELECT scope FROM u GROUP BY scope, n HAVING count(*) > 1
  UNION SELECT scope FROM l WHERE kind = 'merge' GROUP BY scope, op HAVING bool_and(optimized) UNION SELECT scope FROM p WHERE kind = 'merge' AND (len(items) < 2 OR trim(content) = '')),
live AS MATERIALIZED (SELECT * FROM u WHERE scope NOT IN (SELECT scope FROM void))
SELECT scope, n, content, optimized, {describe_sql('content')} AS description FROM (
  SELECT e.scope, e.n, coalesce(trim(t.content), e.content) AS content, e.optimized OR e.scope NOT IN (SELECT scope FROM void) AS optimized
  FROM e LEFT JOIN (SELECT * FROM live WHERE kind = 'merge' AND i = 0) t USING (scope, n)
  WHERE (e.scope IN (SELECT scope FROM void) OR (e.scope, e.n) IN (SELECT (scope, n) FROM f)) AND (e.scope, e.n) NOT IN (SELECT (scope, n) FROM live WHERE kind = 'delete' OR i > 0))""")
def apply_merge_plan(spark, d):
    entries = derive(spark, d, f"SELECT CAST(ord % 50 AS STRING) AS scope, ord AS n, content, optimized FROM ({UNIQUE_SPARK})")
    return M.apply_merge_plan(entries, derive(spark, d, PLAN))[0]


@query("move_memory", f"""WITH e AS ({UNIQUE_DUCK}), m AS (SELECT id, CASE WHEN ord % 10 = 0 THEN 'working' ELSE layer END AS source, CASE ord % 4 WHEN 0 THEN 'long-term' WHEN 1 THEN 'working' WHEN 2 THEN 'short-term' END AS target FROM e WHERE ord % 5 = 0)
SELECT e.id, CASE WHEN m.id IS NOT NULL AND target <> layer THEN target ELSE layer END AS layer, CASE WHEN m.id IS NOT NULL AND target <> layer THEN CASE WHEN target = 'long-term' THEN 'global' WHEN scope = 'global' THEN 'now' ELSE scope END ELSE scope END AS scope,
m.id IS NOT NULL AND target <> layer AS user_placed FROM e LEFT JOIN m ON m.id = e.id AND m.source = e.layer WHERE m.id IS NULL OR target IS NOT NULL""")
def move_memory(spark, d):
    entries = derive(spark, d, UNIQUE_SPARK)
    moves = entries.filter("ord % 5 = 0").select("id", F.when(F.col("ord") % 10 == 0, "working").otherwise(F.col("layer")).alias("source"),
        F.when(F.col("ord") % 4 == 0, "long-term").when(F.col("ord") % 4 == 1, "working").when(F.col("ord") % 4 == 2, "short-term").alias("target"))
    return M.move_memory(entries, moves, "now").select("id", "layer", "scope", "user_placed")


@query("memory_violations", f"""WITH e AS ({ENTRIES_DUCK}) SELECT id, layer, 'blank_content' AS problem FROM e WHERE trim(content) = '' UNION ALL SELECT id, min(layer), 'duplicate_id' FROM e GROUP BY id HAVING count(*) > 1""")
def memory_violations(spark, d):
    return M.memory_violations(derive(spark, d, ENTRIES_SPARK))


@query("scoped_memory", f"""WITH e AS ({UNIQUE_DUCK}) SELECT id, scope AS seen_by FROM e WHERE scope IN ('task1', 'task2') AND (layer = 'working' OR (layer = 'short-term' AND role = 'user')) UNION ALL SELECT id, '*' FROM e WHERE layer = 'long-term' AND scope = 'global'""")
def scoped_memory(spark, d):
    entries = derive(spark, d, UNIQUE_SPARK)
    scopes = entries.filter("scope IN ('task1', 'task2')").select("scope")
    return M.scoped_memory(entries, scopes).select("id", "seen_by")


# --- chat state ----------------------------------------------------------------------------------
CHAT_CHANGES = """SELECT user_id % 40 AS chat_id, event_id AS turn, 1 AS seq, CASE event_type WHEN 'click' THEN 'goal' WHEN 'view' THEN 'constraints' WHEN 'error' THEN 'terms' WHEN 'signup' THEN 'decisions' ELSE 'constraints' END AS category,
  CASE WHEN event_type = 'click' THEN 'set' WHEN event_type = 'purchase' THEN 'remove' WHEN event_id % 83 = 0 THEN 'twist' ELSE 'add' END AS action,
  CASE WHEN event_id % 2 = 0 THEN 'V' ELSE 'v' END || CAST(floor(value) AS INT) % 12 AS value, CASE WHEN event_id % 59 = 0 THEN 'made up' ELSE 'k ' || event_id END AS evidence FROM events"""
CHAT_MESSAGES = "SELECT user_id % 40 AS chat_id, event_id AS turn, 'said: k ' || event_id || ' and more' AS content FROM events"
BAD = "CASE WHEN action = 'twist' THEN 'bad_action' WHEN turn % 59 = 0 THEN 'bad_evidence' END"


@query("state_violations", f"SELECT chat_id, turn, seq, {BAD} AS problem FROM ({CHAT_CHANGES}) WHERE action = 'twist' OR turn % 59 = 0")
def state_violations(spark, d):
    return T.state_violations(derive(spark, d, CHAT_CHANGES), derive(spark, d, CHAT_MESSAGES))


def accepted_changes(spark, d):
    changes = derive(spark, d, CHAT_CHANGES)
    return T.valid_changes(changes, T.state_violations(changes, derive(spark, d, CHAT_MESSAGES)))


@query("chat_state", f"""WITH c AS (SELECT *, lower(value) AS k FROM ({CHAT_CHANGES}) WHERE NOT (action = 'twist' OR turn % 59 = 0)),
off AS (SELECT chat_id, category, k, max(turn) AS t FROM c WHERE action = 'remove' GROUP BY ALL),
lists AS (SELECT c.chat_id, c.category, arg_min(value, turn) AS value, arg_min(evidence, turn) AS evidence, min(turn) AS turn FROM c LEFT JOIN off USING (chat_id, category, k) WHERE c.category <> 'goal' AND action = 'add' AND (off.t IS NULL OR turn > off.t) GROUP BY c.chat_id, c.category, c.k),
g AS (SELECT *, last_value(k) OVER (PARTITION BY chat_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM c WHERE category = 'goal'),
gd AS (SELECT chat_id, max(turn) AS t FROM g WHERE k <> fin GROUP BY ALL)
SELECT * FROM lists UNION ALL SELECT g.chat_id, category, arg_min(value, turn), arg_min(evidence, turn), min(turn) FROM g LEFT JOIN gd USING (chat_id) WHERE k = fin AND (gd.t IS NULL OR turn > gd.t) GROUP BY g.chat_id, category""")
def chat_state(spark, d):
    return T.chat_state(accepted_changes(spark, d))


@query("turn_gaps", "SELECT conv_id, turn, expected FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations WHERE role <> 'system') WHERE turn <> expected")
def turn_gaps(spark, d):
    rows = table(spark, d, "conversations").filter("role <> 'system'").select("conv_id", "turn")
    return T.turn_gaps(rows, ["conv_id"], "turn")


SAVES = """SELECT o_custkey AS task_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'P' THEN 'PLANNING' WHEN 'F' THEN 'EXECUTION' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'DONE' ELSE 'VALIDATION' END END AS state, o_orderpriority < '4' AS confirmed FROM orders"""


@query("task_transitions", f"""WITH s AS ({SAVES}), f AS (SELECT task_id, list_reduce(list({{'q': seq, 's': state, 'c': confirmed, 'cur': '', 'ok': CAST([] AS BIGINT[])}} ORDER BY seq), lambda a, x: {{'q': x.q, 's': x.s, 'c': x.c,
 'cur': CASE WHEN a.cur = '' OR a.cur = x.s OR (a.cur = 'PLANNING' AND x.s = 'EXECUTION' AND x.c) OR (a.cur = 'EXECUTION' AND x.s = 'VALIDATION') OR (a.cur = 'VALIDATION' AND x.s IN ('DONE', 'EXECUTION')) THEN x.s ELSE a.cur END,
 'ok': CASE WHEN a.cur = '' OR a.cur = x.s OR (a.cur = 'PLANNING' AND x.s = 'EXECUTION' AND x.c) OR (a.cur = 'EXECUTION' AND x.s = 'VALIDATION') OR (a.cur = 'VALIDATION' AND x.s IN ('DONE', 'EXECUTION')) THEN list_append(a.ok, x.q) ELSE a.ok END}},
 {{'q': CAST(0 AS BIGINT), 's': '', 'c': false, 'cur': '', 'ok': CAST([] AS BIGINT[])}}) AS f FROM s GROUP BY task_id)
SELECT task_id, seq, state, confirmed, list_contains(f.ok, seq) AS accepted FROM s JOIN f USING (task_id)""")
def task_transitions(spark, d):
    return K.task_transitions(derive(spark, d, SAVES))


@query("token_totals", """SELECT o_custkey AS answer, CAST(sum(o_orderkey) AS BIGINT) AS input_tokens, CAST(sum(length(o_orderpriority)) AS BIGINT) AS output_tokens, count(*) AS attempts FROM orders GROUP BY ALL""")
def token_totals(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_custkey").alias("answer"), F.col("o_orderkey").alias("input_tokens"), F.length("o_orderpriority").alias("output_tokens"))
    return T.token_totals(calls, ["answer"])


STAGES = """SELECT '[local] request=' || event_id || ' stage=' || event_type || ' elapsed_ms=' || CAST(floor(value) AS INT) || CASE WHEN event_id % 9 = 0 THEN ' status=error' WHEN event_id % 9 = 1 THEN ' started' ELSE ' status=ok' END AS line FROM events"""


@query("stage_metrics", """SELECT event_type AS stage, count(*) AS calls, count(*) FILTER (WHERE event_id % 9 = 0) AS failures, CAST(sum(floor(value)) AS BIGINT) AS total_ms, CAST(max(floor(value)) AS BIGINT) AS max_ms, round(quantile_cont(floor(value), 0.95), 6) AS p95_ms FROM events GROUP BY ALL""")
def stage_metrics(spark, d):
    return T.stage_metrics(derive(spark, d, STAGES)).withColumn("p95_ms", F.round("p95_ms", 6))


WIDTH = 21600


@query("rate_limit", f"""WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), f AS (SELECT user_id, list_reduce(list({{'s': s, 'i': event_id, 'b': CAST(-1000000000 AS BIGINT), 'l': CAST([] AS STRUCT(i BIGINT, b BIGINT)[])}} ORDER BY ts, event_id),
 lambda a, x: {{'s': x.s, 'i': x.i, 'b': CASE WHEN x.s - a.b >= {WIDTH} THEN x.s ELSE a.b END, 'l': list_append(a.l, {{'i': x.i, 'b': CASE WHEN x.s - a.b >= {WIDTH} THEN x.s ELSE a.b END}})}},
 {{'s': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'b': CAST(-1000000000 AS BIGINT), 'l': CAST([] AS STRUCT(i BIGINT, b BIGINT)[])}}) AS f FROM e GROUP BY user_id),
w AS (SELECT user_id, unnest(f.l) AS x FROM f), r AS (SELECT e.user_id, e.event_id, s, x.b AS b, row_number() OVER (PARTITION BY e.user_id, x.b ORDER BY ts, event_id) AS n FROM w JOIN e ON e.user_id = w.user_id AND e.event_id = x.i)
SELECT user_id, event_id, b AS window_start, n <= 1 AS allowed, CASE WHEN n > 1 THEN greatest(1, {WIDTH} - (s - b)) END AS retry_after FROM r""")
def rate_limit(spark, d):
    out = K.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 1, WIDTH)
    return out.select("user_id", "event_id", "window_start", "allowed", "retry_after")
