"""Chat state, memory, tasks, rate windows, snapshots and streams on small fixtures."""

import datetime as dt
import json
import time

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers every query)
from lodestone.operators import context as A, dialogue as T, evidence as Q, memory as M, scoring, snapshots as S, tasks as K
from lodestone.registry import QUERIES
from lodestone.sources.index_store import read_index, write_index
from lodestone.sources.media import media_inventory
from lodestone.sources.snapshots import read_snapshot
from lodestone.streaming.common import drain, file_stream
from lodestone.streaming.indexing import stream_index
from lodestone.streaming.stateful import chat_state_stream, latest_state, task_stream

CHANGE = "chat_id long, turn long, seq int, category string, action string, value string, evidence string"


def changes(spark, rows):
    return spark.createDataFrame([(1, *r, "e") for r in rows], CHANGE)


def test_chat_state_follows_the_scenario(spark):
    rows = [(1, 1, "goal", "set", "собрать узел"), (2, 1, "constraints", "add", "только бетон"), (3, 1, "selections", "add", "A_1"),
            (4, 1, "decisions", "add", "решено"), (6, 1, "decisions", "add", "РЕШЕНО"), (9, 1, "constraints", "remove", "только бетон"),
            (9, 2, "constraints", "add", "только железобетон"), (10, 1, "goal", "set", "Собрать узел")]
    got = {(r.category, r.value, r.turn) for r in T.chat_state(changes(spark, rows)).collect()}
    assert got == {("goal", "собрать узел", 1), ("constraints", "только железобетон", 9), ("selections", "A_1", 3), ("decisions", "решено", 4)}


def test_a_full_list_refuses_the_turn(spark):
    rows = [(i, 1, "terms", "add", f"v{i}") for i in range(1, 33)] + [(40, 1, "goal", "set", "g"), (40, 2, "terms", "add", "extra"), (41, 1, "terms", "remove", "v1"), (42, 1, "terms", "add", "last")]
    got = {r.value for r in T.chat_state(changes(spark, rows)).collect()}
    assert "extra" not in got and "g" not in got and "last" in got and len(got) == 32


def test_state_rules(spark):
    rows = changes(spark, [(1, 1, "terms", "set", "v"), (1, 2, "nowhere", "add", "v"), (1, 3, "goal", "set", " "), (2, 1, "goal", "set", "ok")])
    messages = spark.createDataFrame([(1, 1, "some e text"), (1, 2, "nothing")], "chat_id long, turn long, content string")
    got = {(r.turn, r.seq): r.problem for r in T.state_violations(rows, messages).collect()}
    assert got == {(1, 1): "bad_category", (1, 2): "bad_category", (1, 3): "bad_value", (2, 1): "bad_evidence"}


def test_chat_stream_equals_batch(spark, tmp_path):
    rows = [(t, 1, "terms", "add" if t % 3 else "remove", f"v{t % 5}") for t in range(1, 40)]
    df = changes(spark, rows)
    df.filter("turn <= 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("turn > 20").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = latest_state(drain(chat_state_stream(file_stream(spark, str(tmp_path / "in"), "*.parquet", 10)), name="t"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, T.chat_state(df).collect()))


def test_chat_stream_gives_the_state_after_every_turn(spark, tmp_path):
    rows = [(t, 1, ("terms", "constraints")[t % 2], "add" if t % 3 else "remove", f"v{t % 7}") for t in range(1, 30)] + [(30, 1, "goal", "set", "Goal"), (30, 2, "terms", "add", "\u0451")]
    df = changes(spark, rows)
    df.filter("turn <= 12").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = chat_state_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))

    def parts():
        yield 1
        df.filter("turn > 12").write.mode("append").parquet(str(tmp_path / "in"))
        yield 2

    got = {r.turn: json.loads(r.state) for r in drain(stream, name="turns", parts=parts()).collect()}
    assert sorted(got) == list(range(1, 31))
    for turn in (1, 12, 13, 30):
        expected = T.chat_state(df.filter(F.col("turn") <= turn)).select("category", "value", "evidence", "turn").collect()
        assert sorted(map(tuple, got[turn])) == sorted(map(tuple, expected))


def test_a_bucket_keeps_its_tasks_apart(spark, tmp_path):
    saves = [(t, t * 100 + i, ("EXECUTION", "PLANNING", "EXECUTION", "DONE", "VALIDATION")[(i + (t or 0)) % 5], (None, True, False)[i % 3]) for t in range(1, 20) for i in range(10)]
    saves += [(None, 5000 + i, ("PLANNING", "EXECUTION")[i % 2], i % 4 == 1) for i in range(8)]
    df = spark.createDataFrame(saves, "task_id long, seq long, state string, confirmed boolean")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    expected = sorted(map(str, K.task_transitions(df).select("task_id", "seq", "state", "accepted").collect()))
    for buckets in (1, 5):
        assert sorted(map(str, drain(task_stream(stream, buckets), name="tasks").collect())) == expected


def test_a_part_of_many_files_is_not_late_to_itself(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), i % 11) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(r.event_id for r in QUERIES["rate_limit_stream"](spark, str(tmp_path)).collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rate_window_opens_at_the_first_event(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", base + dt.timedelta(seconds=s), s) for s in (0, 10, 20, 59, 60)], "k string, ts timestamp, id int")
    got = {r.id: (r.allowed, r.retry_after) for r in K.rate_limit(df, "k", "ts", "id", 2, 60).collect()}
    assert got == {0: (True, None), 10: (True, None), 20: (False, 40), 59: (False, 1), 60: (True, None)}


def test_task_edges(spark):
    rows = [("PLANNING", False, True), ("EXECUTION", False, False), ("EXECUTION", True, True), ("DONE", True, False), ("VALIDATION", False, True), ("EXECUTION", False, True), ("VALIDATION", False, True), ("DONE", False, True), ("PLANNING", True, False)]
    df = spark.createDataFrame([(1, i, s, c) for i, (s, c, _) in enumerate(rows)], "task_id int, seq int, state string, confirmed boolean")
    assert [r.accepted for r in K.task_transitions(df).orderBy("seq").collect()] == [ok for _, _, ok in rows]


ENTRY = "id string, layer string, scope string, content string"


def test_memory_changes(spark):
    entries = spark.createDataFrame([("a", "working", "t", "old"), ("b", "long-term", "global", "fact"), ("c", "working", "other", "x")], ENTRY)
    rows = [(1, "upsert", "long-term", "a", "new", None), (2, "delete", "working", "a", None, None), (3, "delete", "long-term", "b", None, None), (4, "upsert", "working", "b", "again", None),
            (5, "upsert", "working", "c", "y", None), (6, "upsert", "working", None, " note ", "n1"), (7, "upsert", "working", None, "note", "n2"), (8, "upsert", "working", "zz", "y", None)]
    df = spark.createDataFrame(rows, "change_id int, action string, target string, id string, content string, new_id string")
    kept, rejected = M.apply_memory_changes(entries, df, "t")
    assert {(r.id, r.layer, r.scope, r.content) for r in kept.collect()} == {("a", "long-term", "global", "new"), ("c", "working", "other", "x"), ("n1", "working", "t", " note ")}
    assert {r.change_id: r.reason for r in rejected.collect()} == {2: "not_in_layer", 4: "unknown_id", 5: "other_scope", 8: "unknown_id"}


def test_merge_plans(spark):
    entries = spark.createDataFrame([(s, n, c, o) for s in ("ok", "bad") for n, c, o in [(0, "a", True), (1, "b", False), (2, "a", False), (3, "c", False)]], "scope string, n int, content string, optimized boolean")
    plan = spark.createDataFrame([("ok", 1, "merge", [0, 1], "ab"), ("ok", 2, "delete", [3], None), ("bad", 1, "delete", [0], None)], "scope string, op int, kind string, items array<int>, content string")
    out, problems = M.apply_merge_plan(entries, plan)
    assert [(r.n, r.content, r.optimized) for r in out.filter("scope = 'ok'").collect()] == [(0, "ab", True)]
    assert out.filter("scope = 'bad'").count() == 4 and [(r.scope, r.problem) for r in problems.collect()] == [("bad", "delete_processed")]


def test_quotes_must_come_from_their_own_question(spark):
    contexts = spark.createDataFrame([("r", 1, 1, "c1", "Высота площадки  1.25 м."), ("r", 2, 1, "c2", "Ширина балки 0.35 м.")], "request_id string, number int, rank int, chunk_id string, text string")
    cites = spark.createDataFrame([("r", 1, 1, "Ширина балки 0.35 м."), ("r", 2, 1, "Ширина балки 0.35 м."), ("r", 2, 2, "балки"), ("r", 1, 2, "Высота площадки 1.25")], "request_id string, number int, seq int, quote string")
    got = {(r.number, r.seq): r.chunk_id for r in Q.quote_support(cites, contexts).collect()}
    assert got == {(1, 1): None, (2, 1): "c2", (2, 2): None, (1, 2): "c1"}


PARAM = "element_id long, source string, owner_id long, parameter_id long, name string, display string, converted string, raw string, unit string, data_type string"


def test_snapshot_files_and_diff(spark, tmp_path):
    def snapshot(values):
        return {"snapshot": {"elements": [{"elementId": e, "instanceParameters": [
            {"parameterId": p, "name": "Высота", "ownerElementId": e, "displayValue": f"{v} мм", "rawValue": str(v), "status": "ok"}]} for e, p, v in values],
            "relations": [{"kind": "onSheet", "fromId": 1, "toId": 2}]}}

    sides = []
    for name, values in {"a": [(123, 1, 1000), (5, 1, 7)], "b": [(123, 1, 2650), (777, 1, 1)]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(snapshot(values), ensure_ascii=False))
        tables = read_snapshot(spark, str(tmp_path / f"{name}.json"))
        assert tables["relations"].count() == 1
        sides.append(tables["parameters"].select(
            F.col("elementId").alias("element_id"), "source", F.col("ownerElementId").alias("owner_id"), F.col("parameterId").alias("parameter_id"), "name",
            F.col("displayValue").alias("display"), F.col("convertedValue").alias("converted"), F.col("rawValue").alias("raw"), F.col("unitTypeId").alias("unit"), F.col("dataTypeId").alias("data_type")))
    diff = S.snapshot_diff(*sides)
    row = diff.filter("kind = 'changed'").first()
    assert (row.element_id, row.name, row.old, row.new) == (123, "Высота", "1000 мм", "2650 мм")
    assert {(r.element_id, r.change) for r in S.element_changes(diff).collect()} == {(123, "changed"), (777, "added"), (5, "removed")}


def test_equal_shown_values_give_exact_ones(spark):
    a = spark.createDataFrame([(1, "i", 1, 1, "n", "10", None, "10.01", "mm", "d")], PARAM)
    b = spark.createDataFrame([(1, "i", 1, 1, "n", "10", None, "10.02", "mm", "d")], PARAM)
    assert S.snapshot_diff(a, b).first().exact_values == "10.01 → 10.02"


def test_comparison_replaces_earlier_snapshots_of_its_dimension(spark):
    schema = "request int, pos int, is_comparison boolean, is_error boolean, status string, dimension string"
    rows = [(1, 1, False, False, "ok", "3d"), (1, 2, False, False, "ok", "2d"), (1, 3, True, False, "complete", "3d"), (2, 1, False, False, "ok", "3d"), (2, 2, True, True, "complete", "3d")]
    got = S.supersede_snapshots(spark.createDataFrame(rows, schema), ["request"])
    assert sorted((r.request, r.pos) for r in got.collect()) == [(1, 2), (1, 3), (2, 1), (2, 2)]


def test_byte_budget_leaves_stubs(spark):
    rows = spark.createDataFrame([(1, 1, 60, 10), (1, 2, 60, 10), (1, 3, 25, 10), (1, 4, 30, 10)], "k int, pos int, full int, stub int")
    placed = A.pack_bytes(rows, ["k"], "pos", "full", "stub", 100)
    assert [r.placement for r in placed.orderBy("pos").collect()] == ["full", "stub", "full", "omitted"]
    assert A.omitted_counts(placed, ["k"]).first().omitted == 2


def test_rerank_falls_back_as_a_whole(spark):
    cands = spark.createDataFrame([(q, c, q, "h", "some text " * 5) for q in ("good", "down") for c in ("a", "b")], "query_id string, chunk_id string, question string, heading string, text string")

    def scorer(question, texts):
        if question == "down":
            raise TimeoutError
        return [3.0 + i for i in range(len(texts))]

    lexical = cands.select("query_id", "chunk_id", F.lit(0.5).alias("rerank"))
    rows = scoring.rerank_or_fallback(scoring.rerank(cands, scorer, "m"), lexical).collect()
    assert {(r.query_id, r.mode) for r in rows} == {("good", "cross_encoder:m"), ("down", "lexical_fallback:reranker_unavailable")}
    assert all(r.rerank == 0.5 and r.reason == "reranker_TimeoutError" for r in rows if r.query_id == "down")


def test_index_build_is_published_last(spark, tmp_path):
    path = str(tmp_path / "index")
    one = spark.createDataFrame([(1,)], "id int")
    write_index({"fixed": one}, path, "b1")
    one.selectExpr("id + 1 AS id").write.parquet(f"{path}/fixed/build_id=b2")  # never finished
    assert read_index(spark, path, "fixed").first().id == 1


def test_index_stream_encodes_equal_inputs_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "один текст"), (2, "другой текст")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    docs.withColumn("doc_id", F.col("doc_id") + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = stream_index(file_stream(spark, str(tmp_path / "in"), "*.parquet"), str(tmp_path / "index"))
    assert out.count() == 4 and out.filter("embedding IS NULL").count() == 0
    assert spark.read.parquet(str(tmp_path / "index/vectors")).count() == 2


def test_a_table_of_one_file_or_a_folder_streams_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    docs.repartition(4).write.parquet(str(tmp_path / "many/documents.parquet"))
    for folder in (tmp_path, tmp_path / "many"):
        out = QUERIES["index_stream"](spark, str(folder))
        assert sorted(r.doc_id for r in out.collect()) == list(range(8)) and out.filter("NOT encoded").isEmpty()


def test_media_kinds(spark):
    data = [("p", bytearray([137, 80, 78, 71, 1])), ("j", bytearray([255, 216, 255, 0])), ("w", bytearray(b"RIFF0000WEBPx")), ("t", bytearray(b"text"))]
    rows = media_inventory(spark.createDataFrame(data, "n string, content binary")).collect()
    assert {r.n: r.mime for r in rows} == {"p": "image/png", "j": "image/jpeg", "w": "image/webp", "t": None}


def test_late_rows_are_counted_over_micro_batches(spark, tmp_path):
    from lodestone.streaming.common import use_rocksdb
    from lodestone.streaming.stateful import LateCount, late_rows, rate_limit_stream

    path = str(tmp_path / "in")
    schema = "user string, ts timestamp, event_id int"
    at = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc)
    batches = [[("a", at(s), s) for s in (0, 1, 2, 59, 60, 500)] + [("b", at(490), 490)], [("a", at(501), 501)],
               [("a", at(s), 1000 + s) for s in (3, 100, 439, 502, 560)] + [("b", at(10), 1010), ("c", at(441), 1441)],
               [("a", at(570), 2570), ("c", at(20), 2020)]]
    for rows in batches:  # the file stream takes the files by age
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    use_rocksdb(spark)
    counter = LateCount()
    spark.streams.addListener(counter)
    try:
        out = drain(rate_limit_stream(file_stream(spark, path, "*.parquet"), "user", 2, 60), name="late")
        decided = {(r.key, r.event_id): (r.window_start - 1_700_000_000, r.allowed, r.retry_after) for r in out.collect()}
        late = {(r.user, r.event_id) for r in late_rows(spark.read.schema(schema).parquet(path), out, "user").collect()}
        # Late is what lies a window or more behind the newest row of the batch before last.
        assert late == {("a", 1003), ("a", 1100), ("a", 1439), ("b", 1010), ("c", 2020)}
        assert decided["a", 2] == (0, False, 58) and decided["a", 60] == (60, True, None) and decided["a", 500] == (500, True, None)
        assert decided["a", 501] == (500, True, None) and decided["a", 1502] == (500, False, 58) and decided["a", 1560] == (560, True, None)
        assert decided["a", 2570] == (560, True, None) and decided["c", 1441] == (441, True, None) and len(decided) + len(late) == sum(map(len, batches))
        wait = time.time() + 20
        while counter.late != len(late) and time.time() < wait:
            time.sleep(0.2)
        assert counter.late == len(late) and counter.read == sum(map(len, batches))
    finally:
        spark.streams.removeListener(counter)


def test_a_burst_keeps_its_first_rows(spark):
    """One key with a third of all rows in one window; events of one time go by their number."""
    from lodestone.operators.tasks import rate_limit

    at = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc)
    rows = [("hot", at(i // 500), i) for i in range(5000)] + [(f"k{i % 100}", at(i), 10_000 + i) for i in range(5000)]
    found = rate_limit(spark.createDataFrame(rows, "user string, ts timestamp, event_id int").repartition(4), "user", "ts", "event_id").collect()
    hot = {r.event_id: (r.allowed, r.retry_after) for r in found if r.user == "hot"}
    assert [i for i, v in sorted(hot.items()) if v[0]] == list(range(6)) and hot[4999] == (False, 51)
    assert len(found) == len(rows) and all(r.allowed for r in found if r.user != "hot")


def sequential(entries, plan, scope):
    """The rule itself: one change after the other on one state."""
    state, problems = {e[0]: list(e[1:4]) for e in entries}, {}
    for change, action, target, key, content, new in sorted(plan):
        to = "global" if target == "long-term" else scope
        blank = not (content or "").strip()
        if target not in M.LAYERS:
            problems[change] = "bad_target"
        elif key is None:
            if action not in ("upsert", "delete"):
                problems[change] = "bad_action"
            elif action == "delete":
                problems[change] = "not_in_layer"
            elif blank:
                problems[change] = "blank_content"
            elif not any((layer, s, c.strip()) == (target, to, content.strip()) for layer, s, c in state.values()):
                state[new] = [target, to, content]
        elif key not in state:
            problems[change] = "unknown_id"
        elif state[key][1] not in ("global", scope):
            problems[change] = "other_scope"
        elif action == "delete":
            if state[key][0] == target:
                del state[key]
            else:
                problems[change] = "not_in_layer"
        elif action != "upsert":
            problems[change] = "bad_action"
        elif blank:
            problems[change] = "blank_content"
        else:
            state[key] = [target, to, content]
    return {k: tuple(v) for k, v in state.items()}, problems


def test_chained_changes_equal_one_after_the_other(spark):
    import random

    schema = "id string, layer string, scope string, content string, origin string"
    steps = "change_id long, action string, target string, id string, content string, new_id string"

    def check(entries, plan):
        kept, rejected = M.apply_memory_changes(spark.createDataFrame([(*e, "o") for e in entries], schema).repartition(2), spark.createDataFrame(plan, steps).repartition(3), "t")
        state, problems = sequential(entries, plan, "t")
        rows = kept.collect()
        assert {r.id: (r.layer, r.scope, r.content) for r in rows} == state and len(rows) == len(state)
        assert {r.change_id: r.reason for r in rejected.collect()} == problems
        assert all((r.origin == "o") == any(r.id == e[0] for e in entries) for r in rows)

    # A new fact that is changed, deleted and asked for again; one that waits for the place of another new one.
    check([("s", "working", "t", "old")], [
        (1, "upsert", "working", None, "x", "n1"), (2, "upsert", "working", None, " x ", "n2"), (3, "upsert", "long-term", "n1", "y", None),
        (4, "upsert", "working", None, "x", "n3"), (5, "upsert", "long-term", None, "y", "n4"), (6, "delete", "long-term", "n1", None, None),
        (7, "upsert", "long-term", None, "y", "n5"), (8, "delete", "working", "n2", None, None), (9, "upsert", "working", "n9", "z", None), (10, "upsert", "working", None, "z", "n9"),
        (11, "upsert", "working", "s", "x2", None), (12, "upsert", "working", None, "old", "n6"), (13, "upsert", "working", None, "x2", "n7")])
    pick = random.Random(6)
    for entries_n, plan_n in ((6, 120), (0, 60)):
        entries = [(f"e{i}", pick.choice(M.LAYERS), pick.choice(["t", "global", "other"]), pick.choice("abc ")) for i in range(entries_n)]
        ids = [e[0] for e in entries] + [f"n{i}" for i in range(plan_n)] + ["nobody"]
        plan = [(i, pick.choice(["upsert"] * 5 + ["delete"] * 4 + ["noop", None]), pick.choice([*M.LAYERS, "working", "working", "elsewhere"]),
                 pick.choice([None, None, pick.choice(ids[: entries_n + i + 1])]), pick.choice(["a", " a", "b", "c", " ", None]), f"n{i}") for i in range(plan_n)]
        check(entries, plan)
    check([("s", "working", "t", "old")], [(1, "delete", "working", "s", None, None)])
    empty = spark.createDataFrame([], steps)
    assert M.apply_memory_changes(spark.createDataFrame([("s", "working", "t", "old", "o")], schema), empty, "t")[0].count() == 1


def test_evidence_lines_are_not_broadcast(spark, capsys):
    refs = spark.createDataFrame([(1, 1, 2), (1, 1, 9)], "request_id long, number int, line int")
    out = Q.resolve_evidence_ids(refs, spark.createDataFrame([(1, 1, 2, "q")], "request_id long, number int, line int, quote string"))
    assert {(r.line, r.quote, r.valid) for r in out.collect()} == {(2, "q", True), (9, None, False)}
    out.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_properties_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "ELEMENT_ROWS", 10)
    elements = spark.range(200).selectExpr("id AS element_id", "-1 - id % 3 AS type_id", "IF(id % 2 = 0, 'a', 'b') AS class", "'c' AS category").coalesce(1)
    requests = spark.createDataFrame([("c", "size", 1, "a", "LEN", "instance", "parameter"), ("c", "size", 2, None, "LEN", "instanceThenType", "parameter")],
                                     "category string, key string, place int, class_filter string, identifier string, source string, method string")
    values = spark.range(-4, 200).filter("id < 0 OR id % 5 = 0").selectExpr(
        "id AS owner_id", "'LEN' AS identifier", "CAST(NULL AS DOUBLE) AS number", "CONCAT('t', id) AS text", "CAST(NULL AS STRING) AS spec")
    out = S.resolve_properties(elements, requests, values)
    got = {r.element_id: (r.origin, r.status, r.text) for r in out.collect()}
    assert len(got) == 200
    assert got[0] == ("instance", "ok", "t0") and got[2] == ("instance", "missing", None) and got[5] == ("instance", "ok", "t5") and got[1] == ("type", "ok", "t-2")
    assert "RoundRobinPartitioning(20)" in out._jdf.queryExecution().toString()


def test_rate_windows_of_many_keys_share_state_rows(spark, tmp_path):
    from lodestone.operators.tasks import rate_limit
    from lodestone.streaming.stateful import LateCount, rate_limit_stream
    from lodestone.streaming.common import use_rocksdb

    class Kept(LateCount):
        rows = []

        def onQueryProgress(self, event):
            self.rows += [op.numRowsTotal for op in event.progress.stateOperators]

    at = lambda s: dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc)
    rows = [(None if k == 5 else k, at(s + k % 7), k * 100 + s) for k in range(60) for s in (0, 1, 2, 59, 61, 130)] + [(7, at(300), None)]
    events = spark.createDataFrame(rows, "user long, ts timestamp, event_id int")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    use_rocksdb(spark)
    counter = Kept()
    spark.streams.addListener(counter)
    out = drain(rate_limit_stream(file_stream(spark, str(tmp_path / "in"), "*.parquet"), "user", 2, 60, buckets=4), name="many")
    got = sorted(map(tuple, out.select("key", "event_id", "window_start", "allowed", "retry_after").collect()), key=str)
    wait = time.time() + 20
    while not counter.rows and time.time() < wait:
        time.sleep(0.2)
    spark.streams.removeListener(counter)
    assert counter.rows and max(counter.rows) <= 16  # four buckets with their timers, not sixty keys
    want = rate_limit(events.filter("event_id IS NOT NULL AND user IS NOT NULL"), "user", "ts", "event_id", 2, 60)
    want = {tuple(r) for r in want.select("user", "event_id", "window_start", "allowed", "retry_after").collect()}
    assert {r for r in got if r[0] is not None and r[1] is not None} == want and len(got) == len(rows)
    assert (7, None, 1_700_000_300, True, None) in got and sum(r[0] is None for r in got) == 6
