"""Memory layers: dedup, change routing and application, merge plans, moves, rules, scopes.

Entries: id, layer ('short-term', 'working', 'long-term'), scope, content, plus any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions.text import describe, strip
from lodestone.operators.scans import first_rows, previous, running
from lodestone.session import cut_lineage

UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
LAYERS = ("short-term", "working", "long-term")


def _blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c)), F.lit("")) == ""


def dedup_memory(entries: DataFrame, order: str) -> DataFrame:
    """First entry of equal trimmed content per layer and scope."""
    keyed = entries.withColumn("_c", strip(F.col("content")))
    return first_rows(keyed, ["layer", "scope", "_c"], [order]).drop("_c")


def route_changes(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """Add route: apply, pending or error, with a reason.

    changes: change_id, action, target, id, content, confidence. High and medium confidence apply; anything
    else waits; an uncertain delete waits as an upsert of the stored content.
    """
    known = entries.select(F.col("id").alias("id"), F.col("content").alias("_stored"))
    with_id = changes.filter("id IS NOT NULL").join(known, "id", "left")
    without = changes.filter("id IS NULL").withColumn("_stored", F.lit(None).cast("string"))
    rows = with_id.unionByName(without)
    unsure = ~F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("target").isin("working", "long-term"), F.lit(False)), "bad_target")
        .when(~F.coalesce(F.col("action").isin("upsert", "delete"), F.lit(False)), "bad_action")
        .when((F.col("action") == "upsert") & _blank("content"), "blank_content")
        .when(unsure & (F.col("action") == "delete") & F.col("_stored").isNull(), "unknown_id")
    )
    turned = unsure & (F.col("action") == "delete") & reason.isNull()
    return rows.select(
        "change_id", "target", "id", F.when(turned, "upsert").otherwise(F.col("action")).alias("action"),
        F.when(turned, F.col("_stored")).otherwise(F.col("content")).alias("content"),
        F.when(reason.isNotNull(), "error").when(unsure, "pending").otherwise("apply").alias("route"), reason.alias("reason"))


def apply_memory_changes(entries: DataFrame, changes: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Entries after ordered changes of one scope, and the rejected changes with a reason.

    changes: change_id (order, unique, a number), action, target, id (null = new), content, new_id. A change may name the new_id of
    an earlier new fact of the batch. A new fact equal to one that is held just then is dropped without a reason.

    Changes of one id depend on each other only: its last accepted place is a running value, and the first accepted delete
    ends it. That gives the times during which an id holds a (layer, scope, content). Ids meet where new facts ask whether
    theirs is held: running counts of open times over (key, time) answer for all facts at once. A fact is decided when a
    sure holder is open or no unsure one is; each round decides at least the earliest fact of all that are left.
    """
    order, kind = "change_id", dict(changes.dtypes)["change_id"]
    target_scope = F.when(F.col("target") == "long-term", "global").otherwise(F.lit(scope))
    bad = (
        F.when(~F.coalesce(F.col("target").isin(*LAYERS), F.lit(False)), "bad_target")
        .when(~F.coalesce(F.col("action").isin("upsert", "delete"), F.lit(False)), "bad_action")
        .when((F.col("action") == "upsert") & _blank("content"), "blank_content"))
    changes = cut_lineage(changes.select("change_id", "action", "target", "id", "content", "new_id", target_scope.alias("_to"), bad.alias("_bad")))
    fresh = changes.filter("id IS NULL")
    asking = fresh.filter("_bad IS NULL AND action = 'upsert'")
    stored = entries.select("id", F.col("layer").alias("_layer"), F.col("scope").alias("_scope"), F.col("content").alias("_held"), F.lit(None).cast(kind).alias("_born"))
    facts = stored.unionByName(asking.select(
        F.col("new_id").alias("id"), F.col("target").alias("_layer"), F.col("_to").alias("_scope"), F.col("content").alias("_held"), F.col("change_id").alias("_born")))
    known = F.col("_layer").isNotNull() & (F.col("_born").isNull() | (F.col("_born") < F.col(order)))
    foreign = ~F.col("_scope").isin("global", scope)
    named = changes.filter("id IS NOT NULL").join(facts, "id", "left").withColumn("_can", F.coalesce(known & ~foreign & F.col("_bad").isNull(), F.lit(False)))
    moves = F.when(F.col("_can") & (F.col("action") == "upsert"), F.col("target"))
    named = running(named, ["id"], [order], {"_at": ("last", moves)})
    hits = F.col("_can") & (F.col("action") == "delete") & (F.coalesce("_at", "_layer") == F.col("target"))
    named = cut_lineage(named.withColumn("_hits", hits))
    ends = named.filter("_hits").groupBy("id").agg(F.min(order).alias("_end"))
    # Times (from, till) during which an id holds a key, if it is there at all.
    live = named.filter("_can AND action = 'upsert'").join(ends, "id", "left").filter(F.col("_end").isNull() | (F.col(order) < F.col("_end")))
    touched = named.filter("_can").select("id").distinct()
    steps = facts.select("id", F.col("_born").alias("_from"), "_layer", "_scope", "_held", "_born").unionByName(live.select(
        "id", F.col(order).alias("_from"), F.col("target").alias("_layer"), F.col("_to").alias("_scope"), F.col("content").alias("_held"), "_born"))
    still = steps.join(touched, "id", "left_anti").withColumn("_till", F.lit(None).cast(kind))
    moved = steps.join(touched, "id", "left_semi").withColumn("_back", F.coalesce(-F.col("_from"), F.lit(1 << 62)))
    moved = previous(moved, ["id"], ["_back"], {"_till": F.col("_from")}).drop("_back").join(ends, "id", "left")
    moved = moved.withColumn("_till", F.coalesce("_till", "_end")).drop("_end")
    times = cut_lineage(still.unionByName(moved).withColumn("_c", strip(F.col("_held"))))
    accepted = _decided(times, asking.select(F.col("new_id").alias("id"), "target", "_to", strip(F.col("content")).alias("_c"), F.col(order).alias("_at")), kind)
    there = accepted.withColumn("_new", F.lit(True))
    state = named.join(ends, "id", "left").join(there, "id", "left")
    absent = F.col("_layer").isNull() | (F.col("_born").isNotNull() & (F.col("_new").isNull() | (F.col("_born") >= F.col(order)))) | (F.col(order) > F.coalesce("_end", F.col(order)))
    reason = (
        F.when(F.col("_bad") == "bad_target", "bad_target").when(absent, "unknown_id").when(foreign, "other_scope")
        .when((F.col("action") == "delete") & ~F.col("_hits"), "not_in_layer").otherwise(F.col("_bad")))
    lost = F.when(F.col("_bad").isNull() & (F.col("action") == "delete"), "not_in_layer").otherwise(F.col("_bad"))
    columns = ("change_id", "id", "action", "target", "reason")
    problems = state.withColumn("reason", reason).select(*columns).unionByName(fresh.withColumn("reason", lost).select(*columns)).filter("reason IS NOT NULL")
    # What an id holds when all changes are over; a stored row that was touched keeps its other columns.
    last = times.filter("_till IS NULL")
    gone = ends.join(times.filter("_born IS NULL").select("id").distinct(), "id", "left_semi").select("id")
    changed = last.filter("_born IS NULL AND _from IS NOT NULL").select("id", F.col("_layer").alias("_l"), F.col("_scope").alias("_s"), F.col("_held").alias("_h"))
    kept = entries.join(gone, "id", "left_anti").join(changed, "id", "left").withColumns({
        "layer": F.coalesce("_l", "layer"), "scope": F.coalesce("_s", "scope"), "content": F.coalesce("_h", "content")}).drop("_l", "_s", "_h")
    new = last.filter("_born IS NOT NULL").join(accepted, "id", "left_semi").select("id", F.col("_layer").alias("layer"), F.col("_scope").alias("scope"), F.col("_held").alias("content"))
    return kept.unionByName(new, allowMissingColumns=True), problems


def _decided(times: DataFrame, asking: DataFrame, kind: str) -> DataFrame:
    """(id) of the new facts that nothing equal held when they came.

    times: id, _layer, _scope, _c, _from, _till, _born (null: stored). asking: id, target, _to, _c, _at.
    """
    keys = ["_layer", "_scope", "_c"]
    asks = cut_lineage(asking.select("id", F.col("target").alias("_layer"), F.col("_to").alias("_scope"), "_c", "_at"))
    held = cut_lineage(times.join(asks.select(*keys).distinct(), keys, "left_semi"))
    early = F.lit(-(1 << 62)).cast(kind)
    accepted, left = None, asks
    while not left.isEmpty():
        # A time counts as sure if its id is stored or accepted, as unsure if it is undecided, not at all otherwise.
        sure = held.filter("_born IS NULL")
        sure = sure if accepted is None else sure.unionByName(held.join(accepted, "id", "left_semi"))
        both = sure.withColumn("_sure", F.lit(1)).unionByName(held.join(left.select("id"), "id", "left_semi").withColumn("_sure", F.lit(0)))
        opens = both.select(*keys, F.coalesce("_from", early).alias("_at"), F.lit(1).alias("_d"), "_sure", F.lit(None).cast(dict(asks.dtypes)["id"]).alias("id"))
        shuts = both.filter("_till IS NOT NULL").select(*keys, F.col("_till").alias("_at"), F.lit(-1).alias("_d"), "_sure", F.lit(None).cast(dict(asks.dtypes)["id"]).alias("id"))
        checks = left.select(*keys, "_at", F.lit(0).alias("_d"), F.lit(0).alias("_sure"), "id")
        # A fact's own time opens when it comes, so checks go before what happens at their time.
        events = opens.unionByName(shuts).unionByName(checks).withColumn("_rank", F.abs("_d"))
        counted = running(events, keys, ["_at", "_rank"], {
            "_open": ("sum", F.col("_d") * F.col("_sure")), "_unsure": ("sum", F.col("_d") * (1 - F.col("_sure")))})
        seen = cut_lineage(counted.filter("id IS NOT NULL").select("id", "_open", "_unsure"))
        good = cut_lineage(seen.filter("_open = 0 AND _unsure = 0").select("id"))
        accepted = good if accepted is None else accepted.unionByName(good)
        left = cut_lineage(left.join(seen.filter("_open = 0 AND _unsure > 0").select("id"), "id", "left_semi"))
    return asks.select("id").limit(0) if accepted is None else accepted


def apply_merge_plan(entries: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of every scope after its plan, and the problems that voided plans.

    entries: scope, n, content, optimized. plan: scope, op, kind ('delete' | 'merge'), items, content. Later
    exact copies go first and cannot be named. One bad index or a plan on processed rows only voids all.
    """
    firsts = entries.groupBy("scope", strip(F.col("content")).alias("_c")).agg(F.min("n").alias("n"))
    unique = entries.join(firsts.select("scope", "n"), ["scope", "n"], "left_semi")
    uses = plan.select("scope", "op", "kind", F.posexplode("items").alias("_i", "n"))
    looked = uses.join(unique.select("scope", "n", "optimized"), ["scope", "n"], "left")
    bad_index = looked.filter("optimized IS NULL").select("scope", F.lit("bad_index").alias("problem"))
    twice = uses.groupBy("scope", "n").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("scope", F.lit("index_reused").alias("problem"))
    done = looked.filter("kind = 'delete' AND optimized").select("scope", F.lit("delete_processed").alias("problem"))
    merges = looked.filter("kind = 'merge'").groupBy("scope", "op").agg(F.min("optimized").alias("_all"))
    all_done = merges.filter("_all").select("scope", F.lit("merge_processed").alias("problem"))
    thin = plan.filter((F.col("kind") == "merge") & ((F.size("items") < 2) | _blank("content"))).select("scope", F.lit("bad_merge").alias("problem"))
    problems = bad_index.unionByName(twice).unionByName(done).unionByName(all_done).unionByName(thin).distinct()
    live = uses.join(problems.select("scope").distinct(), "scope", "left_anti")
    dropped = live.filter("kind = 'delete' OR _i > 0").select("scope", "n")
    texts = live.filter("kind = 'merge' AND _i = 0").join(plan.select("scope", "op", strip(F.col("content")).alias("_new")), ["scope", "op"]).select("scope", "n", "_new")
    void = problems.select("scope").distinct().withColumn("_void", F.lit(True))
    marked = entries.join(void, "scope", "left")
    kept = marked.join(firsts.select("scope", "n", F.lit(True).alias("_first")), ["scope", "n"], "left")
    kept = kept.filter(F.col("_void") | F.col("_first")).join(dropped, ["scope", "n"], "left_anti").join(texts, ["scope", "n"], "left")
    out = kept.select("scope", "n", F.coalesce("_new", "content").alias("content"), (F.col("optimized") | F.col("_void").isNull()).alias("optimized"),
                      describe(F.coalesce("_new", "content")).alias("description"))
    return out, problems


def move_memory(entries: DataFrame, moves: DataFrame, current: str) -> DataFrame:
    """Move entries between layers, or delete them (target null): id, source, target.

    A moved entry is global in long-term, else takes the current scope if it was global; it is marked as
    placed by the user. Moves that name another layer than the entry's are ignored.
    """
    named = moves.select("id", F.col("source").alias("layer"), "target", F.lit(True).alias("_m"))
    rows = entries.join(named, ["id", "layer"], "left").filter("_m IS NULL OR target IS NOT NULL")
    moved = F.col("_m").isNotNull() & (F.col("target") != F.col("layer"))
    scope = F.when(F.col("target") == "long-term", "global").when(F.col("scope") == "global", current).otherwise(F.col("scope"))
    return rows.withColumns({
        "scope": F.when(moved, scope).otherwise(F.col("scope")),
        "user_placed": F.col("user_placed") | moved,
        "layer": F.when(moved, F.col("target")).otherwise(F.col("layer")),
    }).drop("target", "_m")


def memory_violations(entries: DataFrame) -> DataFrame:
    """(id, layer, problem) for entries that break a rule."""
    rules = {
        "bad_uuid": ~F.coalesce(F.col("id").rlike(UUID), F.lit(False)), "blank_scope": _blank("scope"), "blank_content": _blank("content"),
        "long_term_not_global": (F.col("layer") == "long-term") & (F.col("scope") != "global"),
        "local_is_global": (F.col("layer") != "long-term") & (F.col("scope") == "global"),
    }
    problems = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    rows = entries.select("id", "layer", F.explode(problems).alias("problem"))
    twice = entries.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min("layer").alias("layer")).filter("_n > 1")
    return rows.unionByName(twice.select("id", "layer", F.lit("duplicate_id").alias("problem")))


def scoped_memory(entries: DataFrame, scopes: DataFrame) -> DataFrame:
    """What each scope sees: its working memory, its dialogue, and global long-term memory. scopes: scope."""
    own = entries.filter((F.col("layer") == "working") | ((F.col("layer") == "short-term") & F.col("role").isin("user", "assistant")))
    own = own.join(scopes.select("scope").distinct(), "scope", "left_semi").withColumn("seen_by", F.col("scope"))
    # Global knowledge is one shared part: it is stored once, under no scope.
    shared = entries.filter("layer = 'long-term' AND scope = 'global'").withColumn("seen_by", F.lit("*"))
    return own.unionByName(shared)
