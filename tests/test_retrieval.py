"""Retrieval rules on synthetic vectors: cosine to the question is given."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import search_tokens
from lodestone.operators import context as A, dedup, retrieval as R
from lodestone.operators.catalog import spec_topk
from lodestone.operators.dedup import near_duplicates, signatures
from lodestone.operators.dense import dense_topk
from lodestone.operators.scoring import embed, word_hash_encoder
from lodestone.plans.hybrid import hybrid_search
from lodestone.session import cut_lineage

CHUNK = "chunk_id string, text string, embedding array<double>, family_names array<string>, section string, owner_id string, kind string, conflict boolean"
FAMILY = "КркНес_ЛПлощадка_Монолитная"


def chunk(name, text, score, names=()):
    return (name, text, [score, math.sqrt(1 - score * score)], list(names), "Раздел", None, "block", False)


def search(spark, chunks, question, limit=None):
    queries = spark.createDataFrame([("q", question, [1.0, 0.0])], "query_id string, text string, embedding array<double>")
    rows = hybrid_search(queries, spark.createDataFrame(chunks, CHUNK), limit).collect()
    return {r.chunk_id: r for r in rows}


def test_named_entity_survives_a_low_cosine(spark):
    many = [chunk(f"semantic{i}", f"Описание постороннего элемента {i}", 0.85 - i * 0.001) for i in range(60)]
    many.append(chunk("exact", f"Инструкция: {FAMILY} устанавливается на опорную грань.", 0.05, [FAMILY]))
    many.append(chunk("partial", f"Другая конструкция {FAMILY}_Другая", 0.04))
    hits = search(spark, many, f"Как установить {FAMILY}?")
    assert hits["exact"].exact and hits["exact"].selected and hits["exact"].in_text
    assert not any(r.exact for k, r in hits.items() if k != "exact")
    assert hits["semantic0"].reason == "different_owner" and len(hits) >= 40


def test_terms_rescue_a_low_cosine(spark):
    hits = search(spark, [chunk("irrelevant", "Общие сведения о конструкциях", 0.95),
                          chunk("instruction", "Фиксатор арматуры: настройте диаметр фиксатора.", 0.08)], "фиксатор арматуры диаметр", 1)
    assert [k for k, r in hits.items() if r.selected] == ["instruction"]


@pytest.mark.parametrize("scores,selected", [((0.8, 0.78, 0.4, 0.2), 2), ((0.9, 0.79, 0.5), 2), ((0.02,), 0)])
def test_gap_and_floor(spark, scores, selected):
    texts = ["Уникальная инструкция размещения", "Другой способ настройки геометрии", "Слабосвязанный текст", "Совсем другое"]
    hits = search(spark, [chunk("abcd"[i], texts[i], s) for i, s in enumerate(scores)], "Что это?")
    assert sum(r.selected for r in hits.values()) == selected


LONG = ("Разместите компонент на рабочей плоскости затем настройте ширину высоту и положение ручек после этого проверьте привязку граней "
        "заполните сведения о материале укажите отметку уровня выберите тип арматуры сохраните вид обновите спецификацию закройте редактор")


def test_copies_go_and_negation_stays(spark):
    hits = search(spark, [chunk("a", LONG, 0.9), chunk("b", LONG.upper(), 0.89), chunk("c", LONG + " далее", 0.88), chunk("d", "Не " + LONG, 0.87)], "Что это?")
    assert {k for k, r in hits.items() if r.selected} == {"a", "d"}
    assert hits["b"].reason == hits["c"].reason == "duplicate"


def jaccard_rule(a, b):
    crit = [[w for w in x if any(c.isdigit() for c in w) or w in ("не", "нельзя", "без")] for x in (a, b)]
    if a == b:
        return True
    if crit[0] != crit[1]:
        return False
    x, y = [{tuple(t[i:i + 3]) for i in range(len(t) - 2)} for t in (a, b)]
    return len(x) >= 10 and len(y) >= 10 and len(x & y) / len(x | y) >= 0.88


def test_greedy_duplicates_equal_a_plain_loop(spark):
    rng = random.Random(11)
    words = [f"w{c}" for c in "абвгдежзиклмнопрст"]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, rng.choice(["hot", "hot", "cold"]), text))
    df = spark.createDataFrame(rows, "id long, g string, t array<string>")
    got = {r.id: r.duplicate for r in near_duplicates(df, ["g"], "id", [], signatures(df, "id", "t")).collect()}
    for g in ("hot", "cold"):
        kept = []
        for i, _, text in [r for r in rows if r[1] == g]:
            repeat = any(jaccard_rule(k, text) for k in kept)
            assert got[i] == repeat, i
            if not repeat:
                kept.append(text)


def test_dense_topk_breaks_ties_by_id(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    c = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "chunk_id int, embedding array<double>")
    assert [r.chunk_id for r in dense_topk(q, c, 3).orderBy("rank").collect()] == [0, 2, 4]
    with pytest.raises(ValueError):
        dense_topk(q, c, 101)


def test_spec_topk_equals_all_pairs(spark):
    rng = random.Random(5)
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    items = [(i, *[rng.choice(["x", "y", "z", None]) for _ in w]) for i in range(80)]
    specs = [(i, *[rng.choice(["x", "y", None]) for _ in w]) for i in range(12)]
    got = spec_topk(spark.createDataFrame(specs, "s int, a string, b string, c string"), spark.createDataFrame(items, "i int, a string, b string, c string"), "s", "i", w)
    found = {(r.s, r["rank"]): r.i for r in got.collect()}
    for s, *sv in specs:
        scored = [(-round(sum(x for x, p, q in zip(w.values(), sv, iv) if p and p == q), 6), i) for i, *iv in items]
        best = [i for score, i in sorted(scored) if score < 0][:3]
        assert [found.get((s, n + 1)) for n in range(len(best))] == best


LOCAL = "query_id string, chunk_id string, place int, selected boolean, reason string, group_key string, exact boolean, text string, section string, question string"


def test_local_budget_cuts_an_excerpt(spark):
    filler = "Обычное предложение наполнителя без нужных слов. " * 180
    rows = [("q", "a", 1, True, "selected", "g", False, filler + "Фиксатор арматуры имеет диаметр двадцать.", "Раздел", "диаметр фиксатора арматуры")]
    hit = A.pack_local(spark.createDataFrame(rows, LOCAL), 1000, 2).first()
    assert hit.verdict == "selected_excerpt" and "Фиксатор арматуры" in hit.excerpt and hit.cost <= 1000


def test_reserves_refill_and_rejected_stay_out(spark):
    costly = ("q", "a", 1, True, "selected", "g1", False, "слово " * 50, "слово " * 60, "вопрос")
    rows = [costly, ("q", "b", 2, False, "family_limit", "g2", False, "Коротко.", "С", "вопрос")]
    rows += [("q", r, 3 + i, False, r, "g3", False, "Коротко.", "С", "вопрос") for i, r in enumerate(["source_conflict", "threshold", "duplicate", "different_owner"])]
    got = {r.chunk_id: r.verdict for r in A.pack_local(spark.createDataFrame(rows, LOCAL), 60, 2).collect()}
    assert got == {"a": "token_budget", "b": "selected", "source_conflict": "source_conflict", "threshold": "threshold", "duplicate": "duplicate", "different_owner": "different_owner"}


def test_group_cap(spark):
    rows = [("q", f"c{i}", i, True, "selected", "g", False, f"Текст {i}.", "С", "вопрос") for i in range(5)]
    got = [r.verdict for r in A.pack_local(spark.createDataFrame(rows, LOCAL), 1000, 3).orderBy("place").collect()]
    assert got == ["selected", "selected", "family_limit", "family_limit", "family_limit"]


def test_rrf_without_lexical_rank(spark):
    row = spark.range(1).select(R.rrf(F.lit(1), F.lit(0)).alias("a"), R.rrf(F.lit(1), F.lit(1)).alias("b")).first()
    assert row.a == round(1 / 61, 9) and row.b == round(2 / 61, 9)
    assert spark.range(1).select(search_tokens(F.lit("и в на")).alias("t")).first().t == []


def test_linked_images_go_first_and_carry_no_score(spark):
    hits = spark.createDataFrame([("q", "t1", "o", 0.9, 1, True, "selected"), ("q", "t2", "o", 0.8, 2, True, "selected"), ("q", "v1", "o", 0.7, 3, False, "family_limit")],
                                 "query_id string, chunk_id string, owner_id string, rerank double, place int, selected boolean, reason string")
    chunks = spark.createDataFrame([("v1", "o", 1, "вид", False), ("v2", "o", 2, "вид", False), ("v3", "o", 3, "разрез", False), ("v4", "o", 4, "план", False), ("x", "p", 1, "чужой", False)],
                                   "chunk_id string, owner_id string, first_ordinal int, visual string, conflict boolean")
    none = spark.createDataFrame([], "query_id string, owner_id string")
    got = {r.chunk_id: (r.selected, r.reason, r.mode) for r in A.linked_evidence(hits, chunks, none, limit=3).collect()}
    linked = "linked_family_visual_evidence"
    assert got == {"v1": (True, linked, "scored"), "v3": (True, linked, "linked_image:no_similarity"), "t1": (True, "selected", "scored"), "t2": (False, "visual_context_limit", "scored")}


def test_encoder_output_is_checked(spark):
    docs = spark.createDataFrame([(i, f"слово {i}") for i in range(40)], "id long, text string")
    rows = embed(docs, "id", "text", word_hash_encoder(8), 8).collect()
    assert len(rows) == 40 and all(len(r.embedding) == 8 and r.embedding[-1] >= 1 for r in rows)
    with pytest.raises(Exception, match="wrong number or size"):
        embed(docs, "id", "text", word_hash_encoder(4), 8).collect()


def test_templates_without_duplicates_take_few_rounds(spark, monkeypatch):
    from lodestone.operators import dedup

    rounds = []
    verified = dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda *a: rounds.append(1) or verified(*a))
    words = [f"w{i}" for i in range(80)]
    texts = [(i, 0, words[:60] + [f"x{i}_{j}" for j in range(20)]) for i in range(300)]
    df = spark.createDataFrame(texts, "id int, g int, t array<string>")
    found = near_duplicates(df, ["g"], "id", [], signatures(df, "id", "t"))
    assert found.filter("duplicate").count() == 0 and len(rounds) <= 2


@pytest.mark.parametrize("n", [2000, 8000])
def test_possible_pairs_of_templates_grow_with_the_rows(spark, n):
    """Letters on one form: shared sentences, and parts of few common words, of very different lengths."""
    pick = random.Random(n)
    form = " ".join(f"form{i}" for i in range(40))
    common = [f"k{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [(i, "g", f"{form} {' '.join(pick.choice(common) for _ in range(pick.choice([20, 30, 60, 90])))} {form[:90]}") for i in range(n)]
    df = spark.createDataFrame(texts, "id long, g string, text string").withColumn("t", search_tokens(F.col("text"))).repartition(4)
    signed = signatures(df, "id", "t")
    rows = df.select("g", "id", F.struct("id").alias("_ord")).join(signed, "id")
    space = ["g", "_crit"]
    members = dedup._shared([*space, "_s", "_room"], dedup._prefix(rows, space, "id"))
    pairs = dedup.possible_pairs(members, members, [*space, "_s", "_room"], ["g"], "id").count()
    assert pairs <= n
    assert near_duplicates(df.filter("id < 500"), ["g"], "id", [], signed).filter("duplicate").count() == 0


def test_written_pairs_are_merged_and_not_broadcast(spark):
    """A row per question and chunk takes a byte or two on disk, so a plain join would send all of them to every executor."""
    flags = {"similarity": F.lit(0.5), "dense_rank": F.lit(1).cast("long"), "lexical": F.lit(0.0), "lexical_rank": F.lit(0).cast("long"),
             "exact": F.lit(True), "in_text": F.lit(True), "rerank": F.lit(0.5), "place": F.lit(1), "selected": F.lit(True), "reason": F.lit("selected"), "owner_id": F.lit("o")}
    pairs = cut_lineage(spark.range(50).select(F.lit(1).cast("long").alias("query_id"), F.col("id").alias("chunk_id"), *[v.alias(k) for k, v in flags.items()]))
    plain = pairs.drop("exact", "in_text", "lexical", "lexical_rank")
    visual = pairs.select("chunk_id", "owner_id", F.col("chunk_id").alias("first_ordinal"), F.lit("v").alias("visual"), F.lit(False).alias("conflict"))
    named = pairs.select("query_id", "owner_id").distinct()
    joined = {
        "candidates": R.candidates(R.rank_channels(plain, pairs), pairs, pairs),
        "linked": A.linked_evidence(pairs, visual, named),
    }
    for name, df in joined.items():
        plan = df._jdf.queryExecution().sparkPlan().toString()
        sides = [line for line in plan.splitlines() if "Join" in line and "query_id" in line and "chunk_id" in line]
        assert sides and all("SortMergeJoin" in line for line in sides if "LeftOuter" in line and "_kept" not in line), (name, sides)
    assert joined["candidates"].count() == 50


def test_a_text_is_searched_once_for_questions_with_the_same_names(spark):
    asked = spark.createDataFrame([(i, f"Как установить {FAMILY}?") for i in range(20)] + [(99, "ничего"), (100, f"{FAMILY} и Другая_Семья")], "query_id long, text string")
    rows = [("named", f"Инструкция: {FAMILY} рядом"), ("silent", "Без имени"), ("other", "Другая_Семья стоит"), ("named", "копия без имени")]
    owner = {"other": ["Другая_Семья"]}
    chunks = spark.createDataFrame([(k, t, owner.get(k, [FAMILY])) for k, t in rows], "chunk_id string, text string, family_names array<string>")
    found = R.exact_entity_match(asked, chunks)
    got = sorted((r.query_id, r.chunk_id, r.in_text) for r in found.collect())
    each = [("named", False), ("named", True), ("silent", False)]
    assert got == sorted([(i, *e) for i in [*range(20), 100] for e in each] + [(100, "other", True)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("regexp") if "regexp" in plan else plan.index("RLIKE"):]
    assert "Aggregate [chunk_id" in before  # the search stands above the distinct chunks and names
