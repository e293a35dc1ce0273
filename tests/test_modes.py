"""Questions of both modes in one search, failing models, matched terms, and retrieval per listed question."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval as R
from lodestone.plans import hybrid as P

CHUNK = "chunk_id string, text string, embedding array<double>, family_names array<string>, section string, owner_id string, kind string, conflict boolean"
FIELDS = ("rerank", "mode", "reason", "selected", "position", "passage", "reranker_error", "matched_terms")


def unit(score):
    return [score, math.sqrt(1 - score * score)]


def words(question, texts):
    """Shared words, well above and below the floor of a model's scores."""
    asked = set(question.lower().split())
    return [4.0 * sum(w in asked for w in t.lower().split()) - 6 for t in texts]


def broken(question, texts):
    if "beam" in question:
        raise TimeoutError("down")
    return words(question, texts)


def short(question, texts):
    return [1.0] * (len(texts) - 1)


MODELS = {"words": words, "broken": broken, "short": short}
TEXTS = ["landing rests on wall", "beam holds reinforcement bars", "wall of bricks", "bars for beam and landing", "roof tiles", "", "beam beam beam landing wall"]


@pytest.fixture(scope="module")
def chunks(spark):
    made = [(f"c{i}", t, unit(0.9 - 0.08 * i), [f"N_{i % 3}"], f"part {i % 2}", f"o{i % 3}", "family_card" if i % 2 else "block", i == 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(made, CHUNK).repartition(2)


def asked(spark, rows):
    return spark.createDataFrame([(k, t, m, unit(0.95)) for k, t, m in rows], "query_id string, text string, model string, embedding array<double>")


def outcome(hits):
    return {(r.query_id, r.chunk_id): tuple(r[f] for f in FIELDS) for r in hits.collect()}


def test_mixed_modes_equal_each_apart(spark, chunks):
    full = chunks.filter("text <> ''")
    rows = [("lex", "landing on wall", None), ("sem", "landing on wall", "words"), ("ok", "landing wall", "broken"), ("down", "beam bars", "broken"),
            ("none", "roof tiles", "nowhere"), ("half", "bars", "short")]
    together = outcome(P.hybrid_search(asked(spark, rows), full, models=MODELS))
    apart = {}
    for part in (rows[:1], rows[1:3], rows[3:]):
        apart |= outcome(P.hybrid_search(asked(spark, part), full, models=MODELS))
    assert together == apart and len({k for k, _ in together}) == len(rows)
    modes = {k: {v[1] for (q, _), v in together.items() if q == k} for k, *_ in rows}
    fallback = {"lexical_fallback:reranker_unavailable"}
    assert modes == {"lex": {"lexical_fallback"}, "sem": {"cross_encoder:words"}, "ok": {"cross_encoder:broken"}, "down": fallback, "none": fallback, "half": fallback}
    why = {k: {v[6] for (q, _), v in together.items() if q == k} for k, *_ in rows}
    assert why == {"lex": {None}, "sem": {None}, "ok": {None}, "down": {"reranker_TimeoutError"}, "none": {"reranker_unknown_model"}, "half": {"reranker_ValueError"}}
    # The lexical score of a failed question is that of a search without models.
    plain = outcome(P.hybrid_search(asked(spark, [("down", "beam bars", None)]), full))
    assert {k: (v[0], v[2], v[3]) for k, v in plain.items()} == {k: (v[0], v[2], v[3]) for k, v in together.items() if k[0] == "down"}
    # A model's scores are judged by its own floor: no shared word is -6, under it; all else passes, whatever the cosine.
    sem = {c: v for (q, c), v in together.items() if q == "sem"}
    assert sem["c0"][0] == 6.0 and sem["c0"][5].endswith("landing rests on wall") and sem["c1"][2] == "threshold" and sem["c4"][2] == "source_conflict"


def test_chunk_without_passage_means_fallback(spark, chunks):
    hits = P.hybrid_search(asked(spark, [("q", "landing", "words")]), chunks, models=MODELS).collect()
    assert {(r.mode, r.reranker_error) for r in hits} == {("lexical_fallback:reranker_unavailable", "reranker_missing")} and all(r.rerank is not None for r in hits)


def test_cutoffs_follow_the_mode(spark):
    rows = [("s", f"c{i}", 0.9, s, 1.0, False, False, "cross_encoder:x") for i, s in enumerate([9.0, 8.0, 7.5, 5.0, 1.0, -9.0])]
    rows += [("l", f"c{i}", s, 0.1, 0.0, False, False, "lexical_fallback") for i, s in enumerate([0.9, 0.89, 0.88, 0.6, 0.3])]
    rows += [("f", "c0", 0.1, -9.0, 0.0, False, False, "cross_encoder:x"), ("g", "c0", 0.1, 9.0, 0.0, False, False, "lexical_fallback:reranker_unavailable")]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, similarity double, rerank double, lexical double, exact boolean, conflict boolean, mode string")
    cut = {r.query_id: r.cutoff for r in R.gap_cutoff(hits).collect()}
    assert cut == {"s": 7.5, "l": 0.88, "f": -2.5, "g": 0.25}
    assert {r.query_id: r.cutoff for r in R.gap_cutoff(hits, semantic_floor=-20.0).collect()}["f"] == -20.0
    reasons = {(r.query_id, r.chunk_id): r.reason for r in R.reject_reason(hits, R.gap_cutoff(hits)).collect()}
    assert [reasons["s", f"c{i}"] for i in range(6)] == [None, None, None, "threshold", "threshold", "threshold"]
    assert reasons["f", "c0"] == "threshold" and reasons["g", "c0"] == "threshold"


def test_matched_terms(spark, chunks):
    hits = {r.chunk_id: r.matched_terms for r in P.hybrid_search(asked(spark, [("q", "Bars, landing? n_1 bars beam", None)]), chunks).collect()}
    assert hits["c3"] == ["bars", "landing", "beam"] and hits["c4"][-1:] == ["n_1"] and hits["c5"] == [] and hits["c1"] == ["bars", "n_1", "beam"]


def test_listed_questions_keep_their_hits(spark, chunks):
    messages = spark.createDataFrame([(1, "1. landing wall? 2. beam bars! 3. roof tiles", None), (2, "one question", "words"), (3, "1. wall? 3. gap", None)],
                                     "message_id long, text string, model string")
    encode = lambda rows: rows.select("query_id", F.lit(unit(0.95)).cast("array<double>").alias("embedding"))
    contexts, hits = P.multi_question_search(messages, chunks.filter("text <> ''"), encode, 2, MODELS)
    rows = {(r.message_id, r.number): r for r in contexts.collect()}
    assert {k: r.question for k, r in rows.items()} == {(1, 1): "landing wall?", (1, 2): "beam bars!", (1, 3): "roof tiles", (2, 1): "one question", (3, 1): "1. wall? 3. gap"}
    assert all(r.n_scanned == 6 and len(r.context) <= 2 and [h.position for h in r.context] == list(range(1, len(r.context) + 1)) for r in rows.values())
    selected = {(r.query_id, r.chunk_id) for r in hits.filter("selected").collect()}
    assert selected == {(r.query_id, h.chunk_id) for r in rows.values() for h in r.context}
    # Each question alone finds the same.
    alone = P.hybrid_search(asked(spark, [("1#2", "beam bars!", None)]), chunks.filter("text <> ''"), 2).filter("selected").collect()
    assert [(h.chunk_id, h.rerank) for h in rows[1, 2].context] == [(r.chunk_id, r.rerank) for r in sorted(alone, key=lambda r: r.position)]
    sources = P.message_sources(contexts).orderBy("message_id", "place").collect()
    first = [(r.number, r.position, r.chunk_id) for r in sources if r.message_id == 1]
    assert first == [(n, h.position, h.chunk_id) for n in (1, 2, 3) for h in rows[1, n].context] and [r.place for r in sources if r.message_id == 1] == list(range(1, len(first) + 1))
    seen = set()
    for number, _, chunk in first:
        assert next(r.repeated for r in sources if (r.message_id, r.number, r.chunk_id) == (1, number, chunk)) == (chunk in {c for n, c in seen if n < number})
        seen.add((number, chunk))


def test_questions_without_chunks(spark, chunks):
    messages = spark.createDataFrame([(1, "1. landing? 2. beam?")], "message_id long, text string")
    encode = lambda rows: rows.select("query_id", F.lit(unit(0.95)).cast("array<double>").alias("embedding"))
    contexts, _ = P.multi_question_search(messages, chunks.limit(0), encode)
    assert sorted((r.number, r.n_scanned, r.n_candidates, r.context) for r in contexts.collect()) == [(1, 0, 0, []), (2, 0, 0, [])]
    assert P.multi_question_search(messages.limit(0), chunks, encode)[0].count() == 0
