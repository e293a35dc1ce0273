"""What keeps shuffles in proportion: narrow packs, shingles ordered in place, vectors encoded where a text lies."""

from pyspark.sql import functions as F

from lodestone.functions.text import search_tokens
from lodestone.functions.vectors import hashing_slots, hashing_vectors
from lodestone.operators import chunking as C, context as A, dedup, lexical as L, retrieval as R, scoring
from lodestone.operators.dedup import near_duplicates, shingles, signatures
from lodestone.session import cut_lineage


def shuffles(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_packs_of_blocks_without_texts_link_like_those_with(spark):
    rows = [(d, i, f"block {i}", 1 + (i * 7 + d) % 9) for d in range(3) for i in range(40)]
    blocks = spark.createDataFrame(rows, "source int, ordinal int, text string, token_count int")

    def packs(some, size):
        packed = C.pack_texts(C.pack_blocks(some, ["source"], size), ["source"])
        return packed.select("source", F.col("pack").cast("string").alias("chunk_id"), "block_ordinals")

    def linked(some):
        return sorted(map(tuple, C.link_parents(packs(some, 12), packs(some, 30)).select("source", "chunk_id", "parent_id").collect()), key=str)

    assert "text" not in C.pack_texts(C.pack_blocks(blocks.drop("text"), ["source"], 12), ["source"]).columns
    assert linked(blocks.drop("text")) == linked(blocks)


def test_shingles_are_ordered_from_rare_to_common_without_a_shuffle(spark):
    common = " ".join(f"base{i}" for i in range(20))
    rows = [(i, f"{common} " + " ".join(f"own{i}x{j}" for j in range(20))) for i in range(40)] + [(40, None), (41, ""), (42, "one two")]
    docs = spark.createDataFrame(rows, "id int, text string").withColumn("t", search_tokens(F.col("text")))
    signed = signatures(docs, "id", "t")
    assert shuffles(signed) == 0
    plain = {r.id: r.s for r in docs.select("id", shingles(F.col("t")).alias("s")).collect()}
    found = {r.id: r["_sh"] for r in signed.collect()}
    often = set.intersection(*[set(plain[i]) for i in range(40)])
    assert len(often) == 18 and all(sorted(found[i]) == sorted(plain[i] or []) for i in range(43))
    assert all(set(found[i][-18:]) == often for i in range(40))
    tails = {tuple(found[i][-18:]) for i in range(40)}
    assert len(tails) == 1


def test_near_duplicates_by_heads_of_sets(spark):
    words = [f"word{a}{b}" for a in "bcdfgh" for b in "klmnprstvz"]
    texts = {1: words, 2: words[:-1], 3: words[::-1], 4: words, 5: words[:30], 6: words[:-2] + ["zeta", "theta"], 7: ["7", *words], 8: words[:5]}
    docs = spark.createDataFrame([(i, "en", " ".join(t)) for i, t in texts.items()], "id int, lang string, text string")
    signed = signatures(docs.withColumn("t", search_tokens(F.col("text"))), "id", "t")
    out = {r.id: r.duplicate for r in near_duplicates(docs, ["lang"], "id", [], signed).collect()}
    assert out == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False}


def test_vectors_travel_once_and_equal_the_slots(spark):
    rows = [(1, "alpha beta beta part_of_it"), (2, ""), (3, None), (4, "ёлка елка " * 30)]
    texts = spark.createDataFrame(rows, "id long, text string")
    vectors = hashing_vectors(texts, "id", F.col("text"))
    assert vectors._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    slots = {(r.id, r.slot): r.n for r in hashing_slots(texts, "id", F.col("text")).collect()}
    found = {r.id: r.embedding for r in vectors.collect()}
    assert found == {i: [float(slots.get((i, s), 0)) for s in range(64)] for i, _ in rows}


def test_a_question_reads_texts_up_to_its_first_fits(spark, monkeypatch):
    filler = "plain words without the wanted ones " * 100
    rows = [("q", f"c{i:03}", i, i < 2, "selected" if i < 2 else "family_limit", f"g{i}", False, f"{filler} c{i}", "s", "wanted words") for i in range(300)]
    rows += [("r", f"c{i:03}", i, True, "selected", "g", False, filler if i < 20 else "short", "s " * 200 if i < 20 else "s", "wanted words") for i in range(30)]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, place int, selected boolean, reason string, group_key string, exact boolean, text string, section string, question string")
    cut, read = A.best_excerpt, []
    monkeypatch.setattr(A, "best_excerpt", lambda pairs, *a, **b: read.append(pairs.count()) or cut(pairs, *a, **b))
    got = {(r.query_id, r.chunk_id): r.verdict for r in A.pack_local(hits, 160, 3).collect()}
    assert sum(read) <= 60
    apart = A.pack_local(hits.withColumn("chunk_id", F.concat("query_id", "chunk_id")).drop("text"), 160, 3, texts=hits.select(F.concat("query_id", "chunk_id").alias("chunk_id"), "text"))
    assert {(r.query_id, r.chunk_id[1:]): r.verdict for r in apart.collect()} == got
    assert got["q", "c000"] == "selected_excerpt" and all(got["q", f"c{i:03}"] != "selected" for i in range(300))
    assert all(got["r", f"c{i:03}"] == "token_budget" for i in range(20)) and got["r", "c020"] == got["r", "c021"] == "selected"
    assert all(got["r", f"c{i:03}"] == "family_limit" for i in range(22, 30))


def test_passages_are_cut_once_for_all_questions(spark, monkeypatch):
    texts = spark.createDataFrame([(i, "h", f"word{i} " * (350 + i)) for i in range(5)] + [(9, "h", " ")], "chunk_id int, heading string, text string")
    pairs = spark.createDataFrame([(q, c, f"asks {q}") for q in "abcdefgh" for c in (0, 1, 2, 3, 4, 9)], "query_id string, chunk_id int, question string")
    cut, read = scoring.passages, []
    monkeypatch.setattr(scoring, "passages", lambda rows, *a, **b: read.append(rows.count()) or cut(rows, *a, **b))

    def scorer(question, found):
        if question == "asks c":
            raise TimeoutError("down")
        return [float(len(question) + len(t)) for t in found]

    def ranked(cands, **more):
        return sorted(map(tuple, scoring.rerank(cands, scorer, "m", **more).select("query_id", "chunk_id", "rerank", "passage", "mode", "_error").collect()), key=str)

    apart = ranked(pairs, texts=texts)
    assert read == [6] and len(apart) == 48 and apart == ranked(pairs.join(texts, "chunk_id"))


def test_scores_are_ordered_where_wanted_only_and_rank_as_among_all(spark, monkeypatch):
    rows = [(q, c, round(((c * 7919 + q * 31) % 1000) / 50, 6)) for q in range(4) for c in range(1500)]
    scores = cut_lineage(spark.createDataFrame(rows, "query_id int, chunk_id int, lexical double"))
    wanted = scores.filter("(query_id < 3 AND chunk_id % 400 = 3) OR (query_id = 3)").select("query_id", "chunk_id")
    monkeypatch.setattr(R, "WHOLE", 1000)
    plain = {(r.query_id, r.chunk_id): (r.lexical, r.lexical_rank) for r in R.lexical_ranks(scores).collect()}
    got = {(r.query_id, r.chunk_id): (r.lexical, r.lexical_rank) for r in R.ranked_words(scores, wanted).collect()}
    assert got.items() <= plain.items() and len(got) < 3000
    best = {k for k, v in plain.items() if v[1] <= 40} | {(r.query_id, r.chunk_id) for r in wanted.collect()}
    assert best & set(plain) <= set(got)


def test_only_asked_terms_are_kept_and_places_stay(spark):
    terms = spark.createDataFrame([(1, "alpha"), (1, "gamma"), (2, "alpha")], "query_id int, term string")
    rows = [(1, ["alpha", "beta", "gamma", "alpha"], 4), (2, [], 0), (3, None, None), (4, ["beta"], 1)]
    tokens = spark.createDataFrame(rows, "chunk_id int, tokens array<string>, length int")
    kept = {r.chunk_id: (r.tokens, r.length) for r in L.asked_tokens(tokens, terms).collect()}
    assert kept == {1: (["alpha", "gamma", "alpha"], 4), 2: ([], 0), 3: (None, None), 4: ([], 1)}
    placed = {r.chunk_id: r.tokens for r in L.asked_tokens(tokens, terms, placed=True).collect()}
    assert placed == {1: ["alpha", None, "gamma", "alpha"], 2: [], 3: None, 4: [None]}


def test_texts_of_many_groups_are_compared_once(spark, monkeypatch):
    words = [f"word{a}{b}" for a in "bcdfgh" for b in "klmnprstvz"]
    docs = spark.createDataFrame([(i, " ".join([*words[i % 2 :], f"own{chr(97 + i)}x"])) for i in range(10)], "id int, text string").withColumn("t", search_tokens(F.col("text")))
    write, sets = dedup.cut_lineage, []

    def seen(df):
        out = write(df)
        sets.extend([out.count()] if "_sh" in df.columns else [])
        return out

    monkeypatch.setattr(dedup, "cut_lineage", seen)
    signed = signatures(docs, "id", "t")
    assert not sets
    rows = docs.select("id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("q"))
    out = near_duplicates(rows, ["q"], "id", [], signed).collect()
    assert sets == [10] and len(out) == 80 and sum(r.duplicate for r in out) == 72
