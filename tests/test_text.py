"""Names, tokens, questions and answers on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import messages as M, text as X
from lodestone.functions.vectors import cosine, valid_vector

BEAM = "IFC_Набор_Балка_№2"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_heading_name_leaves_the_parenthesis(spark):
    assert one(spark, X.entity_name(F.col("t")), t=BEAM + " (Ребро жесткости, 2 хомута)") == BEAM
    assert one(spark, X.entity_name(F.col("t")), t="Обычный заголовок") is None


def test_lists_of_names_need_every_part_to_be_a_name(spark):
    assert one(spark, X.entity_names(F.col("t")), t="A_1 / B_2; a_1") == ["A_1", "B_2"]
    assert one(spark, X.entity_names(F.col("t")), t="A_1 / просто") == []


@pytest.mark.parametrize("text,found", [
    (f"Для чего {BEAM}?", True), (BEAM + "z", False), (BEAM + "0", False), ("ifc_набор_балка_№2.", True), (BEAM + ".1", False), ("x" + BEAM, False)])
def test_whole_name_containment(spark, text, found):
    assert one(spark, X.contains_name(F.col("t"), F.col("n")), t=text, n=BEAM) is found


def test_inflected_words_share_tokens(spark):
    a = one(spark, X.search_tokens(F.col("t")), t="лестничными площадками")
    assert a == one(spark, X.search_tokens(F.col("t")), t="лестничная площадка")


def test_negation_numbers_and_identifiers_survive(spark):
    tokens = one(spark, X.search_tokens(F.col("t")), t="не 200 мм " + BEAM)
    assert "не" in tokens and "200" in tokens and tokens[-1].endswith("№2")
    parts = one(spark, X.retrieval_tokens(F.col("t")), t=BEAM)
    assert parts[0].endswith("№2") and "набор" in parts


@pytest.mark.parametrize("text,count", [
    ("1. Про площадку? 2. Про балку? 3. Про арматуру?", 3), ("Просто вопрос", 1), ("Revit 2024. Размер 1.25?", 1),
    ("Вот: 1. Один? 2. Два?", 1), ("1. Один?", 1), ("1. Один? 3. Три?", 1), ("1. Один? 2. ", 1)])
def test_question_lists(spark, text, count):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    rows = M.split_questions(df, "id", "t").orderBy("number").collect()
    assert len(rows) == count
    if count == 3:
        assert [r.question for r in rows] == ["Про площадку?", "Про балку?", "Про арматуру?"]
    else:
        assert rows[0].question == text


def test_declarations(spark):
    df = spark.createDataFrame([(1, "Цель: собрать узел. Ограничение: только бетон! Под узлом дальше понимаем стык.")], "id int, t string")
    rows = M.explicit_declarations(df, ["id"], "t").orderBy("seq").collect()
    assert [(r.category, r.action, r.value) for r in rows] == [
        ("goal", "set", "собрать узел"), ("constraints", "add", "только бетон"), ("terms", "add", "узлом = стык")]


def test_citations_are_dropped_until_the_next_answer(spark):
    text = "✅ 1. Да\n▫️ Цитаты:\n\"q\"\n✅ 2. Нет"
    assert one(spark, M.strip_citations(F.col("t")), t=text) == "✅ 1. Да\n✅ 2. Нет"


def test_secrets_are_masked(spark):
    masked = one(spark, X.mask_secrets(F.col("t")), t="key sk-abc_1 and password = hunter2\tok Bearer zzz")
    assert masked == "key [скрыто] and [скрыто] ok [скрыто]"


def test_description_is_a_whole_fragment(spark):
    assert one(spark, X.describe(F.col("t")), t="  Класс A.b.C держит 1.5 м. Потом другое") == "Класс A.b.C держит 1.5 м."


def test_markdown(spark):
    text = "# Итог\n**жирный** и `код`\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n# не заголовок\n```\n[x](y)"
    assert one(spark, M.markdown_to_plain(F.col("t")), t=text) == "Итог\nжирный и код\na; b\n- a: 1; b: 2\n# не заголовок\nx (y)"


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, -1.0]
    bad = spark.createDataFrame([([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([1.0, 2.0],)], "a array<double>")
    assert [r.v for r in bad.select(valid_vector(F.col("a"), 2).alias("v")).collect()] == [False, False, False, False, True]


def test_windows_packs_and_budgets_by_another_tokenizer(spark):
    """Pairs of characters as tokens, in Python, against plain slices."""
    from lodestone.functions.text import python_pieces, token_count
    from lodestone.operators import chunking as C, context as A

    two = python_pieces(lambda texts: [[t[i : i + 2] for i in range(0, len(t) - len(t) % 2, 2)] for t in texts])
    texts = ["a b c d e f g h i j k l m n o p", "é🙂" * 25, "x", "", None, "  ", "odd length of words here!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    assert {r.id: r.n for r in df.select("id", token_count(F.col("text"), two).alias("n")).collect()} == {i: len(t or "") // 2 for i, t in enumerate(texts)}
    rows = {(r.id, r.window): (r.start, r.end, r.text, r.token_count) for r in C.fixed_windows(df, ["id"], "text", 8, 3, two).collect()}
    want = {}
    for i, t in enumerate(texts):
        if not (t or "").strip():
            continue
        n, k = len(t) // 2, 0
        while True:
            last = k * 5 + 8 >= n
            part = t[k * 10 :] if last else t[k * 10 : k * 10 + 16]
            if part.strip():
                want[i, k] = (k * 10, k * 10 + len(part), part, min(8, n - k * 5))
            if last:
                break
            k += 1
    assert rows == want
    pairs = df.filter("id < 2").withColumn("terms", F.array(F.lit("k"), F.lit("l")))
    best = {r.id: r.text for r in C.best_excerpt(pairs, ["id"], 8, 3, two).collect()}
    assert "k l" in best[0] and len(best[0]) <= 16
    assert {r.window for r in C.passages(df, "id", 8, 3, pieces=two).filter("id = 0").collect()} == {k for i, k in want if i == 0}
    hits = df.withColumns({"section": F.lit("s"), "chunk_id": F.col("id")})
    for r in A.fragments(hits, True, two).collect():
        assert r.cost == len(r.fragment) // 2
    bad = python_pieces(lambda texts: [["nothing"] for _ in texts])
    with pytest.raises(Exception, match="do not make up"):
        df.filter("id = 0").select(token_count(F.col("text"), bad)).collect()


def test_work_on_long_texts_is_linear(spark):
    import time

    from lodestone.operators import chunking as C

    took = []
    for n in (20_000, 80_000):
        df = spark.createDataFrame([(1, "word, " * n)], "id int, text string").cache()
        df.count()
        for again in range(2):
            start = time.perf_counter()
            assert C.fixed_windows(df, ["id"], "text", 64, 8).count() > 0 and C.literal_slices(df, ["id"], "text", 60).count() == n // 10
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 2


def test_excerpt_cuts_spans_on_both_sides(spark):
    from lodestone.operators import chunking as C

    spans = spark.createDataFrame([("c", 1, 0, 10, 100, 110), ("c", 2, 10, 30, 5, 25), ("c", 3, 30, 40, 0, 10), ("d", 1, 0, 9, 0, 9)],
                                  "chunk_id string, ordinal int, span_start int, span_end int, source_start int, source_end int")
    cut = C.excerpt_spans(spark.createDataFrame([("c", 8, 25)], "chunk_id string, start int, end int"), spans, ["chunk_id"])
    assert sorted(tuple(r)[1:] for r in cut.collect()) == [(1, 0, 2, 108, 110), (2, 2, 17, 5, 20)]
    assert cut.columns == spans.columns


def test_encoder_leaves_null_texts_out(spark):
    from lodestone.operators.scoring import embed, word_hash_encoder

    df = spark.createDataFrame([(i, None if i % 2 else f"t {i}") for i in range(9)] + [(9, None)], "id int, text string").coalesce(1)
    rows = {r.id: r.embedding for r in embed(df, "id", "text", word_hash_encoder(4), 4, batch=2).collect()}
    assert all((rows[i] is None) == bool(i % 2) for i in range(10)) and len(rows[0]) == 4


def test_quotes_of_one_large_request(spark, monkeypatch):
    """Quotes meet contexts on their rarest inner word, or on a gram; the work is not quotes times contexts."""
    import random
    import unicodedata

    from lodestone.operators import evidence
    from lodestone.operators.evidence import normalize, quote_support

    pick = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["é" * 2 + str(i) for i in range(30)] + [unicodedata.normalize("NFD", "й") + str(i) for i in range(30)]
    contexts = [("r", i, f"c{i}", " ".join(pick.choice(words) for _ in range(40)), "purpose of it" if i % 3 else None) for i in range(400)]
    quotes = []
    for i in range(500):
        text = contexts[pick.randrange(400)][3]
        a = pick.randrange(len(text) - 40)
        quotes.append(("r", i, [text[a : a + pick.choice([7, 8, 9, 12, 30])], "w1 nowhere w3 w4", "  purpose   of", "of it", "purpose of it w1", unicodedata.normalize("NFC", text[a : a + 30])][i % 6]))
    quotes += [("other", 1, contexts[0][3][:20]), ("r", 900, None), ("r", 901, "")]
    c = spark.createDataFrame(contexts, "request_id string, rank int, chunk_id string, text string, purpose string").repartition(4)
    q = spark.createDataFrame(quotes, "request_id string, seq int, quote string").repartition(4)
    plain = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip()
    want = {}
    for key, seq, quote in quotes:
        n = plain(quote or "")
        hits = [k for r, _, k, *sources in contexts if r == key and any(n in plain(s) for s in sources if s)] if len(n) >= 8 else []
        want[key, seq] = hits[0] if hits else None
    for pairs in (evidence.PAIRS, 0, 1 << 40):  # by anchors where a request is large, for all requests, for none
        monkeypatch.setattr(evidence, "PAIRS", pairs)
        found = {(r.request_id, r.seq): (r.chunk_id, r.supported) for r in quote_support(q, c, ["request_id"]).collect()}
        assert found == {k: (v, v is not None) for k, v in want.items()}
    assert quote_support(q.limit(0), c, ["request_id"]).count() == 0 and not any(r.supported for r in quote_support(q, c.limit(0), ["request_id"]).collect())
    made = [(i, t) for i, t in enumerate(["áb", "각", "Å x", "plain", "й", "中文", "한국", "á̧", "יִ", None])]
    got = spark.createDataFrame(made, "i int, t string").select("i", normalize(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: t if t is None else plain(t) for i, t in made}


def test_long_answers_in_proportion(spark):
    """Folds over lines copy each line a bounded number of times, and a line finds the next one without a new split."""
    import time

    took = []
    for n in (2000, 8000):
        text = "\n".join(f"| a{i} | b |" if i % 9 else "## head **x**" for i in range(n)) + "\n1. ok"
        df = spark.createDataFrame([(text,)], "t string").cache()
        df.count()
        for again in range(2):
            start = time.perf_counter()
            row = df.select(M.strip_citations(F.col("t")).alias("a"), M.markdown_to_plain(F.col("t")).alias("b")).first()
        took.append(time.perf_counter() - start)
        assert row.a == text and row.b.count("\n") == n and "head x" in row.b
    assert took[1] < 10 * took[0] + 1


def test_grams_and_questions_are_not_broadcast(spark, capsys):
    questions = spark.createDataFrame([(1, "ask Alpha"), (2, "ask 7")], "question_id long, question string")
    out = M.requested_filters(questions, spark.createDataFrame([("alpha",), ("beta",)], "name string"))
    assert [(r.question_id, r.value) for r in out.filter("kind = 'name'").collect()] == [(1, "alpha")]
    out.explain()
    plan = capsys.readouterr().out
    assert "BuildLeft" not in plan and "SortMergeJoin [question_id" in plan
