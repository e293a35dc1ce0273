"""Structure, ownership, conflicts and chunking of a small document."""

from pyspark.sql import functions as F

from lodestone.functions.text import token_count
from lodestone.operators import chunking as C, entities as E
from lodestone.sources.blocks import structure_blocks

RAW = "source string, pos long, level int, kind string, text string, table_id string, cells array<string>, asset_ids array<string>, deleted boolean"
BLOCK = "source string, ordinal long, section string, text string, kind string, heading_level int, family_names array<string>, asset_ids array<string>"


def raw(spark):
    slab, beam = "КркНес_ЛПлощадка_Монолитная", "КркНес_Балка_Монолитная"
    rows = [
        (0, slab, None, None, False), (None, "Абзац", None, None, False), (None, "Параметр | Значение", "t1", ["Параметр", "Значение"], False),
        (None, "Балка_Высота | 100", "t1", ["Балка_Высота", "100"], False), (1, "Балки", None, None, False), (None, "Ещё абзац", None, None, False),
        (None, "Название семейства | Описание", "t2", ["Название семейства", "Описание"], False),
        (None, beam + " | назначение балки", "t2", [beam, "назначение балки"], False), (None, "удалено", None, None, True)]
    return spark.createDataFrame(
        [("d", i, lvl, "row" if tid else "paragraph", text, tid, cells, [], gone) for i, (lvl, text, tid, cells, gone) in enumerate(rows)], RAW)


def test_structure(spark):
    rows = structure_blocks(raw(spark)).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(1, 9))
    assert rows[1].family_names == ["КркНес_ЛПлощадка_Монолитная"]
    assert rows[7].family_names == ["КркНес_Балка_Монолитная"]
    assert rows[3].family_names == ["КркНес_ЛПлощадка_Монолитная"] and rows[3].kind == "table-row:2"
    assert rows[5].section == "КркНес_ЛПлощадка_Монолитная / Балки"
    assert all("удалено" not in r.text for r in rows)


def conflict(spark):
    data = [
        (1, "Сборный", "КркНес_ЛМарш_Сборный", "heading", 0, []),
        (2, "Сборный", "В этой статье описано всё об инструменте КркНес_ЛМарш_Монолитный", "paragraph", None, []),
        (3, "Сборный", "Данный инструмент используют для моделирования сборных маршей", "paragraph", None, ["image"]),
        (4, "Монолитный", "КркНес_ЛМарш_Монолитный", "heading", 0, []),
        (5, "Монолитный", "Данный инструмент используют для моделирования монолитных маршей", "paragraph", None, [])]
    blocks = spark.createDataFrame([("s", o, s, t, k, lvl, [], a) for o, s, t, k, lvl, a in data], BLOCK)
    registry = E.entity_registry(blocks)
    owned = E.assign_owner(blocks, registry)
    refs = E.references(owned, registry)
    return E.classify_blocks(owned, refs), registry, refs


def test_conflicting_introduction(spark):
    blocks, registry, refs = conflict(spark)
    rows = {r.ordinal: r for r in blocks.collect()}
    assert rows[2].owner_name == "КркНес_ЛМарш_Сборный" and len(rows[2].warnings) == 1 and rows[2].classification == "ambiguous"
    cards = {r.name: r for r in E.entity_cards(blocks, registry, refs).collect()}
    assert len(cards) == 2
    card = cards["КркНес_ЛМарш_Сборный"]
    assert card.status == "conflict" and "сборных" in card.purpose and "Монолитный" not in card.purpose and card.n_assets == 1
    assets = spark.createDataFrame([("s", "image", "unprocessed")], "source string, asset_id string, status string")
    assert E.asset_owner(assets, blocks).first().owner_id == card.entity_id
    problems = {r.problem for r in E.integrity_report(blocks, assets, E.entity_cards(blocks, registry, refs)).collect()}
    assert "image_unprocessed" in problems and len(problems) == 2


def test_card_chunks_quote_purpose_only(spark):
    blocks, _, _ = conflict(spark)
    rows = C.card_chunks(blocks, E.card_lines(blocks)).collect()
    assert len(rows) == 2 and all("используют" in r.text and r.kind == "family_card" for r in rows)


def test_shared_heading(spark):
    blocks = spark.createDataFrame([("s", 1, "A", "A_1 / B_2", "heading", 0, [], []), ("s", 2, "A", "текст", "paragraph", None, [], [])], BLOCK)
    rows = blocks.withColumn("owner_id", F.lit(None).cast("string"))
    out = E.backfill_shared(blocks, rows).collect()
    assert all(r.family_names == ["A_1", "B_2"] and r.owner_id for r in out)
    cards = E.shared_cards(blocks, spark.createDataFrame([], "source string, entity_id string")).collect()
    assert [(c.name, c.status) for c in cards] == [("A_1 / B_2", "shared")]


def test_windows_cover_overlap_and_advance(spark):
    text = "Инструкция размещения арматуры. " * 500
    rows = C.fixed_windows(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text", 600, 100).orderBy("window").collect()
    assert rows[0].start == 0 and rows[-1].end == len(text) and all(r.token_count <= 600 for r in rows)
    assert all(r.text == text[r.start:r.end] for r in rows)
    assert all(a.start < b.start < a.end for a, b in zip(rows, rows[1:]))


def test_family_stays_together_and_only_big_blocks_are_split(spark):
    name = "КркНес_ЛПлощадка_Монолитная"
    long = "Инструкция размещения арматуры. " * 65
    data = [(1, name, name, "heading", [name]), (2, name, long, "paragraph", [name]), (3, name + " / Настройка", "Настройка", "heading", [name]),
            (4, name + " / Настройка", "Параметр | Значение", "table-row:1", [name]), (5, name + " / Настройка", "Проверьте привязку к грани.", "paragraph", [name])]
    blocks = spark.createDataFrame([("s", *r[:4], None, r[4], []) for r in data], BLOCK).withColumn("token_count", token_count(F.col("text")))
    groups = C.structural_groups(blocks)
    assert groups.select("group_id").distinct().count() == 1
    packs = C.pack_texts(C.pack_blocks(groups, ["source", "group_id"], 2000), ["source", "group_id"]).collect()
    assert len(packs) == 1 and "Параметр | Значение" in packs[0].text


def test_evidence_lines_keep_all_text(spark):
    text = ("слово " * 100).strip() + "\n\n" + "x" * 500
    rows = C.evidence_lines(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("line").collect()
    assert all(len(r.quote) <= 220 for r in rows)
    assert "".join("".join(r.quote.split()) for r in rows) == "".join(text.split())


def test_catalog_pairs_come_from_both_rows(spark):
    from lodestone.operators.catalog import catalog_pairs, unify_recommend

    weights = {"brand": 0.3, "kind": 0.4, "size": 0.2}
    made = [(1, "b", "k", 5), (2, "b", "k", 5), (3, "b", "x", 5), (4, "b", None, 5), (5, "c", None, 9), (6, None, None, None), (7, "c", "y", 9)]
    items = spark.createDataFrame(made, "item int, brand string, kind string, size int")
    pairs = {(r.item, r.partner): (r.score, r.vetoed, r.matches, r.differences, r.missing) for r in catalog_pairs(items, "item", weights, ["kind"]).collect()}
    assert pairs[1, 2] == (0.9, False, "brand,kind,size", "", "") and pairs[2, 1] == pairs[1, 2]
    assert pairs[3, 1] == (0.5, True, "brand,size", "kind", "") and pairs[3, 4] == (0.5, False, "brand,size", "", "kind")
    assert pairs[7, 5] == (0.5, False, "brand,size", "", "kind") and not any(6 in p for p in pairs)
    assert len(pairs) == catalog_pairs(items, "item", weights, ["kind"]).count()
    best = {r.item: (r.partner, r.score, r.reason, r.missing) for r in unify_recommend(catalog_pairs(items, "item", weights, ["kind"]), "item").collect()}
    assert best[3] == (4, 0.5, "brand,size", "kind") and best[1] == (2, 0.9, "brand,kind,size", "") and best[4] == (1, 0.5, "brand,size", "kind")


def test_catalog_pairs_equal_all_pairs(spark):
    import random

    from lodestone.operators.catalog import catalog_pairs

    pick = random.Random(3)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    made = [(i, *[pick.choice([None, "x", "y", "z"]) for _ in range(3)]) for i in range(120)]
    found = {(r.item, r.partner): (r.score, r.vetoed) for r in catalog_pairs(spark.createDataFrame(made, "item int, a string, b string, c string"), "item", weights, ["a", "c"]).collect()}
    for i, *x in made:
        best, free = {}, {}
        for j, *y in made:
            if i == j:
                continue
            same = [n for n, p, q in zip("abc", x, y) if p is not None and p == q]
            veto = any(p is not None and q is not None and p != q for n, p, q in zip("abc", x, y) if n in "ac")
            score = round(sum(weights[n] for n in same), 6)
            if same:
                best[score] = min(best.get(score, j), j)
                if not veto:
                    free[score] = min(free.get(score, j), j)
            if (i, j) in found:
                assert found[i, j] == (score, veto)
        for scores in (best, free):
            if scores:
                assert (i, scores[max(scores)]) in found


def test_quotes_over_several_lines(spark):
    schema = "source string, ordinal long, owner_id string, text string, warnings array<string>"
    lines = [("s", "a", "purpose", 1, "first line"), ("s", "a", "purpose", 2, "second line\nthird line"), ("s", "a", "purpose", 5, "fourth"), ("s", "a", "purpose", 6, "fifth line"),
             ("s", "a", "constraints", 9, "not allowed\nhere"), ("s", "b", "constraints", 1, "alone"), ("t", "a", "purpose", 1, "first line")]
    card = spark.createDataFrame(lines, "source string, entity_id string, role string, ordinal long, text string")
    texts = {
        1: "first line", 2: "line\nsecond line", 3: "line\nsecond line\nthird line\nfourth\nfif", 4: "first line\nthird line", 5: "not allowed\nhere", 6: "e\nhere", 7: "d\nhere",
        8: "fifth line\nnot allowed", 9: "fir", 10: "x", 11: "", 12: "line\n", 13: "\nfourth", 14: "second line\nthird line\nfifth", 15: "third line\nfourth\nfifth line", 16: "long enough but nowhere to be found"}
    blocks = [("s", k, "a", t, []) for k, t in texts.items()] + [("s", 50, "b", "alone", []), ("t", 60, "a", "second line", []), ("s", 61, "a", "first line", ["w"]), ("s", 62, None, "first line", [])]
    found = {(r.source, r.ordinal) for r in C.quoted_blocks(spark.createDataFrame(blocks, schema).repartition(3), card).collect()}
    joined = {"purpose": "first line\nsecond line\nthird line\nfourth\nfifth line", "constraints": "not allowed\nhere"}
    assert found == {("s", k) for k, t in texts.items() if any(t in j for j in joined.values())}
    assert C.quoted_blocks(spark.createDataFrame([], schema), card).count() == 0


def test_names_are_met_without_copies_of_the_text(spark):
    blocks = spark.createDataFrame([("s", 1, "См. A_1, a_1 и B_2.", None, None), ("s", 2, "A_1x", None, None), ("t", 1, "A_1", None, None), ("s", 3, "A_1 x", "own", "A_1"), ("s", 4, None, None, None)],
                                   "source string, ordinal int, text string, owner_id string, owner_name string")
    registry = spark.createDataFrame([("s", "A_1", "a_1", "ia"), ("s", "B_2", "b_2", "ib")], "source string, name string, key string, entity_id string")
    refs = E.references(blocks, registry)
    assert {tuple(r) for r in refs.collect()} == {("s", 1, "ia"), ("s", 1, "ib")}
    plan = refs._jdf.queryExecution().optimizedPlan().toString()
    tokens = next(part for part in plan.split("Generate")[1:] if "explode" in part)
    assert "text" not in tokens.split("\n")[0].split("outer")[0].split("[", 2)[-1]
