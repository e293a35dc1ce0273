"""Exact dense search over tiles with bounds: top-k, best cards per owner, and ranks of chosen candidates.

Chunks belong to cells around centres and, within a cell, to rings of angles to the centre; a ring is cut into tiles of
about TILE_ROWS rows by a hash of the id. A question's angle to the centre and the ring's least and greatest angle bound
every similarity in the ring from both sides. A first round searches the nearest rings that hold enough rows, a second
one only rings that can still reach the k-th score found there; whatever is skipped cannot change a result.

Centres come from a sample of at most SAMPLE rows; they shape the tiles and never the results. The driver holds the
centres and one line per ring, CENTRES * RINGS at most. A tile and a block of questions meet in one task; a search takes
tiles in lots of up to LOT_TILES, so that a question travels once per lot, and brings back its best rows of the lot. There,
similarities in single precision rule rows out, with NEAR_SLACK to spare, and what is left is scored in double precision.

Vectors that are null, zero or hold null or non-finite components take no part. Ties fall to the chunk id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.functions.vectors import cosine
from lodestone.operators.scans import row_numbers, top_rows
from lodestone.session import cut_lineage, merged

TILE_ROWS = 2048
STRIP_ROWS = 256
QUERY_ROWS = 8192
BLOCK_ROWS = 32768
LOTS, LOT_TILES = 24, 16
NEAR_SLACK = 2e-5
SAMPLE, CENTRES, RINGS, SWEEPS = 8192, 1024, 8, 6
ASKED = 256
WHOLE = 2048
SENT_ROWS = 4096
DIGITS = 6
ANGLE_SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype("float64")


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(centres):
        return np.zeros((len(units), 0))
    return np.arccos(np.clip(units @ centres.T, -1.0, 1.0))


@dataclass
class Rings:
    """What bounds need: centres, and per ring its cell, angles, rows, cards and tiles."""

    centres: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    cards: np.ndarray
    salts: np.ndarray
    digits: int

    @property
    def slots(self) -> np.ndarray:
        """Number of the first tile of each ring, tiles counted through all rings."""
        return np.cumsum(self.salts) - self.salts

    def bounds(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest similarity that each vector can have with a row of each ring."""
        angle = _angles(units, self.centres)[:, self.cell]
        near = np.maximum(np.maximum(self.low - angle, angle - self.high) - ANGLE_SLACK, 0.0)
        far = np.minimum(angle + self.high + ANGLE_SLACK, np.pi)
        slack = 10.0**-self.digits
        return np.cos(far) - slack, np.cos(near) + slack

    def first(self, units: np.ndarray, k: int, owners: int) -> np.ndarray:
        """Rings of the first round: the nearest that hold ``k`` rows and ``owners`` cards."""
        order = np.argsort(-self.bounds(units)[1], axis=1, kind="stable")
        chosen = np.zeros(order.shape, bool)
        for need, have in ((k, self.count), (owners, self.cards)):
            if need:
                own = have[order]
                chosen |= (np.cumsum(own, axis=1) - own < need) & (own > 0)
        out = np.zeros_like(chosen)
        np.put_along_axis(out, order, chosen, axis=1)
        return out

    def second(self, units: np.ndarray, least: np.ndarray, least_card: np.ndarray, k: int, owners: int) -> np.ndarray:
        """Rings beyond the first round that may hold a row of the given score or better."""
        best = self.bounds(units)[1]
        reach = np.zeros(best.shape, bool)
        if k:
            reach |= (best >= least[:, None]) & (self.count > 0)
        if owners:
            reach |= (best >= least_card[:, None]) & (self.cards > 0)
        return reach & ~self.first(units, k, owners)


@dataclass
class Tiles:
    """Chunks dealt to rings and tiles (ring, tile), and the rings."""

    rows: DataFrame
    rings: Rings


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions of ``n`` groups of the sample, by spherical k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(SWEEPS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.unique(sums[size > 1e-9] / size[size > 1e-9, None], axis=0)
    return centres


def tiles(chunks: DataFrame, digits: int = DIGITS, tile_rows: int = TILE_ROWS) -> Tiles:
    """Deal chunks (chunk_id, embedding, and owner_id and card where cards are wanted) to rings and tiles."""
    names = [c for c in ("chunk_id", "owner_id", "card") if c in chunks.columns]
    rows = chunks.select(*names, "embedding").filter(usable(F.col("embedding")))
    total = rows.count()
    sample = rows.select("embedding").orderBy(F.xxhash64("chunk_id")).limit(SAMPLE).collect() if total else []
    drawn = _units(np.array([r.embedding for r in sample], "float64")) if sample else np.zeros((0, 1))
    centres = _centres(drawn, min(CENTRES, len(drawn), -(-total // tile_rows))) if sample else drawn
    # Ring limits are quantiles of the sample's angles, numbers of tiles follow from its shares.
    angle = _angles(drawn, centres)
    own = np.argmin(angle, axis=1) if sample else np.zeros(0, int)
    cuts, salts, cell = [], [], []
    for c in range(len(centres)):
        held = np.sort(angle[own == c, c])
        rings = max(1, min(RINGS, -(-len(held) * total // max(1, len(drawn) * tile_rows))))
        cuts.append(held[[i * len(held) // rings for i in range(1, rings)]] if len(held) else np.zeros(0))
        salts += [max(1, -(-(len(held) * total // max(1, len(drawn))) // (rings * tile_rows)))] * rings
        cell += [c] * rings
    start = np.searchsorted(cell, np.arange(len(centres)))
    many = np.array(salts, int)
    slots = np.cumsum(many) - many

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), TILE_ROWS):
                part = pdf.iloc[i : i + TILE_ROWS].copy()
                away = _angles(_units(_matrix(part["embedding"])), centres)
                near = np.argmin(away, axis=1)
                here = away[np.arange(len(part)), near]
                part["ring"] = start[near] + np.array([np.searchsorted(cuts[c], a, side="right") for c, a in zip(near, here)], dtype="int64")
                part["tile"] = pd.util.hash_array(part["chunk_id"].to_numpy(), categorize=False) % many[part["ring"]].astype("uint64")
                part["slot"] = slots[part["ring"]] + part["tile"].to_numpy().astype("int64")
                part["angle"] = here
                yield part

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = cut_lineage(rows.mapInPandas(deal, f"{kinds}, ring bigint, tile bigint, slot bigint, angle double"))
    card = F.sum(F.col("card").cast("int")) if "card" in names else F.lit(0)
    found = dealt.groupBy("ring").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1)), card).collect() if total else []
    stats = np.zeros((4, len(cell)))
    for ring, *values in found:
        stats[:, ring] = [v or 0 for v in values]
    rings = Rings(centres, np.array(cell, int), stats[0], stats[1], stats[2].astype(int), stats[3].astype(int), many, digits)
    return Tiles(dealt.drop("angle"), rings)


def _sent(queries: DataFrame, rings: Rings, choose: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """A row of each question for every tile of the rings that ``choose`` picks for it."""
    columns = [c for c in queries.columns if not c.startswith("_least")]
    kinds = ", ".join(f"{c} {dict(queries.dtypes)[c]}" for c in columns)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), STRIP_ROWS):
                part = pdf.iloc[i : i + STRIP_ROWS]
                row, ring = np.nonzero(choose(part, _units(_matrix(part["embedding"]))))
                salts = rings.salts[ring]
                row, ring, ends = np.repeat(row, salts), np.repeat(ring, salts), np.cumsum(salts)
                tile = np.arange(len(row)) - np.repeat(ends - salts, salts)
                # A question may go to every tile, so what leaves at once is bounded in rows.
                for j in range(0, len(row), SENT_ROWS):
                    out = part[columns].iloc[row[j : j + SENT_ROWS]].copy()
                    out["ring"], out["tile"] = ring[j : j + SENT_ROWS], tile[j : j + SENT_ROWS]
                    yield out

    return queries.mapInPandas(send, f"{kinds}, ring bigint, tile bigint")


def _met(sent: DataFrame, held: Tiles, blocks: int, schema: str, pick: Callable) -> DataFrame:
    """Run ``pick(questions, chunks in id order, similarities)`` over strips of every tile and the questions sent to it."""
    left = sent.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    right = held.rows.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    names, digits = [part.split()[0] for part in schema.split(", ")], held.rings.digits

    def product(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({n: pd.Series([], dtype="object") for n in names})  # takes any declared type, unlike float64
        c = c.sort_values("chunk_id", ignore_index=True)
        b = _matrix(c["embedding"])
        size, found = (b * b).sum(1), []
        for i in range(0, len(q), STRIP_ROWS):
            strip = q.iloc[i : i + STRIP_ROWS]
            a = _matrix(strip["embedding"])
            norm = np.sqrt(np.outer((a * a).sum(1), size))
            found.append(pick(strip, c, np.clip(np.round(a @ b.T / norm, digits), -1.0, 1.0) + 0.0))
        return pd.concat(found, ignore_index=True)[names]

    return left.groupBy("ring", "tile", "_q").cogroup(right.groupBy("ring", "tile", "_q")).applyInPandas(product, schema)


def _lots(queries: DataFrame, rings: Rings, per: int, choose: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """A row of each question for every lot of ``per`` tiles, with the tiles (``_slots``) that lie in rings ``choose`` picks."""
    kinds = ", ".join(f"{c} {t}" for c, t in queries.dtypes)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), STRIP_ROWS):
                part = pdf.iloc[i : i + STRIP_ROWS]
                row, ring = np.nonzero(choose(part, _units(_matrix(part["embedding"]))))
                salts = rings.salts[ring]
                if not len(row):
                    continue
                row, ends = np.repeat(row, salts), np.cumsum(salts)
                slot = np.repeat(rings.slots[ring] - (ends - salts), salts) + np.arange(len(row))
                lot = slot // per
                starts = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(lot) != 0)])
                listed = np.split(slot, starts[1:])
                # A question may go to every lot, so what leaves at once is bounded in rows.
                for j in range(0, len(starts), SENT_ROWS):
                    out = part.iloc[row[starts[j : j + SENT_ROWS]]].copy()
                    out["_lot"], out["_slots"] = lot[starts[j : j + SENT_ROWS]], listed[j : j + SENT_ROWS]
                    yield out

    return queries.mapInPandas(send, f"{kinds}, _lot bigint, _slots array<bigint>")


def _first(row: np.ndarray, col: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by (similarity desc, column), and all in that order."""
    order = np.lexsort((col, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], sim[kept]


def _first_cards(row: np.ndarray, col: np.ndarray, sim: np.ndarray, holder: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best column of each row and holder, for the ``owners`` best holders of each row."""
    order = np.lexsort((col, -sim, holder[col], row))
    row, col, sim = row[order], col[order], sim[order]
    own = holder[col]
    new = np.r_[True, (np.diff(row) != 0) | (np.diff(own) != 0)] if len(row) else np.zeros(0, bool)
    return _first(row[new], col[new], sim[new], owners)


def _lot_best(strip: pd.DataFrame, b: np.ndarray, b32: np.ndarray, places: dict[int, np.ndarray], holder: np.ndarray, k: int, owners: int, digits: int):
    """(row, column, similarity) of the k best of each question of a strip, and of its best cards, over the tiles sent for it.

    holder: number of a card's owner, -1 for rows that are no cards.
    """
    a = _matrix(strip["embedding"])
    a32, a_size, b_size = _units(a).astype("float32"), (a * a).sum(1), (b * b).sum(1)
    kth, least_card = strip["_least"].to_numpy(copy=True), strip["_least_card"].to_numpy()
    asker = np.repeat(np.arange(len(strip)), strip["_slots"].map(len))
    asked = np.concatenate([np.asarray(x) for x in strip["_slots"]])
    slack = 10.0**-digits + NEAR_SLACK
    top = cards = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def scored(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return np.clip(np.round(np.einsum("ij,ij->i", a[row], b[col]) / np.sqrt(a_size[row] * b_size[col]), digits), -1.0, 1.0) + 0.0

    for slot, cols in places.items():
        rows = asker[asked == slot]
        if not len(rows):
            continue
        near = a32[rows] @ b32[cols].T
        if k:
            low, open_ = kth[rows], kth[rows] < -1
            if open_.any() and k < len(cols):
                low[open_] = np.partition(near[open_], -k, axis=1)[:, -k]
            r, j = np.nonzero(near >= (low - slack).astype("float32")[:, None])
            row, col = rows[r], cols[j]
            sim = scored(row, col)
            kept = sim >= kth[row]
            top = _first(*(np.concatenate([x, y[kept]]) for x, y in zip(top, (row, col, sim))), k)
            full = np.flatnonzero(np.arange(len(top[0])) - np.searchsorted(top[0], top[0]) == k - 1)
            kth[top[0][full]] = np.maximum(kth[top[0][full]], top[2][full])
        held = np.flatnonzero(holder[cols] >= 0) if owners else []
        if len(held):
            held = held[np.argsort(holder[cols[held]], kind="stable")]
            own = holder[cols[held]]
            starts = np.flatnonzero(np.r_[True, np.diff(own) != 0])
            part = near[:, held]
            best = np.maximum(np.maximum.reduceat(part, starts, axis=1), least_card[rows].astype("float32")[:, None])
            r, j = np.nonzero(part >= np.repeat(best - np.float32(slack), np.diff(np.r_[starts, len(held)]), axis=1))
            row, col = rows[r], cols[held[j]]
            cards = _first_cards(*(np.concatenate([x, y]) for x, y in zip(cards, (row, col, scored(row, col)))), holder, owners)
    return top, cards


def search(queries: DataFrame, held: Tiles, k: int, owners: int = 0) -> tuple[DataFrame, DataFrame]:
    """The k best chunks of each question with rank, and the best cards of the ``owners`` best owners with rank."""
    rings, digits = held.rings, held.rings.digits
    asked = queries.select("query_id", "embedding").filter(usable(F.col("embedding")))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    per = max(1, min(LOT_TILES, int(rings.salts.sum()) // LOTS))
    kinds = dict(held.rows.dtypes)
    owner = f", owner_id {kinds['owner_id']}, card boolean" if owners else ""
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {kinds['chunk_id']}, similarity double{owner}"
    names = [part.split()[0] for part in schema.split(", ")]

    def product(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({n: pd.Series([], dtype="object") for n in names})  # takes any declared type, unlike float64
        c = c.sort_values("chunk_id", ignore_index=True)
        b, slots, ids = _matrix(c["embedding"]), c["slot"].to_numpy(), c["chunk_id"].to_numpy()
        b32, places, holder, found = _units(b).astype("float32"), {s: np.flatnonzero(slots == s) for s in np.unique(slots)}, None, []
        if owners:
            holder = np.where(c["card"].fillna(False).to_numpy(dtype=bool), pd.factorize(c["owner_id"], use_na_sentinel=False)[0], -1)
        for i in range(0, len(q), STRIP_ROWS):
            strip = q.iloc[i : i + STRIP_ROWS]
            asking = strip["query_id"].to_numpy()
            for card, (row, col, sim) in zip((False, True), _lot_best(strip, b, b32, places, holder, k, owners, digits)):
                if len(row):
                    found.append(pd.DataFrame({"query_id": asking[row], "chunk_id": ids[col], "similarity": sim, "card": card,
                                               "owner_id": c["owner_id"].to_numpy()[col] if card else None})[names])
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({n: pd.Series([], dtype="object") for n in names})

    def met(sent: DataFrame) -> DataFrame:
        left = sent.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        right = held.rows.withColumns({"_lot": F.floor(F.col("slot") / per), "_q": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
        return left.groupBy("_lot", "_q").cogroup(right.groupBy("_lot", "_q")).applyInPandas(product, schema)

    def best(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        order = [F.desc("similarity"), "chunk_id"]
        if not owners:
            return top_rows(rows, ["query_id"], order, k), rows
        chunks_ = top_rows(rows.filter("NOT card").select("query_id", "chunk_id", "similarity"), ["query_id"], order, max(k, 1))
        each = rows.filter("card").groupBy("query_id", "owner_id").agg(
            F.min_by(F.struct("chunk_id", "similarity"), F.struct(-F.col("similarity"), F.col("chunk_id"))).alias("_b"))
        return chunks_, top_rows(each.select("query_id", "owner_id", "_b.chunk_id", "_b.similarity"), ["query_id"], order, owners)

    open_ = asked.withColumns({"_least": F.lit(-2.0), "_least_card": F.lit(-2.0)})
    near = cut_lineage(met(_lots(open_, rings, per, lambda _, u: rings.first(u, k, owners))))
    limits = asked
    for rows, need, name in zip(best(near), (k, owners), ("_least", "_least_card")):
        last = rows.filter(F.col("rank") == need).select("query_id", F.col("similarity").alias(name)) if need else None
        limits = limits.join(last, "query_id", "left") if need else limits.withColumn(name, F.lit(0.0))
    limits = limits.fillna(-2.0, ["_least", "_least_card"])
    rest = _lots(limits, rings, per, lambda part, u: rings.second(u, part["_least"].to_numpy(), part["_least_card"].to_numpy(), k, owners))
    return best(near.unionByName(met(rest)))


def tiles_met(queries: DataFrame, held: Tiles, k: int) -> DataFrame:
    """(query_id, n_tiles, n_met): of all tiles, how many a search of the k best meets."""
    rings = held.rings
    top = search(queries, held, k)[0].filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("_least"))
    rows = queries.select("query_id", "embedding").filter(usable(F.col("embedding"))).join(top, "query_id", "left").fillna(-2.0, ["_least"])

    def met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                u = _units(_matrix(pdf["embedding"]))
                chosen = rings.first(u, k, 0) | rings.second(u, pdf["_least"].to_numpy(), pdf["_least"].to_numpy(), k, 0)
                yield pd.DataFrame({"query_id": pdf["query_id"], "n_tiles": int(rings.salts.sum()), "n_met": (chosen * rings.salts).sum(1)})

    return rows.mapInPandas(met, f"query_id {dict(queries.dtypes)['query_id']}, n_tiles bigint, n_met bigint")


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """Best k chunks per question by similarity, then id."""
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")
    return search(queries, tiles(chunks.select("chunk_id", "embedding"), digits), k)[0]


def card_recall(queries: DataFrame, cards: DataFrame, owners: int = 20, digits: int = DIGITS) -> DataFrame:
    """Best card per owner, then the best owners: (query_id, owner_id, chunk_id, similarity, rank)."""
    return search(queries, tiles(cards.select("chunk_id", "owner_id", "embedding", F.lit(True).alias("card")), digits), 0, owners)[1]


def dense_ranks(queries: DataFrame, chunks: DataFrame, wanted: DataFrame, held: Tiles | None = None, digits: int = DIGITS) -> DataFrame:
    """(query_id, chunk_id, similarity, dense_rank) of the wanted pairs, ranked among all chunks.

    Similarities of the pairs come from joins. A rank is one more than the number of chunks ahead: rings that lie wholly
    ahead of a pair count as they are, rings wholly behind it not at all, and only the others are searched. That work
    grows with pairs times tiles, so a question with more than WHOLE pairs has all its chunks ranked instead.
    """
    held = held or tiles(chunks.select("chunk_id", "embedding"), digits)
    rings = held.rings
    both = wanted.select("query_id", "chunk_id").distinct().join(queries.select("query_id", F.col("embedding").alias("_a")), "query_id")
    both = merged(both).join(chunks.select("chunk_id", F.col("embedding").alias("_b")), "chunk_id").filter(usable(F.col("_a")) & usable(F.col("_b")))
    like = F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine(F.col("_a"), F.col("_b")))), rings.digits) + 0.0
    pairs = cut_lineage(both.select("query_id", "chunk_id", like.alias("similarity")))
    many = cut_lineage(pairs.groupBy("query_id").count().filter(F.col("count") > WHOLE).select("query_id"))
    some = not many.isEmpty()
    few = pairs.join(many, "query_id", "left_anti") if some else pairs
    # A question asks for ASKED of its pairs at a time, so a question with many pairs is several rows.
    lots = few.withColumn("_lot", F.floor((F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")) - 1) / ASKED))
    asked = lots.groupBy("query_id", "_lot").agg(F.collect_list("chunk_id").alias("_ids"), F.collect_list("similarity").alias("_sims"))
    asked = cut_lineage(asked.join(queries.select("query_id", "embedding"), "query_id").drop("_lot"))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    kinds = dict(held.rows.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {kinds['chunk_id']}, ahead bigint"

    def unclear(part: pd.DataFrame, units: np.ndarray) -> np.ndarray:
        least, most = rings.bounds(units)
        sims = [np.sort(np.asarray(s)) for s in part["_sims"]]
        # A ring is unclear if one of the similarities lies within its bounds.
        inside = [np.searchsorted(s, hi, side="right") > np.searchsorted(s, lo) for s, lo, hi in zip(sims, least, most)]
        return np.stack(inside) & (rings.count > 0)

    def clear(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), STRIP_ROWS):
                part = pdf.iloc[i : i + STRIP_ROWS]
                units = _units(_matrix(part["embedding"]))
                least, open_ = rings.bounds(units)[0], unclear(part, units)
                ahead = [((lo[None] > np.asarray(s)[:, None]) & ~o & (rings.count > 0)) @ rings.count for lo, o, s in zip(least, open_, part["_sims"])]
                yield _counts(part, ahead)

    def pick(strip: pd.DataFrame, c: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        ids, ahead = c["chunk_id"].to_numpy(), []
        for names, sims, row in zip(strip["_ids"], strip["_sims"], scores):
            order = np.argsort(row, kind="stable")  # by score, equal ones by id
            line, sims = row[order], np.asarray(sims)
            low, high = np.searchsorted(line, sims), np.searchsorted(line, sims, side="right")
            ahead.append(len(line) - high)
            for i in np.flatnonzero(high > low):
                ahead[-1][i] += np.searchsorted(ids[order[low[i] : high[i]]], names[i])
        return _counts(strip, ahead)

    counts = _met(_sent(asked, rings, unclear), held, blocks, schema, pick).unionByName(asked.mapInPandas(clear, schema))
    ranks = counts.groupBy("query_id", "chunk_id").agg((F.sum("ahead") + 1).alias("dense_rank"))
    if some:
        ranks = ranks.unionByName(_whole_ranks(queries.join(many, "query_id", "left_semi"), held, pairs))
    return merged(pairs).join(ranks, ["query_id", "chunk_id"])


def _whole_ranks(queries: DataFrame, held: Tiles, pairs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, dense_rank) of the pairs of these questions, from the places of all their chunks."""
    asked = cut_lineage(queries.select("query_id", "embedding").filter(usable(F.col("embedding"))))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(held.rows.dtypes)['chunk_id']}, similarity double"

    def pick(strip: pd.DataFrame, c: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"query_id": np.repeat(strip["query_id"].to_numpy(), len(c)),
                             "chunk_id": np.tile(c["chunk_id"].to_numpy(), len(strip)), "similarity": scores.reshape(-1)})

    rings = len(held.rings.cell)
    every = lambda part, units: np.ones((len(part), rings), bool)
    scored = _met(_sent(asked, held.rings, every), held, max(1, -(-asked.count() // STRIP_ROWS)), schema, pick)
    placed = row_numbers(scored, ["query_id"], F.col("similarity"), "chunk_id", "dense_rank")
    wanted = placed.join(merged(pairs.select("query_id", "chunk_id").distinct()), ["query_id", "chunk_id"], "left_semi")
    return wanted.groupBy("query_id", "chunk_id").agg(F.min("dense_rank").alias("dense_rank"))


def _counts(asked: pd.DataFrame, ahead: list[np.ndarray]) -> pd.DataFrame:
    sizes = [len(a) for a in ahead]
    return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), sizes), "chunk_id": np.concatenate([np.asarray(x) for x in asked["_ids"]]),
                         "ahead": np.concatenate(ahead).astype("int64")})


def dense_candidates(queries: DataFrame, chunks: DataFrame, k: int, wanted: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(query_id, chunk_id, similarity, dense_rank) of the k best of each question and of the wanted pairs."""
    held = tiles(chunks.select("chunk_id", "embedding"), digits)
    top = cut_lineage(search(queries, held, k)[0])
    return ranked_with(queries, chunks, held, top, wanted)


def ranked_with(queries: DataFrame, chunks: DataFrame, held: Tiles, top: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ranked rows of ``top``, and those wanted pairs that it lacks, ranked among all chunks."""
    top = top.select("query_id", "chunk_id", "similarity", F.col("rank").cast("long").alias("dense_rank"))
    rest = wanted.select("query_id", "chunk_id").join(merged(top), ["query_id", "chunk_id"], "left_anti")
    return top.unionByName(dense_ranks(queries, chunks, rest, held))
