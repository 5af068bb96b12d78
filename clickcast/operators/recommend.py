"""Product recommendations for every actor (user or anonymous visitor), as one batch job.

Cascade, earlier stages win, no repeats, at most ``limit`` products per actor:
  0. association-rule predictions for the actor's recent products (the seed basket);
  1. products that actors of the same recent products touch most (for given requests only);
  2. most reviewed / best rated products in the seeds' categories;
  3. global popularity (best seller, reviews, stars).
Seeds (the actor's 10 most recent products) are never recommended.

Stages 2 and 3 only ever need the top ``limit + seeds + limit`` products of a category (or
globally): an actor excludes at most that many, so pre-ranking each category once and
joining actors to those short lists is exact and keeps the join linear in actors.
For all actors at once stage 1 would be all pairs of actors that share a product, so
``recommend_for_all`` leaves it out; ``recommend_for_requests`` runs it for a request table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RECENT_INTERACTIONS, RECOMMEND_LIMIT
from ..session import materialize
from . import rules as RU

REQUESTS_PER_TILE = 2048
ROWS_PER_TILE = 2_000_000   # (peer, product) rows; a peer's stay together
CHUNK = 2048
HELD_ROWS = 4_000_000


def recent_interactions(events: DataFrame, n: int = RECENT_INTERACTIONS) -> DataFrame:
    """(actor, id_type, product_id, pos): the actor's last ``n`` events with a product,
    newest first (ties by event id); repeats of a product allowed. The row_number <= n
    filter is applied partially before the shuffle (window group limit), so a hot actor
    sends at most n rows per map task."""
    ev = events.filter(F.col("product_id").isNotNull()).select(
        F.col("customer_key").alias("actor"), "id_type", "product_id", "event_time", "id")
    w = Window.partitionBy("actor", "id_type").orderBy(F.desc("event_time"), F.desc("id"))
    return (ev.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
              .select("actor", "id_type", "product_id", F.col("pos").cast("bigint").alias("pos")))


def seed_baskets(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("actor", "id_type").agg(F.array_sort(F.collect_set("product_id")).alias("items"))


def rule_stage(seeds: DataFrame, rules: DataFrame, itemsets: DataFrame, products: DataFrame) -> DataFrame:
    """Stage 0: rule predictions (rank order kept) limited to products that exist."""
    b = seed_baskets(seeds).select(F.concat_ws("\u0001", "actor", "id_type").alias("basket_id"),
                                   "actor", "id_type", "items")
    p = RU.basket_predictions(b.select("basket_id", "items"), rules, itemsets)
    known = products.select(F.col("id").cast("string").alias("item"))
    p = p.join(known, "item", "left_semi")
    return (p.join(b.select("basket_id", "actor", "id_type"), "basket_id")
             .select("actor", "id_type", F.col("item").alias("product_id"),
                     F.lit(0).alias("stage"), F.col("rank").alias("pos")))


def _pop_order(*extra):
    return list(extra) + [F.desc_nulls_first("reviews"), F.desc_nulls_first("stars"), F.asc("id")]


def category_candidates(products: DataFrame, depth: int) -> DataFrame:
    """(category, product_id, crank) for the top ``depth`` products of each category."""
    w = Window.partitionBy("category").orderBy(*_pop_order())
    p = products.filter(F.col("category").isNotNull())
    return (p.withColumn("crank", F.row_number().over(w)).filter(F.col("crank") <= depth)
             .select("category", F.col("id").cast("string").alias("product_id"), "crank"))


def category_stage(seeds: DataFrame, products: DataFrame, depth: int) -> DataFrame:
    """Stage 2: products of the seeds' categories, reviews desc, stars desc (NULLs first,
    as a descending database sort puts them), then product id."""
    pcat = products.select(F.col("id").cast("string").alias("product_id"), "category")
    cats = seeds.join(pcat, "product_id").filter(F.col("category").isNotNull()) \
                .select("actor", "id_type", "category").distinct()
    cand = cats.join(category_candidates(products, depth), "category")
    cand = cand.join(seeds.select("actor", "id_type", "product_id"), ["actor", "id_type", "product_id"],
                     "left_anti")
    info = products.select(F.col("id").cast("string").alias("product_id"), "reviews", "stars", "id")
    cand = cand.select("actor", "id_type", "product_id").distinct().join(info, "product_id")
    w = Window.partitionBy("actor", "id_type").orderBy(*_pop_order())
    return cand.select("actor", "id_type", "product_id", F.lit(2).alias("stage"),
                       F.row_number().over(w).alias("pos"))


def global_candidates(products: DataFrame, depth: int) -> list[str]:
    """Ids of the ``depth`` most popular products overall, best first. A TakeOrdered of
    ``depth`` rows: the only driver-side result here, its size is the parameter."""
    top = products.orderBy(*_pop_order(F.desc("is_best_seller"))).limit(depth)
    return [str(r[0]) for r in top.select("id").collect()]


def global_stage(actors: DataFrame, seeds: DataFrame, products: DataFrame, depth: int) -> DataFrame:
    """Stage 3: global popularity minus the actor's seeds: every actor gets the same
    ``depth``-long list (a literal), exploded, then anti-joined with its seeds."""
    ids = global_candidates(products, depth)
    lst = F.array(*[F.struct(F.lit(p).alias("product_id"), F.lit(i + 1).alias("grank"))
                    for i, p in enumerate(ids)]) if ids else F.array().cast(
        "array<struct<product_id:string,grank:int>>")
    cand = actors.select("actor", "id_type", F.inline(lst))
    cand = cand.join(seeds.select("actor", "id_type", "product_id"), ["actor", "id_type", "product_id"],
                     "left_anti")
    w = Window.partitionBy("actor", "id_type").orderBy("grank")
    return cand.select("actor", "id_type", "product_id", F.lit(3).alias("stage"),
                       F.row_number().over(w).alias("pos"))


def recommend_for_all(events: DataFrame, products: DataFrame, rules: DataFrame, itemsets: DataFrame,
                      limit: int = RECOMMEND_LIMIT, n_seeds: int = RECENT_INTERACTIONS) -> DataFrame:
    """(actor, id_type, product_id, stage, rank) for every actor with a product event."""
    seeds = materialize(recent_interactions(events, n_seeds))  # read by every stage
    return _cascade(seeds, products, rules, itemsets, limit, n_seeds, [])


def category_lists(products: DataFrame, depth: int) -> DataFrame:
    """(category, best): each category's first ``depth`` products as one sorted array. NULL reviews and
    stars come first, as in ``_pop_order``; the array's order is that order."""
    w = Window.partitionBy("category").orderBy(*_pop_order())
    top = products.filter(F.col("category").isNotNull()).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= depth)
    place = F.struct((-F.col("reviews")).alias("a"), (-F.col("stars")).alias("b"), F.col("id").alias("c"),
                     F.col("id").cast("string").alias("product_id"))
    return top.groupBy("category").agg(F.sort_array(F.collect_list(place)).alias("best"))


def _cascade(seeds: DataFrame, products: DataFrame, rules: DataFrame, itemsets: DataFrame, limit: int,
             n_seeds: int, more: list[DataFrame]) -> DataFrame:
    """The stages for the actors of ``seeds``: earlier stages win, the first ``limit`` stay.

    One row per actor carries its seeds and one array per stage; an actor meets a category as that
    category's short array, so nothing is blown up to one row per candidate."""
    key = ["actor", "id_type"]
    category = products.select(F.col("id").cast("string").alias("product_id"), "category")
    own = seeds.join(category, "product_id", "left").groupBy(*key).agg(
        F.collect_set("product_id").alias("seen"), F.collect_set("category").alias("categories"))
    # an actor leaves out its seeds and what earlier stages chose
    lists = category_lists(products, limit + n_seeds + limit)
    rows = own.select(*key, "seen", F.explode_outer("categories").alias("category")).join(lists, "category", "left").groupBy(*key).agg(
        F.any_value("seen").alias("seen"), F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    everywhere = F.array(*map(F.lit, global_candidates(products, limit + n_seeds + limit))).cast("array<string>")
    rows = rows.withColumn("s2", F.col("best.product_id")).withColumn("s3", everywhere).drop("best")
    for k, stage in [(0, rule_stage(seeds, rules, itemsets, products)), *((1, m) for m in more)]:
        chosen = stage.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "product_id"))).alias("l"))
        rows = rows.join(chosen.select(*key, F.col("l.product_id").alias(f"s{k}")), key, "left")
    stages = [k for k in range(4) if f"s{k}" in rows.columns]

    def new_with(stage: int):
        return lambda x: F.when(~F.array_contains("seen", x), F.struct(x.alias("product_id"), F.lit(stage).alias("stage")))

    none = F.array().cast("array<string>")
    tagged = F.array_compact(F.flatten(F.array(*[F.transform(F.coalesce(F.col(f"s{k}"), none), new_with(k)) for k in stages])))
    rows = rows.withColumn("all", tagged).withColumn("ids", F.slice(F.array_distinct(F.col("all.product_id")), 1, limit))
    out = rows.select(*key, "all", F.posexplode("ids").alias("k", "product_id"))
    first = F.element_at(F.filter("all", lambda x: x["product_id"] == F.col("product_id")), 1)["stage"]
    return out.select(*key, "product_id", first.alias("stage"), (F.col("k") + 1).cast("bigint").alias("rank"))


def exclude_current_product(recs: DataFrame, current: DataFrame) -> DataFrame:
    """Drop the product the actor is looking at from its recommendations."""
    return recs.join(current.select("actor", "id_type", "product_id"), ["actor", "id_type", "product_id"],
                     "left_anti")


def co_occurrence(events: DataFrame, requests: DataFrame, limit: int = RECOMMEND_LIMIT,
                  n_seeds: int = RECENT_INTERACTIONS) -> DataFrame:
    """Stage 1 for requesting actors ``requests`` (actor, id_type), as the reference runs it per
    request: peers are all actors with an event on one of the requester's recent products; their
    events on other products are counted, most frequent first (ties by product id), first ``limit``.

    Which peers meet which requests is quadratic by nature; the counts are a product of two matrices,
    worked off in tiles of REQUESTS_PER_TILE requests by about ROWS_PER_TILE (peer, product) rows. A tile
    sums up its peers itself, so no row per pair of a request and a peer is made or shuffled."""
    req = requests.select("actor", "id_type").distinct()
    seeds = recent_interactions(events, n_seeds).join(req, ["actor", "id_type"], "left_semi")
    seeds = materialize(seeds.select("actor", "id_type", "product_id").distinct())
    acts = materialize(events.filter(F.col("product_id").isNotNull()).groupBy(
        F.col("customer_key").alias("peer"), F.col("id_type").alias("peer_type"), "product_id").agg(F.count(F.lit(1)).alias("n")))
    co = co_counts(seeds, acts).join(seeds, ["actor", "id_type", "product_id"], "left_anti")
    w = Window.partitionBy("actor", "id_type").orderBy(F.desc("co_count"), F.asc("product_id"))
    return (co.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
              .select("actor", "id_type", "product_id", "co_count", F.col("pos").cast("bigint").alias("pos")))


def co_counts(seeds: DataFrame, acts: DataFrame) -> DataFrame:
    """(actor, id_type, product_id, co_count): events on a product of all peers that have a seed of the
    actor. ``seeds`` (actor, id_type, product_id) and ``acts`` (peer, peer_type, product_id, n) are distinct and
    materialised."""
    numbered = lambda df, name: materialize(df.distinct().withColumn(name, F.monotonically_increasing_id()))
    asked = numbered(seeds.select("actor", "id_type"), "req")
    products = numbered(acts.select("product_id"), "pid")
    n_req = max(1, -(-asked.count() // REQUESTS_PER_TILE))
    n_peer = max(1, -(-acts.count() // ROWS_PER_TILE))
    own = (seeds.join(products, "product_id").join(asked, ["actor", "id_type"])
           .groupBy("req").agg(F.collect_list("pid").alias("pids")))
    one = (acts.join(products, "product_id").groupBy("peer", "peer_type")
           .agg(F.collect_list(F.struct("pid", "n")).alias("l")).select(
               F.pmod(F.xxhash64("peer", "peer_type"), F.lit(n_peer)).alias("pb"),
               F.col("l.pid").alias("pids"), F.col("l.n").alias("n")))
    tile = ["rb", "pb"]
    own = own.select(F.pmod(F.xxhash64("req"), F.lit(n_req)).alias("rb"),
                     F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_peer - 1).cast("bigint"))).alias("pb"), "req", "pids")
    one = one.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_req - 1).cast("bigint"))).alias("rb"), "pb", "pids", "n")
    n_tiles = n_req * n_peer
    parts = (own.repartition(n_tiles, *tile).groupBy(*tile).cogroup(one.repartition(n_tiles, *tile).groupBy(*tile))
             .applyInPandas(tile_counts, "req long, pid long, n long"))
    sums = parts.groupBy("req", "pid").agg(F.sum("n").alias("co_count"))
    return sums.join(products, "pid").join(asked, "req").select("actor", "id_type", "product_id", "co_count")


def tile_counts(requests: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
    """Of one tile: ``requests`` (req, pids) and ``peers`` (pids, n) -> (req, pid, n), the events of the
    requests' peers by product, CHUNK peers at a time."""
    sums = pd.DataFrame({c: np.empty(0, np.int64) for c in ("req", "pid", "n")})
    if not len(requests) or not len(peers):
        return sums
    vocabulary, seed = np.unique(np.concatenate(requests["pids"].to_numpy()), return_inverse=True)
    n_seeds = requests["pids"].map(len).to_numpy()
    first = np.cumsum(n_seeds) - n_seeds
    held, size = [], 0
    for start in range(0, len(peers), CHUNK):
        some = peers.iloc[start:start + CHUNK]
        length = some["pids"].map(len).to_numpy()
        peer = np.repeat(np.arange(len(some)), length)
        pid, n = np.concatenate(some["pids"].to_numpy()), np.concatenate(some["n"].to_numpy())
        at = np.minimum(np.searchsorted(vocabulary, pid), len(vocabulary) - 1)
        hit = vocabulary[at] == pid
        has = np.zeros((len(vocabulary), len(some)), bool)  # product x peer
        has[at[hit], peer[hit]] = True
        meets = np.logical_or.reduceat(has[seed], first, axis=0)  # request x peer
        columns, column = np.unique(pid, return_inverse=True)
        for r, k, total in products_of(meets, length, column, n, len(columns)):
            held.append(pd.DataFrame({"req": r, "pid": columns[k], "n": total}))
            size += len(r)
            if size > HELD_ROWS:
                sums = pd.concat([sums, *held]).groupby(["req", "pid"], as_index=False)["n"].sum()
                held, size = [], 0
    sums = pd.concat([sums, *held]).groupby(["req", "pid"], as_index=False)["n"].sum()
    return sums.assign(req=requests["req"].to_numpy()[sums["req"]])


def products_of(meets: np.ndarray, length: np.ndarray, column: np.ndarray, n: np.ndarray, n_columns: int):
    """Pieces (request, column, count) of the product of ``meets`` (request x peer) and the peers' counts:
    ``length`` of them each, ``n`` at ``column``. Many meetings: CHUNK columns of a full matrix at a time;
    few: the counts of each meeting are looked up."""
    if meets.sum(0) @ length * 32 > meets.size * n_columns:
        peer, full = np.repeat(np.arange(len(length)), length), meets.astype(float)
        for c in range(0, n_columns, CHUNK):
            part = (column >= c) & (column < c + CHUNK)
            weight = np.zeros((len(length), min(CHUNK, n_columns - c)))  # doubles hold whole numbers up to 2^53
            weight[peer[part], column[part] - c] = n[part]
            total = full @ weight
            r, k = np.nonzero(total)
            yield r, c + k, total[r, k].astype(np.int64)
        return
    r, a = np.nonzero(meets)
    ends, start = np.cumsum(length[a]), np.cumsum(length) - length
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(HELD_ROWS, ends[-1] if len(ends) else 0, HELD_ROWS)), len(a)])
    for i, j in zip(cuts, cuts[1:]):
        each = length[a[i:j]]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[a[i:j]], each)
        yield np.repeat(r[i:j], each), column[at], n[at]


def recommend_for_requests(events: DataFrame, requests: DataFrame, products: DataFrame, rules: DataFrame,
                           itemsets: DataFrame, limit: int = RECOMMEND_LIMIT, n_seeds: int = RECENT_INTERACTIONS) -> DataFrame:
    """(actor, id_type, product_id, stage, rank) for the requesting actors: all four stages. A
    co-occurring product is suggested if it exists."""
    seeds = materialize(recent_interactions(events, n_seeds).join(
        requests.select("actor", "id_type").distinct(), ["actor", "id_type"], "left_semi"))
    known = products.select(F.col("id").cast("string").alias("product_id"))
    peers = co_occurrence(events, requests, limit, n_seeds).join(known, "product_id", "left_semi").select(
        "actor", "id_type", "product_id", F.lit(1).alias("stage"), F.col("pos").cast("int").alias("pos"))
    return _cascade(seeds, products, rules, itemsets, limit, n_seeds, [peers])
