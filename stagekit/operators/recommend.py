"""Recommendation: indexing, item similarity (SAR), ranking metrics, splits."""

from __future__ import annotations

import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagekit.base import Fitted
from stagekit.plans.session import fresh, write_table

#: Items of a user that one task pairs with the others.
USER_ITEMS = 1_000
#: Pairs of similar items up to which every worker holds them all (24 bytes each).
SMALL = 2_000_000
#: Pairs of items that a task counts at once.
PAIRS = 4_000_000
#: Affinities and pairs of similar items of a tile.
ENTRIES, TILE = 2_000_000, 4_000_000


def index_by_frequency(df: DataFrame, col: str, output_col: str) -> DataFrame:
    """(value, index): 0-based, most frequent first, ties by value."""
    from stagekit.operators.columns import zip_with_index

    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg((-F.count(F.lit(1))).alias("_n"))
    return zip_with_index(counts, output_col, order_by=["_n", col]).drop("_n")


def recommendation_indexer(df: DataFrame, user_col: str, item_col: str, user_out: str = "user_index", item_out: str = "item_index") -> Fitted:
    """Users and items to indexes by frequency; ``recover_ids`` turns them back."""
    users, items = index_by_frequency(df, user_col, user_out), index_by_frequency(df, item_col, item_out)
    return Fitted(index_ids, {"users": users, "items": items}, user_col=user_col, item_col=item_col)


def index_ids(d: DataFrame, users: DataFrame, items: DataFrame, user_col: str, item_col: str) -> DataFrame:
    return d.join(users, user_col, "left").join(items, item_col, "left")


def recover_ids(d: DataFrame, fitted: Fitted) -> DataFrame:
    """Index columns back to the ids as texts; -1 for an index that is none."""
    for table, key in ((fitted.users, fitted.user_col), (fitted.items, fitted.item_col)):
        (index,) = [c for c in table.columns if c != key]
        (name,) = fresh([*d.columns, *table.columns], "found")
        d = d.join(table.withColumnRenamed(key, name), index, "left").withColumn(key, F.coalesce(F.col(name).cast("string"), F.lit("-1"))).drop(name)
    return d


def sar_affinity(events: DataFrame, user_col: str, item_col: str, rating_col: str | None = None, time_col: str | None = None, now: Column | None = None, half_life_days: float = 30.0) -> DataFrame:
    """(user, item, affinity): sum of ratings, halved for every half life that an event is old, in whole minutes."""
    value = F.col(rating_col).cast("double") if rating_col else F.lit(1.0)
    if time_col:
        stamp = F.unix_millis(F.col(time_col).cast("timestamp"))
        latest = now if now is not None else F.lit(events.agg(F.max(stamp)).first()[0])
        minutes = F.floor((latest - stamp) / 60000)
        value = value * F.pow(F.lit(2.0), -minutes / (half_life_days * 1440))
    return events.groupBy(F.col(user_col).alias("user"), F.col(item_col).alias("item")).agg(F.sum(value).alias("affinity"))


def sar_similarity(events: DataFrame, user_col: str, item_col: str, kind: str = "jaccard", support: int = 4) -> DataFrame:
    """(a, b, similarity) in long form, for items with at least ``support`` users in common.

    Users are distinct per item. Workers make the pairs of each user (a <= b) as numbers, add up equal ones
    and hand on compressed counts, dealt by a hash of the pair so that no item gathers in one task; each pair
    is mirrored after counting. Users lie in ranges of their ids: where neighbours share items, most pairs
    are added up before they move. The pairs of a user with many items are made by several tasks, each for
    some of the first items.
    """
    if kind not in ("jaccard", "lift", "cooccurrence"):
        raise ValueError(f"unknown similarity {kind}")
    from stagekit.operators.columns import zip_with_index

    pairs = write_table(events.select(F.col(user_col).alias("u"), F.col(item_col).alias("i")).where("u IS NOT NULL AND i IS NOT NULL").distinct(), "sar-pairs")
    # places in the order of the items
    items = zip_with_index(pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "x", order_by=["i"])
    places = items.select("i", F.col("x").cast("int").alias("x"))
    sizes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("m"))
    total, most, n_items = (x or 0 for x in sizes.agg(F.sum(F.expr("m * (m + 1) div 2")), F.max("m")).crossJoin(items.agg(F.count(F.lit(1)))).first())
    dealt = pairs.join(places, "i").select("u", "x")
    if most > USER_ITEMS:
        heavy = sizes.where(F.col("m") > USER_ITEMS).select("u", F.ceil(F.col("m") / USER_ITEMS).cast("int").alias("parts"))
        dealt = dealt.join(heavy, "u", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.select("u", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("own"))
    else:
        dealt = dealt.select("u", "x", F.lit(0).alias("part"), F.lit(0).alias("own"))
    wide = max(2 * events.sparkSession.sparkContext.defaultParallelism, -(-total // (8 * PAIRS)))
    first, second = F.collect_list(F.when(F.col("own") == F.col("part"), F.col("x"))), F.collect_list("x")
    lists = dealt.repartitionByRange(wide, "u", "part").groupBy("u", "part").agg(F.sort_array(first).alias("a"), F.sort_array(second).alias("b"))
    blocks = max(1, -(-2 * total // PAIRS))
    counts = lists.select("a", "b").mapInArrow(_counting(n_items, blocks), "block int, codes binary, counts binary")
    counts = counts.repartition(blocks, "block").groupBy("block").applyInArrow(_adding(n_items, support), "x int, y int, c long")
    of = lambda x, i, n: items.select(F.col("x").cast("int").alias(x), F.col("i").alias(i), F.col("n").alias(n))
    both = counts.join(of("x", "a", "na"), "x").join(of("y", "b", "nb"), "y")
    value = {"jaccard": F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), "lift": F.col("c") / (F.col("na") * F.col("nb")), "cooccurrence": F.col("c").cast("double")}[kind]
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    ways = F.when(F.col("x") == F.col("y"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    return both.select(F.explode(ways).alias("p"), value.alias("similarity")).select("p.a", "p.b", "similarity")


def _packed(x: np.ndarray) -> bytes:
    """Numbers with their like bytes side by side, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts[order], first) if len(first) else counts[order]


def _counting(n_items: int, blocks: int):
    """Lists of first and of second items, ascending, to counts of their pairs: ``PAIRS`` of them at a time."""

    def dealt(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        block = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        codes, counts = codes[order], counts[order]
        bounds = np.searchsorted(block[order], np.arange(blocks + 1))
        used = np.flatnonzero(np.diff(bounds))
        parts = [slice(bounds[i], bounds[i + 1]) for i in used]
        packed = [pa.array([_packed(x) for x in found], pa.binary()) for found in ((np.diff(codes[p], prepend=0) for p in parts), (counts[p] for p in parts))]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *packed], names=["block", "codes", "counts"])

    def run(batches):
        fresh_, n_fresh, known = [], 0, (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            owner = np.repeat(np.arange(len(a)), a.value_lengths().to_numpy(zero_copy_only=False))
            size = b.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            a, b = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
            # the second items of a row from the first item on
            start = np.searchsorted(np.repeat(np.arange(len(size)), size) * n_items + b, owner * n_items + a)
            many = ends[owner] - start
            upto = np.cumsum(many)
            at = 0
            while at < len(a):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                n = many[at:end]
                place = np.arange(int(n.sum())) + np.repeat(start[at:end] - (np.cumsum(n) - n), n)
                fresh_.append(np.repeat(a[at:end] * n_items, n) + b[place])
                n_fresh, at = n_fresh + len(place), end
                if n_fresh >= PAIRS:
                    codes, counts = np.unique(np.concatenate(fresh_), return_counts=True)
                    known = _added(np.concatenate([known[0], codes]), np.concatenate([known[1], counts]))
                    fresh_, n_fresh = [], 0
                    if len(known[0]) >= PAIRS // 2:
                        yield dealt(*known)
                        known = (np.empty(0, np.int64), np.empty(0, np.int64))
        codes, counts = np.unique(np.concatenate([np.empty(0, np.int64), *fresh_]), return_counts=True)
        known = _added(np.concatenate([known[0], codes]), np.concatenate([known[1], counts]))
        if len(known[0]):
            yield dealt(*known)

    return run


def _adding(n_items: int, support: int):
    """All counts of some pairs to those with ``support``."""

    def run(table: pa.Table) -> pa.Table:
        codes, counts = ([_unpacked(x) for x in table[c].to_pylist()] for c in ("codes", "counts"))
        codes, counts = _added(np.concatenate([np.cumsum(x) for x in codes]), np.concatenate(counts))
        codes, counts = codes[counts >= support], counts[counts >= support]
        return pa.table({"x": pa.array(codes // n_items, pa.int32()), "y": pa.array(codes % n_items, pa.int32()), "c": pa.array(counts, pa.int64())})

    return run


def sar_recommend(affinity: DataFrame, similarity: DataFrame, k: int, users: DataFrame | None = None, drop_seen: bool = False) -> DataFrame:
    """(user, rank, item, score): affinity times similarity, the ``k`` best of each user, ties to the smaller item.

    A similarity of up to ``SMALL`` pairs goes to every worker, which multiplies user by user; a larger
    one is multiplied in tiles.
    """
    wanted = affinity.join(users, "user", "left_semi") if users is not None else affinity
    similarity = write_table(similarity.select("a", "b", "similarity"), "sar-similarity")
    n_pairs = similarity.count()
    if n_pairs <= SMALL:
        return _multiplied(wanted, similarity, k, drop_seen)
    return top_k(_tiled(wanted, similarity, n_pairs, k, drop_seen), "user", k)


def _tiled(affinity: DataFrame, similarity: DataFrame, n_pairs: int, k: int, drop_seen: bool) -> DataFrame:
    """(user, item, score): the ``k`` best of each user among the items of each tile.

    A tile is a range of users (``ENTRIES`` rows) by a range of items to show (``TILE`` pairs), so it has
    whole sums of its users and items, and only the ``k`` best leave it. Users go to tiles that show one of
    theirs something, pairs to tiles with users of their first item: no row is made for a user and a pair.
    """
    affinity = write_table(affinity.select("user", "item", F.coalesce("affinity", F.lit(0.0)).alias("affinity")), "sar-affinity")
    n, wide = affinity.count(), 2 * affinity.sparkSession.sparkContext.defaultParallelism
    # smaller groups than memory asks for, as long as tasks are fewer than cores
    groups, ranges = max(1, -(-n // ENTRIES), min(wide, -(-8 * n // ENTRIES))), max(1, -(-n_pairs // TILE))
    owned = F.sort_array(F.collect_list(F.struct("item", "affinity")))
    owned = affinity.repartitionByRange(groups, "user").groupBy("user").agg(owned.alias("all"))
    owned = write_table(owned.select("user", F.col("all")["item"].alias("items"), F.col("all")["affinity"].alias("weights"), F.spark_partition_id().alias("g")), "sar-users")
    item, value = (similarity.schema[c].dataType.simpleString() for c in ("b", "similarity"))
    shown = similarity.repartitionByRange(ranges, "b").withColumn("h", F.spark_partition_id())
    shown = write_table(shown.mapInArrow(_rows_of_items, f"a {item}, h int, others array<{item}>, values array<{value}>"), "sar-rows")
    has = owned.select("g", F.explode("items").alias("a")).distinct()
    tiles = has.join(shown.select("a", "h"), "a").select(F.col("g").alias("tg"), F.col("h").alias("th")).distinct()
    left = owned.join(tiles, F.col("g") == F.col("tg")).select("tg", "th", "user", "items", "weights")
    right = has.join(shown, "a").select(F.col("g").alias("rg"), F.col("h").alias("rh"), "a", "others", "values")
    user = affinity.schema["user"].dataType.simpleString()

    def run(mine: pa.Table, rows: pa.Table) -> pa.Table:
        mine, rows = mine.combine_chunks(), rows.combine_chunks()
        column = lambda t, name: t[name].chunk(0) if t[name].num_chunks == 1 else t[name].combine_chunks()
        empty = pa.table({"user": mine["user"].slice(0, 0), "item": column(rows, "others").flatten().slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(mine) or not len(rows):
            return empty
        others = column(rows, "others").flatten().dictionary_encode()
        order = pc.sort_indices(others.dictionary)
        names = others.dictionary.take(order)
        turned = np.empty(len(order), np.int64)
        turned[order.to_numpy()] = np.arange(len(order))
        cols = turned[others.indices.to_numpy(zero_copy_only=False)]
        values = column(rows, "values").flatten().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(column(rows, "others").value_lengths().to_numpy(zero_copy_only=False))])
        items, sizes = column(mine, "items").flatten(), column(mine, "items").value_lengths().to_numpy(zero_copy_only=False)
        find = lambda where: pc.index_in(items, value_set=where).fill_null(-1).to_numpy(zero_copy_only=False)
        row, seen = find(column(rows, "a")), find(names) if drop_seen else None
        weights = column(mine, "weights").flatten().to_numpy(zero_copy_only=False)
        ends, n = np.cumsum(sizes), len(names)
        who, what, scores = [], [], []
        for u, (begin, end) in enumerate(zip(ends - sizes, ends)):
            known = row[begin:end] >= 0
            i = row[begin:end][known]
            many = first[i + 1] - first[i]
            at = np.arange(int(many.sum())) + np.repeat(first[i] - (np.cumsum(many) - many), many)
            there = np.bincount(cols[at], minlength=n) > 0
            score = np.bincount(cols[at], values[at] * np.repeat(weights[begin:end][known], many), n)
            if drop_seen:
                there[seen[begin:end][seen[begin:end] >= 0]] = False
            there = np.flatnonzero(there)
            best = there[np.lexsort((there, -score[there]))[:k]]
            who.append(np.full(len(best), u))
            what.append(best)
            scores.append(score[best])
        who, what, scores = (np.concatenate(x) for x in (who, what, scores))
        return pa.table({"user": mine["user"].take(pa.array(who)), "item": names.take(pa.array(what)), "score": pa.array(scores)})

    dealt = max(wide, groups)
    left, right = left.repartition(dealt, "tg", "th"), right.repartition(dealt, "rg", "rh")
    return left.groupBy("tg", "th").cogroup(right.groupBy("rg", "rh")).applyInArrow(run, f"user {user}, item {item}, score double")


def _rows_of_items(batches):
    """Pairs of one range of second items to a row a first item, with the lists of those and their values."""
    table = pa.Table.from_batches(held) if (held := list(batches)) else None
    if table is None or not len(table):
        return
    table = table.sort_by([("a", "ascending"), ("b", "ascending")]).combine_chunks()
    a = table["a"].chunk(0)
    first = pa.concat_arrays([pa.array([True]), pc.not_equal(a.slice(1), a.slice(0, len(a) - 1))])
    starts = np.flatnonzero(first.to_numpy(zero_copy_only=False))
    offsets = pa.array(np.append(starts, len(a)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, table[c].chunk(0)) for c in ("b", "similarity")]
    out = pa.RecordBatch.from_arrays([a.take(pa.array(starts)), table["h"].chunk(0).take(pa.array(starts)), *lists], names=["a", "h", "others", "values"])
    for at in range(0, len(out), 1000):
        yield out.slice(at, 1000)


def _multiplied(affinity: DataFrame, similarity: DataFrame, k: int, drop_seen: bool) -> DataFrame:
    pairs = similarity.select("a", "b", "similarity").toArrow()  # at most SMALL rows
    a, b = (pairs[c].to_pylist() for c in "ab")
    items = sorted({*a, *b})
    place = {x: i for i, x in enumerate(items)}
    rows, cols = (np.fromiter((place[x] for x in side), np.int64, len(side)) for side in (a, b))
    order = np.argsort(rows, kind="stable")
    first = np.searchsorted(rows[order], np.arange(len(items) + 1))
    known = affinity.sparkSession.sparkContext.broadcast((items, place, first, cols[order], pairs["similarity"].to_numpy()[order]))
    kind = affinity.schema["item"].dataType.simpleString()

    def run(column: pa.Array) -> pa.Array:
        names, index, first, cols, values = known.value
        out = []
        for row in column.to_pylist():
            seen = [(index[x["item"]], x["affinity"]) for x in row if x["item"] in index]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i, _ in seen] or [np.empty(0, np.int64)])
            weight = np.repeat([w for _, w in seen], [first[i + 1] - first[i] for i, _ in seen])
            score = np.bincount(cols[at], values[at] * weight, len(names))
            there = np.flatnonzero(np.bincount(cols[at], minlength=len(names)))
            if drop_seen:
                there = np.setdiff1d(there, [i for i, _ in seen])
            best = there[np.lexsort((there, -score[there]))[:k]]
            out.append([{"rank": n + 1, "item": names[i], "score": float(score[i])} for n, i in enumerate(best.tolist())])
        item = pa.array(names[:1]).type if names else pa.int64()
        return pa.array(out, pa.list_(pa.struct([("rank", pa.int32()), ("item", item), ("score", pa.float64())])))

    lists = affinity.groupBy("user").agg(F.collect_list(F.struct("item", "affinity")).alias("all"))
    found = lists.select("user", F.explode(F.arrow_udf(run, f"array<struct<rank:int,item:{kind},score:double>>")("all")).alias("r"))
    return found.select("user", "r.rank", "r.item", "r.score")


def top_k(scores: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), "item")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "item", "score")


def rank_lists(ratings: DataFrame, user_col: str, item_col: str, rating_col: str, k: int) -> DataFrame:
    """(user, items): the items of rank up to ``k`` by rating, ties by item."""
    order = Window.partitionBy(user_col).orderBy(F.desc(rating_col), item_col)
    first = ratings.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= k)
    return first.groupBy(user_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", item_col))), lambda x: x[item_col]).alias("items"))


def _hits(k: int):
    p, label = F.slice(F.col("prediction"), 1, k), F.col("label")
    return F.transform(p, lambda x: F.array_contains(label, x).cast("int"))


def ranking_metrics(df: DataFrame, k: int = 10, n_items: int = -1) -> DataFrame:
    """One row of metrics over (prediction array, label array) rows.

    map, ndcgAt, precisionAtk as in the literature; recallAtK is distinct hits over the length of the
    prediction (``recallAtKTrue``: over the label's); diversityAtK distinct recommended items over
    ``n_items``; mrr the mean reciprocal rank of the first hit; fcp the share of places that agree.
    """
    df = write_table(df.select("prediction", "label"), "ranking-lists")  # read three times
    p, label = F.col("prediction"), F.col("label")
    gain = lambda i: F.lit(1.0) / F.log2(i + F.lit(2.0))
    zero = F.lit(0.0)
    hits, all_hits = _hits(k), F.transform(p, lambda x: F.array_contains(label, x).cast("int"))
    dcg = F.aggregate(F.transform(hits, lambda h, i: h * gain(i)), zero, lambda a, x: a + x)
    ideal = F.aggregate(F.transform(F.slice(label, 1, k), lambda _, i: gain(i)), zero, lambda a, x: a + x)
    ap = F.aggregate(
        all_hits, F.struct(zero.alias("s"), F.lit(0).alias("n"), F.lit(0).alias("i")),
        lambda a, h: F.struct((a["s"] + F.when(h == 1, (a["n"] + 1) / (a["i"] + 1)).otherwise(0.0)).alias("s"), (a["n"] + h).alias("n"), (a["i"] + 1).alias("i")),
        lambda a: a["s"],
    )
    first = F.array_position(all_hits, 1)
    agree = F.size(F.filter(F.zip_with(p, label, lambda x, y: x.eqNullSafe(y)), lambda e: e))
    size = F.size(p)
    per = df.select(
        F.coalesce(F.try_divide(ap, F.size(label)), zero).alias("map"),
        F.coalesce(F.try_divide(dcg, ideal), zero).alias("ndcgAt"),
        (F.aggregate(hits, F.lit(0), lambda a, x: a + x) / F.lit(float(k))).alias("precisionAtk"),
        F.coalesce(F.try_divide(F.size(F.array_intersect(p, label)), size), zero).alias("recallAtK"),
        F.coalesce(F.try_divide(F.size(F.array_intersect(p, label)), F.size(label)), zero).alias("recallAtKTrue"),
        F.when(first > 0, F.lit(1.0) / first).otherwise(0.0).alias("mrr"),
        F.coalesce(F.try_divide(agree.cast("double"), F.greatest(size, F.size(label))), zero).alias("fcp"),
    )
    means = per.agg(*[F.avg(c).alias(c) for c in per.columns])
    shown = df.select(F.explode("prediction").alias("x")).agg(F.count_distinct("x").alias("d"))
    every = df.select(F.explode(F.concat("prediction", "label")).alias("x")).agg(F.count_distinct("x").alias("e"))
    n = F.lit(float(n_items)) if n_items > 0 else F.col("e").cast("double")
    return means.crossJoin(shown).crossJoin(every).select(*per.columns, F.try_divide(F.col("d"), n).alias("diversityAtK"), F.try_divide(F.col("e"), n).alias("maxDiversity"))


def ranking_split(df: DataFrame, user_col: str, item_col: str, ratio: float = 0.75, min_ratings_user: int = 1, min_ratings_item: int = 1, seed: int = 0) -> DataFrame:
    """Distinct (user, item) rows with ``is_train``: a share ``ratio`` of each user's items in a hashed order."""
    rows = df.dropDuplicates([user_col, item_col])
    by_user, by_item = Window.partitionBy(user_col), Window.partitionBy(item_col)
    rows = rows.withColumns({"_nu": F.count(F.lit(1)).over(by_user), "_ni": F.count(F.lit(1)).over(by_item)})
    rows = rows.where((F.col("_nu") >= min_ratings_user) & (F.col("_ni") >= min_ratings_item))
    order = by_user.orderBy(F.xxhash64(user_col, item_col, F.lit(seed)), item_col)
    place, n = F.row_number().over(order), F.count(F.lit(1)).over(by_user)
    return rows.withColumn("is_train", place <= F.round(n * ratio)).drop("_nu", "_ni")


def ranking_adapter(train: DataFrame, test: DataFrame, recommend, user_col: str, item_col: str, rating_col: str, k: int = 10) -> DataFrame:
    """(user, prediction, label): what ``recommend(train, k)`` (user, rank, item) shows each user of the test part, and what they chose."""
    found = recommend(train, k).select(F.col("user").alias(user_col), "rank", "item")
    lists = found.groupBy(user_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("prediction"))
    actual = rank_lists(test, user_col, item_col, rating_col, k).withColumnRenamed("items", "label")
    return lists.join(actual, user_col).select(F.col(user_col).alias("user"), "prediction", "label")


def sar_recommender(user_col: str, item_col: str, rating_col: str | None = None, kind: str = "jaccard", support: int = 4, drop_seen: bool = True):
    """SAR as a ``recommend(train, k)`` of ``ranking_adapter``."""

    def recommend(train: DataFrame, k: int) -> DataFrame:
        affinity = sar_affinity(train, user_col, item_col, rating_col)
        return sar_recommend(affinity, sar_similarity(train, user_col, item_col, kind, support), k, drop_seen=drop_seen)

    return recommend


def als_recommender(user_col: str, item_col: str, rating_col: str, **options):
    """Alternating least squares over integer ids as a ``recommend(train, k)``."""

    def recommend(train: DataFrame, k: int) -> DataFrame:
        from pyspark.ml.recommendation import ALS

        als = ALS(userCol=user_col, itemCol=item_col, ratingCol=rating_col, **options)
        found = als.fit(train).recommendForAllUsers(k)
        each = found.select(F.col(user_col).alias("user"), F.posexplode("recommendations").alias("place", "r"))
        return each.select("user", (F.col("place") + 1).alias("rank"), F.col("r")[item_col].alias("item"))

    return recommend


def ranking_train_validation(
    ratings: DataFrame, candidates: list, user_col: str, item_col: str, rating_col: str, metric: str = "ndcgAt", k: int = 10, ratio: float = 0.75, min_ratings_user: int = 1,
    min_ratings_item: int = 1, seed: int = 0, parallelism: int = 4,
) -> tuple[int, list[float], DataFrame]:
    """The best of several ``recommend(train, k)`` by a ranking metric over held-out ratings.

    Gives its place, all values, and its recommendations from all ratings. Runs go side by side.
    """
    split = ranking_split(ratings, user_col, item_col, ratio, min_ratings_user, min_ratings_item, seed)
    split = write_table(split, "ranking-split")
    train, test = (split.where(c).drop("is_train") for c in ("is_train", "NOT is_train"))

    def value(candidate) -> float:
        return ranking_metrics(ranking_adapter(train, test, candidate, user_col, item_col, rating_col, k), k).first()[metric] or 0.0

    with ThreadPoolExecutor(parallelism) as pool:
        values = list(pool.map(value, candidates))
    best = max(range(len(values)), key=lambda i: values[i])
    return best, values, candidates[best](ratings, k)
