"""Near-duplicate documents by min-max hashing.

1. One pass over the texts gives each document the size and a 128-bit fingerprint of its set of
   five-word shingles and the bands of its min-max signature. Equal sets become one class at once.
2. Classes that share a band are tied to the smallest class in it, and the ties' components are the
   candidate groups: two classes that share any band are in the same group.
3. Each text with company goes once to the task of its group, which finds the links on the full sets
   and returns a spanning forest of them, never pairs. A group of more than ``GROUP`` classes is
   divided by set size (linked sets differ by no more than the similarity allows) and then by hash into blocks; a task has
   two blocks. So no task gets more than two blocks' texts, however many copies there are.
4. The components of the links are the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagekit.llm.components import connected_components
from stagekit.llm.lookup import text_slices
from stagekit.llm.minmax import PERCENT, bands, fingerprint, linked, permutations, shingle_hash_lists, shingle_set, signature
from stagekit.plans.session import fresh, write_table

#: Classes of a group, or of a block of a larger group.
GROUP = 400
SMALL = 12
COLUMNS = 4096


def _sketch(n: int):
    """(doc_id, text) to (doc_id, n_shingles, set_key, bands), by ``n`` permutations."""

    def run(batches):
        for batch in batches:
            for at, end in text_slices(batch.column(1)):
                sets = shingle_hash_lists(batch.column(1).slice(at, end - at))
                keys = [fingerprint(h) if len(h) else None for h in sets]
                rows = [bands(signature(h, n)) if len(h) else np.empty(0, np.int64) for h in sets]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *rows]))
                ids = batch.column(0).slice(at, end - at).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "bands"])

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_sketch(permutations(percent)), "doc_id long, n_shingles long, set_key binary, bands array<long>")


class _Forest(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def forest_of_links(ids: list[int], texts: list[str], sides: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links on full sets that join the classes' components, as a spanning forest."""
    found, forest, n = [], _Forest(), len(ids)
    if n <= SMALL:
        sets = [shingle_set(t) for t in texts]
        for i in range(n):
            for j in range(i):
                if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], percent) and forest.join(i, j):
                    found.append((ids[i], ids[j]))
        return found
    hashes = shingle_hash_lists(pa.array(texts, pa.string()))
    sizes = np.array([len(h) for h in hashes], np.int64)
    every = np.concatenate(hashes)
    owner = np.repeat(np.arange(n), sizes)
    _, place, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[place] > 1  # a shingle of one class alone is in no intersection
    owner, place = owner[shared], place[shared]
    _, place = np.unique(place, return_inverse=True)
    both = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [at, at + COLUMNS])
        x = np.zeros((n, COLUMNS), np.float32)
        x[owner[a:b], place[a:b] - at] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    for i, j in zip(*np.nonzero(np.tril(near, -1))):
        if forest.join(int(i), int(j)):
            found.append((ids[i], ids[j]))
    return found


def _links(percent: int):
    """Rows (task, node, text) sorted by task to links (u, v)."""

    def run(batches):
        task, ids, texts = None, [], []

        def emit():
            found = forest_of_links(ids, texts, percent=percent) if len(ids) > 1 else []
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for t, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task:
                    if task is not None:
                        yield emit()
                    task, ids, texts = t, [], []
                ids.append(i)
                texts.append(x)
        if ids:
            yield emit()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets of a similarity of ``percent`` hundredths or more are linked; bands are as many as that asks for.
    Documents without words have an empty set, stand alone and are kept. An id is one document: rows
    that repeat it are joined, whatever their texts. Null ids are an error of the input: such rows come
    back with component null and kept false (``drop_near_duplicates`` has an answer for both). An empty
    table gives no rows.
    """
    sketched = write_table(sketches(docs, id_col, text_col, percent), "neardup-sketches")
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = write_table(classes, "neardup-classes")
    placed = classes.select("node", F.explode("bands").alias("band"))
    firsts = placed.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    ties = placed.join(firsts.select("band", "first"), "band").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    groups = write_table(connected_components(ties), "neardup-groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    members = groups.join(classes.select("node", "n").groupBy("node").agg(F.max("n").alias("n")), "node").join(sizes, "component")
    small = members.where(F.col("m") <= GROUP).select("node", F.xxhash64("component").alias("task"))
    # larger groups: classes of set size, then blocks
    step = F.floor(F.ln(F.col("n").cast("double")) / F.lit(-math.log(percent / 100) or 1.0)).cast("int")
    large = members.where(F.col("m") > GROUP).select("component", "node", step.alias("step"))
    counts = large.groupBy("component", "step").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP // 2)).cast("int").alias("blocks"))
    ahead = counts.select("component", (F.col("step") - 1).alias("step"), F.col("blocks").alias("blocks_above"))
    below = counts.select("component", (F.col("step") + 1).alias("step"), F.col("blocks").alias("blocks_below"))
    plan = counts.join(ahead, ["component", "step"], "left").join(below, ["component", "step"], "left")
    large = large.join(plan, ["component", "step"])
    large = large.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    seq = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    name = lambda s, i, s2, j: F.xxhash64(F.col("component"), s, i, s2, j)
    s, b = F.col("step"), F.col("block")
    tasks = F.concat(
        F.transform(seq(F.col("blocks")), lambda j: name(s, F.least(b, j), s, F.greatest(b, j))),
        F.transform(seq(F.coalesce("blocks_above", F.lit(0))), lambda j: name(s, b, s + 1, j)),
        F.transform(seq(F.coalesce("blocks_below", F.lit(0))), lambda j: name(s - 1, j, s, b)),
    )
    large = large.select("node", F.explode(tasks).alias("task"))
    assigned = small.unionByName(large)
    # each class is shown by the row of its smallest id: texts move once a task
    shown = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").alias("text"))
    work = assigned.join(shown, "node").select("task", "node", "text")
    work = work.repartition("task").sortWithinPartitions("task", "node")
    links = work.mapInArrow(_links(percent), "u long, v long")
    found = write_table(connected_components(links), "neardup-components")
    of_class = classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    rows = sketched.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component at this similarity: that of its smallest id.

    Rows whose id is null or occurs again stand behind the others, each text by itself: they stay if no
    other row of their component does, the one of them that comes first by a hash of its text; of equal
    rows one stays. A text without words is like no other. An empty table stays so.
    """
    number, own, again = fresh(docs.columns, "row_number", "own", "again")
    key = F.col(f"`{id_col}`").cast("long")
    many = docs.groupBy(key.alias(own)).agg(F.count(F.lit(1)).alias(number)).where((F.col(number) > 1) | F.col(own).isNull()).select(own)
    many = write_table(many, "neardup-repeated")
    marked = docs.join(many.withColumn(again, F.lit(True)), key.eqNullSafe(F.col(own)), "left").drop(own)
    # behind all ids, which of a text is always the same
    behind = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), key), F.lit(1 << 61))
    marked = marked.withColumn(own, F.when(F.col(again), behind).otherwise(key))
    (kept_id,) = fresh(marked.columns, "kept_id")
    kept = near_duplicates(marked.select(own, text_col), own, text_col, percent).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    rows = marked.join(kept, F.col(own) == F.col(kept_id), "left_semi")
    first = Window.partitionBy(own).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    repeated = rows.where(F.col(again)).withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number)
    return rows.where(F.col(again).isNull()).unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)
