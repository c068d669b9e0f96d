"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source starts with the same expected number of copies. Its whole part is certain; the fractions are rounded
by pairs: mass moves from one document to the other, weighted by their sizes, in a random direction that keeps both expectations,
until one of them is integral. The words of a source stay exactly what they were at each step, so only the last document of a
source is left fractional. Chunks of bounded size run in parallel and hand one residual each to the next level of a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD, free_name, numbered, passing, stored

CHUNK = 128
CAP = 3
EXACT = 1e-12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """source, source_size -> also target: all words shared by weight, no source above ``cap`` times its own.

    Sources weigh ``weights`` in turn, by code point, null last. Sharing the excess anew until none is above comes to one level
    for all uncapped sources; those that reach their cap first, by cap per weight, are the capped ones. One row per source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(by_cap), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))))
    # The level rises while sources are capped and falls after; the uncapped sources share the first one that caps no more.
    rows = rows.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything))
    return rows.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _coin(*parts) -> Column:
    """Uniform in [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def _settle(carry: Column, item: Column, seed: int) -> Column:
    """One pivotal step: what is decided (a row with 0 or 1 more copies) and what goes on."""
    a, b = carry["p"] * carry["size"], item["p"] * item["size"]
    up = F.least(carry["size"] - a, b)      # carry grows, item shrinks
    down = F.least(a, item["size"] - b)     # carry shrinks, item grows
    grow = _coin(carry["key"], item["key"], F.lit(seed)) < down / (up + down)
    moved = F.when(grow, up).otherwise(-down)
    new_a, new_b = (a + moved) / carry["size"], (b - moved) / item["size"]
    carry_done = F.least(new_a, 1 - new_a) <= F.least(new_b, 1 - new_b)

    def row(x, p):
        return F.struct(x["row"].alias("row"), x["key"].alias("key"), x["size"].alias("size"), p.alias("p"))

    decided = F.when(carry_done, row(carry, F.round(new_a))).otherwise(row(item, F.round(new_b)))
    # Rounding moves less than a billionth of a word; the rest keeps its place between 0 and 1.
    rest = F.when(carry_done, row(item, F.least(F.greatest(new_b, F.lit(0.0)), F.lit(1.0)))).otherwise(row(carry, F.least(F.greatest(new_a, F.lit(0.0)), F.lit(1.0))))
    return F.struct(decided.alias("decided"), rest.alias("rest"))


#: Documents of a source whose copies may change by one at the end, one after the other.
CORRECTIONS = 4
ITEM = "struct<row:bigint,key:bigint,size:double,p:double>"


def _round_chunk(items: Column, seed: int) -> Column:
    """(done: decided rows, rest: the fractional one or null) of one chunk."""
    def step(state: Column, item: Column) -> Column:
        settled = _settle(state["rest"], item, seed)
        integral = (item["p"] <= EXACT) | (item["p"] >= 1 - EXACT)
        fixed = F.struct(item["row"].alias("row"), item["key"].alias("key"), item["size"].alias("size"), F.round(item["p"]).alias("p"))
        free = state["rest"].isNull() | (state["rest"]["p"] <= EXACT) | (state["rest"]["p"] >= 1 - EXACT)
        held = F.when(state["rest"].isNull(), F.array().cast(f"array<{ITEM}>")).otherwise(
            F.array(F.struct(state["rest"]["row"].alias("row"), state["rest"]["key"].alias("key"), state["rest"]["size"].alias("size"), F.round(state["rest"]["p"]).alias("p"))))
        return (F.when(integral, F.struct(F.concat(state["done"], F.array(fixed)).alias("done"), state["rest"].alias("rest")))
                .when(free, F.struct(F.concat(state["done"], held).alias("done"), item.alias("rest")))
                .otherwise(F.struct(F.concat(state["done"], F.array(settled["decided"])).alias("done"), settled["rest"].alias("rest"))))

    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("done"), F.lit(None).cast(ITEM).alias("rest"))
    return F.aggregate(items, start, step)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: int = 17, row_column: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies per row of ``docs``; taken = copies * size.

    A null source is a source; null, empty and wordless texts have size 0 and no copies. Rows that repeat an id are rows of their own.
    No document is taken more than ``cap`` times. Reruns agree under any partitioning: coins and chunks are hashes of ids, sizes and texts.
    The last fractional document of a source is rounded to the nearer side; then up to ``CORRECTIONS`` documents of a source, one
    after the other, have their copies changed by one where that comes closer to the target.
    """
    columns = [F.col(id_column).cast("long").alias("doc_id"), size_of(F.col(text_column)).alias("size"), F.col(source_column).cast("string").alias("source"), F.xxhash64(text_column).alias("mark")]
    rows = numbered(docs.select(*columns), "sizes") if row_column is None else stored(docs.select(*columns, F.col(row_column).alias("_row")), "sizes")
    shares = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).drop("n"), weights, cap), "targets")
    wanted = rows.join(shares.select(F.col("source").alias("_source"), "source_size", "target"), rows.source.eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = wanted.withColumn("whole", F.floor(ratio + EXACT).cast("long")).withColumn("p", F.greatest(ratio - F.col("whole"), F.lit(0.0)))
    # Rows that agree in id, size and text are told apart by a running number: any of them may have any of their numbers.
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "size", "mark").orderBy("_row"))
    wanted = stored(wanted.withColumn("key", F.xxhash64("doc_id", "size", "mark", nth, F.lit(seed))).drop("mark"), "wanted")
    key = F.col("key")
    items = wanted.where("size > 0").select("source", F.struct(F.col("_row").alias("row"), key.alias("key"), F.col("size").cast("double").alias("size"), "p").cast(ITEM).alias("item"))
    counts = items.groupBy("source").count()
    largest = counts.agg(F.max("count")).first()[0] or 0

    done, level = [], 0
    while largest:
        level += 1
        chunks = F.ceil(F.col("count") / CHUNK)
        named = counts.withColumnRenamed("source", "_source")
        dealt = items.join(named, items.source.eqNullSafe(F.col("_source"))).select(
            "source", F.pmod(F.xxhash64("item.key", F.lit(seed + level)), chunks).alias("chunk"), "item")
        packed = dealt.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct("item.key", "item"))).alias("items"))
        rounded = stored(packed.select("source", _round_chunk(F.transform("items", lambda x: x["item"]), seed + level).alias("r")), "rounded")
        done.append(rounded.select("source", F.explode("r.done").alias("item")))
        items = rounded.where("r.rest IS NOT NULL").select("source", F.col("r.rest").alias("item"))
        counts = items.groupBy("source").count()
        before, largest = largest, counts.agg(F.max("count")).first()[0] or 0
        if largest <= 1 or largest >= before:
            break
    done.append(items.withColumn("item", F.struct(F.col("item.row").alias("row"), F.col("item.key").alias("key"), F.col("item.size").alias("size"), F.round("item.p").alias("p")).cast(ITEM)))
    extra = done[0]
    for more in done[1:]:
        extra = extra.unionByName(more)
    extra = extra.select(F.col("item.row").alias("_row"), F.col("item.p").cast("long").alias("extra"))
    taken = stored(wanted.join(extra, "_row", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
                   .select("_row", "doc_id", "source", "size", "source_size", "target", "copies", "key", F.lit(False).alias("moved")), "copies")
    for _ in range(CORRECTIONS):
        taken = stored(_corrected(taken, cap), "copies")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "_row")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, whatever their names; options as for ``mix``."""
    row = free_name(docs, "_row")
    with passing() as keep:
        table = keep(numbered(docs, "documents", row, "zstd"))
        times, copy = free_name(table, "_copies"), free_name(table, "_copy")
        copies = keep(stored(mix(table, row_column=row, **options).where("copies > 0").select(F.col("_row").alias(row), F.col("copies").alias(times)), "taken"))
    return table.join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)


def _corrected(taken: DataFrame, cap: int) -> DataFrame:
    """Change the copies of at most one more document per source by one, where that brings the source closer to its target."""
    off = taken.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("missing")).withColumnRenamed("source", "_source")
    near = taken.join(off, taken.source.eqNullSafe(F.col("_source")))
    left = F.when((F.col("missing") > 0) & (F.col("copies") < cap), F.abs(F.col("missing") - F.col("size"))).when(
        (F.col("missing") < 0) & (F.col("copies") > 0), F.abs(F.col("missing") + F.col("size")))
    near = near.where((F.col("size") > 0) & ~F.col("moved")).withColumn("left", left).where(F.col("left") < F.abs("missing"))
    best = near.groupBy("_source").agg(F.min(F.struct("left", "doc_id", "key", "_row", F.signum("missing").cast("long").alias("change"))).alias("best"))
    best = best.select(F.col("best._row").alias("_row"), F.col("best.change").alias("change"))
    changed = taken.join(best, "_row", "left")
    return changed.select(*[c for c in taken.columns if c not in ("copies", "moved")], (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"), (F.col("moved") | F.col("change").isNotNull()).alias("moved"))
