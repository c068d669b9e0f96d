"""Choosing among alternative date readings so that a book runs forward in time.

A shortest path over the pages of a book: the state is the candidate date of a page, the cost
is (backward steps, changed parts, days jumped) compared in that order. Only books that run
backwards and have a choice reach Python. Of a book in several segments each segment yields the
cost from every entry date to every exit date, the small per-book chain of segments is solved,
and the segments are then traced with their entry and exit fixed.
"""

from __future__ import annotations

from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.dates import month_end
from foliant.operators.books import PAGE_ID
from foliant.operators.segments import SEGMENT, Segments
from foliant.session import save, shuffle_partitions

ORDER = ["log_no", *reversed(PAGE_ID)]
PARTS = ("day", "month", "year")


def _options(field: str) -> Column:
    """Distinct normalised values of a part: the reading first, then its alternatives."""
    listed = F.concat(F.array(F.col(field + "_n")), F.col(field + "_alts"))
    return F.when(F.col(field + "_has"), F.array_distinct(F.array_compact(listed))).otherwise(F.array().cast("array<int>"))


def _candidates() -> Column:
    """Valid dates a page can stand for: struct(date, day, month, year, changes)."""
    def differs(field: str, value: Column) -> Column:
        return (~F.col(field + "_n").eqNullSafe(value)).cast("int")

    def of_date(d: Column, m: Column, y: Column) -> Column:
        valid = d <= month_end(y + 2000, m)
        return F.when(valid, F.struct(
            F.unix_date(F.make_date(y + 2000, m, F.when(valid, d))).alias("date"), d.alias("day"), m.alias("month"), y.alias("year"),
            (differs("day", d) + differs("month", m) + differs("year", y)).alias("changes")))

    every = F.flatten(F.transform(F.col("_days"), lambda d: F.flatten(F.transform(
        F.col("_months"), lambda m: F.transform(F.col("_years"), lambda y: of_date(d, m, y))))))
    return F.array_compact(every)


def _step(states: list, candidates: list) -> tuple[list, list]:
    """Best cost of reaching each candidate, and the index of the state it came from."""
    scores, origins = [], []
    for c in candidates:
        best = origin = None
        for i, (date, (back, changes, jumps)) in enumerate(states):
            cost = (back + (c["date"] < date), changes + c["changes"], jumps + abs(c["date"] - date))
            if best is None or cost < best:
                best, origin = cost, i
        scores.append((c["date"], best))
        origins.append(origin)
    return scores, origins


def _walk(rows: list, entry: list | None) -> tuple[list, list]:
    """Costs at the last row and the origin indexes of every row."""
    trail = []
    states = entry
    for candidates in rows:
        if states is None:
            states, origins = [(c["date"], (0, c["changes"], 0)) for c in candidates], [None] * len(candidates)
        else:
            states, origins = _step(states, candidates)
        trail.append(origins)
    return states, trail


def _first_min(states: list) -> int:
    return min(range(len(states)), key=lambda i: states[i][1])


def _trace(trail: list, end: int) -> list:
    path = []
    for origins in reversed(trail):
        path.append(end)
        end = origins[end]
    return path[::-1]


CHOICE = "file_seq long, page_number long, c_day int, c_month int, c_year int"
_CHOICE = dict(zip(("file_seq", "page_number", "c_day", "c_month", "c_year"), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())))


def _made(found, types: dict):
    """Batches of the tuples of ``found``."""
    while chunk := list(islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*chunk), types.values())], list(types))


def _groups(batches, *keys: str):
    """Rows that follow each other with the same keys, as lists of dictionaries."""
    for _, rows in groupby((r for batch in batches for r in batch.to_pylist()), key=lambda r: tuple(r[k] for k in keys)):
        yield list(rows)


def _moves(rows: list, path: list):
    for page, i in zip(rows, path):
        c = page["candidates"][i]
        if c["changes"]:
            yield page["file_seq"], page["page_number"], c["day"], c["month"], c["year"]


def _solve_books(batches):
    """Whole books, one after the other, in batches sorted by book and page."""
    def moved():
        for pages in _groups(batches, "book"):
            states, trail = _walk([p["candidates"] for p in pages], None)
            end = _first_min(states)
            if states[end][1][0] < pages[0]["backward"]:
                yield from _moves(pages, _trace(trail, end))

    return _made(moved(), _CHOICE)


STATES = "array<struct<date:int,back:long,changes:long,jumps:long>>"
_STATES = pa.list_(pa.struct([("date", pa.int32()), ("back", pa.int64()), ("changes", pa.int64()), ("jumps", pa.int64())]))
_KEY = {"book": pa.string(), "_chunk": pa.int32()}


def _pack(states: list | None) -> list | None:
    return None if states is None else [{"date": d, "back": b, "changes": c, "jumps": j} for d, (b, c, j) in states]


def _unpack(states: list | None) -> list | None:
    return None if states is None else [(s["date"], (s["back"], s["changes"], s["jumps"])) for s in states]


def _costs(batches):
    """Of each segment the costs at its last page, from each of the dates it may be entered with."""
    def found():
        for plan, *rows in _groups(batches, "book", "_chunk"):
            entry, candidates = plan["plan"]["entry"], [r["candidates"] for r in rows]
            for i, start in enumerate([None] if entry is None else [[(c["date"], (0, 0, 0))] for c in entry]):
                yield plan["book"], plan["_chunk"], i, _pack(_walk(candidates, start)[0])

    return _made(found(), _KEY | {"entry": pa.int32(), "states": _STATES})


def _chain(batches):
    """Costs on entering each segment, from the costs at the end of the segment before; rows are sorted by book, segment and entry."""
    def found():
        book, reached = None, None
        for rows in _groups(batches, "book", "_chunk"):
            if rows[0]["book"] != book:
                book, reached = rows[0]["book"], None
            yield book, rows[0]["_chunk"], _pack(reached)
            routes = [_unpack(r["states"]) for r in rows]
            if reached is not None:
                routes = [[(d, tuple(x + y for x, y in zip(base, cost))) for d, cost in r] for (_, base), r in zip(reached, routes)]
            reached = [min((r[i] for r in routes), key=lambda s: s[1]) for i in range(len(routes[0]))]

    return _made(found(), _KEY | {"entry": _STATES})


def _origins(batches):
    """Of each segment the place of the entry that each of its exits comes from, and the costs at the exits."""
    def found():
        for plan, *rows in _groups(batches, "book", "_chunk"):
            states, trail = _walk([r["candidates"] for r in rows], _unpack(plan["plan"]["entry"]))
            came = list(range(len(states)))
            for step in reversed(trail):
                came = [None if i is None else step[i] for i in came]
            yield plan["book"], plan["_chunk"], came, _pack(states), rows[0]["backward"]

    return _made(found(), _KEY | {"came": pa.list_(pa.int32()), "states": _STATES, "backward": pa.int64()})


def _exits(batches):
    """The exit of each segment on the best way through its book, from the last segment to the first; none where no way runs forward more."""
    def found():
        book, end = None, None
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["book"] != book:
                book, states = row["book"], _unpack(row["states"])
                end = _first_min(states)
                if states[end][1][0] >= row["backward"]:
                    end = None
            if end is not None:
                yield book, row["_chunk"], end
                end = row["came"][end]

    return _made(found(), _KEY | {"leave": pa.int32()})


def _choose(batches):
    """The pages of each segment whose date changes on the way from its entry to its exit."""
    def found():
        for plan, *rows in _groups(batches, "book", "_chunk"):
            if plan["plan"] is not None:
                _, trail = _walk([r["candidates"] for r in rows], _unpack(plan["plan"]["entry"]))
                yield from _moves(rows, _trace(trail, plan["plan"]["leave"]))

    return _made(found(), _CHOICE)


def _solve_segments(df: DataFrame) -> DataFrame:
    """The same choice for books in several segments, numbered by ``_chunk``.

    Segments may be many and small, so a task reads them one after the other from sorted rows: a segment's plan, then its pages.
    """
    key, pages = ["book", "_chunk"], [*ORDER, "candidates", "backward"]
    tasks = shuffle_partitions(df.sparkSession)

    def planned(plan: DataFrame, columns: list[str]) -> DataFrame:
        plan = plan.select(*key, F.struct(*columns).alias("plan"))
        rows = df.select(*key, *pages).unionByName(plan, allowMissingColumns=True)
        return rows.repartition(tasks, *key).sortWithinPartitions(*key, F.col("plan").isNull(), *ORDER)

    ends = df.groupBy(*key).agg(F.max_by("candidates", F.struct(*ORDER)).alias("last"))
    entries = ends.select(*key, F.lag("last").over(Window.partitionBy("book").orderBy("_chunk")).alias("entry"))
    table = planned(entries, ["entry"]).mapInArrow(_costs, f"book string, _chunk int, entry int, states {STATES}")
    entered = save(table.repartition(tasks, "book").sortWithinPartitions(*key, "entry").mapInArrow(_chain, f"book string, _chunk int, entry {STATES}"))
    traced = planned(entered, ["entry"]).mapInArrow(_origins, f"book string, _chunk int, came array<int>, states {STATES}, backward long")
    leaving = save(traced.repartition(tasks, "book").sortWithinPartitions("book", F.desc("_chunk")).mapInArrow(_exits, "book string, _chunk int, leave int"))
    return planned(entered.join(leaving, key), ["entry", "leave"]).mapInArrow(_choose, CHOICE)


def _whole_books(work: DataFrame) -> DataFrame:
    return work.select("book", *ORDER, "candidates", "backward").repartition("book").sortWithinPartitions("book", *ORDER).mapInArrow(_solve_books, CHOICE)


def sequence_choices(books: Segments) -> DataFrame:
    """Pages whose date changes, with the chosen day, month and year."""
    named = books.rows.where(F.col("log_no").isNotNull()).withColumns({f"_{f}s": _options(f) for f in PARTS})
    dated = named.select(*books.keys, *ORDER, _candidates().alias("candidates")).where(F.size("candidates") > 0)
    dated = save(dated.withColumn("_date", F.col("candidates")[0]["date"]))
    place = F.struct(*ORDER)
    lag = F.lag("_date").over(Window.partitionBy(*books.keys).orderBy(*ORDER))
    ends = dated.withColumn("_before", lag).groupBy(*books.keys).agg(
        F.count_if(F.col("_date") < F.col("_before")).alias("back"), F.max(F.size("candidates")).alias("choice"), F.min_by("_date", place).alias("first"), F.max_by("_date", place).alias("last"))
    if books.cut:
        before = F.lag("last").over(Window.partitionBy("book").orderBy(SEGMENT))
        ends = ends.withColumn("back", F.col("back") + F.coalesce((F.col("first") < before).cast("int"), F.lit(0)))
    sums = ends.groupBy("book").agg(F.sum("back").alias("backward"), F.max("choice").alias("choice")).where("backward > 0 AND choice > 1").select("book", "backward")
    work = books.having(dated.drop("_date")).attach(sums).rows.where(F.col("backward").isNotNull())
    if not books.cut:
        return save(_whole_books(work))
    work = save(work)
    single = _whole_books(work.where(F.col(SEGMENT) == 0))
    return save(single.unionByName(_solve_segments(work.where(F.col(SEGMENT) > 0).withColumnRenamed(SEGMENT, "_chunk"))))
