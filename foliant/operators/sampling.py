"""Batch numbering, page ranges, evenly spaced samples and page-transform smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.books import PAGE_ID
from foliant.operators.skew import in_ranges, positions

RANGE_BLOCK = 4096
MODULUS = 2**31 - 1


def parse_page_range(text: str) -> tuple[int, int | None]:
    """``N``, ``N-M``, ``N-`` or ``-M`` as (first, last); last is None when open."""
    raw = str(text).strip().replace(":", "-").replace("–", "-")
    start, dash, end = raw.partition("-")
    numbers = [int(p) if p.strip() else None for p in (start, end)]
    if not raw or any(n is not None and n < 1 for n in numbers):
        raise ValueError(f"not a page range: {text!r}")
    first = numbers[0] or 1
    last = numbers[1] if dash else first
    if last is not None and last < first:
        raise ValueError(f"page range ends before it starts: {text!r}")
    return first, last


def page_range(pages: DataFrame, text: str) -> DataFrame:
    """Pages of the batch whose global number lies in the range."""
    first, last = parse_page_range(text)
    numbered = positions(pages, PAGE_ID, "batch_no")
    return numbered.where(F.col("batch_no") >= first if last is None else F.col("batch_no").between(first, last))


def slice_batch(counts: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Per-file sub-range (``file_seq, pages``) of a global page range; files outside disappear."""
    pages = F.greatest(F.col("pages"), F.lit(0))
    ranged = in_ranges(counts, ["file_seq"])
    # One row per range of files: the offsets are over a few thousand rows at most.
    sums = ranged.groupBy("_chunk").agg(F.sum(pages).alias("n"))
    offsets = sums.select("_chunk", (F.sum("n").over(Window.orderBy("_chunk")) - F.col("n")).alias("_before"))
    running = F.sum(pages).over(Window.partitionBy("_chunk").orderBy("file_seq"))
    placed = ranged.withColumn("_end", running).join(F.broadcast(offsets), "_chunk").withColumn("_end", F.col("_end") + F.col("_before"))
    start = F.col("_end") - pages + 1
    first_page = F.greatest(F.lit(1), F.lit(first) - start + 1)
    last_page = pages if last is None else F.least(pages, F.lit(last) - start + 1)
    return (placed.select("file_seq", "pages", first_page.alias("first_page"), last_page.alias("last_page"))
            .where((F.col("pages") > 0) & (F.col("last_page") >= F.col("first_page")))
            .withColumn("taken", F.col("last_page") - F.col("first_page") + 1))


def spread_sample(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows spread from the first to the last; indexes round half to even."""
    numbered = positions(rows, order, "_i", start=0)
    total = numbered.agg(F.count("*")).scalar()
    take = F.least(F.lit(n), total)
    # Row i is wanted when some k in 0..n-1 rounds to it; the two nearest k are enough to check.
    span, step = F.greatest(take - 1, F.lit(1)), F.greatest(total - 1, F.lit(1))
    guess = F.floor(F.col("_i") * span / step)
    hits = [((guess + d) >= 0) & ((guess + d) < take) & (F.bround((guess + d) * (total - 1) / span, 0) == F.col("_i")) for d in (-1, 0, 1, 2)]
    return numbered.where((hits[0] | hits[1] | hits[2] | hits[3])).drop("_i")


def step_sample(rows: DataFrame, order: list[str], every: int, cap: int | None = None) -> DataFrame:
    """Every k-th row; above ``cap`` rows, index int(i * len / cap) of those."""
    kept = positions(rows, order, "_i", start=0).where(F.col("_i") % every == 0).withColumn("_j", (F.col("_i") / every).cast("long"))
    if cap is None:
        return kept.drop("_i", "_j")
    total = kept.agg(F.count("*")).scalar()
    # j is int(i * total / cap) for some i exactly when the i it belongs to lands back on j.
    i = F.ceil(F.col("_j") * cap / total)
    lands = [((i + d) >= 0) & ((i + d) < cap) & (F.floor((i + d) * (total / cap)) == F.col("_j")) for d in (-1, 0, 1)]
    return kept.where((total <= cap) | lands[0] | lands[1] | lands[2]).drop("_i", "_j")


def mixed(seed: int) -> Column:
    """A page's place in a random order: whole-number steps below 2**62 that any engine can redo."""
    def reduced(x: Column) -> Column:
        return F.pmod(x, F.lit(MODULUS))

    start = reduced(F.col("page_number").cast("long") * 48271 + F.col("file_seq").cast("long") * 69621 + seed * 16807)
    square = reduced(start * start + 12345)
    return reduced(square * 39373 + start)


def random_sample(pages: DataFrame, n: int, seed: int) -> DataFrame:
    """n pages chosen by a seeded mix of the page's numbers, in (file, page) order; fails if there are too few."""
    short = pages.agg(F.count("*")).scalar() < n
    picked = pages.orderBy(mixed(seed), *PAGE_ID).limit(n)
    checked = picked.where(F.when(short, F.raise_error(F.lit("fewer pages than asked for"))).otherwise(F.lit(True)))
    return checked.orderBy("file", "page_number")


def stabilise_transforms(transforms: DataFrame, half: int = 7) -> DataFrame:
    """Centred window median of each page's transform within its file, over reliable pages if any.

    Files are cut into blocks that share ``half`` pages with their neighbours, so the window
    never needs a whole file in one task.
    """
    if half > RANGE_BLOCK:
        raise ValueError(f"a window reaches at most {RANGE_BLOCK} pages to each side")
    numbered = positions(transforms, PAGE_ID, "_i", start=0)
    blocks = F.array_distinct(F.array(*[F.floor((F.col("_i") + d) / RANGE_BLOCK) for d in (-half, 0, half)]))
    spread = numbered.withColumn("_own", F.floor(F.col("_i") / RANGE_BLOCK)).withColumn("_block", F.explode(blocks))
    window = Window.partitionBy("file_seq", "_block").orderBy("_i").rowsBetween(-half, half)
    trusted = F.max(F.col("reliable").cast("int")).over(window) == 1

    def median(name: str):
        return F.coalesce(F.percentile(F.when(F.col("reliable"), F.col(name)), F.lit(0.5)).over(window),
                          F.percentile(F.col(name), F.lit(0.5)).over(window)).alias(name)

    inliers = F.coalesce(F.max(F.when(F.col("reliable"), F.col("inliers"))).over(window), F.max("inliers").over(window))
    return (spread.select(*PAGE_ID, "_own", "_block", *[median(c) for c in ("rot", "tx", "ty", "scale")],
                          inliers.alias("inliers"), trusted.alias("reliable"))
            .where(F.col("_own") == F.col("_block")).drop("_own", "_block"))
