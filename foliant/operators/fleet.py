"""Registrations against the fleet list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.constants import CONFUSABLE_DIGIT_COST, CONFUSABLE_DIGITS, DIFFERENT_DIGIT_COST, REGISTRATION_RE, SUFFIX_COST, WARNING
from foliant.functions.fields import page_status, update
from foliant.functions.registrations import fleet_entry


def fleet_list(values: DataFrame) -> DataFrame:
    """Distinct valid registrations of a raw list (column ``value``)."""
    return values.select(fleet_entry(F.col("value").cast("string")).alias("registration")).where("registration is not null").distinct()


def membership(values: DataFrame, fleet: DataFrame, inside: bool) -> DataFrame:
    """Rows whose ``registration`` is (not) in the fleet; Spark sends the list to all executors if its size allows it."""
    return values.join(fleet.select("registration").distinct(), "registration", "left_semi" if inside else "left_anti")


def _digit_moves(digit: Column) -> Column:
    """Every digit that may have been read where the entry has ``digit``, with the cost of that misreading."""
    pairs = {frozenset(p) for p in CONFUSABLE_DIGITS}
    costs = [[0 if a == b else CONFUSABLE_DIGIT_COST if frozenset((a, b)) in pairs else DIFFERENT_DIGIT_COST for b in "0123456789"] for a in "0123456789"]
    table = F.array(*[F.array(*[F.lit(c) for c in row]) for row in costs])
    row = F.element_at(table, digit.cast("int") + 1)
    return F.transform(row, lambda cost, i: F.struct(i.cast("string").alias("to"), cost.alias("cost")))


def _suffix_moves(suffix: Column) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("to"), F.when(suffix == s, 0).otherwise(SUFFIX_COST).alias("cost")) for s in ("CMP", "WWP")])


def nearest_entries(fleet: DataFrame) -> DataFrame:
    """Nearest fleet entries of every possible reading HP-nnnnCMP/WWP: the tied list, its cost, and the winner if single.

    The cost of a reading is a sum over its characters, so the minimum over the fleet is found
    one character at a time: spread each entry over the ten digits it may be read as, keep the
    cheapest per reading, and go on with the next character. At most 20,000 readings exist and
    each step groups ten rows per reading, whatever the sizes of the fleet and of the batch;
    readings are never compared with entries pair by pair.
    """
    reg = F.col("registration")
    state = fleet.where(reg.rlike(REGISTRATION_RE)).select("registration").distinct().select(
        *[F.substring(reg, 4 + i, 1).alias(f"d{i}") for i in range(4)], F.substring(reg, 8, 3).alias("suffix"), F.lit(0).alias("cost"), F.array(reg).alias("tied"))
    parts = ["d0", "d1", "d2", "d3", "suffix"]
    for part in parts:
        moves = _suffix_moves(F.col(part)) if part == "suffix" else _digit_moves(F.col(part))
        moved = state.withColumn("_m", F.explode(moves)).select(
            *[F.col("_m.to").alias(p) if p == part else F.col(p) for p in parts], (F.col("cost") + F.col("_m.cost")).alias("cost"), "tied")
        options = moved.groupBy(*parts).agg(F.min("cost").alias("cost"), F.collect_list(F.struct("cost", "tied")).alias("_o"))
        state = options.select(*parts, "cost", F.flatten(F.transform(F.filter("_o", lambda o: o["cost"] == F.col("cost")), lambda o: o["tied"])).alias("tied"))
    return state.select(F.concat(F.lit("HP-"), *parts).alias("registration"), "cost", F.array_sort("tied").alias("tied"),
                        F.when(F.size("tied") == 1, F.col("tied")[0]).alias("winner"))


def nearest_fleet_match(pages: DataFrame, fleet: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Replace out-of-fleet registrations by the only nearest entry, or clear them. No-op without a fleet."""
    allowed = fleet.select("registration").distinct()
    size = allowed.agg(F.count("*")).scalar()
    value = F.upper(F.trim(F.col("matricula")["value"]))
    keyed = pages.withColumn("registration", F.when(value != "", value))
    near = nearest_entries(allowed)
    # The nearest entries are at most 20,000; a list of any size is Spark's choice.
    flagged = keyed.join(allowed.withColumn("_listed", F.lit(True)), "registration", "left").join(F.broadcast(near), "registration", "left")
    read, winner, tied = F.col("registration"), F.col("winner"), F.col("tied")
    change = F.coalesce((size > 0) & read.isNotNull() & F.col("_listed").isNull(), F.lit(False))
    note = (F.when(winner.isNotNull(), F.concat(F.lit("Matrícula reclasificada de "), read, F.lit(" a "), winner, F.lit(": es la más parecida de la lista de flota")))
            .when(F.size(tied) > 0, F.concat(F.lit("Matrícula sin confirmar: "), read, F.lit(" queda a la misma distancia de "), F.array_join(tied, ", ")))
            .otherwise(F.concat(F.lit("Matrícula sin confirmar: "), read, F.lit(" no está en la lista de flota y no se parece a ningún avión de ella"))))
    col = F.col("matricula")
    known = F.coalesce(col["alternatives"], F.array().cast("array<string>"))
    flagged = flagged.withColumn("_change", change)
    matched = flagged.withColumn("matricula", update(
        "matricula", F.col("_change"), value=winner, source=F.lit("fleet_validation"), status=F.lit(WARNING),
        inference_method=F.when(winner.isNotNull(), "fleet_nearest_match").otherwise("fleet_unconfirmed"),
        alternatives=F.when(F.array_contains(known, read), known).otherwise(F.array_append(known, read)),
        comment=F.btrim(F.concat(F.coalesce(col["comment"], F.lit("")), F.lit(" | "), note), F.lit(" |"))))
    return (matched.withColumn("status", F.when(F.col("_change"), page_status(fields)).otherwise(F.col("status")))
            .drop("registration", "_listed", "tied", "winner", "cost", "_change"))
