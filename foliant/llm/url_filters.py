"""URL rules indexed by their rarest literal token: a URL's tokens fetch candidate rules, and only those run their regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import numbered, stored

#: Rules up to this number are sent to all executors (some 200 bytes each); more are joined by a shuffle.
SENT_RULES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``regex`` is searched in host + path. ``tokens`` are literals that every match has: ``h:`` with a whole label of the host or ``p:`` with a whole segment of
    the path; a rule without any is a candidate for all URLs. The largest ``rank`` wins, then the smallest ``name``; ``named``: it is reported as the URL's rule."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...] = ()
    rank: int = 0
    named: bool = False


def host_path(action: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with ``path``; of several the longest wins, before all patterns."""
    segments = path.split("/")[1:-1] if path else []
    tokens = [f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in segments if x]
    tail = re.escape(path) if path else r"(?=/|\z)"
    return Rule(host + path, action, rf"\A(?:[^/]*\.)?{re.escape(host)}{tail}", tuple(tokens), len(host) + len(path), True)


def label(action: str, name: str) -> Rule:
    """A pattern: some label of the host is ``name``."""
    return Rule(f"label {name}", action, rf"\A(?:[^/]*\.)?{re.escape(name)}(?:[./]|\z)", (f"h:{name}",), -1)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return (_lower(F.coalesce(F.regexp_extract(url, shape, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, shape, 2), F.lit("")))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule (the best fitting named rule, else null), verdict and pattern (the best fitting other rule, else null) per row.

    The verdict is the rule's, else the pattern's, else ``default``. Rows that repeat an id are judged on their own; extra columns are ignored.
    Token counts are taken over all rows; each rule is then filed under the one of its tokens that the fewest rows have.
    """
    spark = pages.sparkSession
    host, path = parts(F.col(url_column).cast("string"))
    rows = numbered(pages.select(F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path")), "urls")
    if not rules:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"), none.alias("pattern"))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(rules) <= SENT_RULES else df

    table = spark.createDataFrame([(i, r.name, r.action, r.regex, r.rank, r.named, list(r.tokens) or ["*"]) for i, r in enumerate(rules)],
                                  "id long, name string, action string, regex string, rank int, named boolean, tokens array<string>")
    # A dot or slash at either end makes empty labels; they are no tokens.
    tokens = F.concat(F.array(F.lit("*")), F.transform(F.split("host", r"\.", -1), lambda x: F.concat(F.lit("h:"), x)), F.transform(F.split("path", "/", -1), lambda x: F.concat(F.lit("p:"), x)))
    met = rows.select("_row", F.concat("host", "path").alias("target"), F.explode(F.array_distinct(tokens)).alias("token"))
    literals = table.select("id", F.explode("tokens").alias("token"))
    counts = met.select("token").join(sent(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literals.join(counts, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = stored(table.join(rarest, "id").select("id", "name", "action", "regex", "rank", "named", F.col("least.token").alias("token")), "rules")
    fits = met.join(sent(index), "token").where(F.expr("rlike(target, regex)"))
    first = F.struct(-F.col("rank"), F.col("name"), F.col("action"))
    best = fits.groupBy("_row").agg(F.min(F.when(F.col("named"), first)).alias("r"), F.min(F.when(~F.col("named"), first)).alias("p"))
    return (rows.join(best, "_row", "left")
            .select("page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce("r.action", "p.action", F.lit(default)).alias("verdict"), F.col("p.name").alias("pattern")))
