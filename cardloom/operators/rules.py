"""First matching pattern of many: candidates by a literal that a pattern cannot match without.

A chain of conditions tries every pattern on every text, and no plan holds thousands of them.  Here the longest literal run
of a pattern gives one of its pairs of letters to a table; texts give all of theirs; only the rules that a text shares a
pair with are tried on it, and the first by priority is taken.  Patterns without such a run are tried on all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import columns as C

GRAM = 2
#: What stands for the priority of a rule without one.
LAST = 999


def fold(c: Column) -> Column:
    """Text under which letters that a pattern takes for equal, case aside, are equal.

    The empty text keeps the optimizer from dropping ``upper``, without which some letters would stay apart.
    """
    return F.lower(F.concat(F.upper(c), F.lit("")))


def literal(pattern: str) -> str:
    """The longest run of letters that every match of the pattern contains; empty if none is sure."""
    try:
        tokens = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    if tokens.state.flags & ~(re.IGNORECASE | re.UNICODE):
        return ""
    best = run = ""
    for code, value in _flat(tokens):
        run = run + chr(value) if code is re._constants.LITERAL else ""
        best = max(best, run, key=len)
    return best


def _flat(tokens) -> Iterator[tuple]:  # noqa: ANN001
    for code, value in tokens:
        if code is re._constants.SUBPATTERN and not value[1] and not value[2]:
            yield from _flat(value[3])
        elif code is re._constants.LITERAL:
            yield code, value
        elif code is re._constants.MAX_REPEAT and value[0] >= 1:
            yield from _flat(value[2])
            if value[1] != 1:
                yield code, None
        else:
            yield code, None


def indexed(rules: DataFrame, pattern: str) -> DataFrame:
    """The rules with ``_no``, their place by priority (equal ones by ``load_ord``), and the pair of letters that finds them.

    The pair is the one of the literal that fewest rules have, empty for rules tried on every text.
    """

    def literals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(_literal=[literal(p or "") for p in rows[pattern]])

    held = rules.where(F.col(pattern).isNotNull()).mapInPandas(literals, rules.schema.add("_literal", "string"))
    order = [F.coalesce(F.col("priority").try_cast("int"), F.lit(LAST)), F.col("load_ord")]
    held = held.withColumns({"_order": F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))), "_literal": fold(F.col("_literal"))})
    pairs = held.select("load_ord", F.explode_outer(grams(F.col("_literal"))).alias("_gram"))
    common = pairs.groupBy("_gram").agg(F.count("*").alias("_n"))
    best = pairs.join(common, "_gram", "left").groupBy("load_ord").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    return held.join(best, "load_ord").withColumn("_gram", F.coalesce("_gram", F.lit("")))


def grams(c: Column) -> Column:
    """The different pairs of neighbouring letters."""
    n = F.length(c) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(c, k, F.lit(GRAM)))))


def first_match(texts: DataFrame, text: str, rules: DataFrame, pattern: str, fields: Sequence[str], each: bool = False) -> DataFrame:
    """``text`` and the fields of the first rule that matches it, for the different texts that any rule matches; also ``rule``.

    ``rules`` have the pattern, the fields, ``priority`` and ``load_ord``, which tells rules apart; ``rule`` is that of the
    one taken.  With ``each`` every field comes from the first matching rule that sets it, and ``rule`` is left out.
    """
    known = C.small(indexed(rules, pattern).select(*fields, pattern, "load_ord", "_order", "_literal", "_gram"))
    names = texts.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    asked = names.withColumn("_gram", F.explode(F.array_append(F.coalesce(grams(fold(F.col("_text"))), F.array().cast("array<string>")), "")))
    tried = asked.join(known, "_gram").where(F.contains(fold(F.col("_text")), F.col("_literal")))
    hits = tried.where(F.rlike(F.col("_text"), F.concat(F.lit("(?iu)"), F.col(pattern))))
    if each:
        picks = [F.min_by(F.col(f).cast("string"), F.when(F.col(f).isNotNull(), F.col("_order"))).alias(f) for f in fields]
        return hits.groupBy("_text").agg(*picks).withColumnRenamed("_text", text)
    first = F.min_by(F.struct("load_ord", *(F.col(f).cast("string").alias(f) for f in fields)), "_order")
    found = hits.groupBy("_text").agg(first.alias("_r"))
    return found.select(F.col("_text").alias(text), F.col("_r.load_ord").alias("rule"), *(f"_r.{f}" for f in fields))


def as_table(spark: SparkSession, rules: Sequence[Mapping], pattern: str, fields: Sequence[str]) -> DataFrame:
    """Rules of a list as a table, in the order of the list."""
    rows = [(k, r.get(pattern), None if r.get("priority") is None else str(r["priority"]), *(None if r.get(f) is None else str(r[f]) for f in fields)) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, ", ".join([f"load_ord long, `{pattern}` string, priority string", *(f"`{f}` string" for f in fields)]))
