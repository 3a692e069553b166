"""Functions from columns to columns: what nodes and tokens count as, and the formulas of the metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Node kinds by what they count as.
STATEMENTS = ["statement", "declaration", "branch", "loop", "return", "jump"]
DECISIONS = ["branch", "loop", "case", "catch", "logical", "conditional"]
NESTING = ["branch", "loop", "case", "catch"]
EXPRESSIONS = ["expression", "call", "assignment", "binary", "logical", "conditional", "unary"]


def n_if(cond: Column) -> Column:
    return F.count_if(cond).cast("double")


def is_kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def is_operator(kind: Column | None = None, text: Column | None = None) -> Column:
    """Of a token's row, or of a token given as columns."""
    kind, text = F.col("kind") if kind is None else kind, F.col("text") if text is None else text
    return kind.isin("keyword", "operator") | ((kind == "punctuation") & text.isin("(", "[", "{"))


def is_operand(kind: Column | None = None) -> Column:
    return (F.col("kind") if kind is None else kind).isin("identifier", "literal")


def count_texts(df: DataFrame, keys: list, tokens: Column, operator: Callable, operand: Callable, text: Callable = lambda x: x) -> DataFrame:
    """keys, size_token_count, n1, n2, t1, t2 of an array of tokens, row by row: nothing is shuffled.

    operator, operand: whether a token is one; text: a token's text."""
    pick = lambda which: F.transform(F.filter("_tokens", which), text)
    own = df.select(*keys, tokens.alias("_tokens"))
    own = own.select(*own.columns[:-1], F.size("_tokens").alias("_size"), pick(operator).alias("_operators"), pick(operand).alias("_operands"))
    counts = {"size_token_count": F.col("_size"), "n1": F.size(F.array_distinct("_operators")), "n2": F.size(F.array_distinct("_operands")), "t1": F.size("_operators"), "t2": F.size("_operands")}
    return own.select(*own.columns[:-3], *[c.cast("double").alias(a) for a, c in counts.items()])


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where b is 0 or either is null."""
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def cognitive_increment(name: Column) -> Column:
    """What a node adds; name: that of the function it belongs to."""
    nested = F.col("cog_level") + 1
    return (
        F.when(is_kind("branch") & F.col("is_continuation"), 1)
        .when(is_kind("branch", "loop", "catch", "conditional"), nested)
        .when(is_kind("else"), F.when(F.col("wraps_continuation"), 0).otherwise(1))
        .when(is_kind("case"), F.when(F.col("prev_kind").eqNullSafe("case"), 0).otherwise(nested))
        .when(is_kind("logical"), F.when((F.col("parent_kind") == "logical") & F.col("parent_label").eqNullSafe(F.col("label")), 0).otherwise(1))
        .when(is_kind("call"), F.when(F.col("label") == name, 1).otherwise(0))
        .otherwise(0)
    )


def halstead(n1: Column, n2: Column, t1: Column, t2: Column) -> dict[str, Column]:
    """The derived Halstead measures from counts of operators and operands, distinct and total."""
    vocabulary, length = n1 + n2, t1 + t2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary))
    difficulty = F.when(n2 > 0, n1 / F.lit(2.0) * F.try_divide(t2, n2))
    effort = difficulty * volume
    return {
        "halstead_unique_operators": n1, "halstead_unique_operands": n2, "halstead_total_operators": t1, "halstead_total_operands": t2,
        "halstead_vocabulary": vocabulary, "halstead_length": length, "halstead_volume": volume, "halstead_difficulty": difficulty,
        "halstead_effort": effort, "halstead_time": effort / 18.0, "halstead_bugs": volume / 3000.0,
    }


def maintainability(volume: Column, cyclomatic: Column, sloc: Column) -> Column:
    return F.when((volume > 0) & (sloc > 0), F.lit(171.0) - F.lit(5.2) * F.log(volume) - F.lit(0.23) * cyclomatic - F.lit(16.2) * F.log(sloc))
