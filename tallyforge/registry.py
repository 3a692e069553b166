"""The ordered registry of metrics: public ids, and the scopes (F function, L file, P project) that each is defined at."""

from __future__ import annotations

#: Metric ids in column order, each with its scopes.
METRICS: list[tuple[str, str]] = [
    ("size.loc", "LP"), ("size.sloc", "FLP"), ("size.comment_loc", "LP"), ("size.blank_loc", "LP"), ("size.comment_ratio", "LP"),
    ("size.statement_count", "FLP"), ("size.token_count", "FLP"), ("size.function_count", "LP"), ("size.function_length", "F"),
    ("size.avg_function_length", "LP"), ("size.max_function_length", "LP"),
    ("complexity.cyclomatic", "FLP"), ("complexity.branch_count", "FLP"), ("complexity.conditional_count", "FLP"), ("complexity.loop_count", "FLP"),
    ("complexity.return_count", "FLP"), ("complexity.jump_count", "FLP"), ("complexity.path_count", "F"), ("complexity.cognitive", "FLP"),
    ("nesting.max_depth", "FLP"), ("nesting.avg_depth", "FLP"),
    ("halstead.unique_operators", "FLP"), ("halstead.unique_operands", "FLP"), ("halstead.total_operators", "FLP"), ("halstead.total_operands", "FLP"),
    ("halstead.vocabulary", "FLP"), ("halstead.length", "FLP"), ("halstead.volume", "FLP"), ("halstead.difficulty", "FLP"), ("halstead.effort", "FLP"),
    ("halstead.time", "FLP"), ("halstead.bugs", "FLP"),
    ("function.parameter_count", "F"), ("function.avg_parameter_count", "LP"), ("function.max_parameter_count", "LP"),
    ("function.expression_count", "FLP"), ("function.call_count", "FLP"),
    ("duplication.duplicate_block_count", "LP"), ("duplication.duplicate_token_count", "LP"), ("duplication.duplication_ratio", "LP"), ("duplication.max_duplicate_length", "LP"),
    ("dependency.fan_out", "F"), ("dependency.fan_in", "F"), ("dependency.call_depth", "F"), ("dependency.dependency_count", "LP"),
    ("documentation.doc_loc", "F"), ("documentation.documented_function_count", "LP"), ("documentation.documentation_ratio", "LP"),
    ("maintainability.index", "FL"),
    ("derived.cyclomatic_per_function", "LP"), ("derived.tokens_per_loc", "LP"), ("derived.statements_per_function", "LP"), ("derived.duplicate_tokens_per_sloc", "LP"),
]

IDS = [m for m, _ in METRICS]
SCOPE_NAMES = {"F": "function", "L": "file", "P": "project"}


def column(metric: str) -> str:
    """The column that holds a metric inside DataFrames; dots would need back-ticks."""
    return metric.replace(".", "_")


def ids(scope: str) -> list[str]:
    """The metrics of scope F, L or P, in registry order."""
    return [m for m, s in METRICS if scope in s]
