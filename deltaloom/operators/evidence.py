"""Binding names to definitions by evidence only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.scalars import dotted_prefixes, dotted_suffixes

#: Candidates that an unresolved name may be given to, at most.
FANOUT = 3


def import_evidence(imports: DataFrame, keys: list[str], target: str = "target", module: str = "module") -> DataFrame:
    """keys and every module that an import of `target` gives evidence of: the target and all its dotted prefixes."""
    return imports.select(*keys, F.explode(dotted_prefixes(F.col(target))).alias(module)).distinct()


def classified(candidates: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """Candidates of each key with `outcome`: resolved (one), ambiguous (2 to fanout, a row for each) or
    dropped (more; the candidates are not listed, one row with n stays)."""
    counts = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n") == 1, "resolved").when(F.col("n") <= fanout, "ambiguous").otherwise("dropped")
    small = counts.filter(F.col("n") <= fanout)
    kept = candidates.join(small, keys).withColumn("outcome", kind)
    dropped = counts.filter(F.col("n") > fanout).withColumn("outcome", F.lit("dropped"))
    return kept.unionByName(dropped, allowMissingColumns=True)


def suffix_matches(names: DataFrame, definitions: DataFrame, keys: list[str], name: str, qualified: str) -> DataFrame:
    """Distinct keys and names with every definition whose dotted name ends them, after a dot.

    The suffixes of each distinct name are exploded once and joined by equality, so a last word that many
    definitions have costs nothing where the words before it differ.
    """
    asked = names.select(*keys, name).distinct().withColumn(qualified, F.explode(dotted_suffixes(F.col(name))))
    return asked.join(definitions, [*keys, qualified])


def longest_prefix(names: DataFrame, known: DataFrame, keys: list[str], name: str, prefix: str, separator: str = ".") -> DataFrame:
    """names with `prefix`: of the known prefixes of the same keys, the longest that the name is or goes on from
    after a separator; null where there is none. Null names have none.

    Prefixes of each distinct name are joined by equality, and the longest is an aggregate. known: keys and
    the column `prefix`; repeated rows change nothing.
    """
    asked = names.select(*keys, name).filter(F.col(name).isNotNull()).distinct().withColumn(prefix, F.explode(dotted_prefixes(F.col(name), separator)))
    found = asked.join(known.select(*keys, prefix).distinct(), [*keys, prefix])
    best = found.groupBy(*keys, name).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return names.join(best, [*keys, name], "left")
