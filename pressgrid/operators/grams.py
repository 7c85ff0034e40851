"""Containment anywhere in a text as key joins on short runs of characters.

A part is filed under the one of its runs that fewest texts hold; a text meets
only the parts filed under one of its own runs, and is then tested in full. Work
grows with the texts and with the pairs that share a rare run, not with texts times parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.operators.lookup import is_small, lookup, salted_join
from pressgrid.session import settle

RUN = 8  # characters of a run; shorter parts are filed under themselves


def _runs(text: Column, size: Column) -> Column:
    """Hashes of the distinct runs of `size` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda at: F.xxhash64(F.substr(text, at, size))))


def contained(texts: DataFrame, text: str, parts: DataFrame, part: str, run: int = RUN) -> DataFrame:
    """Each distinct value of `text` joined to the rows of `parts` whose `part` lies in it.

    Nulls hold nothing and lie in nothing. An empty part lies everywhere, which no join can make
    small: such rows are left out, and callers answer for them directly. Distinct names are expected.
    """
    filed = parts.filter(F.length(part) > 0).withColumn("_size", F.least(F.length(part), F.lit(run)))
    runs = filed.select(part, "_size").distinct().withColumn("_run", F.explode(_runs(F.col(part), F.col("_size"))))
    runs = settle(runs)
    sizes = [r[0] for r in runs.select("_size").distinct().collect()]  # at most `run` numbers
    held = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    if not sizes:
        return held.join(parts.limit(0), F.lit(False))
    fitting = F.filter(F.array(*(F.lit(s) for s in sorted(sizes))), lambda s: s <= F.length(text))
    met = held.withColumn("_size", F.explode(fitting)).withColumn("_run", F.explode(_runs(F.col(text), F.col("_size")))).drop("_size")
    # only runs that some part has are counted and kept; there are few of each text's
    met = settle(lookup(met, runs.select("_run").distinct(), "_run", "left_semi", spread=[text]))
    often = met.groupBy("_run").agg(F.count("*").alias("_n"))
    counted = lookup(runs, often, "_run", "left", spread=[part])
    # a part with a run that no text holds lies in none
    rarest = counted.groupBy(part).agg(F.min_by("_run", F.struct(F.coalesce("_n", F.lit(0)), F.col("_run"))).alias("_run"), F.min(F.coalesce("_n", F.lit(0))).alias("_n"))
    filed = filed.drop("_size").join(rarest.filter("_n > 0").drop("_n"), part)
    found = met.join(F.broadcast(filed), "_run") if is_small(filed) else salted_join(met, filed, "_run", "inner", spread=[text])
    return found.filter(F.contains(F.col(text), F.col(part))).drop("_run")
