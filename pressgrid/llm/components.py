"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressgrid.operators.lookup import lookup
from pressgrid.session import new_dir
from pressgrid.sources.folders import remove


class _Tables:
    """Written tables of one run. Tables are written rather than checkpointed: a checkpoint hands on what
    the optimiser knows of its columns, and that grows from round to round until planning takes longer than the work."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_dir(self.spark, "components")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but_last(self) -> None:
        for path in self.paths[:-1]:
            remove(self.spark, path)
        self.paths = self.paths[-1:]


def _to_roots(up: DataFrame, keep) -> DataFrame:
    """(node, up) of a forest -> the same with every node pointing at its root; each step halves the way."""
    while True:
        above = up.filter("node <> up").select(F.col("node").alias("up"), F.col("up").alias("next"))
        moved = keep(lookup(up, above, "up", "left", spread=["node"]))
        if moved.filter("next is not null").isEmpty():
            return up
        up = moved.select("node", F.coalesce("next", "up").alias("up"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node in a link; root is the smallest node that links reach.

    In a round every node points at the smallest of itself and its neighbours; the trees that
    makes are flattened by doubling and become the nodes of the next round. A round at least halves the
    nodes that still have links, so rounds and doublings grow with the logarithm, also on a chain. Only
    minima are aggregated, with map-side combine, and joins salt what many rows point at. Loops and
    nulls in the input are ignored. Only the result's table stays in the shared folder.
    """
    tables = _Tables(links.sparkSession)
    links = tables.keep(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    found = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = tables.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("up")))
        root = _to_roots(near, tables.keep)
        if found is None:
            found = root.withColumnRenamed("up", "root")
        else:
            found = lookup(found, root.toDF("root", "next"), "root", "left", spread=["node"]).select(
                "node", F.coalesce("next", "root").alias("root"))
        moved = lookup(lookup(links, root.toDF("a", "ra"), "a", "inner", spread=["b"]), root.toDF("b", "rb"), "b", "inner", spread=["a"])
        links = tables.keep(
            moved.filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        found = tables.keep(found)
        if links.isEmpty():
            tables.drop_all_but_last()
            return found
