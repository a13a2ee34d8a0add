"""Class imbalance and oversampling of minority classes from a network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.operators.graph import Edge
from evidentia.operators.selection import FeatureParams
from evidentia.operators.synth import SyntheticGenerator
from evidentia.session import cut_lineage

IMBALANCE_RATIO = 0.5
CHUNK = 100_000


def class_imbalance(df: DataFrame, label: str, limit: float = IMBALANCE_RATIO) -> DataFrame:
    """``(class, n, ratio, minority)``: a class is in minority when its size is below ``limit`` of the largest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.col("n") / counts.agg(F.max("n")).scalar()
    return counts.withColumn("ratio", ratio).withColumn("minority", ratio < limit)


def _numbered(deficits: DataFrame, label: str) -> DataFrame:
    """``(label, first, end)``: the numbers of every class's new rows, counted on from class to class in order.

    The classes are dealt out by range and numbered part by part, so their number is not bound to one task.
    """
    parts = int(deficits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(deficits.repartitionByRange(parts, label).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(F.sum("missing").alias("__sum"))  # a row per part
    before = F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("__part", before.alias("__start"))
    end = F.col("__start") + F.sum("missing").over(W.partitionBy("__part").orderBy(label))
    return placed.join(F.broadcast(starts), "__part").withColumn("end", end).select(label, (F.col("end") - F.col("missing")).alias("first"), "end")


class ClassBalancer(FeatureParams):
    """Raises every class to the size of the largest with rows sampled from a network whose root is
    the label. ``featureCols`` are categories; ``numericParents`` as in the generator."""

    components = Param(Params._dummy(), "components", "mixture components", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol=None, knownStructure=None, numericParents=None, components=1, seed=0):
        super().__init__()
        self._setDefault(components=1, seed=0)
        given = dict(self._input_kwargs)
        self.known_structure: Sequence[Edge] | None = given.pop("knownStructure", None)
        self.numeric_parents = given.pop("numericParents", None) or {}
        self._set(**{n: v for n, v in given.items() if v is not None})

    def fit_resample(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` and the new ones, told apart by ``synthetic``."""
        label, features = self.label(df), self.features(df)
        if self.known_structure and any(child == label for _, child in self.known_structure):
            raise ValueError("the label must be a root of the network")
        counts = cut_lineage(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")))
        model = SyntheticGenerator(
            featureCols=[label, *features], knownStructure=self.known_structure, blackList=[(c, label) for c in features],
            numericParents=self.numeric_parents, components=self.getOrDefault("components"), seed=self.getOrDefault("seed"),
        ).fit(df)
        columns = [label, *features, *self.numeric_parents]
        originals = df.select(*columns).withColumn("synthetic", F.lit(False))
        largest = counts.agg(F.max("n")).first()[0] or 0
        deficits = _numbered(counts.where(F.col("n") < largest).select(label, (F.lit(largest) - F.col("n")).alias("missing")), label)
        if deficits.isEmpty():
            return originals
        # The numbers of the new rows are cut into chunks that spread over the cluster, however uneven
        # the classes are.
        chunks = deficits.select(label, "end", F.explode(F.sequence(F.col("first"), F.col("end") - 1, F.lit(CHUNK))).alias("first"))
        until = F.least(F.col("first") + CHUNK, F.col("end")) - 1
        wanted = chunks.repartition(label, "first").select(label, F.explode(F.sequence("first", until)).alias("id"))
        made = model._transform(wanted, self.getOrDefault("seed")).select(
            *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns], F.lit(True).alias("synthetic")
        )
        return originals.unionByName(made)
