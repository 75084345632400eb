"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) on Spark.

Fitting draws one small sample per tree by hash over the whole training table, which is
filtered and never sorted, and builds the trees as independent tasks of at most
``max_samples`` rows.  The model is a node table of at most
``trees * (2 * max_samples - 1)`` rows; scoring ships it to the executors and walks whole
Arrow batches down each tree.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.operators import preparation as prep
from emberwatch.operators.ordering import exact_quantiles
from emberwatch.session import written

EULER_GAMMA = 0.5772156649015329
MAX_NODES = 2_000_000

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, depth double"
)


@dataclass
class IsolationForest:
    """Fitted model: settings, scaling statistics, node rows and the decision offset."""

    columns: list[str]
    trees: int
    sample_size: int
    contamination: float
    seed: int
    means: list[float]
    deviations: list[float]
    nodes: list[tuple] = field(repr=False)
    offset: float = 0.0

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Node table as Parquet, settings as one JSON row."""
        settings = {k: v for k, v in self.__dict__.items() if k != "nodes"}
        self.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        settings = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        rows = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes").collect()
        return cls(nodes=sorted(tuple(r) for r in rows), **settings)


def _tree_builder(width: int, limit: int, seed: int, size: int):
    """Grouped function building one tree.  Self-contained, as it is shipped by value."""

    def build(pdf):
        import numpy as np
        import pandas as pd

        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(["_order", "_id"])
        if len(pdf) != size:
            raise ValueError(f"tree {tree} drew {len(pdf)} of {size} rows")
        data = np.stack(pdf["x"].to_numpy()).reshape(len(pdf), width)
        rng = np.random.default_rng([seed, tree])

        def expected(n):
            if n <= 1:
                return 0.0
            if n == 2:
                return 1.0
            return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n

        nodes, todo = [], [(0, np.arange(len(data)), 0)]
        issued = 1
        while todo:
            node, rows, depth = todo.pop()
            part = data[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + expected(len(rows))))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = part[:, f] <= cut
            if goes_left.all() or not goes_left.any():
                cut = float((low[f] + high[f]) / 2.0)
                goes_left = part[:, f] <= cut
            left, right = issued, issued + 1
            issued += 2
            nodes.append((tree, node, f, cut, left, right, float(depth)))
            todo.append((left, rows[goes_left], depth + 1))
            todo.append((right, rows[~goes_left], depth + 1))
        return pd.DataFrame(
            nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"]
        )

    return build


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def tree_samples(df: DataFrame, key: str, columns: list[str], trees: int, size: int, seed: int, rows: int) -> DataFrame:
    """``size`` rows per tree: (tree, _order, _id, x).

    Every tree takes the rows with the smallest hash of (key, tree), out of the whole table.
    """
    whole = 1 << 31
    pool = df.select(
        F.col(key).cast("string").alias("_id"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
    )
    # a row is copied only for the trees whose hash it passes: about 3 * size + 64 per tree, so that
    # a shortfall is out of question; ``fit`` checks the sizes all the same
    limit = int(min(1.0, (3.0 * size + 64) / max(1, rows)) * whole)

    def place(tree):
        return F.pmod(F.xxhash64("_id", tree, F.lit(seed)), F.lit(whole))

    every = F.sequence(F.lit(0), F.lit(trees - 1))
    # explode and filter compile to one loop over the trees; a lambda would be interpreted
    drawn = pool.select(F.explode(every).alias("tree"), "_id", "x").withColumn("_order", place(F.col("tree")))
    drawn = drawn.filter(F.col("_order") < limit)
    best = Window.partitionBy("tree").orderBy("_order", "_id")
    return drawn.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= size).drop("_place")


def fit(
    df: DataFrame,
    columns: list[str],
    key: str = "block_id",
    trees: int = 100,
    max_samples: str | int | float = "auto",
    contamination: float = 0.01,
    seed: int = 42,
) -> IsolationForest:
    """Fit scaler and forest on cleaned rows.

    Three small results reach the driver: row count with scaling statistics, the node
    rows (size-checked) and the offset.
    """
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    rows = stats["n"]
    if rows == 0:
        raise ValueError("the feature table is empty")
    if max_samples == "auto":
        size = min(256, rows)
    elif isinstance(max_samples, float):
        size = max(1, int(max_samples * rows))
    else:
        size = min(int(max_samples), rows)
    if trees * (2 * size - 1) > MAX_NODES:
        raise ValueError("trees * max_samples exceeds the broadcast bound")
    means = [stats[f"m{i}"] for i in range(len(columns))]
    deviations = [stats[f"d{i}"] or 1.0 for i in range(len(columns))]
    scaled = df.select(
        key, *[((F.col(c) - m) / d).alias(c) for c, m, d in zip(columns, means, deviations)]
    )
    samples = tree_samples(scaled, key, columns, trees, size, seed, rows)
    depth = math.ceil(math.log2(max(size, 2)))
    nodes = samples.groupBy("tree").applyInPandas(
        _tree_builder(len(columns), depth, seed, size), NODE_SCHEMA
    )
    # bounded by the check above; a sort on the cluster would build the trees twice
    collected = sorted(tuple(r) for r in nodes.collect())
    model = IsolationForest(
        list(columns), trees, size, contamination, seed, means, deviations, collected
    )
    scores = written(score_samples(df.select(key, *columns), model).select("_raw"), "scores")
    offset = exact_quantiles(scores, ["_raw"], [contamination]).first()["quantile"]
    model.offset = float(offset)
    return model


def _walker(model: IsolationForest):
    """Vectorised path walk over Arrow batches; closes over plain arrays only.

    All trees share flat node arrays.  A leaf points to itself behind an endless limit, so
    every row takes the same number of steps and no row needs to be singled out.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    table = np.array(model.nodes, dtype="float64")
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    tree, node = table[:, 0].astype("int64"), table[:, 1].astype("int64")
    roots = np.flatnonzero(node == 0)
    leaf = table[:, 2] < 0
    here = np.arange(len(table))
    feature = np.where(leaf, 0, table[:, 2]).astype("int64")
    threshold = np.where(leaf, np.inf, table[:, 3])
    # the right child always follows the left one
    left = np.where(leaf, here, table[:, 4].astype("int64") + roots[tree])
    depth = np.where(leaf, table[:, 6], 0.0)
    steps = int(table[~leaf, 6].max()) + 1 if (~leaf).any() else 0
    means, deviations = np.array(model.means), np.array(model.deviations)
    norm = expected_path(model.sample_size) or 1.0
    width = len(model.columns)

    def walk(batches):
        import numpy as np
        import pandas as pd

        for columns in batches:
            if isinstance(columns, pd.Series):
                columns = (columns,)
            x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
            x = ((x - means) / deviations).ravel()
            rows = len(x) // width
            base = np.arange(rows) * width
            total = np.zeros(rows)
            for root in roots:
                at = np.full(rows, root)
                for _ in range(steps):
                    goes_right = x.take(base + feature.take(at)) > threshold.take(at)
                    at = left.take(at) + goes_right
                total += depth.take(at)
            yield pd.Series(-np.power(2.0, -(total / len(roots)) / norm))

    walk.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return walk


def score_samples(df: DataFrame, model: IsolationForest, out: str = "_raw") -> DataFrame:
    """Add the raw score in [-1, 0): lower is more anomalous."""
    walk = F.pandas_udf(_walker(model), "double")
    return df.withColumn(out, walk(*[F.col(c).cast("double") for c in model.columns]))


def score(df: DataFrame, model: IsolationForest, threshold: float | None = None) -> DataFrame:
    """Add anomaly_score (higher is more normal), prediction ±1 and is_anomaly."""
    ready = prep.zero_fill(df, model.columns)
    scored = score_samples(ready, model).withColumn(
        "anomaly_score", F.col("_raw") - F.lit(model.offset)
    )
    value = F.col("anomaly_score")
    limit = 0.0 if threshold is None else threshold
    return scored.drop("_raw").withColumns(
        {
            "prediction": F.when(value < 0, -1).otherwise(1),
            "is_anomaly": value < limit,
        }
    )
