"""Grouped statistics of all numeric columns, crosstabs, classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbel.operators.frames import numeric_columns

#: ``median`` is exact, by ``medians``; ``median_sketch`` is bounded, off by one rank in 10,000 at most.
AGGREGATES = {"mean": F.avg, "median_sketch": lambda c: F.percentile_approx(c, 0.5, 10_000), "std": F.stddev_samp, "var": F.var_samp, "sum": F.sum, "min": F.min}
#: Rows of a key from which its bracket is broadcast; there are no more such keys than rows by this.
_LARGE = 1_000_000
#: Different training rows of a task in the fit of a kernel classifier, each as long as there are landmarks.
FIT_ROWS = 32_768
#: Parts in which a sketch brackets the middle of a group.
_ACCURACY = 10_000


def medians(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column_median for each): exact medians of keys that are not null, without a task that holds a group's values.

    A sketch brackets the middle of every group; values outside the bracket are counted, and only those
    within, some thousandths, are ordered, one row for each different value.
    """
    cast = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    d = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *cast)
    names, each = [f"k{i}" for i in range(len(keys))], range(len(columns))
    around = F.array(F.lit(0.5 - 4 / _ACCURACY), F.lit(0.5 + 4 / _ACCURACY))
    bounds = d.groupBy(*names).agg(*[F.percentile_approx(f"v{i}", around, _ACCURACY).alias(f"b{i}") for i in each])
    # keys with few rows are many, those with many rows are few: these go to all tasks, so that none gets all rows of a key
    sized = d.groupBy(*names).agg(F.count("*").alias("n"))
    large = F.broadcast(sized.where(F.col("n") > _LARGE).select(*names))
    some = F.broadcast(bounds.join(large, names, "left_semi"))
    near = d.join(some, names).unionByName(d.join(large, names, "left_anti").join(bounds, names))
    long = near.select(*names, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v"), F.col(f"b{i}").alias("b")) for i in each])).alias("x")).where("x.v IS NOT NULL")
    # a value below the bracket counts as the one just below it, a value above as one above
    low, high = F.col("x.b")[0], F.col("x.b")[1]
    side = F.when(F.col("x.v") < low, -1).when(F.col("x.v") > high, 1).otherwise(0)
    counts = long.groupBy(*names, F.col("x.i").alias("i"), side.alias("side"), F.when(side == 0, F.col("x.v")).alias("v")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*names, "i")
    placed = counts.select("*", F.sum("n").over(group).alias("total"), F.sum("n").over(group.orderBy("side", "v")).alias("end"))
    holds = lambda rank: (F.col("end") > rank) & (F.col("end") - F.col("n") <= rank)
    lower, upper = F.expr("(total - 1) DIV 2"), F.expr("total DIV 2")
    middle = placed.groupBy(*names, "i").agg(F.max(F.when(holds(lower), F.col("v"))).alias("l"), F.max(F.when(holds(upper), F.col("v"))).alias("u"))
    found = middle.withColumn("m", (F.col("l") + F.col("u")) / 2)
    wide = found.groupBy(*names).agg(*[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"{c}_median") for i, c in enumerate(columns)])
    return wide.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *[f"{c}_median" for c in columns])


def describe_groups(df: DataFrame, keys: list[str], how: list[str], columns: list[str] | None = None) -> DataFrame:
    """Statistics of all (or given) numeric columns per key, named column_statistic; rows with a null key are left out."""
    columns = columns or [c for c in numeric_columns(df) if c not in keys]
    rows = df.dropna(subset=keys)
    rest = [h for h in how if h != "median"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("__n"), *[AGGREGATES[h](c).alias(f"{c}_{h}") for c in columns for h in rest])
    if "median" in how:
        out = out.join(medians(rows, keys, columns), keys, "left")
    return out.select(*keys, *[f"{c}_{h}" for c in columns for h in how])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each combination of values, most frequent first."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def pivot_count(df: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """Counts of each of ``values`` of a column, 0 where there are none."""
    return df.groupBy(*rows).pivot(column, values).count().na.fill(0)


def crosstab(df: DataFrame, actual: str, predicted: str, values: list) -> DataFrame:
    """Confusion matrix in wide form."""
    return pivot_count(df, [actual], predicted, values)


def class_outcomes(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Correct and wrong predictions of each predicted class, most wrong first."""
    hit = F.col(actual) == F.col(predicted)
    return df.groupBy(predicted).agg(F.count_if(hit).alias("correct"), F.count_if(~hit).alias("wrong")).orderBy(F.desc("wrong"), predicted)


def frequent_values(df: DataFrame, column: str, part: int = 10) -> DataFrame:
    """Values that occur more often than a ``part``-th of the most frequent one's count (whole division)."""
    counts = df.dropna(subset=[column]).groupBy(column).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))  # one row
    return counts.crossJoin(F.broadcast(top)).where(F.col("n") > F.floor(F.col("top") / part)).drop("top")


def top_above_mean(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The first ``n`` of the values whose count exceeds the mean count, from the least frequent."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.crossJoin(F.broadcast(mean)).where("n > mean").drop("mean").orderBy("n", column).limit(n)


def stacked_scores(df: DataFrame, keys: list[str], predicted: str, score: str, at_most: float) -> DataFrame:
    """(keys, predicted, place, score): scores up to a limit, highest first, each list padded with 0 to the longest of its key."""
    kept = df.where(F.col(score) <= at_most)
    lists = kept.groupBy(*keys, predicted).agg(F.sort_array(F.collect_list(score), asc=False).alias("s"))
    longest = kept.groupBy(*keys, predicted).agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max("c").alias("longest"))
    padded = lists.join(longest, keys).withColumn("s", F.concat("s", F.array_repeat(F.lit(0.0), (F.col("longest") - F.size("s")).cast("int"))))
    return padded.select(*keys, predicted, F.posexplode("s").alias("place", score))


class KernelMap:
    """Nystroem's map of a radial kernel exp(-gamma |x - y|^2): inner products of mapped rows are the kernel's as seen from ``landmarks``.

    With all training rows as landmarks it is the kernel itself on these rows. Landmarks are standardised rows, of
    bounded number; gamma is one over the number of features unless it is given.
    """

    def __init__(self, landmarks: np.ndarray, gamma: float | None = None):
        self.landmarks, self.gamma = landmarks, gamma or 1.0 / landmarks.shape[1]
        values, vectors = np.linalg.eigh(self.kernel(landmarks))
        keep = values > 1e-10 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(axis=1)[:, None] + (self.landmarks * self.landmarks).sum(axis=1) - 2 * x @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.root


class KernelClassifier:
    """Support vectors with a radial kernel: standardise, map by landmarks, linear hinge loss on the mapped rows.

    ``fit`` takes the mean and deviation of every feature, ``landmarks`` rows of least hash of ``key`` (all, if there are
    fewer), and Spark's linear solver over all rows, of which equal ones are mapped once and weigh as many as they are, in tasks
    of FIT_ROWS different ones at most or so; so only landmarks pass through the driver. ``margins`` adds margin
    and prediction (0 or 1). Rows with a missing feature take no part in fitting and get null for both.
    """

    def __init__(self, features: list[str], label: str, key: str, landmarks: int = 128, gamma: float | None = None, regularisation: float = 0.01, iterations: int = 100):
        self.features, self.label, self.key, self.count = features, label, key, landmarks
        self.gamma, self.regularisation, self.iterations = gamma, regularisation, iterations

    def _mapped(self, df: DataFrame, extra: list[str]) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        mean, scale, kernel = self.mean, self.scale, self.map

        @F.pandas_udf("array<double>")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(list(kernel((np.array(x.tolist(), float).reshape(len(x), -1) - mean) / scale)))

        rows = df.dropna(subset=self.features).withColumn("__x", F.array(*[F.col(c).cast("double") for c in self.features]))
        return rows.select(*extra, array_to_vector(run("__x")).alias("__mapped"))

    def fit(self, train: DataFrame) -> KernelClassifier:
        from pyspark.ml.classification import LinearSVC

        sound = train.dropna(subset=[*self.features, self.label])
        moments = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(self.features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        stats = sound.agg(*moments, F.approx_count_distinct(F.xxhash64(*self.features, self.label)).alias("different")).first()
        self.mean = np.array([stats[f"m{i}"] for i in range(len(self.features))])
        self.scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(self.features))])
        chosen = sound.orderBy(F.md5(F.col(self.key).cast("string")), self.key).limit(self.count).select(*[F.col(c).cast("double") for c in self.features]).collect()
        self.map = KernelMap(np.unique((np.array(chosen, float) - self.mean) / self.scale, axis=0), self.gamma)
        svc = LinearSVC(featuresCol="__mapped", labelCol="__label", weightCol="__weight", regParam=self.regularisation, maxIter=self.iterations, tol=1e-8, standardization=False)
        of = [*self.features, "__label"]
        equal = sound.withColumn("__label", F.col(self.label).cast("double")).groupBy(*of).agg(F.count("*").cast("double").alias("__weight"))
        dealt = equal.repartition(-(-stats["different"] // FIT_ROWS) or 1, *of).sortWithinPartitions(*of)
        model = svc.fit(self._mapped(dealt, ["__label", "__weight"]))
        self.weights, self.intercept = model.coefficients.toArray(), model.intercept
        return self

    def margins(self, df: DataFrame) -> DataFrame:
        mean, scale, kernel, weights, intercept = self.mean, self.scale, self.map, self.weights, self.intercept

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            rows = np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), -1)
            out = kernel((rows - mean) / scale) @ weights + intercept
            return pd.Series(out).where(~np.isnan(rows).any(axis=1), None)

        df = df.withColumn("margin", run(F.array(*[F.col(c).cast("double") for c in self.features])))
        margin = F.when(~F.isnan("margin"), F.col("margin"))
        return df.withColumn("margin", margin).withColumn("predicted", (F.col("margin") > 0).cast("int"))


def classifier(train: DataFrame, features: list[str], label: str, classes: int, iterations: int = 50):
    """A fitted pipeline: assemble, standardise, linear support vectors (one against the rest for more classes).

    Margins are linear; ``KernelClassifier`` has those of a radial kernel.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    svc = LinearSVC(featuresCol="scaled", labelCol=label, maxIter=iterations)
    last = svc if classes == 2 else OneVsRest(classifier=svc, featuresCol="scaled", labelCol=label)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), last]).fit(train)
