"""Boosted trees and ridge regression on feature tables, with early stopping, weights and importances."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.numeric import clip
from starloom.operators.skew import maybe_broadcast
from starloom.session import Stored, durable, one_row

# Boosting settings per history band: shallow and strongly damped where little is known.
PARAMS_BY_BAND = {
    "cold": {"maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 50, "subsamplingRate": 0.8},
    "known": {"maxDepth": 5, "stepSize": 0.1, "minInstancesPerNode": 20, "subsamplingRate": 0.9},
    "known_prefix": {"maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 30, "subsamplingRate": 0.9},
}
# The experts of the tabular mixture: no history and long histories want larger leaves.
EXPERT_PARAMS = {
    "0": {"maxDepth": 4, "minInstancesPerNode": 120},
    "1": {"maxDepth": 5, "minInstancesPerNode": 60},
    "2-20": {"maxDepth": 5, "minInstancesPerNode": 60},
    ">20": {"maxDepth": 5, "minInstancesPerNode": 80},
}
MAX_LEVELS = 60  # levels of a column that trees split by sets
FOLDS = 5
DAMPING = 10.0  # rows of the overall mean in the mean label of a level
MISSING = "__missing__"
STAGES_READ = 4  # stages whose predictions are computed when rows are read, before they are stored with them
COLD_WEIGHTS = {"1": 1.5, "2-5": 1.2}  # all other bands weigh 1


def band_weight(band: Column) -> Column:
    """Rows of short histories weigh more when the cold model is fitted."""
    out = F
    for name, w in COLD_WEIGHTS.items():
        out = out.when(band == name, w)
    return out.otherwise(1.0)


def numeric_columns(df: DataFrame, leave_out: list[str]) -> list[str]:
    kinds = ("double", "float", "integer", "long", "short", "byte")
    return [f.name for f in df.schema.fields if f.dataType.typeName() in kinds and f.name not in leave_out]


def categorical_columns(df: DataFrame, leave_out: list[str]) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name not in leave_out]


class Categories:
    """Text columns as features of trees.

    A column of at most ``MAX_LEVELS`` levels becomes the number of its level, marked as nominal, so that trees split sets of levels; a level
    not seen in the fit has number 0. A column of more levels becomes the damped mean label of its level; the rows of the fit get that of the
    other folds, so that no row sees its own label. A missing value is a level of its own.
    """

    def __init__(self, columns: list[str], label: str):
        self.columns, self.label = list(columns), label

    def _long(self, df: DataFrame, columns: list[str], more: list) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(MISSING)).alias("level")) for c in columns])
        return df.select(*more, F.explode(cells).alias("cell")).select("cell.*", *[m if isinstance(m, str) else "_fold" for m in more])

    def fold(self) -> Column:
        return F.pmod(F.xxhash64(*self.folded_by), F.lit(FOLDS)).cast("int")

    def fit(self, train: DataFrame, folded_by: list[str]) -> "Categories":
        self.folded_by = folded_by
        self.narrow, self.wide, self.encoded = {}, [], None
        if not self.columns:
            return self
        counts = durable(self._long(train, self.columns, [self.label, self.fold().alias("_fold")]).groupBy("column", "level", "_fold").agg(F.count(self.label).alias("n"), F.sum(self.label).alias("s")))
        sizes = {r["column"]: r["levels"] for r in counts.groupBy("column").agg(F.countDistinct("level").alias("levels")).collect()}
        few = [c for c in self.columns if sizes.get(c, 0) <= MAX_LEVELS]
        self.narrow = {c: [] for c in few}
        for r in counts.where(F.col("column").isin(few)).select("column", "level").distinct().orderBy("column", "level").collect():  # MAX_LEVELS each
            self.narrow[r["column"]].append(r["level"])
        self.wide = [c for c in self.columns if c not in self.narrow]
        if self.wide:
            rows = counts.where(F.col("column").isin(self.wide))
            g = one_row(rows.agg((F.sum("s") / F.sum("n")).alias("g")))["g"]
            total = rows.groupBy("column", "level").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
            damped = lambda s, n: (s + DAMPING * g) / (n + DAMPING)
            own = rows.join(total, ["column", "level"]).select("column", "level", "_fold", damped(F.col("_s") - F.col("s"), F.col("_n") - F.col("n")).alias("value"))
            new = total.select("column", "level", F.lit(-1).alias("_fold"), damped(F.col("_s"), F.col("_n")).alias("value"))
            self.encoded, self.overall = durable(own.unionByName(new)), float(g)
        return self

    def apply(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        """The rows with each categorical column ``c`` beside its feature ``_cat_c``."""
        added = []
        for c, levels in self.narrow.items():
            at = F.array_position(F.array(*[F.lit(x) for x in levels]), F.coalesce(F.col(c), F.lit(MISSING))) if levels else F.lit(0)
            added.append(at.cast("double").alias(f"_cat_{c}", metadata={"ml_attr": {"type": "nominal", "vals": ["__unseen__", *levels], "name": f"_cat_{c}"}}))
        rows = df.select("*", *added)
        for c in self.wide:
            own = self.encoded.where((F.col("column") == c) & ((F.col("_fold") >= 0) if fitting else (F.col("_fold") == -1)))
            own = maybe_broadcast(own.select(F.col("level").alias("_level"), F.col("_fold").alias("_its_fold"), F.col("value").alias(f"_cat_{c}")))
            match = F.coalesce(rows[c], F.lit(MISSING)) == own["_level"]
            match = match & (self.fold() == own["_its_fold"]) if fitting else match
            rows = rows.join(own, match, "left").drop("_level", "_its_fold").fillna({f"_cat_{c}": self.overall})
        return rows


class Remaining:
    """Rows of a fit, stored once as columns, with what the stages so far leave of the label in ``_left``.

    Vectors are assembled when the rows are read, so that only compressed columns lie on disk. The predictions of the last stages are
    computed then as well; every ``STAGES_READ`` stages the rows are replaced by rows that include them.
    """

    def __init__(self, df: DataFrame, features: list[str]):
        self.stored, self.features, self.waiting = Stored(df.withColumn("_label", F.col("_left")), "boosted"), features, []
        self.columns = {f.name: f.metadata for f in df.schema.fields}

    def rows(self, models=None) -> DataFrame:
        """The rows after all stages, or after ``models``, the first ones of the fit."""
        rows = self.stored.rows.withColumns({c: F.col(c).alias(c, metadata=self.columns[c]) for c in self.features if self.columns[c]})
        rows = rows if models is None else rows.withColumn("_left", F.col("_label"))
        rows = VectorAssembler(inputCols=self.features, outputCol="_features").transform(rows)
        for model in self.waiting if models is None else models:
            rows = model.transform(rows).withColumn("_left", F.col("_left") - F.col("_p")).drop("_p")
        return rows

    def after(self, model) -> None:
        self.waiting.append(model)
        if len(self.waiting) == STAGES_READ:
            self.stored, self.waiting = self.stored.replaced_by(self.rows().drop("_features"), "boosted"), []

    def delete(self) -> None:
        self.stored.delete()


class Booster:
    """Gradient-boosted trees with absolute loss, fitted in stages, stopped early, refitted on all rows.

    ``fit`` adds stages of ``stage`` rounds, each on what the stages before leave, and measures the error on the validation rows after each round,
    all rounds of a stage in one pass. It stops when the best round is ``patience`` rounds old and cuts the model behind the best round.
    ``refit`` fits as many rounds to all rows. Without validation rows all ``rounds`` are kept. A missing number counts as 0 unless the
    feature table filled it; ``categorical`` columns are text (``Categories``).
    """

    def __init__(self, features: list[str], label="rating", weight: str | None = None, rounds=20, patience: int | None = None, stage: int | None = None, categorical: list[str] = (), **params):
        self.features, self.label, self.weight, self.rounds, self.params = list(features), label, weight, rounds, params
        self.patience, self.stage, self.categories = patience or max(1, rounds), stage or patience or 10, Categories(categorical, label)

    @property
    def inputs(self) -> list[str]:
        return self.features + self.categories.columns

    @property
    def assembled(self) -> list[str]:
        return self.features + [f"_cat_{c}" for c in self.categories.columns]

    def _filled(self, df: DataFrame, fitting: bool = False) -> DataFrame:
        return self.categories.apply(df, fitting).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features})

    def _assembled(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.assembled, outputCol="_features").transform(self._filled(df)).drop(*[f"_cat_{c}" for c in self.categories.columns])

    def _learner(self, rounds: int) -> GBTRegressor:
        params = {"maxBins": max(32, MAX_LEVELS + 2), **self.params}
        learner = GBTRegressor(featuresCol="_features", labelCol="_left", predictionCol="_p", lossType="absolute", maxIter=rounds, seed=42, **params)
        return learner.setWeightCol(self.weight) if self.weight else learner

    def _prepared(self, rows: DataFrame, fitting: bool) -> Remaining:
        key = ["review_id"] if "review_id" in rows.columns and "review_id" not in self.inputs else []
        keep = [*key, *self.inputs, self.label] + ([self.weight] if self.weight else [])
        rows = rows.select(*keep)
        if fitting:
            self.categories.fit(rows, key or self.inputs)
        left = F.col(self.label).cast("double").alias("_left")
        return Remaining(self._filled(rows, fitting).select(*self.assembled, left, *([self.weight] if self.weight else [])), self.assembled)

    def fit(self, train: DataFrame, validation: DataFrame | None = None) -> "Booster":
        rows = self._prepared(train, True)
        held = None if validation is None else self._prepared(validation, False)
        self.models, self.errors = [], []
        if held is None or held.rows().isEmpty():
            self.models = [self._learner(self.rounds).fit(rows.rows())]
            self.best_rounds = self.rounds
        else:
            self._fit_stages(rows, held)
        for part in (rows, held):
            if part is not None:
                part.delete()
        return self

    def _fit_stages(self, rows: Remaining, held: Remaining) -> None:
        while True:
            model = self._learner(min(self.stage, self.rounds - len(self.errors))).fit(rows.rows())
            self.errors += model.evaluateEachIteration(held.rows(), "absolute")
            self.models.append(model)
            best = min(range(len(self.errors)), key=lambda i: self.errors[i]) + 1
            if len(self.errors) >= self.rounds or len(self.errors) - best >= self.patience:
                break
            rows.after(model)
            held.after(model)
        whole, more = divmod(best, self.stage)
        self.best_rounds, self.models = best, self.models[:whole] + ([self.models[whole]] if more else [])
        if more and self.models[whole].getNumTrees != more:
            self.models[whole] = self._learner(more).fit(rows.rows(self.models[:whole]))

    def refit(self, rows: DataFrame) -> "Booster":
        """The same number of rounds, in the same stages, on all ``rows``."""
        rows, self.models = self._prepared(rows, True), []
        for done in range(0, self.best_rounds, self.stage):
            if self.models:
                rows.after(self.models[-1])
            self.models.append(self._learner(min(self.stage, self.best_rounds - done)).fit(rows.rows()))
        rows.delete()
        return self

    def _scored(self, df: DataFrame) -> DataFrame:
        rows = self._assembled(df).withColumn("_total", F.lit(0.0))
        for model in self.models:
            rows = model.transform(rows).withColumn("_total", F.col("_total") + F.col("_p")).drop("_p")
        return rows

    def predict(self, df: DataFrame, out: str = "prediction", key: str = "review_id") -> DataFrame:
        """The rows with a prediction limited to 1..5; feature columns come back unchanged."""
        scored = self._scored(df.select(key, *[c for c in self.inputs if c != key])).select(F.col(key).alias("_key"), clip(F.col("_total"), 1, 5).alias(out))
        return df.join(scored, df[key] == scored["_key"], "left").drop("_key")

    def score(self, df: DataFrame, keep: list[str], out: str = "prediction") -> DataFrame:
        """Only the named columns and the prediction, without a join."""
        return self._scored(df).select(*keep, clip(F.col("_total"), 1, 5).alias(out))

    def importance(self) -> DataFrame:
        """Share of each feature in the gains of all trees, stages weighted by their number of trees."""
        trees = [m.getNumTrees for m in self.models]
        values = sum(m.featureImportances.toArray() * n for m, n in zip(self.models, trees)) / sum(trees)
        rows = sorted(((f, float(v)) for f, v in zip(self.inputs, values)), key=lambda r: -r[1])
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")

    @property
    def model(self):
        """The model of the first stage, the only one of a fit without validation."""
        return self.models[0]


class Ridge:
    """Ridge regression on standardized columns. A missing feature counts as its mean over the fit rows, also when scoring."""

    def __init__(self, features: list[str], label="rating", alpha: float = 1.0):
        self.features, self.label, self.alpha = features, label, alpha

    def fit(self, train: DataFrame) -> "Ridge":
        means = one_row(train.agg(*[F.avg(v).alias(c) for c, v in self._present().items()]))
        self.means = {c: float(means[c] or 0.0) for c in self.features}
        rows = durable(self._assembled(train.select(*self.features, self.label).filter(F.col(self.label).isNotNull())))
        self.scaler = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True).fit(rows)
        n = max(rows.count(), 1)
        learner = LinearRegression(featuresCol="_features", labelCol=self.label, predictionCol="_p", elasticNetParam=0.0, regParam=self.alpha / n, standardization=False)
        self.model = learner.fit(self.scaler.transform(rows))
        return self

    def _present(self) -> dict[str, Column]:
        return {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in self.features}

    def _assembled(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"_x_{c}": F.coalesce(v, F.lit(self.means[c])) for c, v in self._present().items()})
        return VectorAssembler(inputCols=[f"_x_{c}" for c in self.features], outputCol="_raw").transform(filled).drop(*[f"_x_{c}" for c in self.features])

    def score(self, df: DataFrame, keep: list[str], out: str = "prediction") -> DataFrame:
        rows = self.model.transform(self.scaler.transform(self._assembled(df)))
        return rows.select(*keep, clip(F.col("_p"), 1, 5).alias(out))
