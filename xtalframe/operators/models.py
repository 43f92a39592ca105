"""Feature preparation and the four forest models on MLlib.

Preparation statistics are ordinary aggregates, categories are tables. What
fitting brings to the driver is one row of means and deviations and one row per
categorical column, and what MLlib's forests bring there.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xtalframe.functions.text import no_nan
from xtalframe.functions.vectors import sparse_vector
from xtalframe.operators.metrics import classification_metrics, regression_metrics
from xtalframe.operators.split import row_ids, split_two_way
from xtalframe.session import stored

# The feature columns of the interchange tables.
CATEGORICAL = ["elements", "crystal_system_pg"]
NUMERIC = [
    "num_elements",
    "density_pg",
    "volume_pg",
    "volume_per_atom_pg",
    "spacegroup_number_pg",
    "lattice_a_pg",
    "lattice_b_pg",
    "lattice_c_pg",
    "lattice_alpha_pg",
    "lattice_beta_pg",
    "lattice_gamma_pg",
    "num_sites_pg",
]
# These two equal two of the targets; kept only on request.
LEAKING = ["band_gap_mp", "formation_energy_per_atom_mp"]
MAIN_TARGETS = ["target_band_gap", "target_formation_energy", "target_is_metal"]


def _value(column: str) -> Column:
    return no_nan(F.col(column).cast("double"))


def impute_stats(df: DataFrame, numeric: list[str]) -> DataFrame:
    """One row: mean of each numeric column over its present values."""
    return df.agg(*[F.avg(_value(c)).alias(f"{c}_mean") for c in numeric])


def scale_stats(df: DataFrame, numeric: list[str]) -> DataFrame:
    """One row: mean and population standard deviation after mean imputation.

    Filling gaps with the mean leaves the mean and shrinks the variance by the
    share of present values, so one pass over the raw column is enough.
    """
    share = lambda c: F.count(_value(c)) / F.count(F.lit(1))
    return df.agg(
        *[F.avg(_value(c)).alias(f"{c}_mean") for c in numeric],
        *[F.sqrt(F.var_pop(_value(c)) * share(c)).alias(f"{c}_std") for c in numeric],
    )


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row: most frequent value of a column, the smallest one on ties.

    Counted by group and reduced by top-1 per task; no task ever holds the
    full set of distinct values.
    """
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value").asc())
        .limit(1)
        .select(F.lit(column).alias("feature"), "value", "n")
    )


def numeric_prep(df: DataFrame, train: DataFrame, numeric: list[str]) -> DataFrame:
    """Impute and scale numeric columns with statistics of the training rows.

    A column without spread is only centred. The statistics enter as scalar
    subqueries: no join, and nothing is collected.
    """
    packed = scale_stats(train, numeric).select(F.struct("*").alias("stats")).scalar()
    with_stats = df.withColumn("_stats", packed)
    out = {}
    for c in numeric:
        mean, std = F.col(f"_stats.{c}_mean"), F.col(f"_stats.{c}_std")
        out[c] = (F.coalesce(_value(c), mean) - mean) / F.when(std > 0, std).otherwise(1.0)
    return with_stats.withColumns(out).drop("_stats")


def category_dictionary(df: DataFrame, column: str) -> DataFrame:
    """value, position: the distinct values of a column in order, from 0.

    Positions are places in range partitions plus the partitions' offsets; no
    task and no driver holds the list.
    """
    distinct = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    numbered = row_ids(distinct, "value", "_number")
    return numbered.select("value", (F.col("_number") - 1).alias("position"))


@dataclass
class Preprocessor:
    """Imputation, scaling and one-hot encoding as fitted on training rows.

    ``numeric``: column -> (mean, deviation). ``modes``: categorical column ->
    what fills its gaps. ``dictionaries``: categorical column -> its stored
    dictionary (value, position), ``sizes`` their rows. The vector has the
    numeric columns first, then one place for each category.
    """

    numeric: dict[str, tuple[float, float]]
    modes: dict[str, str]
    dictionaries: dict[str, DataFrame]
    sizes: dict[str, int]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(self.sizes.values())

    def places(self, df: DataFrame) -> DataFrame:
        """Add ``<column>__at`` for each categorical column: the vector's place
        that is set, null for a category not seen in training.

        One join with each dictionary, on its unique values: a category that
        very many rows have can be split by adaptive execution.
        """
        start = len(self.numeric)
        for c, dictionary in self.dictionaries.items():
            own = dictionary.select(F.col("value").alias(f"{c}__value"), (F.col("position") + start).alias(f"{c}__at"))
            filled = F.coalesce(F.col(c), F.lit(self.modes[c]))
            df = df.join(own, filled == F.col(f"{c}__value"), "left").drop(f"{c}__value")
            start += self.sizes[c]
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``features``, a sparse vector of ``width``."""
        placed = self.places(df)
        scaled = [(F.coalesce(_value(c), F.lit(mean)) - mean) / (std or 1.0) for c, (mean, std) in self.numeric.items()]
        at = [F.col(f"{c}__at") for c in self.dictionaries]
        set_ = F.array_compact(F.array(*at)) if at else F.array().cast("array<bigint>")
        indices = F.concat(F.array(*[F.lit(k).cast("bigint") for k in range(len(scaled))]).cast("array<bigint>"), set_)
        values = F.concat(F.array(*scaled).cast("array<double>"), F.transform(set_, lambda _: F.lit(1.0)))
        return placed.withColumn("features", sparse_vector(self.width, indices, values)).drop(*[f"{c}__at" for c in self.dictionaries])

    def save(self, folder: str) -> None:
        """Dictionaries as tables, numbers and modes as one small table."""
        spark = SparkSession.active()
        for c, dictionary in self.dictionaries.items():
            dictionary.write.mode("overwrite").parquet(f"{folder}/dictionary/{c}")
        rows = [(c, mean, std, None, None) for c, (mean, std) in self.numeric.items()]
        rows += [(c, None, None, mode, self.sizes[c]) for c, mode in self.modes.items()]
        rows = [(k, *r) for k, r in enumerate(rows)]
        spark.createDataFrame(rows, _FITTED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/fitted")

    @classmethod
    def load(cls, folder: str) -> Preprocessor:
        spark = SparkSession.active()
        rows = spark.read.schema(_FITTED).parquet(f"{folder}/fitted").orderBy("place").collect()  # one row a column
        numeric = {r["column"]: (r["mean"], r["std"]) for r in rows if r["size"] is None}
        categorical = [r for r in rows if r["size"] is not None]
        read = {r["column"]: spark.read.schema("value string, position bigint").parquet(f"{folder}/dictionary/{r['column']}") for r in categorical}
        return cls(numeric, {r["column"]: r["mode"] for r in categorical}, read, {r["column"]: r["size"] for r in categorical})


_FITTED = "place int, column string, mean double, std double, mode string, size bigint"


def fit_preprocessor(
    train: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None
) -> Preprocessor:
    """Fit imputation, scaling and one-hot encoding on the training rows.

    A numeric column without any value is left out; a gap in a categorical
    column counts as its most frequent value (the empty text where there is
    none); a category not seen in training sets no place. One row of means and
    deviations comes to the driver, and one row for each categorical column.
    """
    numeric = list(NUMERIC if numeric is None else numeric)
    categorical = list(CATEGORICAL if categorical is None else categorical)
    stats = scale_stats(train, numeric).first() if numeric else {}
    fitted = {c: (float(stats[f"{c}_mean"]), float(stats[f"{c}_std"])) for c in numeric if stats[f"{c}_mean"] is not None}
    modes, dictionaries, sizes = {}, {}, {}
    for c in categorical:
        mode = most_frequent(train, c).first()
        modes[c] = "" if mode is None else mode["value"]
        filled = train.select(F.coalesce(F.col(c), F.lit(modes[c])).alias(c))
        dictionaries[c] = stored(category_dictionary(filled, c), "categories")
        sizes[c] = dictionaries[c].count()
    return Preprocessor(fitted, modes, dictionaries, sizes)


@dataclass(frozen=True)
class Forest:
    """Forest settings."""

    trees: int = 10
    depth: int = 10
    seed: int = 42


@dataclass
class PropertyModels:
    """The fitted models; a missing one only disables its own prediction."""

    main: Preprocessor | None = None
    dos_prep: Preprocessor | None = None
    band_gap: object | None = None
    formation_energy: object | None = None
    is_metal: object | None = None
    dos: object | None = None
    metrics: dict[str, DataFrame] = field(default_factory=dict)


def _regressor(label: str, forest: Forest) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol=f"predicted_{label}",
        numTrees=forest.trees,
        maxDepth=forest.depth,
        seed=forest.seed,
        featureSubsetStrategy="all",
    )


def _fit_regressor(train: DataFrame, test: DataFrame, label: str, forest: Forest):
    model = _regressor(label, forest).fit(train)
    return model, regression_metrics(model.transform(test), label, f"predicted_{label}")


def features_used(reference_features: bool = False) -> list[str]:
    """Numeric feature names; with ``reference_features`` also the leaking two."""
    return (LEAKING if reference_features else []) + NUMERIC


def fit_dos_regressor(
    table: DataFrame,
    key: str = "material_id",
    test_size: float = 0.2,
    forest: Forest = Forest(),
    numeric: list[str] | None = None,
) -> tuple[Preprocessor, object, DataFrame]:
    """Density of states for metals that have one: (preprocessor, model, metrics)."""
    metals = table.where(F.col("target_is_metal")).dropna(subset=["target_dos_at_fermi"])
    parts = split_two_way(metals, key, test_size, forest.seed)
    train, test = parts.where("split = 'train'"), parts.where("split = 'test'")
    prep = fit_preprocessor(train, numeric)
    model, metrics = _fit_regressor(
        prep.transform(train), prep.transform(test), "target_dos_at_fermi", forest
    )
    return prep, model, metrics


def _main_parts(table: DataFrame, key: str, test_size: float, seed: int):
    complete = table.dropna(subset=MAIN_TARGETS)
    parts = split_two_way(complete, key, test_size, seed)
    return parts.where("split = 'train'"), parts.where("split = 'test'")


def fit_main_regressor(
    table: DataFrame,
    label: str,
    key: str = "material_id",
    test_size: float = 0.2,
    forest: Forest = Forest(),
    numeric: list[str] | None = None,
    prep: Preprocessor | None = None,
) -> tuple[Preprocessor, object, DataFrame]:
    """Band gap or formation energy: (preprocessor, model, metrics)."""
    train, test = _main_parts(table, key, test_size, forest.seed)
    prep = prep or fit_preprocessor(train, numeric)
    model, metrics = _fit_regressor(prep.transform(train), prep.transform(test), label, forest)
    return prep, model, metrics


def fit_metal_classifier(
    table: DataFrame,
    key: str = "material_id",
    test_size: float = 0.2,
    forest: Forest = Forest(),
    numeric: list[str] | None = None,
    prep: Preprocessor | None = None,
) -> tuple[Preprocessor, object, DataFrame]:
    """Metal or not: (preprocessor, model, metrics)."""
    train, test = _main_parts(table, key, test_size, forest.seed)
    prep = prep or fit_preprocessor(train, numeric)
    label = F.col("target_is_metal").cast("double").alias("label")
    model = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        predictionCol="predicted_metal",
        probabilityCol="metal_probability",
        rawPredictionCol="metal_raw",
        numTrees=forest.trees,
        maxDepth=forest.depth,
        seed=forest.seed,
    ).fit(prep.transform(train).select("features", label))
    scored = model.transform(prep.transform(test).select("features", label))
    return prep, model, classification_metrics(scored, "label", "predicted_metal")


def fit_all(
    table: DataFrame,
    key: str = "material_id",
    test_size: float = 0.2,
    forest: Forest = Forest(),
    reference_features: bool = False,
) -> PropertyModels:
    """Fit the four models; the three main ones share split and preprocessor."""
    numeric = features_used(reference_features)
    models = PropertyModels()
    common = dict(key=key, test_size=test_size, forest=forest)
    models.main, models.band_gap, models.metrics["target_band_gap"] = fit_main_regressor(
        table, "target_band_gap", numeric=numeric, **common
    )
    shared = dict(prep=models.main, **common)
    _, models.formation_energy, models.metrics["target_formation_energy"] = fit_main_regressor(
        table, "target_formation_energy", **shared
    )
    _, models.is_metal, models.metrics["target_is_metal"] = fit_metal_classifier(table, **shared)
    models.dos_prep, models.dos, models.metrics["target_dos_at_fermi"] = fit_dos_regressor(
        table, numeric=numeric, **common
    )
    return models


_PREPARED = ["main", "dos_prep"]
_FILES = [*_PREPARED, "band_gap", "formation_energy", "is_metal", "dos"]


def save_models(models: PropertyModels, folder: str) -> None:
    """Write every fitted part below ``folder``: preprocessors as tables, models
    as MLlib directories."""
    for name in _FILES:
        part = getattr(models, name)
        if isinstance(part, Preprocessor):
            part.save(f"{folder}/{name}")
        elif part is not None:
            wrapped = part if isinstance(part, PipelineModel) else PipelineModel([part])
            wrapped.write().overwrite().save(f"{folder}/{name}")


def load_models(folder: str) -> PropertyModels:
    """Read what is there; a part whose folder is missing stays ``None``. Any
    other failure to read one is raised."""
    models = PropertyModels()
    for name in _FILES:
        kind = Preprocessor if name in _PREPARED else PipelineModel
        try:
            setattr(models, name, kind.load(f"{folder}/{name}"))
        except (PySparkException, Py4JJavaError) as error:
            if "does not exist" not in str(error) and "PATH_NOT_FOUND" not in str(error):
                raise
            warnings.warn(f"model part {name} is not available: {str(error)[:120]}", stacklevel=2)
    return models


def score_properties(df: DataFrame, models: PropertyModels, key: str = "material_id") -> DataFrame:
    """Predicted class with its probability, gap, energy and, where a metal is
    predicted, density of states. A prediction whose model is missing is null.
    Rows meet the category dictionaries by joins; models travel to the rows."""
    null = F.lit(None).cast("double")
    out = df
    names: dict[str, Column] = {}
    if models.main is not None:
        out = models.main.transform(out)
    have = models.main is not None
    if have and models.is_metal is not None:
        out = models.is_metal.transform(out)
        chance = F.array_max(vector_to_array(F.col("metal_probability")))
        names["predicted_is_metal"] = F.col("predicted_metal") == 1.0
        names["predicted_probability"] = chance
    if have and models.band_gap is not None:
        out = models.band_gap.transform(out)
        names["predicted_band_gap"] = F.col("predicted_target_band_gap")
    if have and models.formation_energy is not None:
        out = models.formation_energy.transform(out)
        names["predicted_formation_energy"] = F.col("predicted_target_formation_energy")
    if "predicted_is_metal" in names and models.dos_prep is not None and models.dos is not None:
        out = models.dos.transform(models.dos_prep.transform(out.drop("features")))
        names["predicted_dos_at_fermi"] = F.when(
            names["predicted_is_metal"], F.col("predicted_target_dos_at_fermi")
        )
    wanted = [
        ("predicted_is_metal", F.lit(None).cast("boolean")),
        ("predicted_probability", null),
        ("predicted_band_gap", null),
        ("predicted_formation_energy", null),
        ("predicted_dos_at_fermi", null),
    ]
    return out.select(key, *[names.get(n, default).alias(n) for n, default in wanted])

