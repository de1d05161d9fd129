"""Tabular ML (ML1–ML6, G12, G14, N7) on ``pyspark.ml``.

* ML1: text columns → ``StringIndexer(handleInvalid="keep")`` +
  ``OneHotEncoder(dropLast=True)``: every known category gets a slot and an
  unseen or NULL value (the extra "keep" index, the dropped last slot) becomes
  the all-zero vector; numeric columns pass through (P9 splits them by type).
  The indexer keeps its values on the driver; columns of more than
  ``MAX_CATEGORIES`` values get their slots from a ``Dictionary`` table instead,
  with the same vectors.
* ML2 / N7: stratified 80/20 split: per class, the rows with the smallest
  ``md5(key ':' seed)``, found by counting buckets of the hash and ranking
  within a bucket, so no task sees a whole class.  ``exact=False`` decides each
  row by its hash alone (approximate class shares, no shuffle).
* ML3 / ML4: ``LogisticRegression(maxIter=500)``; an L2 penalty with C=1 on the
  summed loss equals ``regParam = 1/(C·n)`` on Spark's mean loss, without
  standardisation; string labels go through ``StringIndexer`` / ``IndexToString``.
* ML5 / G12: accuracy = mean of (label == prediction) and the test size.
* ML6 / K6: ``PipelineModel`` save / load and batch ``transform``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

MAX_ITER = 500
TEST_SIZE = 0.2
SEED = 42
MAX_CATEGORIES = 200_000


def split_columns(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """Text (and boolean) columns are categorical, numeric ones pass through."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    cat, num = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, (T.StringType, T.BooleanType)):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    return cat, num


def wide_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more distinct values than an indexer should keep on the driver."""
    if not columns:
        return []
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > MAX_CATEGORIES]


@dataclass
class Dictionary:
    """Slots of text columns as a table (column, value, slot), however many values there are.

    Slots are numbered over range partitions of the distinct values by prefix
    counts (``rank_in_groups``); nothing but each column's number of values
    reaches the driver.  Rows get their slots by joins, which Spark broadcasts
    for small columns and shuffles for large ones."""
    table: DataFrame
    sizes: dict[str, int]

    @classmethod
    def build(cls, df: DataFrame, columns: list[str]) -> "Dictionary":
        from .read import rank_in_groups
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
        values = df.select(pairs).select("p.*").where("value IS NOT NULL").distinct()
        table = rank_in_groups(values, ["column"], [F.col("value").asc()], "slot").select("column", "value", (F.col("slot") - 1).alias("slot"))
        sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls(table, {c: sizes.get(c, 0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        """``<column>__idx``: the value's slot; for unseen values and NULL the number after the last one, which the encoder drops."""
        for c, n in self.sizes.items():
            slots = self.table.where(F.col("column") == c).select(F.col("value").alias("__value"), F.col("slot").alias("__slot"))
            df = df.join(slots, F.col(c).cast("string") == F.col("__value"), "left").withColumn(f"{c}__idx", F.coalesce("__slot", F.lit(n)).cast("double")).drop("__value", "__slot")
            if n:  # the encoder takes the number of known values from here, as from an indexer's column
                df = df.withMetadata(f"{c}__idx", {"ml_attr": {"type": "nominal", "name": f"{c}__idx", "num_vals": n}})
        return df


@dataclass
class DictionaryModel:
    """A fitted pipeline behind a dictionary of its wide columns."""
    dictionary: Dictionary
    pipeline: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.dictionary.transform(df))


def class_count(df: DataFrame, label: str) -> DataFrame:
    """Number of distinct labels (decides whether the split is stratified)."""
    return df.agg(F.count_distinct(F.col(label)).alias("n_classes"))


def row_key(df: DataFrame, cols: list[str] | None = None):
    """A deterministic per-row key (hash of the row's values) for splitting."""
    cols = cols or df.columns
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in cols])))


def stratified_split(df: DataFrame, label: str | None, key: str, test_size: float = TEST_SIZE,
                     seed: int = SEED, exact: bool = True) -> DataFrame:
    """Adds ``is_test``: per class, the ``ceil(test_size · n)`` rows with the
    smallest ``md5(key ':' seed)`` (ties by key).  ``label=None`` splits the whole
    table as one class."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    if not exact:
        bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(10000))
        return df.withColumn("is_test", bucket < int(test_size * 10000))
    # rank by buckets of the hash's first bits: counts say which buckets are taken whole, so rows are
    # ranked within one bucket of their class only (at most 65,536 counts a class)
    rows = df.withColumn("__h", h).withColumn("__class", F.to_json(F.struct(F.col(label).alias("v"))) if label else F.lit(""))
    rows = rows.withColumn("__bucket", F.substring("__h", 1, 4))
    counts = rows.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    by_class = counts.groupBy("__class").agg(F.ceil(F.lit(test_size) * F.sum("__n")).alias("__need"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = counts.withColumn("__before", before).join(by_class, "__class").select("__class", "__bucket", (F.col("__need") - F.col("__before")).alias("__quota"))
    rank = F.row_number().over(Window.partitionBy("__class", "__bucket").orderBy("__h", F.col(key)))
    out = rows.withColumn("__rank", rank).join(quota, ["__class", "__bucket"])
    return out.select(*df.columns, (F.col("__rank") <= F.col("__quota")).alias("is_test"))


def accuracy(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """G12 / ML5: share of rows whose prediction equals the label, and the row count."""
    hit = F.when(F.col(label).cast("string") == F.col(prediction).cast("string"), 1.0).otherwise(0.0)
    return pred.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_test"))


def build_pipeline(cat: list[str], num: list[str], target: str, n_train: int, C: float = 1.0,
                   max_iter: int = MAX_ITER, wide: list[str] = ()) -> Pipeline:
    """``wide`` columns have their index already (``Dictionary.transform``)."""
    narrow = [c for c in cat if c not in wide]
    idx = [f"{c}__idx" for c in narrow]
    ohe = [f"{c}__ohe" for c in [*narrow, *wide]]
    stages = []
    if narrow:
        stages.append(StringIndexer(inputCols=narrow, outputCols=idx, handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe[:len(narrow)], dropLast=True))  # the indexer's extra index is the last
    if wide:
        # an index beyond the known ones takes the extra last slot, which is dropped
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in wide], outputCols=ohe[len(narrow):], dropLast=True, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=ohe + num, outputCol="__features", handleInvalid="keep"))
    stages.append(LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__pred",
                                     maxIter=max_iter, regParam=1.0 / (C * max(n_train, 1)),
                                     elasticNetParam=0.0, standardization=False))
    return Pipeline(stages=stages)


@dataclass
class TrainResult:
    model: PipelineModel | DictionaryModel
    metrics: DataFrame        # one row: accuracy, n_test
    predictions: DataFrame    # test rows with `prediction`


def _with_label_text(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("__label_text", F.col(target).cast("string"))


def train(df: DataFrame, target: str, test_size: float = TEST_SIZE, seed: int = SEED,
          C: float = 1.0, max_iter: int = MAX_ITER, exact_split: bool = True) -> TrainResult:
    """ML1–ML5: split (stratified when the target has more than one class),
    fit one pipeline on the train part, score the test part."""
    cat, num = split_columns(df, target)
    wide = wide_columns(df, cat)
    keyed = df.withColumn("__key", row_key(df))
    n_classes = class_count(df, target).first()["n_classes"]   # one small aggregate
    split = stratified_split(keyed, target if n_classes > 1 else None, "__key", test_size, seed, exact_split)
    checkpoint_dir(df.sparkSession)
    split = split.checkpoint()  # decided once: fitting and scoring read it back
    train_df = _with_label_text(split.where(~F.col("is_test")), target)
    test_df = _with_label_text(split.where(F.col("is_test")), target)
    n_train = train_df.count()
    # the label index is only needed to fit; the saved model turns indexes back into labels
    label = StringIndexer(inputCol="__label_text", outputCol="__label", handleInvalid="error").fit(train_df)
    dictionary = Dictionary.build(train_df, wide) if wide else None
    rows = dictionary.transform(train_df) if wide else train_df
    fitted = build_pipeline(cat, num, target, n_train, C, max_iter, wide).fit(label.transform(rows))
    model = PipelineModel(fitted.stages + [IndexToString(inputCol="__pred", outputCol="prediction", labels=label.labels)])
    if wide:
        model = DictionaryModel(dictionary, model)
    pred = predict(model, test_df)
    return TrainResult(model, accuracy(pred, target, "prediction"), pred)


def predict(model: PipelineModel | DictionaryModel, df: DataFrame) -> DataFrame:
    """ML6: batch predictions; ``prediction`` holds the original label text."""
    out = model.transform(df)
    internal = [c for c in out.columns if c.startswith("__") or c.endswith("__idx") or c.endswith("__ohe")
                or c in ("rawPrediction", "probability")]
    return out.drop(*internal)


def save_model(model: PipelineModel | DictionaryModel, path: str) -> None:
    """K6; a dictionary is saved as a table beside its pipeline."""
    if isinstance(model, DictionaryModel):
        model.dictionary.table.write.mode("overwrite").parquet(f"{path}/dictionary")
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | DictionaryModel:
    from pyspark.sql import SparkSession

    from ..sources.sinks import path_exists
    spark = SparkSession.getActiveSession()
    if not path_exists(spark, f"{path}/dictionary"):
        return PipelineModel.load(path)
    table = spark.read.parquet(f"{path}/dictionary")
    sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return DictionaryModel(Dictionary(table, sizes), PipelineModel.load(f"{path}/pipeline"))
