"""Text classifier: train (M2), select (M3), evaluate (M4), predict (M5),
score into records (M6, F16) -- re-aimed at Spark ML.

The reference fine-tunes a pre-trained transformer (weights not available, a
single-machine deep-learning engine).  Here the classifier is a Spark ML
pipeline, fitted on executors: whitespace tokens -> hashed term frequencies
-> IDF -> multinomial logistic regression.  Model selection keeps the
reference's contract: rounds of growing training budget (max iterations, like
epochs), accuracy on the validation split after each, stop after ``patience``
rounds without improvement, at most ``max_rounds`` rounds, keep the best
(earliest on ties).  Features are computed once and checkpointed; each round
is one distributed fit plus one distributed evaluation.  Every optimizer step
sends a dense gradient per partition, so the features lie in at most one
partition a core: a step's traffic does not grow with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.session import cut_lineage


# Name recorded in artifacts and reports for the fitted pipeline.
MODEL_TYPE = "spark-ml-tfidf-logistic-regression"


@dataclass(frozen=True)
class TrainParams:
    max_rounds: int = 15        # num_train_epochs
    patience: int = 3           # early_stopping_patience
    reg_param: float = 0.01
    elastic_net: float = 0.0
    num_features: int = 1 << 18


def feature_stages(params: TrainParams, text_col: str = "text"):
    tok = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=tx.WHITESPACE_RUN, gaps=True,
                         toLowercase=True)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=params.num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    return [tok, tf, idf]


def classifier(params: TrainParams, max_iter: int) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="_label", maxIter=max_iter,
                              regParam=params.reg_param, elasticNetParam=params.elastic_net,
                              family="multinomial")


@dataclass
class Selection:
    model: PipelineModel
    history: DataFrame      # round, max_iter, val_accuracy, best
    best_round: int


def _with_label(df: DataFrame, label_idx: str) -> DataFrame:
    return df.filter(F.col(label_idx).isNotNull()).withColumn("_label", F.col(label_idx).cast("double"))


def _a_partition_a_core(df: DataFrame) -> DataFrame:
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def _val_accuracy(model, val_f: DataFrame) -> float:
    row = model.transform(val_f).agg(F.avg((F.col("prediction") == F.col("_label")).cast("double"))).first()
    return float(row[0]) if row[0] is not None else 0.0


def train_select(spark: SparkSession, train: DataFrame, val: DataFrame, params: TrainParams = TrainParams(),
                 text_col: str = "text", label_idx: str = "label_idx") -> Selection:
    """M2 + M3: fit on train, pick the round with the best validation accuracy."""
    tok, tf, idf = feature_stages(params, text_col)
    train_tf = tf.transform(tok.transform(_a_partition_a_core(_with_label(train, label_idx)))).select("_tf", "_label").persist()
    try:  # texts are split and hashed once for both
        idf = idf.fit(train_tf)
        train_f = cut_lineage(idf.transform(train_tf).select("features", "_label"))
    finally:
        train_tf.unpersist()
    feats = PipelineModel(stages=[tok, tf, idf])
    val_f = cut_lineage(feats.transform(_with_label(val, label_idx)).select("features", "_label"))
    best, best_acc, best_round, since, rows = None, -1.0, 0, 0, []
    for rnd in range(1, params.max_rounds + 1):
        lr_model = classifier(params, rnd).fit(train_f)
        acc = _val_accuracy(lr_model, val_f)
        rows.append((rnd, rnd, acc))
        if acc > best_acc:
            best, best_acc, best_round, since = lr_model, acc, rnd, 0
        else:
            since += 1
            if since >= params.patience:
                break
    history = spark.createDataFrame(
        [(r, m, a, r == best_round) for r, m, a in rows],
        "round int, max_iter int, val_accuracy double, best boolean",
    )
    model = PipelineModel(stages=[*feats.stages, best])
    return Selection(model, history, best_round)


def with_label_names(model: PipelineModel, labels: list[str]) -> PipelineModel:
    """The pipeline with decoding as its last stage, so that a saved model needs nothing else to name its classes."""
    return PipelineModel(stages=[*model.stages, IndexToString(inputCol="prediction", outputCol="predicted_class", labels=list(labels))])


def label_names(model: PipelineModel) -> list[str]:
    last = model.stages[-1]
    if not isinstance(last, IndexToString):
        raise ValueError("the pipeline does not decode its labels: see with_label_names")
    return list(last.getLabels())


def predict(model: PipelineModel, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """M5 + F16: predicted index / class, confidence (max probability), label -> probability map.

    Without ``labels`` the pipeline must decode its own (``with_label_names``)."""
    if labels is None:
        labels = label_names(model)
        decoded = F.col("predicted_class")
    else:
        decoded = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    names = F.array(*[F.lit(x) for x in labels])
    return (
        model.transform(df).withColumn("_p", vector_to_array(F.col("probability")))
        .withColumn("pred_idx", F.col("prediction").cast("int"))
        .withColumn("predicted_class", decoded)
        .withColumn("confidence", F.array_max("_p"))
        .withColumn("all_probabilities", F.map_from_arrays(names, F.col("_p")))
        .drop("_p", "_words", "_tf", "features", "rawPrediction", "probability", "prediction")
    )


def scored_record(scored: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ()) -> DataFrame:
    """M6: the reference's five-field record per comment (after any key columns)."""
    return scored.select(
        *keys,
        F.col(f"{text_col}_original").alias("original_text"),
        F.col(text_col).alias("processed_text"),
        "predicted_class", "confidence", "all_probabilities",
    )
