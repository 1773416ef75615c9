"""Classification metrics over scores(exp_id, fold, label, score).

Everything is grouped by (exp_id, fold), so that all runs are scored in one query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rank import cumulative_counts
from corpusloom.operators.sides import few
from corpusloom.sources.scratch import forget, stored

KEYS = ["exp_id", "fold"]


def pair_scores(labels: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """C4: labels and scores joined by keys; an error if a key is on one side only. The join is made once, and stored for the check and the result."""
    both = stored(labels.withColumn("__l", F.lit(1)).join(scores.withColumn("__s", F.lit(1)), keys, "full"), "pairs")
    alone = both.agg(F.count_if(F.col("__l").isNull()).alias("no_label"), F.count_if(F.col("__s").isNull()).alias("no_score")).first()
    if alone.no_label or alone.no_score:
        forget(both)
        raise ValueError(f"{alone.no_score} labels without a score, {alone.no_label} scores without a label")
    return both.drop("__l", "__s")


def threshold_predict(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The scores with predicted, 1 from the threshold on."""
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def confusion_counts(scores: DataFrame, threshold: float = 0.5, keys: list[str] = KEYS, pos_label: int = 1) -> DataFrame:
    """Tp, fp, fn and tn per run."""
    hit, true = F.col("score") >= threshold, F.col("label") == pos_label
    return scores.groupBy(*keys).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))


def precision_recall_f1(scores: DataFrame, threshold: float = 0.5, keys: list[str] = KEYS, zero_division: float = 0.0, pos_label: int = 1) -> DataFrame:
    """Precision, recall and f1 per run; zero_division where they are not defined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.when(b == 0, F.lit(float(zero_division))).otherwise(a / b)
    return confusion_counts(scores, threshold, keys, pos_label).select(*keys, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def average_precision(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """pr_auc per run: the step-wise average precision over distinct scores; 0 without positives."""
    steps = cumulative_counts(scores, keys)
    area = F.sum(F.col("pos") * F.col("tp") * F.lit(1.0) / F.col("seen"))
    return steps.groupBy(*keys).agg(F.when(F.sum("pos") == 0, F.lit(0.0)).otherwise(area / F.sum("pos")).alias("pr_auc"))


def pr_curve(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Threshold, precision and recall per distinct score of each run, and the last point (null, 1, 0)."""
    steps = cumulative_counts(scores, keys)
    total = steps.groupBy(*keys).agg(F.sum("pos").alias("__p"))
    rows = steps.join(total, keys)
    recall = F.when(F.col("__p") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("__p"))
    points = rows.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"), recall.alias("recall"))
    ends = total.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(ends)


def pr_baseline(scores: DataFrame) -> DataFrame:
    """The rate of positives per run, and pooled over the folds of an experiment (fold null)."""
    return scores.groupingSets([["exp_id", "fold"], ["exp_id"]], "exp_id", "fold").agg(F.avg("label").alias("pos_rate"), F.count("*").alias("n"))


def evaluate(scores: DataFrame, threshold: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """D10-D12 together: exp_id, fold, precision, recall, f1, pr_auc and threshold per run."""
    return precision_recall_f1(scores, threshold, keys).join(average_precision(scores, keys), keys).withColumn("threshold", F.lit(float(threshold)))


def aggregate_folds(metrics: DataFrame) -> DataFrame:
    """Per experiment, mean and sample deviation of its folds (null for one fold), and the folds themselves."""
    names = ("precision", "recall", "f1", "pr_auc")
    means = [F.avg(n).alias(f"mean_{n}") for n in names]
    deviations = [F.stddev_samp(n).alias(f"std_{n}") for n in names]
    return metrics.groupBy("exp_id").agg(F.count("*").alias("n_folds"), *means, *deviations, F.array_sort(F.collect_list(F.struct("fold", *names))).alias("per_fold"))


def class_weights(df: DataFrame, label_col: str, k: int | None = None) -> DataFrame:
    """Label and weight n / (k * n_label) for labels 0 to k - 1 (by default the largest + 1); absent: 0. An error for an empty table or negative labels."""
    label = F.col(label_col)
    each = df.where(label.isNotNull()).groupBy(label.cast("long").alias("label")).agg(F.count("*").alias("n"))
    span = each.agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("n")).first()
    if span.n is None:
        raise ValueError("no labels")
    if span.lo < 0:
        raise ValueError(f"negative label {span.lo}")
    k = k or span.hi + 1
    weight = F.coalesce(F.lit(float(span.n)) / (F.lit(k) * F.col("n")), F.lit(0.0))
    return df.sparkSession.range(k).withColumnRenamed("id", "label").join(each, "label", "left").select("label", weight.alias("weight"))


def attach_class_weight(df: DataFrame, weights: DataFrame, label_col: str) -> DataFrame:
    """The rows with the weight of their class. weights: one row per class."""
    return df.join(few(weights.select(F.col("label").alias("__l"), "weight")), F.col(label_col) == F.col("__l"), "left").drop("__l")


def weighted_log_loss(probabilities: DataFrame, weights: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Class-weighted cross entropy per run. probabilities: keys, label, p (of label 1), clipped at 1e-15."""
    rows = attach_class_weight(probabilities, weights, "label")
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    nll = -F.ln(F.when(F.col("label") == 1, p).otherwise(1 - p))
    return rows.groupBy(*keys).agg((F.sum(F.col("weight") * nll) / F.sum("weight")).alias("log_loss"))


def minmax_scores(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Scores scaled to [0, 1] per run; unchanged where all are equal."""
    span = scores.groupBy(*keys).agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col("score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.col("score"))
    return scores.join(few(span), keys).withColumn("score", scaled).drop("__lo", "__hi")


def results_table(metrics: DataFrame) -> DataFrame:
    """The holdout rows (fold -1), rounded to four decimals, by experiment."""
    names = ("precision", "recall", "f1", "pr_auc")
    return metrics.where("fold = -1").select("exp_id", *(F.round(n, 4).alias(n) for n in names)).orderBy("exp_id")


def select_best_config(aggregates: DataFrame, family: str = "family", value: str = "mean_pr_auc") -> DataFrame:
    """The experiment of the largest mean average precision per family; ties: the later id."""
    return aggregates.groupBy(family).agg(F.max_by("exp_id", F.struct(value, "exp_id")).alias("exp_id"), F.max(value).alias(value))


def compare_tracks(metrics: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per metric, the best holdout value of tracks A and B and their difference. tracks: exp_id, track."""
    rows = metrics.where("fold = -1").join(tracks, "exp_id")
    long = rows.select("track", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("precision", "recall", "f1", "pr_auc")))).alias("m")).select("track", "m.*")
    wide = long.groupBy("metric").pivot("track", ["A", "B"]).agg(F.max("value"))
    return wide.select("metric", F.col("A").alias("track_a"), F.col("B").alias("track_b"), (F.col("B") - F.col("A")).alias("delta"))
