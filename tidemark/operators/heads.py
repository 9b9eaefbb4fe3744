"""Model heads on Spark ML: boosted trees, logistic scorers, tree rules, isotonic calibration, weights."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import shared_path, stored


def _inputs(features: list[str]) -> list:
    """Medians of the training rows fill gaps."""
    filled = [f"{c}_filled" for c in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="x_")]


def class_weights(rows: DataFrame, y: str) -> DataFrame:
    """Rows with w_, which gives both classes the same mass."""
    sums = rows.agg(F.avg(y).alias("base_"))
    return rows.crossJoin(F.broadcast(sums)).withColumn("w_", F.when(F.col(y) == 1, 0.5 / F.greatest("base_", F.lit(1e-9))).otherwise(0.5 / F.greatest(1 - F.col("base_"), F.lit(1e-9)))).drop("base_")


def fit_head(train: DataFrame, features: list[str], y: str, kind: str = "trees", **settings):
    """A fitted pipeline for one binary head."""
    model = {
        "trees": lambda: GBTClassifier(featuresCol="x_", labelCol=y, weightCol="w_", maxIter=settings.get("iterations", 20), maxDepth=settings.get("depth", 4), stepSize=settings.get("step", 0.05), subsamplingRate=0.8, seed=7),
        "logistic": lambda: LogisticRegression(featuresCol="x_", labelCol=y, weightCol="w_", maxIter=50, regParam=settings.get("ridge", 0.01)),
        "forest": lambda: RandomForestClassifier(featuresCol="x_", labelCol=y, weightCol="w_", numTrees=settings.get("trees", 20), maxDepth=settings.get("depth", 5), seed=7),
    }[kind]()
    return Pipeline(stages=[*_inputs(features), model]).fit(class_weights(train, y))


def predict(model, rows: DataFrame, name: str) -> DataFrame:
    keep = rows.columns
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*keep, name)


def walk_forward(rows: DataFrame, folds: list[tuple[str, str, str]], features: list[str], y: str, name: str, kind: str = "trees", **settings) -> DataFrame:
    """Out-of-fold scores: for each (train before, test from, test before) one model; nothing later is in reach of it. A fit reads its rows many times, so
    they are worked out once and written to the shared folder."""
    out, rows = None, stored(rows, "walk-forward")
    for k, (until, start, end) in enumerate(folds):
        train = rows.where((F.col("day") < F.lit(until).cast("date")) & F.col(y).isNotNull())
        test = rows.where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
        part = predict(fit_head(train, features, y, kind, **settings), test, name).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


class Rule(NamedTuple):
    """A path of a fitted tree: conditions (feature, <= or >, threshold), all of which hold, and the leaf's number and rate in training."""

    leaf: int
    conditions: tuple[tuple[str, str, float], ...]
    rate: float

    def text(self) -> str:
        return " AND ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions) or "all rows"

    def holds(self, medians: dict[str, float]) -> Column:
        """The rule as a predicate; a missing feature has its training median, as in the model."""
        out = F.lit(True)
        for f, op, t in self.conditions:
            x = F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(float(medians[f])))
            out = out & ((x <= t) if op == "<=" else (x > t))
        return out


def fit_tree(rows: DataFrame, features: list[str], y: str, depth: int = 3, min_rows: int = 200):
    """A fitted shallow tree over weighted rows (w_)."""
    tree = DecisionTreeClassifier(featuresCol="x_", labelCol=y, weightCol="w_", maxDepth=depth, minInstancesPerNode=min_rows, leafCol="leaf", seed=7)
    return Pipeline(stages=[*_inputs(features), tree]).fit(rows)


def compile_rules(model, features: list[str]) -> tuple[list[Rule], dict[str, float]]:
    """The leaves of a fitted tree, left to right, as rules; and the medians that stand for missing features."""
    tree, found = model.stages[-1]._java_obj, []

    def walk(node, conditions: tuple) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            counts = list(node.impurityStats().stats())
            found.append(Rule(len(found), conditions, counts[1] / sum(counts) if len(counts) > 1 and sum(counts) else 0.0))
            return
        split = node.split()
        name, at = features[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), (*conditions, (name, "<=", at)))
        walk(node.rightChild(), (*conditions, (name, ">", at)))

    walk(tree.rootNode(), ())
    row = model.stages[0].surrogateDF.first()
    return found, {f: row[f] for f in features}


def rules_by_fold(rows: DataFrame, rules: list[Rule], medians: dict[str, float], y: str, fold: str) -> DataFrame:
    """(fold, leaf, rule, n, hits, rate, base, lift): each rule on each fold's rows, in one pass; every row meets exactly one rule. Null labels don't count; lift
    is null in a fold without hits."""
    number = F.coalesce(*[F.when(r.holds(medians), F.lit(r.leaf)) for r in rules])
    text = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.leaf, r.text())]), F.col("leaf"))
    per = rows.where(F.col(y).isNotNull()).groupBy(fold, number.alias("leaf")).agg(F.count("*").alias("n"), F.sum(y).alias("hits"))
    base = F.try_divide(F.sum("hits").over(Window.partitionBy(fold)), F.sum("n").over(Window.partitionBy(fold)))
    per = per.withColumns({"rate": F.col("hits") / F.col("n"), "base": base})
    return per.withColumns({"lift": F.try_divide("rate", "base"), "rule": text})


def isotonic(train: DataFrame, rows: DataFrame, p: str, y: str, name: str) -> DataFrame:
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol=name).fit(train.select(F.col(p).cast("double"), F.col(y).cast("double")))
    return model.transform(rows)


def intercept_shift(rows: DataFrame, p: str, y: str, steps: int = 25) -> float:
    """The b that makes the mean of sigmoid(logit(p) + b) the observed rate: Newton steps, each an aggregate over all rows."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    logits = rows.select(F.log(clipped / (1 - clipped)).alias("z"), F.col(y).cast("double").alias("y")).groupBy("z").agg(F.sum("y").alias("y"), F.count("*").alias("n")).cache()
    b = 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("z") + b)))
        g = logits.agg(F.sum(F.col("n") * q - F.col("y")).alias("g"), F.sum(F.col("n") * q * (1 - q)).alias("h")).first()
        if not g.h or abs(g.g / g.h) < 1e-10:
            break
        b -= max(-2.0, min(2.0, g.g / g.h))
    logits.unpersist()
    return b


def shifted(p: Column, b: float) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(F.log(c / (1 - c)) + b)))


def band_weights(rows: DataFrame, band: str, y: str) -> DataFrame:
    """Weights that give each class the same mass within each band (few values), and bands the mass of their rows. A band is counted, not gathered."""
    per = rows.groupBy(F.col(band).alias("band_")).agg(F.sum(y).alias("pos_"), F.count("*").alias("n_"))
    pos, n = F.col("pos_"), F.col("n_")
    counted = rows.join(F.broadcast(per), F.col(band).eqNullSafe(F.col("band_")))
    return counted.withColumn("weight", F.when(F.col(y) == 1, n / 2 / F.nullif(pos, F.lit(0))).otherwise(n / 2 / F.nullif(n - pos, F.lit(0)))).drop("band_", "pos_", "n_")


def greedy_matches(rows: DataFrame, picked: str, value: str) -> DataFrame:
    """(day, market, control, reason): each picked row, in rank order, takes the free other row of its day with the nearest value, ties by name.

    A day whose picks lack a value, or that has fewer others with a value than picks, has no matches but a reason: selected_value_missing,
    insufficient_controls. A day is one array of a universe's names; picks fold over what is still free of it.
    """
    pick = F.struct("rk", "market", F.col(value).cast("double").alias("v"))
    other = F.struct("market", F.col(value).cast("double").alias("v"))
    days = rows.groupBy("day").agg(
        F.array_sort(F.collect_list(F.when(F.col(picked), pick))).alias("picks"), F.array_sort(F.collect_list(F.when(~F.col(picked) & F.col(value).isNotNull(), other))).alias("free"),
    )
    missing = F.exists("picks", lambda p: p["v"].isNull())
    reason = F.when(missing, "selected_value_missing").when(F.size("free") < F.size("picks"), "insufficient_controls")
    days = days.where(F.size("picks") > 0).withColumn("reason", reason)

    def take(acc: Column, p: Column) -> Column:
        best = F.array_min(F.transform(acc["free"], lambda f: F.struct(F.round(F.abs(f["v"] - p["v"]), 9).alias("gap"), f["market"].alias("market"))))["market"]
        return F.struct(F.filter(acc["free"], lambda f: f["market"] != best).alias("free"), F.concat(acc["out"], F.array(F.struct(p["market"].alias("market"), best.alias("control")))).alias("out"))

    kind = rows.schema["market"].dataType.simpleString()
    start = F.struct(F.col("free").alias("free"), F.array().cast(f"array<struct<market:{kind},control:{kind}>>").alias("out"))
    taken = F.aggregate("picks", start, take, lambda acc: acc["out"])
    none = F.transform("picks", lambda p: F.struct(p["market"].alias("market"), F.lit(None).cast(kind).alias("control")))
    return days.select("day", "reason", F.explode(F.when(F.col("reason").isNull(), taken).otherwise(none)).alias("m")).select("day", "m.market", "m.control", "reason")


def sweep(rows: DataFrame, folds: list[tuple[str, str, str]], feature_sets: dict[str, list[str]], models: dict[str, dict], heads: list[str], name: str) -> DataFrame:
    """rows of the test folds with set, model, fold and a score a head: rows are worked out once, each (set, model, fold, head) is fitted once and its scores are
    written once to the shared folder, where all cut-offs, universes and regimes read them. models: {name: {"kind": ..., settings}}."""
    out, rows = None, stored(rows, f"{name}-rows")
    for label, features in feature_sets.items():
        for model, settings in models.items():
            options = {k: v for k, v in settings.items() if k != "kind"}
            for k, (until, start, end) in enumerate(folds):
                train = rows.where(F.col("day") < F.lit(until).cast("date"))
                part = rows.where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date")))
                for head in heads:
                    part = predict(fit_head(train.where(F.col(head).isNotNull()), features, head, settings["kind"], **options), part, f"p_{head}")
                part = part.withColumns({"set": F.lit(label), "model": F.lit(model), "fold": F.lit(k)})
                out = part if out is None else out.unionByName(part)
    path = shared_path(rows.sparkSession, name)
    out.write.parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path)
