"""Fitted trees as a table (M6, M13, J6): one row per node, scored and weighed by DataFrame expressions.

``node_table`` reads a saved ensemble's nodes: (model, tree, weight, depth, node,
feature, threshold, left, right, value, gain, n). A vote is a descent inside
the row: the nodes of all trees are one array, known to every task like a
literal (their number is fixed by the ensemble's size, not by the data), and a
row goes down each tree by index. Importances are one aggregate over nodes.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.fixed import CLASS_CUT
from retentio.operators.clean import _c

def node_table(spark: SparkSession, pipeline_dir: str, models: tuple[str, ...], features: list[str],
               depths: dict[str, int]) -> DataFrame:
    """The nodes of the tree stages 1, 2, .. of a saved pipeline, named by ``models``.

    ``value`` of a node: the share of the positive class for a forest, the
    prediction for boosted trees. Inner nodes have a feature; a row goes left
    where its value is at most the threshold. ``depths``: each model's greatest depth, so many steps reach a leaf.
    """
    names = F.array(*map(F.lit, features))
    out = None
    for i, model in enumerate(models):
        # the stage's folder starts with its number; Spark lists it
        data = spark.read.parquet(os.path.join(pipeline_dir, "stages", f"{i + 1}_*", "data"))
        trees = spark.read.parquet(os.path.join(pipeline_dir, "stages", f"{i + 1}_*", "treesMetadata")).select(
            F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
        node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
        boosted = model.startswith("boosted")
        total = stats[0] if boosted else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value = node["prediction"] if boosted else stats[1] / total
        rows = data.join(trees, "treeID").select(
            F.lit(model).alias("model"), F.col("treeID").alias("tree"), "weight", node["id"].alias("node"),
            F.when(node["leftChild"] >= 0, F.get(names, node["split"]["featureIndex"])).alias("feature"),
            F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"), value.alias("value"),
            node["gain"].alias("gain"), total.alias("n"), F.lit(depths[model]).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _whole_trees(nodes: DataFrame, features: list[str]) -> DataFrame:
    """One row: all trees as (model, weight, depth, nodes), a tree's nodes at the places that its links name.

    Both links of a leaf name the leaf itself, so a descent that goes on stays there.
    """
    at = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    leaf = F.col("left") < 0
    node = F.struct("node", F.coalesce(F.element_at(at, F.col("feature")), F.lit(-1)).alias("f"), "threshold",
                    F.when(leaf, F.col("node")).otherwise(F.col("left")).alias("left"),
                    F.when(leaf, F.col("node")).otherwise(F.col("right")).alias("right"), "value")
    trees = nodes.groupBy("model", "tree", "weight", "depth").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return trees.agg(F.array_sort(F.collect_list(F.struct("model", "tree", "weight", "depth", "nodes"))).alias("trees"))


def vote(df: DataFrame, nodes: DataFrame, features: list[str], prob_col: str = "Churn_Probability",
         class_cut: float = CLASS_CUT) -> DataFrame:
    """``df`` (with the model features) with the ensemble's probability and class, from the node table alone.

    A forest's probability is the mean of its leaves' shares; a boosted
    ensemble's is 1 / (1 + exp(-2 m)) of its weighted sum m; the vote is the
    mean over models.
    """
    x = F.array(*[_c(f).cast("double") for f in features])
    trees = _whole_trees(nodes, features).scalar()

    def leaf(tree: Column, row: Column) -> Column:
        # what a step needs is bound once: the node it is at, the row's values and the tree's nodes; inside a lambda
        # an expression is evaluated wherever it is written
        def down(places: Column) -> Column:
            def step(n: Column, _: Column) -> Column:
                return F.get(places, F.when(F.get(row, n["f"]) <= n["threshold"], n["left"]).otherwise(n["right"]))

            return F.aggregate(F.sequence(F.lit(1), tree["depth"]), F.get(places, F.lit(0)), step)["value"]

        return F.get(F.transform(F.array(tree["nodes"]), down), F.lit(0))

    def leaves_of(both: Column) -> Column:
        return F.transform(both["trees"], lambda t: F.struct(t["model"].alias("model"), t["weight"].alias("weight"),
                                                             leaf(t, both["x"]).alias("value")))

    leaves = df.withColumn("__both", F.struct(x.alias("x"), trees.alias("trees"))).withColumn(
        "__trees", F.get(F.transform(F.array("__both"), leaves_of), F.lit(0)))
    models = sorted(r[0] for r in nodes.select("model").distinct().collect())  # the ensemble's members

    def of(model: str) -> Column:
        mine = F.filter("__trees", lambda t: t["model"] == model)
        total = F.aggregate(mine, F.lit(0.0), lambda a, t: a + t["weight"] * t["value"])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * total)) if model.startswith("boosted") else total / F.size(mine)

    p = sum((of(m) for m in models), F.lit(0.0)) / len(models)
    return (leaves.withColumn(prob_col, p).withColumn("Predicted_Churn_Numeric", (F.col(prob_col) > class_cut).cast("int"))
            .drop("__both", "__trees"))


def importances(nodes: DataFrame) -> DataFrame:
    """(model, feature, importance), the features that some node splits on.

    A node's gain counts as often as it has rows; a forest's trees count
    alike, boosted trees by their gains; a model's importances sum to 1.
    """
    by_tree = (nodes.where("feature is not null").groupBy("model", "tree", "feature")
               .agg(F.sum(F.col("gain") * F.col("n")).alias("gained")))
    whole = by_tree.groupBy("model", "tree").agg(F.sum("gained").alias("whole"))
    share = F.when(F.col("model").startswith("boosted"), F.col("gained")).otherwise(F.col("gained") / F.col("whole"))
    summed = (by_tree.join(whole, ["model", "tree"]).where("whole <> 0").groupBy("model", "feature")
              .agg(F.sum(share).alias("gained")))
    total = summed.groupBy("model").agg(F.sum("gained").alias("whole"))
    return summed.join(total, "model").select("model", "feature", (F.col("gained") / F.col("whole")).alias("importance"))
