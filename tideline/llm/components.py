"""Connected components of a graph given as edges, by hooking labels and pointer jumping over written tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import fresh_key, written


def local_labels(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels (the smallest index) of n vertices within one task, from label (if given) and links."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            return label
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def tree_edges(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the members of each label as a balanced binary tree: few rounds to contract, and no vertex with many edges."""
    order = np.argsort(label, kind="stable")
    sorted_label = label[order]
    first = np.flatnonzero(np.r_[True, sorted_label[1:] != sorted_label[:-1]]) if len(order) else np.empty(0, int)
    start = np.repeat(first, np.diff(np.r_[first, len(order)]))
    at = np.arange(len(order)) - start
    child = at > 0
    return order[(start + (at - 1) // 2)[child]], order[child.nonzero()[0]]


def star_edges(label: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (nodes) from each member of a label to the smallest node with it: where many tasks see parts of one component, most of them name the same few."""
    least = np.full(len(label), np.iinfo(node.dtype).max, node.dtype)
    np.minimum.at(least, label, node)
    to = least[label]
    away = to != node
    return node[away], to[away]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every vertex of ``edges(u long, v long)``: label is the smallest vertex of its component.

    Each round every component's label hooks onto the smallest label beside it, then labels jump to their label's label;
    rounds grow with the logarithm of the longest path. Sums are made before shuffles, and the joins
    on labels, which a large component shares, are of the kind that AQE splits. Null ends and loops are ignored; no
    edges give no rows.
    """
    both = edges.where("u is not null and v is not null and u <> v")
    both = written(both.union(both.select("v", "u")).distinct(), "edges")
    label = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        beside = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "node")
        seen = label.join(beside, "node").select("node", "label", F.least("label", "near").alias("near"))
        seen = written(seen, "seen")
        # what a label's members have seen moves the label itself, so whole components hook at once
        hook = written(seen.where("near < label").groupBy("label").agg(F.min("near").alias("to")), "hook")
        if hook.isEmpty():
            return label
        jump = hook
        for _ in range(2):  # a hook leads to a smaller label, which may hook as well
            on = jump.select(F.col("label").alias("mid"), F.col("to").alias("end"))
            jump = jump.join(on, jump["to"] == on["mid"], "left").select("label", F.coalesce("end", "to").alias("to"))
        jump = written(jump, "jump").select(fresh_key("label").alias("key"), "to")
        label = written(seen.join(jump, seen["label"] == jump["key"], "left").select("node", F.least("near", F.coalesce("to", "near")).alias("label")), "labels")
