"""Connected components of a link table by spreading the least label with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written

#: Links that a task unites at once.
CHUNK = 500_000


def _stars(batches):
    """Links of each chunk, replaced by links of every node with the least node of its component in the chunk."""

    def united(held):
        a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        use = label != np.arange(len(nodes))
        return pa.record_batch([pa.array(nodes[use]), pa.array(nodes[label[use]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield united(held)
            held, n = [], 0
    if n:
        yield united(held)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): the label is the least node reachable. Repeated links and loops do no harm."""
    links = links.select("a", "b").filter("a <> b").mapInArrow(_stars, "a long, b long")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        after = written(step.join(far, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), "old"))
        labels = after.select("node", "label")
        if not after.filter("label <> old").limit(1).count():
            return labels
