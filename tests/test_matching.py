"""The stateful stream against the batch operator."""

import os

import numpy as np

from lockstep.operators import alignment
from lockstep.streaming import matching


def test_greedy_matches_as_they_arrive(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(4):
        other = rng.choice(list("abcdefgh"), 60).tolist()
        mine = [t for t in other if rng.random() < 0.8]
        mine[10:10] = ["x", "y"]
        rows += [(f"k{k}", 0, i, t) for i, t in enumerate(mine)] + [(f"k{k}", 1, i, t) for i, t in enumerate(other)] + [(f"k{k}", 1, 60, None)]
    kind = "k string, side int, place long, token string"
    batch = spark.createDataFrame([r for r in rows if r[3] is not None], kind)
    want = sorted(map(tuple, alignment.greedy_align(batch, ["k"], "side", "place", "token", 4).collect()))
    order = rng.permutation(len(rows))
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for part in np.array_split(order, 5):  # shuffled over five micro-batches, some rows twice
        again = [rows[i] for i in [*part, *part[:7]]]
        spark.createDataFrame(again, kind).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    q = matching.greedy_matches(stream, "k", ahead=4).writeStream.outputMode("append").format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("matched").collect())) == want and len(q.recentProgress) >= 5
