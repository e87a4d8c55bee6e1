"""Components of few links are joined in one task, as those of many are in rounds; workers give memory back."""

import os
import re

import numpy as np
import pyarrow as pa

from linkspark.llm import common, jaccard


def test_components_of_few_links(spark):
    rng = np.random.default_rng(5)
    name = [bytes(rng.integers(0, 256, 16, np.uint8)) for _ in range(400)]
    links = [(name[a], name[b]) for a, b in rng.integers(0, 400, (260, 2)) if a != b] + [(name[i], name[i + 1]) for i in range(60)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in links], "a binary, b binary").repartition(5)
    stages = []
    got = {}
    for few in (0, jaccard.FEW):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"few {few}", "")
        found = jaccard.components(df, few).collect()
        stages.append(len(tracker.getJobIdsForGroup(f"few {few}")))
        got[few] = {bytes(r.node): bytes(r.label) for r in found}
        assert len(found) == len(got[few])
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    label = {x: x for pair in links for x in pair}
    for _ in range(400):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got[0] == got[jaccard.FEW] == label and stages[1] < stages[0] / 2
    assert jaccard.components(df.limit(0)).count() == 0


def test_workers_give_memory_back():
    def resident() -> int:
        with open("/proc/self/status") as lines:
            return int(re.search(r"VmRSS:\s+(\d+)", lines.read())[1]) >> 10

    def run(batches):
        for batch in batches:
            held = [os.urandom(60_000) for _ in range(2000)]  # below what the C library maps apart
            kept = held[-1]
            del held
            yield batch if kept else None

    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    before = resident()
    assert list(common.trimmed(run)(iter([batch, batch]))) == [batch, batch]
    assert resident() < before + 60
