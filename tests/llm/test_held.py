"""What is read again at once is held by the executors, not written as checkpoints, and let go of."""

import glob

from linkspark.llm import common, warc


def _checkpoints(spark) -> set[str]:
    common.shared_dir(spark)
    return set(glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/rdd-*"))


def _held(spark) -> int:
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_archives_need_no_checkpoint(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(30)]
    before, held = _checkpoints(spark), _held(spark)
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"{tmp_path}/archives")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, f"{tmp_path}/archives").collect()}
    assert got == {i: ("response", None) if i < 7 else ("revisit", i % 7) for i in range(30)}
    assert _checkpoints(spark) == before
    assert _held(spark) == held
