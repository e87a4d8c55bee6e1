"""python -m linkspark.check_results RESULT [--candidates FILE] [--test DIR]: findings, and 0 if there is none.

RESULT has a row for each S1 id of the test set and a comma list of matched ids. With a candidates' file, matches that
aren't among the candidates are a warning. Exit codes: 0 sound, 1 findings, 2 a file that can't be read."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks as CK
from .sources.io import exists, id_set

MATCHES, CANDIDATES = ["source1_entity_id", "matched_entity_ids"], ["source1_entity_id", "candidate_entity_ids"]


def targets(spark: SparkSession, test: str, warnings: list[str]) -> DataFrame | None:
    """The ids of S2 and S3; a file that isn't there is a warning, and its ids aren't checked."""
    found = None
    for n in (2, 3):
        path = f"{test}/test_source{n}.tsv"
        if not exists(spark, path):
            warnings.append(f"{path} not found: ids of S{n} aren't checked")
            return None
        own = id_set(spark, path)
        found = own if found is None else found.unionByName(own)
    return found


def run(spark: SparkSession, result: str, test: str, candidates: str | None = None) -> tuple[int, list[str]]:
    said: list[str] = []
    required = f"{test}/test_source1.tsv"
    if not exists(spark, required):
        return 2, [f"{required} not found"]
    s1, known = id_set(spark, required).withColumnRenamed("id", "s1"), targets(spark, test, said)
    findings = [(result, r) for r in CK.check_submission(spark, result, MATCHES, s1, known).collect()]
    if candidates:
        findings += [(candidates, r) for r in CK.check_submission(spark, candidates, CANDIDATES, s1, known).collect()]
        if not findings:
            lost = CK.not_among_candidates(CK.id_lists(spark, result)[0], CK.id_lists(spark, candidates)[0]).agg(F.count("*")).first()[0]
            if lost:
                said.append(f"{lost} matched pairs aren't among the candidates")
    said += [f"{path}: {r['rule']}: {r['n']} ({', '.join(r['examples'])})" for path, r in findings]
    return (1 if findings else 0), said


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("result")
    parser.add_argument("--candidates")
    parser.add_argument("--test", default="dataset/test")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("check results").getOrCreate()
    try:
        code, said = run(spark, args.result, args.test, args.candidates)
    except UnicodeDecodeError as e:
        code, said = 2, [f"not UTF-8: {e}"]
    print("\n".join([*said, "PASS" if code == 0 else "FAIL"]))
    return code


if __name__ == "__main__":
    sys.exit(main())
