"""Headline timings as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every
timing runs to its last row, after a warm-up on the smallest scale.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from termloom.operators.clauses import Clause  # noqa: E402
from termloom.plans import bindings as B  # noqa: E402
from termloom.plans.index import StoredIndex  # noqa: E402
from termloom.plans.search import search, search_keywords  # noqa: E402
from termloom.sources import corpus as S  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def finish(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def thousand_queries(index: StoredIndex) -> DataFrame:
    """1,000 queries of three index terms each, the same in every run."""
    terms = index.terms_for().orderBy(F.xxhash64("term"), "term").limit(3000)
    numbered = terms.select("term", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(1000)).alias("qid"))
    return numbered.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("keyword"))


def one_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change to every hundredth document, deletes and upserts by turns."""
    docs = S.documents(spark, sf_dir).select(
        F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("seq"), "path"
    )
    op = F.when(F.col("seq") % 200 == 0, "delete").otherwise("modify")
    return docs.filter("seq % 100 = 0").select(
        "seq", F.current_timestamp().alias("ts"), op.alias("op"), "path",
        F.lit(None).cast("string").alias("old_path"),
    )


def run(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    taken: dict[str, float] = {}

    def timed(name, work):
        begun = time.perf_counter()
        result = work()
        taken[name] = round(time.perf_counter() - begun, 3)
        return result

    corpus = S.documents(spark, sf_dir)
    index = timed(
        "index_build", lambda: StoredIndex.open(spark, B.new_root(spark, "bench")).build(corpus)
    )
    timed("search_one", lambda: search(index, [Clause(0, 0, terms=["trash"])]).collect())
    timed("search_boolean", lambda: search(index, [
        Clause(0, 0, "must", terms=["the"]), Clause(0, 1, "must", terms=["of"]),
        Clause(0, 2, "must_not", terms=["trash"]),
    ]).collect())
    timed("search_phrase", lambda: search(index, [Clause(0, 0, kind="phrase", terms=["of the"])]).collect())
    timed("search_benchmark_texts", lambda: finish(search_keywords(index, B.keyword_queries(spark, sf_dir))))
    timed("search_benchmark_phrases", lambda: finish(search(index, B.phrase_queries(spark, sf_dir))))
    timed("search_thousand", lambda: finish(search_keywords(index, thousand_queries(index))))
    changed = timed(
        "apply_one_percent", lambda: index.apply(one_percent(spark, sf_dir), corpus, B.ALL_EXTENSIONS)
    ).index
    timed("search_after_change", lambda: search(changed, [Clause(0, 0, terms=["trash"])]).collect())
    return taken


def main() -> None:
    spark = session()
    run(spark, "/root/testdata/sf0.001")
    taken = run(spark, SF_DIR)
    print(json.dumps({
        "metric": "full-text index build, search and update", "value": round(sum(taken.values()), 3),
        "unit": "sec", "queries": taken, "sf": Path(SF_DIR).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
