"""Workers drop what an operator cached in them when a step without Python follows."""

import time

import pyarrow as pa

from quernel.llm import common, toxicity


def in_workers(spark, act):
    cores = spark.sparkContext.defaultParallelism

    def run(batches):
        told = act()
        time.sleep(0.2)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([told] * b.num_rows, pa.int64())], ["n"])

    return [r.n for r in spark.range(0, cores, 1, cores).mapInArrow(run, "n long").collect()]


def test_forget_clears_the_caches_of_workers(spark):
    def fill():
        common.claim("toxicity", toxicity._cache.clear)
        toxicity._cache["values"] = {"a": 1.0}
        return len(toxicity._cache)

    assert sum(in_workers(spark, fill)) > 0
    common.forget(spark)
    assert sum(in_workers(spark, lambda: len(toxicity._cache))) == 0
