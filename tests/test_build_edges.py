"""Edges between builds: repeated input rows tell no edge twice, without a comparison of the edges themselves."""

import contextlib
import io

from quernel.operators import graph


def test_repeated_rows_tell_edges_once_and_edges_are_not_aggregated(spark):
    instances = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", False), (3, "a", False), (4, "b", False), (5, "c", False), (6, "c", False)], "id long, path string, outer boolean")
    references = spark.createDataFrame([(4, "a"), (4, "a"), (2, "b"), (2, "c"), (1, "b"), (5, None)], "src long, path string")
    out = graph.build_edges(instances, references)
    assert sorted(map(tuple, out.collect())) == [(1, 2), (1, 3), (2, 4), (4, 1), (4, 2), (4, 3)]
    with contextlib.redirect_stdout(io.StringIO()) as told:
        out.explain()
    assert not any("HashAggregate(keys=[src" in x and "dst" in x for x in told.getvalue().splitlines())
