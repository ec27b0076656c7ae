"""Tables that grow with the input are not broadcast, however few bytes they have compressed."""

import contextlib
import io

import pytest

from quernel.plans import semantic


@pytest.mark.parametrize("name", ["reference_end_to_end", "verify_invocations"])
def test_facts_meet_declarations_without_a_broadcast(spark, name):
    out = getattr(semantic, name)(spark, "/root/testdata/sf0.001")
    with contextlib.redirect_stdout(io.StringIO()) as told:
        out.explain()
    joins = [x for x in told.getvalue().splitlines() if "Join [" in x]
    # the variants are a row for each brand and framework
    assert any("SortMergeJoin" in x for x in joins) and not [x for x in joins if "BroadcastHashJoin" in x and "[variant" not in x]
