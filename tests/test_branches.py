"""No query of ``q_branches`` may miss a branch it is there for; nor may dedupe_resubmits return what it reads."""

import pytest

from conftest import SF_SMALL
from lodgelake.plans.registry import QUERIES  # isort: skip  (loads the queries)
from lodgelake.plans.q_branches import BRANCHES


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_every_branch_is_reached(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    missed = [c for c in BRANCHES[name] if df.where(c.replace("column =", "`column` =")).isEmpty()]
    assert not missed


def test_resubmits_are_dropped(spark, views):
    kept = QUERIES["dedupe_resubmits"](spark, SF_SMALL).count()
    assert 0 < kept < views.resent_messages.count()
