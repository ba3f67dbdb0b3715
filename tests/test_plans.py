"""Plan-shape guards: the physical plans keep the properties the design relies on."""

from wordloom.operators.match import word_map
from wordloom.operators.normalize import tokenize, vocabulary
from wordloom.plans import inputs

from conftest import SMALL_SF

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_main_pass_has_no_per_token_regex(spark, normalizer):
    comments = inputs.comments(spark, SMALL_SF)
    plan = _plan(normalizer.annotate(tokenize(comments, "text", keys=("row_id", "split"))))
    assert "lower(word" not in plan          # cleaning runs per distinct raw token, not here
    assert "IsUppercase" not in plan         # case patterns too
    assert "BroadcastHashJoin" in plan
    assert not any(f in plan for f in FORBIDDEN)


def test_regroup_reuses_row_partitioning(spark, normalizer):
    plan = _plan(normalizer.normalize(inputs.comments(spark, SMALL_SF), "text"))
    # one exchange (the spread by row_id), none between it and the per-row aggregate
    assert plan.count("Exchange hashpartitioning(row_id") <= 1
    assert not any(f in plan for f in FORBIDDEN)


def test_cascade_is_hash_joins(spark, dictionary):
    toks = tokenize(inputs.comments(spark, SMALL_SF), "text")
    for strategy in ("bucket", "deletion"):
        plan = _plan(word_map(vocabulary(toks), dictionary, strategy=strategy))
        assert "BroadcastHashJoin" in plan and not any(f in plan for f in FORBIDDEN), strategy
