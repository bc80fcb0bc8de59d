"""Plan-shape checks that guard the scale properties of the registered queries."""

import contextlib
import io

import __spark_entry__ as E
from quire.plans.catalog import QUERIES

from conftest import SF_SMALL


def plan_text(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_no_query_plans_a_cross_product(spark):
    for name, fn in QUERIES.items():
        plan = plan_text(fn(spark, SF_SMALL), "simple")
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_filtered_topk_limits_before_the_shuffle(spark):
    plan = plan_text(E.queries()["filtered_topk"](spark, SF_SMALL), "simple")
    lines = [l.strip() for l in plan.splitlines()]
    limits = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l]
    exchanges = [i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l]
    # printed top-down: a group limit below (after) the exchange runs before it
    assert any(i > min(exchanges) for i in limits)


def test_tag_regex_evaluated_once(spark):
    plan = plan_text(E.queries()["tag_index"](spark, SF_SMALL), "simple")
    physical = plan.split("== Physical Plan ==")[-1]
    assert physical.count("regexp_extract_all") == 1


def test_error_filter_pushed_to_scan(spark):
    plan = plan_text(E.queries()["error_signatures"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_audit_regexes_evaluated_once(spark):
    physical = plan_text(E.queries()["audit_claims"](spark, SF_SMALL), "simple").split("== Physical Plan ==")[-1]
    assert physical.count("RLIKE") == 2


def test_redaction_chain_evaluated_once(spark):
    physical = plan_text(E.queries()["redact_text"](spark, SF_SMALL), "simple").split("== Physical Plan ==")[-1]
    assert physical.count("regexp_replace") == 3
