"""What the plans must and must not hold."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from proofmill.plans import registry

#: Pairs of arms are a handful of rows; constants are one row.
NESTED_LOOPS = {"provider_pairs", "context_extremes", "context_reduction"}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in NESTED_LOOPS


@pytest.mark.parametrize(("name", "table_columns"), [("accuracy_by_stratum", {"doc_id", "quality", "lang"}), ("case_wall_time", {"user_id", "ts"}), ("cost_by_currency", {"o_orderpriority", "o_totalprice", "o_orderstatus"})])
def test_scans_read_only_what_is_used(spark, sf_dir, name, table_columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(registry.queries()[name](spark, sf_dir)))
    assert {c.split(":")[0] for s in read for c in s.split(",")} == table_columns


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(registry.queries()["facet_filter"](spark, sf_dir))
    assert any("In(event_type" in line and "In(user_id" in line for line in re.findall(r"PushedFilters: .*", text))


def test_tables_of_their_own_folder_and_no_local_folder_on_a_cluster(spark):
    from proofmill import session

    first, second = session.shared_path(spark, "a"), session.shared_path(spark, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    assert spark.sparkContext.applicationId in first and first.startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Cluster)
