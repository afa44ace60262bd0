"""Physical plans: what must and must not be in them."""

import re

import pytest

from pkgatlas.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text


@pytest.mark.parametrize(
    "name", ["reverse_dependencies", "dedupe_best_repo", "keyword_search", "vector_topk", "result_map"]
)
def test_groups_are_cut_before_the_shuffle(name, spark, sf_dir):
    assert re.search(r"WindowGroupLimit .*Partial", plan(QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["top_growth", "top_by_dependents", "metric_filter"])
def test_top_lists_need_no_full_sort(name, spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_dir))


def test_scan_reads_what_it_needs(spark, sf_dir):
    text = plan(QUERIES["monthly_downloads"](spark, sf_dir))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
    text = plan(QUERIES["version_counts"](spark, sf_dir))
    assert "EqualTo(event_type,signup)" in text


def test_short_name_list_filters_below_the_count(spark, sf_dir):
    from pkgatlas.operators import lookup
    from pkgatlas.operators.lookup import Layers
    from pkgatlas.plans.domain import Domain

    names = lookup.name_list(spark, ["pkg-1", "PKG-2"])
    d = Domain(spark, sf_dir)
    text = plan(lookup.dependents_count(Layers(deps=d.deps()), names))
    semi = text.index("LeftSemi")
    assert "partial_count" in text[:semi]  # the filter sits under the partial count
    assert "BroadcastHashJoin" in text[semi - 80 : semi]


def test_no_collect_of_data_in_library_code():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "pkgatlas"
    found = {
        str(p.relative_to(root)): len(re.findall(r"\.(?:collect|toPandas|toLocalIterator)\(\)", p.read_text()))
        for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts  # those have their own tests
    }
    # bounded request batches, gram sizes, the caller's own guarded result, a row per stage of the build
    assert {k: v for k, v in found.items() if v} == {
        "operators/search.py": 2, "operators/vector_search.py": 1, "operators/guard.py": 1,
        "plans/dataset.py": 1,
    }
