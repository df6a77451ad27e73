"""What the plans must look like: pruned scans, pushed filters, no Python where built-ins do, no unbounded cross joins."""

import re

import pytest

from tessella.plans import registry

QUERIES = registry.queries()


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["flagship_latency_quantiles", "chunk_slice", "j_range_chunks", "top_hrw_owner", "win_counter_delta", "pq05", "agg_pivot_metrics", "win_seq_detect", "state_swim_merge", "src_prom_text", "f_urlenc", "f_shared_key", "src_request_codec", "src_response_codec", "pq12", "top_yes_maybe", "state_hydrate_ring", "win_lru_order"])
def test_stays_in_the_engine(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search("ArrowEval|BatchEval|InPandas|InArrow|CartesianProduct", text)


def test_scans_are_pruned(spark, sf_dir):
    schemas = re.findall(r"ReadSchema: (.*)", plan(QUERIES["chunk_slice"](spark, sf_dir)))
    assert schemas and all("l_comment" not in s and "l_extendedprice" not in s and "l_shipdate" not in s for s in schemas)


def test_filters_reach_the_scan(spark, sf_dir):
    """Of registered queries: accesses have a key, snapshots are of some orders."""
    assert re.search(r"PushedFilters: \[.*IsNotNull\(props\)", plan(QUERIES["win_lru_order"](spark, sf_dir)))


@pytest.mark.parametrize("name", ["top_hrw_owner", "win_hrw_rank", "f_hrw_score"])
def test_owners_need_no_shuffle(name, spark, sf_dir):
    # The one exchange gathers the nodes into arrays, by their block, before the broadcast.
    text = plan(QUERIES[name](spark, sf_dir))
    assert text.count("hashpartitioning") <= 1 and not re.search(r"hashpartitioning\([^)]*(mount|blob|offset)", text)


@pytest.mark.parametrize("name", ["top_yes_maybe", "f_bloom_contains", "j_chunk_holder", "agg_fp_rate", "state_bloom_stale_drop"])
def test_filters_are_looked_up_by_bit(name, spark, sf_dir):
    """Four lookups a chunk, by equality with the broadcast slices: no filter is tested against every chunk, and chunks aren't shuffled for it."""
    text = plan(QUERIES[name](spark, sf_dir)).split("(1) Scan")[0]
    assert len(re.findall("BroadcastHashJoin", text)) >= 4 and "SortMergeJoin" not in text.split("BroadcastHashJoin")[-1]
    # Candidates have the alive nodes' names beside every chunk, in one row.
    assert len(re.findall("BroadcastNestedLoopJoin", text)) == (name == "top_yes_maybe")


def test_range_reads_join_by_equality(spark, sf_dir):
    assert "BroadcastNestedLoopJoin" not in plan(QUERIES["chunk_slice"](spark, sf_dir))
