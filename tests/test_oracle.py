"""Every query against its SQL twin."""

import os

import pytest

from oracle_check import compare, connect
from replyforge.plans.catalog import QUERIES
from replyforge.plans.oracle import SQL

SF_DIR = os.environ.get("REPLYFORGE_SF_DIR", "/root/testdata/sf0.001")
NO_SQL = {"train_score", "golden_evaluation", "topic_clusters", "cluster_profile"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql_or_is_a_model():
    assert set(QUERIES) - set(SQL) == NO_SQL
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, SQL[name]) == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["turns", "conversations", "pct"]
