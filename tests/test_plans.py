"""What Catalyst makes of the queries: filters and columns reach the scans, nothing is paired that is not linked."""

import os

import pytest

from graphloom.plans import facts
from graphloom.queries import graphs, problems

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def of(spark, text):
    return facts(graphs.cypher(graphs.star_graph(spark, D), text))


def test_label_and_filter_reach_the_scan(spark):
    f = of(spark, "MATCH (p:Part) WHERE p.size = 7 RETURN p.brand AS b")
    assert f.read == {"p_brand", "p_size"} and any("EqualTo(p_size,7)" in p for p in f.pushed) and f.exchanges == 0
    f = of(spark, "MATCH (n) WHERE id(n) = 2000000000007 RETURN n.name AS name")
    assert f.exchanges == 0


def test_types_prune_the_other_tables(spark):
    f = of(spark, "MATCH (a)-[r:IN_REGION]->(b:Region) RETURN b.name AS b, count(*) AS n")
    assert not any(c.startswith("l_") for c in f.read) and f.products == 0


def test_an_unused_vertex_is_not_joined(spark):
    f = of(spark, "MATCH ()-[r:PLACED]->() RETURN count(*) AS n")
    assert not any(c.startswith(("p_", "s_", "r_", "l_")) for c in f.read) and f.exchanges <= 1


def test_linked_parts_become_an_equi_join(spark):
    f = of(spark, "MATCH (a:Nation), (b:Customer) WHERE a.name = b.segment RETURN a.id AS a, b.id AS b")
    assert f.products == 0


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p6_found"])
def test_problem_queries_pair_nothing(spark, name):
    assert facts(problems.QUERIES[name](spark, D)).products == 0
