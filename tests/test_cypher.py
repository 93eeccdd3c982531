"""The query language against hand-computed answers on a small graph."""

import pytest

from graphloom.cypher.compiler import cypher, run, to_json
from graphloom.cypher.lexer import CypherError
from graphloom.cypher.parser import parse
from graphloom.graph import Graph

# ann(1) -KNOWS-> bob(2) -KNOWS-> cid(3) -KNOWS-> ann(1); ann -LIVES_IN-> oslo(10), bob -LIVES_IN-> oslo; dan(4) alone;
# cid has no age; eve(5) -KNOWS-> eve
PEOPLE = [(1, "Person", "Ann", 30, "12"), (2, "Person", "Bob", 25, "x"), (3, "Person", "Cid", None, "9"), (4, "Person", "Dan", 41, None), (5, "Person", "Eve", 30, "10"), (10, "City", "Oslo", None, None)]
EDGES = [(100, 1, 2, "KNOWS", 2010), (101, 2, 3, "KNOWS", 2012), (102, 3, 1, "KNOWS", None), (103, 1, 10, "LIVES_IN", 2000), (104, 2, 10, "LIVES_IN", 2001), (105, 5, 5, "KNOWS", 1999)]


@pytest.fixture(scope="module")
def graph(spark):
    v = spark.createDataFrame(PEOPLE, "id bigint, label string, name string, age int, code string")
    e = spark.createDataFrame(EDGES, "eid bigint, src bigint, dst bigint, type string, since int")
    return Graph(v, e)


def rows(graph, text, **params):
    return sorted([tuple(r) for r in cypher(graph, text, params).collect()], key=repr)


CASES = {
    # predicates
    "MATCH (n) WHERE n.age >= 30 RETURN n.id": [(1,), (4,), (5,)],
    "MATCH (n) WHERE n.age <= 25 RETURN n.id": [(2,)],
    "MATCH (n) WHERE n.age <> 30 RETURN n.id": [(2,), (4,)],
    "MATCH (n:Person) WHERE NOT n.age = 30 RETURN n.id": [(2,), (4,)],
    "MATCH (n) WHERE 24 < n.age < 31 RETURN n.id": [(1,), (2,), (5,)],
    "MATCH (n) WHERE n.age = 30 XOR n.name = 'Ann' RETURN n.id": [(5,)],
    "MATCH (n) WHERE n.age = 30 OR n.name = 'Bob' AND n.id = 2 RETURN n.id": [(1,), (2,), (5,)],
    "MATCH (n) WHERE n.age IS NULL RETURN n.id": [(10,), (3,)],
    "MATCH (n) WHERE n.age IS NOT NULL AND n.code IS NULL RETURN n.id": [(4,)],
    "MATCH (n) WHERE n.missing = 1 RETURN n.id": [],
    "MATCH (n) WHERE n.name STARTS WITH 'A' OR n.name ENDS WITH 'b' OR n.name CONTAINS 'v' RETURN n.id": [(1,), (2,), (5,)],
    "MATCH (n) WHERE n.name =~ '[A-C].*' RETURN n.id": [(1,), (2,), (3,)],
    "MATCH (n) WHERE n.id IN [1, 3, 99] RETURN n.id": [(1,), (3,)],
    "MATCH (n) WHERE n.code < 11 RETURN n.id": [(3,), (5,)],
    "MATCH (n) WHERE id(n) = 1 RETURN n.name": [("Ann",)],
    "MATCH (n:Person {name: 'Bob', age: 25}) RETURN n.id": [(2,)],
    "MATCH (n) WHERE n:City RETURN n.id": [(10,)],
    "MATCH (a), (b) WHERE a = b AND a.id < 3 RETURN a.id, b.id": [(1, 1), (2, 2)],
    # patterns
    "MATCH (a)-[r:KNOWS]->(b) RETURN a.id, b.id": [(1, 2), (2, 3), (3, 1), (5, 5)],
    "MATCH (a)<-[r:KNOWS]-(b) RETURN a.id, b.id": [(1, 3), (2, 1), (3, 2), (5, 5)],
    "MATCH (a)-[r:KNOWS]-(b) RETURN a.id, b.id": [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (5, 5)],
    "MATCH (a)-->(b:City) RETURN a.id": [(1,), (2,)],
    "MATCH (a)-[r:KNOWS|LIVES_IN]->(b) RETURN count(*) AS n": [(6,)],
    "MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.id, c.id": [(1, 3), (2, 1), (3, 2)],
    "MATCH (a)-[r1]->(b)<-[r2]-(c) RETURN a.id, c.id": [(1, 2), (2, 1)],
    "MATCH (a {id: 1})-->(b), (b)-->(c) RETURN b.id, c.id": [(2, 10), (2, 3)],
    "MATCH (a)-->(b)-->(c)-->(a) RETURN a.id": [(1,), (2,), (3,)],
    "MATCH (a:Person {id: 1}) MATCH (a)-[:LIVES_IN]->(c)<-[:LIVES_IN]-(b) RETURN b.name": [("Bob",)],
    "MATCH (a:City), (b:City) RETURN a.id, b.id": [(10, 10)],
    "MATCH (a {id: 1})-[:KNOWS*1..2]->(b) RETURN b.id": [(2,), (3,)],
    "MATCH (a {id: 1})-[:KNOWS*]->(b) RETURN b.id": [(1,), (2,), (3,)],
    "MATCH (a {id: 1})-[:KNOWS*0..1]->(b) RETURN b.id": [(1,), (2,)],
    "MATCH (a {id: 1})-[:KNOWS*2]->(b) RETURN b.id": [(3,)],
    "MATCH (b)<-[:KNOWS*2]-(a {id: 1}) RETURN b.id": [(3,)],
    "MATCH p = (a {id: 1})-[:KNOWS*1..2]->(b) RETURN b.id, length(p) AS n, [x IN nodes(p) | x.id] AS ids": [(2, 1, [1, 2]), (3, 2, [1, 2, 3])],
    "MATCH p = (a {id: 1})-[r]->(b) RETURN [x IN relationships(p) | x.eid] AS e": [([100],), ([103],)],
    "MATCH (a:Person) OPTIONAL MATCH (a)-[:LIVES_IN]->(c) RETURN a.id, c.name": [(1, "Oslo"), (2, "Oslo"), (3, None), (4, None), (5, None)],
    "MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE b.age < 30 RETURN a.id, b.id": [(1, 2), (2, None), (3, None), (4, None), (5, None)],
    "MATCH (a:Person) WHERE (a)-[:LIVES_IN]->() RETURN a.id": [(1,), (2,)],
    "MATCH (a:Person) WHERE NOT (a)-->() RETURN a.id": [(4,)],
    "MATCH (a:Person) WHERE EXISTS { MATCH (a)-[:KNOWS]->(b) WHERE b.age = 25 } OR a.id = 4 RETURN a.id": [(1,), (4,)],
    "MATCH (a:Person) RETURN a.id, [(a)-[:KNOWS]->(b) | b.id] AS k": [(1, [2]), (2, [3]), (3, [1]), (4, []), (5, [5])],
    "MATCH (a:Person) WHERE size((a)-->()) = 2 RETURN a.id": [(1,), (2,)],
    # projections and aggregates
    "MATCH (n) WHERE n.id < 10 RETURN avg(n.id)": [(3.0,)],
    "MATCH (n:Person) RETURN n.age AS age, count(*) AS n": [(25, 1), (30, 2), (41, 1), (None, 1)],
    "MATCH (n:Person) RETURN count(n.age) AS a, count(DISTINCT n.age) AS b, sum(n.age) AS c, min(n.age) AS d, max(n.age) AS e": [(4, 3, 126, 25, 41)],
    "MATCH (a:Person)-[:KNOWS]->(b) RETURN b.name AS b, collect(a.id) AS l": [("Ann", [3]), ("Bob", [1]), ("Cid", [2]), ("Eve", [5])],
    "MATCH (a)-[r]->(b) RETURN a, count(r) AS n ORDER BY n DESC, a.id LIMIT 1": None,
    "MATCH (n:Person) RETURN sum(n.age) + count(*) * 2 AS x": [(136,)],
    "MATCH (n:Person) RETURN DISTINCT n.age AS a": [(25,), (30,), (41,), (None,)],
    "MATCH (n:Person) WITH n.age AS a, count(*) AS k WHERE k > 1 RETURN a, k": [(30, 2)],
    "MATCH (n:Person) WITH n ORDER BY n.age DESC LIMIT 2 RETURN n.id": [(3,), (4,)],
    "MATCH (n:Person) RETURN n.id ORDER BY n.id SKIP 1 LIMIT 2": [(2,), (3,)],
    "UNWIND [1, 2, 2, 3] AS x RETURN x, count(*) AS n": [(1, 1), (2, 2), (3, 1)],
    "UNWIND [] AS x RETURN x": [],
    "MATCH (n {id: 1}) RETURN n.id UNION MATCH (n {id: 1}) RETURN n.id": [(1,)],
    "MATCH (n {id: 1}) RETURN n.id UNION ALL MATCH (n {id: 1}) RETURN n.id": [(1,), (1,)],
    "MATCH (n:Person) RETURN percentileCont(n.age, 0.5) AS p, percentileDisc(n.age, 0.5) AS q": [(30.0, 30)],
    # expressions
    "RETURN 7 / 2 AS a, -7 / 2 AS b, 7 % 3 AS c, -7 % 3 AS d, 2 ^ 3 AS e, 7.0 / 2 AS f, 1 + 2 * 3 AS g": [(3, -3, 1, -1, 8.0, 3.5, 7)],
    "RETURN 'a' + 'b' AS a, [1] + [2] AS b, [1, 2, 3][0] AS c, [1, 2, 3][-1] AS d, [1, 2, 3][1..] AS e, [1, 2, 3][..2] AS f": [("ab", [1, 2], 1, 3, [2, 3], [1, 2])],
    "RETURN CASE 2 WHEN 1 THEN 'x' WHEN 2 THEN 'y' ELSE 'z' END AS a, CASE WHEN 1 > 2 THEN 1 END AS b": [("y", None)],
    "RETURN [x IN [1, 2, 3] WHERE x > 1 | x * 10] AS a, all(x IN [1, 2] WHERE x > 0) AS b, any(x IN [1] WHERE x > 1) AS c, none(x IN [1] WHERE x > 1) AS d, single(x IN [1, 2] WHERE x > 1) AS e": [([20, 30], True, False, True, True)],
    "RETURN reduce(s = 0, x IN [1, 2, 3] | s + x) AS a": [(6,)],
    "RETURN 0x1F AS a, 017 AS b, 1.5e2 AS c, true AS d, null AS e, 'it\\'s' AS f": [(31, 15, 150.0, True, None, "it's")],
    "RETURN toUpper('ab') AS a, substring('hello', 1, 3) AS b, size([1, 2]) AS c, size('abc') AS d, split('a,b', ',') AS e, toInteger('12x') AS f, toInteger('7') AS g, coalesce(null, 2) AS h": [("AB", "ell", 2, 3, ["a", "b"], None, 7, 2)],
    "RETURN head([1, 2]) AS a, last([1, 2]) AS b, tail([1, 2]) AS c, range(1, 3) AS d, reverse('ab') AS e, left('abc', 2) AS f, right('abc', 2) AS g": [(1, 2, [2], [1, 2, 3], "ba", "ab", "bc")],
    "MATCH (n {id: 1})-[r]->(m:City) RETURN labels(n) AS l, type(r) AS t, keys(n) AS k, startNode(r) AS s": [(["Person"], "LIVES_IN", ["name", "age", "code"], 1)],
    "RETURN {a: 1, b: 'x'}.b AS m": [("x",)],
    # procedures
    "CALL algo.triangleCount() YIELD triangles RETURN triangles": [(2,)],
    "CALL algo.outDegree() YIELD id, degree WHERE degree > 1 RETURN id, degree": [(1, 2), (2, 2)],
}


@pytest.mark.parametrize("text", CASES)
def test_case(graph, text):
    got = rows(graph, text)
    if CASES[text] is not None:
        assert got == sorted(CASES[text], key=repr)


def test_parameters_and_whole_nodes(graph):
    assert rows(graph, "MATCH (n) WHERE n.id = $i RETURN n.name", i=2) == [("Bob",)]
    assert to_json(cypher(graph, "MATCH (n {id: 10}) RETURN n")).first()[0] == '{"n":{"id":10,"label":"City","name":"Oslo","age":null,"code":null}}'
    assert cypher(graph, "MATCH (n) WHERE n.id < 3 RETURN n.name AS a, avg(n.age)").columns == ["a", "avg(n.age)"]


def test_order_keeps_nulls_last_ascending_and_first_descending(graph):
    q = "MATCH (n:Person) RETURN n.id AS i ORDER BY n.age {}, i"
    assert [r[0] for r in cypher(graph, q.format("")).collect()] == [2, 1, 5, 4, 3]
    assert [r[0] for r in cypher(graph, q.format("DESC")).collect()] == [3, 4, 1, 5, 2]


def test_undirected_graph_ignores_arrows(graph):
    g = Graph(graph.vertices, graph.edges, directed=False)
    want = [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2), (5, 5)]
    for arrow in ("-[:KNOWS]->", "<-[:KNOWS]-", "-[:KNOWS]-"):
        assert rows(g, f"MATCH (a){arrow}(b) RETURN a.id, b.id") == want


@pytest.mark.parametrize(
    "text",
    ["MATCH (n) RETURN m", "MATCH (n) RETURN", "MATCH (n)-[n]->(m) RETURN n", "MATCH (n) WITH n.id RETURN 1", "MATCH (n) WHERE count(n) > 1 RETURN n", "MATCH (n", "RETURN foo(1)", "CALL no.such() YIELD x RETURN x", "MATCH (n) RETURN n.id AS a, n.age AS a", "MATCH (a)-[*3..2]->(b) RETURN a", "MATCH (n) RETURN n.id + count(*) AS x"],
)
def test_errors_are_raised(graph, text):
    with pytest.raises(CypherError):
        cypher(graph, text).collect()


def test_updates_give_a_new_graph(graph):
    g = run(graph, "MATCH (a {id: 1}), (b {id: 4}) CREATE (a)-[:KNOWS {since: 2020}]->(b)").graph
    assert rows(g, "MATCH (a {id: 1})-[r:KNOWS]->(b) RETURN b.id, r.since") == [(2, 2010), (4, 2020)]
    assert rows(graph, "MATCH (a {id: 1})-[r:KNOWS]->(b) RETURN b.id") == [(2,)]
    r = run(g, "CREATE (n:City {name: 'Bern'})<-[:LIVES_IN]-(p:Person {name: 'Fay', age: 20}) RETURN n.name, p.age, id(n) > 10")
    assert [tuple(x) for x in r.rows.collect()] == [("Bern", 20, True)]
    assert rows(r.graph, "MATCH (:Person {name: 'Fay'})-->(c) RETURN c.name") == [("Bern",)]


def test_set_remove_delete(graph):
    r = run(graph, "MATCH (n:Person) WHERE n.age = 30 SET n.age = n.age + 1, n.nick = 'old' RETURN n.id, n.age, n.nick")
    assert sorted(map(tuple, r.rows.collect())) == [(1, 31, "old"), (5, 31, "old")]
    g = run(r.graph, "MATCH (n {id: 1}) REMOVE n.nick SET n:Boss").graph
    assert rows(g, "MATCH (n:Boss) RETURN n.id, n.nick") == [(1, None)]
    with pytest.raises(CypherError):
        run(graph, "MATCH (n {id: 1}) DELETE n")
    g = run(graph, "MATCH (n {id: 1}) DETACH DELETE n").graph
    assert (g.vertices.count(), g.edges.count()) == (5, 3)
    g = run(graph, "MATCH ()-[r:KNOWS]->() DELETE r").graph
    assert (g.vertices.count(), g.edges.count()) == (6, 2)


def test_merge(graph):
    r = run(graph, "MERGE (n:Person {name: 'Ann'}) ON MATCH SET n.age = 99 ON CREATE SET n.age = 1 RETURN n.id, n.age")
    assert [tuple(x) for x in r.rows.collect()] == [(1, 99)]
    r = run(graph, "MERGE (n:Person {name: 'Zoe'}) ON MATCH SET n.age = 99 ON CREATE SET n.age = 1 RETURN n.name, n.age")
    assert [tuple(x) for x in r.rows.collect()] == [("Zoe", 1)] and r.graph.vertices.count() == 7
    g = run(graph, "MATCH (a:Person), (c:City) MERGE (a)-[r:LIVES_IN]->(c)").graph
    assert g.edges.where("type = 'LIVES_IN'").count() == 5


def test_schemaless_properties(spark):
    v = spark.createDataFrame([(1, "A", {"x": "5"}), (2, "A", {"x": "12", "y": "b"}), (3, "B", None)], "id bigint, label string, props map<string,string>")
    e = spark.createDataFrame([(1, 1, 2, "R", {"w": "3"})], "eid bigint, src bigint, dst bigint, type string, props map<string,string>")
    g = Graph(v, e)
    assert rows(g, "MATCH (n) WHERE n.x > 6 RETURN n.id, n.y") == [(2, "b")]
    assert rows(g, "MATCH (a)-[r {w: 3}]->(b) RETURN a.id, r.w") == [(1, "3")]
    assert rows(run(g, "MATCH (n:B) SET n.z = 7").graph, "MATCH (n) WHERE n.z = 7 RETURN n.id") == [(3,)]


def test_empty_graph(spark):
    v = spark.createDataFrame([], "id bigint, label string, name string")
    e = spark.createDataFrame([], "eid bigint, src bigint, dst bigint, type string")
    g = Graph(v, e)
    assert rows(g, "MATCH (a)-->(b) RETURN a.id") == [] and rows(g, "MATCH (n) RETURN count(*) AS n") == [(0,)]


def test_precedence():
    assert parse("MATCH (a) RETURN 1 + 2 * 3 ^ 2 AS x").clauses[1] == parse("MATCH (a) RETURN (1 + (2 * (3 ^ 2))) AS x").clauses[1]
