"""Operators against hand-made cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import advisor, catalog, config, cycles, graph, normalize, sqlscan, stats, usage
from quarrylens.plans import registry
from quarrylens.sources import files, java, sinks

NODES = "signature string, node_type string, name string, fqn string"
EDGES = "source_id string, type string, target_id string"


def test_test_only_callees(spark):
    test = "annotation:org.junit.jupiter.api.Test"
    nodes = [(m, "Method", m, "T") for m in ("t", "x", "m1", "m2", "m3", "m4", "m5")] + [("l", "Lambda", "l", "T"), ("s", None, None, None), (test, "Annotation", "Test", test[11:]), ("annotation:unresolved:t:Test", "Annotation", "Test", "unresolved:t:Test")]
    edges = [("t", "CALLS", "m1"), ("t", "ENCLOSES", "l"), ("l", "CALLS", "m2"), ("t", "CALLS", "m3"), ("x", "CALLS", "m3"), ("t", "CALLS", "m4"), ("m4", "ANNOTATED_BY", test), ("t", "CALLS", "s"), ("t", "ANNOTATED_BY", test), ("x", "ANNOTATED_BY", "annotation:unresolved:t:Test")]
    got = graph.test_only_callees(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect()
    assert sorted((r["signature"], r["testCallerCount"]) for r in got) == [("m1", 1), ("m2", 1)]


def test_neighbours_and_upserts(spark):
    edges = spark.createDataFrame([("A", "CALLS", "B"), ("C", "USES", "B")], EDGES)
    asked = spark.createDataFrame([("A",), ("B",)], "signature string")
    assert [tuple(r) for r in graph.callers(edges, asked).collect()] == [("B", "A")]
    assert [tuple(r) for r in graph.callees(edges, asked).collect()] == [("A", "B")]
    assert [tuple(r) for r in graph.usages(edges, asked).collect()] == [("B", "C")]
    w = spark.createDataFrame([("A", "CALLS", "B", {"x": "1", "y": "1"}, 1), ("A", "CALLS", "B", {"x": "2"}, 2), ("A", "CALLS", "B", None, 3), ("A", "USES", "B", None, 4)], EDGES + ", attributes map<string,string>, seq long")
    got = {r["type"]: r["attributes"] for r in graph.upsert_edges(w).collect()}
    assert got == {"CALLS": {"x": "2", "y": "1"}, "USES": {}}
    n = spark.createDataFrame([("A", "Class", "a", "f", 1), ("A", "Class", "b", None, 2)], NODES + ", seq long")
    assert [tuple(r) for r in graph.upsert_nodes(n).collect()] == [("A", "Class", "b", None)]


def brute_cycles(edges):
    out = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1] and b == path[0]:
                out.add((*path, b))
            elif a == path[-1] and b > path[0] and b not in path:
                walk([*path, b])

    for a in {a for a, _ in edges}:
        walk([a])
    return out


def brute_greedy(cycles_, weight):
    left, out = set(cycles_), []
    while left:
        count = {}
        for c in left:
            for e in zip(c, c[1:]):
                count[e] = count.get(e, 0) + 1
        best = min(count, key=lambda e: (-count[e] / weight[e], e))
        out.append(best)
        left = {c for c in left if best not in zip(c, c[1:])}
    return out


@pytest.mark.parametrize("whole", [0, 100])
def test_cycles_and_cuts_by_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(cycles, "WHOLE_EDGES", whole)  # none, or all, walked over the cluster
    rng = random.Random(4)
    edges = {(g * 10 + rng.randrange(5), g * 10 + rng.randrange(5)) for g in range(4) for _ in range(9)} | {(1, 11), (22, 13)}
    beans = spark.createDataFrame([(a, b, rng.choice(list(cycles.INJECTION_WEIGHT)), rng.randrange(5)) for a, b in sorted(edges)], "src long, dst long, injection_type string, method_count int")
    found = cycles.elementary_cycles(beans)
    want = brute_cycles(edges)
    assert sorted(tuple(r["cycle"]) for r in found.collect()) == sorted(want)
    weights = cycles.edge_weights(beans)
    chosen = cycles.greedy_cut(found, weights).orderBy("step").collect()
    assert [(r["src"], r["dst"]) for r in chosen] == brute_greedy(want, {(r["src"], r["dst"]): r["weight"] for r in weights.collect()})
    assert [r["step"] for r in chosen] == list(range(1, len(chosen) + 1))


def test_strong_components_by_both_ways(spark):
    rng = random.Random(6)
    edges = spark.createDataFrame([(rng.randrange(14), rng.randrange(14)) for _ in range(22)], "src long, dst long")
    pairs = lambda df: sorted(map(tuple, df.select("node", "component").collect()))
    assert pairs(cycles.strong_components(edges)) == pairs(cycles._coloured(edges.distinct()))


def test_a_long_ring(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 300) for i in range(300)], "src long, dst long")
    assert [len(r["cycle"]) for r in cycles.elementary_cycles(ring).collect()] == [301]


def test_cut_breaks_every_cycle(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(9), rng.randrange(9), rng.choice(list(cycles.INJECTION_WEIGHT)), rng.randrange(5)) for _ in range(18)]
    beans = spark.createDataFrame(rows, "src int, dst int, injection_type string, method_count int").dropDuplicates(["src", "dst"])
    found = cycles.elementary_cycles(beans)
    cut = cycles.greedy_cut(found, cycles.edge_weights(beans))
    assert 0 < cut.count() <= found.count()
    assert cycles.cyclic_components(cycles.without(beans, cut)).count() == 0


CHANGES = "seq long, kind string, table_name string, object_name string, column_csv string, is_unique boolean"


def replayed(spark, rows):
    return sorted((r["table_name"], r["index_type"], r["index_name"], r["column_csv"]) for r in catalog.replay(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CHANGES)).collect())


def test_catalog_replay(spark):
    rows = [
        ("createTable", "users", "pk", "id", False), ("createTableUnique", "users", "uk", "email", True), ("createIndex", "Users", None, "name", False), ("createIndex", "users", "i2", "a,b", True),
        ("dropIndex", None, "i2", None, None), ("createIndex", "users", "i2", "a,b", False), ("createIndex", "users", "i3", " ", False), ("dropUniqueConstraint", "users", None, None, None), ("dropPrimaryKey", "users", None, None, None), ("dropIndex", "orders", "i2", None, None),
    ]
    assert replayed(spark, rows) == [("users", "INDEX", "<unnamed>", "name"), ("users", "INDEX", "i2", "a,b"), ("users", "UNIQUE_CONSTRAINT", "uk", "email")]


def test_catalog_replay_takes_the_last_drop(spark):
    rows = [("createIndex", "t", "i", "a", False), ("dropIndex", "T", "i", None, None), ("createIndex", "t", "i", "a", False), ("dropIndex", "t", "other", None, None)]
    rows += [("addPrimaryKey", "t", "pk", "id", False), ("dropPrimaryKey", "t", "pk2", None, None), ("addPrimaryKey", "u", "pk", "id", False), ("dropPrimaryKey", "u", None, None, None), ("dropPrimaryKey", None, None, None, None)]
    assert replayed(spark, rows) == [("t", "INDEX", "i", "a"), ("t", "PRIMARY_KEY", "pk", "id")]
    assert [r["seq"] for r in catalog.replay(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CHANGES)).orderBy("seq").collect()] == [2, 4]


# the catalog's queries meet an entry with drops by keys alone: no join compares each with each of its name
@pytest.mark.parametrize("name", ["c1_catalog_replay", "c11_catalog_report", "d1_cardinality", "d4_unique_columns", "d6_prefix_coverage", "d5_leading_index"])
def test_replay_joins_by_keys_alone(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if " Join " in f" {line}"]
    assert len(joins) >= 2
    assert not [line for line in joins if " > " in line or " < " in line]


# what kind an entry is, is asked after its columns are grouped: on the changes, each row would work its kind out again and again
@pytest.mark.parametrize("name", ["d4_unique_columns", "d1_cardinality"])
def test_kinds_of_entries_are_not_asked_of_changes(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if " Filter " in f" {line}"]
    assert [line for line in filters if "createIndex" in line]
    assert not [line for line in filters if "createIndex" in line and "UNIQUE_INDEX" in line]


def test_raw_sql_changes(spark):
    sql = "CREATE INDEX idx_orders_customer ON orders (customer_id); CREATE UNIQUE INDEX idx_orders_date ON orders (order_date, customer_id);"
    got = catalog.raw_sql_changes(spark.createDataFrame([(1, sql), (2, "drop index concurrently if exists idx_x;"), (3, "not sql (")], "seq long, sql string")).collect()
    assert [(r["kind"], r["table_name"], r["object_name"], r["column_csv"], r["is_unique"]) for r in got] == [("createIndex", "orders", "idx_orders_customer", "customer_id", False), ("createIndex", "orders", "idx_orders_date", "order_date,customer_id", True), ("dropIndex", None, "idx_x", None, False)]


def test_cardinality(spark):
    ix = spark.createDataFrame([("users", "PRIMARY_KEY", "pk", "user_id"), ("users", "UNIQUE_CONSTRAINT", "uk", "email"), ("users", "INDEX", "i", "name"), ("users", "UNIQUE_INDEX", "u", "username"), ("orders", "INDEX", "io", "customer_id,order_date")], "table_name string, index_type string, index_name string, column_csv string")
    asked = [("users", "user_id", None, "HIGH"), ("users", "email", None, "HIGH"), ("users", "username", None, "HIGH"), ("users", "name", None, "MEDIUM"), ("users", "is_active", None, "LOW"), ("orders", "customer_id", None, "MEDIUM"), ("USERS", "USER_ID", None, "HIGH"), (None, "x", None, "MEDIUM"), ("nowhere", "x", None, "MEDIUM"), ("t", "kind", "enum", "LOW"), ("t", "is_x", "other", "MEDIUM"), ("t", "forced", None, "HIGH"), ("t", "isx", None, "MEDIUM")]
    out = catalog.CARDINALITY(columns=spark.createDataFrame([a[:3] for a in asked], "table_name string, column_name string, data_type string"), members=catalog.members(ix), high=spark.createDataFrame([("forced",)], "name string"), low=spark.createDataFrame([("forced",)], "name string"))
    assert {(r["table_name"], r["column_name"]): r["cardinality"] for r in out.collect()} == {a[:2]: a[3] for a in asked}


def test_external_keys_of_one_name_are_dealt_over_tasks(spark):
    tables = spark.createDataFrame([("s", "b0")] * 2345 + [("s", "b1"), ("s", None), ("s", "b2")], "source_table string, table_name string")
    related = [("e", f"f{i}", "b0") for i in range(40)] + [("e", "g", "b1"), ("e", "g", "b1"), ("b2", "self", "b2"), (None, "x", "b2"), ("e", "y", None), ("e", "z", "b9")]
    got = normalize.EXTERNAL_KEYS(new_tables=tables, relationships=spark.createDataFrame(related, "entity string, field string, target string").coalesce(1))
    assert {(r["table_name"], r["entity"], r["field"]): r["count"] for r in got.groupBy("table_name", "entity", "field").count().collect()} == {("b0", "e", f"f{i}"): 2345 for i in range(40)} | {("b1", "e", "g"): 2}
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 40 * 2345 / 2


def test_external_keys_of_many_rows_are_no_exploded_copies(spark):
    sizes = {"b1": 1, "b2": 999, "b3": 1000, "b4": 1001, "b5": 99_999, "b6": 100_000, "b7": 101_000, "b8": 200_001}
    tables = spark.createDataFrame(list(sizes.items()), "table_name string, n long").selectExpr("'s' AS source_table", "table_name", "explode(sequence(1, n)) AS i").drop("i")
    related = [("e", "f", t) for t in sizes] + [("e", "g", "b4"), ("e", "g", "b4"), ("b8", "self", "b8")]
    got = normalize.EXTERNAL_KEYS(new_tables=tables, relationships=spark.createDataFrame(related, "entity string, field string, target string"))
    assert {tuple(r)[:3]: r["count"] for r in got.groupBy("table_name", "entity", "field").count().collect()} == {(t, "e", "f"): n for t, n in sizes.items()} | {("b4", "e", "g"): 2002}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    ("composites", "singles", "removed"),
    [
        (["ships|flag,hull", "ships|flag,hull,berth"], [], ["ships|flag,hull"]),
        (["ships|flag,hull", "berths|flag,hull,pier"], [], []),
        (["ships|hull,flag", "ships|flag,hull,berth"], [], []),
        (["ships|Flag,HULL", "ships|flag,hull,berth"], [], ["ships|flag,hull"]),
        (["tides|a,b", "tides|a,b,c", "tides|a,b,c,d", "tides|a,c"], [], ["tides|a,b", "tides|a,b,c"]),
        (["ships|flag,hull"], ["ships|flag", "ships|berth"], ["ships|flag"]),
        (["ships|flag,hull"], ["ships|hull"], []),
        (["ships|flag,hull", "ships|berth,pier"], ["ships|flag", "ships|hull", "ships|berth"], ["ships|flag", "ships|berth"]),
        (["berths|flag,pier"], ["ships|flag"], []),
        (["users|a_b", "users|axb,c"], [], []),
    ],
)
def test_redundant_indexes(spark, composites, singles, removed):
    table = lambda xs: spark.createDataFrame([x.split("|") for x in xs], "table_name string, column_csv string")
    kept = advisor.PRUNED_COMPOSITES(composites=table(composites)).union(advisor.PRUNED_SINGLES(singles=table(singles), composites=table(composites))).collect()
    assert {f"{r[0]}|{r[1]}" for r in kept} == {x.lower() for x in composites + singles} - set(removed)


def java_hash(s):
    h = 0
    for c in s:
        h = (31 * h + ord(c)) % (1 << 32)
    return h - (1 << 32) if h >= 1 << 31 else h


def test_index_names(spark):
    rows = [("users", "id,Last Name"), ("a_very_long_table_name_for_an_index", "first_column,second_column,third_column")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, c string").select(advisor.index_name(F.col("t"), F.col("c"))).collect()]
    full = "idx_a_very_long_table_name_for_an_index_first_column_second_column_third_column"
    assert got == ["idx_users_id_last_name", f"{full[:52]}_{abs(java_hash(full)) % 10_000_000:07d}"]


SQL = [
    ("SELECT hull, flag FROM ships WHERE tonnage > 900 AND harbour = ?", [("ships", "tonnage", ">"), ("ships", "harbour", "=")], 0),
    ("SELECT hull FROM ships WHERE captain_no IN (SELECT no FROM captains WHERE retired = 0) AND flag <> 'PA'", [("ships", "captain_no", "IN"), ("ships", "flag", "<>")], 0),
    ("SELECT s.hull FROM ships s LEFT JOIN berths b ON s.berth_no = b.no WHERE b.depth >= ? OR s.flag LIKE 'N%'", [("berths", "depth", ">="), ("ships", "flag", "LIKE")], 1),
    ("UPDATE berths SET depth = depth + 1 WHERE pier = ? AND tide < 3", [("berths", "pier", "="), ("berths", "tide", "<")], 0),
    ("DELETE FROM voyages WHERE sailed_on < ? AND crew = 0", [("voyages", "sailed_on", "<"), ("voyages", "crew", "=")], 0),
    ("SELECT * FROM tides WHERE height BETWEEN 2 AND ? AND moon NOT BETWEEN 1 AND 4", [("tides", "height", "BETWEEN"), ("tides", "moon", "BETWEEN")], 0),
    ("SELECT * FROM crates WHERE sealed_at IS NULL AND owner_no IS NOT NULL", [("crates", "sealed_at", "IS NULL"), ("crates", "owner_no", "IS NOT NULL")], 0),
    ("SELECT count(*) FROM lighthouses", [], 0),
    ("SELECT no FROM buoys WHERE colour = 'red' UNION ALL SELECT no FROM beacons WHERE colour = 'green'", [("buoys", "colour", "="), ("beacons", "colour", "=")], 0),
    ("(((SELECT no FROM buoys WHERE lit = 1)))", [("buoys", "lit", "=")], 0),
    ("SELECT 1 FROM voyages v JOIN ships s ON v.ship_no = s.no JOIN captains c ON s.captain_no = c.no WHERE v.port = ?", [("voyages", "port", "=")], 2),
    ("UPDATE ships s JOIN berths b ON s.berth_no = b.no SET s.docked = 1 WHERE b.free = 0", [("berths", "free", "=")], 1),
    ("DELETE v FROM voyages v JOIN ships s ON v.ship_no = s.no WHERE s.scrapped = 1", [("ships", "scrapped", "=")], 1),
    ("SELECT * FROM crates WHERE kind NOT IN ('a', 'b') AND label NOT LIKE '%x' AND 40 < weight", [("crates", "kind", "IN"), ("crates", "label", "NOT LIKE"), ("crates", "weight", "<")], 0),
    ("SELECT FROM WHERE ((", [], 0),
]


def test_sql_conditions(spark):
    got = sqlscan.conditions(spark.createDataFrame([(i, s[0]) for i, s in enumerate(SQL)], "query_id long, sql string")).collect()
    for i, (_, where, joins) in enumerate(SQL):
        mine = sorted((r for r in got if r["query_id"] == i and r["kind"] == "WHERE"), key=lambda r: r["position"])
        assert sorted((r["table_name"], r["column_name"], r["operator"]) for r in mine) == sorted(where)
        assert sum(r["query_id"] == i and r["kind"] == "JOIN" for r in got) == joins
    assert sqlscan.scan(SQL[8][0]).where_text == "colour = 'red'"


def test_decomposition(spark):
    assert normalize.ordered(["address", "patient"], [("address", "patient")]) == ["patient", "address"]
    assert normalize.ordered(["A", "B", "C"], [("C", "A"), ("C", "B"), ("A", "unknown"), ("B", "B")]) == ["A", "B", "C"]
    with pytest.raises(ValueError, match="cycle"):
        normalize.ordered(["A", "B"], [("A", "B"), ("B", "A")])
    mappings = [("id", "patient", "id"), ("name", "patient", "name"), ("patient_id", "address", "patient_id"), ("street", "address", "street")]
    keys = [("address", "patient_id", "patient", "id")]
    old = spark.createDataFrame([(1, "Ann", 1, "A St"), (2, "Bo", 2, "B St"), (2, "Bo", 2, "C St")], "id int, name string, patient_id int, street string")
    order = normalize.ordered(["address", "patient"], [("address", "patient")])
    assert normalize.insert_select("old_patient", mappings, order) == ["INSERT INTO patient (id, name) SELECT id, name FROM old_patient;", "INSERT INTO address (patient_id, street) SELECT patient_id, street FROM old_patient;"]
    parts = normalize.split(old, mappings, order)
    assert list(parts) == order and parts["patient"].count() == 3
    for base in order:  # either end of the key may be the base
        again = normalize.rebuilt(parts | {"patient": parts["patient"].distinct()}, base, mappings, keys)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, old.collect()))
    assert "PRIMARY KEY (id)" in normalize.create_table("t", [("id", "Long", True, False), ("x", "Strange", False, True)])
    assert normalize.create_table_changeset("t", [("id", "Long", True, False)], frozenset({"id"})).count('autoIncrement="true"') == 1
    assert normalize.empty_table(spark, [("a", "LocalDateTime"), ("b", "BigDecimal")]).dtypes == [("a", "timestamp_ntz"), ("b", "decimal(19,2)")]
    assert len(normalize.triggers("v", "ORACLE")) == 3


def test_versions_and_decisions(spark):
    pairs = [("2.0.0.RELEASE", "2.0.0", 0), ("2.0.0-RC1", "2.0.0", 1), ("1.4", "1.4.1", -1), (None, "1", -1), ("1", None, 1), ("1.10", "1.9", 1)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(config.compare_versions(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [p[2] for p in pairs]
    rows = [(["WEB", "JSON"], False, True, "X", True), ([], False, True, "X", True), (["NONE"], False, True, "UnitTest", True), (["WEB"], True, True, "X", True), (["WEB", "GRAPHQL"], False, True, "X", True), (["WEB"], False, False, "X", True), (["WEB"], False, True, "X", False)]
    df = spark.createDataFrame(rows, "r array<string>, s boolean, k boolean, c string, ok boolean")
    t, a = config.test_decision(F.col("r"), F.col("s"), F.col("k"), F.col("c"), F.col("ok"))
    assert [tuple(r) for r in df.select(t, a).collect()] == [("WebMvcTest", "CONVERTED"), ("UnitTest", "CONVERTED"), ("UnitTest", "KEPT"), ("SpringBootTest(RANDOM_PORT)", "CONVERTED"), ("SpringBootTest", "REVERTED"), (None, "SKIPPED"), ("SpringBootTest", "REVERTED")]


@pytest.mark.parametrize(("model", "given", "out", "cached", "cost"), [("gemini-1.5-flash", 100_000, 100_000, 50_000, 0.0346875), ("gemini-2.5-pro", 100_000, 100_000, 0, 1.125), ("gemini-2.5-pro", 300_000, 100_000, 0, 2.25), ("gemini-1.5-flash", 1_000_000, 1_000_000, 0, 0.75)])
def test_costs(spark, model, given, out, cached, cost):
    used = spark.createDataFrame([(1, model, given, out, cached)], "id int, model string, input_tokens long, output_tokens long, cached_tokens long")
    r = stats.COSTS(used=used, prices=stats.price_table(spark)).first()
    assert r["input_cost"] + r["output_cost"] == pytest.approx(cost)
    assert stats.priced_model("gpt-4o-mini-2024") == "gpt-4o-mini" and stats.priced_model("other") == "gemini-1.5-flash"


def test_json_in_text():
    assert stats.embedded_json('a\n```json\n[1]\n```\nb\n```\n{"x": 2}\n```') == '{"x": 2}'
    assert stats.embedded_json('see [x]\n{"a": 1}') == '{"a": 1}'
    assert stats.embedded_json('say [1]') == "[1]" and stats.embedded_json("none") is None


def test_java_graph(spark):
    source = "package com.example;\nclass Repo { void save() {} }\nclass Service {\n void resolved(Repo repo) { repo.save(); }\n void unresolved() { mystery.save(); }\n}\n"
    rows = java.graph_rows(spark.createDataFrame([("f", source), ("g", None), ("h", "class {{{")], "file string, source string"))
    calls = {(r["source_id"], r["target_id"]): r["attributes"] for r in java.edges_of(rows).filter("type = 'CALLS'").collect()}
    assert calls == {("com.example.Service#resolved(Repo)", "com.example.Repo#save()"): {}, ("com.example.Service#unresolved()", "mystery#save()"): {"resolution": "partial"}}
    kinds = {t for s in [java.scan("class A { int x, y; A() {} { a(); } @B void m(@C int p) { Runnable r = () -> go(); r.run(); Z::q; } enum E { P } }").rows] for t in [r[2] for r in s]}
    assert {"Class", "Field", "Constructor", "StaticBlock", "Method", "Parameter", "Lambda", "Enum", "EnumConstant", "Annotation", "ENCLOSES", "CONTAINS", "CALLS", "REFERENCES", "ANNOTATED_BY"} <= kinds


CHANGELOG = """<databaseChangeLog xmlns="http://www.liquibase.org/xml/ns/dbchangelog"><changeSet id="1" author="a"><createTable tableName="users">
<column name="id" type="bigint"><constraints primaryKey="true"/></column><column name="email" type="text"><constraints unique="true"/></column></createTable></changeSet>
{more}<changeSet id="2" author="a"><sql>CREATE INDEX i ON users (x);</sql><addForeignKeyConstraint constraintName="fk" baseTableName="o" baseColumnNames="uid" referencedTableName="users" referencedColumnNames="id"/></changeSet></databaseChangeLog>"""


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "inc.xml").write_text(CHANGELOG.replace("{more}", "").replace("users", "posts"))
    (tmp_path / "root.xml").write_text(CHANGELOG.replace("{more}", '<include file="inc.xml" relativeToChangelogFile="true"/>'))
    changes = files.read_changelog(spark, str(tmp_path / "root.xml")).collect()
    assert [(r["kind"], r["table_name"]) for r in changes] == [("createTableUnique", "users"), ("createTable", "users"), ("createTableUnique", "posts"), ("createTable", "posts"), ("sql", None), ("addForeignKey", "o"), ("sql", None), ("addForeignKey", "o")]
    (tmp_path / "a.properties").write_text("# no\nk=v\\\n  w\nx: y\n\n! no\nempty=\n")
    assert [(r["key"], r["value"]) for r in files.read_properties(spark, str(tmp_path / "a.properties")).collect()] == [("k", "vw"), ("x", "y"), ("empty", "")]
    (tmp_path / "a.yml").write_text("a:\n  b: 1 # no\n  c:\n    - x\n    - y: 'z'\nd: \"e\"\n")
    assert [(r["key"], r["value"]) for r in files.read_yaml(spark, str(tmp_path / "a.yml")).collect()] == [("a.b", "1"), ("a.c[0]", "x"), ("a.c[1].y", "z"), ("d", "e")]
    (tmp_path / "app").mkdir()
    (tmp_path / "pom.xml").write_text("<project><groupId>g</groupId><artifactId>p</artifactId><version>1</version><properties><v>1</v><w>1</w></properties></project>")
    (tmp_path / "app/pom.xml").write_text("<project><parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version></parent><artifactId>c</artifactId><properties><v>2</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>d</artifactId></dependency></dependencies></project>")
    layers = files.pom_layers(spark, str(tmp_path / "app/pom.xml"))
    assert {(r["key"], r["value"]) for r in config.MERGED(layers=layers.filter("kind = 'properties'")).collect()} == {("v", "2"), ("w", "1")}
    assert files.read_checkpoint(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cp.json").write_text('{"sessionId": "s", "processed": ["a"], "unknown": 1}')
    assert files.read_checkpoint(spark, str(tmp_path / "cp.json")).first()["processed"] == ["a"]
    sinks.write_queries_csv(spark.createDataFrame([("r", 'select\r\n"x", y')], "repo string, query string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').first()["query"] == 'select\t"x", y'
    master = sinks.with_include('<databaseChangeLog><include file="db/a.xml"/>\n</databaseChangeLog>', "b.xml")
    assert 'file="db/b.xml"' in master and sinks.with_include(master, "b.xml") == master
    assert sinks.validated_changelog(None)[0] == ["file not found"] and sinks.validated_changelog("<a>")[0] and not sinks.validated_changelog(CHANGELOG.replace("{more}", ""))[0]
    assert json.loads(sinks.validation_json([], ["w"]))["valid"] is True
    assert files.store_options({"type": "AGE", "clear_on_start": "true"}) == {"type": "age", "batch_size": 1000, "mode": "overwrite"}


def test_edge_stream(spark, tmp_path):
    from quarrylens.streaming import edges

    source = tmp_path / "in"
    source.mkdir()
    for n in (1, 2):
        (source / f"{n}.json").write_text(json.dumps({"source_id": "A", "target_id": "B", "type": "CALLS", "attributes": {"k": str(n), f"own{n}": "x"}, "seq": n}) + "\n")
        edges.append_batches(edges.edge_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = edges.graph_table(spark, str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["attributes"] == {"k": "2", "own1": "x", "own2": "x"}


def test_other_changes():
    rename = sinks.changeset("rename_table", old="a", new="b")
    view = sinks.changeset("create_view", ("POSTGRESQL",), name="a", query="SELECT 1")
    assert sinks.composite([rename, view]) == ("ALTER TABLE a RENAME TO b;\n-- dialects: POSTGRESQL\nCREATE VIEW a AS SELECT 1;", "DROP VIEW a;\nALTER TABLE b RENAME TO a;")
    assert sinks.changeset("drop_foreign_key", table="o", name="fk", column="u", ref_table="users", ref_column="id")[1].startswith("ALTER TABLE o ADD CONSTRAINT fk")
    with pytest.raises(ValueError, match="no such change"):
        sinks.changeset("other")


def test_usage_helpers(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "a"]), (["a"], ["x"]), ([], [])], "old array<string>, new array<string>")
    got = [r[0] for r in df.select(usage.position_mapping("old", "new")).collect()]
    assert got == [{0: 1, 1: 0}, {}, {}]


def test_call_index_under_stubs_and_references(spark):
    calls = spark.createDataFrame([("T", "m1", "repo"), ("T", "m2", "this.repo"), ("T", "m3", "verify(repo)"), ("T", "m4", "doReturn(1).when(this.repo)"), ("T", "m5", "verify(repo, times(2))"), ("T", "m6", "other.repo"), ("T", "m7", "check(repo)")], "caller string, callee string, scope string")
    deps = spark.createDataFrame([("R", "T", "repo")], "target string, cls string, field string")
    assert sorted(r["method"] for r in usage.CALL_INDEX(calls=calls, deps=deps).collect()) == ["m1", "m2", "m3", "m4", "m5"]


def test_deep_parents_and_placeholders(spark):
    layers = spark.createDataFrame([("f", level, "k", f"v{level}-{seq}", seq) for level in range(6) for seq in range(2)], "file string, level int, key string, value string, seq int")
    assert config.MERGED(layers=layers).first()["value"] == "v5-1" and config.NEAREST(layers=layers).first()["version"] == "v5-0"
    assert config.OVERLAID(layers=layers).first()["value"] == "v5-1"
    names = [f"a{i}" for i in range(15)]
    properties = spark.createDataFrame([(1, n, f"${{{m}}}") for n, m in zip(names, names[1:])] + [(1, names[-1], "9"), (1, "x", "${x}"), (2, "y", None)], "project int, key string, value string")
    versions = spark.createDataFrame([(1, "1.${a0}.${none}-${x}"), (2, "${y}!"), (3, "${z}"), (4, None)], "project int, version string")
    assert {r["project"]: r["version"] for r in config.resolved_placeholders(versions, properties).collect()} == {1: "1.9.${none}-${x}", 2: "!", 3: "${z}", 4: None}


def test_spock_is_raised_and_warned_about(spark):
    rows = [("p", "spock", "spock-core", "1.3-groovy-2.5"), ("p", "spock", "spock-spring", "${v}"), ("p", "spock", "spock-core", "2.0-groovy-3.0"), ("p", "groovy", "groovy-all", "${v}"), ("p", "groovy", "groovy", "2.4"), ("p", "property", None, "${x}"), ("p", "spock", "a", None)]
    got = config.GROOVY(versions=spark.createDataFrame(rows, "project string, kind string, artifact string, version string")).collect()
    assert [(r["raised_to"], r["warns"]) for r in got] == [("2.0-groovy-3.0", True), ("2.0-groovy-3.0", False), (None, False), (None, False), ("3.0.8", False), ("3.0.8", False), (None, False)]


def test_responses_without_a_known_field(spark):
    texts = ['{"issues": ["x"], "a": 1}', '{"data": ["d"]}', '["l"]', "{}", "broken"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(stats.unwrapped("t")).collect()]
    assert got == ['["x"]', '["d"]', '["l"]', "{}", None]


def test_deep_nesting_fails_no_task(spark):
    sql = "SELECT * FROM a WHERE " + "(" * 5000 + "x = 1" + ")" * 5000
    code = "class A {" * 4000 + "}" * 4000
    assert sqlscan.conditions(spark.createDataFrame([(1, sql), (2, "SELECT * FROM b WHERE y = 2")], "query_id long, sql string")).filter("query_id = 2").count() == 1
    assert java.graph_rows(spark.createDataFrame([("f", code)], "file string, source string")).count() > 0


def test_yaml_scalars():
    text = """
a: "x # y"   # note
b: {c: 1, d: [x, 'y, z'], e: {f: "g: h"}}
t: |
  one # kept

    two
u: >-
  folded
  text
list: [
  1,
  2
]
s:
- p: 1
  q: it's plain
- - nested
"quoted key": 'it''s'
url: http://x:80/#frag
plain: goes
  on here
none: ~
"""
    assert files.flat_yaml(text) == [
        ("a", "x # y"), ("b.c", "1"), ("b.d[0]", "x"), ("b.d[1]", "y, z"), ("b.e.f", "g: h"), ("t", "one # kept\n\n  two\n"), ("u", "folded text"), ("list[0]", "1"), ("list[1]", "2"),
        ("s[0].p", "1"), ("s[0].q", "it's plain"), ("s[1][0]", "nested"), ("quoted key", "it's"), ("url", "http://x:80/#frag"), ("plain", "goes on here"), ("none", ""),
    ]
    for broken in ("a: {b: 1", "a: [", 'a: "x', ": x", "- ", "a: }", "{", "a: |", "a: [}]"):
        files.flat_yaml(broken)


def test_trigger_bodies_and_plan():
    mappings = [("id", "patient", "id"), ("name", "patient", "name"), ("patient_id", "address", "patient_id"), ("street", "address", "street")]
    keys = [("address", "patient_id", "patient", "id")]
    assert normalize.trigger_statements("patient", mappings, keys, "INSERT", ":")[0] == "INSERT INTO patient (id, name) VALUES (:NEW.id, :NEW.name);"
    assert normalize.trigger_statements("patient", mappings, keys, "UPDATE") == ["UPDATE patient SET name = NEW.name WHERE id = NEW.id;", "UPDATE address SET street = NEW.street WHERE patient_id = NEW.id;"]
    assert normalize.trigger_statements("patient", mappings, keys, "DELETE") == ["DELETE FROM address WHERE patient_id = OLD.id;", "DELETE FROM patient WHERE id = OLD.id;"]
    columns = {"address": [("patient_id", "Long", True, False), ("street", "String", False, True)], "patient": [("id", "Long", True, False), ("name", "String", False, True)]}
    steps = normalize.plan_steps("old_patient", "patient", columns, mappings, keys, [("visit", "fk_visit")], "POSTGRESQL")
    assert list(dict.fromkeys(s for s, _, _ in steps)) == list(normalize.STEPS)
    assert "JOIN address ON address.patient_id = patient.id" in next(sql for s, sql, _ in steps if s == "create view")
    with pytest.raises(ValueError, match="no key leads"):
        normalize.trigger_statements("patient", mappings, [], "DELETE")


def test_changelogs_and_poms_that_include_themselves(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<databaseChangeLog><include file="a.xml" relativeToChangelogFile="true"/></databaseChangeLog>')
    with pytest.raises(ValueError, match="includes itself"):
        files.read_changelog(spark, str(tmp_path / "a.xml"))
    (tmp_path / "x").mkdir()
    for at in ("pom.xml", "x/pom.xml"):
        (tmp_path / at).write_text(f"<project><parent><groupId>g</groupId><artifactId>p</artifactId><version>1</version><relativePath>{'x/pom.xml' if at == 'pom.xml' else '../pom.xml'}</relativePath></parent><artifactId>c</artifactId></project>")
    with pytest.raises(ValueError, match="its own parent"):
        files.pom_layers(spark, str(tmp_path / "x/pom.xml"))
