import pytest
from pyspark.sql import functions as F

from weftgraph.catalog import Catalog, Schema
from weftgraph.errors import DuplicateNameError, InvalidProjectionError, PropertyTypeError, SchemaConflictError, UnknownElementError, UnknownNameError, UnsupportedError
from weftgraph.functions.keys import composite_key, node_key, parse_literal, table_of, valid_primary_key
from weftgraph.plans.language import parse
from weftgraph.store import GraphStore

ALDAN, BREVIK, CORRAN = 1, 2, 3
FERRY, REGATTA = 1, 2


@pytest.fixture(scope="module")
def harbours(spark):
    c = Catalog().role("source").role("target").label("Harbour").relation_type("Ferry").relation_type("Regatta")
    c = c.property_key("title", "element", "text").property_key("depth", "element", "integer").property_key("toll", "relation", "integer")
    c = c.graph_projection("ferries", "source", "target", ["Ferry"]).hypergraph_projection("regattas", ["source"], ["target"], ["Regatta"])
    c = c.index("harbour_label", "label", "Harbour").index("title_eq", "equality", "title").index("depth_range", "range", "depth").index("title_depth", "composite", ["title", "depth"]).index("ferry_members", "projection", "ferries")
    s, _ = GraphStore.empty(spark, c).add_elements(spark.createDataFrame([(i,) for i in range(3)], "n long"), ["n"])
    s, _ = s.add_relations(spark.createDataFrame([(1, 1), (2, 2)], "n long, relation_type_id long"), ["n"])
    s = s.add_incidences(spark.createDataFrame([(FERRY, ALDAN, 1), (FERRY, BREVIK, 2), (REGATTA, ALDAN, 1), (REGATTA, BREVIK, 2), (REGATTA, CORRAN, 2)], "relation_id long, element_id long, role_id long"))
    s = s.add_labels(0, spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "element_id long, label_id long"))
    s = s.set_properties("title", spark.createDataFrame([(ALDAN, "Aldan"), (BREVIK, "Brevik")], "subject_id long, value string"))
    return s.set_properties("depth", spark.createDataFrame([(ALDAN, 31)], "subject_id long, value long")).compact()


def ids(df):
    return sorted(r[-1] for r in df.collect())


def test_scans_and_probes(harbours):
    assert harbours.query("match elements").count() == 3 and harbours.query("MATCH RELATIONS").count() == 2 and harbours.query("MATCH INCIDENCES").count() == 5
    assert ids(harbours.query("MATCH ELEMENTS HAS LABEL Harbour")) == [1, 2, 3]
    assert ids(harbours.query("MATCH RELATIONS TYPE Ferry")) == [FERRY]
    assert ids(harbours.lookup("title_depth", composite=["Aldan", 31])) == [ALDAN]
    assert ids(harbours.lookup("depth_range", between=(29, 38))) == [ALDAN] and ids(harbours.lookup("depth_range", between=(38, 29))) == []
    assert ids(harbours.lookup("ferry_members")) == [ALDAN, FERRY, BREVIK] and harbours.count("harbour_label") == 3
    assert ids(harbours.element_by_key("title_eq", "Brevik")) == [BREVIK]
    assert harbours.validate().isEmpty()


@pytest.mark.parametrize(("where", "want"), [
    ("title = 'Aldan'", [ALDAN]), ("depth > 30", [ALDAN]), ("depth > 30 OR title = 'Brevik'", [ALDAN, BREVIK]), ("depth > 38 OR title = 'Brevik' AND depth = 1", []),
    ("( depth > 38 OR title = 'Brevik' ) AND title >= 'A'", [BREVIK]), ("depth <= 31 and title < \"B\"", [ALDAN]),
])
def test_where(harbours, where, want):
    assert ids(harbours.query(f"MATCH ELEMENTS WHERE {where}")) == want


@pytest.mark.parametrize(("text", "error"), [
    ("MATCH", UnsupportedError), ("MATCH ELEMENTS WHERE depth ! 1", UnsupportedError), ("MATCH ELEMENTS WHERE ( depth = 1", UnsupportedError), ("MATCH ELEMENTS WHERE depth = 1 2", UnsupportedError),
    ("MATCH ELEMENTS WHERE depth = 'x'", PropertyTypeError), ("MATCH ELEMENTS WHERE toll = 1", PropertyTypeError), ("MATCH ELEMENTS WHERE none = 1", UnknownNameError),
    ("MATCH ELEMENTS HAS LABEL harbour", UnknownNameError), ("GRAPH regattas NEIGHBORS 1", InvalidProjectionError), ("GRAPH ferries WALK FROM 1 DEPTH x", UnsupportedError),
    ("GRAPH ferries WALK FROM 1 DEPTH 1 LIMIT 2 LIMIT 3", UnsupportedError), ("GRAPH ferries WALK FROM 1 DEPTH 1 DIRECTION up", UnsupportedError),
])
def test_errors(harbours, text, error):
    with pytest.raises(error):
        harbours.query(text)


def test_walk_statements(harbours):
    assert [tuple(r) for r in harbours.query("graph ferries walk from 1 depth 3 limit 5 direction both").collect()] == [(BREVIK, 1)]
    assert ids(harbours.query("GRAPH ferries NEIGHBORS 1").select("element_id")) == [BREVIK]
    assert harbours.explain("MATCH ELEMENTS WHERE title = 'Brevik'").startswith("elements by property title = 'Brevik'")
    assert parse("CATALOG").shape == "catalog"


def test_strict_projection(harbours, spark):
    s = harbours.add_incidences(spark.createDataFrame([(FERRY, CORRAN, 2)], "relation_id long, element_id long, role_id long"))
    with pytest.raises(InvalidProjectionError):
        s.graph("ferries")


def test_versions_and_tombstones(harbours, spark):
    gone = spark.createDataFrame([(ALDAN,)], "subject_id long")
    s = harbours.without(0, gone)
    assert ids(s.elements) == [BREVIK, CORRAN] and s.incidences.count() == 3 and s.properties.count() == 1 and s.relations.count() == 2
    assert harbours.elements.count() == 3
    assert harbours.without(1, spark.createDataFrame([(REGATTA,)], "subject_id long")).incidences.count() == 2
    kept = harbours.retain("harbour_label", spark.createDataFrame([(BREVIK,)], "subject_id long"))
    assert ids(kept.elements) == [BREVIK]


def test_upserts_and_properties(harbours, spark):
    s, got = harbours.upsert_elements("title_eq", spark.createDataFrame([("Brevik",), ("Dunmor",), ("Dunmor",)], "value string"))
    assert {r["value"]: r["element_id"] for r in got.collect()} == {"Brevik": BREVIK, "Dunmor": 4}
    assert s.property(0, 4, "title") == "Dunmor" and s.property(0, CORRAN, "title") is None
    with pytest.raises(UnknownElementError):
        s.property(0, CORRAN, "title", required=True)
    with pytest.raises(PropertyTypeError):
        s.set_properties("depth", spark.createDataFrame([(BREVIK, "x")], "subject_id long, value string"))
    with pytest.raises(UnknownElementError):
        s.set_properties("depth", spark.createDataFrame([(77, 1)], "subject_id long, value long"))
    s = s.unset_properties("title", spark.createDataFrame([(BREVIK,)], "subject_id long"))
    assert s.property(0, BREVIK, "title") is None
    row = harbours.element(ALDAN).first()
    assert row["labels"] == [1] and row["properties"] == {"title": "Aldan", "depth": "31"}


def test_neighbors_and_endpoints(harbours):
    assert sorted(tuple(r) for r in harbours.endpoints().collect()) == [(FERRY, ALDAN, BREVIK), (REGATTA, ALDAN, BREVIK)]
    one = harbours.elements.where("element_id = 2")
    assert [tuple(r) for r in harbours.neighbors(one, "Regatta", "outgoing").collect()] == [(BREVIK, CORRAN)]
    assert sorted(tuple(r) for r in harbours.neighbors(one, "Regatta", "both").collect()) == [(BREVIK, ALDAN), (BREVIK, CORRAN)]


def test_save_and_open(harbours, spark, tmp_path):
    harbours.save(str(tmp_path / "v1"))
    again = GraphStore.open(spark, str(tmp_path / "v1"))
    assert again.catalog == harbours.catalog and ids(again.query("MATCH ELEMENTS")) == [1, 2, 3]
    GraphStore.create(spark, str(tmp_path / "v2"))
    with pytest.raises(Exception, match="exists"):
        GraphStore.create(spark, str(tmp_path / "v2"))


def test_schema():
    s = Schema(roles=("a", "b"), property_keys=(("k", "element", "text"),))
    c = s.apply(s.apply(Catalog()))
    assert c.roles == {"a": 1, "b": 2} and s.bind(c)["roles"] == {"a": 1, "b": 2}
    assert s.fingerprint() == Schema(roles=("b", "a"), property_keys=(("k", "element", "text"),)).fingerprint()
    with pytest.raises(SchemaConflictError):
        Schema(property_keys=(("k", "element", "integer"),)).apply(c)
    with pytest.raises(DuplicateNameError):
        c.role("a")
    with pytest.raises(UnsupportedError):
        c.index("x", "composite", [])


def test_keys(spark):
    assert [parse_literal(t) for t in ("true", "-5", "'a'", '"b"', "+7")] == [True, -5, "a", "b", 7]
    with pytest.raises(PropertyTypeError):
        parse_literal("TRUE")
    df = spark.createDataFrame([(7,)], "k long").select(node_key(3, F.col("k")).alias("n"), composite_key(F.lit("ab"), F.lit("c")).alias("c"))
    row = df.select("*", *[c.alias(n) for c, n in zip(table_of(F.col("n")), "tk", strict=True)]).first()
    assert (row["n"], row["t"], row["k"], row["c"]) == ((3 << 32) + 7, 3, 7, "2:ab1:c")
    with pytest.raises(Exception, match="primary key"):
        spark.createDataFrame([(-1,)], "k long").select(valid_primary_key(F.col("k"))).collect()
