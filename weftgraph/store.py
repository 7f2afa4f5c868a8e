"""GraphStore: immutable versions of a property graph with roled incidences.

A store is six DataFrames, a catalog and the highest ids ever given out. Writing
methods return a new store, so whoever holds an old one keeps reading it unchanged;
a method that changes nothing returns the store itself. In a folder each version
has tables of its own, and the file that names it is created last and only once, so
a version is there as a whole or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.catalog import ELEMENT, FAMILIES, INCIDENCE, RELATION, Catalog, Index, Projection, PropertyKey
from weftgraph.errors import CommitConflictError, InvalidProjectionError, PropertyTypeError, UnknownElementError, UnsupportedError
from weftgraph.functions.keys import show_value
from weftgraph.graph import Graph, HyperGraph
from weftgraph.operators import projection
from weftgraph.session import cut, numbered

SCHEMAS = {
    "elements": "element_id long",
    "relations": "relation_id long, relation_type_id long",
    "incidences": "incidence_id long, relation_id long, element_id long, role_id long",
    "element_labels": "element_id long, label_id long",
    "relation_labels": "relation_id long, label_id long",
    "properties": "subject_kind int, subject_id long, key_id long, bool_value boolean, int_value long, text_value string",
}
IDS = {"elements": "element_id", "relations": "relation_id", "incidences": "incidence_id"}


@dataclass(frozen=True)
class GraphStore:
    elements: DataFrame
    relations: DataFrame
    incidences: DataFrame
    element_labels: DataFrame
    relation_labels: DataFrame
    properties: DataFrame
    catalog: Catalog
    #: The highest id ever given out by table; a table that is not there has its highest id.
    marks: Mapping[str, int] = field(default_factory=dict)

    # -- versions -----------------------------------------------------------------
    @classmethod
    def empty(cls, spark: SparkSession, catalog: Catalog | None = None) -> GraphStore:
        return cls(*[spark.createDataFrame([], s) for s in SCHEMAS.values()], catalog or Catalog())

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> GraphStore:
        """A new, empty store in a folder that has none yet."""
        store = cls.empty(spark)
        store._publish(path, 0)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> GraphStore:
        """The last version written to a folder, or the one with a number."""
        known = versions(spark, path)
        if not known or version is not None and version not in known:
            raise UnknownElementError(f"version {version} of {path}")
        version = known[-1] if version is None else version
        raw = json.loads("".join(r[0] for r in spark.read.text(f"{path}/versions/{version:012d}").collect()))
        tables, raw = raw["tables"], raw["catalog"] | {"marks": raw["marks"]}
        catalog = Catalog(
            raw["roles"], raw["labels"], raw["relation_types"],
            {k: PropertyKey(**v) for k, v in raw["property_keys"].items()},
            {k: Projection(**{f: tuple(x) if isinstance(x, list) else x for f, x in v.items()}) for k, v in raw["projections"].items()},
            {k: Index(**{f: tuple(x) if isinstance(x, list) else x for f, x in v.items()}) for k, v in raw["indexes"].items()},
        )
        return cls(*[spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{tables}/{n}") for n in SCHEMAS], catalog, raw["marks"])

    def save(self, path: str) -> int:
        """Write a new version to a folder and return its number; older versions stay readable."""
        known = versions(self.elements.sparkSession, path)
        return self._publish(path, known[-1] + 1 if known else 0)

    def _publish(self, path: str, version: int) -> int:
        spark = self.elements.sparkSession
        tables = f"tables/{version:012d}-{uuid.uuid4().hex[:12]}"  # two writers never share a folder
        for name in SCHEMAS:
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{tables}/{name}")
        marks = {name: self._mark(name) for name in IDS}
        text = json.dumps({"tables": tables, "catalog": asdict(self.catalog), "marks": marks})
        system, target = _file(spark, f"{path}/versions/{version:012d}")
        try:
            out = system.create(target, False)
        except Exception as taken:
            raise CommitConflictError(f"version {version} of {path} exists already") from taken
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return version

    @classmethod
    def write(cls, spark: SparkSession, path: str, change: Callable[[GraphStore], GraphStore]) -> Outcome:
        """Apply a change to the last version and publish what it returns.

        An error in the change leaves the folder as it was. A change that returns the
        store it was given publishes nothing. Where another writer was first, the
        commit is refused.
        """
        known = versions(spark, path)
        store = cls.open(spark, path)
        new = change(store)
        if new is store:
            return Outcome(store, known[-1], True)
        version = new._publish(path, known[-1] + 1)
        return Outcome(cls.open(spark, path, version), version, False)

    def compact(self) -> GraphStore:
        """The same version with its lineage folded into written tables."""
        return replace(self, **{n: cut(getattr(self, n)) for n in SCHEMAS})

    def validate(self) -> DataFrame:
        """Violations (what, id): dangling references and repeated ids; none in a sound store."""
        def missing(frame: DataFrame, column: str, of: DataFrame, key: str, what: str) -> DataFrame:
            return frame.join(of.select(F.col(key).alias(column)), column, "left_anti").select(F.lit(what).alias("what"), F.col(column).alias("id"))

        found = [
            missing(self.incidences, "relation_id", self.relations, "relation_id", "incidence without relation"),
            missing(self.incidences, "element_id", self.elements, "element_id", "incidence without element"),
            missing(self.element_labels, "element_id", self.elements, "element_id", "label without element"),
            missing(self.relation_labels, "relation_id", self.relations, "relation_id", "label without relation"),
        ]
        for kind, (name, key) in enumerate(IDS.items()):
            found.append(missing(self.properties.where(F.col("subject_kind") == kind), "subject_id", getattr(self, name), key, "property without subject"))
            found.append(getattr(self, name).groupBy(key).count().where("count > 1").select(F.lit(f"repeated {key}").alias("what"), F.col(key).alias("id")))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    # -- scans and point reads -------------------------------------------------------
    def element_ids(self) -> DataFrame:
        return self.elements.select("element_id").orderBy("element_id")

    def relation_ids(self) -> DataFrame:
        return self.relations.select("relation_id").orderBy("relation_id")

    def stats(self) -> DataFrame:
        """One row of counts."""
        one = lambda name: getattr(self, name).agg(F.count("*").alias(name))
        out = one("elements")
        for n in ("relations", "incidences", "properties"):
            out = out.crossJoin(one(n))  # one row each
        summary = self.catalog.summary()
        return out.select("*", *[F.lit(v).cast("long").alias(f"catalog_{k}") for k, v in summary.items()])

    def contains(self, kind: int, subject: int) -> bool:
        name = list(IDS)[kind]
        return not getattr(self, name).where(F.col(IDS[name]) == subject).isEmpty()

    def element(self, element: int) -> DataFrame:
        """element_id, labels, properties (name to text); no row if it is not visible."""
        return self._one(ELEMENT, element)

    def relation(self, relation: int) -> DataFrame:
        return self._one(RELATION, relation)

    def incidence(self, incidence: int) -> DataFrame:
        return self._one(INCIDENCE, incidence)

    def _one(self, kind: int, subject: int) -> DataFrame:
        """One record; the filters on its id reach the scans of all tables."""
        name = list(IDS)[kind]
        own = lambda df: df.where(F.col(IDS[name]) == subject)
        store = replace(self, **{name: own(getattr(self, name))}, properties=self.properties.where(F.col("subject_id") == subject))
        labels = (self.element_labels, self.relation_labels, None)[kind]
        rows, key = getattr(store, name), IDS[name]
        if labels is not None:
            rows = rows.join(own(labels).groupBy(key).agg(F.array_sort(F.collect_set("label_id")).alias("labels")), key, "left")
        return rows.join(store.property_bags(kind).withColumnRenamed("subject_id", key), key, "left")

    def property_bags(self, kind: int) -> DataFrame:
        """subject_id, properties: a map from key name to the text of the value."""
        names = F.create_map(*[F.lit(x) for k in self.catalog.property_keys.values() for x in (k.key_id, k.name)]) if self.catalog.property_keys else F.create_map().cast("map<int,string>")
        value = show_value(F.col("bool_value"), F.col("int_value"), F.col("text_value"))
        return self.properties.where(F.col("subject_kind") == kind).groupBy("subject_id").agg(F.map_from_entries(F.collect_list(F.struct(names[F.col("key_id").cast("int")], value))).alias("properties"))

    def property(self, kind: int, subject: int, key: str, required: bool = False):
        """One value, or None; with required, a missing one is an error."""
        k = self.catalog.need("property_keys", key)
        row = self.properties.where((F.col("subject_kind") == kind) & (F.col("subject_id") == subject) & (F.col("key_id") == k.key_id)).select(k.column).first()
        if row is None and required:
            raise UnknownElementError(f"{key} of {subject}")
        return None if row is None else row[0]

    # -- probes ------------------------------------------------------------------------
    def literal(self, key: PropertyKey, value) -> Column:
        kind = {"boolean": bool, "integer": int, "text": str}[key.type]
        if type(value) is not kind:
            raise PropertyTypeError(f"{key.name} is {key.type}")
        return F.lit(value).cast("long") if kind is int else F.lit(value)

    def _holding(self, key: str) -> tuple[PropertyKey, DataFrame]:
        k = self.catalog.need("property_keys", key)
        return k, self.properties.where((F.col("key_id") == k.key_id) & (F.col("subject_kind") == FAMILIES[k.family]))

    def lookup_equal(self, key: str, value) -> DataFrame:
        k, rows = self._holding(key)
        return rows.where(F.col(k.column) == self.literal(k, value)).select("subject_kind", "subject_id")

    def lookup_range(self, key: str, low, high) -> DataFrame:
        """Both ends belong to the range; a low above high gives nothing."""
        k, rows = self._holding(key)
        return rows.where(F.col(k.column).between(self.literal(k, low), self.literal(k, high))).select("subject_kind", "subject_id").distinct()

    def lookup_composite(self, pairs: Sequence[tuple[str, object]]) -> DataFrame:
        """Subjects that carry every pair, in one pass over the properties."""
        wanted = F.lit(False)
        for key, value in pairs:
            k = self.catalog.need("property_keys", key)
            wanted = wanted | ((F.col("key_id") == k.key_id) & (F.col(k.column) == self.literal(k, value)))
        hits = self.properties.where(wanted).groupBy("subject_kind", "subject_id").agg(F.countDistinct("key_id").alias("n"))
        return hits.where(F.col("n") == len({k for k, _ in pairs})).select("subject_kind", "subject_id")

    def lookup(self, index: str, equal=None, between=None, composite=None) -> DataFrame:
        """Probe an index; a probe of the wrong shape is unsupported."""
        i = self.catalog.need("indexes", index)
        given = [x is not None for x in (equal, between, composite)]
        if i.kind in ("label", "relation_type", "projection") and not any(given):
            if i.kind == "label":
                label = F.col("label_id") == self.catalog.labels[i.on[0]]
                e = self.element_labels.where(label).select(F.lit(ELEMENT).alias("subject_kind"), F.col("element_id").alias("subject_id"))
                return e.unionByName(self.relation_labels.where(label).select(F.lit(RELATION).alias("subject_kind"), F.col("relation_id").alias("subject_id")))
            if i.kind == "relation_type":
                return self.relations_of_type(i.on[0]).select(F.lit(RELATION).alias("subject_kind"), F.col("relation_id").alias("subject_id"))
            return self.projection_members(i.on[0])
        if i.kind in ("equality", "range") and given == [True, False, False]:
            return self.lookup_equal(i.on[0], equal)
        if i.kind == "range" and given == [False, True, False]:
            return self.lookup_range(i.on[0], *between)
        if i.kind == "composite" and given == [False, False, True] and len(composite) == len(i.on):
            return self.lookup_composite(list(zip(i.on, composite, strict=True)))
        raise UnsupportedError(f"probe of {i.kind} index {index}")

    def count(self, index: str) -> int:
        return self.lookup(index).count()

    def element_by_key(self, index: str, value) -> DataFrame:
        """The first element with the value; at most one row."""
        return self.lookup(index, equal=value).where(F.col("subject_kind") == ELEMENT).select(F.col("subject_id").alias("element_id")).orderBy("element_id").limit(1)

    def elements_with_label(self, label: str) -> DataFrame:
        return self.element_labels.where(F.col("label_id") == self.catalog.need("labels", label)).select("element_id").distinct()

    def relations_of_type(self, name: str) -> DataFrame:
        return self.relations.where(F.col("relation_type_id") == self.catalog.need("relation_types", name)).select("relation_id")

    # -- adjacency -------------------------------------------------------------------
    def element_incidences(self, element: int) -> DataFrame:
        return self.incidences.where(F.col("element_id") == element).orderBy("incidence_id")

    def relation_incidences(self, relation: int) -> DataFrame:
        return self.incidences.where(F.col("relation_id") == relation).orderBy("incidence_id")

    def endpoints(self, relations: DataFrame | None = None) -> DataFrame:
        """relation_id, first, second: the elements of the two lowest incidences; none where there are fewer."""
        rows = self.incidences if relations is None else self.incidences.join(relations.select("relation_id"), "relation_id", "left_semi")
        two = rows.groupBy("relation_id").agg(F.min_by(F.struct("incidence_id", "element_id"), "incidence_id").alias("a"), F.count("*").alias("n")).where("n > 1")
        rest = rows.join(two.select("relation_id", F.col("a.incidence_id").alias("lowest")), "relation_id").where("incidence_id > lowest")
        second = rest.groupBy("relation_id").agg(F.min_by("element_id", "incidence_id").alias("second"))
        return two.join(second, "relation_id").select("relation_id", F.col("a.element_id").alias("first"), "second")

    def neighbors(self, elements: DataFrame, relation_type: str, direction: str = "both") -> DataFrame:
        """(element_id, neighbor): others in relations of the type; the lower incidence is the source."""
        own = self.incidences.join(self.relations_of_type(relation_type), "relation_id", "left_semi")
        a = own.join(elements.select("element_id"), "element_id", "left_semi").select("relation_id", "element_id", F.col("incidence_id").alias("i"))
        b = own.select("relation_id", F.col("element_id").alias("neighbor"), F.col("incidence_id").alias("j"))
        side = {"outgoing": F.col("i") < F.col("j"), "incoming": F.col("i") > F.col("j"), "both": F.lit(True)}.get(direction)
        if side is None:
            raise UnsupportedError(f"direction: {direction}")
        return a.join(b, "relation_id").where(side & (F.col("element_id") != F.col("neighbor"))).select("element_id", "neighbor").distinct()

    # -- projections --------------------------------------------------------------------
    def graph(self, name: str, check: bool = True) -> Graph:
        p = self._projection(name, "graph")
        return projection.graph(self.relations, self.incidences, self._types(p), self.catalog.roles[p.sources[0]], self.catalog.roles[p.targets[0]], check)

    def hypergraph(self, name: str, check: bool = True) -> HyperGraph:
        p = self._projection(name, "hypergraph")
        roles = lambda names: [self.catalog.roles[r] for r in names]
        return projection.hypergraph(self.relations, self.incidences, self._types(p), roles(p.sources), roles(p.targets), check)

    def _projection(self, name: str, kind: str) -> Projection:
        p = self.catalog.need("projections", name)
        if p.kind != kind:
            raise InvalidProjectionError(f"{name} is a {p.kind} projection")
        return p

    def _types(self, p: Projection) -> list[int]:
        return [self.catalog.relation_types[t] for t in p.types]

    def projection_members(self, name: str) -> DataFrame:
        """(subject_kind, subject_id) of a projection; a hypergraph has its incidences too."""
        kind = lambda df, c, k: df.select(F.lit(k).alias("subject_kind"), F.col(c).alias("subject_id")).distinct()
        if self.catalog.need("projections", name).kind == "graph":
            g = self.graph(name)
            return kind(g.vertices, "element_id", ELEMENT).unionByName(kind(g.edges, "edge", RELATION))
        h = self.hypergraph(name)
        return kind(h.vertices, "element_id", ELEMENT).unionByName(kind(h.relations, "relation_id", RELATION)).unionByName(kind(h.sides, "incidence_id", INCIDENCE))

    # -- writing ------------------------------------------------------------------------
    def with_catalog(self, catalog: Catalog) -> GraphStore:
        return replace(self, catalog=catalog)

    def _mark(self, name: str) -> int:
        """The highest id of a table that was ever given out; removed ones count."""
        if name in self.marks:
            return self.marks[name]
        return getattr(self, name).agg(F.max(IDS[name])).first()[0] or 0

    def _minted(self, name: str, rows: DataFrame, order: Sequence[str]) -> tuple[GraphStore, DataFrame]:
        """The rows with new ids in the order of the columns, and a store with them."""
        last = self._mark(name)
        minted = cut(numbered(rows, list(order), IDS[name], last + 1))
        n = minted.count()
        if not n:
            return self, minted
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        return replace(self, **{name: getattr(self, name).unionByName(minted.select(*columns))}, marks={**self.marks, name: last + n}), minted

    def add_elements(self, rows: DataFrame, order: Sequence[str]) -> tuple[GraphStore, DataFrame]:
        """New elements, one for each row in the order of the columns; also the rows with their element_id."""
        return self._minted("elements", rows, order)

    def add_relations(self, rows: DataFrame, order: Sequence[str]) -> tuple[GraphStore, DataFrame]:
        """rows may have relation_type_id."""
        rows = rows if "relation_type_id" in rows.columns else rows.withColumn("relation_type_id", F.lit(None).cast("long"))
        return self._minted("relations", rows, order)

    def add_incidences(self, rows: DataFrame) -> GraphStore:
        """rows: relation_id, element_id, role_id; all must be visible or registered."""
        roles = list(self.catalog.roles.values())
        if not rows.where(~F.col("role_id").isin(roles)).isEmpty():
            raise UnknownElementError("role")
        for key, of in (("relation_id", self.relations), ("element_id", self.elements)):
            if not rows.join(of, key, "left_anti").isEmpty():
                raise UnknownElementError(key)
        return self._minted("incidences", rows.select("relation_id", "element_id", "role_id"), ["relation_id", "role_id", "element_id"])[0]

    def set_relation_type(self, rows: DataFrame) -> GraphStore:
        """rows: relation_id, relation_type_id [, seq]; they replace what was there.

        Of several rows for one relation the last by seq wins; without seq, the
        greatest type. A relation that is not visible is an error.
        """
        new = _last(rows, "relation_id", "relation_type_id").toDF("relation_id", "t").withColumn("hit", F.lit(True))
        if not new.join(self.relations, "relation_id", "left_anti").isEmpty():
            raise UnknownElementError("relation_id")
        joined = self.relations.join(new, "relation_id", "left")
        if joined.where(F.col("hit") & ~F.col("t").eqNullSafe(F.col("relation_type_id"))).isEmpty():
            return self
        return replace(self, relations=joined.select("relation_id", F.when(F.col("hit"), F.col("t")).otherwise(F.col("relation_type_id")).alias("relation_type_id")))

    def add_labels(self, kind: int, rows: DataFrame) -> GraphStore:
        """rows: element_id or relation_id, and label_id; incidences carry no labels."""
        if kind == INCIDENCE:
            raise UnsupportedError("incidences carry no labels")
        name = ("element_labels", "relation_labels")[kind]
        key = list(IDS.values())[kind]
        if not rows.join(getattr(self, list(IDS)[kind]), key, "left_anti").isEmpty() or not rows.where(~F.col("label_id").isin(list(self.catalog.labels.values()))).isEmpty():
            raise UnknownElementError("subject or label")
        new = cut(rows.select(key, "label_id").distinct().join(getattr(self, name), [key, "label_id"], "left_anti"))
        return self if new.isEmpty() else replace(self, **{name: getattr(self, name).unionByName(new)})

    def set_properties(self, key: str, rows: DataFrame) -> GraphStore:
        """rows: subject_id, value [, seq]. Subjects must be visible.

        Of several rows for one subject the last by seq wins; without seq, the
        greatest value. A value that is there already is left alone.
        """
        k = self.catalog.need("property_keys", key)
        kind = FAMILIES[k.family]
        name = list(IDS)[kind]
        want = {"boolean": "boolean", "integer": "bigint", "text": "string"}[k.type]
        got = dict(rows.dtypes)["value"]
        if got != want and not (want == "bigint" and got in ("int", "smallint", "tinyint")):
            raise PropertyTypeError(f"{key} is {k.type}, not {got}")
        if not rows.join(getattr(self, name).select(F.col(IDS[name]).alias("subject_id")), "subject_id", "left_anti").isEmpty():
            raise UnknownElementError(f"subject of {key}")
        rows = _last(rows, "subject_id", "value")
        columns = {c: F.lit(None).cast(t) for c, t in (("bool_value", "boolean"), ("int_value", "long"), ("text_value", "string"))}
        columns[k.column] = F.col("value").cast(want)
        new = rows.select(F.lit(kind).alias("subject_kind"), "subject_id", F.lit(k.key_id).cast("long").alias("key_id"), *[v.alias(c) for c, v in columns.items()])
        ids = ["subject_kind", "subject_id", "key_id"]
        # An anti-join finds no nulls equal, so only the column of the key's type is compared.
        same = self.properties.where(F.col("key_id") == k.key_id).select(*ids, k.column)
        new = cut(new.join(same, [*ids, k.column], "left_anti"))
        if new.isEmpty():
            return self
        return replace(self, properties=self.properties.join(new.select(*ids), ids, "left_anti").unionByName(new.select(*self.properties.columns)))

    def unset_properties(self, key: str, subjects: DataFrame) -> GraphStore:
        k = self.catalog.need("property_keys", key)
        gone = subjects.select(F.lit(FAMILIES[k.family]).alias("subject_kind"), "subject_id", F.lit(k.key_id).cast("long").alias("key_id"))
        return replace(self, properties=self.properties.join(gone, ["subject_kind", "subject_id", "key_id"], "left_anti"))

    def without(self, kind: int, subjects: DataFrame) -> GraphStore:
        """Tombstone subjects (subject_id): incidences follow their element or relation, labels and
        properties their subject; relations do not follow their elements."""
        ids = subjects.select("subject_id").distinct()
        drop = lambda df, c, gone: df.join(gone.select(F.col("subject_id").alias(c)), c, "left_anti")
        new, gone = {}, {kind: ids}
        if kind == ELEMENT:
            new |= {"elements": drop(self.elements, "element_id", ids), "element_labels": drop(self.element_labels, "element_id", ids)}
        if kind == RELATION:
            new |= {"relations": drop(self.relations, "relation_id", ids), "relation_labels": drop(self.relation_labels, "relation_id", ids)}
        if kind == INCIDENCE:
            new["incidences"] = drop(self.incidences, "incidence_id", ids)
        else:
            c = IDS[list(IDS)[kind]]
            follow = self.incidences.join(ids.select(F.col("subject_id").alias(c)), c, "left_semi").select(F.col("incidence_id").alias("subject_id"))
            new["incidences"], gone[INCIDENCE] = drop(self.incidences, c, ids), follow
        dead = None
        for k, df in gone.items():
            part = df.select(F.lit(k).alias("subject_kind"), "subject_id")
            dead = part if dead is None else dead.unionByName(part)
        marks = {n: self._mark(n) for n in IDS}  # ids that go are never given out again
        return replace(self, properties=self.properties.join(dead, ["subject_kind", "subject_id"], "left_anti"), marks=marks, **new)

    def upsert_elements(self, index: str, values: DataFrame) -> tuple[GraphStore, DataFrame]:
        """(value, element_id): the element that has the value, or a new one that gets it."""
        i = self.catalog.need("indexes", index)
        k = self.catalog.need("property_keys", i.on[0])
        if i.kind != "equality" or k.family != "element":
            raise UnsupportedError(f"upsert through {index}")
        wanted = values.select("value").distinct()
        known = self._holding(k.name)[1].select(F.col(k.column).alias("value"), F.col("subject_id").alias("element_id")).join(wanted, "value", "left_semi").groupBy("value").agg(F.min("element_id").alias("element_id"))
        known = cut(known)
        store, minted = self.add_elements(wanted.join(known, "value", "left_anti"), ["value"])
        store = store.set_properties(k.name, minted.select(F.col("element_id").alias("subject_id"), "value"))
        return store, known.unionByName(minted.select("value", "element_id"))

    def upsert_relations(self, index: str, rows: DataFrame, relation_type: str | None = None) -> tuple[GraphStore, DataFrame]:
        """rows: value, element_id, role_id, one for each end. A known value leaves its relation as it is."""
        i = self.catalog.need("indexes", index)
        k = self.catalog.need("property_keys", i.on[0])
        if i.kind != "equality" or k.family != "relation":
            raise UnsupportedError(f"upsert through {index}")
        wanted = rows.select("value").distinct()
        known = cut(self._holding(k.name)[1].select(F.col(k.column).alias("value"), F.col("subject_id").alias("relation_id")).join(wanted, "value", "left_semi").groupBy("value").agg(F.min("relation_id").alias("relation_id")))
        type_id = F.lit(None if relation_type is None else self.catalog.need("relation_types", relation_type)).cast("long")
        store, minted = self.add_relations(wanted.join(known, "value", "left_anti").withColumn("relation_type_id", type_id), ["value"])
        store = store.set_properties(k.name, minted.select(F.col("relation_id").alias("subject_id"), "value"))
        store = store.add_incidences(rows.join(minted.select("value", "relation_id"), "value").select("relation_id", "element_id", "role_id"))
        return store, known.unionByName(minted.select("value", "relation_id"))

    def retain(self, index: str, keep: DataFrame) -> GraphStore:
        """Tombstone the members of an index that are not in keep (subject_id)."""
        i = self.catalog.need("indexes", index)
        if i.kind in ("label", "relation_type", "projection"):
            members = self.lookup(index)
        else:
            members = self._holding(i.on[0])[1].select("subject_kind", "subject_id")
        store = self
        for kind in (ELEMENT, RELATION, INCIDENCE):
            gone = members.where(F.col("subject_kind") == kind).join(keep.select("subject_id"), "subject_id", "left_anti")
            if i.kind in ("label", "projection") or kind == (RELATION if i.kind == "relation_type" else FAMILIES[self.catalog.property_keys[i.on[0]].family]):
                store = store.without(kind, gone)
        return store

    # -- language -----------------------------------------------------------------------
    def query(self, text: str) -> DataFrame:
        from weftgraph.plans import language

        return language.run(self, text)

    def explain(self, text: str) -> str:
        from weftgraph.plans import language

        return language.explain(self, text)


class Outcome(NamedTuple):
    """What a write left behind: the store now current, its version, and whether nothing was to be written."""

    store: GraphStore
    version: int
    empty: bool


def _last(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value), one row for each key: the last by seq, or the greatest value."""
    last = F.max_by(value, F.struct("seq", value)) if "seq" in rows.columns else F.max(value)
    return rows.groupBy(key).agg(last.alias(value))


def _file(spark: SparkSession, path: str):
    """(file system, path) of a place that every node sees."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a folder, ascending."""
    system, target = _file(spark, f"{path}/versions")
    return sorted(int(s.getPath().getName()) for s in system.listStatus(target) if s.getPath().getName().isdigit()) if system.exists(target) else []


def merged(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows with a delta over them: the delta has the same columns and `gone`; its rows win."""
    kept = base.join(delta.select(*keys), list(keys), "left_anti")
    return kept.unionByName(delta.where(~F.col("gone")).drop("gone"))
