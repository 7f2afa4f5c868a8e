"""Catalog of roles, labels, types, property keys, projections and indexes.

The catalog is small and lives on the driver; ids start at 1 and are never reused.
A catalog is never changed in place: each registration returns a new one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from weftgraph.errors import DuplicateNameError, SchemaConflictError, UnknownNameError, UnsupportedError

ELEMENT, RELATION, INCIDENCE = 0, 1, 2
FAMILIES = {"element": ELEMENT, "relation": RELATION, "incidence": INCIDENCE}
TYPES = {"boolean": "bool_value", "integer": "int_value", "text": "text_value"}
INDEX_KINDS = ("label", "relation_type", "equality", "range", "composite", "projection")


@dataclass(frozen=True)
class PropertyKey:
    key_id: int
    name: str
    family: str
    type: str

    @property
    def column(self) -> str:
        return TYPES[self.type]


@dataclass(frozen=True)
class Projection:
    """A graph takes one role on each side, a hypergraph sets of roles; no types mean all relations."""

    projection_id: int
    name: str
    kind: str
    types: tuple[str, ...]
    sources: tuple[str, ...]
    targets: tuple[str, ...]


@dataclass(frozen=True)
class Index:
    index_id: int
    name: str
    kind: str
    on: tuple[str, ...]


@dataclass(frozen=True)
class Catalog:
    roles: dict[str, int] = field(default_factory=dict)
    labels: dict[str, int] = field(default_factory=dict)
    relation_types: dict[str, int] = field(default_factory=dict)
    property_keys: dict[str, PropertyKey] = field(default_factory=dict)
    projections: dict[str, Projection] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def _add(self, kind: str, name: str, make) -> Catalog:
        known = getattr(self, kind)
        if name in known:
            raise DuplicateNameError(f"{kind}: {name}")
        return replace(self, **{kind: {**known, name: make(len(known) + 1)}})

    def role(self, name: str) -> Catalog:
        return self._add("roles", name, lambda i: i)

    def label(self, name: str) -> Catalog:
        return self._add("labels", name, lambda i: i)

    def relation_type(self, name: str) -> Catalog:
        return self._add("relation_types", name, lambda i: i)

    def property_key(self, name: str, family: str, type_: str) -> Catalog:
        if family not in FAMILIES or type_ not in TYPES:
            raise UnsupportedError(f"property {name}: {family} {type_}")
        return self._add("property_keys", name, lambda i: PropertyKey(i, name, family, type_))

    def graph_projection(self, name: str, source: str, target: str, types: Sequence[str] = ()) -> Catalog:
        return self._projection(name, "graph", types, (source,), (target,))

    def hypergraph_projection(self, name: str, sources: Sequence[str], targets: Sequence[str], types: Sequence[str] = ()) -> Catalog:
        return self._projection(name, "hypergraph", types, tuple(sources), tuple(targets))

    def _projection(self, name: str, kind: str, types: Sequence[str], sources: tuple[str, ...], targets: tuple[str, ...]) -> Catalog:
        for t in types:
            self.need("relation_types", t)
        for r in (*sources, *targets):
            self.need("roles", r)
        return self._add("projections", name, lambda i: Projection(i, name, kind, tuple(types), sources, targets))

    def index(self, name: str, kind: str, on: str | Sequence[str]) -> Catalog:
        on = (on,) if isinstance(on, str) else tuple(on)
        if kind not in INDEX_KINDS or not on or (kind != "composite" and len(on) != 1):
            raise UnsupportedError(f"index {name}: {kind} on {on}")
        where = {"label": "labels", "relation_type": "relation_types", "projection": "projections"}.get(kind, "property_keys")
        for n in on:
            self.need(where, n)
        return self._add("indexes", name, lambda i: Index(i, name, kind, on))

    def need(self, kind: str, name: str):
        try:
            return getattr(self, kind)[name]
        except KeyError:
            raise UnknownNameError(f"{kind}: {name}") from None

    def summary(self) -> dict[str, int]:
        return {k: len(getattr(self, k)) for k in ("roles", "labels", "relation_types", "property_keys", "projections", "indexes")}


@dataclass(frozen=True)
class Schema:
    """Declared names, applied to a catalog as often as one likes."""

    roles: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    relation_types: tuple[str, ...] = ()
    property_keys: tuple[tuple[str, str, str], ...] = ()
    projections: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = ()
    indexes: tuple[tuple[str, str, tuple[str, ...]], ...] = ()

    def apply(self, catalog: Catalog) -> Catalog:
        """Add what is missing; a name with another shape is a conflict."""
        for kind, add in (("roles", Catalog.role), ("labels", Catalog.label), ("relation_types", Catalog.relation_type)):
            for name in getattr(self, kind):
                catalog = catalog if name in getattr(catalog, kind) else add(catalog, name)
        for name, family, type_ in self.property_keys:
            known = catalog.property_keys.get(name)
            if known is None:
                catalog = catalog.property_key(name, family, type_)
            elif (known.family, known.type) != (family, type_):
                raise SchemaConflictError(f"property key {name}")
        for name, kind, types, sources, targets in self.projections:
            known = catalog.projections.get(name)
            if known is None:
                catalog = catalog._projection(name, kind, types, tuple(sources), tuple(targets))
            elif (known.kind, known.types, known.sources, known.targets) != (kind, tuple(types), tuple(sources), tuple(targets)):
                raise SchemaConflictError(f"projection {name}")
        for name, kind, on in self.indexes:
            known = catalog.indexes.get(name)
            if known is None:
                catalog = catalog.index(name, kind, on)
            elif (known.kind, known.on) != (kind, tuple(on)):
                raise SchemaConflictError(f"index {name}")
        return catalog

    def bind(self, catalog: Catalog) -> dict[str, dict[str, object]]:
        """What the declared names stand for; a missing name is an error."""
        names = {k: [x if isinstance(x, str) else x[0] for x in getattr(self, k)] for k in ("roles", "labels", "relation_types", "property_keys", "projections", "indexes")}
        return {k: {n: catalog.need(k, n) for n in v} for k, v in names.items()}

    def fingerprint(self) -> str:
        """The same for the same declarations in any order."""
        lines = sorted(f"{k}|{x!r}" for k in ("roles", "labels", "relation_types", "property_keys", "projections", "indexes") for x in getattr(self, k))
        return hashlib.sha256("\n".join(lines).encode()).hexdigest()
