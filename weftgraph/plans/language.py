"""Nine statements over a GraphStore.

    CATALOG
    MATCH ELEMENTS | RELATIONS | INCIDENCES
    MATCH ELEMENTS HAS LABEL name
    MATCH RELATIONS TYPE name
    MATCH ELEMENTS WHERE key op literal [AND | OR ... ( ... )]
    GRAPH projection NEIGHBORS element
    GRAPH projection WALK FROM element DEPTH n [DIRECTION outgoing | incoming | both] [LIMIT n]

Words are separated by blanks, keywords may be written in any case, names may
not. A statement is parsed into a Statement without the catalog, then bound to
it; everything after that is Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.catalog import ELEMENT
from weftgraph.errors import InvalidProjectionError, PropertyTypeError, UnsupportedError
from weftgraph.functions.keys import parse_literal

COMPARE = {"=": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
UNLIMITED = (1 << 64) - 1


@dataclass(frozen=True)
class Compare:
    key: str
    op: str
    token: str


@dataclass(frozen=True)
class Both:
    word: str
    left: object
    right: object


@dataclass(frozen=True)
class Statement:
    shape: str
    name: str | None = None
    predicate: object = None
    element: int | None = None
    depth: int = 1
    direction: str = "outgoing"
    limit: int | None = None


class _Predicate:
    """Words of a WHERE clause; OR binds weaker than AND, parentheses stand alone."""

    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self, what: str) -> str:
        if self.at >= len(self.words):
            raise UnsupportedError(f"expected {what} in WHERE")
        self.at += 1
        return self.words[self.at - 1]

    def chain(self, word: str, part):
        left = part()
        while (self.peek() or "").upper() == word:
            self.at += 1
            left = Both(word, left, part())
        return left

    def any_of(self):
        return self.chain("OR", self.all_of)

    def all_of(self):
        return self.chain("AND", self.factor)

    def factor(self):
        if self.peek() == "(":
            self.at += 1
            inner = self.any_of()
            if self.take("a closing parenthesis") != ")":
                raise UnsupportedError("unbalanced parentheses in WHERE")
            return inner
        key, op, token = self.take("a key"), self.take("a comparison"), self.take("a value")
        if op not in COMPARE:
            raise UnsupportedError(f"comparison: {op}")
        return Compare(key, op, token)


def _whole(word: str, what: str) -> int:
    if not (word.isascii() and word.isdigit()):
        raise UnsupportedError(f"{what} must be a whole number")
    return int(word)


def parse(text: str) -> Statement:
    words = text.split()
    upper = [w.upper() for w in words]
    if upper[:3] == ["MATCH", "ELEMENTS", "WHERE"]:
        p = _Predicate(words[3:])
        predicate = p.any_of()
        if p.peek() is not None:
            raise UnsupportedError(f"unexpected {p.peek()} in WHERE")
        return Statement("equal" if isinstance(predicate, Compare) and predicate.op == "=" else "where", predicate=predicate)
    if upper == ["CATALOG"]:
        return Statement("catalog")
    if len(words) == 2 and upper[0] == "MATCH" and upper[1] in ("ELEMENTS", "RELATIONS", "INCIDENCES"):
        return Statement(upper[1].lower())
    if len(words) == 5 and upper[:4] == ["MATCH", "ELEMENTS", "HAS", "LABEL"]:
        return Statement("label", words[4])
    if len(words) == 4 and upper[:3] == ["MATCH", "RELATIONS", "TYPE"]:
        return Statement("type", words[3])
    if len(words) == 4 and upper[0] == "GRAPH" and upper[2] == "NEIGHBORS":
        return Statement("walk", words[1], element=_whole(words[3], "an element"))
    if len(words) >= 7 and upper[0] == "GRAPH" and upper[2:4] == ["WALK", "FROM"] and upper[5] == "DEPTH":
        options: dict[str, object] = {}
        rest = words[7:]
        if len(rest) % 2:
            raise UnsupportedError("a walk option needs a value")
        for option, value in zip(rest[::2], rest[1::2], strict=True):
            name = option.lower()
            if name in options or name not in ("direction", "limit"):
                raise UnsupportedError(f"walk option: {option}")
            if name == "direction" and value.lower() not in ("outgoing", "incoming", "both"):
                raise UnsupportedError(f"direction: {value}")
            options[name] = value.lower() if name == "direction" else _whole(value, "a limit")
        return Statement("walk", words[1], element=_whole(words[4], "an element"), depth=_whole(words[6], "a depth"), **options)
    raise UnsupportedError(f"statement: {text}")


def _keys(predicate) -> list[str]:
    return [predicate.key] if isinstance(predicate, Compare) else _keys(predicate.left) + _keys(predicate.right)


def _condition(store, predicate) -> Column:
    if isinstance(predicate, Both):
        left, right = _condition(store, predicate.left), _condition(store, predicate.right)
        return left & right if predicate.word == "AND" else left | right
    key = store.catalog.need("property_keys", predicate.key)
    if key.family != "element":
        raise PropertyTypeError(f"{key.name} belongs to a {key.family}")
    return getattr(F.col(f"k{key.key_id}"), COMPARE[predicate.op])(store.literal(key, parse_literal(predicate.token)))


def run(store, text: str) -> DataFrame:
    s = parse(text)
    if s.shape == "catalog":
        rows = [(p.projection_id, p.name) for p in store.catalog.projections.values()]
        return store.elements.sparkSession.createDataFrame(rows, "projection_id long, name string").orderBy("projection_id")
    if s.shape == "elements":
        return store.element_ids()
    if s.shape == "relations":
        return store.relation_ids()
    if s.shape == "incidences":
        return store.incidences.orderBy("incidence_id")
    if s.shape == "label":
        return store.elements_with_label(s.name).orderBy("element_id")
    if s.shape == "type":
        return store.relations_of_type(s.name).orderBy("relation_id")
    if s.shape in ("equal", "where"):
        condition = _condition(store, s.predicate)  # names and types are checked first
        keys = [store.catalog.property_keys[k] for k in dict.fromkeys(_keys(s.predicate))]
        held = store.properties.where((F.col("subject_kind") == ELEMENT) & F.col("key_id").isin([k.key_id for k in keys]))
        if s.shape == "equal":
            k = keys[0]
            return held.where(F.col(k.column) == store.literal(k, parse_literal(s.predicate.token))).select(F.col("subject_id").alias("element_id")).orderBy("element_id")
        values = [F.max(F.when(F.col("key_id") == k.key_id, F.col(k.column))).alias(f"k{k.key_id}") for k in keys]
        return held.groupBy(F.col("subject_id").alias("element_id")).agg(*values).where(condition).select("element_id").orderBy("element_id")
    p = store.catalog.need("projections", s.name)
    if p.kind != "graph":
        raise InvalidProjectionError(f"{s.name} is a {p.kind} projection")
    return store.graph(s.name).walk([s.element], s.depth, s.direction, s.limit).nodes.select(F.col("element").alias("element_id"), "depth")


def _words(predicate) -> str:
    if isinstance(predicate, Compare):
        return f"{predicate.key} {predicate.op} {predicate.token}"
    return f"({_words(predicate.left)} {predicate.word} {_words(predicate.right)})"


def explain(store, text: str) -> str:
    """One line on the chosen access path, then Spark's plan."""
    s = parse(text)
    line = {
        "catalog": "catalog metadata", "elements": "scan of elements", "relations": "scan of relations", "incidences": "scan of incidences",
        "label": f"elements by label {s.name}", "type": f"relations by type {s.name}",
        "equal": f"elements by property {_words(s.predicate) if s.predicate else ''}", "where": f"filter of elements {_words(s.predicate) if s.predicate else ''}",
        "walk": f"walk of projection {s.name} from {s.element}, depth {s.depth}, {s.direction}, limit {UNLIMITED if s.limit is None else s.limit}",
    }[s.shape]
    df = run(store, text)
    return line + "\n" + df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
