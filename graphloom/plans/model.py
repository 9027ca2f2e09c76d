"""What a graph model declares: types, properties, constraints and bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from ..functions.types import ValueType, spark_type

FORMAT_VERSION = "1.0"


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    code: str
    message: str
    target: str = ""


@dataclass(frozen=True)
class Bound:
    """How many elements: at least `least`, at most `most` (None: any number)."""

    least: int = 0
    most: int | None = None

    def __str__(self) -> str:
        if self.most is None:
            return "*" if not self.least else f"{self.least}..*"
        return str(self.least) if self.least == self.most else f"{self.least}..{self.most}"


MANY, ONE = Bound(), Bound(0, 1)
#: Bounds (from, to) by the words of a name (fixed values).
NAMED = {"one-to-one": (ONE, ONE), "one-to-many": (ONE, MANY), "many-to-one": (MANY, ONE), "many-to-many": (MANY, MANY), "one-one": (ONE, ONE), "one-many": (ONE, MANY), "many-one": (MANY, ONE), "many-many": (MANY, MANY)}


def parse_bound(text: str) -> Bound | None:
    m = re.fullmatch(r"\s*(?:(\*)|(\d+)(?:\s*\.\.\s*(\d+|\*))?)\s*", text)
    if not m:
        return None
    if m[1]:
        return MANY
    return Bound(int(m[2]), None if m[3] == "*" else int(m[3] or m[2]))


@dataclass(frozen=True)
class Property:
    name: str
    type: ValueType
    id: str = ""
    enum: str | None = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    required: bool = False
    unique: bool = False
    inherited_from: str | None = None
    mixin: str | None = None
    source_id: str | None = None

    @property
    def is_list(self) -> bool:
        return self.type.kind in ("list", "array")

    @property
    def scalar(self) -> str:
        """The scalar's name, that of a list's items, or json for other composites."""
        t = self.type.item if self.is_list else self.type
        return t.name if t.kind == "scalar" else "json"

    def field(self) -> T.StructField:
        facets = {"id": self.id, "type": str(self.type), "enum": self.enum, "min": self.min, "max": self.max, "minLength": self.min_length, "maxLength": self.max_length, "pattern": self.pattern, "unique": self.unique or None, "size": self.type.size}
        return T.StructField(self.name, spark_type(self.type), not self.required, {k: v for k, v in facets.items() if v is not None})


@dataclass(frozen=True)
class Constraint:
    """A named assertion: kind with two properties, several, or an edge's count."""

    name: str
    kind: str
    props: tuple[str, ...] = ()
    edge: str | None = None
    of: str | None = None
    bound: Bound = MANY
    message: str = ""
    severity: str = "violation"
    id: str = ""


@dataclass(frozen=True)
class NodeType:
    name: str
    id: str = ""
    iri: str | None = None
    abstract: bool = False
    open: bool = False
    extends: str | None = None
    mixins: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    props: tuple[Property, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    raw_shacl: str | None = None
    ancestors: tuple[str, ...] = ()
    key_inherited_from: str | None = None
    file: str = ""

    def prop(self, name: str) -> Property | None:
        return next((p for p in self.props if p.name == name), None)


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: str = ""
    target: str = ""
    id: str = ""
    iri: str | None = None
    sources: Bound = MANY
    """How many sources one target has (`from`)."""
    targets: Bound = MANY
    """How many targets one source has (`to`)."""
    props: tuple[Property, ...] = ()
    file: str = ""


@dataclass(frozen=True)
class Enum:
    name: str
    values: tuple[str, ...]
    id: str = ""
    file: str = ""


@dataclass(frozen=True)
class Mixin:
    name: str
    props: tuple[Property, ...] = ()
    id: str = ""
    file: str = ""


@dataclass(frozen=True)
class Model:
    prefix: str = ""
    iri: str = ""
    version: str = FORMAT_VERSION
    prefixes: dict[str, str] = field(default_factory=dict)
    imports: tuple[tuple[str, str], ...] = ()
    nodes: tuple[NodeType, ...] = ()
    edges: tuple[EdgeType, ...] = ()
    mixins: tuple[Mixin, ...] = ()
    enums: tuple[Enum, ...] = ()
    derived_ids: frozenset[str] = frozenset()

    def node(self, name: str) -> NodeType | None:
        return next((n for n in self.nodes if n.name == name), None)

    def edge(self, name: str) -> EdgeType | None:
        return next((e for e in self.edges if e.name == name), None)

    def enum(self, name: str | None) -> Enum | None:
        return next((e for e in self.enums if e.name == name), None)

    def concrete(self) -> list[NodeType]:
        return [n for n in self.nodes if not n.abstract]

    def descendants(self, name: str) -> list[NodeType]:
        return [n for n in self.nodes if name in n.ancestors]

    def leaves(self, name: str) -> list[NodeType]:
        """The tables that hold a type: itself if concrete, else its concrete descendants."""
        own = self.node(name)
        if own is None:
            return []
        return [own] if not own.abstract else [n for n in self.descendants(name) if not n.abstract]

    def carriers(self, name: str) -> list[NodeType]:
        """All concrete types whose rows are of the type, it and its descendants."""
        return [n for n in self.concrete() if n.name == name or name in n.ancestors]

    def schema(self, name: str) -> T.StructType:
        return T.StructType([p.field() for p in self.node(name).props])

    # immutable edits: each returns a new model
    def with_node(self, node: NodeType) -> Model:
        return replace(self, nodes=(*(n for n in self.nodes if n.name != node.name), node))

    def without_node(self, name: str) -> Model:
        return replace(self, nodes=tuple(n for n in self.nodes if n.name != name), edges=tuple(e for e in self.edges if name not in (e.source, e.target)))

    def with_edge(self, edge: EdgeType) -> Model:
        return replace(self, edges=(*(e for e in self.edges if e.name != edge.name), edge))

    def without_edge(self, name: str) -> Model:
        return replace(self, edges=tuple(e for e in self.edges if e.name != name))

    def edit_node(self, node: str, /, **changes) -> Model:
        return replace(self, nodes=tuple(replace(n, **changes) if n.name == node else n for n in self.nodes))

    def edit_edge(self, edge: str, /, **changes) -> Model:
        return replace(self, edges=tuple(replace(e, **changes) if e.name == edge else e for e in self.edges))

    def edit_property(self, owner: str, prop: str, /, **changes) -> Model:
        new = lambda props: tuple(replace(p, **changes) if p.name == prop else p for p in props)
        return replace(self, nodes=tuple(replace(n, props=new(n.props)) if n.name == owner else n for n in self.nodes), edges=tuple(replace(e, props=new(e.props)) if e.name == owner else e for e in self.edges))

    def rename_type(self, old: str, new: str) -> Model:
        """A node type's new name, wherever it is referred to."""
        r = lambda x: new if x == old else x
        nodes = tuple(replace(n, name=r(n.name), extends=r(n.extends), ancestors=tuple(map(r, n.ancestors)), constraints=tuple(replace(c, of=r(c.of)) for c in n.constraints), props=tuple(replace(p, inherited_from=r(p.inherited_from)) for p in n.props)) for n in self.nodes)
        return replace(self, nodes=nodes, edges=tuple(replace(e, source=r(e.source), target=r(e.target)) for e in self.edges))

    def edges_referencing(self, name: str) -> list[EdgeType]:
        return [e for e in self.edges if name in (e.source, e.target)]
