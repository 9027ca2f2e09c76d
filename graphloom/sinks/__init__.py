"""Targets that a model is written for, with what each of them enforces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..plans.model import Diagnostic, Model
from . import graph_text, property_graph, rdf_text, relational

#: What each target does with a feature (fixed values).
FEATURES = ("required", "unique", "compositeKey", "enums", "open", "value", "named", "cardinality", "inheritance")
CAPABILITIES = {
    "spark": ("unsupported", "unsupported", "unsupported", "unsupported", "unsupported", "unsupported", "unsupported", "unsupported", "leaf-tables"),
    "ladybug": ("key-only", "key-only", "synthesized", "unsupported", "unsupported", "unsupported", "unsupported", "upper-bound-only", "leaf-tables"),
    "sqlpgq": ("enforced", "enforced", "native", "enforced", "unsupported", "enforced", "partial", "upper-bound-only", "leaf-tables"),
    "neo4j": ("edition-dependent", "enforced", "native", "unsupported", "always-open", "unsupported", "unsupported", "unsupported", "labels"),
    "memgraph": ("enforced", "enforced", "native", "enforced", "always-open", "unsupported", "unsupported", "unsupported", "labels"),
    "falkordb": ("enforced", "enforced", "native", "unsupported", "always-open", "unsupported", "unsupported", "unsupported", "labels"),
    "shacl": ("enforced", "unsupported", "native", "enforced", "native", "enforced", "enforced", "enforced", "subclass"),
    "owl": ("unsupported", "unsupported", "native", "enforced", "always-open", "unsupported", "unsupported", "unsupported", "subclass"),
    "gql": ("enforced", "enforced", "unsupported", "unsupported", "unsupported", "unsupported", "unsupported", "unsupported", "labels"),
    "pgschema": ("enforced", "enforced", "native", "unsupported", "native", "unsupported", "unsupported", "unsupported", "subclass"),
    "linkml": ("enforced", "enforced", "native", "enforced", "unsupported", "partial", "unsupported", "enforced", "subclass"),
    "typescript": ("enforced", "unsupported", "native", "enforced", "native", "unsupported", "unsupported", "unsupported", "subclass"),
    "tgs": ("enforced", "unsupported", "unsupported", "enforced", "always-open", "unsupported", "unsupported", "upper-bound-only", "leaf-tables"),
    "context": ("enforced", "enforced", "native", "documented", "native", "enforced", "enforced", "enforced", "subclass"),
    "docs": ("enforced", "enforced", "native", "documented", "native", "enforced", "enforced", "enforced", "subclass"),
}
Emitter = Callable[[Model], str]


@dataclass(frozen=True)
class Target:
    name: str
    extension: str
    emit: Emitter
    capabilities: dict[str, str]


@dataclass(frozen=True)
class Artifact:
    target: str
    extension: str
    content: str
    diagnostics: tuple[Diagnostic, ...]


_EMITTERS: dict[str, tuple[str, Emitter]] = {
    "spark": ("sql", relational.spark),
    "sqlpgq": ("sql", relational.sqlpgq),
    "ladybug": ("cypher", property_graph.ladybug),
    "neo4j": ("cypher", property_graph.neo4j),
    "memgraph": ("cypher", property_graph.memgraph),
    "falkordb": ("sh", property_graph.falkordb),
    "shacl": ("ttl", rdf_text.shacl),
    "owl": ("ttl", rdf_text.owl),
    "gql": ("gql", graph_text.gql),
    "pgschema": ("pgs", graph_text.pgschema),
    "linkml": ("yaml", graph_text.linkml),
    "typescript": ("ts", graph_text.typescript),
    "context": ("md", graph_text.context),
    "docs": ("html", graph_text.docs),
    "tgs": ("md", graph_text.tgs),
}
TARGETS: dict[str, Target] = {name: Target(name, extension, emit_, dict(zip(FEATURES, CAPABILITIES[name], strict=True))) for name, (extension, emit_) in _EMITTERS.items()}
BUILT_IN = frozenset(TARGETS)


def register_target(target: Target) -> None:
    """A target of one's own, with its whole set of capabilities; built-in targets stay."""
    if target.name in BUILT_IN:
        raise ValueError(f"'{target.name}' is built in")
    if set(target.capabilities) != set(FEATURES):
        raise ValueError(f"capabilities of '{target.name}' must be {', '.join(FEATURES)}")
    TARGETS[target.name] = target


def used_features(model: Model) -> set[str]:
    props = [p for o in (*model.nodes, *model.edges) for p in o.props]
    tests = {
        "required": any(p.required for p in props),
        "unique": any(p.unique for p in props),
        "compositeKey": any(len(n.key) > 1 for n in model.nodes),
        "enums": any(p.enum for p in props),
        "open": any(n.open for n in model.nodes),
        "value": any(x is not None for p in props for x in (p.min, p.max, p.pattern, p.min_length, p.max_length)),
        "named": any(n.constraints for n in model.nodes),
        "cardinality": any(b.least or b.most is not None for e in model.edges for b in (e.sources, e.targets)),
        "inheritance": any(n.extends for n in model.nodes),
    }
    return {k for k, on in tests.items() if on}


def emit(model: Model, target: str) -> Artifact:
    """The model's text for a target, with a warning for each feature that the target can't hold."""
    t = TARGETS[target]
    weak = ("unsupported", "always-open", "partial", "key-only", "upper-bound-only", "edition-dependent")
    said = tuple(Diagnostic("info" if f in ("named", "value") else "warning", f"downgrade-{f}", f"{target}: {f} is {t.capabilities[f]}", target) for f in FEATURES if f in used_features(model) and t.capabilities[f] in weak)
    return Artifact(target, t.extension, t.emit(model), said)


def capability_rows() -> list[tuple[str, str, str]]:
    return [(t.name, f, t.capabilities[f]) for t in TARGETS.values() for f in FEATURES]
