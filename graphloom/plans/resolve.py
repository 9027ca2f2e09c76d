"""Resolution: imports, inheritance, mixins, keys and ids, flattened into one model."""

from __future__ import annotations

import posixpath
from collections import deque
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from ..sources.model_yaml import parse_model
from .ids import derive_id, duplicate_ids
from .model import Constraint, Diagnostic, Model, NodeType, Property
from .validate import validate_model


def _read(path: str) -> str | None:
    p = Path(path)
    return p.read_text(encoding="utf-8") if p.is_file() else None


def load_closure(entry: str, read: Callable[[str], str | None] = _read) -> tuple[list[tuple[str, Model]], list[Diagnostic]]:
    """The entry file and all that it imports, nearest first; of files with one namespace IRI the first counts."""
    queue, seen, spaces, out, said = deque([(entry, "")]), {entry}, set(), [], []
    while queue:
        path, importer = queue.popleft()
        text = read(path)
        if text is None:
            said.append(Diagnostic("error", "missing-import", f"{path} can't be read" + (f" for {importer}." if importer else "."), path))
            continue
        model, found = parse_model(path, text)
        said += found
        for target, _ in model.imports:
            full = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
            if full not in seen:
                seen.add(full)
                queue.append((full, path))
        if not model.iri:
            if not any(d.target == path and d.severity == "error" for d in said):
                said.append(Diagnostic("error", "missing-namespace", f"{path} declares no namespace.", path))
        elif model.iri in spaces:
            continue
        spaces.add(model.iri)
        out.append((path, model))
    return out, said


def _ancestors(nodes: dict[str, NodeType], name: str, said: list[Diagnostic]) -> tuple[str, ...]:
    chain, at = [], nodes[name].extends
    while at:
        if at == name or at in chain:
            said.append(Diagnostic("error", "cyclic-inheritance", f"'{name}' inherits from itself.", name))
            break
        if at not in nodes:
            said.append(Diagnostic("error", "unresolved-parent", f"'{name}' extends the unknown '{at}'.", name))
            break
        chain.append(at)
        at = nodes[at].extends
    return tuple(chain)


def resolve_model(entry: str, read: Callable[[str], str | None] = _read) -> tuple[Model, list[Diagnostic]]:
    """The model of a file with everything that it imports, checked."""
    loaded, said = load_closure(entry, read)
    if not loaded:
        return Model(), said
    first = loaded[0][1]
    prefixes: dict[str, str] = {}
    for _, m in reversed(loaded):
        prefixes |= m.prefixes | ({m.prefix: m.iri} if m.prefix else {})
    nodes, edges, mixins, enums = {}, {}, {}, {}
    for path, m in reversed(loaded):  # imported first, so that the entry file is the one to be told
        for kind, into, own in (("node", nodes, m.nodes), ("edge", edges, m.edges), ("mixin", mixins, m.mixins), ("enum", enums, m.enums)):
            for x in own:
                if x.name in into and into[x.name].file != path and kind in ("node", "edge"):
                    said.append(Diagnostic("error", "sealed-import", f"{kind} '{x.name}' of {path} is already declared in {into[x.name].file}.", x.name))
                    continue
                into[x.name] = x
    model = flatten(Model(first.prefix, first.iri, first.version, prefixes, first.imports, tuple(nodes.values()), tuple(edges.values()), tuple(mixins.values()), tuple(enums.values())), said)
    return model, said + duplicate_ids(model) + validate_model(model)


def flatten(model: Model, said: list[Diagnostic] | None = None) -> Model:
    """Ids, ancestors, inherited properties and keys of declared types. Constraints aren't inherited."""
    said = [] if said is None else said
    taken: set[str] = {x.id for x in (*model.nodes, *model.edges, *model.mixins, *model.enums) if x.id}
    derived: set[str] = set()

    def id_of(own: str, kind: str, name: str, within: str | None = None) -> str:
        if own:
            return own
        found = derive_id(kind, name, within, taken)
        taken.add(found)
        derived.add(found)
        return found

    def props_of(props: tuple[Property, ...], owner: str) -> tuple[Property, ...]:
        return tuple(replace(p, id=id_of(p.id, "prop", p.name, owner)) for p in props)

    mixins = {m.name: replace(m, id=id_of(m.id, "mixin", m.name), props=props_of(m.props, m.name)) for m in model.mixins}
    nodes = {n.name: replace(n, id=id_of(n.id, "node", n.name), props=props_of(tuple(p for p in n.props if not p.inherited_from and not p.mixin), n.name), constraints=tuple(replace(c, id=id_of(c.id, "constraint", c.name, n.name)) for c in n.constraints), key=() if n.key_inherited_from else n.key) for n in model.nodes}
    edges = [replace(e, id=id_of(e.id, "edge", e.name), props=props_of(e.props, e.name)) for e in model.edges]
    enums = [replace(x, id=id_of(x.id, "enum", x.name)) for x in model.enums]
    done = []
    for n in nodes.values():
        line = _ancestors(nodes, n.name, said)
        found: dict[str, Property] = {}
        for at in (n.name, *line):  # nearest first; own properties go before those of mixins
            owner, from_ = nodes[at], None if at == n.name else at
            for p in owner.props:
                found.setdefault(p.name, replace(p, inherited_from=from_))
            for mixin in owner.mixins:
                if mixin not in mixins:
                    if from_ is None:
                        said.append(Diagnostic("error", "unresolved-mixin", f"'{n.name}' uses the unknown mixin '{mixin}'.", n.name))
                    continue
                for p in mixins[mixin].props:
                    found.setdefault(p.name, replace(p, id=derive_id("prop", p.name, at), source_id=p.id, mixin=mixin, inherited_from=from_))
        key_from = next((at for at in (n.name, *line) if nodes[at].key), None)
        done.append(replace(n, ancestors=line, props=tuple(found.values()), key=nodes[key_from].key if key_from else (), key_inherited_from=key_from if key_from != n.name else None))
    names = set(nodes)
    for e in edges:
        for end, at in (("from", e.source), ("to", e.target)):
            if not at:
                said.append(Diagnostic("error", "missing-endpoint", f"Edge '{e.name}' has no '{end}'.", e.name))
            elif at not in names:
                said.append(Diagnostic("error", "unresolved-endpoint", f"Edge '{e.name}' names the unknown type '{at}' as '{end}'.", e.name))
    order = lambda xs: tuple(sorted(xs, key=lambda x: (x.name.casefold(), x.name)))
    return replace(model, nodes=order(done), edges=order(edges), mixins=tuple(mixins.values()), enums=order(enums), derived_ids=frozenset(derived))


def model_of(text: str) -> Model:
    """The model of a text without imports; errors are raised."""
    model, said = resolve_model("model.yaml", lambda path: text if path == "model.yaml" else None)
    if wrong := [d for d in said if d.severity == "error"]:
        raise ValueError("; ".join(f"{d.code}: {d.message}" for d in wrong))
    return model


__all__ = ["Constraint", "flatten", "load_closure", "model_of", "resolve_model"]
