"""Checks of a resolved model that need no data."""

from __future__ import annotations

import re

from ..functions.types import ORDERED, TEXT, ValueType
from .model import FORMAT_VERSION, Diagnostic, Model, Property


def _walk(t: ValueType):
    yield t
    for _, part in t.parts:
        yield from _walk(part)


def _composite(p: Property, where: str) -> list[Diagnostic]:
    out = []
    for t in _walk(p.type):
        if t.kind == "array" and (t.size or 0) < 1:
            out.append(Diagnostic("error", "empty-array-type", f"'{where}' holds arrays of no elements.", where))
        if t.kind == "map" and t.parts[0][1].kind != "scalar":
            out.append(Diagnostic("error", "composite-map-key", f"'{where}' has a composite map key.", where))
        if t.kind in ("struct", "union") and len({n for n, _ in t.parts}) < len(t.parts):
            out.append(Diagnostic("error", "duplicate-type-field", f"'{where}' names a field twice.", where))
    return out


def _facets(model: Model, p: Property, where: str) -> list[Diagnostic]:
    out = _composite(p, where)
    say = lambda severity, code, message: out.append(Diagnostic(severity, code, message, where))
    if p.enum is not None:
        if model.enum(p.enum) is None:
            say("error", "unresolved-enum", f"'{where}' uses the unknown enum '{p.enum}'.")
        if p.scalar != "string":
            say("error", "enum-type-mismatch", f"'{where}' has an enum but is no string.")
    if (p.min is not None or p.max is not None) and p.scalar not in ORDERED:
        say("error", "constraint-type-mismatch", f"'{where}' has bounds, but {p.scalar} has no order.")
    if (p.pattern is not None or p.min_length is not None or p.max_length is not None) and p.scalar not in TEXT:
        say("error", "constraint-type-mismatch", f"'{where}' has a pattern or lengths, but is no text.")
    if (p.min is not None and p.max is not None and p.min > p.max) or (p.min_length is not None and p.max_length is not None and p.min_length > p.max_length):
        say("error", "impossible-constraint", f"No value of '{where}' can satisfy its bounds.")
    if p.pattern is not None:
        try:
            re.compile(p.pattern)
        except re.error:
            say("error", "malformed-pattern", f"The pattern of '{where}' is no regular expression.")
    return out


def validate_model(model: Model) -> list[Diagnostic]:
    out: list[Diagnostic] = []
    say = lambda severity, code, message, target="": out.append(Diagnostic(severity, code, message, target))
    if not re.fullmatch(r"\d+\.\d+", model.version):
        say("error", "unknown-format-version", f"'{model.version}' is no format version.")
    elif model.version.split(".")[0] != FORMAT_VERSION.split(".")[0]:
        say("error", "unsupported-format-version", f"Format {model.version} is not {FORMAT_VERSION}.")
    for x in model.enums:
        if len(set(x.values)) < len(x.values):
            say("error", "duplicate-enum-value", f"Enum '{x.name}' lists a value twice.", x.name)
    for n in model.nodes:
        if not n.abstract and not n.key:
            say("error", "missing-key", f"'{n.name}' has no key.", n.name)
        for k in n.key:
            p = n.prop(k)
            if p is None:
                say("error", "key-unknown-property", f"The key of '{n.name}' names the unknown '{k}'.", n.name)
            elif p.is_list:
                say("error", "list-key", f"'{n.name}.{k}' is a list and can't be a key.", n.name)
            elif p.type.kind != "scalar":
                say("error", "composite-key-property", f"'{n.name}.{k}' is composite and can't be a key.", n.name)
        for p in n.props:
            if not p.inherited_from:
                out += _facets(model, p, f"{n.name}.{p.name}")
        names = [c.name for c in n.constraints]
        for c in n.constraints:
            where = f"{n.name}.{c.name}"
            if names.count(c.name) > 1:
                say("error", "duplicate-constraint", f"'{where}' is declared twice.", where)
            for p in c.props:
                if n.prop(p) is None:
                    say("error", "unresolved-operand", f"'{where}' names the unknown property '{p}'.", where)
            if c.kind == "count":
                e, line = model.edge(c.edge or ""), (n.name, *n.ancestors)
                if e is None:
                    say("error", "unresolved-operand", f"'{where}' counts the unknown edge '{c.edge}'.", where)
                elif e.source not in line:
                    say("error", "unreachable-edge", f"'{where}' counts '{c.edge}', which doesn't start at '{n.name}'.", where)
                elif c.of and (of := model.node(c.of)) is None:
                    say("error", "unresolved-operand", f"'{where}' counts the unknown type '{c.of}'.", where)
                elif c.of and e.target not in (c.of, *of.ancestors) and c.of not in (model.node(e.target).ancestors if model.node(e.target) else ()):
                    say("error", "incompatible-qualifier", f"'{where}' counts '{c.of}', where '{c.edge}' never ends.", where)
                if c.bound.most is not None and c.bound.least > c.bound.most:
                    say("error", "impossible-constraint", f"Nothing can satisfy '{where}'.", where)
    for e in model.edges:
        for p in e.props:
            out += _facets(model, p, f"{e.name}.{p.name}")
    used = {m for n in model.nodes for m in n.mixins}
    for m in model.mixins:
        if m.name not in used:
            say("warning", "unused-mixin", f"No type uses mixin '{m.name}'.", m.name)
        for n in model.nodes:
            own = {p.name for p in n.props if not p.mixin and not p.inherited_from}
            if m.name in n.mixins and (both := own & {p.name for p in m.props}):
                say("warning", "shadowed-mixin-property", f"'{n.name}' declares {', '.join(sorted(both))} of mixin '{m.name}' itself.", n.name)
    return out
