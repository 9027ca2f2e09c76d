"""Lint of queries against a model: names, directions, endpoints, properties and literals, without running anything."""

from __future__ import annotations

from ..functions.types import NUMERIC
from .model import Diagnostic, Model, NodeType, Property
from .patterns import NodePattern, RelPattern, Token, lex, read_chains

COMPARISONS = {"=", "<>", "<", ">", "<=", ">="}


def _family(p: Property) -> str | None:
    if p.type.kind != "scalar":
        return None
    if p.enum:
        return "enum"
    return "string" if p.scalar == "string" else "boolean" if p.scalar == "boolean" else "number" if p.scalar in NUMERIC else None


def _literal_family(t: Token | None) -> str | None:
    if t is None:
        return None
    return t.kind if t.kind in ("string", "number") else "boolean" if t.text.lower() in ("true", "false") else None


class _Linter:
    def __init__(self, model: Model, file: str) -> None:
        self.model, self.file, self.out = model, file, []

    def say(self, code: str, message: str, at: int, severity: str = "error") -> None:
        self.out.append(Diagnostic(severity, code, message, f"{self.file}:{at}"))

    def related(self, a: str, b: str) -> bool:
        """Whether a row could be of both types: one descends from the other."""
        x, y = self.model.node(a), self.model.node(b)
        return x is None or y is None or a == b or a in y.ancestors or b in x.ancestors

    def holders(self, labels: set[str]) -> list[NodeType]:
        """Types whose properties a node with these labels may have: the types and their descendants."""
        return [n for n in self.model.nodes if any(n.name == x or x in n.ancestors for x in labels)]

    def node_property(self, labels: set[str], name: str, at: int) -> Property | None:
        types = self.holders(labels)
        found = next((p for n in types if (p := n.prop(name))), None)
        if types and found is None and not any(n.open for n in types):
            self.say("lint-unknown-property", f"{' and '.join(sorted(labels))} has no property '{name}'.", at)
        return found

    def edge_property(self, types: tuple[str, ...], name: str, at: int) -> Property | None:
        edges = [e for t in types if (e := self.model.edge(t))]
        found = next((p for e in edges for p in e.props if p.name == name), None)
        if edges and len(edges) == len(types) and found is None:
            self.say("lint-unknown-property", f"{' and '.join(types)} has no property '{name}'.", at)
        return found

    def literal(self, p: Property | None, where: str, value: Token | None) -> None:
        if p is None or (given := _literal_family(value)) is None or (wanted := _family(p)) is None:
            return
        if given != ("string" if wanted == "enum" else wanted):
            self.say("lint-type-mismatch", f"{where} is a {p.scalar} and is compared with a {given}.", value.start)
        elif wanted == "enum" and (e := self.model.enum(p.enum)) and value.value not in e.values:
            self.say("lint-enum-value", f"{where} is one of {', '.join(e.values)}, never '{value.value}'.", value.start)

    def statement(self, tokens: list[Token]) -> None:
        chains = read_chains(tokens)
        # variables bound anew are not followed
        rebound = {tokens[i + 1].value for i, t in enumerate(tokens[:-1]) if t.text.upper() == "AS" and tokens[i + 1].kind in ("word", "quoted")}
        rebound |= {tokens[i - 1].value for i, t in enumerate(tokens) if i and t.text.upper() == "IN" and tokens[i - 1].kind == "word" and (i < 2 or tokens[i - 2].text != ".")}
        bound: dict[str, tuple[set[str], tuple[str, ...]]] = {}
        unsure: set[str] = set(rebound)
        for chain in chains:
            for x in chain:
                if x.variable is None:
                    continue
                kinds = (set(x.labels), ()) if isinstance(x, NodePattern) else (set(), x.types)
                if not x.readable:
                    unsure.add(x.variable)
                elif kinds != (set(), ()):
                    if x.variable in bound and bound[x.variable] != kinds:
                        unsure.add(x.variable)
                    bound[x.variable] = kinds
        labels_of = lambda x: set(x.labels) or (bound.get(x.variable, (set(), ()))[0] if x.variable and x.variable not in unsure else set())
        for chain in chains:
            for x in chain:
                self.element(x)
            for left, rel, right in zip(chain[::2], chain[1::2], chain[2::2], strict=False):
                self.step(labels_of(left), rel, labels_of(right))
        for i, t in enumerate(tokens[:-2]):
            if t.kind not in ("word", "quoted") or tokens[i + 1].text != "." or tokens[i + 2].kind not in ("word", "quoted") or (i and tokens[i - 1].text == "."):
                continue
            if t.value in unsure or t.value not in bound or (i + 3 < len(tokens) and tokens[i + 3].text in (".", "(")):
                continue
            labels, types = bound[t.value]
            name, where = tokens[i + 2].value, f"{t.value}.{tokens[i + 2].value}"
            if labels and any(self.model.node(x) is None for x in labels):
                continue
            p = self.node_property(labels, name, tokens[i + 2].start) if labels else self.edge_property(types, name, tokens[i + 2].start)
            follows = tokens[i + 3 : i + 6]
            if len(follows) > 1 and follows[0].text in COMPARISONS:
                self.literal(p, where, follows[2] if follows[1].text == "-" and len(follows) > 2 else follows[1])
            elif i > 1 and tokens[i - 1].text in COMPARISONS:
                self.literal(p, where, tokens[i - 2])

    def element(self, x: NodePattern | RelPattern) -> None:
        if not x.readable:
            return
        if isinstance(x, NodePattern):
            for label in x.labels:
                if self.model.node(label) is None:
                    self.say("lint-unknown-label", f"The model has no node type '{label}'.", x.start)
            known = bool(x.labels) and all(self.model.node(y) for y in x.labels)
            for name, value in x.props.items() if known else ():
                self.literal(self.node_property(set(x.labels), name, x.start), name, value)
        else:
            for t in x.types:
                if self.model.edge(t) is None:
                    self.say("lint-unknown-edge", f"The model has no edge type '{t}'.", x.start)
            for name, value in x.props.items() if x.types else ():
                self.literal(self.edge_property(x.types, name, x.start), name, value)

    def step(self, left: set[str], rel: RelPattern, right: set[str]) -> None:
        edges = [e for t in rel.types if (e := self.model.edge(t))]
        if not rel.readable or not edges or len(edges) < len(rel.types) or (rel.least, rel.most) != (1, 1):
            return
        if any(self.model.node(x) is None for x in left | right):
            return
        fit = lambda a, b: any(all(self.related(x, e.source) for x in a) and all(self.related(x, e.target) for x in b) for e in edges)
        there, back = fit(left, right), fit(right, left)
        names = "|".join(rel.types)
        ok = {"out": there, "in": back, "any": there or back}[rel.direction]
        if not ok and rel.direction != "any" and (there or back):
            self.say("lint-edge-direction", f"{names} goes the other way.", rel.start)
        elif not ok:
            self.say("lint-edge-endpoint", f"{names} does not join {' and '.join(sorted(left)) or 'anything'} with {' and '.join(sorted(right)) or 'anything'}.", rel.start)


def lint_query(model: Model, text: str, file: str = "query") -> list[Diagnostic]:
    """Findings in the order of the text's statements. After a break nothing behind the last `;` is checked."""
    tokens, broken = lex(text)
    linter = _Linter(model, file)
    statements: list[list[Token]] = [[]]
    for t in tokens:
        if t.text == ";":
            statements.append([])
        else:
            statements[-1].append(t)
    if broken is not None:
        linter.say("lint-unreadable", "The text can't be read from here on; what follows the last complete statement is not checked.", broken, "warning")
        statements.pop()
    for s in statements:
        linter.statement(s)
    return linter.out
