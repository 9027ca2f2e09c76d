"""Element ids: derived from names where a file declares none."""

from __future__ import annotations

from .model import Diagnostic, Model

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
PREFIXES = {"node": "n", "edge": "e", "prop": "p", "mixin": "m", "enum": "x", "constraint": "c"}


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    raw, h = text.encode("utf-16-le", "surrogatepass"), 0x811C9DC5
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) & 0xFFFFFFFF
    return h


def derive_id(kind: str, name: str, within: str | None = None, taken: frozenset[str] | set[str] = frozenset()) -> str:
    """A short id that two readings of a file agree on; a number is added while the id is taken."""
    key, salt = f"{kind}:{within + '.' if within is not None else ''}{name}", 0
    while True:
        h, letters = fnv1a(key if not salt else f"{key}#{salt}"), ""
        for _ in range(5):
            h, digit = divmod(h, len(ALPHABET))
            letters += ALPHABET[digit]
        if (found := f"{PREFIXES[kind]}_{letters}") not in taken:
            return found
        salt += 1


def declared_ids(model: Model) -> list[tuple[str, str]]:
    """(id, element) of what the model's own declarations hold, inherited properties left out."""
    out = [(n.id, f"node {n.name}") for n in model.nodes] + [(e.id, f"edge {e.name}") for e in model.edges] + [(m.id, f"mixin {m.name}") for m in model.mixins] + [(x.id, f"enum {x.name}") for x in model.enums]
    for owner in (*model.nodes, *model.edges, *model.mixins):
        out += [(p.id, f"property {owner.name}.{p.name}") for p in owner.props if not p.inherited_from and not p.mixin]
    for n in model.nodes:
        out += [(c.id, f"constraint {n.name}.{c.name}") for c in n.constraints]
    return out


def duplicate_ids(model: Model) -> list[Diagnostic]:
    seen: dict[str, str] = {}
    out = []
    for i, what in declared_ids(model):
        if i and seen.setdefault(i, what) != what:
            out.append(Diagnostic("error", "duplicate-id", f"{what} has the id '{i}' of {seen[i]}.", what))
    return out
