"""One way in for all formats, plugins among them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from ..plans.model import Diagnostic, Model
from .ladybug_ddl import import_ladybug
from .notes import import_notes
from .sql_ddl import detect_format, import_sql
from .turtle import import_turtle

Importer = Callable[[str], tuple[Model, list[Diagnostic]]]
IMPORTERS: dict[str, Importer] = {"sql": import_sql, "turtle": import_turtle, "ladybug": import_ladybug, "notes": import_notes}
BUILT_IN = frozenset(IMPORTERS)
EXTENSIONS: dict[str, str] = {}


def register_importer(name: str, importer: Importer, extensions: tuple[str, ...] = ()) -> None:
    if name in BUILT_IN:
        raise ValueError(f"'{name}' is built in")
    IMPORTERS[name] = importer
    EXTENSIONS.update(dict.fromkeys(extensions, name))


def import_texts(files: dict[str, str], kind: str | None = None) -> tuple[Model, list[Diagnostic]]:
    """The model of files of one format; a script of tables may come with Turtle, whose datatypes it then refines."""
    formats = {f: kind or next((n for e, n in EXTENSIONS.items() if f.endswith(e)), None) or detect_format(f, t) for f, t in files.items()}
    if unknown := [f for f, k in formats.items() if k not in IMPORTERS]:
        return Model(), [Diagnostic("error", "import-format", f"The format of {', '.join(unknown)} is not known.")]
    together = {k: "\n".join(t for f, t in files.items() if formats[f] == k) for k in sorted(set(formats.values()))}
    if len(together) > 1 and set(together) != {"turtle", "ladybug"}:
        return Model(), [Diagnostic("error", "import-mixed", f"{', '.join(together)} can't be read as one model.")]
    if len(together) == 1:
        k, text = next(iter(together.items()))
        return IMPORTERS[k](text)
    (base, said), (tables, more) = import_turtle(together["turtle"]), import_ladybug(together["ladybug"])
    refined = lambda n: replace(n, key=n.key or (t.key if (t := tables.node(n.name)) else ()), props=tuple(replace(p, type=q.type) if (t := tables.node(n.name)) and (q := t.prop(p.name)) else p for p in n.props))
    return replace(base, nodes=tuple(map(refined, base.nodes))), said + more
