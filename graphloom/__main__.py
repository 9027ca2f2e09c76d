"""python -m graphloom: check, emit, ids, lock, diff, migrate, audit, drift, import, lint-queries, describe and targets.

Findings, violations and errors give exit code 1."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans.diff import CLASSES, at_least, diff_models
from .plans.lint import lint_query
from .plans.resolve import resolve_model
from .plans.views import describe, list_types
from .sinks import TARGETS, emit
from .sources.lockfile import ids_not_written, read_lockfile, write_lockfile
from .sources.model_yaml import serialize_model
from .sources.importers import import_texts


def _say(diagnostics) -> int:
    for d in diagnostics:
        print(f"{d.severity}: {d.code}: {d.message}", file=sys.stderr)
    return int(any(d.severity == "error" for d in diagnostics))


def _tables(folder: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    return spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("check", "ids", "lock", "emit", "diff", "migrate", "audit", "drift", "describe", "lint-queries"):
        p = verbs.add_parser(verb)
        p.add_argument("model")
        if verb in ("diff", "migrate", "lock"):
            p.add_argument("--lockfile", required=True)
        if verb == "diff":
            p.add_argument("--fail-on", choices=CLASSES)
            p.add_argument("--json", action="store_true")
        if verb == "migrate":
            p.add_argument("--allow-destructive", action="store_true")
        if verb == "emit":
            p.add_argument("--target", choices=sorted(TARGETS), required=True)
        if verb in ("audit", "drift"):
            p.add_argument("--tables", required=True, help="folder with a <type or edge table>.parquet for each table")
        if verb == "lint-queries":
            p.add_argument("files", nargs="+")
        if verb == "describe":
            p.add_argument("type", nargs="?")
    imported = verbs.add_parser("import")
    imported.add_argument("files", nargs="+")
    verbs.add_parser("targets")
    a = parser.parse_args(argv)
    if a.verb == "targets":
        print(*sorted(TARGETS), sep="\n")
        return 0
    if a.verb == "import":
        model, said = import_texts({f: Path(f).read_text(encoding="utf-8") for f in a.files})
        print(serialize_model(model), end="")
        return _say(said)
    model, said = resolve_model(a.model)
    if _say(said):
        return 1
    match a.verb:
        case "ids":
            return _say(ids_not_written(model))
        case "lock":
            if code := _say(ids_not_written(model)):
                return code
            path = Path(a.lockfile)
            revision = read_lockfile(path.read_text(encoding="utf-8"))[1] + 1 if path.exists() else 1
            path.write_text(write_lockfile(model, revision), encoding="utf-8")
        case "emit":
            made = emit(model, a.target)
            print(made.content, end="")
            return _say(made.diagnostics)
        case "diff" | "migrate":
            before, revision, wrong = read_lockfile(Path(a.lockfile).read_text(encoding="utf-8"))
            if _say(wrong):
                return 1
            if a.verb == "diff":
                changes = diff_models(before, model)
                print(json.dumps([c.__dict__ for c in changes]) if a.json else "\n".join(f"{c.change_class:11} {c.label}: {c.detail}" for c in changes))
                return int(bool(a.fail_on) and any(at_least(c.change_class, a.fail_on) for c in changes))
            from .operators.migrate import plan_migration

            plan = plan_migration(before, model, revision, a.allow_destructive)
            print("\n".join(f"{s.kind} {s.on} {s.old} {s.new}".rstrip() for s in plan.steps))
            _say(plan.diagnostics)
            if plan.lockfile:
                Path(a.lockfile).write_text(plan.lockfile, encoding="utf-8")
            return int(plan.refused)
        case "describe":
            rows = describe(model, a.type) if a.type else list_types(model)
            print("\n".join(json.dumps(r) for r in rows))
        case "lint-queries":
            return _say([d for f in a.files for d in lint_query(model, Path(f).read_text(encoding="utf-8"), f)])
        case "audit":
            from .operators.audit import audit
            from .operators.graph import PropertyGraph, edge_tables

            spark, read = _tables(a.tables)
            rows = audit(PropertyGraph(model, {n.name: read(n.name) for n in model.concrete()}, {(e, s, t): read(name) for e, s, t, name in edge_tables(model)})).collect()
            print("\n".join(f"{r.violations:10} [{r.code}] {r.label}" for r in rows))
            return int(any(r.violations for r in rows))
        case "drift":
            from .operators.drift import drift
            from .operators.graph import edge_tables

            spark, read = _tables(a.tables)
            names = [n.name for n in model.concrete()] + [x[3] for x in edge_tables(model)]
            rows = drift(spark, model, {n: read(n) for n in names}).collect()
            print("\n".join(f"{r.kind:10} {r.object}: {r.detail}" for r in rows))
            return int(bool(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
