"""Next revisions of the warehouse model, one for each kind of change, and SQL that works out their changes and reach."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from pathlib import Path

import yaml

from ..plans.model import Model
from ..plans.resolve import model_of
from . import warehouse


def _prop(w: dict, node: str, name: str) -> dict:
    return w["nodes"][node]["props"][name]


def _take(d: dict, old: str, new: str) -> None:
    """Rename a key in place of the old one."""
    items = [(new if k == old else k, v) for k, v in d.items()]
    d.clear()
    d.update(items)


def _drop_parts(w: dict) -> None:
    del w["nodes"]["Part"], w["edges"]["OF_PART"]


def _mixin_to_parent(w: dict) -> None:
    for name in ("Customer", "Supplier"):
        w["nodes"][name].pop("mixins")
    w["nodes"]["Party"]["mixins"] = ["Noted"]


def _noted(w: dict) -> None:
    """The revision before a mixin moves up: both parties have it."""
    w["mixins"] = {"Noted": {"id": "m_not", "props": {"remark": {"id": "p_rmk", "type": "string"}}}}
    for name in ("Customer", "Supplier"):
        w["nodes"][name]["mixins"] = ["Noted"]


def _balance_to_party(w: dict) -> None:
    w["nodes"]["Party"]["props"] = {"c_acctbal": w["nodes"]["Customer"]["props"].pop("c_acctbal")}


SELECT = "SELECT '{}' AS \"class\", '{}' AS label, '{}' AS detail, CAST({} AS BIGINT) AS affected, CAST({} AS BIGINT) AS broken"


def rows(*changes: tuple[str, ...]) -> str:
    """The changes (class, label, detail, affected, broken); all that is removed is lost, and where nothing is said nothing breaks."""
    return " UNION ALL ".join(SELECT.format(a, b, c.replace("'", "''"), n, *(wrong or [n if c == "removed" else "0"])) for a, b, c, n, *wrong in changes)


def n(what: str, table: str) -> str:
    return f"(SELECT count({what}) FROM {table})"


def where(table: str, condition: str) -> str:
    return f"(SELECT count(*) FROM {table} WHERE {condition})"


def shared(table: str, columns: str) -> str:
    """Rows that share the columns' values with another row; null is no value."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(", "))
    return f"(SELECT coalesce(sum(k), 0) FROM (SELECT count(*) AS k FROM {table} WHERE {whole} GROUP BY {columns} HAVING count(*) > 1))"


def lines(condition: str) -> str:
    """Parts by their number of lines."""
    return f"(SELECT count(*) FROM (SELECT p_partkey, count(l_partkey) AS k FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey) WHERE {condition})"


#: Each edit: what it does to the model, and its changes with the rows or values that each concerns.
EDITS: dict[str, tuple[Callable[[dict], object], str]] = {
    "add_enum_value": (lambda w: w["enums"]["Segment"]["values"].append("FURNITURE"), rows(("additive", "enum Segment", "values added: FURNITURE", n("c_mktsegment", "customer")))),
    "add_enum": (lambda w: w["enums"].update(Flag={"id": "x_flg", "values": ["A", "N", "R"]}), rows(("additive", "enum Flag", "added with values A, N, R", "0"))),
    "add_node_type": (lambda w: w["nodes"].update(Depot={"id": "n_dep", "key": ["d_code"], "props": {"d_code": {"id": "p_dc", "type": "string", "required": True}}}), rows(("additive", "node Depot", "added", "0"), ("additive", "property Depot.d_code", "added as string, required", "0"))),
    "add_optional_property": (lambda w: w["nodes"]["Party"].update(props={"remark": {"id": "p_rem", "type": "string"}}), rows(("additive", "property Party.remark", "added as string", n("*", "customer") + " + " + n("*", "supplier")))),
    "add_required_property": (lambda w: w["nodes"]["Part"]["props"].update(p_origin={"id": "p_por", "type": "int", "required": True}), rows(("breaking", "property Part.p_origin", "added as int, required", n("*", "part"), n("*", "part")))),
    "add_subtype": (lambda w: w["nodes"].update(Carrier={"id": "n_car", "extends": "Party", "key": ["k"], "props": {"k": {"id": "p_cark", "type": "int"}}}), rows(("additive", "node Carrier", "added", "0"), ("additive", "property Carrier.k", "added as int", "0"))),
    "add_unique": (lambda w: _prop(w, "Customer", "c_name").update(unique=True), rows(("breaking", "property Customer.c_name", "became unique", n("c_name", "customer"), shared("customer", "c_name")))),
    "change_cardinality": (lambda w: w["edges"]["IN_REGION"].update(cardinality="many-to-many"), rows(("additive", "edge IN_REGION", "cardinality changed from many-to-one to many-to-many", n("n_regionkey", "nation")))),
    "change_endpoints": (lambda w: w["edges"]["SUPPLIED_BY"].update({"from": "Part"}), rows(("breaking", "edge SUPPLIED_BY", "endpoints changed from (LineItem)->(Supplier) to (Part)->(Supplier)", n("l_suppkey", "lineitem"), n("l_suppkey", "lineitem")))),
    "change_key": (lambda w: w["nodes"]["Part"].update(key=["p_partkey", "p_brand"]), rows(("breaking", "node Part", "key changed from (p_partkey) to (p_partkey, p_brand)", n("*", "part"), shared("part", "p_partkey, p_brand") + " + " + where("part", "p_partkey IS NULL OR p_brand IS NULL")))),
    "drop_uniqueness": (lambda w: _prop(w, "Region", "r_name").pop("unique"), rows(("additive", "property Region.r_name", "no longer unique", n("r_name", "region")))),
    "make_required": (lambda w: _prop(w, "Label", "toxic").update(required=True), rows(("breaking", "property Label.toxic", "became required", n("toxic", "labels"), where("labels", "toxic IS NULL")))),
    "mixin_on_parent": (_mixin_to_parent, rows(("additive", "node Customer", "mixins changed from [Noted] to []", n("*", "customer")), ("additive", "node Party", "mixins changed from [] to [Noted]", n("*", "customer") + " + " + n("*", "supplier")), ("additive", "node Supplier", "mixins changed from [Noted] to []", n("*", "supplier")))),
    "move_to_ancestor": (_balance_to_party, rows(("additive", "property Party.c_acctbal", "moved from Customer", n("c_acctbal", "customer")))),
    "remove_enum_value": (lambda w: w["enums"]["OrderStatus"]["values"].remove("P"), rows(("destructive", "enum OrderStatus", "values removed: P", n("o_orderstatus", "orders"), where("orders", "o_orderstatus = 'P'")))),
    "remove_node_type": (_drop_parts, rows(*(("destructive", f"property Part.{c}", "removed", n(c, "part")) for c in ("p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type")), ("destructive", "node Part", "removed", n("*", "part")), ("destructive", "edge OF_PART", "removed", n("l_partkey", "lineitem")))),
    "remove_property": (lambda w: w["nodes"]["Event"]["props"].pop("value"), rows(("destructive", "property Event.value", "removed", n("value", "events")))),
    "rename_edge": (lambda w: _take(w["edges"], "LABELLED", "JUDGED"), rows(("breaking", "edge JUDGED", "renamed from 'LABELLED'", n("doc_id", "documents")))),
    "rename_node_type": (lambda w: _take(w["nodes"], "Event", "Click"), rows(("breaking", "node Click", "renamed from 'Event'", n("*", "events")))),
    "rename_property": (lambda w: _take(w["nodes"]["Event"]["props"], "event_type", "kind"), rows(("breaking", "property Event.kind", "renamed from 'event_type'", n("event_type", "events")))),
    "replace_id": (lambda w: _prop(w, "Part", "p_type").update(id="p_pt2"), rows(("destructive", "property Part.p_type", "removed", n("p_type", "part")), ("additive", "property Part.p_type", "added as string", n("*", "part")))),
    "retype_property": (lambda w: _prop(w, "Part", "p_size").update(type="string") or [_prop(w, "Part", "p_size").pop(k) for k in ("min", "max")], rows(("breaking", "property Part.p_size", "type changed from int32 to string", n("p_size", "part"), where("part", "p_size IS NOT NULL AND CAST(p_size AS VARCHAR) IS NULL")), ("additive", "property Part.p_size", "min removed: 1", n("p_size", "part")), ("additive", "property Part.p_size", "max removed: 50", n("p_size", "part")))),
    "value_pattern": (lambda w: _prop(w, "Supplier", "s_name").update(pattern="^Supplier"), rows(("breaking", "property Supplier.s_name", "pattern added: ^Supplier", n("s_name", "supplier"), where("supplier", "NOT regexp_matches(s_name, '^Supplier')")))),
    "retype_lossy": (lambda w: _prop(w, "Part", "p_brand").update(type="int"), rows(("breaking", "property Part.p_brand", "type changed from string to int", n("p_brand", "part"), where("part", "p_brand IS NOT NULL AND TRY_CAST(p_brand AS BIGINT) IS NULL")))),
    "tighten_range": (lambda w: _prop(w, "Customer", "c_acctbal").update(max=5000), rows(("breaking", "property Customer.c_acctbal", "max changed from 9000 to 5000", n("c_acctbal", "customer"), where("customer", "c_acctbal > 5000 AND c_acctbal <= 9000")))),
    "tighten_length": (lambda w: _prop(w, "Document", "text").update(minLength=200), rows(("breaking", "property Document.text", "minLength changed from 20 to 200", n("text", "documents"), where("documents", "length(text) >= 20 AND length(text) < 200")))),
    "tighten_cardinality": (lambda w: w["edges"]["OF_PART"]["cardinality"].update({"from": "0..25"}), rows(("breaking", "edge OF_PART", "cardinality changed from from 0..40 to 1 to from 0..25 to 1", n("l_partkey", "lineitem"), lines("k > 25 AND k <= 40")))),
    "add_assertion": (lambda w: w["nodes"]["LineItem"]["constraints"].append({"id": "c_qtx", "name": "taxBelowDiscount", "assert": {"lessThan": ["l_tax", "l_discount"]}}), rows(("breaking", "constraint LineItem.taxBelowDiscount", "added", "0", where("lineitem", "NOT l_tax < l_discount")))),
}
#: What the older revision has besides the warehouse model.
FIRST: dict[str, Callable[[dict], object]] = {"mixin_on_parent": _noted}


def _model(w: dict) -> Model:
    return model_of(yaml.safe_dump(w, sort_keys=False))


@cache
def revisions(name: str) -> tuple[Model, Model]:
    """The model before and after an edit."""
    w = yaml.safe_load(Path(warehouse.__file__).with_name("warehouse.yaml").read_text(encoding="utf-8"))
    if name in FIRST:
        FIRST[name](w)
    before = _model(w)
    EDITS[name][0](w)
    return before, _model(w)
