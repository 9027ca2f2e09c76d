"""Property types: their spellings, the composite grammar and their Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

#: Canonical scalars and the spellings that mean them, compared in upper case with `_` read as a blank (fixed values).
SCALARS = {
    "string": ("STRING",),
    "int8": ("INT8", "TINYINT"),
    "int16": ("INT16", "SMALLINT"),
    "int32": ("INT32",),
    "int": ("INT", "INTEGER", "INT64", "BIGINT"),
    "int128": ("INT128", "HUGEINT"),
    "uint8": ("UINT8",),
    "uint16": ("UINT16",),
    "uint32": ("UINT32",),
    "uint64": ("UINT64",),
    "float32": ("FLOAT32", "REAL"),
    "float": ("FLOAT", "FLOAT64", "DOUBLE"),
    "decimal": ("DECIMAL", "NUMERIC"),
    "boolean": ("BOOL", "BOOLEAN"),
    "date": ("DATE",),
    "datetime": ("DATETIME", "TIMESTAMP", "LOCAL DATETIME"),
    "zoneddatetime": ("ZONEDDATETIME", "ZONED DATETIME", "TIMESTAMP TZ", "TIMESTAMPTZ"),
    "duration": ("DURATION", "INTERVAL"),
    "uuid": ("UUID",),
    "blob": ("BLOB", "BYTES", "BINARY"),
    "json": ("JSON",),
}
ALIASES = {spelling: name for name, spellings in SCALARS.items() for spelling in spellings}
NUMERIC = {"int8", "int16", "int32", "int", "int128", "uint8", "uint16", "uint32", "uint64", "float32", "float", "decimal"}
ORDERED = NUMERIC | {"date", "datetime", "zoneddatetime", "duration"}
TEXT = {"string"}
#: Largest values of the unsigned widths, which Spark holds in the next wider signed type.
UNSIGNED_MAX = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
DEFAULT_DECIMAL = (18, 3)
MONTHS_AND_TIME = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])


@dataclass(frozen=True)
class ValueType:
    """A type: kind is scalar, list, array, struct, map or union."""

    kind: str
    name: str = ""
    precision: int | None = None
    scale: int | None = None
    size: int | None = None
    parts: tuple[tuple[str, ValueType], ...] = ()

    @property
    def item(self) -> ValueType:
        return self.parts[0][1]

    def __str__(self) -> str:
        match self.kind:
            case "scalar":
                return self.name if self.precision is None else f"{self.name}({self.precision},{self.scale})"
            case "list":
                return f"{self.item}[]"
            case "array":
                return f"{self.item}[{self.size}]"
            case "map":
                return f"map({self.parts[0][1]}, {self.parts[1][1]})"
            case _:
                return f"{self.kind}({', '.join(f'{n} {t}' for n, t in self.parts)})"


def scalar_name(written: str) -> str | None:
    return ALIASES.get(" ".join(written.replace("_", " ").split()).upper())


def parse_type(text: str) -> ValueType | None:
    """The type that a text spells, or None.

    Grammar: base { '[' [n] ']' | NOT NULL }; base is LIST<t>, ARRAY<t, n>, STRUCT(f t, ...), MAP(t, t), UNION(m t, ...) or
    a scalar's spelling, of which decimal takes (precision[, scale])."""
    tokens = re.findall(r"\w+|[\[\]<>(),]|\S", text)
    at = 0

    def peek() -> str:
        return tokens[at].upper() if at < len(tokens) else ""

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (expected and tokens[at] != expected):
            raise ValueError(expected)
        at += 1
        return tokens[at - 1]

    def fields() -> tuple[tuple[str, ValueType], ...]:
        take("(")
        out = [(take(), whole())]
        while peek() == ",":
            take()
            out.append((take(), whole()))
        take(")")
        return tuple(out)

    def base() -> ValueType:
        word, follows = peek(), tokens[at + 1] if at + 1 < len(tokens) else ""
        if word in ("LIST", "ARRAY") and follows == "<":
            take(), take()
            item, size = whole(), None
            if word == "ARRAY":
                take(",")
                size = int(take())
            take(">")
            return ValueType("array" if word == "ARRAY" else "list", size=size, parts=(("", item),))
        if word in ("STRUCT", "UNION") and follows == "(":
            take()
            return ValueType(word.lower(), parts=fields())
        if word == "MAP" and follows == "(":
            take(), take()
            key = whole()
            take(",")
            value = whole()
            take(")")
            return ValueType("map", parts=(("key", key), ("value", value)))
        for n in (2, 1):  # the longest spelling wins
            name = scalar_name(" ".join(tokens[at : at + n]))
            if name and len(tokens[at : at + n]) == n:
                for _ in range(n):
                    take()
                if name == "decimal" and peek() == "(":
                    take()
                    precision, scale = int(take()), 0
                    if peek() == ",":
                        take()
                        scale = int(take())
                    take(")")
                    return ValueType("scalar", name, precision, scale)
                return ValueType("scalar", name)
        raise ValueError(word)

    def whole() -> ValueType:
        found = base()
        while True:
            if peek() == "NOT" and at + 1 < len(tokens) and tokens[at + 1].upper() == "NULL":
                take(), take()
            elif peek() == "[":
                take()
                size = None if peek() == "]" else int(take())
                take("]")
                found = ValueType("list" if size is None else "array", size=size, parts=(("", found),))
            else:
                return found

    try:
        result = whole()
    except (ValueError, IndexError):
        return None
    return result if at == len(tokens) else None


def spark_type(t: ValueType) -> T.DataType:
    """The Spark type of a value. Unions are structs of nullable members with a `tag`; int128 is narrowed to 38 digits."""
    match t.kind:
        case "list" | "array":
            return T.ArrayType(spark_type(t.item))
        case "map":
            return T.MapType(spark_type(t.parts[0][1]), spark_type(t.parts[1][1]))
        case "struct":
            return T.StructType([T.StructField(n, spark_type(x)) for n, x in t.parts])
        case "union":
            return T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(n, spark_type(x)) for n, x in t.parts)])
    plain = {
        "string": T.StringType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int": T.LongType(), "int128": T.DecimalType(38, 0),
        "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float": T.DoubleType(),
        "boolean": T.BooleanType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "zoneddatetime": T.TimestampType(), "duration": MONTHS_AND_TIME,
        "uuid": T.StringType(), "blob": T.BinaryType(), "json": T.StringType(),
    }
    return T.DecimalType(*((t.precision, t.scale) if t.precision is not None else DEFAULT_DECIMAL)) if t.name == "decimal" else plain[t.name]


def model_type(t: T.DataType) -> ValueType:
    """The model type of a Spark type; the inverse of spark_type where that loses nothing."""
    scalar = lambda name: ValueType("scalar", name)
    if isinstance(t, T.ArrayType):
        return ValueType("list", parts=(("", model_type(t.elementType)),))
    if isinstance(t, T.MapType):
        return ValueType("map", parts=(("key", model_type(t.keyType)), ("value", model_type(t.valueType))))
    if isinstance(t, T.StructType):
        if t == MONTHS_AND_TIME:
            return scalar("duration")
        return ValueType("struct", parts=tuple((f.name, model_type(f.dataType)) for f in t.fields))
    if isinstance(t, T.DecimalType):
        return ValueType("scalar", "decimal", t.precision, t.scale)
    names = {
        T.StringType: "string", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int", T.FloatType: "float32", T.DoubleType: "float",
        T.BooleanType: "boolean", T.DateType: "date", T.TimestampNTZType: "datetime", T.TimestampType: "zoneddatetime", T.BinaryType: "blob", T.DayTimeIntervalType: "duration",
    }
    return scalar(next((n for k, n in names.items() if isinstance(t, k)), "json"))
