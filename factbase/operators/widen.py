"""Attribute-value rows into wide rows with typed columns, by combineByKey over per-entity slot registers."""

from __future__ import annotations

import re
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, functions as F, types as T

from .shared import cut

# The forms of the value types.
FORMS = {
    "bigint": r"[+-]?[0-9]+",
    "int": r"[+-]?[0-9]+",
    "double": r"[+-]?[0-9]+(\.[0-9]+)?(e[+-]?[0-9]+)?",
    "decimal": r"[+-]?[0-9]+(\.[0-9]{1,2})?",
    "boolean": r"true|false",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "instant": r"[0-9]{4}-[0-9]{2}-[0-9]{2}t[0-9]{2}:[0-9]{2}:[0-9]{2}z",
    "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
}
TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "decimal": T.DecimalType(38, 2), "boolean": T.BooleanType(), "date": T.DateType(), "instant": T.TimestampType()}
COMPILED = {k: re.compile(x) for k, x in FORMS.items()}


def encoded(kind: str, text: str):
    """(whether ``text`` is of the type, its value). Blanks around and letter case don't matter, except in strings.

    A decimal of more than 36 whole digits, which decimal(38,2) can't hold, is of its type but has no usable value. Types without a form (string, ref)
    take any text as it stands.
    """
    if kind not in COMPILED:
        return True, text
    s = text.strip().lower()
    if not COMPILED[kind].fullmatch(s):
        return False, None
    if kind in ("bigint", "int"):
        digits = s.lstrip("+-").lstrip("0") or "0"
        n = int(("-" if s[0] == "-" else "") + digits) if len(digits) <= 19 else 1 << 64
        half = 1 << (63 if kind == "bigint" else 31)
        return (True, n) if -half <= n < half else (False, None)
    if kind == "double":
        return True, float(s)
    if kind == "decimal":
        return True, Decimal(s) if len(s.lstrip("+-").partition(".")[0].lstrip("0")) <= 36 else None
    if kind == "boolean":
        return True, s == "true"
    if kind == "uuid":
        return True, s
    try:
        return (True, date.fromisoformat(s)) if kind == "date" else (True, datetime.strptime(s, "%Y-%m-%dt%H:%M:%Sz").replace(tzinfo=timezone.utc))
    except ValueError:
        return False, None


class Slots:
    """The columns of some classes: one slot for each attribute that the schema gives them.

    A schema is metadata and small; its rows without attr, cls or field make no slot, and of repeated attributes the
    first in order counts.
    """

    def __init__(self, schema: DataFrame, classes: list[str]):
        rows = schema.filter(F.col("cls").isin(classes) & F.col("attr").isNotNull() & F.col("field").isNotNull()).select("attr", "cls", "field", "value_type", "cardinality").orderBy("attr", "field", "value_type", "cardinality").collect()
        seen = {r.attr: r for r in reversed(rows)}
        self.attrs = sorted(seen)
        self.classes = sorted(classes)
        self.columns = [f"{seen[a].cls}_{seen[a].field}" for a in self.attrs]
        self.cls = [self.classes.index(seen[a].cls) for a in self.attrs]
        self.kinds = [(seen[a].value_type or "string").strip().lower() for a in self.attrs]
        self.many = [(seen[a].cardinality or "one").strip().lower() == "many" for a in self.attrs]

    def schema(self) -> T.StructType:
        kind = lambda i: T.ArrayType(self.type(i)) if self.many[i] else self.type(i)
        fixed = [T.StructField("e", T.LongType()), T.StructField("cls", T.StringType()), T.StructField("unusable", T.ArrayType(T.StringType()))]
        return T.StructType(fixed + [T.StructField(c, kind(i)) for i, c in enumerate(self.columns)])

    def type(self, i: int) -> T.DataType:
        return TYPES.get(self.kinds[i], T.StringType())


def create(cell):
    """A cell: (slot, transaction, place in it, whether the value was retracted later, value); many: those that hold."""
    slot, *rest, many = cell
    return {slot: [rest[3]] if many and not rest[2] else [] if many else tuple(rest)}


def merge_value(register, cell):
    slot, t, s, dead, v, many = cell
    if many:
        if not dead:
            register.setdefault(slot, []).append(v)
    elif slot not in register or register[slot] < (t, s, dead, v):
        register[slot] = (t, s, dead, v)
    return register


def merge_registers(a, b):
    for slot, x in b.items():
        if slot not in a:
            a[slot] = x
        elif isinstance(x, list):
            a[slot].extend(x)
        elif a[slot] < x:
            a[slot] = x
    return a


def emitter(slots: Slots):
    columns, kinds, many, attrs, classes, width = slots.columns, slots.kinds, slots.many, slots.attrs, slots.classes, len(slots.columns)

    def emit(pair):
        (c, e), register = pair
        row, bad, some = [None] * width, [], False
        for slot, x in register.items():
            if many[slot]:
                values = []
                for v in sorted(x):
                    good, value = encoded(kinds[slot], v)
                    some = True
                    values.append(value) if good and value is not None else None
                    if not good and attrs[slot] not in bad:
                        bad.append(attrs[slot])
                row[slot] = values or None
            elif not x[2]:
                some = True
                good, row[slot] = encoded(kinds[slot], x[3])
                if not good:
                    bad.append(attrs[slot])
        return [(e, classes[c], sorted(bad), *row)] if some else []

    return emit


def widen(state: DataFrame, schema: DataFrame, classes: list[str]) -> DataFrame:
    """One row per entity and class: e, cls, unusable (attributes with a live value not of their type) and a typed column for each field.

    state: (e, a, v, la, lr) as of ``fact_state``, of the whole feed. Columns are named class_field. A column is null
    where the entity has no usable value; a field of cardinality many is an array in order of its text. Attributes
    without a schema row have no column, and an entity with no live value in a class has no row of it.

    The cells of an entity meet in one register by an associative merge (the later assert wins), on the map side first,
    so an entity sends at most one register a task however many rows it has. An entity's array of many values is the
    only thing that grows with its facts, as the result does.
    """
    spark, slots = state.sparkSession, Slots(schema, classes)
    if not slots.attrs:
        return spark.createDataFrame([], slots.schema())
    number = F.create_map(*[x for i, a in enumerate(slots.attrs) for x in (F.lit(a), F.lit(i))])
    cells = state.filter(F.col("a").isin(slots.attrs) & F.col("la").isNotNull()).select(
        "e", number[F.col("a")].alias("slot"), F.expr("cast(la div 2147483648 as bigint)").alias("t"), F.expr("cast(la % 2147483648 as bigint)").alias("s"), F.coalesce(F.col("lr") > F.col("la"), F.lit(False)).alias("dead"), "v"
    )
    cls, many = slots.cls, slots.many
    # the aggregate ends here: Python tasks that are lost start again from the shared folder
    pairs = cut(cells).rdd.map(lambda r: ((cls[r[1]], r[0]), (r[1], r[2], r[3], r[4], r[5], many[r[1]])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    registers = pairs.combineByKey(create, merge_value, merge_registers, parts)
    return spark.createDataFrame(registers.flatMap(emitter(slots)), slots.schema(), verifySchema=False)
