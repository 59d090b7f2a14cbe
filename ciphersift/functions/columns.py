"""Column-level helpers built from built-in functions only (JVM side, inside
whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.catalog import CLASS_SEVERITY, CONFIDENCE_RANK, SEVERITY_RANK
from .regex import GO_SPACE_CLASS


def sql_lit(v) -> str:
    """A Spark SQL literal for a Python str / int / bool / None."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def struct_sql(d: dict) -> str:
    return "named_struct(" + ", ".join(f"{sql_lit(k)}, {sql_lit(v)}" for k, v in d.items()) + ")"


def lit_map(d: dict) -> Column:
    """A literal MAP column: a dimension lookup without a join.  Built from
    one SQL expression (one driver round trip, constant-folded)."""
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.expr("map(" + ", ".join(f"{sql_lit(k)}, {sql_lit(v)}" for k, v in d.items()) + ")")


def lit_struct_map(d: dict) -> Column:
    """MAP<STRING, STRUCT> literal from {key: {field: value}}."""
    return F.expr("map(" + ", ".join(f"{sql_lit(k)}, {struct_sql(v)}" for k, v in d.items()) + ")")


def lit_struct_array(rows: list[dict]) -> Column:
    """ARRAY<STRUCT> literal from a list of {field: value}."""
    return F.expr("array(" + ", ".join(struct_sql(r) for r in rows) + ")")


def lookup(d: dict, key: Column, default=None) -> Column:
    v = F.element_at(lit_map(d), key) if d else F.lit(None)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def go_trim(c: Column) -> Column:
    """strings.TrimSpace: strip Unicode white space at both ends (Spark's
    ``trim`` only strips blanks)."""
    return F.regexp_replace(c, f"^{GO_SPACE_CLASS}+|{GO_SPACE_CLASS}+\\z", "")


def severity_rank(sev: Column) -> Column:
    return F.coalesce(F.element_at(lit_map({k: str(v) for k, v in SEVERITY_RANK.items()}), sev).cast("int"),
                      F.lit(1))


def confidence_rank(conf: Column) -> Column:
    return F.coalesce(F.element_at(lit_map({k: str(v) for k, v in CONFIDENCE_RANK.items()}), conf).cast("int"),
                      F.lit(0))


def class_severity(cls: Column) -> Column:
    return lookup(CLASS_SEVERITY, cls, "info")


def sarif_level(sev: Column) -> Column:
    return (F.when(sev.isin("critical", "high"), "error")
            .when(sev == "medium", "warning").otherwise("note"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def go_base(p: Column) -> Column:
    """filepath.Base: last element after trimming trailing slashes; '' -> '.'"""
    trimmed = F.regexp_replace(p, "/+\\z", "")
    return (F.when(p == "", F.lit("."))
            .when(trimmed == "", F.lit("/"))
            .otherwise(F.substring_index(trimmed, "/", -1)))
