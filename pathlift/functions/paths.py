"""Path algebra.

A path is a row with one nullable column per dimension: a value is a condition, NULL is "any". Conditions never
hold NULL because dimension values are normalised first. This keeps path matching and path extension as plain
column comparisons inside generated code. Dimension names are checked identifiers (see the configuration).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pathlift.config import AttributionConfig

JOINER = " / "
# Names of path depths.
LAYERS = {1: "单维", 2: "二级", 3: "三级"}


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(order: Sequence[str]) -> str:
    """``name=value`` per dimension, NULL for an open one."""
    return ", ".join(f"concat('{d}=', {d})" for d in order)


def canonical_path(dims: Sequence[str]) -> Column:
    return F.expr(f"array_join(array_sort(array_compact(array({texts(dims)}))), '{JOINER}')")


def display_path(order: Sequence[str]) -> Column:
    return F.expr(f"concat_ws('{JOINER}', {texts(order)})")


def path_depth(dims: Sequence[str]) -> Column:
    return F.expr(" + ".join(f"int({d} is not null)" for d in dims))


def record_id(canonical: Column) -> Column:
    return F.substring(F.sha1(canonical.cast("binary")), 1, 12)


def conditions(order: Sequence[str], cfg: AttributionConfig) -> Column:
    """Array of (field, value, label) in the given order."""
    parts = ", ".join(
        f"if({d} is null, null, named_struct('field', '{d}', 'value', {d}, "
        f"'label', {quoted(cfg.field_labels.get(d, d))}))"
        for d in order
    )
    return F.expr(f"array_compact(array({parts}))")


def layer_name(depth: str) -> Column:
    cases = " ".join(f"when {n} then '{name}'" for n, name in LAYERS.items())
    return F.expr(f"case {depth} {cases} else concat({depth}, '维') end")


def from_conditions(conds: str, dims: Sequence[str]) -> dict[str, Column]:
    """Path columns out of an array of (field, value, ...) structs; missing values normalised."""
    from pathlift.functions.scalars import normalize_value

    out = {}
    for d in dims:
        hit = F.expr(f"get(filter({conds}, c -> c.field = '{d}'), 0)")
        out[d] = F.when(hit.isNotNull(), normalize_value(hit["value"]))
    return out


def matches(dims: Sequence[str], row: str = "", path: str = "_s_") -> Column:
    """True where a fact row lies on a path: every condition equal, open dimensions ignored."""
    return F.expr(" and ".join(f"({path}{d} is null or {row}{d} = {path}{d})" for d in dims))


def from_canonical(path: str, dims: Sequence[str]) -> dict[str, Column]:
    """Path columns out of canonical (or display) path text."""
    out = {}
    for d in dims:
        hit = f"get(filter(split({path}, '{JOINER}'), x -> startswith(x, '{d}=')), 0)"
        out[d] = F.expr(f"substring({hit}, {len(d) + 2})")
    return out
