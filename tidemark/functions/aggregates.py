"""The five aggregates over kinds of columns, exact and with Spark's partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import SchemaError

_DEC = "decimal(38,6)"


def _number(c: dict[str, Column]) -> Column:
    parts = [c[k].cast(_DEC) for k in ("i", "d") if k in c]
    return F.coalesce(*parts) if parts else F.lit(None).cast(_DEC)


def _guard(c: dict[str, Column], func: str, out: Column, kind: str) -> Column:
    """An error if the rows hold a text or blob; a column of that kind without such rows is fine."""
    wrong = [F.count(c[k]) for k in ("t", "b") if k in c]
    if not wrong:
        return out
    return F.when(sum(wrong[1:], wrong[0]) > 0, F.raise_error(F.lit(f"{func.upper()} of a value that is not a number")).cast(kind)).otherwise(out)


def aggregate(func: str, c: dict[str, Column] | None, row_id: Column | None) -> dict[str, Column]:
    """Kinds of the result, as aggregate expressions."""
    if func == "count":
        return {"i": F.count(F.lit(1)) if c is None else F.count(_any(c))}
    if c is None:
        raise SchemaError(f"{func.upper()} needs a column")
    if func == "sum":
        out: dict[str, Column] = {}
        if "i" in c or "d" not in c:
            whole = F.sum(c["i"].cast("decimal(19,0)")) if "i" in c else F.lit(None).cast("decimal(29,0)")
            fits = F.when(whole.between(F.lit(str(-(1 << 63))).cast("decimal(29,0)"), F.lit(str((1 << 63) - 1)).cast("decimal(29,0)")) | whole.isNull(), whole.cast("long"))
            fits = fits.otherwise(F.raise_error(F.lit("SUM overflows a 64-bit integer")).cast("long"))
            out["i"] = _guard(c, func, F.when(F.count(c["d"]) == 0, fits) if "d" in c else fits, "long")
        if "d" in c:
            total = F.sum(_number(c)).cast(_DEC)
            over = F.when(total.isNull() & (F.count(_number(c)) > 0), F.raise_error(F.lit("SUM overflows a decimal")).cast(_DEC)).otherwise(total)
            out["d"] = _guard(c, func, F.when(F.count(c["d"]) > 0, over) if "i" in c else over, _DEC)
        return out
    if func == "avg":
        number = _number(c)
        # Division rounds half away from zero at scale 6, once; avg() would round twice.
        mean = (F.sum(number).cast(_DEC) / F.count(number).cast("decimal(20,0)")).cast(_DEC)
        return {"d": _guard(c, func, F.when(F.count(number) > 0, mean), _DEC)}
    if len(c) == 1:
        (k, x), = c.items()
        return {k: F.min(x) if func == "min" else F.max(x)}
    # Numbers by magnitude before texts before blobs; of equal magnitudes the first row's value.
    least = func == "min"
    seen = row_id if row_id is not None else F.lit(0).cast("long")
    group = F.when(_number(c).isNotNull(), 1)
    for k, r in (("t", 2), ("b", 3)):
        if k in c:
            group = group.when(c[k].isNotNull(), r)
    key = F.when(_any(c).isNotNull(), F.struct(group.alias("g"), _number(c).alias("n"), *[c[k].alias(k) for k in ("t", "b") if k in c], (seen if least else -seen).alias("r")))
    value = F.struct(*[x.alias(k) for k, x in c.items()])
    best = F.min_by(value, key) if least else F.max_by(value, key)
    return {k: best[k] for k in c}


def _any(c: dict[str, Column]) -> Column:
    """Not null where any kind is set."""
    if len(c) == 1:
        return next(iter(c.values()))
    return F.when(sum([x.isNotNull().cast("int") for x in c.values()], F.lit(0)) > 0, F.lit(1))
