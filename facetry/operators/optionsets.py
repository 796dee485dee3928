"""Long option sets as relations: a criterion over thousands of options is a join, and its plan stays of one size.

Options are numbered and become one frame for each variant that a value may be in, typed like the variant's column.  "Any
of" is a semi-join (or a mark, where absence or several variants take part), "all of" counts the distinct options that an
item's values meet.  Options that no variant can take match nothing and never fail."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value, moment, tier
from ..shapes import IRI, Dictionary, Embedded, Range

#: Options up to which a criterion is a plain condition, and values up to which it is a list that scans take.
INLINE, LISTED = 16, 1000
#: Bytes of options, counted on the driver that they come from, up to which they are sent to all tasks.
BROADCAST_BYTES = 8 << 20


def constant(kind: T.DataType, r: Range, option: Any) -> Any:
    """An option as a plain value of a column's type; None if it is of another one.  Moments are ISO text."""
    if option is None or isinstance(option, dict | list) or isinstance(r, Embedded):
        return None
    number = isinstance(option, int | float | Decimal) and not isinstance(option, bool)
    match kind:
        case T.BooleanType():
            return option if isinstance(option, bool) else None
        case T.IntegralType():
            if tier(r) == IRI and isinstance(option, str) and option.lstrip("-").isdigit():
                option, number = int(option), True
            whole = number and option == option and abs(option) < 1 << 63 and option == int(option)
            return int(option) if whole else None
        case T.DoubleType() | T.FloatType() | T.DecimalType():
            return float(option) if number else None
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            own = moment(r, option) if isinstance(option, str | dt.date | dt.datetime) else None
            return None if own is None else own.isoformat()
        case T.StringType():
            return option if isinstance(option, str) else str(option) if tier(r) == IRI and not isinstance(option, bool) else None
    return None


def tagged_options(given: Sequence[Any]) -> list[tuple[int, str, str]]:
    """(number, tag, text) of the options that name a language."""
    out = []
    for k, option in enumerate(given):
        for tag, texts in option.items() if isinstance(option, dict) else ():
            out += [(k, tag, x) for x in (texts if isinstance(texts, list | tuple) else [texts])]
    return out


class OptionSet:
    """The options of one criterion, numbered; `null`: absence is one of them."""

    def __init__(self, spark: SparkSession, own: Sequence[Any], name: str):
        self.spark, self.name = spark, name
        self.null, self.given = any(o is None for o in own), [o for o in own if o is not None]
        self._count = 0

    def _fresh(self) -> str:
        self._count += 1
        return f"{self.name}o{self._count}"

    def _frame(self, rows: list[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> DataFrame:
        table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * len(names), kinds)], names=list(names))
        df = self.spark.createDataFrame(table)
        return F.broadcast(df) if table.nbytes <= BROADCAST_BYTES else df

    def values(self, df: DataFrame, r: Range, c: Column, numbered: bool = False) -> tuple[DataFrame, Column, list[Any]] | None:
        """(frame of the options that a variant can take, the condition under which its column meets one, their values)."""
        kind = df.select(c).schema[0].dataType
        found = [(k, x) for k, x in ((k, constant(kind, r, o)) for k, o in enumerate(self.given)) if x is not None]
        if not found:
            return None
        if not numbered:
            found = [(0, x) for x in dict.fromkeys(x for _, x in found)]
        o = self._fresh()
        arrow = pa.bool_() if isinstance(kind, T.BooleanType) else pa.int64() if isinstance(kind, T.IntegralType) else pa.float64() if isinstance(kind, T.NumericType) else pa.string()
        own = self._frame(found, (f"{o}k", o), (pa.int64(), arrow))
        if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            own = own.withColumn(o, F.col(o).cast(kind))
        own = own if numbered else own.drop(f"{o}k")
        return own, (c.cast("double") if isinstance(kind, T.DecimalType) else c) == F.col(o), [x for _, x in found]

    def _tags(self, v: Value) -> list[tuple[Dictionary, Column]]:
        return [(r, m) for (r, _), m in zip(v.parts, v.maps or (None,) * len(v.parts)) if isinstance(r, Dictionary) and m is not None]

    # --- any of

    def any_of(self, df: DataFrame, v: Value) -> DataFrame:
        """The rows whose value is one of the options."""
        tagged = tagged_options(self.given) if self._tags(v) else []
        if len(v.parts) == 1 and not self.null and not tagged:
            own = self.values(df, *v.parts[0])
            if own is None:
                return df.where(F.lit(False))
            options, on, values = own
            # bounds reach the scan, whatever the join will be
            c = v.parts[0][1]
            if not isinstance(values[0], bool):
                low, high = (F.lit(x).cast(options.schema[-1].dataType) for x in (min(values), max(values)))
                df = df.where((c >= low) & (c <= high))
            return df.join(options, on, "left_semi")
        df, mark = self.marked(df, v)
        return df.where(mark).drop(mark)

    def marked(self, df: DataFrame, v: Value) -> tuple[DataFrame, Column]:
        """The frame with a column that tells whether a row's value is one of the options."""
        ok, used = (~v.present if self.null else F.lit(False)), []
        for r, c in v.parts:
            own = self.values(df, r, c)
            if own is not None:
                df = df.join(own[0], own[1], "left")
                used.append(own[0].columns[-1])
        by_tag: dict[str, list[str]] = {}
        for _, tag, text in tagged_options(self.given):
            by_tag.setdefault(tag, []).append(text)
        for r, m in self._tags(v):
            for tag, texts in by_tag.items():
                o = self._fresh()
                options = self._frame([(x,) for x in dict.fromkeys(texts)], (o,), (pa.string(),))
                if r.many:  # the distinct lists of texts that hold one of the options
                    held = df.select(m[tag].alias(f"{o}a")).where(F.size(f"{o}a") > 0).distinct()
                    each = held.select(f"{o}a", F.explode(f"{o}a").alias(f"{o}x"))
                    options = each.join(options, F.col(f"{o}x") == F.col(o), "left_semi").select(F.col(f"{o}a").alias(o)).distinct()
                df = df.join(options, m[tag] == F.col(o), "left")
                used.append(o)
        for o in used:
            ok = ok | F.col(o).isNotNull()
        mark = self._fresh()
        return df.withColumn(mark, F.coalesce(ok, F.lit(False))).drop(*used), F.col(mark)

    # --- all of

    def all_of(self, df: DataFrame, v: Value) -> DataFrame:
        """The rows whose one value is each of the options: options in other words for one value."""
        if self.null or any(isinstance(o, dict) for o in self.given):
            return df.where(~v.present) if not self.given else df.where(F.lit(False))
        ok, used = F.lit(False), []
        for r, c in v.parts:
            own = self.values(df, r, c, numbered=True)
            if own is not None:
                options, on, _ = own
                o = options.columns[-1]
                every = options.groupBy(o).agg(F.count_distinct(f"{o}k").alias(f"{o}n")).where(F.col(f"{o}n") == len(self.given)).select(o)
                df = df.join(every, on, "left")
                used.append(o)
                ok = ok | F.col(o).isNotNull()
        return df.where(ok).drop(*used)

    def met(self, df: DataFrame, v: Value, keys: list[Column], names: list[str]) -> DataFrame:
        """The keys (named `names`) of the items whose values, the rows of `df`, meet all options that are values."""
        parts, k = [], f"{self.name}k"
        for r, c in v.parts:
            own = self.values(df, r, c, numbered=True)
            if own is not None:
                parts.append(df.join(own[0], own[1]).select(*keys, F.col(own[0].columns[0]).alias(k)))
        tagged = tagged_options(self.given)
        for r, m in self._tags(v) if tagged else ():
            o = self._fresh()
            options = self._frame(tagged, (f"{o}k", f"{o}t", o), (pa.int64(), pa.string(), pa.string()))
            each = df.select(*(x.alias(f"{o}{n}") for n, x in zip(names, keys)), F.explode(m).alias(f"{o}tag", f"{o}text"))
            if r.many:
                each = each.withColumn(f"{o}text", F.explode(f"{o}text"))
            hit = each.join(options, (F.col(f"{o}tag") == F.col(f"{o}t")) & (F.col(f"{o}text") == F.col(o)))
            parts.append(hit.select(*(F.col(f"{o}{n}").alias(n) for n in names), F.col(f"{o}k").alias(k)))
        if not parts:
            return df.select(*keys).limit(0)
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy(*names).agg(F.count_distinct(k).alias(k)).where(F.col(k) == len(self.given)).drop(k)
