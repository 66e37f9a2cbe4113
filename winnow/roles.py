"""Which column is the row key, which is the target, and what the rest are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    row_id: str = "row_id"
    label: str = "label"

    def features(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in (self.row_id, self.label)]

    def numeric(self, df: DataFrame) -> list[str]:
        return self._typed(df, lambda t: isinstance(t, T.NumericType))

    def categorical(self, df: DataFrame) -> list[str]:
        return self._typed(df, lambda t: isinstance(t, T.StringType))

    def vectors(self, df: DataFrame) -> list[str]:
        return self._typed(df, lambda t: t.typeName().endswith("vector") or "VectorUDT" in str(t))

    def ids(self, df: DataFrame) -> list[str]:
        return [self.row_id] if self.row_id in df.columns else []

    def labels(self, df: DataFrame) -> list[str]:
        return [self.label] if self.label in df.columns else []

    def _typed(self, df: DataFrame, test) -> list[str]:
        skip = (self.row_id, self.label)
        return [f.name for f in df.schema.fields if f.name not in skip and test(f.dataType)]


ROLES = Roles()


def ident(name: str) -> str:
    """Quote a column name for use in SQL text or F.col."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(ident(name))


def lay_out(df: DataFrame, roles: Roles = ROLES) -> DataFrame:
    """Row key first, features in data order, target last; numbers to double with NaN
    turned into NULL, every other feature to string so type rules agree."""
    out = [col(c) for c in roles.ids(df)]
    for f in df.schema.fields:
        if f.name in (roles.row_id, roles.label):
            continue
        if isinstance(f.dataType, T.NumericType):
            d = col(f.name).cast("double")
            out.append(F.when(~F.isnan(d), d).alias(f.name))
        elif "VectorUDT" in str(f.dataType):
            out.append(col(f.name))
        else:
            out.append(col(f.name).cast("string").alias(f.name))
    out += [col(c).cast("string").alias(c) for c in roles.labels(df)]
    return df.select(*out)
