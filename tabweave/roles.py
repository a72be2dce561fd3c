"""Column roles: ``str`` marks a categorical column, ``int`` and ``float`` a continuous one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Roles = dict[str, str]

ROLE_TYPES = {"str": "string", "int": "bigint", "float": "double"}


def cat_cols(roles: Roles) -> list[str]:
    return [c for c, r in roles.items() if r == "str"]


def cont_cols(roles: Roles) -> list[str]:
    return [c for c, r in roles.items() if r != "str"]


def infer_roles(df: DataFrame) -> Roles:
    """Roles from the schema; dates, timestamps and nested columns get none and are left out."""
    roles: Roles = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            roles[f.name] = "str"
        elif isinstance(f.dataType, T.IntegralType):
            roles[f.name] = "int"
        elif isinstance(f.dataType, T.NumericType):
            roles[f.name] = "float"
    return roles


def check_roles(roles: Roles) -> Roles:
    bad = {c: r for c, r in roles.items() if r not in ROLE_TYPES}
    if bad:
        raise ValueError(f"unknown roles {bad}; use one of {sorted(ROLE_TYPES)}")
    return roles
