"""Schema contracts: what columns and types each block of input has."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tideline.sources.readers import newest

VERSION = 1


class ContractViolation(ValueError):
    """A frame doesn't match its contract."""


def signature(df: DataFrame) -> dict[str, str]:
    """Types by column, in order."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def build(blocks: Mapping[str, DataFrame], by: str, version: int = VERSION) -> dict:
    return {"contract_version": version, "generated_at_utc": dt.datetime.now(dt.UTC).isoformat(), "generated_by": by, "blocks": {k: {"columns": signature(v)} for k, v in blocks.items()}}


def from_files(spark: SparkSession, root: str, patterns: Mapping[str, str], by: str) -> dict:
    """From the newest file of each block's glob; only footers are read."""
    return build({k: spark.read.parquet(newest(spark, f"{root.rstrip('/')}/{p}")) for k, p in patterns.items()}, by)


def export(contract: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(contract, f, indent=2)
        f.write("\n")


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def differences(df: DataFrame, contract: dict, block: str, extra: bool = False) -> list[tuple[str, str, str | None, str | None]]:
    """(column, kind, expected, found) of every mismatch; kind is missing, unexpected (unless extra columns are allowed) or type."""
    want, got = contract["blocks"][block]["columns"], signature(df)
    out = [(c, "missing", want[c], None) for c in want if c not in got]
    out += [(c, "unexpected", None, got[c]) for c in got if c not in want and not extra]
    return out + [(c, "type", want[c], got[c]) for c in want if c in got and want[c] != got[c]]


def validate(df: DataFrame, contract: dict, block: str, extra: bool = False) -> None:
    if block not in contract.get("blocks", {}):
        raise ContractViolation(f"the contract has no block {block}")
    if found := differences(df, contract, block, extra):
        raise ContractViolation(f"{block} (contract {contract.get('contract_version')}): " + "; ".join(f"{kind} column {c}: expected {a}, found {b}" for c, kind, a, b in found))
