"""Table contracts: which columns are public, readable, sortable, writable, and how they refer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.schema import check_names, column, schema_fingerprint

# The public column types and their Spark types. Time stays validated text.
PUBLIC_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "byte": T.ShortType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "decimal": T.DecimalType(38, 10),
    "single": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "datetimeoffset": T.TimestampType(),
    "time": T.StringType(),
    "guid": T.StringType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
}


@dataclass(frozen=True)
class ForeignKey:
    """One component of a reference to another table."""

    name: str
    referenced: str
    referenced_column: str
    display: str
    search: tuple[str, ...]
    ordinal: int = 0


@dataclass(frozen=True)
class ContractColumn:
    source: str
    alias: str
    type: str
    nullable: bool = True
    readable: bool = True
    filterable: bool = True
    sortable: bool = True
    writable: bool = False
    key: int | None = None
    generated: bool = False
    token: bool = False
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    foreign_key: ForeignKey | None = None

    @property
    def spark_type(self) -> T.DataType:
        if self.type == "decimal" and self.precision is not None:
            return T.DecimalType(self.precision, self.scale or 0)
        return PUBLIC_TYPES[self.type]

    @property
    def insertable(self) -> bool:
        """May be supplied when a row is added."""
        return not self.generated and not self.token and (self.writable or self.key is not None)

    @property
    def updatable(self) -> bool:
        """May be set on an existing row."""
        return self.writable and self.key is None and not self.generated and not self.token


@dataclass(frozen=True)
class TableContract:
    columns: tuple[ContractColumn, ...]
    # "original_values", "row_version" or "read_only"
    concurrency: str = "original_values"
    max_cell_bytes: int = 2 * 1024 * 1024
    # Fingerprint of the table the contract was made for; reads, staged sets and edits of another schema are refused.
    fingerprint: str | None = None

    def __post_init__(self):
        check_names([c.alias for c in self.columns], "alias")
        unknown = [c.type for c in self.columns if c.type not in PUBLIC_TYPES]
        if unknown:
            raise TabularError("contract.type", f"unknown type '{unknown[0]}'")
        if self.concurrency == "row_version" and sum(c.token for c in self.columns) != 1:
            raise TabularError("contract.token", "row-version contracts need one token column")

    @property
    def keys(self) -> list[ContractColumn]:
        return sorted((c for c in self.columns if c.key is not None), key=lambda c: c.key)

    @property
    def readable(self) -> list[ContractColumn]:
        return [c for c in self.columns if c.readable]

    @property
    def insertable(self) -> list[ContractColumn]:
        return [c for c in self.columns if c.insertable]

    @property
    def updatable(self) -> list[ContractColumn]:
        return [c for c in self.columns if c.updatable]

    def find(self, alias: str) -> ContractColumn:
        for c in self.columns:
            if c.alias.lower() == alias.lower():
                return c
        raise TabularError("contract.alias", f"'{alias}' is not a published column")

    def foreign_keys(self) -> dict[str, list[ContractColumn]]:
        """Components per foreign key, in order; partly published references are refused."""
        groups: dict[str, list[ContractColumn]] = {}
        for c in self.columns:
            if c.foreign_key is not None:
                groups.setdefault(c.foreign_key.name.lower(), []).append(c)
        for name, parts in groups.items():
            parts.sort(key=lambda c: c.foreign_key.ordinal)
            head = parts[0].foreign_key
            same = all(
                (p.foreign_key.referenced, p.foreign_key.display, p.foreign_key.search)
                == (head.referenced, head.display, head.search)
                for p in parts
            )
            uniform = len({p.writable for p in parts}) == 1 and len({p.nullable for p in parts}) == 1
            if not head.search or not same or not uniform or not all(p.readable for p in parts):
                raise TabularError("contract.foreign_key", f"foreign key '{name}' is not one readable tuple")
        return groups


def table_fingerprint(df: DataFrame, contract: TableContract) -> str:
    """The table's schema with the contract's keys and references, as one digest."""
    return schema_fingerprint(df, [k.source for k in contract.keys], [
        f"{name}|{','.join(f'{p.source}={p.foreign_key.referenced_column}' for p in parts)}|{parts[0].foreign_key.referenced}"
        for name, parts in contract.foreign_keys().items()
    ])


def pinned(contract: TableContract, df: DataFrame) -> TableContract:
    """The contract bound to the table as it is now."""
    return replace(contract, fingerprint=table_fingerprint(df, contract))


def check_schema(df: DataFrame, contract: TableContract) -> None:
    """Refuse a table whose schema is not the one the contract is pinned to; runs no job."""
    if contract.fingerprint is not None and table_fingerprint(df, contract) != contract.fingerprint:
        raise TabularError("contract.schema_changed", "the table's schema no longer matches the contract")


def contract_for(df: DataFrame, keys: Sequence[str], writable: Sequence[str] = (), **options) -> TableContract:
    """A contract that publishes every column of ``df`` under its own name."""
    names = {
        "boolean": "boolean", "tinyint": "int16", "smallint": "int16", "int": "int32", "bigint": "int64",
        "float": "single", "double": "double", "date": "date", "timestamp_ntz": "datetime",
        "timestamp": "datetimeoffset", "string": "string", "binary": "binary",
    }
    order = {k.lower(): i for i, k in enumerate(keys)}
    open_columns = {w.lower() for w in writable}
    built = []
    for f in df.schema.fields:
        decimal = isinstance(f.dataType, T.DecimalType)
        built.append(
            ContractColumn(
                f.name, f.name, "decimal" if decimal else names[f.dataType.simpleString()],
                nullable=f.name.lower() not in order, key=order.get(f.name.lower()),
                writable=f.name.lower() in open_columns,
                precision=f.dataType.precision if decimal else None, scale=f.dataType.scale if decimal else None,
            )
        )
    return TableContract(tuple(built), **options)


def project(df: DataFrame, contract: TableContract, guard_cells: bool = False) -> DataFrame:
    """Readable columns in contract order under their public aliases.

    With ``guard_cells`` a text or binary cell above the byte limit becomes null and the
    row's ``__oversize`` flag is set. A pinned contract refuses a table whose schema has changed.
    """
    check_schema(df, contract)
    guarded = [c for c in contract.readable if c.type in ("string", "binary")] if guard_cells else []
    too_big = {c.alias: F.octet_length(column(df, c.source)) > contract.max_cell_bytes for c in guarded}
    cells = []
    for c in contract.readable:
        cell = column(df, c.source)
        if c.alias in too_big:
            cell = F.when(F.coalesce(too_big[c.alias], F.lit(False)), F.lit(None)).otherwise(cell)
        cells.append(cell.alias(c.alias))
    if guard_cells:
        flag = F.lit(False)
        for test in too_big.values():
            flag = flag | F.coalesce(test, F.lit(False))
        cells.insert(0, flag.alias("__oversize"))
    return df.select(*cells)
