"""Declared tables: column types, keys, references and row rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPEN_DATE = "9999-01-01"


@dataclass(frozen=True)
class Column:
    """A column as the relational side declares it, e.g. ``Column("gender", "enum('M','F')", required=True)``."""

    name: str
    declared: str
    required: bool = False

    @property
    def is_char(self) -> bool:
        return self.declared.lower().startswith("char(")

    @property
    def max_length(self) -> int | None:
        found = re.fullmatch(r"(?:var)?char\((\d+)\)", self.declared.lower())
        return int(found.group(1)) if found else None

    @property
    def allowed(self) -> list[str] | None:
        if not self.declared.lower().startswith("enum("):
            return None
        return re.findall(r"'([^']*)'", self.declared)

    @property
    def spark_type(self) -> str:
        """Text stays STRING: Spark's CHAR pads on read and its VARCHAR fails a whole job on one long value."""
        return "string" if self.max_length or self.allowed else self.declared.lower()


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"foreign_key:{','.join(self.columns)}"


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    """Row rules by name, each a SQL predicate; as in SQL, a rule that yields NULL is not broken."""
    ignore_case: bool = False
    """Compare text keys and enum values without regard to case, as a case-insensitive collation does."""

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.spark_type}" for c in self.columns)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)

    @property
    def keys(self) -> dict[str, tuple[str, ...]]:
        """Every key whose values may occur once, by constraint name."""
        primary = {"primary_key": self.primary_key} if self.primary_key else {}
        return primary | {f"unique:{','.join(cols)}": cols for cols in self.unique}

    def key_value(self, name: str) -> SparkColumn:
        """The value by which ``name`` is compared in keys."""
        is_text = any(c.name == name and c.spark_type == "string" for c in self.columns)
        return F.lower(name) if self.ignore_case and is_text else F.col(name)


def load_order(specs: Iterable[TableSpec]) -> list[TableSpec]:
    """Parents before children, otherwise as declared. A table may refer to itself; a circle of several is an error."""
    by_name = {s.name: s for s in specs}
    parents = {n: [f.parent for f in s.foreign_keys if f.parent in by_name and f.parent != n] for n, s in by_name.items()}
    return [by_name[n] for n in TopologicalSorter(parents).static_order()]


def _period_table(name: str) -> TableSpec:
    return TableSpec(
        name,
        (
            Column("emp_no", "int", True),
            Column("dept_no", "char(4)", True),
            Column("from_date", "date", True),
            Column("to_date", "date", True),
        ),
        primary_key=("emp_no", "dept_no"),
        foreign_keys=(
            ForeignKey(("emp_no",), "employees", ("emp_no",)),
            ForeignKey(("dept_no",), "departments", ("dept_no",)),
        ),
    )


# The declared tables of the employee database and of the customer and order schema.
DEPARTMENTS = TableSpec(
    "departments",
    (Column("dept_no", "char(4)", True), Column("dept_name", "varchar(40)", True)),
    primary_key=("dept_no",),
    unique=(("dept_name",),),
)
EMPLOYEES = TableSpec(
    "employees",
    (
        Column("emp_no", "int", True),
        Column("birth_date", "date", True),
        Column("first_name", "varchar(14)", True),
        Column("last_name", "varchar(16)", True),
        Column("gender", "enum('M','F')", True),
        Column("hire_date", "date", True),
    ),
    primary_key=("emp_no",),
)
DEPT_MANAGER = _period_table("dept_manager")
DEPT_EMP = _period_table("dept_emp")
TITLES = TableSpec(
    "titles",
    (
        Column("emp_no", "int", True),
        Column("title", "varchar(50)", True),
        Column("from_date", "date", True),
        Column("to_date", "date"),
    ),
    primary_key=("emp_no", "title", "from_date"),
    foreign_keys=(ForeignKey(("emp_no",), "employees", ("emp_no",)),),
)
SALARIES = TableSpec(
    "salaries",
    (
        Column("emp_no", "int", True),
        Column("salary", "int", True),
        Column("from_date", "date", True),
        Column("to_date", "date", True),
    ),
    primary_key=("emp_no", "from_date"),
    foreign_keys=(ForeignKey(("emp_no",), "employees", ("emp_no",)),),
)
CUSTOMERS = TableSpec(
    "customers",
    (
        Column("customer_id", "int", True),
        Column("name", "varchar(100)", True),
        Column("email", "varchar(100)"),
        Column("registration_date", "date"),
    ),
    primary_key=("customer_id",),
)
ORDERS = TableSpec(
    "orders",
    (
        Column("order_id", "int", True),
        Column("customer_id", "int"),
        Column("order_date", "date"),
        Column("total_amount", "decimal(10,2)"),
    ),
    primary_key=("order_id",),
    foreign_keys=(ForeignKey(("customer_id",), "customers", ("customer_id",)),),
)
EMPLOYEE_DATABASE = (DEPARTMENTS, EMPLOYEES, DEPT_MANAGER, DEPT_EMP, TITLES, SALARIES)

# The rows an empty customers table is seeded with.
CUSTOMER_SEED = (
    (1, "John Doe", "john@example.com", "2023-01-15"),
    (2, "Jane Smith", "jane@example.com", "2023-02-20"),
    (3, "Bob Johnson", "bob@example.com", "2023-03-10"),
    (4, "Alice Brown", "alice@example.com", "2023-04-05"),
    (5, "Charlie Davis", "charlie@example.com", "2023-05-12"),
)
