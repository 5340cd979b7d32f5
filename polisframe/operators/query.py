"""Feature queries: type selection, property paths, filters, sorting, paging, counts and extents.

A query binds property paths to value columns; every distinct step becomes one join, so that conditions on the same
step test the same property row. Joins are left joins; Catalyst turns them into inner joins wherever the filter rejects
nulls, which is the join choice a filter without OR and null tests needs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisframe.functions import envelope as env
from polisframe.functions.scalar import Operand
from polisframe.functions.temporal import validity
from polisframe.model import CASTS, VALUE_COLUMNS, CityModel, ModelError, PropertyDef
from polisframe.runtime import after_row, page_rows

GENERICS = 3

#: Attributes stored in the feature table itself.
FEATURE_ATTRIBUTES = {
    "id": ("id", "integer"), "objectid": ("objectid", "string"), "identifier": ("identifier", "string"),
    "creationdate": ("creation_date", "timestamp"), "terminationdate": ("termination_date", "timestamp"),
    "validfrom": ("valid_from", "timestamp"), "validto": ("valid_to", "timestamp"),
    "lastmodificationdate": ("last_modification_date", "timestamp"), "envelope": ("envelope", "envelope"),
    "updatingperson": ("updating_person", "string"), "reasonforupdate": ("reason_for_update", "string"),
    "lineage": ("lineage", "string"),
}


@dataclass(frozen=True)
class Step:
    """One path step: the n-th such property (1-based, by id), rows that pass ``where``, or a cast of a generic one.

    ``where`` gets a function from property column name to the step's Column, for instance
    ``lambda p: p("val_uom") == "EUR"``.
    """

    name: str
    at: int | None = None
    where: Callable[[Callable[[str], Column]], Column] | None = None
    cast: str | None = None


@dataclass
class _Join:
    """One joined step; ``key`` names the already joined column it hangs on."""

    alias: str
    name: str
    namespace_id: int
    parent: "_Join | None"
    nested: bool
    type: str | None
    target_ids: list[int] | None = None
    target_class: int | None = None
    positions: set = field(default_factory=set)
    positioned: bool = False
    unpositioned: bool = False

    def col(self, name: str) -> Column:
        return F.col(f"{self.alias}_{name}")

    @property
    def owner_key(self) -> str:
        if self.parent is None:
            return "id"
        return f"{self.parent.alias}_id" if self.nested else f"{self.parent.alias}_target"


_USED = ("id", "feature_id", "parent_id", "val_int", "val_double", "val_string", "val_timestamp", "val_uri",
         "val_uom", "val_codespace", "val_lod", "val_geometry_id", "val_implicitgeom_id", "val_appearance_id",
         "val_address_id", "val_feature_id", "val_relation_type", "datatype_id")


class FeatureQuery:
    """Features of some types, filtered by Columns over bound paths."""

    def __init__(self, model: CityModel, types: Iterable[str | int] | None = None):
        self.model = model
        self.class_ids = model.types.feature_class_ids(types)
        names = list(types) if types is not None else self.class_ids
        self.root_class = model.types.common_supertype(names)["id"]
        self._joins: dict[tuple, _Join] = {}
        self._flags: list[tuple[str, tuple]] = []
        self._conditions: list[Column] = []
        self._order: list[tuple[tuple, str]] = []
        self._page: tuple[int | None, int] = (None, 0)

    # -- paths

    def path(self, *steps: str | Step) -> Operand:
        """The value at a path, as a typed operand. ``"a.b"`` is short for ``"a", "b"``.

        The value is null where a step predicate or position does not hold, so no comparison accepts it there.
        """
        column, kind, guard, untyped = self._resolve(_steps(steps))
        if guard is not None:
            column = F.when(guard, column)
        return Operand(column, kind, untyped=untyped)

    def is_null(self, *steps: str | Step) -> Column:
        """The value is SQL null (where its step predicates hold)."""
        column, _, guard, _ = self._resolve(_steps(steps))
        return column.isNull() if guard is None else guard & column.isNull()

    def missing(self, *steps: str | Step) -> Column:
        """The feature has no property row at this path at all (row form of IS NULL)."""
        names = _steps(steps)
        if names[-1].where is not None or names[-1].at is not None:
            raise ModelError("IS NULL takes no predicate on its last step")
        flag = f"has_{len(self._flags)}"
        self._flags.append((flag, tuple(names)))
        return F.col(flag).isNull()

    def present(self, *steps: str | Step) -> Column:
        return ~self.missing(*steps)

    def _resolve(self, steps: list[Step]):
        registry, join = self.model.types, None
        owner_class, owner_type, guard = self.root_class, None, None
        for i, step in enumerate(steps):
            last = i == len(steps) - 1
            if join is None and last and step.name.lower() in FEATURE_ATTRIBUTES:
                column, kind = FEATURE_ATTRIBUTES[step.name.lower()]
                return F.col(column), kind, None, False
            declared = self._declared(registry, owner_class, owner_type, step.name)
            if declared is not None and step.cast:
                raise ModelError(f"{step.name!r} is declared; only generic attributes are cast")
            if declared is None:
                kind = CASTS.get(step.cast) if step.cast else None
                if step.cast and kind is None:
                    raise ModelError(f"unknown cast {step.cast!r}")
                declared = PropertyDef(step.name, GENERICS, kind or "String")
            join = self._bind(join, declared, nested=owner_class is None)
            if step.at is not None:
                join.positioned = True
                join.positions.add(step.at)
                guard = _and(guard, join.col("position") == step.at)
            else:
                join.unpositioned = True
            if step.where is not None:
                guard = _and(guard, step.where(join.col))
            if declared.type == "FeatureProperty":
                owner_class = registry.lookup(declared.target)["id"] if declared.target else self.root_class
                owner_type = None
            elif not last:
                owner_class, owner_type = None, declared.type
            if last:
                untyped = declared.namespace_id == GENERICS and not step.cast
                if declared.type not in VALUE_COLUMNS:
                    return join.col("id"), "feature", guard, False
                name, kind = VALUE_COLUMNS[declared.type]
                column = join.col(name)
                return (column == 1 if kind == "boolean" else column), kind, guard, untyped
        raise ModelError("empty path")

    @staticmethod
    def _declared(registry, owner_class, owner_type, name):
        if owner_class is not None:
            return registry.class_property(owner_class, name)
        return registry.datatype_property(owner_type, name)

    def _bind(self, parent: _Join | None, prop: PropertyDef, nested: bool) -> _Join:
        key = (parent.alias if parent else None, prop.name, prop.namespace_id)
        if key not in self._joins:
            target_ids = None
            if prop.type == "FeatureProperty" and prop.target:
                target_ids = self.model.types.feature_class_ids([prop.target])
            self._joins[key] = _Join(f"s{len(self._joins)}", prop.name, prop.namespace_id, parent, nested, prop.type,
                                     target_ids)
        return self._joins[key]

    def _rows(self, join: _Join) -> DataFrame:
        """The property rows of one step, with the step's prefix on every column."""
        fk = "parent_id" if join.nested else "feature_id"
        rows = self.model.property.where(
            (F.col("name") == join.name) & (F.col("namespace_id") == join.namespace_id))
        rows = rows.select(*_USED)
        if join.positioned:
            position = F.row_number().over(Window.partitionBy(fk).orderBy("id"))
            rows = rows.withColumn("position", position)
            if not join.unpositioned:
                # two different positions of one shared step can never hold together, and none is below 1
                wanted = join.positions if len(join.positions) == 1 else set()
                rows = rows.where(F.col("position") == wanted.pop() if wanted else F.lit(False))
        if join.target_ids is not None:
            targets = self.model.feature.where(F.col("objectclass_id").isin(join.target_ids)).select(
                F.col("id").alias("target"))
            rows = rows.join(targets, rows["val_feature_id"] == targets["target"])
        elif join.type == "FeatureProperty":
            rows = rows.withColumn("target", F.col("val_feature_id"))
        return rows.select(*[F.col(c).alias(f"{join.alias}_{c}") for c in rows.columns])

    def _join_step(self, df: DataFrame, join: _Join, how: str = "left") -> DataFrame:
        rows = self._rows(join)
        fk = f"{join.alias}_{'parent_id' if join.nested else 'feature_id'}"
        return df.join(rows, df[join.owner_key] == rows[fk], how)

    # -- filter

    def where(self, *conditions: Column) -> "FeatureQuery":
        self._conditions += conditions
        return self

    def valid(self, mode: str = "valid", at=None, reference: str = "database", lenient: bool = False):
        """Restrict by validity in time; without arguments, to what is not terminated."""
        condition = validity(mode, at, reference, lenient)
        return self if condition is None else self.where(condition)

    def sql(self, statement: str) -> "FeatureQuery":
        """Features whose id is in the result of a one-column SELECT over the model's tables."""
        self._semi = getattr(self, "_semi", []) + [self.model.select_ids(statement)]
        return self

    def ids(self, ids: DataFrame, column: str = "id") -> "FeatureQuery":
        """Features whose ``column`` is in the frame's column of that name."""
        self._semi = getattr(self, "_semi", []) + [ids.select(column)]
        return self

    # -- sort and page

    def sort_by(self, *keys: tuple) -> "FeatureQuery":
        """Sort by ``(path, "asc" | "desc")``; nulls come last ascending and first descending."""
        for path, direction in keys:
            steps = _steps((path,) if isinstance(path, (str, Step)) else path)
            if any(s.where is not None for s in steps):
                raise ModelError("sort paths take no predicates")
            self._order.append((tuple(steps), direction))
        return self

    def page(self, limit: int | None, start: int = 0) -> "FeatureQuery":
        self._page = (limit, start)
        return self

    def after(self, *values) -> "FeatureQuery":
        """Only features that come after one with these sort values, and its id last: the next page without an offset."""
        self._after = values
        return self

    # -- results

    def _base(self, columns: Iterable[str]) -> DataFrame:
        feature = self.model.feature.where(F.col("objectclass_id").isin(self.class_ids))
        return feature.select(*dict.fromkeys(["id", "objectclass_id", *columns]))

    def _matches(self, columns: Iterable[str]) -> DataFrame:
        """One row per matching feature."""
        df = self.model.feature.where(F.col("objectclass_id").isin(self.class_ids))
        for ids in getattr(self, "_semi", []):
            df = df.join(ids, ids.columns[0], "left_semi")
        for join in self._joins.values():
            df = self._join_step(df, join)
        for flag, steps in self._flags:
            owners = FeatureQuery(self.model, self.class_ids)
            owners._resolve(list(steps))
            df = df.join(owners._owners().withColumn(flag, F.lit(True)), "id", "left")
        for condition in self._conditions:
            df = df.where(condition)
        df = df.select(*dict.fromkeys(["id", "objectclass_id", *columns]))
        # id determines the other columns, so DISTINCT over all of them is one hash aggregate keyed by id
        return df.distinct() if self._joins else df

    def _owners(self) -> DataFrame:
        """Ids of the features that have a row at the end of this query's path; joined from the property side."""
        chain = list(self._joins.values())
        first = self._rows(chain[0])
        df = first.withColumn("id", F.col(f"{chain[0].alias}_feature_id"))
        for join in chain[1:]:
            df = self._join_step(df, join, "inner")
        return df.select("id").distinct()

    def _sort_values(self, matches: DataFrame) -> tuple[DataFrame, list[Column]]:
        """Join the sort keys as ``sort_0 …``, reduced to the first row per feature before they meet the features."""
        order, groups = [], {}
        for i, (steps, direction) in enumerate(self._order):
            name = f"sort_{i}"
            order.append(_ordered(F.col(name), direction))
            if len(steps) == 1 and steps[0].name.lower() in FEATURE_ATTRIBUTES:
                column = FEATURE_ATTRIBUTES[steps[0].name.lower()][0]
                if column not in matches.columns:
                    source = self.model.feature.select("id", F.col(column).alias(name))
                    matches = matches.join(source, "id", "left")
                else:
                    matches = matches.withColumn(name, F.col(column))
            else:
                groups.setdefault(steps[0].name, []).append((name, steps, direction))
        for members in groups.values():
            side = FeatureQuery(self.model, self.class_ids)
            values = [(n, side._resolve(list(s))[0], d) for n, s, d in members]
            chain = list(side._joins.values())
            df = side._rows(chain[0]).withColumn("id", F.col(f"{chain[0].alias}_feature_id"))
            for join in chain[1:]:
                df = side._join_step(df, join)
            df = df.select("id", *[v.alias(n) for n, v, _ in values])
            first = Window.partitionBy("id").orderBy(*[_ordered(F.col(n), d) for n, _, d in values])
            df = df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
            matches = matches.join(df, "id", "left")
        return matches, order

    def result(self, *columns: str) -> DataFrame:
        """Matching features once each: id, class id and the named feature columns, sorted and paged."""
        needed = list(columns) + [FEATURE_ATTRIBUTES[s[0].name.lower()][0] for s, _ in self._order
                                  if len(s) == 1 and s[0].name.lower() in FEATURE_ATTRIBUTES]
        df, order = self._sort_values(self._matches(needed))
        limit, start = self._page
        if order and not any(s[0].name.lower() == "id" for s, _ in self._order):
            order.append(F.col("id"))
        if getattr(self, "_after", None) is not None:
            names = [(f"sort_{i}", d) for i, (_, d) in enumerate(self._order)] + [("id", "asc")]
            if len(self._after) != len(names):
                raise ModelError(f"after takes {len(names)} values: those of the sort keys and the id")
            df = df.where(after_row(names, list(self._after)))
        if limit is not None or start:
            df = page_rows(df, order or [F.col("id")], limit, start)
        elif order:
            df = df.orderBy(*order)
        return df.select(*dict.fromkeys(["id", "objectclass_id", *columns]))

    def count_hits(self) -> DataFrame:
        """Number of distinct matching features, one row."""
        return self._matches([]).agg(F.count("*").alias("hits"))

    def extent(self) -> DataFrame:
        """The 3D box around all matching features, one row; sorting and paging are ignored."""
        return self._matches(["envelope"]).agg(env.extent("envelope").alias("envelope"))


def sequenced(df: DataFrame, order: list[Column], name: str = "sequence_id") -> DataFrame:
    """Keep the query order through a write: number the rows in ``order`` (1, 2, …)."""
    from polisframe.runtime import number_rows
    return number_rows(df, order, name)


def nth_property(properties: DataFrame, name: str, n: int, parent: str = "feature_id") -> DataFrame:
    """The n-th property of a name within its parent, by id, 1-based."""
    position = F.row_number().over(Window.partitionBy(parent).orderBy("id"))
    return properties.where(F.col("name") == name).withColumn("position", position).where(F.col("position") == n)


def in_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Batch lookup: the rows whose ``column`` is among ``ids`` (a one-column frame)."""
    return df.join(ids.toDF(column), column, "left_semi")


def _steps(steps) -> list[Step]:
    out = []
    for s in steps:
        out += [s] if isinstance(s, Step) else [Step(part) for part in s.split(".")]
    return out


def _and(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def _ordered(c: Column, direction: str) -> Column:
    return c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first()
