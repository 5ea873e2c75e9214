"""Measures defined once and grouped by any dimensions chosen at query time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import exact, exact_quotient, money, rounded


@dataclass(frozen=True)
class Measure:
    """A measure in two steps: ``parts`` over the rows of one entity, ``total`` over entities.

    ``total`` aggregates the named parts of rows that are one per entity, so there
    ``F.count`` of the entity is its distinct count. Parts must be of a kind that
    sums, minima or maxima put together, given with the way to do so.
    """

    parts: dict[str, tuple[Column, str]]
    total: Column


_TOGETHER = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class MetricView:
    """A source with named dimensions and measures.

    A measure is an aggregate expression over source rows, or a ``Measure`` over
    the rows of an entity. Ratios and distinct counts are computed anew at every
    grouping and never added up from a finer one. ``joins`` are applied only when
    a chosen dimension needs them.

    With ``entity``, all levels of a cube come from rows reduced to one per entity
    and combination of dimensions: those are copied per level, the source's rows are not,
    and no level counts distinct values by a copy of each row.
    """

    source: DataFrame
    dims: dict[str, Column]
    measures: dict[str, Column | Measure]
    joins: dict[str, tuple[DataFrame, list[str]]] = field(default_factory=dict)
    needs: dict[str, list[str]] = field(default_factory=dict)
    entity: str | None = None

    def _base(self, dims: list[str], where: Column | None) -> DataFrame:
        frame = self.source if where is None else self.source.filter(where)
        wanted: list[str] = []
        for dim in dims:
            wanted += [j for j in self.needs.get(dim, []) if j not in wanted]
        for name in wanted:
            other, on = self.joins[name]
            frame = frame.join(other, on, "left")
        return frame

    def _split(self, names: list[str]) -> bool:
        """Whether the measures can be taken over rows of the entity."""
        return self.entity is not None and all(isinstance(self.measures[n], Measure) for n in names)

    def _parts(self, names: list[str]) -> dict[str, tuple[Column, str]]:
        return {p: how for n in names for p, how in self.measures[n].parts.items()}

    def _per_entity(self, dims: list[str], measures: list[str], where: Column | None) -> DataFrame:
        keys = [*[self.dims[d].alias(d) for d in dims], F.col(self.entity).alias("__entity")]
        parts = [c.alias(p) for p, (c, _) in self._parts(measures).items()]
        grouped = self._base(dims, where).groupBy(*keys)
        return grouped.agg(*parts) if parts else grouped.agg(F.count(F.lit(1)).alias("__rows"))

    def _totals(self, names: list[str]) -> list[Column]:
        return [self.measures[n].total.alias(n) for n in names]

    def _plain(self, names: list[str]) -> list[Column]:
        return [self.measures[n].alias(n) for n in names]

    def query(self, dims: list[str], measures: list[str], where: Column | None = None) -> DataFrame:
        if self._split(measures):
            return self._per_entity(dims, measures, where).groupBy(*dims).agg(*self._totals(measures))
        keys = [self.dims[d].alias(d) for d in dims]
        return self._base(dims, where).groupBy(*keys).agg(*self._plain(measures))

    def _levels(self, how: str, dims: list[str], measures: list[str], where: Column | None) -> DataFrame:
        if not self._split(measures):
            keyed = self._base(dims, where).withColumns({d: self.dims[d] for d in dims})
            return getattr(keyed, how)(*dims).agg(F.grouping_id().alias("level"), *self._plain(measures))
        if how == "cube":
            kept = [[d for i, d in enumerate(dims) if mask >> i & 1] for mask in range(1 << len(dims))]
        else:
            kept = [dims[:n] for n in range(len(dims) + 1)]
        # the entity is part of every grouping set, so its bit of the level is 0
        sets = [[*[F.col(d) for d in chosen], F.col("__entity")] for chosen in kept]
        together = [_TOGETHER[way](p).alias(p) for p, (_, way) in self._parts(measures).items()]
        per_entity = self._per_entity(dims, measures, where).groupingSets(sets, *dims, "__entity")
        levels = per_entity.agg(F.shiftright(F.grouping_id(), 1).alias("level"), *together)
        return levels.groupBy(*dims, "level").agg(*self._totals(measures))

    def cube(self, dims: list[str], measures: list[str], where: Column | None = None) -> DataFrame:
        return self._levels("cube", dims, measures, where)

    def rollup(self, dims: list[str], measures: list[str], where: Column | None = None) -> DataFrame:
        return self._levels("rollup", dims, measures, where)


@dataclass(frozen=True)
class Snippet:
    name: str
    expression: Column
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class SnippetSet:
    """Reusable filters, row expressions and measures, found by name or synonym."""

    filters: tuple[Snippet, ...]
    expressions: tuple[Snippet, ...]
    measures: tuple[Snippet, ...]

    @staticmethod
    def _find(kind: tuple[Snippet, ...], word: str) -> Snippet:
        wanted = word.strip().lower()
        for snippet in kind:
            if wanted in {n.lower() for n in (snippet.name, *snippet.synonyms)}:
                return snippet
        raise KeyError(word)

    def query(self, df: DataFrame, filters: list[str], dims: list[str], measures: list[str]) -> DataFrame:
        for word in filters:
            df = df.filter(self._find(self.filters, word).expression)
        keys = [self._find(self.expressions, w) for w in dims]
        values = [self._find(self.measures, w) for w in measures]
        return df.groupBy(*[k.expression.alias(k.name) for k in keys]).agg(
            *[m.expression.alias(m.name) for m in values]
        )


def orders_metric_view(v) -> MetricView:
    buyers, revenue = F.count("__entity"), F.sum("paid")
    paid = {"paid": (F.sum(exact("o_totalprice")), "sum")}
    customer = v.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    nation = v.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = v.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return MetricView(
        source=v.orders,
        dims={
            "status": F.col("o_orderstatus"),
            "month": F.trunc("o_orderdate", "month"),
            "segment": F.col("c_mktsegment"),
            "nation": F.col("n_name"),
            "region": F.col("r_name"),
        },
        measures={
            "order_count": Measure({"orders": (F.count(F.lit(1)), "sum")}, F.sum("orders")),
            "customers": Measure({}, buyers),
            "revenue": Measure(paid, money(revenue)),
            "revenue_per_customer": Measure(paid, exact_quotient(revenue, buyers)),
        },
        entity="o_custkey",
        joins={
            "customer": (customer, ["o_custkey"]),
            "nation": (nation, ["c_nationkey"]),
            "region": (region, ["n_regionkey"]),
        },
        needs={
            "segment": ["customer"],
            "nation": ["customer", "nation"],
            "region": ["customer", "nation", "region"],
        },
    )


def sales_snippets() -> SnippetSet:
    return SnippetSet(
        filters=(
            Snippet("high value orders", F.col("o_totalprice") > 100000, ("expensive", "premium", "large orders")),
            Snippet("urgent orders", F.col("o_orderpriority") == "1-URGENT", ("urgent",)),
        ),
        expressions=(
            Snippet("order_month", F.trunc("o_orderdate", "month"), ("month", "monthly")),
            Snippet("order_year", F.year("o_orderdate"), ("year", "yearly")),
        ),
        measures=(
            Snippet("avg_order_value", rounded(F.avg(exact("o_totalprice"))), ("average", "avg", "mean order")),
            Snippet("total_revenue", money(F.sum(exact("o_totalprice"))), ("revenue", "sales", "total sales")),
            Snippet("order_count", F.count("o_totalprice"), ("count", "number of orders")),
        ),
    )
