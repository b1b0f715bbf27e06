"""Customer totals kept up to date by new order lines, without the lines that came before.

Three keyed tables in buckets (``sources.buckets``) stand for the lines of the past: one row per customer and order, one per customer and
product, one per customer. A delta is summed first; of the tables it then looks up only the keys that it holds, in their buckets. So a
customer with very many orders costs as much as the new ones, and a late line of an old order finds that order's row.

Every row names the delta that wrote it and what the row held before. A delta that was lost half way is applied again, with the same number
and the same lines, and starts from those earlier values; a delta that was finished is passed over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.plans.marts import order_items
from fretwork.session import materialize, run_together, scratch_scope
from fretwork.sources.buckets import BucketTable
from fretwork.sources.pointers import point_to, pointers

ORDER_FACTS = "total decimal(38,2), last date, first date"
CUSTOMER_FACTS = "total_orders bigint, n_products bigint, lifetime_value decimal(38,2), last_order_date date, first_order_date date"


def plus(a: Column, b: Column) -> Column:
    """Sum in which NULL is nothing, as in an aggregate."""
    return F.coalesce(a + b, a, b)


def _schema(keys: str, facts: str) -> str:
    return f"{keys}, delta bigint, now struct<{_struct(facts)}>, before struct<{_struct(facts)}>"


def _struct(facts: str) -> str:
    return ", ".join(f"{part.split(' ', 1)[0]}:{part.split(' ', 1)[1]}" for part in facts.split(", "))


@dataclass(frozen=True)
class CustomerTotals:
    """``path``: folder of the tables; ``buckets`` must stay the same for its life.

    Lines (customer_id, order_id, product_id, line_total, order_date) are only ever added; a correction is a line with a negative total.
    A NULL customer, order or product is a key like any other; as in ``marts.customer_stats`` a NULL order counts as no order.
    One writer at a time.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _table(self, name: str, keys: Sequence[str], facts: str) -> BucketTable:
        schema = self.spark.createDataFrame([], _schema(", ".join(f"{k} string" for k in keys), facts)).schema
        return BucketTable(self.spark, f"{self.path}/{name}", schema, keys, ["delta"], self.buckets)

    @property
    def orders(self) -> BucketTable:
        return self._table("orders", ["customer_id", "order_id"], ORDER_FACTS)

    @property
    def products(self) -> BucketTable:
        return self._table("products", ["customer_id", "product_id"], "bought boolean")

    @property
    def customers(self) -> BucketTable:
        return self._table("customers", ["customer_id"], CUSTOMER_FACTS)

    def applied(self) -> int:
        """Number of the last delta that was finished; 0 before the first."""
        done = pointers(self.spark, f"{self.path}/applied")
        return int(done[-1][1]) if done else 0

    def apply(self, lines: DataFrame, delta: int) -> bool:
        """Add the lines of delta ``delta`` (1, 2, ...); False where it has been applied before."""
        last = self.applied()
        if delta <= last:
            return False
        if delta != last + 1:
            raise ValueError(f"delta {last + 1} comes before delta {delta}")
        with scratch_scope(self.spark):
            items = materialize(order_items(lines), "delta-items")
            # Each row is written once: the customers are made from what the other two logs have just taken in.
            run_together(
                lambda: self.orders.append(self._new_orders(items, delta)),
                lambda: self.products.append(self._new_products(items, delta).where("before is null")),
            )
            self.customers.append(self._new_customers(self.orders.last_appended(), self.products.last_appended(), delta))
        point_to(self.spark, f"{self.path}/applied", str(delta))
        return True

    def _with_past(self, table: BucketTable, news: DataFrame, delta: int) -> DataFrame:
        """Rows of ``news`` with ``before``: what the table held of their key before this delta, NULL where nothing."""
        own = F.col("delta") == delta
        held = table.read(among=news.select(*table.keys))
        past = held.select(*[F.col(k).alias(f"_{k}") for k in table.keys], F.when(own, F.col("before")).otherwise(F.col("now")).alias("before"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in table.keys])
        return news.join(past, same, "left").drop(*[f"_{k}" for k in table.keys])

    def _row(self, table: BucketTable, rows: DataFrame, delta: int, now: Column) -> DataFrame:
        types = {f.name: f.dataType for f in table.schema}
        return rows.select(*table.keys, F.lit(delta).cast("bigint").alias("delta"), now.cast(types["now"]).alias("now"), F.col("before").cast(types["before"]).alias("before"))

    def _new_orders(self, items: DataFrame, delta: int) -> DataFrame:
        table = self.orders
        news = items.groupBy(*table.keys).agg(F.sum("total").alias("total"), F.max("last").alias("last"), F.min("first").alias("first"))
        now = F.struct(
            plus(F.col("total"), F.col("before.total")).alias("total"),
            F.greatest("last", "before.last").alias("last"),
            F.least("first", "before.first").alias("first"),
        )
        return self._row(table, self._with_past(table, news, delta), delta, now)

    def _new_products(self, items: DataFrame, delta: int) -> DataFrame:
        table = self.products
        news = items.select(*table.keys).distinct()
        return self._row(table, self._with_past(table, news, delta), delta, F.struct(F.lit(True).alias("bought")))

    def _new_customers(self, orders: DataFrame, products: DataFrame, delta: int) -> DataFrame:
        """From the rows of the delta alone: what each order adds to its customer is its row now less its row before."""
        table = self.customers
        added = F.when(F.col("before").isNull(), F.col("now.total")).otherwise(plus(F.col("now.total"), -F.col("before.total")))
        from_orders = orders.groupBy("customer_id").agg(
            F.count_if(F.col("before").isNull() & F.col("order_id").isNotNull()).alias("n_orders"),
            F.sum(added).alias("total"),
            F.max("now.last").alias("last"),
            F.min("now.first").alias("first"),
        )
        from_products = products.groupBy(F.col("customer_id").alias("_id")).agg(F.count_if(F.col("before").isNull()).alias("n_new"))
        news = from_orders.join(from_products, F.col("customer_id").eqNullSafe(F.col("_id")), "left").drop("_id")
        news = news.withColumn("n_new", F.coalesce("n_new", F.lit(0)))
        now = F.struct(
            plus(F.col("n_orders"), F.col("before.total_orders")).alias("total_orders"),
            plus(F.col("n_new"), F.col("before.n_products")).alias("n_products"),
            plus(F.col("total"), F.col("before.lifetime_value")).alias("lifetime_value"),
            F.greatest("last", "before.last_order_date").alias("last_order_date"),
            F.least("first", "before.first_order_date").alias("first_order_date"),
        )
        return self._row(table, self._with_past(table, news, delta), delta, now)

    def compact(self) -> None:
        """Fold the logs into the buckets that they touch; any time between two deltas."""
        run_together(self.orders.compact, self.products.compact, self.customers.compact)

    def totals(self) -> DataFrame:
        """The columns of ``marts.customer_stats`` and the number of distinct products, per customer that ordered."""
        return self.customers.read().select("customer_id", "now.*")

    def bridge(self) -> DataFrame:
        """The columns of ``marts.customer_products``."""
        return self.products.read().select("customer_id", "product_id")
