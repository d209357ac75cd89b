"""Receipts built from the order tables: one per order.

Vendors come from a fixed list by customer; the lines of the order are the
items.  The list of items belongs to one receipt document, so it is gathered
per order, as wide as that document is.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.functions.amounts import MONEY, gst_exclusive_totals, items_total


#: Vendors of the receipts, by customer; some contain a category's keyword.
VENDORS = (
    "Harbour Fuel", "Corner Coffee", "North Star Telecom", "Paper & Pen Co", "O'Brien's Bakery",
    "Blue Gum Grocer", "Metro Taxi", "Granite Software", "Quick Ink", "Riverside Cafe",
    "Summit Subscription Box", "Old Mill Restaurant", "Lantern Books", "Seaside Parking",
    "Tinker Tools", "Wattle Energy", "24-7 Stationery", "Cloud AWS Reseller", "Fern Notebook Shop",
    "Kookaburra Airlines", "Red Door Printing", "Marble Hotel",
)

#: Session option: into how many partitions row-by-row heavy inputs are dealt.
SPREAD = "docketry.spread.partitions"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the given parquet tables.

    ``spread`` marks row-by-row heavy work.  A file with a single row group keeps
    one core busy; whoever knows that the input is such sets the option
    ``SPREAD`` to a number of partitions.  Unset, nothing is shuffled for this.
    """
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    partitions = spark.conf.get(SPREAD, None) if spread else None
    return rows.repartition(int(partitions)) if partitions else rows


def line_price() -> Column:
    """Discounted price of a line in whole cents."""
    exact = "decimal(18,4)"
    gross = F.col("l_extendedprice").cast(exact).cast("decimal(12,2)")
    kept = F.lit(1).cast("decimal(3,2)") - F.col("l_discount").cast(exact).cast("decimal(3,2)")
    return F.round(gross * kept, 2).cast(MONEY)


def vendor_of(custkey: Column) -> Column:
    """Vendor name of a customer."""
    names = F.array(*[F.lit(v) for v in VENDORS])
    return F.get(names, F.pmod(custkey, F.lit(len(VENDORS))).cast("int"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with part name, quantity and price.

    ``part`` is left to adaptive execution: broadcast only when it measures
    small, else a shuffle on the part key.
    """
    lines = table(spark, sf_dir, "lineitem", spread=True).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        line_price().alias("price"), "l_shipdate",
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def receipts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_key, request_id, vendor, receipt_date, items, subtotal/gst/total_amount, ...``"""
    entry = F.struct(
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("price"),
        F.col("l_quantity"), F.col("l_shipdate"), F.col("p_name"),
    )
    gathered = (
        order_lines(spark, sf_dir)
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(entry)).alias("_lines"))
    )

    def item(line: Column) -> Column:
        quantity = line["l_quantity"].cast("int")
        unit = F.round(
            line["price"] / F.greatest(quantity, F.lit(1)).cast("decimal(10,0)"), 2
        ).cast(MONEY)
        return F.struct(
            line["p_name"].alias("name"),
            quantity.alias("quantity"),
            unit.alias("unit_price"),
            line["price"].alias("total_price"),
        )

    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"
    )
    joined = orders.join(gathered, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    items = F.transform(F.coalesce(F.col("_lines"), F.array()), item)
    with_items = joined.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderkey").cast("string").alias("request_id"),
        F.col("o_custkey").alias("customer_key"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").cast("timestamp").alias("request_ts"),
        vendor_of(F.col("o_custkey")).alias("vendor"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("receipt_date"),
        items.alias("items"),
    ).withColumn("subtotal_amount", items_total(F.col("items")))
    gst, total = gst_exclusive_totals(F.col("subtotal_amount"))
    return with_items.withColumns({"gst_amount": gst, "total_amount": total})
