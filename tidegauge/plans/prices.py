"""Price and stock histories: alignment, modal prices, misread cleaning, sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numbers import exact_count, half_up, money
from tidegauge.functions.text import tidy_label


def last_readings(obs: DataFrame, keys: list[str]) -> DataFrame:
    """One reading per key and day: the last by time, then by its own fields, so ties repeat."""
    rest = [c for c in obs.columns if c not in (*keys, "day", "seq")]
    return (obs.groupBy(*keys, "day").agg(F.max(F.struct("seq", *rest)).alias("_r"))
            .select(*keys, "day", *[F.col(f"_r.{c}").alias(c) for c in rest]))


def parsed(obs: DataFrame) -> DataFrame:
    """Exact stock and price of each kept reading, on the shared day axis.

    The axis is the calendar of all readings; numbering it makes 'next day' a
    difference of one, so no dense grid is needed to find gaps.
    """
    kept = last_readings(obs, ["sku"])
    axis = obs.select("day").distinct().withColumn(
        "day_ix", (F.row_number().over(Window.orderBy("day")) - 1).cast("bigint"))
    return kept.join(axis, "day").select(
        "sku", "day", "day_ix", exact_count(F.col("available")).alias("stock"),
        money(F.col("price")).cast("double").alias("price"), F.trim("status").alias("status"),
        tidy_label(F.col("label")).alias("label"))


def price_runs(readings: DataFrame) -> DataFrame:
    """The aligned grid as stretches of days: equal stock and price, or no reading at all.

    One row per stretch with its first and last day index; `was_read` tells an empty reading from a
    missing one. A SKU's stretches cover the whole axis without overlap, and there are at most twice
    as many as readings, plus one, however long the axis is.
    """
    order = Window.partitionBy("sku").orderBy("day_ix")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goes_on = ((F.lag("day_ix").over(order) == F.col("day_ix") - 1) & F.lag("stock").over(order).eqNullSafe(F.col("stock"))
               & F.lag("price").over(order).eqNullSafe(F.col("price")))
    runs = (readings.select("sku", "day_ix", "stock", "price")
            .withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
            .withColumn("_run", F.sum("_new").over(so_far))
            .groupBy("sku", "_run").agg(F.min("day_ix").alias("first_ix"), F.max("day_ix").alias("last_ix"),
                                        F.any_value("stock").alias("stock"), F.any_value("price").alias("price")))
    by_run = Window.partitionBy("sku").orderBy("first_ix")
    end = readings.agg(F.max("day_ix")).scalar()
    free = F.coalesce(F.lag("last_ix").over(by_run) + 1, F.lit(0).cast("bigint"))
    spaced = runs.withColumn("_free", free).withColumn("_is_last", F.lead("first_ix").over(by_run).isNull())

    def stretch(first: Column, last: Column, read: bool) -> Column:
        stock, price = ((F.col(c) if read else F.lit(None).cast(t)).alias(c) for c, t in (("stock", "bigint"), ("price", "double")))
        return F.struct(first.alias("first_ix"), last.alias("last_ix"), F.lit(read).alias("was_read"), stock, price)

    first, last = F.col("first_ix"), F.col("last_ix")
    parts = F.array_compact(F.array(
        F.when(F.col("_free") < first, stretch(F.col("_free"), first - 1, False)), stretch(first, last, True),
        F.when(F.col("_is_last") & (last < end), stretch(last + 1, end, False))))
    return spaced.select("sku", F.explode(parts).alias("p")).select("sku", "p.*")


def dense_grid(runs: DataFrame, days: DataFrame, *, sku: str | None = None) -> DataFrame:
    """The days of one SKU, or of all, from its stretches; `days` holds (day_ix, day)."""
    chosen = runs if sku is None else runs.where(F.col("sku") == sku)
    return (chosen.withColumn("day_ix", F.explode(F.sequence("first_ix", "last_ix"))).join(days, "day_ix")
            .select("sku", "day_ix", "day", "stock", "price"))


def modal_price(readings: DataFrame) -> DataFrame:
    """Most frequent in-stock price per SKU (lower on ties), or of all readings if never in stock."""
    in_stock = F.col("status").startswith("ok") & (F.col("stock") > 0)
    counts = readings.where("price IS NOT NULL").groupBy("sku", "price").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(in_stock, F.lit(False))).alias("n_in"))

    def mode(n: str) -> Column:
        return F.min_by("price", F.when(F.col(n) > 0, F.struct(-F.col(n), F.col("price"))))

    return counts.groupBy("sku").agg(F.coalesce(mode("n_in"), mode("n")).alias("modal"))


# Product families as labelled.
FAMILIES = ["K-Cups", "Ground", "Whole Bean"]


def sku_catalogue(readings: DataFrame, modal: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Name, family and size of every SKU from its latest label and modal price.

    `catalogue` holds (sku, label, size) as kept by hand: a label that is not blank replaces the one read,
    a size that is not blank replaces the one inferred. Of several entries of a SKU the greatest counts.
    """
    latest = readings.groupBy("sku").agg(
        F.max_by("label", F.when(F.length("label") > 0, F.col("day"))).alias("label"),
        F.max(F.when(F.col("stock").isNotNull(), F.col("day"))).alias("last_reading"))
    if catalogue is None:
        listed = latest.withColumns({"listed_label": F.lit(None).cast("string"), "listed_size": F.lit(None).cast("string")})
    else:
        kept = catalogue.groupBy("sku").agg(F.max(F.struct("label", "size")).alias("c")).select(
            "sku", tidy_label(F.col("c.label")).alias("listed_label"), F.trim("c.size").alias("listed_size"))
        listed = latest.join(kept, "sku", "left")
    label = F.coalesce(F.when(F.length("listed_label") > 0, F.col("listed_label")), "label", "sku")
    parts = F.split(label, " - ", 2)
    split_up = (F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "")
    named = listed.join(modal, "sku", "left").select(
        "sku", "last_reading", "modal", "listed_size",
        F.when(split_up, F.when(F.trim(parts[0]).isin(FAMILIES), F.trim(parts[0]))).alias("f"),
        F.trim(F.when(split_up, F.get(parts, F.lit(1))).otherwise(label)).alias("name"))
    family = F.coalesce("f", F.lit("Other"))
    size = (F.when(F.length("listed_size") > 0, F.col("listed_size")).when(family == "K-Cups", "12-pack").when(F.lower("name").contains("kona"), "7oz")
            .when(F.col("modal") >= 45, "5lb").otherwise("12oz"))
    return named.select("sku", "name", family.alias("family"), size.alias("size"), "modal", "last_reading")


def bad_days(readings: DataFrame, modal: DataFrame, *, hi: float = 1.35, thresh: int = 5) -> DataFrame:
    """Days on which many SKUs read far above their own modal price at once: a bad scan."""
    high = F.col("price") > F.lit(hi) * F.col("modal")
    return (readings.join(modal, "sku").groupBy("day").agg(F.count_if(high).alias("high_skus"))
            .where(F.col("high_skus") >= thresh))


def with_held(readings: DataFrame, *, tol: float = 0.08) -> DataFrame:
    """Mark prices that stand in a run of three or more neighbouring days near their own value."""
    order = Window.partitionBy("sku").orderBy("day_ix")
    p = F.col("price")

    def near(offset: int) -> Column:
        q = F.lag("price", offset).over(order) if offset > 0 else F.lead("price", -offset).over(order)
        ix = F.lag("day_ix", offset).over(order) if offset > 0 else F.lead("day_ix", -offset).over(order)
        return F.coalesce((F.abs(F.col("day_ix") - ix) == abs(offset)) & (F.abs(q - p) <= F.lit(tol) * p), F.lit(False))

    one = F.lit(1)
    left1, right1 = near(1), near(-1)
    run = (one + left1.cast("int") + (left1 & near(2)).cast("int")
           + right1.cast("int") + (right1 & near(-2)).cast("int"))
    return readings.withColumn("held", F.coalesce(p.isNotNull() & (run >= 3), F.lit(False)))


def clean_prices(readings: DataFrame, modal: DataFrame, bad: DataFrame, *, hi: float = 1.35, lo: float = 0.65,
                 tol: float = 0.08) -> DataFrame:
    """Null misreads: high ones always, low ones only on a bad-scan day, never a held price."""
    j = (with_held(readings, tol=tol).join(modal, "sku", "left")
         .join(bad.select("day", F.lit(True).alias("bad_day")), "day", "left"))
    high = F.col("price") > F.lit(hi) * F.col("modal")
    low = (F.col("price") < F.lit(lo) * F.col("modal")) & F.coalesce("bad_day", F.lit(False))
    drop = F.coalesce((F.col("modal") > 0) & (high | low) & ~F.col("held"), F.lit(False))
    return j.select("sku", "day", "day_ix", "stock", F.col("price").alias("raw_price"),
                    F.when(~drop, F.col("price")).alias("price"), drop.alias("nulled"))


def nulled_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("sku").agg(F.count_if("nulled").alias("nulled"), F.count("price").alias("kept"))


def second_store(obs: DataFrame) -> DataFrame:
    """Aligned readings of the shop with tidied (product, variant) keys and a compare-at price."""
    obs = obs.withColumns({c: tidy_label(F.col(c)) for c in ("product", "variant")})
    kept = last_readings(obs, ["product", "variant"])
    status, stock = F.trim("status"), F.trim("stock")
    price = money(F.col("price")).cast("double")
    compare = money(F.col("compare_at")).cast("double")
    return kept.select(
        "product", "variant", "day",
        F.when((status == "in_stock") & stock.rlike(r"^\d+$"), stock.try_cast("bigint")).when(status == "sold_out", 0).alias("stock"),
        price.alias("price"), F.when((compare > 0) & (compare > price), compare).alias("compare_at"))


def second_store_catalogue(readings: DataFrame) -> DataFrame:
    """Family, size and latest price of every (product, variant)."""
    v, p = F.lower("variant"), F.lower("product")
    family = (F.when(v.contains("12 pack") | p.contains("kcup"), "K-Cups").when(v.contains("whole bean"), "Whole Bean")
              .when(v.contains("ground"), "Ground").otherwise("Other"))
    size = (F.when(v.contains("5lb"), "5lb").when(v.contains("7oz"), "7oz").when(v.contains("12oz"), "12oz")
            .when(family == "K-Cups", "12-pack").otherwise(""))
    return readings.groupBy("product", "variant").agg(
        F.max_by("price", F.when(F.col("price").isNotNull(), F.col("day"))).alias("price"),
        F.max(F.when(F.col("stock").isNotNull(), F.col("day"))).alias("last_reading")) \
        .select("product", "variant", family.alias("family"), size.alias("size"), "price", "last_reading")


def sales(readings: DataFrame, modal: DataFrame, *, margin: float = 0.3) -> DataFrame:
    """Units sold, restocked, revenue and margin per SKU from differences of known stock."""
    order = Window.partitionBy("sku").orderBy("day_ix")
    known = readings.where("stock IS NOT NULL").withColumn("before", F.lag("stock").over(order))
    change = F.col("stock") - F.col("before")
    s = known.groupBy("sku").agg(
        F.coalesce(F.sum(F.when(change < 0, -change)), F.lit(0)).alias("sold"),
        F.coalesce(F.sum(F.when(change > 0, change)), F.lit(0)).alias("restocked"))
    revenue = F.col("sold") * F.col("modal")
    return s.join(modal, "sku").select("sku", "sold", "restocked", half_up(revenue * 100).alias("revenue_cents"),
                                       half_up(revenue * margin * 100).alias("margin_cents"))
