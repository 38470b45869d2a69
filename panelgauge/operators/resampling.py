"""Object bootstrap, jackknife, interval endpoints and pilot summaries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SpecError
from .ranking import grouped_rank, hashed_place

MINIMUM = 50


def draws(panel: DataFrame, object: str, attempts: int, seed: int) -> DataFrame:
    """attempt, position, object: resampled objects. A draw depends on seed, attempt and position, not on row order."""
    objects = hashed_place(panel.select(object).distinct(), [object]).withColumn("__at", F.col("place") - 1).drop("place")
    n = objects.count()
    spark = panel.sparkSession
    slots = spark.range(attempts * n).select((F.floor(F.col("id") / n) + 1).cast("long").alias("attempt"), (F.col("id") % n).cast("long").alias("position"))
    slots = slots.withColumn("__at", F.pmod(F.xxhash64(F.lit(seed), "attempt", "position"), F.lit(n)))
    return slots.join(objects, "__at").drop("__at")


def resample(panel: DataFrame, drawn: DataFrame, object: str) -> DataFrame:
    """The rows of each drawn object under its new identity, with multiplicity: an equi-join on the object."""
    return drawn.join(panel, object).drop(object).withColumnRenamed("position", object)


def intervals(replicates: DataFrame, by: list[str], value: str, level: float = 0.95, minimum: int = MINIMUM) -> DataFrame:
    """se, lower, upper, finite of each group: type 6 percentiles, null without support at either end."""
    if not 0 < level < 1:
        raise SpecError("level must lie between 0 and 1")
    a = (1 - level) / 2
    rows = grouped_rank(replicates.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("v")), by, "v")
    n = F.col("size")
    place = lambda p: F.least(F.greatest((n + 1) * F.lit(p), F.lit(1.0)), n.cast("double"))
    at = lambda k: F.max(F.when(F.col("rank") == F.least(k, n), F.col("v")))
    ends = {}
    for name, p in (("lower", a), ("upper", 1 - a)):
        ends |= {f"{name}_0": at(F.floor(place(p))), f"{name}_1": at(F.floor(place(p)) + 1)}
    g = rows.groupBy(*by).agg(F.first("size").alias("size"), F.stddev_samp("v").alias("sd"), *[c.alias(k) for k, c in ends.items()])
    ok = (n >= minimum) & (F.lit(a) * (n + 1) >= 1)
    # type 6: between the order statistics around (n + 1) p
    mid = lambda name, p: F.col(f"{name}_0") + (place(p) - F.floor(place(p))) * (F.col(f"{name}_1") - F.col(f"{name}_0"))
    return g.select(*by, F.when(n >= minimum, F.col("sd")).alias("se"), F.when(ok, mid("lower", a)).alias("lower"), F.when(ok, mid("upper", 1 - a)).alias("upper"), n.cast("long").alias("finite"))


def acceleration(jackknife: DataFrame, by: list[str], value: str) -> DataFrame:
    """BCa acceleration of each group from leave-one-out estimates."""
    m = jackknife.groupBy(*by).agg(F.avg(value).alias("__m"))
    d = F.col("__m") - F.col(value)
    s = jackknife.join(m, by).groupBy(*by).agg(F.sum(d * d).alias("q"), F.sum(d * d * d).alias("c"))
    return s.select(*by, F.when(F.col("q") > 0, F.col("c") / (6 * F.pow("q", 1.5))).otherwise(0.0).alias("acceleration"))


def bca_probabilities(share: float, acceleration: float, level: float) -> tuple[float, float] | None:
    """Adjusted percentiles, or None where the correction is undefined."""
    if not 0 < share < 1:
        return None
    n = NormalDist()
    z0, out = n.inv_cdf(share), []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = n.inv_cdf(p)
        d = 1 - acceleration * (z0 + z)
        if d <= 0:
            return None
        out.append(n.cdf(z0 + (z0 + z) / d))
    return out[0], out[1]


def pilot_summary(records: DataFrame, width_target: float | None = None) -> DataFrame:
    """Rates, Monte Carlo errors and widths of each design's attempts."""
    n = F.count("*")
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    is_ = lambda *s: F.col("status").isin(*s)
    ok = F.col("interval_available")
    g = records.groupBy("design_id").agg(
        n.alias("attempted"), hit(F.col("accepted")).alias("accepted"), hit(is_("fit_error")).alias("preparation_or_fit_errors"), hit(is_("simulation_error")).alias("simulation_errors"), hit(is_("numerically_refused")).alias("refused"), hit(is_("reliability_error")).alias("reliability_errors"),
        hit(ok).alias("interval_available"), hit(is_("interval_unavailable")).alias("interval_unavailable"), F.avg(F.when(ok, F.col("width"))).alias("mean_width_given_interval"), (F.stddev_samp(F.when(ok, F.col("width"))) / F.sqrt(F.sum(ok.cast("int")))).alias("mean_width_mcse_given_interval"),
        hit(F.coalesce(ok & (F.col("width") <= (width_target if width_target is not None else 0.0)), F.lit(False))).alias("precision_successes"),
    )
    errors = F.col("preparation_or_fit_errors") + F.col("simulation_errors") + F.col("reliability_errors")
    for name, top in (("acceptance", F.col("accepted")), ("refusal", F.col("refused")), ("error", errors), ("interval", F.col("interval_available"))):
        p = top / F.col("attempted")
        g = g.withColumns({f"{name}_rate": p, f"{name}_mcse": F.sqrt(p * (1 - p) / F.col("attempted"))})
    if width_target is None:
        return g.drop("precision_successes")
    p = F.col("precision_successes") / F.col("attempted")
    return g.withColumns({"width_target": F.lit(width_target), "precision_success_rate": p, "precision_success_mcse": F.sqrt(p * (1 - p) / F.col("attempted"))})
