"""Click propensity by position and the weights made from it."""

from pyspark.sql import functions as F

from ..functions.exprs import num, ratio
from ..functions.small import small_table


def propensity(df):
    """Mean click per position on randomly ordered slates."""
    return (df.where(F.col("random_bool") == 1).groupBy("position")
            .agg(F.avg("click_bool").alias("propensity")))


def fit_propensity(df, min_rows=1):
    """Fit a / (position + b) to the propensities by least squares on their reciprocals.

    1/p = position/a + b/a is linear in the position; positions without clicks
    have no reciprocal and are left out.
    """
    rates = (df.where(F.col("random_bool") == 1).groupBy("position")
             .agg(F.avg("click_bool").alias("p"), F.count(F.lit(1)).alias("n"))
             .where((F.col("p") > 0) & (F.col("n") >= min_rows)))
    inverse = 1 / F.col("p")
    line = rates.agg(F.regr_slope(inverse, num("position")).alias("slope"),
                     F.regr_intercept(inverse, num("position")).alias("intercept"),
                     F.count(F.lit(1)).alias("n_positions"))
    return line.select(ratio(F.lit(1.0), "slope").alias("a"), ratio("intercept", "slope").alias("b"), "n_positions")


def fit_propensity_curve(df, max_steps=60):
    """Least-squares fit of a / (position + b) to the propensities themselves.

    Damped Gauss-Newton steps from (0.1, 1.0). The table of positions is
    aggregated once; every step is one aggregate of it into five sums, and the
    2x2 system is solved here. `converged` is 1 if the last step moved neither
    parameter, 0 if the steps ran out or none led further down.
    """
    rates = small_table(propensity(df))
    x, y = num("position"), F.col("propensity")

    def sums(a, b):
        base = 1.0 / (x + b)
        err = y - a * base
        da, db = base, -a * base * base
        return rates.agg(F.sum(err * err).alias("sse"), F.sum(da * da).alias("aa"), F.sum(da * db).alias("ab"),
                         F.sum(db * db).alias("bb"), F.sum(da * err).alias("ae"), F.sum(db * err).alias("be"),
                         F.count(F.lit(1)).alias("n")).first()

    a, b, damping, converged = 0.1, 1.0, 1e-3, 0
    now = sums(a, b)
    for _ in range(max_steps):
        aa, bb = now["aa"] * (1 + damping), now["bb"] * (1 + damping)
        det = aa * bb - now["ab"] ** 2
        if det == 0:
            break
        sa = (bb * now["ae"] - now["ab"] * now["be"]) / det
        sb = (aa * now["be"] - now["ab"] * now["ae"]) / det
        after = sums(a + sa, b + sb) if b + sb > -1 + 1e-6 else None
        if after is not None and after["sse"] <= now["sse"]:
            small = abs(sa) < 1e-10 * (1 + abs(a)) and abs(sb) < 1e-10 * (1 + abs(b))
            a, b, now, damping = a + sa, b + sb, after, damping / 10
            if small:
                converged = 1
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return df.sparkSession.createDataFrame([(a, b, now["sse"], now["n"], converged)],
                                           "a double, b double, sse double, n_positions long, converged int")


def fitted_weights(df):
    """Per position: fitted propensity, its inverse, and the inverse divided by its mean."""
    ab = fit_propensity(df).select(F.struct("a", "b")).scalar()
    positions = df.select("position").distinct()
    fitted = positions.withColumn("fitted", ratio(ab["a"], F.col("position") + ab["b"]))
    inverse = fitted.withColumn("ipw", ratio(F.lit(1.0), "fitted"))
    return inverse.withColumn("ipw_norm", ratio("ipw", inverse.agg(F.avg("ipw")).scalar()))
