"""Training metrics of one ride as column expressions. Results are null where an input is missing, unless said otherwise."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_even, present

DEFAULT_THRESHOLD_HR, DEFAULT_FTP, DEFAULT_RESTING_HR = 170, 150, 50


def heart_rate_stress(duration_s: Column, avg_hr: Column, threshold_hr: Column) -> Column:
    """Hours times the squared share of the threshold heart rate, times 100; 0 if anything is missing."""
    intensity = avg_hr / present(threshold_hr).cast("double")
    return F.coalesce(present(duration_s) / F.lit(3600.0) * intensity * intensity * F.lit(100.0), F.lit(0.0))


def power_stress(duration_s: Column, power: Column, ftp: Column) -> Column:
    """100 for an hour at the threshold power; 0 if anything is missing."""
    intensity = power / present(ftp).cast("double")
    return F.coalesce(present(duration_s) / F.lit(3600.0) * intensity * intensity * F.lit(100.0), F.lit(0.0))


def ratio(power: Column, by: Column) -> Column:
    """Power by heart rate (efficiency), by threshold power (intensity) or by mean power (variability), to two decimals."""
    return half_even(F.when(by > 0, present(power)) / by.cast("double"), 2)


def heart_rate_load(hr: Column, max_hr: Column, resting_hr: Column) -> Column:
    """One second's share of the exponential heart-rate load; 0 at or below rest."""
    reserve = F.least((hr - resting_hr) / (max_hr - resting_hr).cast("double"), F.lit(1.0))
    return F.when((hr > resting_hr) & (max_hr > resting_hr), F.lit(1.0) / F.lit(60.0) * reserve * F.lit(0.64) * F.exp(F.lit(1.92) * reserve)).otherwise(F.lit(0.0))


def richness(power: Column, hr: Column, distance: Column, cadence: Column, calories: Column, elevation: Column) -> Column:
    """How much a record holds: power counts 3, heart rate 2, every other measure 1."""
    has = lambda c, n, ok: F.when(ok, n).otherwise(0)
    parts = [has(power, 3, power != 0), has(hr, 2, hr != 0), has(distance, 1, distance > 0), has(cadence, 1, cadence != 0), has(calories, 1, calories != 0), has(elevation, 1, elevation > 0)]
    return sum(parts[1:], parts[0])


def fitted_distance(km: Column, tsb: Column) -> Column:
    """The planned distance, a fifth less for tired riders (form of -10 or below)."""
    return F.when(tsb <= -10, half_even(km * F.lit(0.8), 1)).otherwise(km)


def form_word(tsb: Column) -> Column:
    return F.when(tsb > 10, "fresh").when(tsb > -10, "neutral").when(tsb.isNotNull(), "fatigued")


#: Speeds in km/h where there is no history.
DEFAULT_SPEEDS = {"road": 27.0, "gravel": 22.0, "mtb": 17.0}


def usual_speed(surface: Column, speed: Column) -> Column:
    """The rider's speed, or the surface's usual one."""
    usual = F.lit(22.0)
    for name, v in DEFAULT_SPEEDS.items():
        usual = F.when(surface == name, F.lit(v)).otherwise(usual)
    return F.coalesce(present(speed), usual)


def planned_distance(minutes: Column, surface: Column, speed: Column) -> Column:
    """Kilometres in that time at the rider's speed, or the surface's usual one."""
    return half_even(minutes / F.lit(60.0) * usual_speed(surface, speed), 1)
