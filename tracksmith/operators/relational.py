"""Generic table layer: event choice, comparisons, intervals, maxima, derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Electrons per MeV (fixed value).
ELECTRONS_PER_MEV = 1e5 / 2.5

_COMPARE = {"==": Column.__eq__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
_BOUNDS = {"open": (">", "<"), "closed": (">=", "<="), "left": (">=", "<"), "right": (">", "<=")}


def get_event(df: DataFrame, event_id: int) -> DataFrame:
    """The rows of one event; asking for an unknown event is an error."""
    found = df.where(F.col("event_id") == event_id)
    if found.isEmpty():
        raise KeyError(f"no event {event_id}")
    return found


def select_by(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows whose column compares so with a value; op is one of == < <= > >=."""
    return df.where(_COMPARE[op](F.col(column), F.lit(value)))


def in_range(x: str | Column, low, high, bound: str = "closed") -> Column:
    """Whether x lies in an interval: open, closed, left (closed) or right (closed)."""
    x = F.col(x) if isinstance(x, str) else x
    a, b = _BOUNDS[bound]
    return _COMPARE[a](x, F.lit(low)) & _COMPARE[b](x, F.lit(high))


def select_interval(df: DataFrame, column: str, low, high, bound: str = "closed") -> DataFrame:
    return df.where(in_range(column, low, high, bound))


def select_where(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(predicate)


def find_max(df: DataFrame, y: str, order: str, x: str | None = None, by: list[str] | None = None) -> DataFrame:
    """by, index (least order value among the greatest y), x at the maximum, y: the first maximum of each group.

    A partial aggregate, not a sort: the greatest (y, -order) struct.
    """
    pick = F.max(F.struct(F.col(y).alias("y"), (-F.col(order)).alias("neg"), F.col(x or y).alias("x")))
    out = df.where(F.col(y).isNotNull()).groupBy(*(by or [])).agg(pick.alias("m"))
    return out.select(*(by or []), (-F.col("m.neg")).alias("index"), F.col("m.x").alias("x_at_max"), F.col("m.y").alias("max"))


def transform_hits(hits: DataFrame, electrons: bool = True) -> DataFrame:
    """Hits without time, label, particle and hit numbers; with electrons (halves round to even)."""
    out = hits.drop("time", "label", "particle_id", "hit_id")
    return out.withColumn("electrons", F.rint(F.col("energy") * ELECTRONS_PER_MEV).cast("long")) if electrons else out


def parse_event_spec(spec: str) -> list[tuple[int, int, int]]:
    """Ranges (first, last, step) of a text such as "3", "2:9", "1:2:9" or "1,5,7:9"."""
    out = []
    for part in spec.replace(" ", "").split(","):
        n = [int(x) for x in part.split(":")]
        out.append({1: lambda: (n[0], n[0], 1), 2: lambda: (n[0], n[1], 1), 3: lambda: (n[0], n[2], n[1])}[len(n)]())
    return out


def choose_events(df: DataFrame, spec: str | None = None, first: int | None = None, from_rank: int = 1, events: DataFrame | None = None) -> DataFrame:
    """Rows of the chosen events: by a spec text, by rank in ascending id order, by a table of ids, or all.

    Specs become range predicates that reach the scan; ranks sort the distinct ids only.
    """
    if events is not None:
        return df.join(events.select("event_id").distinct(), "event_id", "left_semi")
    if spec is not None:
        hit = F.lit(False)
        for a, b, step in parse_event_spec(spec):
            hit = hit | (F.col("event_id").between(a, b) & ((F.col("event_id") - a) % step == 0))
        return df.where(hit)
    if first is None and from_rank == 1:
        return df
    ids = df.select("event_id").distinct().orderBy("event_id")
    chosen = ids.offset(from_rank - 1) if from_rank > 1 else ids
    return df.join(chosen.limit(first) if first is not None else chosen, "event_id", "left_semi")


def validate_input(hits: DataFrame, generated: int, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """One row: events in the configuration and with hits, id range, and whether a wanted range lies inside."""
    facts = hits.agg(F.countDistinct("event_id").alias("n_with_hits"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    inside = F.lit(True)
    if lowest is not None:
        inside = inside & (F.col("first_event") <= lowest)
    if highest is not None:
        inside = inside & (F.col("last_event") >= highest)
    return facts.withColumn("n_generated", F.lit(generated)).withColumn("complete", F.col("n_with_hits") == F.col("n_generated")).withColumn("range_inside", inside)


def validate_parameters(voxel_size: float, max_distance: float, energy_threshold: float, xyc: float = 1.0, zc: float = 1.0) -> None:
    bad = [n for n, v in {"voxel_size": voxel_size, "max_distance": max_distance, "xyc": xyc, "zc": zc}.items() if v <= 0]
    if bad or energy_threshold < 0:
        raise ValueError(f"out of range: {', '.join(bad) or 'energy_threshold'}")


def find_alphas(particles: DataFrame) -> DataFrame:
    """Alpha particles as event_id, x, y, z, energy, finalv."""
    return particles.where(F.col("particle_name") == "alpha").select("event_id", F.col("initial_x").alias("x"), F.col("initial_y").alias("y"), F.col("initial_z").alias("z"), F.col("kin_energy").alias("energy"), F.col("final_volume").alias("finalv"))


def sigma_t_mm(drift_cm: Column, per_sqrt_cm: float = 3.5) -> Column:
    """Transverse diffusion of electrons in mm after a drift in cm."""
    return per_sqrt_cm * F.sqrt(drift_cm)


def sigma_l_mm(drift_cm: Column, per_sqrt_cm: float = 0.9) -> Column:
    return per_sqrt_cm * F.sqrt(drift_cm)


def sigma_t_ion_mm(drift_cm: Column, temperature_k: float = 300.0, field_v_cm: float = 500.0) -> Column:
    """Thermal diffusion of ions: sqrt(2 kT L / (e E)), in mm."""
    return F.sqrt(2 * 8.617333e-5 * temperature_k * drift_cm / field_v_cm) * 10


def voxel_and_distance(drift_cm: Column, sigma: Column, truth_size: float = 0.5) -> tuple[Column, Column]:
    """Voxel size and link distance from drift and diffusion: scales 1.5 and 1.5 beyond 50 cm, 3 and 2 below; truth size without drift."""
    far = drift_cm > 50
    size = F.when(drift_cm <= 0, F.lit(truth_size)).otherwise(sigma * F.when(far, 1.5).otherwise(3.0))
    return size, size * F.when(drift_cm <= 0, F.lit(2.5)).when(far, 1.5).otherwise(2.0)


def peak_columns(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, then for the leftmost and the rightmost peak: left, right, prominence; 0 where there is none.

    peaks: keys, at, left, right, prominence; groups are tracks.
    """
    first, last = F.min(F.struct("at", "left", "right", "prominence")), F.max(F.struct("at", "left", "right", "prominence"))
    out = peaks.groupBy(*keys).agg(F.count("at").alias("n_peaks"), first.alias("p1"), last.alias("p2"))
    cols = [F.coalesce(F.col(f"p{i}.{c}"), F.lit(0.0)).alias(f"peak{i}_{c}") for i in (1, 2) for c in ("left", "right", "prominence")]
    return out.select(*keys, "n_peaks", *cols)
