"""Column functions of flight mechanics: atmosphere, speeds, drag polar, limits and cubic descents."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard atmosphere and gravity.
G0 = 9.80665
RHO0 = 1.225
T0 = 288.15
P0 = 101_325.0
LAPSE = 0.0065
R_AIR = 287.05287


def temperature_k(h: Column, delta_isa: Column) -> Column:
    return T0 - LAPSE * F.greatest(h, F.lit(0.0)) + delta_isa


def pressure_pa(h: Column) -> Column:
    return P0 * F.pow(F.greatest(T0 - LAPSE * F.greatest(h, F.lit(0.0)), F.lit(1.0)) / T0, F.lit(G0 / (R_AIR * LAPSE)))


def density(h: Column, delta_isa: Column) -> Column:
    return pressure_pa(h) / (R_AIR * F.greatest(temperature_k(h, delta_isa), F.lit(1.0)))


def tas_of(cas: Column, h: Column, delta_isa: Column) -> Column:
    return cas * F.sqrt(RHO0 / F.greatest(density(h, delta_isa), F.lit(1e-9)))


def cas_of(tas: Column, h: Column, delta_isa: Column) -> Column:
    return tas * F.sqrt(F.greatest(density(h, delta_isa), F.lit(1e-9)) / RHO0)


def dynamic_pressure(tas: Column, h: Column, delta_isa: Column) -> Column:
    return 0.5 * density(h, delta_isa) * tas * tas


def drag_n(cd0: Column, k: Column, mass: Column, area: Column, tas: Column, h: Column, gamma: Column, bank: Column, delta_isa: Column) -> Column:
    """Drag of a parabolic polar at the lift that flight path and bank ask for."""
    q = dynamic_pressure(F.greatest(tas, F.lit(1.0)), h, delta_isa)
    lift = mass * G0 * F.cos(gamma) / F.greatest(F.least(F.cos(bank), F.lit(1.0)), F.lit(0.1))
    cl = lift / F.greatest(q * area, F.lit(1e-6))
    return q * area * (cd0 + k * cl * cl)


def lift_coefficient(mass: Column, area: Column, tas: Column, h: Column, gamma: Column, delta_isa: Column) -> Column:
    return mass * G0 * F.cos(gamma) / F.greatest(dynamic_pressure(F.greatest(tas, F.lit(1.0)), h, delta_isa) * area, F.lit(1e-6))


def banked_lift_coefficient(mass: Column, area: Column, tas: Column, h: Column, gamma: Column, bank: Column, delta_isa: Column) -> Column:
    return lift_coefficient(mass, area, tas, h, gamma, delta_isa) / F.greatest(F.cos(bank), F.lit(0.2))


def thrust_ceiling_n(max_thrust: Column, idle: Column, mode: Column, tas: Column, h: Column, delta_isa: Column) -> Column:
    """Greatest thrust: falls with density and speed, and by phase. Exponent, relief and phase scales."""
    thin = F.greatest(F.least(density(h, delta_isa) / RHO0, F.lit(1.25)), F.lit(0.05))
    relief = F.greatest(1.0 - 0.0008 * F.greatest(tas / 0.514444 - 120.0, F.lit(0.0)), F.lit(0.35))
    phase = F.when(mode == "clean", 1.0).when(mode == "approach", 0.92).otherwise(0.85)
    return F.greatest(max_thrust * F.pow(thin, F.lit(0.75)) * relief * phase, idle + 1.0)


def mode_at(s: Column, final_gate_m: float = 12_000.0, approach_gate_m: float = 35_000.0) -> Column:
    """Mode by distance to go: final, approach, else clean."""
    return F.when(s <= final_gate_m, "final").when(s <= approach_gate_m, "approach").otherwise("clean")


def stall_cas(v_ref: Column, mass: Column, reference_mass: Column) -> Column:
    return v_ref * F.sqrt(mass / reference_mass)


def cas_floor(cas_min: Column, stall: Column) -> Column:
    return F.greatest(F.coalesce(cas_min, F.lit(0.0)), stall)


def cas_ceiling(cas_max: Column) -> Column:
    return F.coalesce(cas_max, F.lit(float("inf")))


def stall_bank_limit(stall: Column, cas: Column, factor: float = 1.3) -> Column:
    """Bank at which the stall margin is used up; 0 at no speed."""
    share = F.pow(factor * stall / F.nullif(cas, F.lit(0.0)), F.lit(2.0))
    return F.when(cas <= 0, 0.0).otherwise(F.acos(F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))))


def bank_limit(comfort: Column, procedure: Column, stall: Column, cas: Column) -> Column:
    return F.least(comfort, procedure, stall_bank_limit(stall, cas))


def target_cas(mode: Column, clean: Column, approach: Column, final: Column, h: Column, limit_h: float = 3048.0, limit_cas: float = 250 * 0.514444) -> Column:
    """The mode's target, at most limit_cas at or below limit_h."""
    own = F.when(mode == "clean", clean).when(mode == "approach", approach).otherwise(final)
    return F.when(h <= limit_h, F.least(own, F.lit(limit_cas))).otherwise(own)


def ground_speed(tas: Column, wind_along: Column) -> Column:
    return F.greatest(tas + wind_along, F.lit(1.0))


def distance_rates(tas: Column, gamma: Column, thrust: Column, drag: Column, mass: Column, wind_along: Column) -> Column:
    """struct(dh_ds, dv_ds, dt_ds) by path distance s of a flight path angle, net force and ground speed."""
    ground = ground_speed(F.greatest(tas, F.lit(1.0)), wind_along)
    dv = (thrust - drag) / mass - G0 * F.sin(gamma)
    return F.struct((-F.tan(gamma)).alias("dh_ds"), (-dv / (F.greatest(tas, F.lit(1.0)) * F.greatest(F.cos(gamma), F.lit(0.05)))).alias("dv_ds"), (1.0 / ground).alias("dt_ds"))


def cubic_height(x: Column, length: Column, h0: Column, h1: Column, slope0: Column, slope1: Column) -> Column:
    """Hermite cubic over [0, length] from h0 to h1 with end slopes."""
    u = x / length
    return (2 * u * u * u - 3 * u * u + 1) * h0 + (u * u * u - 2 * u * u + u) * length * slope0 + (3 * u * u - 2 * u * u * u) * h1 + (u * u * u - u * u) * length * slope1


def cubic_slope(x: Column, length: Column, h0: Column, h1: Column, slope0: Column, slope1: Column) -> Column:
    u = x / length
    return (6 * u * u - 6 * u) * (h0 - h1) / length + (3 * u * u - 4 * u + 1) * slope0 + (3 * u * u - 2 * u) * slope1


def top_of_descent_guess(drop_m: Column, gamma: Column, most_m: Column) -> Column:
    """Length of a descent of at least three degrees, between 1 km and most_m."""
    return F.greatest(F.least(drop_m / F.tan(F.greatest(F.abs(gamma), F.lit(math.radians(3.0)))), most_m), F.lit(1000.0))


def roll_rate(bank: Column, wanted: Column, tau: Column, most: Column) -> Column:
    return F.greatest(F.least((wanted - bank) / tau, most), -most)


def heading_rate(bank: Column, tas: Column) -> Column:
    return G0 * F.tan(bank) / F.greatest(tas, F.lit(1.0))


def approach_mass_kg(landing_limit: Column, empty: Column, payload: Column) -> Column:
    return F.least(landing_limit, empty + payload)


def speed_targets(clean: Column, approach: Column, final: Column) -> Column:
    """struct(clean, approach, final); a missing one takes the first of the others that there is, in that order."""
    every = F.coalesce(clean, approach, final)
    return F.struct(F.coalesce(clean, every).alias("clean"), F.coalesce(approach, every).alias("approach"), F.coalesce(final, every).alias("final"))
