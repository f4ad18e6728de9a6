"""Radiative formulas as Column builders (5S family); every argument is a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard atmosphere.
PRESSURE_0, LAPSE, TEMPERATURE_0, EXPONENT = 1013.25, 6.5, 288.15, 5.255


def forward(rho_unif: Column, rho_atm: Column, t_up: Column, t_down: Column, sph_alb: Column) -> Column:
    """Top-of-atmosphere reflectance of a uniform surface; ``t_*``: total transmittances."""
    return rho_atm + t_up * t_down * rho_unif / (1 - sph_alb * rho_unif)


def inverse(rho_toa: Column, rho_atm: Column, t_up: Column, t_down: Column, sph_alb: Column) -> Column:
    """Uniform-surface reflectance from the top of the atmosphere."""
    signal = rho_toa - rho_atm
    return signal / (sph_alb * signal + t_up * t_down)


def surface(rho_unif: Column, rho_env: Column, tdir_up: Column, tdif_up: Column, sph_alb: Column) -> Column:
    """Pixel reflectance once the environment's share is known."""
    total = rho_unif * (tdir_up + tdif_up) * (1 - rho_env * sph_alb) / (1 - rho_unif * sph_alb)
    return (total - rho_env * tdif_up) / tdir_up


def toa_with_environment(rho_s: Column, rho_env: Column, rho_atm: Column, t_down: Column, tdir_up: Column, tdif_up: Column, sph_alb: Column) -> Column:
    return rho_atm + t_down * (tdir_up * rho_s + tdif_up * rho_env) / (1 - sph_alb * rho_env)


def direct_transmittance(optical_depth: Column, zenith_deg: Column) -> Column:
    return F.exp(-optical_depth / F.cos(F.radians(zenith_deg)))


def surface_pressure(h_km: Column) -> Column:
    return PRESSURE_0 * F.pow(1 - LAPSE * h_km / TEMPERATURE_0, F.lit(EXPONENT))


def rayleigh_depth(wl_nm: Column, pressure: Column) -> Column:
    """A published fourth-power fit with two corrections, scaled by pressure."""
    um2 = F.pow(wl_nm / 1000.0, F.lit(-2.0))
    return 0.008569 * um2 * um2 * (1 + 0.0113 * um2 + 0.00013 * um2 * um2) * pressure / PRESSURE_0


def aerosol_depth(aot: Column, wl_nm: Column, angstrom: Column) -> Column:
    """Angstrom's law about 560 nm."""
    return aot * F.pow(wl_nm / 560.0, -angstrom)


def digitize(value: Column, low: Column, high: Column, levels: int) -> Column:
    """Nearest of ``levels`` equidistant values; ties go up, NaN goes to the top."""
    step = (high - low) / (levels - 1)
    at = F.least(F.lit(float(levels - 1)), F.floor((value - low) / step + 0.5).cast("double"))
    return F.when(F.isnan(value), high).when(step == 0, low).otherwise(low + step * at)


def satellite_offset(height: Column, vza: Column, vaa: Column) -> tuple[Column, Column]:
    """Ground offset of the satellite, to four decimals."""
    ground = height * F.tan(F.radians(vza))
    return F.bround(ground * F.cos(F.radians(180 - vaa)), 4), F.bround(ground * F.sin(F.radians(180 - vaa)), 4)


def local_estimates(sza: Column, saa: Column, vza: Column) -> tuple[Column, Column]:
    """Directions of sun and satellite; both carry the sun's azimuth."""
    return F.struct(sza.alias("th_deg"), saa.alias("phi_deg")), F.struct(vza.alias("th_deg"), saa.alias("phi_deg"))


def sensor(gx: Column, gy: Column, vza: Column, vaa: Column, height: Column) -> dict[str, Column]:
    """A sensor that looks at the ground point."""
    ground, a = height * F.tan(F.radians(vza)), F.radians(vaa)
    return {"pos_x": gx + ground * F.cos(a), "pos_y": gy + ground * F.sin(a), "pos_z": height, "th_deg": 180 - vza, "ph_deg": F.pmod(vaa + 180, F.lit(360.0))}


def radial_sensor(r: Column, vza: Column, vaa: Column, height: Column) -> dict[str, Column]:
    """A sensor for a ground point at distance ``r`` on the axis across the viewing azimuth."""
    a = F.radians(vaa)
    return sensor(-r * F.sin(a), r * F.cos(a), vza, vaa, height)


def radial_weight(r: Column, r_min: Column) -> Column:
    return 1 / (2 * F.pi() * F.greatest(r_min, r))


def two_stream(depth: Column, asymmetry: Column) -> Column:
    """Total transmittance of a conservative layer (two-stream closed form)."""
    return 1 / (1 + (1 - asymmetry) * depth * 0.75)
