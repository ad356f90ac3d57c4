"""Two-phase conductance on cell grids: coarsening, conductivity, finite-volume assembly and solution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PHASES = ("open_space", "buildings")


def coarsened(cells: DataFrame, factor: int) -> DataFrame:
    """site, y, x, fraction: share of each block that is occupied; padding counts as empty."""
    return cells.groupBy("site", F.expr(f"y div {factor}").alias("y"), F.expr(f"x div {factor}").alias("x")).agg((F.count(F.lit(1)) / F.lit(float(factor * factor))).alias("fraction"))


def coarsening_factor(active: int, most: int = 250_000) -> int:
    return max(1, int(np.ceil(np.sqrt(active / most))))


def transport_grid(cells: DataFrame, domain: DataFrame, most: int = 250_000) -> DataFrame:
    """site, y, x, fraction, factor: each site's grid, coarsened by the least factor that leaves about ``most`` domain cells.

    A coarse cell belongs to the domain if half of it or more does (padding does
    not), and its fraction is that of its domain cells that are occupied.
    """
    active = domain.groupBy("site").agg(F.count(F.lit(1)).alias("active_"))
    factor = F.greatest(F.lit(1).cast("long"), F.ceil(F.sqrt(F.col("active_") / float(most)))) if most > 0 else F.lit(1).cast("long")
    marked = domain.select("site", "y", "x").join(cells.select("site", "y", "x", F.lit(1).alias("m_")).distinct(), ["site", "y", "x"], "left").join(active, "site").withColumn("factor", factor)
    coarse = marked.groupBy("site", "factor", F.expr("y div factor").alias("y"), F.expr("x div factor").alias("x")).agg(F.count(F.lit(1)).alias("room_"), F.count("m_").alias("full_"))
    return coarse.where(F.col("room_") >= 0.5 * F.col("factor") * F.col("factor")).select("site", "y", "x", (F.col("full_") / F.col("room_")).alias("fraction"), "factor")


def conductivity(fraction: Column, contrast: float, phase: str) -> Column:
    """Log mixture of the phases' conductivities 1 and 1 / contrast by the building fraction."""
    if contrast <= 1:
        raise ValueError("contrast must exceed 1")
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase}")
    poor = np.log(1.0 / contrast)
    return F.exp((fraction if phase == "open_space" else 1 - fraction) * F.lit(float(poor)))


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def conductance_edges(k: DataFrame) -> DataFrame:
    """site, y, x, to_y, to_x, g: right and lower neighbours, by two equi-joins."""
    out = None
    for dy, dx in ((0, 1), (1, 0)):
        other = k.select("site", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("k").alias("k2"))
        e = k.join(other, ["site", "y", "x"]).select("site", "y", "x", (F.col("y") + dy).alias("to_y"), (F.col("x") + dx).alias("to_x"), harmonic(F.col("k"), F.col("k2")).alias("g"))
        out = e if out is None else out.unionByName(e)
    return out


def assembled(k: DataFrame, direction: str = "lr") -> DataFrame:
    """site, y, x, diagonal, rhs of the unknowns for a unit potential on the domain's first column (or row, for tb) and 0 on its last."""
    along = {"lr": "x", "tb": "y"}[direction]
    e = conductance_edges(k)
    both = e.select("site", "y", "x", F.col(f"to_{along}").alias("other"), "g").unionByName(e.select("site", F.col("to_y").alias("y"), F.col("to_x").alias("x"), F.col(along).alias("other"), "g"))
    sides = k.groupBy("site").agg(F.min(along).alias("first"), F.max(along).alias("last"))
    inner = both.join(sides, "site").where((F.col(along) > F.col("first")) & (F.col(along) < F.col("last")))
    return inner.groupBy("site", "y", "x").agg(F.sum("g").alias("diagonal"), F.sum(F.when(F.col("other") == F.col("first"), F.col("g")).otherwise(0.0)).alias("rhs"))


def _anchored(domain: np.ndarray, first: int, last: int) -> np.ndarray:
    """The cells of 4-connected components that reach one of the two side columns: the others' potential is undetermined."""
    from .topology import _labels

    edge = np.diff(np.pad(domain, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(edge == 1)
    x1 = np.nonzero(edge == -1)[1] - 1
    label = _labels(y, x0, x1, 0)
    reach = np.unique(label[(x0 <= first) | (x1 >= last)])
    out = domain.copy()
    for i in np.flatnonzero(~np.isin(label, reach)).tolist():
        out[y[i], x0[i] : x1[i] + 1] = False
    return out


def solve(k: np.ndarray, domain: np.ndarray, direction: str, tolerance: float = 1e-10, rounds: int = 20_000) -> dict:
    """Conductance between two opposite sides by Jacobi-preconditioned conjugate gradients on the five-point stencil."""
    if direction == "tb":
        k, domain = k.T, domain.T
    k = np.where(domain, k, 0.0)
    rows, cols = np.nonzero(domain)
    if not len(rows):
        raise ValueError("the domain is empty")
    first, last = cols.min(), cols.max()
    if first == last:
        raise ValueError("the two sides coincide: no potential can be imposed")
    anchored = _anchored(domain, first, last)
    excluded = int(domain.sum() - anchored.sum())
    domain = anchored
    k = np.where(domain, k, 0.0)
    side = np.zeros(k.shape, bool)
    side[:, first], side[:, last] = domain[:, first], domain[:, last]
    with np.errstate(invalid="ignore", divide="ignore"):
        gx = np.nan_to_num(2 * k[:, 1:] * k[:, :-1] / (k[:, 1:] + k[:, :-1]))
        gy = np.nan_to_num(2 * k[1:] * k[:-1] / (k[1:] + k[:-1]))
    diagonal = np.zeros(k.shape)
    diagonal[:, :-1] += gx
    diagonal[:, 1:] += gx
    diagonal[:-1] += gy
    diagonal[1:] += gy
    free = domain & ~side & (diagonal > 0)

    def apply(u):
        out = diagonal * u
        out[:, :-1] -= gx * u[:, 1:]
        out[:, 1:] -= gx * u[:, :-1]
        out[:-1] -= gy * u[1:]
        out[1:] -= gy * u[:-1]
        return out

    u = np.zeros(k.shape)
    u[:, first] = domain[:, first]
    r = np.where(free, -apply(u), 0.0)
    norm = np.linalg.norm(r)
    inverse = np.where(free, 1 / np.where(diagonal > 0, diagonal, 1), 0.0)
    z = inverse * r
    p, rz, n = z.copy(), float((r * z).sum()), 0
    while norm and np.linalg.norm(r) > tolerance * norm and n < rounds and rz > 0:
        q = np.where(free, apply(p), 0.0)
        a = rz / float((p * q).sum())
        u += a * p
        r -= a * q
        z = inverse * r
        new = float((r * z).sum())
        p = z + new / rz * p
        rz = new
        n += 1
    energy = float((gx * np.diff(u, axis=1) ** 2).sum() + (gy * np.diff(u, axis=0) ** 2).sum())
    flux = float((gx[:, first] * (u[:, first] - u[:, first + 1])).sum()) if first < k.shape[1] - 1 else 0.0
    found = {"conductance": flux, "energy": energy, "iterations": n, "converged": bool(not norm or np.linalg.norm(r) <= 10 * tolerance * norm)}
    return found | {"unknown_cells": int(free.sum()), "excluded_unanchored_cells": excluded, "active_cells": int(domain.sum()), "bbox": (k.shape[1] - 1) / k.shape[0] * flux, "potential": u.T if direction == "tb" else u}


#: Cells that one site's grid may have: what a solving task holds.
MOST_CELLS = 4_000_000
RESULT = (
    "site long, phase string, contrast double, direction string, conductance double, resistance double, relative_conductance double, homogeneous_conductance double, energy_error double, effective_conductivity_bbox double,"
    " active_cells long, unknown_cells long, excluded_unanchored_cells long, iterations long, converged boolean"
)


def _site_grid(pdf: pd.DataFrame, n_rows: int, n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    if n_rows * n_cols > MOST_CELLS:
        raise ValueError(f"a grid of {n_rows * n_cols} cells is too large for one task; coarsen it first")
    domain, f = np.zeros((n_rows, n_cols), bool), np.zeros((n_rows, n_cols))
    domain[pdf["y"], pdf["x"]] = True
    f[pdf["y"], pdf["x"]] = pdf["fraction"]
    return domain, f


def conductances(fractions: DataFrame, n_rows: int, n_cols: int, contrasts=(1000.0,), phases=PHASES, directions=("lr", "tb")) -> DataFrame:
    """A row for each site, phase, contrast and direction; the homogeneous grid is solved once per direction.

    fractions(site, y, x, fraction) holds the domain's cells. A site's grid is
    one group, of MOST_CELLS cells at most: callers coarsen it first.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        domain, f = _site_grid(pdf, n_rows, n_cols)
        rows = []
        for direction in directions:
            base = solve(np.ones(f.shape), domain, direction)["conductance"]
            for phase in phases:
                for contrast in contrasts:
                    k = np.exp((f if phase == "open_space" else 1 - f) * np.log(1 / contrast))
                    s = solve(k, domain, direction)
                    g = s["conductance"]
                    rows.append((int(pdf["site"].iloc[0]), phase, contrast, direction, g, 1 / g if g > 0 else np.inf, g / base if base > 0 else None, base, abs(s["energy"] - g) / max(abs(g), 1e-15), s["bbox"], s["active_cells"], s["unknown_cells"], s["excluded_unanchored_cells"], s["iterations"], s["converged"]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return fractions.groupBy("site").applyInPandas(run, RESULT)


def potentials(fractions: DataFrame, n_rows: int, n_cols: int, phase: str, contrast: float, direction: str) -> DataFrame:
    """site, y, x, u: the potential of every domain cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        domain, f = _site_grid(pdf, n_rows, n_cols)
        u = solve(np.exp((f if phase == "open_space" else 1 - f) * np.log(1 / contrast)), domain, direction)["potential"]
        y, x = np.nonzero(domain)
        return pd.DataFrame({"site": pdf["site"].iloc[0], "y": y, "x": x, "u": u[y, x]})

    return fractions.groupBy("site").applyInPandas(run, "site long, y long, x long, u double")


def dissipation(k: DataFrame, u: DataFrame, direction: str = "lr") -> DataFrame:
    """site, energy, flux of potentials u(site, y, x, u) on conductivities k(site, y, x, k): the sum of g du^2 over all edges, and of g du over those that leave the source side."""
    along = {"lr": "x", "tb": "y"}[direction]
    e = conductance_edges(k)
    a = u.withColumnRenamed("u", "ua")
    b = u.select("site", F.col("y").alias("to_y"), F.col("x").alias("to_x"), F.col("u").alias("ub"))
    source = k.groupBy("site").agg(F.min(along).alias("first"))
    du = F.col("ua") - F.col("ub")
    leaves = (F.col(along) == F.col("first")) & (F.col(f"to_{along}") > F.col("first"))
    return e.join(a, ["site", "y", "x"]).join(b, ["site", "to_y", "to_x"]).join(source, "site").groupBy("site").agg(F.sum(F.col("g") * du * du).alias("energy"), F.sum(F.when(leaves, F.col("g") * du)).alias("flux"))


def by_direction(results: DataFrame) -> DataFrame:
    """One row for each site, phase and contrast with both directions and their anisotropy."""
    wide = results.groupBy("site", "phase", "contrast").pivot("direction", ["lr", "tb"]).agg(F.first("relative_conductance"))
    return wide.withColumn("anisotropy", F.when((F.col("lr") > 0) & (F.col("tb") > 0), F.greatest("lr", "tb") / F.least("lr", "tb")))


def transport_summary(results: DataFrame) -> DataFrame:
    """site, status and greatest energy error, with the anisotropy lr / tb of each phase's relative conductance at each contrast, as rows."""
    own = results.groupBy("site").agg(F.when(F.bool_and("converged"), "ok").otherwise("solver_warning").alias("status"), F.max("energy_error").alias("max_energy_identity_relative_error"))
    wide = results.groupBy("site", "phase", "contrast").pivot("direction", ["lr", "tb"]).agg(F.first("relative_conductance"))
    return wide.withColumn("anisotropy_relative_conductance", F.col("lr") / F.nullif(F.col("tb"), F.lit(0.0))).drop("lr", "tb").join(own, "site")
