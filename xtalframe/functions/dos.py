"""Density of states at the Fermi level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xtalframe.functions.once import let


def dos_at_fermi(dos: Column) -> Column:
    """Total density of states at ``efermi``, interpolated, summed over spins.

    Null without a document, a Fermi level or energies; 0.0 when the Fermi
    level lies outside the energies.
    """
    fermi, energies = dos["efermi"], dos["energies"]

    def between(points: Column, n_below: Column) -> Column:
        low, high = F.try_element_at(points, n_below), F.try_element_at(points, n_below + 1)
        part = (fermi - low["e"]) / (high["e"] - low["e"])
        return F.when(low["e"] == fermi, low["v"]).otherwise(
            low["v"] + part * (high["v"] - low["v"])
        )

    def one_spin(values: Column) -> Column:
        points = F.array_sort(
            F.zip_with(energies, values, lambda e, v: F.struct(e.alias("e"), v.alias("v")))
        )
        return let(
            points,
            lambda ps: let(
                F.size(F.filter(ps, lambda p: p["e"] <= fermi)), lambda n: between(ps, n)
            ),
        )

    total = F.aggregate(
        F.map_values(dos["densities"]), F.lit(0.0), lambda acc, values: acc + one_spin(values)
    )
    usable = dos.isNotNull() & fermi.isNotNull() & (F.size(energies) > 0)
    inside = fermi.between(F.array_min(energies), F.array_max(energies))
    return F.when(usable & inside, total).when(usable & ~inside, F.lit(0.0))


def is_metal(band_gap: Column) -> Column:
    """Gap exactly zero; null for an unknown gap."""
    return band_gap == F.lit(0.0)


def energy_per_site(energy: Column, num_sites: Column) -> Column:
    """Energy divided by the number of sites; unchanged for zero sites."""
    return F.when(num_sites > 0, energy / num_sites).otherwise(energy)
