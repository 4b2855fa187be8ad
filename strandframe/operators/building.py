"""Cartesian coordinates from internal ones, one chain at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def place(a: np.ndarray, b: np.ndarray, c: np.ndarray, r: float, planar: float, dihedral: float) -> np.ndarray:
    """The point at distance r from c, angle planar at c and dihedral about b-c, in radians."""
    bc = (c - b) / np.linalg.norm(c - b)
    n = np.cross(b - a, bc)
    n /= np.linalg.norm(n)
    bend = np.pi - planar
    return c + r * (np.cos(bend) * bc + np.sin(bend) * (np.cos(dihedral) * np.cross(n, bc) + np.sin(dihedral) * n))


def first_three(r1: float, r2: float, planar: float) -> np.ndarray:
    """The first atom at the origin, the second on x, the third in the xy plane."""
    return np.array([[0, 0, 0], [r1, 0, 0], [r1 + r2 * np.cos(np.pi - planar), r2 * np.sin(np.pi - planar), 0]], dtype=float)


def build_order(topology: np.ndarray) -> list[int]:
    """The atoms from the fourth on, each after the three that it stands on; raises where atoms stand on one another in a ring."""
    n = len(topology)
    waits = [[] for _ in range(n)]
    left = [0] * n
    for i in range(3, n):
        for j in set(topology[i]):
            if j >= 3:
                waits[j].append(i)
                left[i] += 1
    ready = [i for i in range(3, n) if not left[i]]
    for i in ready:  # grows as atoms are placed
        for j in waits[i]:
            left[j] -= 1
            if not left[j]:
                ready.append(j)
    if len(ready) < n - 3:
        raise ValueError("atoms stand on one another in a ring")
    return ready


def restore(r: np.ndarray, planar: np.ndarray, dihedral: np.ndarray, topology: np.ndarray | None = None) -> np.ndarray:
    """Positions of all atoms. topology: (a, b, c) numbers of each atom's references, earlier or later; the three before it without one."""
    n = len(r)
    out = np.zeros((n, 3))
    out[:3] = first_three(r[1] if n > 1 else 0, r[2] if n > 2 else 0, planar[2] if n > 2 else np.pi)[:n]
    for i in range(3, n) if topology is None else build_order(topology):
        a, b, c = (i - 3, i - 2, i - 1) if topology is None else topology[i]
        out[i] = place(out[a], out[b], out[c], r[i], planar[i], dihedral[i])
    return out


def build_chains(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, x, y, z from keys, ord, r, planar, dihedral (radians) and, if present, a, b, c: reference ords.

    A chain is one group, which its own length bounds; chains are built side by side.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in atoms.select(*keys).schema)
    has_topology = {"a", "b", "c"} <= set(atoms.columns)

    def one(pdf):
        import pandas as pd

        pdf = pdf.sort_values("ord")
        topology = None
        if has_topology:
            at = {o: i for i, o in enumerate(pdf["ord"])}
            topology = np.array([[at.get(x, 0) for x in row] for row in pdf[["a", "b", "c"]].to_numpy()], dtype=int)
        xyz = restore(pdf["r"].to_numpy(float), pdf["planar"].to_numpy(float), pdf["dihedral"].to_numpy(float), topology)
        out = pd.DataFrame({"ord": pdf["ord"].to_numpy("int64"), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return atoms.groupBy(*keys).applyInPandas(one, f"{kinds}, ord long, x double, y double, z double")


#: Bond lengths (A) and planar angles (degrees) of an extended peptide's N, CA and C.
BACKBONE = {"N": (1.329, 116.6), "CA": (1.458, 121.7), "C": (1.525, 111.0)}


def backbone_definition(n_residues: int, phi: float, psi: float, omega: float = 180.0) -> list[tuple[int, str, float, float, float]]:
    """(ord, name, r, planar, dihedral) rows, in radians, of a chain of N, CA and C atoms."""
    dihedral = {"N": psi, "CA": omega, "C": phi}
    rows = []
    for i in range(n_residues):
        for k, name in enumerate(("N", "CA", "C")):
            r, planar = BACKBONE[name]
            rows.append((3 * i + k, name, r, float(np.radians(planar)), float(np.radians(dihedral[name]))))
    return rows
