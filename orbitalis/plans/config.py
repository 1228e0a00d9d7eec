"""Configuration of walks and runs, with named dialects.

Simulation codes disagree on when a cell stands for its bodies and on how steps
are put together.  A dialect names one such set of choices:

- body:      the side is compared with the distance to each body; far leaves
             count as one mass; a cell that holds the body is never accepted
- body_soft: as body with the softened distance and without that guard
- body_exact: only inner cells are accepted; leaves are always opened
- leaf_box:  leaves are targets; the distance is that of the leaf's middle less
             its half diagonal; leaves are always opened; second moments count
- bucket:    leaves are targets; a cell is opened if its radius reaches the
             leaf's centre of mass over the opening angle; halving cells
"""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass

DIALECTS = {
    "body": {"mac": "body", "guard": True, "exact_leaves": False, "leaf_size": 16, "theta": 0.5, "softening": 1e-11},
    "body_soft": {"mac": "body", "soft_mac": True, "guard": False, "exact_leaves": False, "leaf_size": 1, "theta": 0.5, "integrator": "drift_first"},
    "body_exact": {"mac": "body", "guard": False, "exact_leaves": True, "leaf_size": 8, "theta": 0.5, "softening": 1e-3, "integrator": "leapfrog_fused"},
    "leaf_box": {"mac": "leaf_box", "guard": False, "exact_leaves": True, "leaf_size": 8, "theta": 0.5, "quadrupole": True, "integrator": "leapfrog_fused"},
    "bucket": {"mac": "bucket", "guard": False, "exact_leaves": False, "leaf_size": 10, "theta": 0.5, "softening": 0.05, "digit": 1, "integrator": "split_kick"},
}


@dataclass(frozen=True)
class SimConfig:
    dialect: str = "body"
    mac: str = "body"
    soft_mac: bool = False
    guard: bool = True
    exact_leaves: bool = False
    quadrupole: bool = False
    digit: int = 3
    theta: float = 0.5
    leaf_size: int = 16
    softening: float = 0.0
    max_depth: int = 21
    gravity: float = 1.0
    algorithm: str = "tree"
    strategy: str = "auto"  # auto: relational; partitioned for mac "body" without second moments, "leaf_box" with them, from arrow_from bodies on
    arrow_from: int = 3_000
    integrator: str = "kdk"
    dt: float = 0.01
    steps: int = 1
    energy_every: int = 1
    snapshot_every: int = 0
    snapshot_path: str = ""
    pad: float = 0.0

    @classmethod
    def of(cls, dialect: str = "body", **more) -> SimConfig:
        """A dialect's preset with changes; unknown keys are errors."""
        if dialect not in DIALECTS:
            raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(DIALECTS)}")
        known = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(more) - known:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        return cls(**{"dialect": dialect, **DIALECTS[dialect], **more}).checked()

    @classmethod
    def from_toml(cls, text: str, **more) -> SimConfig:
        return cls.of(**{**tomllib.loads(text), **more})

    @classmethod
    def from_namelist(cls, text: str, aliases: dict[str, str] | None = None) -> SimConfig:
        """From a Fortran namelist: `name = value` entries; d-exponents, .true. and .false. are read."""
        found: dict = {}
        for line in text.splitlines():
            line = line.split("!")[0].strip().rstrip(",")
            if "=" not in line or line[:1] in "&/":
                continue
            name, value = (x.strip() for x in line.split("=", 1))
            name, low = (aliases or {}).get(name.lower(), name.lower()), value.lower().strip(",")
            if low in (".true.", ".false."):
                found[name] = low == ".true."
            elif low[:1] in "'\"":
                found[name] = value.strip("'\"")
            else:
                number = float(low.replace("d", "e"))
                found[name] = int(number) if number.is_integer() and not set(low) & set(".de") else number
        return cls.of(**found)

    def checked(self) -> SimConfig:
        if self.theta < 0 or self.leaf_size < 1 or self.steps < 0 or self.softening < 0:
            raise ValueError("theta, softening and steps are not negative, and leaves hold a body at least")
        if self.algorithm not in ("tree", "direct") or self.strategy not in ("auto", "relational", "arrow", "partitioned"):
            raise ValueError("algorithm is tree or direct; strategy is auto, relational, arrow or partitioned")
        if self.mac not in ("body", "leaf_box", "bucket") or self.digit not in (1, 3):
            raise ValueError("mac is body, leaf_box or bucket; digit is 1 or 3")
        return self

    @property
    def depth(self) -> int:
        """The greatest depth of cells, in digits."""
        return min(self.max_depth * 3, 63) if self.digit == 1 else min(self.max_depth, 21)
