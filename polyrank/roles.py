"""Which column of a candidate table plays which role."""

from __future__ import annotations

from dataclasses import dataclass

#: A candidate whose truth is at least this is acceptable; medium and high quality start at the next two.
ACCEPTABLE, MEDIUM, HIGH = 0.23, 0.49, 0.80


@dataclass(frozen=True)
class Roles:
    """group and key identify a candidate; truth is used as a label only; ties are broken by ``ties``, ascending."""

    group: str = "g"
    key: str = "id"
    score: str = "score"
    truth: str = "truth"
    rank: str = "rank"
    fold: str = "fold"
    ties: tuple[str, ...] = ("id",)
    threshold: float = ACCEPTABLE


DEFAULT = Roles()
