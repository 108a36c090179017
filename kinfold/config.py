"""What a run of the linkage can be told."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from typing import Any

from kinfold.functions.vocabulary import NICKNAMES


@dataclass(frozen=True)
class Config:
    """The knobs of a run; ``with_changes`` merges a mapping over them, name by name.

    ``nicknames`` are pairs of a short form and a formal name. ``strict_refusals`` turns every
    refusal by rule into a constraint that clusters honour too; it is off by default.
    """

    review_threshold: float = 0.85
    name_gate: float = 0.8
    source_trust: tuple[str, ...] = ("crm-export", "enrichment", "form-fill", "event-list", "purchased-list")
    blocking: bool = True
    max_block_size: int = 200
    default_phone_region: str = "US"
    nicknames: tuple[tuple[str, str], ...] = field(default=NICKNAMES, repr=False)
    strict_refusals: bool = False
    #: Rows up to which every pair may be compared when ``blocking`` is off.
    exhaustive_limit: int = 20_000

    def __post_init__(self) -> None:
        for name in ("review_threshold", "name_gate"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 <= value <= 1:
                raise ValueError(f"{name} must be a number from 0 to 1, not {value!r}")
        if isinstance(self.max_block_size, bool) or not isinstance(self.max_block_size, int) or self.max_block_size < 2:
            raise ValueError(f"max_block_size must be a whole number of 2 or more, not {self.max_block_size!r}")
        if not isinstance(self.blocking, bool):
            raise ValueError("blocking must be true or false")
        if isinstance(self.source_trust, str) or not all(isinstance(s, str) for s in self.source_trust):
            raise ValueError("source_trust must be a list of names")

    def with_changes(self, changes: dict[str, Any] | None) -> Config:
        known = asdict(self)
        if unknown := set(changes or {}) - set(known):
            raise ValueError(f"no such setting: {', '.join(sorted(unknown))}")
        merged = {k: getattr(self, k) for k in known} | dict(changes or {})
        return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items()})

    def described(self) -> dict[str, Any]:
        """The settings that identify a run."""
        return {
            "reviewThreshold": self.review_threshold,
            "nameGate": self.name_gate,
            "sourceTrust": list(self.source_trust),
            "blocking": self.blocking,
            "maxBlockSize": self.max_block_size,
            "defaultPhoneRegion": self.default_phone_region,
        }
