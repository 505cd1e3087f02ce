"""Vocabularies and policies shared by operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Status, lane and relation vocabularies of the data contract.
CLOSED_STATUSES = ("closed", "done", "completed", "resolved")
CONTEXT_CLOSED_STATUSES = (*CLOSED_STATUSES, "canceled", "cancelled", "duplicate")
ACTIVE_STATUSES = ("open", "in_progress", "blocked", "deferred")
COLLISION_STATUSES = ("open", "in_progress", "blocked")
LANES = ("dependency", "echo", "overlap")
OVERLAP, ECHO = "possible-overlap", "completed-work-echo"
NO_LINK = "none recorded"


@dataclass(frozen=True)
class CandidatePolicy:
    """Thresholds and caps of a review run, checked when it is made."""

    # The defaults of the contract.
    echo_threshold: float = 0.72
    overlap_threshold: float = 0.82
    exception_margin: float = 0.08
    reciprocal_rank: int = 5
    max_per_issue: int = 3
    max_echoes_per_target: int = 2
    max_echo_alternatives_per_active: int = 3
    max_dependencies_per_issue: int = 3
    max_total: int = 250
    max_dependencies: int = 75
    max_echoes: int = 125
    max_overlaps: int = 125
    lane_reservations: dict[str, int] | None = None
    baseline_echo_threshold: float = 0.72
    baseline_overlap_threshold: float = 0.82
    objectives: frozenset[str] | None = None

    def __post_init__(self) -> None:
        for name in ("echo_threshold", "overlap_threshold", "baseline_echo_threshold", "baseline_overlap_threshold"):
            if not -1.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be between -1 and 1")
        if not 0.0 <= self.exception_margin <= 2.0:
            raise ValueError("exception_margin must be between 0 and 2")
        for name in ("reciprocal_rank", "max_dependencies_per_issue", "max_dependencies", "max_echoes", "max_overlaps"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("max_per_issue", "max_echoes_per_target", "max_echo_alternatives_per_active", "max_total"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.lane_reservations is not None:
            if set(self.lane_reservations) != set(LANES):
                raise ValueError("lane_reservations must name every lane")
            if sum(self.lane_reservations.values()) > self.max_total or min(self.lane_reservations.values()) < 0:
                raise ValueError("lane_reservations must fit the total cap")
            caps = zip(LANES, (self.max_dependencies, self.max_echoes, self.max_overlaps), strict=True)
            if any(self.lane_reservations[lane] > cap for lane, cap in caps):
                raise ValueError("lane_reservations must fit the lanes' caps")
        if self.objectives is not None and not self.objectives <= {"collision", "overlap", "echo", "structure"}:
            raise ValueError("unknown objective")

    @property
    def legacy(self) -> bool:
        return self.objectives is None

    def wants(self, objective: str) -> bool:
        return self.objectives is None or objective in self.objectives

    @property
    def looser(self) -> bool:
        """Whether a threshold is below the baseline, whose queue is then protected."""
        return self.echo_threshold < self.baseline_echo_threshold or self.overlap_threshold < self.baseline_overlap_threshold

    @property
    def stricter(self) -> bool:
        return self.echo_threshold > self.baseline_echo_threshold or self.overlap_threshold > self.baseline_overlap_threshold

    @property
    def baseline(self) -> CandidatePolicy:
        """This policy at the baseline's thresholds."""
        return replace(self, echo_threshold=self.baseline_echo_threshold, overlap_threshold=self.baseline_overlap_threshold)

    @property
    def lane_caps(self) -> dict[str, int]:
        caps = {"dependency": self.max_dependencies, "echo": self.max_echoes, "overlap": self.max_overlaps}
        named = {"dependency": "structure", "echo": "echo", "overlap": "overlap"}
        return {lane: cap if self.wants(named[lane]) else 0 for lane, cap in caps.items()}
