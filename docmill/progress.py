"""Progress of a synchronisation."""

from __future__ import annotations

from dataclasses import dataclass, field

# The stages in order with their share of a document's work in percent.
STAGES = {"parsing": 5, "chunking": 5, "enriching": 45, "embedding": 20, "saving": 5, "merging_entities": 10, "merging_relationships": 10}


@dataclass
class DocumentProgress:
    name: str
    stage: str = ""
    done: int = 0
    total: int = 0

    @property
    def percent(self) -> int:
        """What the stages before and the done part of this one come to; an unknown stage is nothing yet."""
        if self.stage == "done":
            return 100
        names = list(STAGES)
        if self.stage not in names:
            return 0
        part = self.done / self.total if self.total > 0 else 0
        return min(100, int(sum(STAGES[n] for n in names[: names.index(self.stage)]) + STAGES[self.stage] * part))


@dataclass
class SyncProgress:
    files_total: int = 0
    files_done: int = 0
    active: dict[str, DocumentProgress] = field(default_factory=dict)

    @property
    def percent(self) -> int:
        if self.files_total <= 0:
            return 0
        return min(100, int((100 * self.files_done + sum(d.percent for d in self.active.values())) / self.files_total))
