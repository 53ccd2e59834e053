"""Settings of a run, as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class EngineConfig:
    resources_dir: str = "resources"
    formats: list[str] = field(default_factory=lambda: [".epub", ".pdf", ".txt"])
    chunk_max_chars: int = 1800
    chunk_overlap: int = 300
    chunk_method: str = "paragraph"
    embedding_batch: int = 100
    provenance_threshold: float = 0.8
    predicate_threshold: float = 0.88
    entity_threshold: float = 0.92
    resolution: float = 0.8
    min_edge_weight: int = 1
    boilerplate: list[str] = field(default_factory=list)
    noise_entities: list[str] = field(default_factory=list)
    noise_predicates: list[str] = field(default_factory=list)
    failed_entities: list[str] = field(default_factory=list)
    type_rules: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        return cls().merged(json.loads(Path(path).read_text()))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2, sort_keys=True))

    def merged(self, changes: dict) -> EngineConfig:
        """A copy with these settings; unknown names and nulls are left out."""
        own = {f.name for f in fields(self)}
        return EngineConfig(**asdict(self) | {k: v for k, v in changes.items() if k in own and v is not None})

    def clamped(self) -> EngineConfig:
        """With sizes in their bounds: chunks of 200 to 5000 characters, overlap at most half of one."""
        most = min(5000, max(200, self.chunk_max_chars))
        method = self.chunk_method if self.chunk_method in ("paragraph", "semantic") else "paragraph"
        return self.merged({"chunk_max_chars": most, "chunk_overlap": min(max(0, self.chunk_overlap), most // 2), "chunk_method": method})
