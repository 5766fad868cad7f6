"""Run configuration: dimensions, windows, thresholds, suppression and expert path."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace

_SAFE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")

# Labels and colours shown with each level.
LEVEL0_LABEL = "Level0 无预警"
LEVEL_COLORS = {0: "slate", 1: "yellow", 2: "orange", 3: "red"}


@dataclass(frozen=True)
class Window:
    key: str
    observation_days: int
    label: str = ""
    purpose: str = ""
    color: str = ""


@dataclass(frozen=True)
class Threshold:
    level: int
    min_observation_count: float
    min_growth_factor: float
    min_structure_lift_factor: float
    min_z_score: float
    label: str = ""


@dataclass(frozen=True)
class SuppressionRule:
    field: str
    value: str
    reason: str


@dataclass(frozen=True)
class ExpertStep:
    field: str
    value: str
    label: str = ""


@dataclass(frozen=True)
class AttributionConfig:
    dimensions: tuple[str, ...]
    windows: tuple[Window, ...]
    thresholds: tuple[Threshold, ...]
    suppression_rules: tuple[SuppressionRule, ...] = ()
    expert_path: tuple[ExpertStep, ...] = ()
    field_labels: dict[str, str] = field(default_factory=dict)
    version: str = "unknown"
    table: str = ""
    date_field: str = "create_date"
    partition_field: str = "pt"
    count_field: str = "cnt"
    approval_fields: tuple[str, ...] = ("approval_cnt", "approval_jy0_cnt")
    person_field: str = "cid_cnt"
    person_approval_field: str = "approval_cid_cnt"
    lookback_days: int = 60
    trend_days: int = 60
    single_limit: int = 10
    pair_limit: int = 5
    level0_min_observation: float = 30
    output_limit: int = 250

    def __post_init__(self) -> None:
        names = (*self.dimensions, self.date_field, self.count_field, *self.approval_fields)
        bad = [n for n in names if not _SAFE_NAME.fullmatch(n)]
        if bad:
            raise ValueError(f"unsupported field name: {bad}")
        unknown = {r.field for r in self.suppression_rules} | {s.field for s in self.expert_path}
        unknown -= set(self.dimensions)
        if unknown:
            raise ValueError(f"rule or expert field is not a dimension: {sorted(unknown)}")

    @property
    def measures(self) -> tuple[str, ...]:
        return (self.count_field, *self.approval_fields, self.person_field, self.person_approval_field)

    @property
    def levels_ascending(self) -> list[Threshold]:
        return sorted(self.thresholds, key=lambda t: t.level)

    def level_label(self, level: int) -> str:
        labels = {0: LEVEL0_LABEL, **{t.level: t.label for t in self.thresholds}}
        return labels[level]

    def with_(self, **changes) -> "AttributionConfig":
        return replace(self, **changes)

    def to_dict(self) -> dict:
        return asdict(self)

    def fingerprint(self) -> str:
        """Twelve hex digits that change whenever any setting changes."""
        text = json.dumps(self.to_dict(), ensure_ascii=False, sort_keys=True, default=str)
        return hashlib.sha1(text.encode("utf-8")).hexdigest()[:12]

    def run_id(self, pt: str, offset: int = 0) -> str:
        return f"{pt}_{int(offset)}_{self.fingerprint()}"

    @classmethod
    def from_dict(cls, raw: dict) -> "AttributionConfig":
        """Build from the JSON layout users already keep (``top_k`` nested, lists of objects)."""
        known = {
            "version", "table", "date_field", "count_field", "lookback_days", "trend_days",
            "field_labels", "level0_min_observation", "output_limit",
        }
        args = {k: raw[k] for k in known if k in raw}
        if "approval_fields" in raw:
            args["approval_fields"] = tuple(raw["approval_fields"])
        if "cid_count_field" in raw:
            args["person_field"] = raw["cid_count_field"]
        if "cid_approval_field" in raw:
            args["person_approval_field"] = raw["cid_approval_field"]
        top = raw.get("top_k", {})
        return cls(
            dimensions=tuple(raw["dimensions"]),
            windows=tuple(Window(**w) for w in raw["windows"]),
            thresholds=tuple(Threshold(**t) for t in raw["thresholds"]),
            suppression_rules=tuple(SuppressionRule(**r) for r in raw.get("suppression_rules", [])),
            expert_path=tuple(ExpertStep(**s) for s in raw.get("expert_path", [])),
            single_limit=int(top.get("single_limit", 10)),
            pair_limit=int(top.get("pair_limit", 5)),
            **args,
        )

    @classmethod
    def from_json(cls, path: str) -> "AttributionConfig":
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(json.load(handle))
