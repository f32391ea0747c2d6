"""Run settings: ablations, scenario families and limits."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ablation:
    """What a rollout uses; names are those of the four presets."""

    name: str = "full"
    use_user_state: bool = True
    use_behavior: bool = True
    assistant_strategy: str = "oracle"
    history_window: int | None = None
    recent_window: int = 4
    user_retry_temperatures: tuple = (0.7, 0.8, 0.9, 1.0, 1.1)
    user_temperature: float = 0.7
    assistant_temperature: float = 0.7
    controller_temperature: float = 0.9


PRESETS = {
    "full": Ablation(),
    "no_state": Ablation("no_state", use_user_state=False, use_behavior=False),
    "no_behavior": Ablation("no_behavior", use_behavior=False),
    "oracle_profile_only": Ablation("oracle_profile_only", use_user_state=False, assistant_strategy="oracle_profile_only"),
}


def ablation(name: str) -> Ablation:
    if name not in PRESETS:
        raise ValueError(f"unknown ablation {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


@dataclass(frozen=True)
class Limits:
    max_turns: int = 12
    min_turns: int = 3
    concurrency: int = 40  # calls in flight, over all tasks
    retries: int = 3
    max_prompts: int | None = None  # None or 0: no limit


@dataclass(frozen=True)
class ScenarioFamily:
    prefix: str
    categories: tuple = field(default_factory=tuple)


# Prefixes of scenario ids by family.
FAMILIES = {"lifelong": ScenarioFamily("lifelong"), "high_frequency": ScenarioFamily("high_frequency"), "affective": ScenarioFamily("affective")}
STYLES = ("personamem_mcq", "prefeval_gen", "lamp_cls")


def comma_list(raw: str | None) -> list[str]:
    """Names of a comma-separated list, blanks around them and empty ones left out."""
    return [x for x in (part.strip() for part in (raw or "").split(",")) if x]


def deduplicated_path(source: str) -> str:
    """Where a deduplicated table goes by default: beside its source."""
    stem, dot, suffix = source.rstrip("/").rpartition(".")
    return f"{stem}.deduped_shuffled.{suffix}" if dot and "/" not in suffix and stem.rpartition("/")[2] else f"{source.rstrip('/')}.deduped_shuffled"


def report_path(output: str) -> str:
    return f"{output.rstrip('/')}.report.json"
