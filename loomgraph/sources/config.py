"""Project settings from TOML: languages, effect rules, storage, embedding, sandbox."""

from __future__ import annotations

import logging
import tomllib
from dataclasses import dataclass, field

from loomgraph.functions.effects import EffectRule
from loomgraph.schema import EFFECTS

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] = ()
    headers: str | None = None
    effect_rules: tuple[EffectRule, ...] = ()
    storage: str = ""
    embedding: str | None = None
    dimension: int = 384
    loop_cap: int = 10
    policy: str = "if_true"
    mocks: dict[str, int] = field(default_factory=dict)


def _rule(raw: dict) -> EffectRule | None:
    effect = str(raw.get("effect", "")).strip().lower()
    if effect not in EFFECTS:
        log.warning("rule skipped: unknown effect %r", raw.get("effect"))
        return None
    call = raw.get("call", raw)
    for how in ("prefix", "contains", "exact"):
        if how in call:
            return EffectRule(how, call[how], effect)
    log.warning("rule skipped: it has no pattern")
    return None


def parse(text: str) -> Config:
    """Settings from the text of a TOML file; what is absent keeps its default."""
    raw = tomllib.loads(text)
    rules = tuple(r for r in map(_rule, raw.get("effect_rules", [])) if r)
    embedding, sandbox = raw.get("embedding", {}), raw.get("sandbox", {})
    return Config(
        languages=tuple(raw.get("languages", {}).get("enabled", ())),
        headers=raw.get("languages", {}).get("headers"),
        effect_rules=rules,
        storage=raw.get("storage", {}).get("path", ""),
        embedding=embedding.get("backend"),
        dimension=embedding.get("dim", 384),
        loop_cap=sandbox.get("loop_cap", 10),
        policy=sandbox.get("policy", "if_true"),
        mocks=dict(sandbox.get("mocks", {})),
    )


def load(path: str) -> Config:
    with open(path, "rb") as file:
        return parse(file.read().decode())
