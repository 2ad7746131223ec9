"""Effects of calls, from an ordered list of rules over their names; the first rule that matches counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.schema import EFFECTS


@dataclass(frozen=True)
class EffectRule:
    """how: prefix, contains or exact; case-sensitive."""

    how: str
    text: str
    effect: str

    def matches(self, name: Column) -> Column:
        text = F.lit(self.text)
        return {"prefix": F.startswith(name, text), "contains": F.contains(name, text), "exact": name == text}[self.how]

    def matches_text(self, name: str) -> bool:
        return {"prefix": name.startswith(self.text), "contains": self.text in name, "exact": name == self.text}[self.how]


# The rules in their order, by effect and way of matching.
_RULES = (
    ("prefix", "http_call", "http. net/http."),
    ("prefix", "log", "log. slog."),
    ("prefix", "file_read", "os. open("),
    ("contains", "http_call", "RestTemplate retrofit WebClient"),
    ("contains", "file_read", "FileInputStream FileReader BufferedReader"),
    ("contains", "file_write", "FileOutputStream FileWriter"),
    ("contains", "event_emit", "kafka. rabbit amqp"),
    ("contains", "sql_query", ".Query .QueryRow .Raw .Select .Find .First .Model("),
    ("contains", "sql_write", ".Exec .Insert .Update .Delete( .Create( .Save( .Session"),
    ("prefix", "http_call", "requests."),
    ("contains", "http_call", ".Get( .Post( .Put( .Delete( .Patch( .Do( .NewRequest"),
    (
        "contains",
        "event_emit",
        ".Publish .publish .Send .send .Produce .produce .Consume .consume .Subscribe .subscribe .Receive .receive",
    ),
    ("contains", "cache_read", ".MGet"),
    ("contains", "cache_write", ".MSet"),
    ("contains", "cache_read", ".HGet"),
    ("contains", "cache_write", ".HSet"),
    ("contains", "cache_read", ".HGetAll"),
    ("contains", "cache_write", ".Del( .Expire"),
    ("contains", "cache_read", ".Exists .TTL"),
    ("contains", "file_read", ".Open .ReadFile .ReadAll"),
    ("contains", "file_write", ".WriteFile .WriteString .Create .Mkdir"),
    ("contains", "log", "logging. logger. .Printf .Println .Infof .Info .Errorf .Error .Warnf .Warn .Debugf .Debug"),
    ("contains", "cache_write", ".Set"),
    ("contains", "sql_query", ".Get"),
)
DEFAULT_RULES = tuple(EffectRule(how, text, effect) for how, effect, texts in _RULES for text in texts.split())


def rules_with(own: Sequence[EffectRule]) -> list[EffectRule]:
    """Own rules before the default ones; rules of unknown effects are left out."""
    return [r for r in own if r.effect in EFFECTS] + list(DEFAULT_RULES)


def classify(name: Column, own: Sequence[EffectRule] | None = None) -> Column:
    """struct<effect, effect_desc>: the effect of the first rule that matches, and that rule's text."""
    # One array built from the rules' texts would evaluate all of them; a chain stops at the first match.
    case = None
    for rule in rules_with(own or []):
        value = F.struct(F.lit(rule.effect).alias("effect"), F.lit(rule.text).alias("effect_desc"))
        case = F.when(rule.matches(name), value) if case is None else case.when(rule.matches(name), value)
    return case.otherwise(F.struct(F.lit("none").alias("effect"), F.lit(None).cast("string").alias("effect_desc")))


def classify_text(name: str, own: Sequence[EffectRule] | None = None) -> tuple[str, str | None]:
    for rule in rules_with(own or []):
        if rule.matches_text(name):
            return rule.effect, rule.text
    return "none", None
