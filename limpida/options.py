"""Job options, validated on the driver before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from limpida.functions.patterns import (
    ALLOW_PATTERNS,
    PII_PATTERNS,
    REMOVAL_PATTERNS,
    AllowPattern,
    PiiPattern,
    RemovalPattern,
)

MIN_SALT_LENGTH = 16

# Salts that are known placeholders.
PLACEHOLDER_SALTS = ("changeme", "example", "test", "placeholder", "your-salt-here")


class PiiMode(str, Enum):
    """What happens to personal data that was found."""

    REDACT = "redact"
    DETECT_ONLY = "detect_only"
    DISABLED = "disabled"


@dataclass(frozen=True)
class PipelineVersion:
    """Version strings stamped on every output row (fixed values)."""

    parser_version: str = "email-parser-1.3.0"
    canonicalization_version: str = "1.3.0"
    ner_model_version: str = "it_core_news_lg-3.8.2"
    pii_redaction_version: str = "1.0.0"

    def __str__(self) -> str:
        return "|".join(
            (
                self.parser_version,
                self.canonicalization_version,
                self.ner_model_version,
                self.pii_redaction_version,
            )
        )


@dataclass(frozen=True)
class CleaningOptions:
    """Options of a cleaning job. The salt has no default on purpose."""

    pii_salt: str = field(repr=False)
    pii_mode: PiiMode = PiiMode.REDACT
    ner_confidence_threshold: float = 0.75
    remove_quotes: bool = True
    remove_signatures: bool = True
    max_body_size_kb: int = 500
    removal_patterns: tuple[RemovalPattern, ...] = REMOVAL_PATTERNS
    pii_patterns: tuple[PiiPattern, ...] = PII_PATTERNS
    allow_patterns: tuple[AllowPattern, ...] = ALLOW_PATTERNS
    version: PipelineVersion = PipelineVersion()

    def __post_init__(self) -> None:
        object.__setattr__(self, "pii_mode", PiiMode(self.pii_mode))
        if len(self.pii_salt) < MIN_SALT_LENGTH:
            raise ValueError(f"pii_salt needs at least {MIN_SALT_LENGTH} characters")
        lowered = self.pii_salt.lower()
        if lowered in PLACEHOLDER_SALTS or lowered.endswith("-pii-salt"):
            raise ValueError("pii_salt is a placeholder; generate a random one")
        if not 0.0 <= self.ner_confidence_threshold <= 1.0:
            raise ValueError("ner_confidence_threshold must lie in [0, 1]")
        if not 100 <= self.max_body_size_kb <= 5000:
            raise ValueError("max_body_size_kb must lie in [100, 5000]")

    @property
    def effective_threshold(self) -> float:
        """A threshold of zero means the default, as callers have come to expect."""
        return self.ner_confidence_threshold or 0.75

    @property
    def max_body_chars(self) -> int:
        return self.max_body_size_kb * 1024

    def active_removal_patterns(self) -> tuple[RemovalPattern, ...]:
        """Patterns left after the two group switches, in table order."""
        switched_off = set()
        if not self.remove_quotes:
            switched_off.add("quotes")
        if not self.remove_signatures:
            switched_off.add("signatures")
        return tuple(p for p in self.removal_patterns if p.group not in switched_off)
