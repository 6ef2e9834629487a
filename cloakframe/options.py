"""Job options and the fixed values every part of the engine agrees on."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Default score thresholds per entity type.
DEFAULT_THRESHOLDS: dict[str, float] = {
    "PERSON": 0.85,
    "EMAIL_ADDRESS": 0.75,
    "PHONE_NUMBER": 0.75,
    "LOCATION": 0.90,
    "DATE_TIME": 0.95,
    "NRP": 0.85,
    "IP_ADDRESS": 0.75,
    "DOMAIN_NAME": 0.80,
    "URL": 0.80,
    "DEFAULT": 0.85,
}

# Fixed value: fuzzy threshold (0-100) when a profile names none.
DEFAULT_FUZZY_THRESHOLD = 80

# Fixed value: what a placeholder looks like in text (8 hex digits, or 16 when token_hex=16).
TYPE_NAME = re.compile(r"^[A-Z_]+$")
TOKEN_PATTERN = "<[A-Z_]+_[0-9a-f]{8}>"
WIDE_TOKEN_PATTERN = "<[A-Z_]+_(?:[0-9a-f]{16}|[0-9a-f]{8})>"

# Order in which span sources claim text: lower wins.
PRIORITY = {"exact": 0, "fuzzy": 1, "pattern": 2, "gazetteer": 3, "model": 4}


@dataclass(frozen=True)
class Options:
    """Everything a redaction or restoration job can be told."""

    salt: str | None = None  # must be set to mint tokens; keep it secret
    scope: str = "document"  # document | leaf | global
    token_hex: int = 8  # 2 to 32; short ones need operators.unique
    default_profile: str = "default"
    min_text_length: int = 5
    min_entity_length: int = 2
    max_phrase_words: int = 5
    uuid_length: int = 36
    uuid_dashes: int = 4
    skip_parity: bool = False
    all_occurrences: bool = True
    keep_mappings: bool = True
    disabled_types: frozenset[str] = field(default_factory=frozenset)
    ttl_seconds: int = 3600
    store_capacity: int = 100
    fold_limit: int = 256
    on_error: str = "closed"  # closed | raise

    def __post_init__(self) -> None:
        if self.scope not in ("document", "leaf", "global"):
            raise ValueError(f"unknown token scope: {self.scope}")
        if not 2 <= self.token_hex <= 32:
            raise ValueError("token_hex must be 2 to 32")
        if self.on_error not in ("closed", "raise"):
            raise ValueError("on_error must be 'closed' or 'raise'")

    @property
    def secret(self) -> str:
        """The salt; without one, tokens of e-mails and phone numbers could be guessed back."""
        if not self.salt:
            raise ValueError("set Options(salt=...) to a secret of your own")
        return self.salt

    @property
    def token_pattern(self) -> str:
        if self.grows:
            return f"<[A-Z_]+_[0-9a-f]{{{self.token_hex},64}}>"
        return TOKEN_PATTERN if self.token_hex == 8 else WIDE_TOKEN_PATTERN

    @property
    def grows(self) -> bool:
        """Tokens of 8 and 16 digits keep their length when they are minted again, others get 16 digits more."""
        return self.token_hex not in (8, 16)

    def digits(self, again: int) -> int:
        return min(self.token_hex + 16 * again, 64) if self.grows else self.token_hex


def check_type_name(entity_type: str) -> str:
    """Only names the placeholder pattern can read back are allowed."""
    if not TYPE_NAME.match(entity_type):
        raise ValueError(f"entity type must match [A-Z_]+: {entity_type!r}")
    return entity_type
