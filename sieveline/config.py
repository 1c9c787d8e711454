"""Options of a triage run; they become literals of the plan, so what is switched off is not planned at all."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("off", "normal", "strict")


@dataclass(frozen=True)
class TriageOptions:
    """``max_file_size`` is one default for API and command line; rule modes are off, normal or strict."""

    max_file_size: int = 100_000_000
    use_magic: bool = False
    use_markers: bool = False
    pdf_rules: str = "normal"
    office_rules: str = "normal"
    zip_rules: str = "normal"
    image_rules: str = "normal"

    def __post_init__(self) -> None:
        for name in ("pdf_rules", "office_rules", "zip_rules", "image_rules"):
            if getattr(self, name) not in MODES:
                raise ValueError(f"{name} must be one of {', '.join(MODES)}")
        if self.max_file_size < 0:
            raise ValueError("max_file_size must not be negative")
