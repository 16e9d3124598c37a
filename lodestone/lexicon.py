"""Product lexicon: families, document types and code patterns, loaded from a file or handed in; none is shipped."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

UNKNOWN = "UNKNOWN"


@dataclass(frozen=True)
class Lexicon:
    """Patterns in file order; `rows` and `codes` feed joins and literals alike."""

    raw: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Lexicon:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith((".yaml", ".yml")):
            import yaml

            return cls(yaml.safe_load(text))
        return cls(json.loads(text))

    @property
    def families(self) -> dict[str, Any]:
        return self.raw.get("families", {})

    def patterns(self) -> list[tuple[str, int, str, int]]:
        """(family, tier, lower-cased pattern, position): tier 0 category patterns, tier 1 aliases."""
        rows, at = [], 0
        for family, spec in self.families.items():
            for tier, kind in enumerate(("category_patterns", "aliases")):
                for pattern in spec.get(kind, []):
                    rows.append((family, tier, pattern.lower(), at))
                    at += 1
        return rows

    def model_codes(self) -> list[tuple[str, str, int]]:
        """(family, code, position)."""
        rows: list[tuple[str, str, int]] = []
        for family, spec in self.families.items():
            rows += [(family, code, len(rows) + i) for i, code in enumerate(spec.get("model_codes", []))]
        return rows

    def doc_types(self) -> list[tuple[str, str, int]]:
        return [(kind, p.lower(), i) for i, (kind, p) in enumerate((k, p) for k, ps in self.raw.get("doc_types", {}).items() for p in ps)]

    def code_patterns(self) -> list[tuple[str, bool]]:
        """Pattern, and whether it captures what a phrase calls a code."""
        return [(p, "(" in p.replace("(?:", "") and "code" in p) for p in self.raw.get("fault_code_patterns", [])]

    # Tens to some hundreds of rows: the lexicon is written by hand.
    def pattern_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.patterns(), "family string, tier int, pattern string, position int")

    def code_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.model_codes(), "family string, code string, position int")
