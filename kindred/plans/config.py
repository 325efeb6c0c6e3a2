"""Output shapes that users declare."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


class KindredError(Exception):
    """An error with a code and a status, as callers of a service need them."""

    def __init__(self, code: str, message: str, status: int = 400, details: object = None):
        super().__init__(message)
        self.code, self.status, self.details = code, status, details


TYPES = ("string", "number", "boolean", "string[]", "object")
NORMALIZERS = ("E164", "canonical", "YYYY-MM")
MISSING = ("null", "omit", "error")


@dataclass(frozen=True)
class OutputField:
    path: str
    source: str
    type: str
    required: bool = False
    normalize: str | None = None


@dataclass(frozen=True)
class OutputConfig:
    fields: tuple[OutputField, ...] | None = field(default_factory=tuple)
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"


def parse_config(told: dict | str) -> OutputConfig:
    """A config from its JSON, with defaults. Fields that aren't a list mean the identity; other faults raise MALFORMED_CONFIG."""
    told = json.loads(told) if isinstance(told, str) else told
    bad = lambda why: KindredError("MALFORMED_CONFIG", why, 422)
    missing = told.get("on_missing", "null")
    if missing not in MISSING:
        raise bad(f"on_missing is one of {', '.join(MISSING)}")
    fields = None
    if isinstance(told.get("fields"), list):
        fields = []
        for f in told["fields"]:
            if not isinstance(f.get("path"), str) or not isinstance(f.get("from"), str):
                raise bad("a field needs path and from")
            if f.get("type") not in TYPES:
                raise bad(f"type is one of {', '.join(TYPES)}")
            if f.get("normalize") not in (None, *NORMALIZERS):
                raise bad(f"normalize is one of {', '.join(NORMALIZERS)}")
            if "[" in f["path"]:
                raise bad(f"an output path can't hold an index: {f['path']}")
            fields.append(OutputField(f["path"], f["from"], f["type"], bool(f.get("required", False)), f.get("normalize")))
        paths = [f.path for f in fields]
        for p in paths:
            if paths.count(p) > 1 or any(q.startswith(p + ".") for q in paths):
                raise bad(f"two fields go to {p}")
        fields = tuple(fields)
    return OutputConfig(fields, told.get("include_confidence", True), told.get("include_provenance", True), missing)


def _default() -> OutputConfig:
    kinds = {"candidate_id": "string", "full_name": "string", "emails": "string[]", "phones": "string[]", "location": "object", "links": "object", "headline": "string", "years_experience": "number", "skills": "object", "experience": "object", "education": "object"}
    optional = ("location", "headline", "years_experience")
    return OutputConfig(tuple(OutputField(name, name, kind, name not in optional) for name, kind in kinds.items()))


DEFAULT = _default()
