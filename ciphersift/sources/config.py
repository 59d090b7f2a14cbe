"""Scan configuration (S7): a small driver-side document validated before any
job starts.  It arrives as a dict or a YAML file; unknown keys are ignored."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.regex import RegexError, validate_re2
from .catalog import CONFIDENCE_RANK, SEVERITIES, Scheme, catalog_schemes, default_remediation


class ConfigError(ValueError):
    pass


@dataclass
class ScanConfig:
    min_confidence: str | None = None
    include_unknown: bool = False
    exclude: list[str] = field(default_factory=list)
    disable: list[str] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)
    custom_schemes: list[Scheme] = field(default_factory=list)


def custom_scheme(id: str, pattern: str, title: str = "", cls: str = "", note: str = "",
                  remediation: str = "", ord: int = 0) -> Scheme:
    """A user-defined scheme: title defaults to the id, class to ``weak``;
    the pattern is RE2 and case-sensitive unless it opts in with ``(?i)``."""
    try:
        validate_re2(pattern)
    except (RegexError, ValueError) as e:
        raise ConfigError(f"scheme {id!r}: invalid pattern: {e}") from e
    return Scheme(ord=ord, name=id, title=title or id, cls=cls or "weak", note=note or "",
                  pattern=pattern, remediation=remediation or default_remediation(id, cls or "weak"), custom=True)


def parse_config(doc: dict | None, source: str = "config") -> ScanConfig:
    doc = doc or {}
    cfg = ScanConfig(include_unknown=bool(doc.get("include_unknown", False)),
                     exclude=list(doc.get("exclude") or []))
    mc = doc.get("min_confidence") or ""
    if mc:
        if mc not in CONFIDENCE_RANK:
            raise ConfigError(f"{source}: invalid min_confidence {mc!r}")
        cfg.min_confidence = mc
    rules = doc.get("rules") or {}
    cfg.disable = list(rules.get("disable") or [])
    for rid, sev in (rules.get("severity") or {}).items():
        if sev not in SEVERITIES:
            raise ConfigError(f"{source}: invalid severity {sev!r} for rule {rid!r}")
        cfg.severity[rid] = sev
    base = len(catalog_schemes())
    for i, cs in enumerate(doc.get("custom_schemes") or []):
        if not cs.get("id") or not cs.get("pattern"):
            raise ConfigError(f"{source}: custom_schemes[{i}] needs both id and pattern")
        try:
            cfg.custom_schemes.append(custom_scheme(
                cs["id"], cs["pattern"], cs.get("title", ""), cs.get("class", ""), cs.get("note", ""),
                cs.get("remediation", ""), ord=base + i))
        except ConfigError as e:
            raise ConfigError(f"{source}: {e}") from e
    return cfg


def load_config(path: str) -> ScanConfig:
    try:
        import yaml
    except ImportError as e:  # pragma: no cover
        raise ConfigError("PyYAML is needed to read a YAML config; pass a dict instead") from e
    with open(path, encoding="utf-8") as fh:
        try:
            doc = yaml.safe_load(fh)
        except yaml.YAMLError as e:
            raise ConfigError(f"parsing {path}: {e}") from e
    return parse_config(doc or {}, path)
