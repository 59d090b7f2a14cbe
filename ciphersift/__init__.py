"""ciphersift: cryptography inventory and misuse findings over any text corpus,
as Spark DataFrame jobs."""

from .operators.scheme_scan import resolve
from .plans.report import render
from .plans.scan import ScanOptions, ScanResult, scan
from .sources.catalog import catalog_schemes


def schemes(spark):
    """The catalog listing (``%-14s %-8s %s`` lines in catalog order)."""
    from .plans.report import catalog_lines
    return catalog_lines(spark).orderBy("ord")


__all__ = ["ScanOptions", "ScanResult", "scan", "render", "resolve", "schemes", "catalog_schemes"]
