"""Driver-side string helpers: RE2 -> Java regexes and glob -> regex.

Spark evaluates regexes with ``java.util.regex``; the rules are written for RE2
(the dialect the scanner semantics are defined in, and the one DuckDB uses, so
the oracle agrees with it).  :mod:`.re2` parses a pattern and prints it for Java.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException

from .re2 import RegexError, translate

# Unicode White_Space as Go's unicode.IsSpace (strings.TrimSpace) sees it.
GO_SPACE_CLASS = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def java_regex(re2: str, *, drop_boundaries: bool = False) -> str:
    """Full Java pattern (with flags) equivalent to an RE2 pattern."""
    return "(?d)" + translate(re2, fold=False, drop_boundaries=drop_boundaries)


def prefilter(re2_patterns: list[str]) -> str | None:
    """A boundary-free alternation of all patterns: a superset test per line.

    Returns None when there is nothing to combine.
    """
    if not re2_patterns:
        return None
    bodies = [translate(p, fold=False, drop_boundaries=True) for p in re2_patterns]
    return "(?d)" + "|".join(f"(?:{b})" for b in bodies)


def validate_re2(pattern: str) -> None:
    """Raise RegexError if RE2 refuses the pattern or, where a JVM is at hand, if its Java form does not compile."""
    java = java_regex(pattern)
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jvm is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(java)
        except (Py4JJavaError, PySparkException) as e:
            raise RegexError(f"{pattern!r} is outside the supported classes: {str(e).splitlines()[0]}") from e


def glob_to_regex(glob: str) -> str:
    """gitignore-style glob (``*``, ``**``, ``?``) -> anchored regex.

    ``**/`` matches zero or more directories, ``**`` anything, ``*`` and ``?``
    stay within one path segment; every other character is literal.  The
    result ends in ``\\z`` (Java's ``$`` would also match before a final
    newline).
    """
    out = ["^"]
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
                continue
            if glob.startswith("**", i):
                out.append(".*")
                i += 2
                continue
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "/_-" else c)
        i += 1
    out.append("\\z")
    return "(?d)" + "".join(out)
