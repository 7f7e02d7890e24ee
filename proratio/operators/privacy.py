"""Scan of text tables for private data.

Each text is searched whole, once per pattern, where it lies; only findings move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shapes of private values. Names of one's own systems come from the caller.
PATTERNS = {
    "database login": r"PG(PASSWORD|HOST|USER|DATABASE)\s*=\s*\S+",
    "login in a url": r"postgres(ql)?://[^\s'\"]+:[^\s'\"]+@",
    "database address": r"DATABASE_URL\s*=\s*\S+",
    "64 hex digits": r"\b[a-fA-F0-9]{64}\b",
    "workbook name": r"(?i)[^\s'\"]+\.xlsx",
}
# Names no published file may have.
FORBIDDEN_NAMES = r"(^|/)\.env[^/]*$"
FORBIDDEN_SUFFIXES = r"(?i)\.(xlsx|xls|sql|py|ps1)$"
MARK_SHOWN = 4


def pattern_scan(texts: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """Each pattern found in each text: how often, and the first match, whole."""
    matches = F.array(*[
        F.struct(F.lit(label).alias("label"), F.regexp_count(text, F.lit(p)).alias("matches"), F.regexp_extract(text, p, 0).alias("excerpt"))
        for label, p in (patterns or PATTERNS).items()
    ])
    found = F.filter(matches, lambda f: f["matches"] > 0)
    return texts.select(F.col(key), F.inline(found)).select(key, "label", "matches", "excerpt")


def parse_markers(lines: list[str]) -> list[str]:
    """Marker lines without blanks and comments."""
    stripped = [line.strip() for line in lines]
    return [m for m in stripped if m and not m.startswith("#")]


def marker_scan(texts: DataFrame, key: str, text: str, markers: list[str]) -> DataFrame:
    """Literal markers found in each text, masked in the report.

    Markers are a short private list; they become literals of one pass over the texts.
    """
    if not markers:
        return texts.select(key, F.lit("").alias("marker")).where(F.lit(False))
    hits = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.col(text), m))
    return texts.select(F.col(key), F.explode(hits).alias("m")).select(
        key, F.concat(F.substring("m", 1, MARK_SHOWN), F.lit("***")).alias("marker")
    )


def name_rules(paths: DataFrame, path: str, suffixes: str = FORBIDDEN_SUFFIXES) -> DataFrame:
    """Paths whose name or suffix must not be published."""
    bare = F.regexp_replace(path, r"[?#].*$", "")
    found = F.array_compact(
        F.array(
            F.when(bare.rlike(FORBIDDEN_NAMES), F.lit("arquivo de ambiente")),
            F.when(bare.rlike(suffixes), F.lit("extensao proibida")),
        )
    )
    return paths.select(F.col(path), F.explode(found).alias("finding"))


def mode_check(documents: DataFrame, key: str, text: str, expected: str = "DEMO") -> DataFrame:
    """Documents that are not JSON, or whose meta.mode is not the expected one."""
    parsed = F.try_parse_json(F.col(text))
    mode = F.get_json_object(text, "$.meta.mode")
    problem = F.when(parsed.isNull(), "invalid JSON").when(
        ~mode.eqNullSafe(F.lit(expected)), F.concat(F.lit("meta.mode is "), F.coalesce(mode, F.lit("missing")))
    )
    return documents.select(F.col(key), problem.alias("finding")).where("finding is not null")


def gate(*findings: DataFrame) -> None:
    """Raise if any scan found something."""
    for found in findings:
        sample = found.limit(3).collect()
        if sample:
            raise ValueError(f"private data found: {[r.asDict() for r in sample]}")
