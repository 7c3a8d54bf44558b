"""Personal data and credentials in texts, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of a finding, and domains that nobody owns
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "us_phone": r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d)",
    "bearer_token": r"[Bb]earer\s+[A-Za-z0-9\-._~+/]+=*",
    "api_key_assignment": r"""(?:api[_-]?key|secret[_-]?key|access[_-]?token)["']?\s*[=:]\s*["']?[^\s"']{16,}""",
}
RESERVED = ("example.com", "example.net", "example.org", "test", "example", "invalid", "localhost")
MARKER, MARKER_LINES = "synthetic-test-data", 5
LINE_MARKER = "pii-ok"
PLACEHOLDERS = ("user@domain.com", "admin@domain.com", "admin@yourcompany.com", "info@yourcompany.com", "user@yourdomain.com", "admin@yourdomain.com")
#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: What a line with a finding has, for a cheap look before its pattern is tried.
HINTS = {"email": "@", "us_phone": r"\d{3}.?.?\d{3}.?\d{4}", "bearer_token": "[Bb]earer", "api_key_assignment": "key|token"}

# fixed values: what is looked at, and where nothing is
EXTENSIONS = (".py", ".json", ".yaml", ".yml", ".md", ".txt", ".csv", ".toml", ".cfg", ".ini", ".html", ".xml", ".env", ".sh", ".bash")
NOT_IN = (".git/", ".claude/", "node_modules/", "__pycache__/", "epics/", ".project/", "requirements.txt", "requirements-dev.txt")


def scannable(path: Column) -> Column:
    """Whether a file is looked at: not under a path that is left out, and with an extension of those listed (any case). A name
    that is all extension, as .env, counts as one; a null path is not looked at."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    ending = F.lower(F.when(suffix != "", suffix).when(name.startswith(".") & ~name.endswith("."), name))
    out = F.coalesce(ending.isin(*EXTENSIONS), F.lit(False))
    for prefix in NOT_IN:
        out = out & ~path.startswith(prefix)
    return F.coalesce(out, F.lit(False))


def findings(texts: DataFrame, id_column: str, kinds: tuple[str, ...] = tuple(PATTERNS), reserved: tuple[str, ...] = RESERVED) -> DataFrame:
    """id_column, line (from 1), kind, match.

    A text with the marker in its first lines is skipped, and so are lines with their own marker, reserved addresses and
    placeholders. Only lines that can have a finding are kept before the patterns are tried.
    """
    lines = F.split("text", LINE_ENDS)
    rows = texts.filter(~F.exists(F.slice(lines, 1, MARKER_LINES), lambda x: x.contains(MARKER)))
    rows = rows.select(id_column, F.posexplode(lines).alias("_line", "_text")).filter(~F.col("_text").contains(LINE_MARKER))
    rows = rows.filter(F.col("_text").rlike("|".join(HINTS[k] for k in kinds)))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("_text", F.lit(PATTERNS[k]), F.lit(0)).alias("found")) for k in kinds))
    rows = rows.select(id_column, "_line", F.explode(found).alias("_f"))
    rows = rows.select(id_column, (F.col("_line") + 1).cast("bigint").alias("line"), "_f.kind", F.explode("_f.found").alias("match"))
    domain = F.lower(F.substring_index("match", "@", -1))
    nobody = F.lower("match").isin(*PLACEHOLDERS) if reserved else F.lit(False)
    for d in reserved:
        nobody = nobody | (domain == d) | domain.endswith("." + d)
    return rows.filter((F.col("kind") != "email") | ~nobody)
