"""Publication scan of texts and files: secrets, private places, network calls, remote assets, unsafe paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of what must not be published; without look-around, so that other engines read them too.
PATTERNS = {
    "secret": r"(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{12,}",
    "key_block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "cloud_key": r"\b(AKIA|ASIA)[A-Z0-9]{16}",
    "forge_token": r"\b(gh[pousr]_|github_pat_)[A-Za-z0-9_]{30,}",
    "storage_url": r"(?i)\bs3://\S+",
    "resource_name": r"(?i)\barn:aws(-[a-z]+)?:",
    "css_url": r"(?i)\burl\(\s*['\"]?[^\s)'\"]+",
    "import": r"\b(import|export)\s+[^;\n'\"]*['\"][^'\"\n]+['\"]|\b(import|importScripts)\s*\(",
    "private_path": r"(?i)(/(home|workspace|mnt)/|/Users/[A-Za-z]+/|[A-Z]:\\\\Users\\\\)",
    "network_call": r"(?i)\b(fetch|XMLHttpRequest|WebSocket|EventSource|sendBeacon)\s*\(",
    "remote_asset": r"(?i)(src|href)\s*=\s*['\"]?(https?:)?//",
    "mail": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "link": r"(?i)\bh(tt|xx)ps?://[^\s\]>)\"']+",
}
#: Bounds of a published folder.
MOST_FILES, MOST_FILE, MOST_TOTAL = 32, 1_000_000, 2_000_000


def findings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, finding, hits of every text that a pattern matches. Null texts match nothing."""
    long = df.select(key, *(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(n) for n, p in PATTERNS.items()))
    return long.unpivot([key], list(PATTERNS), "finding", "hits").filter("hits > 0")


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, url, host of each distinct link of a text."""
    urls = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS["link"]), F.lit(0)))).alias("url"))
    return urls.select(key, "url", F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/:?#]+)", 1)).alias("host"))


def unsafe_path(path: Column) -> Column:
    """Absolute paths, backslashes, and parts that are empty, . or .."""
    return path.startswith("/") | path.contains("\\") | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))


def folder_problems(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """problem of an inventory (path, bytes): unknown suffixes, too many or too large files, unsafe paths."""
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | F.col("path").endswith(s)
    each = files.select(F.when(~ok, F.concat(F.lit("suffix: "), "path")).when(F.col("bytes") > MOST_FILE, F.concat(F.lit("size: "), "path")).when(unsafe_path(F.col("path")), F.concat(F.lit("path: "), "path")).alias("problem")).filter("problem is not null")
    whole = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).select(F.when(F.col("n") > MOST_FILES, "too many files").when(F.col("b") > MOST_TOTAL, "too large").alias("problem")).filter("problem is not null")
    return each.unionByName(whole)
