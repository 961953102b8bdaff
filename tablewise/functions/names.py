"""Rules on column, table and file names (metadata only, never on rows)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from tablewise.functions import rules


def contains_any(name: str, words: Iterable[str]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)


def has_keyword(name: str, words: Iterable[str], match: str = "substring") -> bool:
    """``substring`` finds a word anywhere in the name, ``token`` only between separators."""
    lowered = name.strip().lower()
    if match == "substring":
        return contains_any(lowered, words)
    return not set(re.split(r"[\s_-]+", lowered)).isdisjoint(words)


def first_hit(columns: Sequence[str], hints: Iterable[str]) -> str | None:
    """The first column holding the earliest hint that any column holds."""
    return next((c for hint in hints for c in columns if hint in c.lower()), None)


def best_hit(columns: Sequence[str], hints: Iterable[str]) -> str:
    return first_hit(columns, hints) or columns[0]


def session_prefix(session_id: str) -> str:
    return session_id.replace("-", "")[:8]


def table_name(session_id: str, file_name: str) -> str:
    stem = re.sub(r"[\s.-]+", "_", PurePosixPath(file_name).stem.lower())
    stem = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "", stem).strip("_"))
    return f"{session_prefix(session_id)}_{stem or 'table'}"


def split_prefix(table: str) -> tuple[str, str]:
    prefix, found, rest = table.partition("_")
    return (prefix, rest) if found else ("", table)


def join_view_name(from_table: str, to_table: str) -> str:
    prefix, left = split_prefix(from_table)
    if not prefix:
        return f"view_{from_table}_{to_table}"
    return f"view_{prefix}_{left}_{split_prefix(to_table)[1]}"


def key_stem(column: str) -> str:
    """``customer_id``, ``CUSTOMER-KEY`` → ``customer``."""
    return re.sub(rules.KEY_SUFFIX, "", column.strip().lower()).strip("_")


def same_key(left: str, right: str) -> bool:
    """Do two key stems name the same thing: equal, abbreviated, or one a prefix (3+ letters)?"""
    short, long = sorted((left, right), key=len)
    if not short:
        return False
    if (short, long) in rules.NAME_ABBREVIATIONS:
        return True
    return short == long or (len(short) >= 3 and long.startswith(short))


def label(column: str) -> str:
    stem = re.sub(rules.LABEL_SUFFIX, "", column, flags=re.IGNORECASE)
    return stem.replace("_", " ").strip().title()
