"""Prose about columns, tables and anomalies from an injected provider: text in, text or None out. None by default."""

from __future__ import annotations

from collections.abc import Callable, Sequence

Provider = Callable[[str], str | None]
#: What a prompt holds at most.
COLUMN_VALUES, TABLE_ROWS, TABLE_COLUMNS, ANOMALIES = 5, 3, 10, 5


def _asked(provider: Provider | None, prompt: str) -> str | None:
    if provider is None:
        return None
    try:
        out = provider(prompt)
    except Exception:  # noqa: BLE001 prose is optional
        return None
    return out.strip() or None if out else None


def column(provider: Provider | None, name: str, values: Sequence) -> str | None:
    return _asked(provider, f"Describe the column {name!r} with the values {list(values)[:COLUMN_VALUES]} in ten words or fewer.")


def table(provider: Provider | None, name: str, columns: Sequence[str], rows: Sequence[dict]) -> str | None:
    return _asked(provider, f"Summarise the table {name!r} with the columns {list(columns)[:TABLE_COLUMNS]} and the rows {list(rows)[:TABLE_ROWS]}.")


def anomalies(provider: Provider | None, name: str, rows: Sequence[dict]) -> str | None:
    return _asked(provider, f"Explain why these rows of {name!r} were flagged: {list(rows)[:ANOMALIES]}") if rows else None


def tie(provider: Provider | None, source: str, candidates: Sequence[str]) -> str | None:
    """The first candidate that the first line of an answer names."""
    answer = _asked(provider, f"Which of {list(candidates)} is the field {source!r}? Answer with its name.")
    line = answer.splitlines()[0] if answer else ""
    return next((c for c in candidates if c in line), None)
