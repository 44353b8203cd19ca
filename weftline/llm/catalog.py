"""The queries of this subpackage and their SQL."""

from importlib import import_module

#: One module an operator.
MODULES = ("ann", "bpe", "chat", "decontam", "extract", "linededup", "quality", "secrets", "simhash", "toxicity")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return _merged("ORACLE_SQL")
