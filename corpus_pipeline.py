"""The training-data pipeline: its stages and their run, which live in ``weftline.llm.pipeline``."""

from weftline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
