"""Documents to training sequences: runs the stages of the training-data operators (see tamarack/llm/pipeline.py)."""

from tamarack.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
