"""Every plan module, imported once so that its queries are registered."""

from . import evaluations, files, grading, label_tables, search, telemetry, texts, trajectories, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "R4_rrf"
