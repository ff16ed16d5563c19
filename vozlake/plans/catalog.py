"""All named queries; importing a module registers its queries."""

from vozlake.plans import curation, dialogues, evaluation, files, mixtures, signals, speech, streams  # noqa: F401
from vozlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
