"""The registered queries: every operator run over the test tables, with its SQL twin."""

from tallyloom.catalog import encoders_and_folds, jobs, joins_and_groups, models_and_studies, sequences_and_scalars, tables_and_cleaning  # noqa: F401
from tallyloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
