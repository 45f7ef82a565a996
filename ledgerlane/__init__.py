"""Ledger reconciliation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from ledgerlane.config import ReconConfig
from ledgerlane.plans.reconcile import Reconciliation, reconcile

__all__ = ["ReconConfig", "Reconciliation", "reconcile"]

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
