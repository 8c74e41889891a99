"""Checked queries: every operator bound to the given tables, with its SQL."""

from platewise.plans.registry import ORACLES, QUERIES  # noqa: F401
from platewise.plans import sources  # noqa: F401
from platewise.plans import keys  # noqa: F401
from platewise.plans import qc  # noqa: F401
from platewise.plans import normalise  # noqa: F401
from platewise.plans import aggregates  # noqa: F401
from platewise.plans import joins  # noqa: F401
from platewise.plans import ordering  # noqa: F401
from platewise.plans import stats  # noqa: F401
from platewise.plans import models  # noqa: F401
from platewise.plans import variants  # noqa: F401
from platewise.plans import completeness  # noqa: F401
