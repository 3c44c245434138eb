"""All registered queries (importing the plan modules registers them)."""

from __future__ import annotations

from . import base
from . import integration  # noqa: F401
from . import descriptive  # noqa: F401
from . import survival  # noqa: F401
from . import episodes  # noqa: F401
from . import evaluation  # noqa: F401
from . import models  # noqa: F401
from . import io  # noqa: F401


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.ORACLE)
