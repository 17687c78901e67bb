"""All registered queries."""

from . import extraction, maintenance, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
