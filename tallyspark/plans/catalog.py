"""Imports every query module so the registry is filled."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import activity, benchmark, exports, filings, finance, quality, reports, streams, values  # noqa: F401
