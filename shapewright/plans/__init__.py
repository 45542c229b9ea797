"""Query plans by group; importing this module registers all of them."""

from . import agreement, anchored, archived, axes, details, drawn, evaluation, funds, pages, panel, profile, relational, rows, series, stored, streaming, studies, triplets, vintage  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
