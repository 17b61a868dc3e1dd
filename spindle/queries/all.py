"""All registered queries of the package's own operators."""

from __future__ import annotations

from spindle.queries import keeping, more, packing, placing, scoring, shapes, tables, wording  # noqa: F401
from spindle.queries.registry import ORACLE_SQL, QUERIES  # noqa: F401
