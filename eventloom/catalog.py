"""All queries of the engine's own operators, with the SQL that checks them."""

from .queries import QUERIES, SQL, events, files, frames, matching, motion, reports, tables  # noqa: F401
