"""The registered queries over the driver tables, and their SQL."""

from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
