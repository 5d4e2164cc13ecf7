"""Readers and writers."""

from .readers import *  # noqa: F403
from .writers import *  # noqa: F403
