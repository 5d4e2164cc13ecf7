"""Locks: a canonical document, its digest, and verification that fails closed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from ..sources.writers import fingerprint


class LockError(ValueError):
    """A lock does not match what it locks."""


def digest(values: Mapping) -> str:
    text = json.dumps(values, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def build(name: str, frames: Mapping[str, DataFrame], parameters: Mapping, of: Callable[[DataFrame], str] = fingerprint) -> dict:
    """A lock over the fingerprints of frames and over parameters."""
    body = {"name": name, "parameters": dict(parameters), "frames": {k: of(v) for k, v in frames.items()}}
    return {**body, "lock": digest(body)}


def verify(lock: Mapping, frames: Mapping[str, DataFrame], of: Callable[[DataFrame], str] = fingerprint) -> None:
    """Refuse a lock that was edited, or frames that differ from those it names."""
    body = {k: v for k, v in lock.items() if k != "lock"}
    if digest(body) != lock.get("lock"):
        raise LockError("the lock itself was changed")
    if set(frames) != set(lock["frames"]):
        raise LockError("the lock names other frames")
    for k, v in frames.items():
        if of(v) != lock["frames"][k]:
            raise LockError(f"frame {k} differs from its lock")


def guard_test_split(df: DataFrame) -> DataFrame:
    """Refuse a plan that can read test rows: its partition filters must leave that split out."""
    if "split" not in df.columns:
        raise LockError("no split to guard")
    return df.filter("split <> 'test'")
