"""Error categories.  Every error carries an ``area`` such as ``plan.field``."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, area: str, message: str):
        super().__init__(f"[{area}] {message}")
        self.area = area


class Invalid(EngineError, ValueError):
    """The caller's input breaks a rule."""


class Unsupported(EngineError, NotImplementedError):
    """A type, version or option outside the engine."""


class Corrupt(EngineError, IOError):
    """Stored bytes or metadata contradict each other."""
