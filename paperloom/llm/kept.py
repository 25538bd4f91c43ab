"""Results kept by key, within a bound of bytes."""

from __future__ import annotations

from collections.abc import Callable


class Kept(dict):
    """``make(key)`` for strings or bytes, kept until about ``most`` bytes are; then all go. Long keys are made anew each time."""

    def __init__(self, make: Callable, most: int = 96 << 20, longest: int = 256):
        super().__init__()
        self.make, self.most, self.longest, self.held = make, most, longest, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self.held += 200 + len(key) + (8 if isinstance(value, int) else len(value))
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[key] = value
        return value
