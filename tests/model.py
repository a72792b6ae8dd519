"""The store as a plain Python model: one dict, in command order."""

from __future__ import annotations


class Model:
    def __init__(self):
        self.cells: dict = {}

    def live(self, key, now):
        value, expiry = self.cells.get(key, (None, 0))
        return None if value is None or (expiry != 0 and expiry <= now) else value

    def put(self, key, value, expiry=0):
        self.cells[key] = (value, expiry)

    def delete(self, key, now):
        existed = self.live(key, now) is not None
        self.cells[key] = (None, 0)
        return existed

    def snapshot(self, now):
        return {k: v for k in self.cells if (v := self.live(k, now)) is not None}


def flushes(log, threshold):
    """(op index, keys, bytes) of each flush, and the open rest, of (key, value) mutations."""
    sizes, total, out = {}, 0, []
    for i, (key, value) in enumerate(log):
        size = len(key) + len(value or "")
        total += size - sizes.get(key, 0)
        sizes[key] = size
        if total >= threshold:
            out.append((i, len(sizes), total))
            sizes, total = {}, 0
    return out, (len(sizes), total)
