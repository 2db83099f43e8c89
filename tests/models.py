"""Slow, plain models of the stateful operators, for comparison only."""

from __future__ import annotations

import hashlib
import math


def fnv(text: str) -> int:
    value = 2166136261
    for byte in text.encode():
        value = (value ^ byte) * 16777619 % 2**32
    return value


def part(text: str, n: int) -> int:
    return (fnv(text) % 2**31) % n


def lives_and_events(keys, epsilon, support):
    """Walk one topic's stream; returns (events, tracked sizes, promotions).

    Events are (bucket, key, kind, count) in the order they happen, where kind is
    'hot' at the first hot turnover of a life and 'gone' when a life ends.
    """
    width = math.floor(1 / epsilon)
    limit = (support - epsilon) * width
    table = {}
    events, tracked = [], []
    for bucket0 in range(len(keys) // width):
        for key in keys[bucket0 * width : (bucket0 + 1) * width]:
            table.setdefault(key, {"left": 0, "allowance": bucket0, "hot": False})["left"] += 1
        for key in list(table):
            entry = table[key]
            entry["left"] -= 1
            if entry["left"] + entry["allowance"] < bucket0 + 1:
                del table[key]
                events.append((bucket0 + 1, key, "gone", entry["hot"]))
            elif entry["left"] >= limit and not entry["hot"]:
                entry["hot"] = True
                events.append((bucket0 + 1, key, "hot", entry["left"]))
        tracked.append(len(table))
    return events, tracked


class MapModel:
    """Hot map as a flat dict key -> (count, partition)."""

    def __init__(self, n):
        self.n = n
        self.at = {}

    def size(self, p):
        return sum(c for c, q in self.at.values() if q == p)

    def add(self, key, count):
        one, two = part(key + "#1", self.n), part(key + "#2", self.n)
        self.at[key] = (count, two if self.size(one) > self.size(two) else one)

    def round(self, rule, tolerance=None, frozen=()):
        mean = sum(c for c, _ in self.at.values()) / self.n
        sizes = [self.size(p) for p in range(self.n)]
        if tolerance is not None and max(sizes) <= mean * (1 + tolerance):
            return 0
        low = [p for p in range(self.n) if sizes[p] < mean]
        moved = 0
        for src in [p for p in range(self.n) if sizes[p] > mean]:
            here = self.size(src)
            plan = {}
            for key, (count, p) in self.at.items():
                if p != src or count > here - mean or key in frozen:
                    continue
                best = None
                for dst in low:
                    gap = here - self.size(dst)
                    far = abs(gap - 2 * count) if rule == "improves" else abs(gap + 2 * count)
                    if gap < 0 or gap < far:
                        continue
                    score = (abs(self.size(dst) + count - mean), dst)
                    if best is None or score < best:
                        best = score
                if best is not None:
                    plan[key] = best[1]
            for key, dst in plan.items():
                self.at[key] = (self.at[key][0], dst)
            moved += len(plan)
        return moved


def control_history(keys, epsilon, support, n, every, rule="improves", tolerance=None, cooldown=None):
    """Map after each turnover of one topic, and the number of moves."""
    width = math.floor(1 / epsilon)
    events, _ = lives_and_events(keys, epsilon, support)
    by_bucket = {}
    for event in events:
        by_bucket.setdefault(event[0], []).append(event)
    model, states, moves, last_move = MapModel(n), [], 0, {}
    for bucket in range(1, len(keys) // width + 1):
        for _, key, kind, value in by_bucket.get(bucket, []):
            if kind == "hot":
                model.add(key, value)
                last_move.pop(key, None)
            elif value:
                model.at.pop(key)
        if every and bucket % every == 0:
            now = bucket * width
            frozen = {
                k for k, t in last_move.items() if cooldown is not None and now - t < cooldown
            }
            before = dict(model.at)
            moves += model.round(rule, tolerance, frozen)
            for key, (_, p) in model.at.items():
                if before[key][1] != p:
                    last_move[key] = now
        states.append(dict(model.at))
    return states, moves


def skewed_keys(n, seed, spread=40):
    """A repeatable skewed stream of keys."""
    out = []
    for i in range(n):
        u = int(hashlib.md5(f"{seed}/{i}".encode()).hexdigest()[:8], 16) / 2**32
        out.append(f"k{int(u ** 3 * spread)}")
    return out
