"""The step builder: which parts of which items make up the microbatches of each training step.

It is a state machine: what a step draws depends on where the steps before left each lane, on what was carried over from their
rounding, and on what selection and packing made of the draws. It works on metadata only (id, kind, size, graded spans, score), and
on no more of a lane than its steps can draw, so its input grows with the steps and not with the corpus. State is a plain
dictionary: a builder that is given the state after step k goes on exactly as the one that wrote it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np

RANKS, ACCUMULATE, MICROBATCH = 2, 2, 4
PER_STEP = RANKS * ACCUMULATE * MICROBATCH
ATTEMPTS, MORE, LEAST_TAIL, BAND = 6, 1.8, 16, -1.0


@dataclass
class Plan:
    """Stages in token order: name, first token, sequence length, width of the blend into it, shares of lanes."""

    lanes: tuple[str, ...]
    starts: list[int]
    names: list[str]
    lengths: list[int]
    bands: list[int]
    shares: np.ndarray
    floors: np.ndarray
    longest: int = field(default=0)

    def at(self, tokens: int) -> tuple[int, np.ndarray, float]:
        """Stage, mixture, and how much of the stage before is still in it."""
        k = max(0, min(bisect_right(self.starts, tokens) - 1, len(self.names) - 1))
        band = self.bands[k]
        rest = max(0.0, 1 - (tokens - self.starts[k]) / band) if k and band else 0.0
        return k, self.shares[k] * (1 - rest) + self.shares[max(k - 1, 0)] * rest, rest


def whole_quotas(shares: np.ndarray, floors: np.ndarray, carry: np.ndarray, n: int = PER_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Whole sequences of each lane and what the next step has to make up for.

    A lane below its floor is lifted to it; lanes without one shrink by a common factor to make room.
    """
    lifted, free = np.maximum(shares, floors), floors == 0
    room = lifted[free].sum()
    if room > 0:
        lifted = np.where(free, lifted * min(1.0, max(0.0, 1 - (lifted.sum() - 1) / room)) if lifted.sum() > 1 else lifted, lifted)
    want = np.round(lifted / lifted.sum() * n + carry, 9)
    counts = np.floor(np.maximum(want, 0)).astype(int)
    by_rest = np.argsort(counts - want, kind="stable")
    spare = n - counts.sum()
    if spare > 0:
        counts += spare // len(counts)
        counts[by_rest[: spare % len(counts)]] += 1
    for k in by_rest[::-1]:
        less = min(counts[k], max(0, -spare))
        counts[k] -= less
        spare += less
    return counts, want - counts


def graded_in(spans: list[tuple[int, int]], lo: int, hi: int) -> int:
    return sum(max(0, min(b, hi) - max(a, lo)) for a, b in spans)


def best_start(n: int, spans: list[tuple[int, int]], length: int) -> int:
    """The first place from which a window covers most graded tokens."""
    if n <= length:
        return 0
    places = {0} | {min(max(x, 0), n - length) for a, b in spans for x in (a, b, a - length, b - length)}
    return max(places, key=lambda o: (graded_in(spans, o, o + length), -o))


def shuffled(keys: list[str], *salt) -> list[str]:
    head = ":".join(map(str, salt))
    return sorted(keys, key=lambda k: (hashlib.sha256(f"{head}:{k}".encode()).hexdigest()[:15], k))


class Builder:
    """`pool`: lane -> list of items (dictionaries of id, kind, n, spans, score), as many as the steps can draw."""

    def __init__(self, pool: dict[str, list[dict]], plan: Plan, fill, seed: int = 1234, state: dict | None = None):
        self.pool = {lane: {i["id"]: i for i in pool.get(lane, [])} for lane in plan.lanes}
        self.plan, self.fill, self.seed = plan, fill, seed
        state = state or {}
        self.step, self.tokens = state.get("step", 0), state.get("tokens", 0)
        self.cursor = {lane: state.get("cursor", {}).get(lane, 0) for lane in plan.lanes}
        self.epoch = {lane: state.get("epoch", {}).get(lane, 0) for lane in plan.lanes}
        self.carry = np.array(state.get("carry", [0.0] * len(plan.lanes)))
        self.orders: dict[tuple[str, int], list[str]] = {}

    def state(self) -> dict:
        return {"step": self.step, "tokens": self.tokens, "cursor": dict(self.cursor), "epoch": dict(self.epoch), "carry": self.carry.tolist()}

    def _order(self, lane: str) -> list[str]:
        key = (lane, self.epoch[lane])
        if key not in self.orders:
            self.orders[key] = shuffled(list(self.pool[lane]), self.seed, *key)
        return self.orders[key]

    def draw(self, lane: str, tokens: float) -> list[tuple[dict, int]]:
        """Items and their pass until their sizes reach `tokens`; a lane that ends is shuffled anew."""
        got, out, most = 0, [], 4 * len(self.pool[lane]) + 8
        while self.pool[lane] and got < tokens and len(out) < most:
            if self.cursor[lane] == len(self.pool[lane]):
                self.epoch[lane], self.cursor[lane] = self.epoch[lane] + 1, 0
            item = self.pool[lane][self._order(lane)[self.cursor[lane]]]
            self.cursor[lane] += 1
            out.append((item, self.epoch[lane] + 1))
            got += item["n"]
        return out

    def select(self, drawn: list[tuple[dict, int]], budget: float, floor: float) -> tuple[list[tuple[dict, int]], dict[str, int]]:
        """The best by score up to the budget (a prefix of their order), and what was decided on all of them."""
        ranked, before, taken, kinds = sorted(drawn, key=lambda x: (-x[0]["score"], x[0]["id"], x[1])), 0, [], {}
        for item, nth in ranked:
            score = item["score"]
            kind = "protected" if before < min(floor, budget) and score < 0 else "accepted" if before < min(floor, budget) or (score >= 0 and before < budget) else "topup" if before < budget else "full" if score >= 0 else "deferred" if score >= BAND else "low"
            if before < budget:
                taken.append((item, nth))
            kinds[kind] = kinds.get(kind, 0) + 1
            before += item["n"]
        return taken, kinds

    def pack(self, chosen: list[tuple[dict, int]], length: int, policy: str) -> list[list[dict]]:
        """Windows as lists of members; those without anything graded are left out."""
        parts = []
        for item, nth in chosen:
            if item["kind"] == "pretrain":
                cuts = [(o, min(length, item["n"] - o)) for o in range(0, item["n"], length) if item["n"] <= length or item["n"] - o >= LEAST_TAIL]
            else:
                cuts = [(best_start(item["n"], item["spans"], length), min(item["n"], length))]
            parts += [{"id": item["id"], "pass": nth, "lo": o, "hi": o + size, "loss": graded_in(item["spans"], o, o + size), "whole": item["n"], "alone": item["kind"] != "pretrain" and item["n"] > length} for o, size in cuts]
        together = [p for p in parts if not (policy == "structure_preserving" and p["alone"])]
        bins = self.fill([p["hi"] - p["lo"] for p in together], {"structure_preserving": "best_fit"}.get(policy, policy), length)
        packs: list[list[dict]] = [[] for _ in range(max(bins, default=-1) + 1)]
        order = sorted(range(len(together)), key=lambda i: (together[i]["lo"] - together[i]["hi"], i))
        for i in order:
            packs[bins[i]].append(together[i])
        packs += [[p] for p in parts if policy == "structure_preserving" and p["alone"]]
        return [p for p in packs if sum(m["loss"] for m in p)]

    def build(self) -> dict:
        """The next step: its windows in the order of microbatches, and what was planned and decided."""
        stage, mixture, rest = self.plan.at(self.tokens)
        length = self.plan.lengths[stage]
        quotas, self.carry = whole_quotas(mixture, self.plan.floors, self.carry)
        floors = mixture * 0 + self.plan.floors * PER_STEP
        windows, decisions = [], {}
        for lane, quota, floor in zip(self.plan.lanes, quotas.tolist(), floors.tolist(), strict=True):
            made: list[tuple[str, str, list[dict]]] = []
            for _ in range(ATTEMPTS):
                short = quota - len(made)
                drawn = self.draw(lane, int(short * length * MORE)) if short > 0 else []
                if not drawn:
                    break
                chosen, kinds = self.select(drawn, short * length, min(short, floor) * length)
                for k, n in kinds.items():
                    decisions[k] = decisions.get(k, 0) + n
                if chosen:
                    kind = chosen[0][0]["kind"]
                    policy = "long_context" if lane == "web" and length >= self.plan.longest else "best_fit" if kind == "pretrain" else "structure_preserving"
                    made += [(lane, policy, p) for p in self.pack(chosen, length, policy)]
            windows += made[:quota]
        by = shuffled([str(i) for i in range(len(windows))], self.seed, "step", self.step)
        windows = [windows[int(i)] for i in by]
        out = {"step": self.step, "stage": self.plan.names[stage], "length": length, "blend": round(rest, 4), "quotas": dict(zip(self.plan.lanes, quotas.tolist(), strict=True)), "decisions": decisions, "windows": windows}
        self.tokens += len(windows) * length
        self.step += 1
        return out
