"""A weighted backoff automaton as arrays: numbered states, arcs sorted by (state, token), a failure state and weight for each state."""

from __future__ import annotations

import numpy as np

LANE = 512  # tokens that one lane walks; a text's lanes are walked side by side
_STATE = np.uint64(32)


class Automaton:
    """Compiled from counts of one, two and three tokens; every number is a log10.

    tokens: how often each token occurs, by its number. pairs: (first, second, count), tokens by number, different pairs. triples: (pair, second pair,
    count): of the tokens a, b, c the places of a b and b c among pairs. State 0 is the empty context and has an arc for every token. State 1 + t is the
    context t, if that occurs; the pairs that occur ``least`` times are the states behind those. An arc leads to the longest state that ends what
    was read. Its probability is the count with ``mass`` times the probability from the failure state, over the state's count and ``mass``. Where a state has
    no arc for a token, its failure leads to the state without the first token, at the weight of what ``mass`` leaves to that: so a state's probabilities sum to 1.
    """

    def __init__(self, tokens: np.ndarray, alone: np.ndarray, pairs: tuple, triples: tuple | None, mass: float, least: int):
        self.alone = alone
        #: Where the empty context's arcs lead: tokens that don't occur are no context.
        self.start = np.where(tokens > 0, np.arange(1, 1 + len(tokens), dtype=np.int32), np.int32(0))
        first, second, n = pairs
        is_state = (n >= least) if triples is not None else np.zeros(len(n), bool)
        state = np.where(is_state, np.cumsum(is_state, dtype=np.int32) + np.int32(len(tokens)), second + np.int32(1))  # the longest that ends each pair
        self.failure = np.concatenate([np.zeros(1 + len(tokens), np.int32), second[is_state] + np.int32(1)])
        self.failure_weight = np.concatenate([[0.0], np.log10(mass / (np.concatenate([tokens, n[is_state]]) + mass))])
        there = n > 0
        kept = triples[2] > 0 if triples is not None else there[:0]
        n_pairs, size = int(there.sum()), int(there.sum()) + int(kept.sum())
        #: (state, token) of each arc, ascending, and behind them one that no search passes; those behind pairs come last, as these are the last states.
        self.arcs = np.full(size + 1, 2**64 - 1, np.uint64)
        self.to, self.weights = np.empty(size, np.int32), np.empty(size)
        less = mass * 10.0**alone
        weight = np.zeros(len(n))
        weight[there] = np.log10((n[there] + less[second[there]]) / (tokens[first[there]] + mass))
        self._put(0, first[there] + np.int32(1), second[there], state[there], weight[there])
        if triples is not None:
            np.power(10.0, weight, out=weight)
            weight *= mass
            before, after, m = (x[kept] for x in triples)
            longer = m + weight[after]
            del m, weight
            longer /= n[before] + mass
            np.log10(longer, out=longer)
            self._put(n_pairs, state[before], second[after], state[after], longer)

    def _put(self, begin: int, state: np.ndarray, token: np.ndarray, to: np.ndarray, weight: np.ndarray) -> None:
        """Arcs behind those up to ``begin``."""
        key = state.astype(np.uint64)
        key <<= _STATE
        key |= token.astype(np.uint64)
        by, end = np.argsort(key), begin + len(key)
        self.arcs[begin:end], self.to[begin:end], self.weights[begin:end] = key[by], to[by], weight[by]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights of the arcs and failures taken, for a token in each of some states."""
        to, weight = self.start[token], self.alone[token]
        at = np.flatnonzero(state)
        state, fallen = state[at], np.zeros(len(at))
        while len(at):
            key = state.astype(np.uint64) << _STATE | token[at].astype(np.uint64)
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[arc] == key
            to[at[hit]], weight[at[hit]] = self.to[arc[hit]], fallen[hit] + self.weights[arc[hit]]
            at, state, fallen = at[~hit], state[~hit], fallen[~hit]
            fallen = fallen + self.failure_weight[state]
            state = self.failure[state]
            empty = state == 0
            weight[at[empty]] += fallen[empty]
            at, state, fallen = at[~empty], state[~empty], fallen[~empty]
        return to, weight

    def walk(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The weight of each token of some texts, read from left to right; the first token of a text is given and weighs nothing.

        A long text is read in lanes. A lane but the first reads two tokens before its own, from the empty context: they are all that a state remembers."""
        sizes = np.maximum(ends - starts - 1, 0)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(starts)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        own = starts[text] + 1 + nth * LANE
        begin = own - np.where(nth > 0, 2, 1)
        end = np.minimum(own + LANE, ends[text])
        by = np.argsort(begin - end, kind="stable")  # the longest first, so that those that still read are in front
        own, begin, end = own[by], begin[by], end[by]
        reading = np.searchsorted(begin - end, -np.arange(int((end - begin).max(initial=0))))
        state, out = np.zeros(len(begin), np.int32), np.zeros(len(tokens))
        for i, n in enumerate(reading):
            at = begin[:n] + i
            state[:n], weight = self.step(state[:n], tokens[at])
            mine = at >= own[:n]
            out[at[mine]] = weight[mine]
        return out
