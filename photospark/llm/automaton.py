"""Weighted backoff automaton over word n-grams, walked left to right by all texts of a block in step.

A state is a context of one or two words from which arcs leave; state 0 is the
empty context. An arc carries the smoothed log10 probability of its word and
leads to the longest context that ends there. Where a state has no arc for a
word its failure arc leads to the shorter context, at the cost of the weight
that is left; state 0 takes every word.
"""

from __future__ import annotations

import numpy as np

#: Discount taken from each kept count, and what is added to each single-word count.
DISCOUNT = 0.5
ADDED = 0.1
ORDER = 3
#: Words of a text that a lane walks; a lane first walks the ``ORDER - 1`` words before, which fix its state.
STRIDE = 256


def _weight(total: np.ndarray, arcs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the kept continuations of a context leave to the shorter one."""
    return np.maximum(1.0 - (total - DISCOUNT * arcs) / np.maximum(count, 1), 1e-9)


class Automaton:
    """States, arcs and failure arcs over the words 0, 1, ... of a block.

    ``count`` are the training counts of the words; ``pair`` (first word,
    second word) and ``triple`` (pair of its first two words, third word, pair
    of its last two words) list n-grams with ``pair_count`` and
    ``triple_count``, 0 for those that are not in the model. ``*_total`` and
    ``*_arcs`` are the counts of the kept continuations of each word and pair and
    their number, over the whole model. ``below`` is the denominator of the
    single-word probabilities.
    """

    def __init__(self, count: np.ndarray, below: float, pair: tuple[np.ndarray, np.ndarray], pair_count: np.ndarray, triple: tuple[np.ndarray, np.ndarray, np.ndarray],
                 triple_count: np.ndarray, word_total: np.ndarray, word_arcs: np.ndarray, pair_total: np.ndarray, pair_arcs: np.ndarray):
        self.size = max(1, len(count))
        single = (count + ADDED) / below
        self.single = np.log10(single)
        n_words = int((word_arcs > 0).sum())
        word_state = np.where(word_arcs > 0, np.cumsum(word_arcs > 0), 0)
        pair_state = np.where(pair_arcs > 0, n_words + np.cumsum(pair_arcs > 0), 0)
        self.enter = word_state
        word_left, pair_left = _weight(word_total, word_arcs, count), _weight(pair_total, pair_arcs, pair_count)
        first, second = pair
        self.fail = np.concatenate([[0], np.zeros(n_words, np.int64), word_state[second[pair_arcs > 0]]])
        self.left = np.log10(np.concatenate([[1.0], word_left[word_arcs > 0], pair_left[pair_arcs > 0]]))
        # arcs of words, then arcs of pairs, which rest on those
        chance = np.where(pair_count > 0, (pair_count - DISCOUNT) / np.maximum(count[first], 1), 0) + word_left[first] * single[second]
        kept = np.flatnonzero(pair_count > 0)
        context, last, tail = triple
        full = np.flatnonzero(triple_count > 0)
        context, last, tail = context[full], last[full], tail[full]
        deep = (triple_count[full] - DISCOUNT) / pair_count[context] + pair_left[context] * chance[tail]
        keys = np.concatenate([word_state[first[kept]] * self.size + second[kept], pair_state[context] * self.size + last])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.cost = np.log10(np.concatenate([chance[kept], deep]))[order]
        self.to = np.concatenate([np.where(pair_state[kept] > 0, pair_state[kept], word_state[second[kept]]), np.where(pair_state[tail] > 0, pair_state[tail], word_state[last])])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability of each lane's word, its state after it): its arc, after as many failure arcs as it takes."""
        cost, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        lane = np.arange(len(state))
        while len(lane):
            at_end = state == 0
            if at_end.any():
                cost[lane[at_end]] += self.single[word[at_end]]
                after[lane[at_end]] = self.enter[word[at_end]]
                lane, state, word = lane[~at_end], state[~at_end], word[~at_end]
            if not len(lane) or not len(self.keys):
                # a state without any arc in this block
                cost[lane] += self.left[state]
                state = self.fail[state]
                continue
            asked = state * self.size + word
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            hit = self.keys[at] == asked
            cost[lane] += np.where(hit, self.cost[at], self.left[state])
            after[lane[hit]] = self.to[at[hit]]
            lane, state, word = lane[~hit], self.fail[state[~hit]], word[~hit]
        return cost, after

    def walk(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of every word of all texts; each lane carries its state from word to word."""
        out = np.zeros(len(words))
        lanes = -(-np.diff(offsets) // STRIDE)
        text = np.repeat(np.arange(len(lanes)), lanes)
        start = offsets[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        end = np.minimum(start + STRIDE, offsets[text + 1])
        begin = np.maximum(start - (ORDER - 1), offsets[text])
        order = np.argsort(begin - end, kind="stable")
        begin, start, length = begin[order], start[order], (end - begin)[order]
        state = np.zeros(len(begin), np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -t, side="left"))
            place = begin[:live] + t
            cost, state[:live] = self.step(state[:live], words[place])
            own = place >= start[:live]
            out[place[own]] = cost[own]
        return out
