"""Many phrases in one pass over a text: a deterministic automaton, run over blocks of texts by numpy.

The automaton's states are the prefixes of the phrases; its table has a row for each state and a column for each letter that
phrases have (and one for all others), so a text's character costs one look-up, however many phrases there are. The texts of a
block stand in a row that is cut into lanes; all lanes advance together. A lane starts as many characters early as the longest
phrase has before its last: what the automaton knows after these doesn't depend on what stood before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters of a lane, and of a block (a longer text is a block of its own).
LANE, BLOCK = 256, 1 << 20
#: Cells of a table at most (4 bytes each): the automaton is broadcast, so its size is bounded.
MOST_CELLS = 16 << 20


class Automaton:
    def __init__(self, phrases: Sequence[str], words: bool = True):
        """phrases: distinct and not empty. With words, those without a blank, -, ' or & count only between other than a-z and 0-9."""
        if "" in phrases or len(set(phrases)) < len(phrases):
            raise ValueError("phrases must be distinct and not empty")
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.word = np.array([words and not any(s in p for s in " -'&") for p in phrases], bool)
        #: Phrases that can overlap themselves; only of these some occurrences may not count.
        self.bordered = np.array([any(p.startswith(p[k:]) for k in range(1, len(p))) for p in phrases], bool)
        letters = sorted(set().union(*map(set, phrases)) if phrases else ())
        self.column = np.zeros(0x110000, np.int32)
        self.column[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.columns = len(letters) + 1
        tree: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, p in enumerate(phrases):
            at = 0
            for c in self.column[[ord(c) for c in p]].tolist():
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                    ends.append([])
                at = tree[at][c]
            ends[at].append(k)
        if len(tree) * self.columns > MOST_CELLS:
            raise ValueError(f"{len(phrases)} phrases make an automaton of {len(tree)} states and {self.columns} letters, over {MOST_CELLS} cells")
        # a state's row is that of its longest proper suffix that is a state, but for its own branches; level by level
        table = np.zeros((len(tree), self.columns), np.int32)
        suffix, level = [0] * len(tree), [0]
        while level:
            below = []
            for at in level:
                if at:
                    table[at] = table[suffix[at]]
                for c, to in tree[at].items():
                    suffix[to] = int(table[at, c]) if at else 0
                    ends[to] = ends[to] + ends[suffix[to]]
                    table[at, c] = to
                    below.append(to)
            level = below
        self.table = table.ravel()
        self.first = np.cumsum([0, *map(len, ends)])
        self.found = np.array([k for x in ends for k in x], np.int64)

    def _states(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where phrases end, in order, and the states there."""
        early = int(self.size.max()) - 1 if len(self.size) else 0
        lanes = -(-len(columns) // LANE)
        row = np.zeros(early + lanes * LANE, np.int32)
        row[early : early + len(columns)] = columns
        has, at, places, states = np.diff(self.first) > 0, np.zeros(lanes, np.int64), [], []
        start = np.arange(lanes) * LANE
        for k in range(early + LANE):
            at = self.table[at * self.columns + row[start + k]]
            if k >= early:
                hit = np.flatnonzero(has[at])
                places.append(start[hit] + k - early)
                states.append(at[hit])
        place, state = np.concatenate(places), np.concatenate(states)
        order = np.argsort(place, kind="stable")
        return place[order], state[order]

    def counts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, phrase and number of occurrences, of each phrase that a text has. Occurrences of a phrase don't overlap, from the left."""
        none = np.zeros(0, np.int64)
        if not len(self.size) or not texts:
            return none, none, none
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        columns = self.column[points]
        columns[ends] = 0
        place, state = self._states(columns)
        many = self.first[state + 1] - self.first[state]
        phrase = self.found[np.repeat(self.first[state] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))]
        place = np.repeat(place, many)
        if self.word.any():
            solid = ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122))
            begin = place - self.size[phrase] + 1
            inside = solid[place + 1] | (solid[begin - 1] & (begin > 0))
            place, phrase = (x[~(self.word[phrase] & inside)] for x in (place, phrase))
        text = np.searchsorted(ends, place)
        if self.bordered[phrase].any():
            keep, last = np.ones(len(phrase), bool), {}
            for k in np.flatnonzero(self.bordered[phrase]).tolist():
                key = (text[k], phrase[k])
                keep[k] = place[k] - self.size[phrase[k]] >= last.get(key, -1)
                if keep[k]:
                    last[key] = place[k]
            text, phrase = text[keep], phrase[keep]
        both, n = np.unique(text * len(self.size) + phrase, return_counts=True)
        return both // len(self.size), both % len(self.size), n


def blocks(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts of about BLOCK characters, a longer text alone."""
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and size + n > BLOCK:
            yield first, k
            first, size = k, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)
