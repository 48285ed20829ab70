"""Byte-pair encoding from the left.

The encoding of a text's prefix ends with one certain token, and two tokens may stand side by side just
if encoding both together gives these two.  So the last token of each prefix follows from those of
shorter prefixes: it is the one that ends there and may follow the last token of what stands before it.
This forward step needs neither merges over whole words nor what comes after.
"""

from __future__ import annotations

from collections.abc import Callable

#: Marks the last symbol of a word, where a vocabulary has tokens of their own for word ends.
WORD_END = "￿"

#: Pairs of tokens that are remembered at most.
MOST_PAIRS = 400_000


def symbols(text: str) -> list[str]:
    parts = list(text)
    if len(parts) > 1 and parts[-1] == WORD_END:
        parts[-2:] = [parts[-2] + WORD_END]
    return parts


class Tokens:
    """A vocabulary with the order of its merges.

    tokens: text -> id.  rank(left, right): the lower, the sooner two symbols merge; None if they don't.
    """

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], float | None]):
        self.tokens = tokens
        self.rank = rank
        self.own: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: the tokens that encoding can give
        self.good = {t for t in tokens if self.merges(t)[3]}

    def merges(self, token: str) -> tuple[str, str, list[tuple[float, str, str]], bool]:
        """The merges of a token by itself, least rank first, leftmost among equals.

        First and last symbol; for each merge its rank and the outer symbols after it; whether one is left.
        """
        found = self.own.get(token)
        if found is None:
            parts, done = symbols(token), []
            first, last = parts[0], parts[-1]
            while True:
                best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                done.append((best[0], parts[0], parts[-1]))
            found = self.own[token] = (first, last, done, len(parts) == 1)
        return found

    def may_follow(self, left: str, right: str) -> bool:
        """Whether encoding both together gives these two: their own merges run side by side, and none
        across the border between them is ever due."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._may_follow(left, right)
        return found

    def _may_follow(self, left: str, right: str) -> bool:
        _, x, ours, _ = self.merges(left)
        y, _, theirs, _ = self.merges(right)
        i = j = 0
        never = float("inf")
        while True:
            a = ours[i][0] if i < len(ours) else never
            b = theirs[j][0] if j < len(theirs) else never
            across = self.rank(x, y)
            if across is not None and across < a and across <= b:
                return False
            if a == b == never:
                return True
            if a <= b:
                x = ours[i][2]
                i += 1
            else:
                y = theirs[j][1]
                j += 1


class ForwardStates:
    """The forward step as a deterministic transducer.

    A state holds what can still matter: the longest ending of the text so far that begins some token, and
    the last tokens of the prefixes within it (with counted, also their numbers of tokens, relative to
    now).  So there are finitely many; states and transitions are made when first met and kept.
    """

    def __init__(self, vocabulary: Tokens, counted: bool, most: int):
        self.vocabulary, self.counted, self.most = vocabulary, counted, most
        self.openings = {t[:k] for t in vocabulary.tokens for k in range(1, len(t.removesuffix(WORD_END)) + 1)}
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [("", (None,), (0,) if self.counted else ())]
        self.numbers = {self.states[0]: 0}
        #: by state: symbol -> (state, last token, change of the count)
        self.steps: list[dict[str, tuple[int, str, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]

    def last(self, number: int, symbol: str) -> tuple[str, str, int]:
        """The window with the symbol, the token that ends with it and the count with it, relative to before."""
        window, lasts, counts = self.states[number]
        read, vocabulary = window + symbol, self.vocabulary
        good = vocabulary.good
        for i in range(len(window) + 1):
            token = read[i:]
            if token in good:
                left = lasts[i]
                if left is None or left not in vocabulary.tokens or vocabulary.may_follow(left, token):
                    return read, token, (counts[i] if self.counted else 0) + 1
        return read, symbol, 1  # a symbol without a token stands alone

    def step(self, number: int, symbol: str) -> tuple[int, str, int]:
        found = self.steps[number].get(symbol)
        if found is None:
            state = self.states[number]
            read, token, count = self.last(number, symbol)
            # where no token that begins there can still be open, what stands before doesn't matter
            lasts, counts, cut = [*state[1], token], [c - count for c in state[2]], -1
            for i in range(len(read)):
                if read[i:] in self.openings:
                    cut = i if cut < 0 else cut
                else:
                    lasts[i] = ""
                    if self.counted:
                        counts[i] = 0
            cut = len(read) if cut < 0 else cut
            following = (read[cut:], tuple(lasts[cut:]), (*counts[cut:], 0) if self.counted else ())
            n = self.numbers.get(following)
            if n is None:
                n = self.numbers[following] = len(self.states)
                self.states.append(following)
                self.steps.append({})
                self.ends.append({})
            found = self.steps[number][symbol] = (n, token, count)
        return found
