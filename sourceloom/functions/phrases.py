"""Whole phrases in texts by one pass of an automaton, whatever the number of phrases.

Phrases of at most three letters (dots aside) count in capitals between characters that are no ASCII letters; longer ones count in any case between
characters that are no letters. Each phrase stands for the numbers of its groups, so a pass tells which groups a text mentions.
"""

from __future__ import annotations

import ahocorasick


class _Folds(dict):
    """Characters to their case-folded single character, computed as they come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = c.upper().lower() if len(c.upper()) == 1 else c.lower()
        out = self[code] = low if len(low) == 1 else "i" if c == "İ" else c
        return out


def fold(text: str, folds: _Folds) -> str:
    """text in one case, character by character, so that places stay the same."""
    return text.lower() if text.isascii() else text.translate(folds)


def is_short(phrase: str) -> bool:
    return len(phrase.replace(".", "")) <= 3


class PhraseSet:
    """Groups of phrases, ready to be sought together."""

    def __init__(self, groups: list[list[str]]) -> None:
        self.folds, self.every = _Folds(), (1 << len(groups)) - 1
        words: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for i, phrases in enumerate(groups):
            for p in phrases:
                kind, key = (0, p.upper()) if is_short(p) else (1, fold(p, self.folds))
                words[kind][key] = words[kind].get(key, 0) | 1 << i
        self.short, self.long = map(self._automaton, words)

    @staticmethod
    def _automaton(words: dict[str, int]):
        out = ahocorasick.Automaton()
        for w, mask in words.items():
            out.add_word(w, (len(w), mask))
        out.make_automaton()
        return out if len(out) else None

    def mentioned(self, text: str | None, sought: int | None = None) -> int:
        """The groups that the text mentions, a bit each; only those of the bits sought are looked for."""
        sought = self.every if sought is None else sought
        found = 0
        if not text or not sought:
            return 0
        if self.short:
            letter = lambda c: c.isascii() and c.isalpha()
            found = self._scan(self.short, text, letter, sought, found)
        if self.long and sought & ~found:
            found = self._scan(self.long, fold(text, self.folds), str.isalpha, sought, found)
        return found & sought

    @staticmethod
    def _scan(automaton, text: str, letter, sought: int, found: int) -> int:
        last = len(text) - 1
        for end, (length, mask) in automaton.iter(text):
            if mask & sought & ~found:
                at = end - length
                if (at < 0 or not letter(text[at])) and (end == last or not letter(text[end + 1])):
                    found |= mask
                    if not sought & ~found:
                        break
        return found
