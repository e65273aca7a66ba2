"""Phrases in texts: found over the words of one text, or stated as a pattern for Spark's own functions."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\W_]+")
#: Distinct words of which a worker keeps what may begin with them.
KEPT = 1 << 17
#: What may stand between two words of a phrase, besides white space.
JOINTS = {"", "-", "–", "/", "'", "’", "´", "&"}


def listed(phrases: str) -> list[str]:
    return [p.strip() for p in phrases.split(",")]


def pattern(phrases: str) -> str:
    """A pattern (Java's) of any of the phrases as whole words; those with capitals keep them."""
    stated = []
    for p in listed(phrases):
        body = r"[\s-]+".join(re.escape(w[:-1]) + r"\w*" if w.endswith("*") else re.escape(w) for w in p.split())
        stated.append(f"(?-i:{body})" if p != p.lower() else body)
    return rf"(?<!\w)(?:{'|'.join(stated)})(?!\w)"


def grade_pattern(series: dict[str, int]) -> str:
    """A pattern of grades as series and number, by the highest number of each."""
    numbers = {top: rf"[1-{top}]" if top < 9 else r"\d" if top == 9 else r"\d{1,2}" for top in series.values()}
    return rf"(?<!\w)(?:{'|'.join(f'{s}-?{numbers[top]}' for s, top in series.items())})(?!\w)"


class Phrases:
    """Named lists of phrases, looked up by the beginning of their first word."""

    def __init__(self, kinds: dict[str, dict[str, str]]):
        self.heads = defaultdict(list)
        for kind, names in kinds.items():
            for name, phrases in names.items():
                for p in listed(phrases):
                    words = [(w.rstrip("*"), w.endswith("*"), w != w.lower()) for w in p.split()]
                    self.heads[words[0][0][:2].lower()].append((words, kind, name))
        for found in self.heads.values():
            found.sort(key=lambda x: -len(x[0]))
        self.known: dict[str, list] = {}

    def begun(self, word: str) -> list:
        """The phrases that may begin with a word in lower case."""
        if len(self.known) >= KEPT:
            self.known.clear()
        fits = lambda w, open_: word.startswith(w.lower()) if open_ else word == w.lower()
        self.known[word] = found = [x for x in self.heads.get(word[:2], ()) if fits(*x[0][0][:2])]
        return found

    def find(self, text: Text) -> dict[str, list[tuple[int, int, str]]]:
        """By kind the (first word, word after the last, name) of what occurs, in order; of one kind and name the longest at each place."""
        out, known = defaultdict(list), self.known
        for i, word in enumerate(text.low):
            begun = known.get(word)
            if begun is None:
                begun = self.begun(word)
            if not begun:
                continue
            done = set()
            for words, kind, name in begun:
                if (kind, name) not in done and text.has(i, words):
                    done.add((kind, name))
                    out[kind].append((i, i + len(words), name))
        return out


class Text:
    """The words of a text with their places."""

    def __init__(self, text: str):
        spans = [m.span() for m in WORD.finditer(text)]
        self.text, self.n = text, len(spans)
        self.words = [text[s:e] for s, e in spans]
        self.low = [w.lower() for w in self.words]
        self.start, self.end = [s for s, _ in spans], [e for _, e in spans]

    def gap(self, k: int) -> str:
        """What stands between word k and the next; behind the last, the rest; before the first (-1), the beginning."""
        return self.text[self.end[k] if k >= 0 else 0 : self.start[k + 1] if k + 1 < self.n else len(self.text)]

    def joined(self, k: int) -> bool:
        gap = self.gap(k)
        return gap == "." or gap.strip() in JOINTS

    def has(self, i: int, words: list[tuple[str, bool, bool]]) -> bool:
        if i + len(words) > self.n:
            return False
        for k, (w, open_, exact) in enumerate(words, i):
            found = self.words[k] if exact else self.low[k]
            if not (found.startswith(w) if open_ else found == w) or k > i and not self.joined(k - 1):
                return False
        return True

    def reach(self, k: int, chars: int) -> int:
        """The word after the last that begins within so many characters behind word k - 1."""
        at = self.end[k - 1] if k else 0
        while k < self.n and self.start[k] - at < chars:
            k += 1
        return k
