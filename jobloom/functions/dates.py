"""Dates in adverts: what is a date, and which one is the deadline or the publication."""

from __future__ import annotations

from datetime import date

from jobloom.functions import vocabulary as V
from jobloom.functions.phrases import Phrases, Text

MONTH = {name: n for n, names in V.MONTHS.items() for name in names.split()}
WEEKDAYS, TIMES, ZONES = set(V.WEEKDAYS.split()), set(V.TIMES.split()), set(V.ZONES.split())
CUES = Phrases({kind: {"": phrases} for kind, phrases in V.DATES.items()})
ORDINALS = ("st", "nd", "rd", "th")
#: Characters between an announcement and its date: of words alone, and behind a time of day; between "extended" and its date; of a call.
NEAR, BEHIND_TIME, LONGER, CALL = 46, 34, 32, 42
SUBMIT = 200


def made(year: str, month: int, day: str) -> date | None:
    try:
        return date(int(year), month, int(day))
    except ValueError:
        return None


def day_of(word: str) -> str | None:
    """The digits of a day of the month, with or without an ordinal ending."""
    digits = word[:-2] if word.endswith(ORDINALS) else word
    return digits if digits.isdecimal() and len(digits) <= 2 else None


def date_at(text: Text, k: int) -> tuple[bool, date | None]:
    """Whether three words from k on have the form of a date, and the date; ambiguous figures are day first."""
    if k + 2 >= text.n or (k and text.gap(k - 1) == "." and text.low[k - 1].isdecimal()):
        return False, None
    a, b, c = text.low[k : k + 3]
    g, h = text.gap(k).strip(), text.gap(k + 1).strip()
    if a.isdecimal() and b.isdecimal() and c.isdecimal():
        if g == h and len(b) <= 2 and (len(a), len(c), g in (".", "/", "-")) in ((1, 4, True), (2, 4, True)):
            return True, made(c, int(b), a)
        if g == h and g in ("-", "/") and len(a) == 4 and len(b) <= 2 and len(c) <= 2:
            return True, made(a, int(b), c)
        return False, None
    if not (c.isdecimal() and len(c) == 4):
        return False, None
    if b in MONTH and (day := day_of(a)) and g in ("", ".", "-") and h in ("", ",", ".", "-", ".,"):
        return True, made(c, MONTH[b], day)
    if a in MONTH and (day := day_of(b)) and g in ("", ".") and h in ("", ","):
        return True, made(c, MONTH[a], day)
    return False, None


def parse_date(value: str) -> date | None:
    """A text that is a date and nothing else, but for a weekday before it."""
    text = Text(value)
    first = 1 if text.n == 4 and text.low[0] in WEEKDAYS else 0
    return date_at(text, first)[1] if text.n - first == 3 else None


def is_aside(text: Text, k: int) -> bool:
    """Whether a number is a time of day, an offset from a time zone or a count of days."""
    word = text.low[k]
    if word.rstrip("apmhrs").isdecimal() and not word.isdecimal():
        return True
    before, after = text.gap(k - 1), text.gap(k)
    clock = ":" in (before.strip(), after.strip()) or after == "." and k + 2 < text.n and text.low[k + 2] in TIMES and text.low[k + 1].isdecimal()
    return clock or k + 1 < text.n and text.low[k + 1] in TIMES or k > 0 and text.low[k - 1] in ZONES


def after_words(text: Text, j: int, near: int, later: int | None = None) -> date | None:
    """The date behind word j - 1, with words and (if later is given) times between; none if another number comes first."""
    last, limit, k = text.end[j - 1], near, j
    while k < text.n and text.start[k] - last < limit:
        shaped, found = date_at(text, k)
        if shaped:
            return found
        if text.low[k][0].isdecimal():
            if later is None or not is_aside(text, k):
                return None
            last, limit = text.end[k], later
        k += 1
    return None


def right_after(text: Text, j: int) -> date | None:
    """The date at word j, but for an article and a weekday before it."""
    for skipped in ({"the"}, WEEKDAYS):
        if j < text.n and text.low[j] in skipped:
            j += 1
    if j >= text.n or text.gap(j - 1).strip() not in ("", ","):
        return None
    return date_at(text, j)[1]


def same_sentence(gap: str) -> bool:
    return ";" not in gap and not (gap.startswith(".") and gap[1:2].isspace())


def extension(text: Text, hits: dict) -> date | None:
    """The date to which a call is extended: a call's word, at most one date, and "extended", in one sentence without a contract's words."""
    longer = {i: j for i, j, _ in hits["longer"]}
    terms = {i for i, _, _ in hits["term"]}
    begins = [(i, j, True) for i, j, _ in hits["longer_call"]] + [(i, j, False) for i, j, _ in hits["call"]]
    for _, j, whole in sorted(begins):
        if whole:
            if found := after_words(text, j, LONGER):
                return found
            continue
        k, left, dated = j, CALL, 0
        while k < text.n and left > 0 and k not in terms:
            gap = text.gap(k - 1)
            if set(".;") & set(gap) and not (k == dated and k in longer):
                break
            if k in longer:
                if found := after_words(text, longer[k], LONGER):
                    return found
                break
            if not dated and date_at(text, k)[0]:
                k = dated = k + 3
                continue
            if text.low[k][0].isdecimal():
                break
            left -= len(gap) + len(text.low[k])
            k += 1
    return None


def deadline(value: str) -> date | None:
    """The date that counts: of an extension if one is stated, else the one announced first."""
    text = Text(value)
    hits = CUES.find(text)
    if found := extension(text, hits):
        return found
    stated = [(i, after_words(text, j, NEAR, BEHIND_TIME)) for i, j, _ in hits["announced"]]
    ends = {i: j for i, j, _ in hits["until"]}
    stated += [(i, right_after(text, ends[j])) for i, j, _ in hits["taken"] if j in ends and text.joined(j - 1)]
    stated += [(i, right_after(text, j)) for i, j, _ in hits["runs_out"]]
    verbs = {i for i, _, _ in hits["verb"]}
    for i, j, _ in hits["people"]:
        # "Candidates should by <date> send": the date has three words.
        if text.low[j : j + 2] == ["should", "by"] and (found := right_after(text, j + 2)) and j + 5 in verbs:
            stated.append((i, found))
    for i, j, _ in hits["verb"]:
        for k in range(j, text.reach(j, SUBMIT)):
            if not same_sentence(text.gap(k - 1)):
                break
            if text.low[k] == "by" and (found := right_after(text, k + 1)):
                stated.append((i, found))
                break
    return min((x for x in stated if x[1]), default=(0, None))[1]


def published(value: str) -> date | None:
    text = Text(value)
    return next((found for _, j, _ in CUES.find(text)["published"] if (found := after_words(text, j, 22))), None)
