"""Time phrases in questions: words become kinds, rules are sequences of kinds, calendars do the rest."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Fixed words.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT = ["jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}  # first month
WORDS = {
    "prep": ["in", "from", "during", "on", "of", "over", "for"], "the": ["the"], "act": ["taken", "shot"], "between": ["between"], "join": ["to", "and", "until", "till", "-", "–"],
    "since": ["since"], "rel": ["last", "this", "past"], "unit": ["year", "month", "week"], "day": ["today", "yesterday"],
}
PAST = {"year": 365, "month": 30, "week": 7}  # days, today included

#: One letter for each kind; "of" may also stand between a month and its year.
LETTER = {"prep": "p", "the": "t", "act": "a", "between": "b", "join": "j", "since": "s", "rel": "r", "unit": "u", "day": "d"}
KIND = {w: LETTER[k] for k, ws in WORDS.items() for w in ws} | {m: "m" for m in [*MONTHS, *SHORT]} | {s: "q" for s in SEASONS} | {"of": "o"}


@dataclass
class When:
    """Half-open ranges of days, or months of any year; the words of it for an answer; the text without the phrase."""

    label: str
    range: tuple[dt.date, dt.date] | None = None
    months: list[int] = field(default_factory=list)
    rest: str = ""


def month_of(word: str) -> int:
    return next(n for n, m in enumerate(MONTHS, 1) if m[:3] == word[:3])


def first_of(day: dt.date, months: int = 0) -> dt.date:
    """The first day of the month so many months later."""
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return dt.date(year, month + 1, 1)


def title(day: dt.date) -> str:
    return f"{MONTHS[day.month - 1].capitalize()} {day.year}"


def _years(words: list[str]) -> list[int]:
    return [int(w) for w in words if w.isdigit()]


def span(kinds: str, words: list[str], today: dt.date) -> When:
    a, b = sorted(_years(words))
    return When(f"from {a} to {b}", (dt.date(a, 1, 1), dt.date(b + 1, 1, 1)))


def since(kinds: str, words: list[str], today: dt.date) -> When:
    named = "m" in kinds
    start = dt.date(_years(words)[0], month_of(words[1]) if named else 1, 1)
    return When(f"since {title(start) if named else start.year}", (start, today + dt.timedelta(1)))


def recent(kinds: str, words: list[str], today: dt.date) -> When:
    if kinds.endswith("d"):
        at = today - dt.timedelta(words[-1] == "yesterday")
        return When(f"from {words[-1]}", (at, at + dt.timedelta(1)))
    rel, unit = words[-2:]
    if (rel, unit) == ("this", "week"):
        return When("from this week", (today - dt.timedelta(today.weekday()), today + dt.timedelta(1)))
    if rel == "past" or unit == "week":
        n = PAST[unit]
        return When(f"from the last {n} days", (today - dt.timedelta(n - 1), today + dt.timedelta(1)))
    length = {"year": 12, "month": 1}[unit]
    start = first_of(today.replace(month=1) if unit == "year" else today, -length if rel == "last" else 0)
    return When(f"from {rel} {unit} ({start.year if unit == 'year' else title(start)})", (start, first_of(start, length)))


def season(kinds: str, words: list[str], today: dt.date) -> When | None:
    name, rel, year = next(w for w in words if w in SEASONS), next((w for w in words if w in WORDS["rel"]), ""), _years(words)
    first = SEASONS[name]
    if not (rel or year):
        if not set("po") & set(kinds):
            return None
        return When(f"from {name} (any year)", months=[(first + k - 1) % 12 + 1 for k in range(3)])
    if year:
        start = dt.date(year[0], first, 1)
    elif rel == "this":  # last year's if it is not over yet, else the one of this year
        before, start = (dt.date(today.year - k, first, 1) for k in (1, 0))
        start = before if first_of(before, 3) > today else start
    else:  # the latest one that is over
        start = max(s for k in range(3) if first_of(s := dt.date(today.year - k, first, 1), 3) <= today)
    last = first_of(start, 2)
    years = f"{start.year}" if last.year == start.year else f"{start.year}–{last.year}"
    return When(f"from {name} {years} ({MONTHS[first - 1].capitalize()}–{MONTHS[last.month - 1].capitalize()})", (start, first_of(start, 3)))


def month(kinds: str, words: list[str], today: dt.date) -> When | None:
    at = kinds.index("m")
    n, rel, year = month_of(words[at]), "r" in kinds and words[kinds.index("r")], _years(words)
    if rel or year:
        of_year = [dt.date(y, n, 1) for y in (year[:1] or [today.year, today.year - 1])]
        over = [s for s in of_year if first_of(s, 1) <= today]  # the latest one comes first
        start = over[0] if rel == "last" and not year else of_year[0]
        return When(f"from {title(start)}", (start, first_of(start, 1)))
    # A month alone needs a word before it; "may" and "mar" need one that can only mean time.
    before = [w for w in words[:at] if w in WORDS["prep"]]
    if not before or words[at] in ("may", "mar") and before[-1] not in ("in", "from", "during"):
        return None
    return When(f"from {MONTHS[n - 1].capitalize()} (any year)", months=[n])


def year(kinds: str, words: list[str], today: dt.date) -> When:
    y = _years(words)[0]
    return When(f"from {y}", (dt.date(y, 1, 1), dt.date(y + 1, 1, 1)))


#: Rules in order, over kinds; y is a year. A rule that gives nothing at its first place may look further.
LEAD = "(?:a?[po])?t?"
RULES: list[tuple[str, Callable[..., When | None], bool]] = [
    ("[pob]?yjy", span, False), ("sm?y", since, False), (f"{LEAD}(?:d|ru)", recent, False),
    (f"{LEAD}r?q(?:o?y)?", season, False), (f"{LEAD}r?m(?:o?y)?", month, True), (f"{LEAD}y", year, False),
]
TOKEN = re.compile(r"\w+|[^\w\s]")


def kind_of(word: str) -> str:
    if len(word) == 4 and word.isdigit() and word[:2] in ("19", "20"):
        return "y"
    return KIND.get(word, "x")


def find_time(text: str, today: dt.date) -> When | None:
    """The time phrase of the first rule that fits anywhere in the text."""
    found = list(TOKEN.finditer(text))
    words = [m.group().lower() for m in found]
    kinds = "".join(map(kind_of, words))
    for rule, read, further in RULES:
        for m in re.finditer(rule, kinds):
            when = read(m.group(), words[m.start(): m.end()], today)
            if when is not None:
                rest = f"{text[: found[m.start()].start()]} {text[found[m.end() - 1].end():]}"
                when.rest = re.sub(r"\s+([?.!,])", r"\1", " ".join(rest.split()))
                return when
            if not further:
                break
    return None
