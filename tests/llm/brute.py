"""Plain answers to small cases."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_LOWER = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(TO_LOWER))


def shingle_set(text, size):
    found = words(text)
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def near_components(texts, size, percent):
    """{id: (set size, smallest id reachable)} over all pairs."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    seen = defaultdict(list)
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in seen[s])
        for j, both in common.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            seen[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [
        (kind, *m.span())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text)
        if _holds(kind, m[0])
    ]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def repeated_places(texts, length):
    """For each run of so many words that several documents hold, its places in each of them."""
    places = defaultdict(lambda: defaultdict(list))
    for i, text in texts.items():
        found = words(text)
        for j in range(len(found) - length + 1):
            places[tuple(found[j : j + length])][i].append(j)
    return {run: dict(found) for run, found in places.items() if len(found) > 1}


BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damaged_rows(rows):
    """{conv_id: [(turn, role, text)]} after the damage of the query, in order."""
    left = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        left[conv]  # also conversations that lose all rows
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        left[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rs in left.items()}


def cheapest_edits(rows):
    """Counts, cost, audit and repaired text of one conversation's rows, by all edits at once."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None
        faults.append(fault or ("truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    roles = [role[:1] for _, role, _ in rows]
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    following = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    # Best (cost, audit, text) to the end from each state in front of each row.
    best = {"": (0, "", ()), "a": (0, "", ()), "s": None, "u": None}

    def inserted(best):
        for _ in range(3):
            for state in best:
                for role, name in (("u", "user"), ("a", "assistant")):
                    if role in following[state] and best[role] is not None:
                        cost, audit, text = best[role]
                        option = (cost + 2, "I" + audit, (f"{name}:", *text))
                        if best[state] is None or option[:2] < best[state][:2]:
                            best[state] = option
        return best

    best = inserted(best)
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        before = {}
        for state in best:
            options = []
            if best[state] is not None:
                cost, audit, rest = best[state]
                options.append((cost + 3, "D" + audit, rest))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                new = [("K", role[:1], role, 0), ("R", "u", "user", 2), ("R", "a", "assistant", 2)]
                for letter, to, name, price in new:
                    if to in following[state] and best[to] is not None:
                        cost, audit, rest = best[to]
                        options.append((cost + price + extra, letter + audit, (f"{name}:{text}", *rest)))
            before[state] = min(options, key=lambda o: o[:2]) if options else None
        best = inserted(before)
    cost, audit, text = best[""]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(pair not in legal for pair in zip(roles, roles[1:]))
    return (gaps, *counts, illegal, cost, audit, "\n".join(text))


def periodic_runs(found):
    """(start, length, smallest period) of the runs of a list of words."""
    n, runs = len(found), []
    for period in range(1, n // 4 + 1):
        i = 0
        while i + period < n:
            end = i
            while end + period < n and found[end] == found[end + period]:
                end += 1
            length = end - i + period
            if end > i and length >= max(6, 4 * period):
                part = found[i : i + length]
                if not any(part[q:] == part[:-q] for q in range(1, period)):
                    runs.append((i, length, period))
            i = max(end, i) + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(texts, items, window):
    """{id: (words, words hit, sorted items)}; ``items`` are pairs of an id and a text."""
    owners = defaultdict(set)
    for item, text in items:
        found = PLAIN_WORD.findall((text or "").translate(TO_LOWER))
        for i in range(max(len(found) - window + 1, 1) if found and item is not None else 0):
            owners[tuple(found[i : i + window])].add(item)
    lengths = sorted({len(phrase) for phrase in owners})
    result = {}
    for key, text in texts.items():
        found = PLAIN_WORD.findall((text or "").translate(TO_LOWER))
        hit, held = set(), set()
        for n in lengths:
            for i in range(len(found) - n + 1):
                phrase = tuple(found[i : i + n])
                if phrase in owners:
                    held |= owners[phrase]
                    hit |= set(range(i, i + n))
        result[key] = (len(found), len(hit), sorted(held))
    return result
