"""Small panels and a plain-Python restatement of the study's rules, for brute-force checks."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

START, END = dt.date(2020, 1, 1), dt.date(2021, 12, 31)


def months(start=START, end=END):
    out, day = [], start.replace(day=1)
    while day <= end:
        out.append(day)
        day = (day + dt.timedelta(days=32)).replace(day=1)
    return out


def random_prices(tickers=17, seed=3, gap=0.08, steps=(3, 4, 6, 7)):
    """Daily walks with missing days, skipped months, late starts and early ends."""
    rng = random.Random(seed)
    rows = []
    for number in range(tickers):
        price, sigma = 100.0, 0.3 + 0.1 * number
        first = rng.choice([0, 0, 0, 2, 9])
        last = rng.choice([24, 24, 24, 19, 15])
        for index, month in enumerate(months()):
            skipped = rng.random() < gap
            for day in range(1, 29, rng.choice(steps)):
                price *= 1 + rng.gauss(0, sigma) / 100
                if first <= index < last and not skipped:
                    rows.append((f"T{number:02d}", month.replace(day=day), price))
    return rows


def brute_monthly(rows, start=START, end=END):
    grid = months(start, end)
    by = {}
    for ticker, day, price in sorted(rows):
        by.setdefault(ticker, {}).setdefault(day.replace(day=1), []).append((day, price))
    returns = {}
    for ticker, buckets in by.items():
        for i, month in enumerate(grid):
            days = buckets.get(month, [])
            value = None
            if len(days) >= 5 and i < len(grid) - 1:
                base = days[0][1]
                if i > 0 and buckets.get(grid[i - 1]):
                    base = buckets[grid[i - 1]][-1][1]
                value = (days[-1][1] / base - 1) * 100
            returns[ticker, month] = value
    return returns


def shift(month, n):
    index = month.year * 12 + month.month - 1 + n
    return dt.date(index // 12, index % 12 + 1, 1)


def brute_pti(rows, members, lookback, coverage, minimum, start=START, end=END):
    """{holding month: (P1..P5)} by nested loops; ``members(date)`` gives the index or None."""
    grid, returns = months(start, end), brute_monthly(rows, start, end)
    spans = {}
    for ticker, day, _ in rows:
        low, high = spans.get(ticker, (day, day))
        spans[ticker] = (min(low, day), max(high, day))
    out = {}
    for i in range(lookback + 1, len(grid)):
        formation = grid[i - 1]
        index = members(formation)
        eligible = [
            t for t, (low, high) in spans.items()
            if low <= shift(formation, -lookback) and high >= formation
            and (index is None or t in index)
        ]
        if len(eligible) < 5 * minimum:
            continue
        vols = {}
        for ticker in eligible:
            window = [returns[ticker, m] for m in grid[max(0, i - lookback - 1): i]]
            window = [v for v in window if v is not None]
            if len(window) >= math.ceil(lookback * coverage) and len(window) > 1:
                vols[ticker] = round(statistics.stdev(window), 9)
        if len(vols) < 5 * minimum:
            continue
        order = sorted(vols, key=lambda t: (vols[t], t))
        size = len(order) // 5
        means = []
        for q in range(5):
            group = [returns[t, grid[i]] for t in order[q * size:(q + 1) * size]]
            valid = [v for v in group if v is not None]
            if len(valid) < math.ceil(size * coverage):
                break
            means.append(sum(valid) / len(valid) if valid else None)
        if len(means) == 5 and None not in means:
            out[grid[i]] = means
    return out
