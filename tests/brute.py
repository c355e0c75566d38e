"""Straightforward single-machine models of the definitions, for comparison on small record sets."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations


def random_records(seed, n=None, items=6, classes=2, fill=0.5):
    rng = random.Random(seed)
    names = list(range(10, 10 + items))
    size = n or rng.randint(3, 14)
    return [(tuple(i for i in names if rng.random() < fill), rng.randrange(classes)) for _ in range(size)]


def measures(a, k, c, n):
    spread = a * c * (n - a) * (n - c)
    chi2 = math.nan if spread == 0 else float(Fraction(n * (n * k - a * c) ** 2, spread))
    return k / n, k / a, chi2


def line(ant, con, sup, conf, chi2):
    return f"{' '.join(map(str, ant))} -> {con} ({sup:.6f}, {conf:.6f}, {'NaN' if math.isnan(chi2) else f'{chi2:.6f}'})"


def in_order(rules):
    return sorted(rules, key=lambda r: (r[3], r[2], len(r[0]), line(*r)), reverse=True)


def good(conf, chi2, min_conf, min_chi2):
    return conf >= min_conf and (math.isnan(chi2) or chi2 >= min_chi2)


def support_rules(records, min_sup, min_conf, min_chi2, max_len=10):
    n = len(records)
    least = math.ceil(min_sup * n)
    per_class = Counter(label for _, label in records)
    freq = Counter(i for items, _ in records for i in items)
    ranked = sorted((i for i in freq if freq[i] >= least), key=lambda i: (-freq[i], i))
    rules = []
    for size in range(1, max_len + 1):
        for combo in combinations(reversed(ranked), size):
            hits = Counter(label for items, label in records if set(combo) <= set(items))
            if not hits or max(hits.values()) < least:
                continue
            for con in (x for x in hits if hits[x] == max(hits.values())):
                m = measures(sum(hits.values()), hits[con], per_class[con], n)
                if size == 1 or good(m[1], m[2], min_conf, min_chi2):
                    rules.append((combo, con, *m))
    return in_order(rules)


def _gini(counts):
    n = sum(counts.values())
    return 1 - sum(Fraction(v, n) ** 2 for v in counts.values()) if n else Fraction(0)


def gain_rules(records, min_sup, min_conf, min_chi2):
    n = len(records)
    least = math.ceil(min_sup * n)
    per_class = Counter(label for _, label in records)
    by_item = {}
    for items, label in records:
        for i in items:
            by_item.setdefault(i, Counter())[label] += 1
    value = {
        i: Fraction(sum(c.values()), n) * (_gini(per_class) - _gini(c))
        for i, c in by_item.items()
        if sum(c.values()) >= least
    }
    order = sorted((i for i in value if value[i] > 0), key=lambda i: (value[i], i), reverse=True)
    paths = [(tuple(i for i in order if i in items), label) for items, label in records]
    paths = [p for p in paths if p[0]]

    def counts_below(prefix):
        return Counter(label for path, label in paths if path[: len(prefix)] == prefix)

    def rule_of(prefix, counts):
        best = max(counts.values())
        con = min(x for x in counts if counts[x] == best)
        hits = Counter(label for items, label in records if set(prefix) <= set(items))
        m = measures(sum(hits.values()), hits[con], per_class[con], n)
        return [(prefix, con, *m)] if good(m[1], m[2], min_conf, min_chi2) else []

    def walk(prefix, above):
        counts = counts_below(prefix)
        if not (_gini(above) - _gini(counts) > 0 and max(counts.values()) >= least):
            return []
        if _gini(counts) == 0:
            return rule_of(prefix, counts)
        nexts = sorted({p[len(prefix)] for p, _ in paths if len(p) > len(prefix) and p[: len(prefix)] == prefix})
        below = [r for i in nexts for r in walk((*prefix, i), counts)]
        return below or rule_of(prefix, counts)

    root = counts_below(())
    return in_order([r for i in sorted({p[0] for p, _ in paths}) for r in walk((i,), root)])


def covered(rules, records):
    used, spare, left = [], [], list(records)
    for rule in rules:
        hit = [r for r in left if set(rule[0]) <= set(r[0])]
        if not hit:
            spare.append(rule)
        elif any(label == rule[1] for _, label in hit):
            used.append(rule)
            left = [r for r in left if not set(rule[0]) <= set(r[0])]
    return used, spare


def probability(rules, items, classes, voting, metric, weight, default):
    hits = [r for r in rules if set(r[0]) <= set(items)]
    if not hits:
        return default
    votes = {}
    for c in classes:
        own = [1 - r[2] if metric == "support" else r[3] for r in hits if r[1] == c]
        if own:
            votes[c] = {"mean": sum(own) / len(own), "min": min(own), "max": max(own)}[voting]
    rest = math.prod(1 - v for v in votes.values())
    if (voting, metric, weight) == ("max", "confidence", "none") and len(votes) < len(classes):
        rest /= len(classes) - len(votes)
    if weight == "numRules":
        votes = {c: v * sum(r[1] == c for r in hits) / len(hits) for c, v in votes.items()}
    raw = [votes.get(c, rest) for c in classes]
    return [v / sum(raw) for v in raw]
