"""Plain, slow NumPy statement of the classifier, used as the expected answer."""

from hashlib import md5

import numpy as np


def memory(dim, levels, seed):
    row = np.full(dim, -1)
    out = []
    for level in range(levels):
        quota = dim // 2 if level == 0 else int(dim / 2 / levels)
        order = sorted(range(dim), key=lambda d: (md5(f"{seed}:{level}:{d}".encode()).hexdigest(), d))
        row = row.copy()
        row[order[:quota]] *= -1
        out.append(row)
    return np.array(out)


def edges(x, levels):
    lo, hi = x.min(), x.max()
    return [lo + k * ((hi - lo) / levels) for k in range(levels)] + [hi]


def level(value, edge):
    last = len(edge) - 2
    return min(max(sum(e <= value for e in edge[:-1]) - 1, 0), last)


def encode(x, edge, mem):
    return np.array([
        sum(np.roll(mem[level(v, edge)], f) for f, v in enumerate(row)) for row in x
    ])


def guess(classes, hv):
    best, name = -np.inf, next(iter(classes))
    for label, vector in classes.items():
        size = np.linalg.norm(vector) * np.linalg.norm(hv)
        score = np.dot(vector, hv) / size if size else np.nan
        if round(score, 12) > best:
            best, name = round(score, 12), label
    return name


def train(x, y, edge, mem):
    classes = {}
    for hv, label in zip(encode(x, edge, mem), y):
        classes[label] = classes.get(label, 0) + hv
    return classes


def accuracy(classes, hvs, y):
    return round(100 * np.mean([guess(classes, hv) == t for hv, t in zip(hvs, y)]) + 1e-9, 2)


def history(train_x, train_y, test_x, test_y, dim, levels, seed, passes, stop=False, batch=False):
    mem, edge = memory(dim, levels, seed), edges(train_x, levels)
    classes = train(train_x, train_y, edge, mem)
    hv, test_hv = encode(train_x, edge, mem), encode(test_x, edge, mem)
    out, before = [(0, None, accuracy(classes, test_hv, test_y))], None
    for step in range(1, passes + 1):
        wrong, now = 0, {k: v.copy() for k, v in classes.items()}
        for row, label in zip(hv, train_y):
            found = guess(now if batch else classes, row)
            if found != label:
                wrong += 1
                classes[found] = classes[found] - row
                classes[label] = classes[label] + row
        error = wrong / len(hv)
        out.append((step, error, accuracy(classes, test_hv, test_y)))
        if stop and error == before:
            break
        before = error
    return out
