"""Document statistics and tree growing worked out a second time, row by row."""

import math
import random
import statistics as st

import numpy as np
import pytest

from changelens.llm import quality


def plain(text):
    words = text.split()
    if not words:
        return [0.0] * len(quality.FEATURES)
    data, lines, n = text.encode("utf-8", "replace"), text.split("\n"), len(words)
    pairs = list(zip(words, words[1:]))
    return [
        math.log(1 + len(text)), math.log(1 + n), st.fmean(map(len, words)), st.pstdev(map(len, words)), len(set(words)) / n, sum(a == b for a, b in pairs) / n,
        max(words.count(w) for w in set(words)) / n, math.log(1 + len(lines)), len(set(lines)) / len(lines), len(text) / len(lines),
        sum(w.isupper() for w in words) / n, sum(not w.isalpha() for w in words) / n, len(set(pairs)) / n, sum(b >= 128 for b in data) / len(data),
        *(sum(b in group for b in data) / len(data) for group in quality.GROUPS),
    ]


def test_statistics_equal_plain_counts():
    texts = ["", " \n", "one", "A B a b\n\nÜber 12 %", "x x x y\nx x", "w " * 500, "mixed-Case WORDS, and 3.14!\t(end)\r\nlast", "é" * 50]
    assert np.allclose(quality.statistics(texts), [plain(t) for t in texts])


def grown(table, label, trees, depth, rate, bins, smooth, least):
    """Every split tried on the rows themselves."""
    share = (sum(label) + 0.5) / (len(label) + 1)
    margin = [math.log(share / (1 - share))] * len(label)
    edges = [sorted(set(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for column in table.T]
    out = []
    for _ in range(trees):
        chance = [1 / (1 + math.exp(-m)) for m in margin]
        slope, curve = [c - y for c, y in zip(chance, label)], [c * (1 - c) for c in chance]
        part = lambda rows: (sum(slope[r] for r in rows), sum(curve[r] for r in rows), len(rows))
        tree, leaves = {}, {}

        def split(node, rows, level):
            if level == depth:
                g, h, _ = part(rows)
                leaves[node - (2**depth - 1)] = -rate * g / (h + smooth)
                return
            best = (1e-9, 0, math.inf)
            for f in range(table.shape[1]):
                own = (0.0, None)
                for edge in edges[f]:
                    left = [r for r in rows if table[r, f] <= edge]
                    right = [r for r in rows if table[r, f] > edge]
                    (g, h, c), (g2, h2, c2) = part(left), part(right)
                    gain = g * g / (h + smooth) + g2 * g2 / (h2 + smooth) - (g + g2) ** 2 / (h + h2 + smooth) if c >= least and c2 >= least else 0.0
                    if own[1] is None or gain > own[0] + 1e-12:
                        own = (gain, edge)
                if own[1] is not None and own[0] > best[0] + 1e-12:
                    best = (own[0], f, own[1])
            _, f, edge = best
            tree[node] = (f, edge)
            split(2 * node + 1, [r for r in rows if table[r, f] <= edge], level + 1)
            split(2 * node + 2, [r for r in rows if table[r, f] > edge], level + 1)

        split(0, range(len(label)), 0)
        for r in range(len(label)):
            node = 0
            for _ in range(depth):
                f, edge = tree[node]
                node = 2 * node + 1 + (table[r, f] > edge)
            margin[r] += leaves[node - (2**depth - 1)]
        out.append((tree, leaves))
    return out, margin


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_every_split_tried(seed):
    rng = random.Random(seed)
    table = np.array([[rng.random(), rng.randint(0, 3), rng.gauss(0, 1), 1.0] for _ in range(70)])
    label = np.array([float(rng.random() < (0.9 if row[0] + 0.2 * row[1] > 0.8 else 0.1)) for row in table])
    made = quality.grow(table, label, trees=4, depth=3, bins=8, least=3)
    want, margin = grown(table, label.tolist(), 4, 3, 0.1, 8, 1.0, 3)
    for at, (tree, leaves) in enumerate(want):
        assert [made.threshold[at][n] for n in sorted(tree)] == pytest.approx([tree[n][1] for n in sorted(tree)])
        assert [made.feature[at][n] for n in sorted(tree) if tree[n][1] < math.inf] == [tree[n][0] for n in sorted(tree) if tree[n][1] < math.inf]
        assert made.leaf[at].tolist() == pytest.approx([leaves[n] for n in sorted(leaves)])
    assert made.score(table).tolist() == pytest.approx([1 / (1 + math.exp(-m)) for m in margin])
