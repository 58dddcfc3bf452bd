from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from siftstone.llm.splitting import LIMIT, OVERLAP, TOKEN, boundaries, cuts, pieces_of, split_oversized


def check(code: str):
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(code)]
    got = pieces_of(code)
    assert all(n <= LIMIT for _, _, n in got)
    assert (len(got) > 1) == (len(spans) > LIMIT)
    own = [got[0][0], *[b for _, b, _ in got]]
    assert own[0] == 0 and own[-1] == len(code) and own == sorted(own)
    for (a, b, n), (a2, b2, _) in zip(got, got[1:]):
        before = [s for s in spans if a <= s[0] < b]
        assert len(before) == n and a2 == before[-OVERLAP][0] and b2 > b  # starts with the last tokens of the one before
    return got


def function(r, name, lines):
    body = "\n".join("    " + " ".join(f"t{r.randrange(99)}" for _ in range(r.randrange(1, 12))) + ";" for _ in range(lines))
    return f"void {name}() {{\n{body}\n}}\n"


def test_pieces_of_functions():
    r = random.Random(1)
    for _ in range(30):
        code = "\n".join(function(r, f"f{i}", r.randrange(2, 30)) for i in range(r.randrange(1, 14)))
        got = check(code)
        for _, b, _ in got[:-1]:
            assert code[:b].rstrip(" ").endswith("\n")  # only between lines


def test_cut_between_functions_where_possible():
    r = random.Random(2)
    code = "".join(function(r, f"f{i}", 20) for i in range(8))
    starts = {m.start() for m in re.finditer("void", code)}
    assert all(b in starts for _, b, _ in check(code)[:-1])


@pytest.mark.parametrize(
    "code",
    ["", " \n", "x", "x " * 510, "x " * 511, "x" * 10_000, "x;" * 4000, "é " * 3000, "\r\n".join(["a b c"] * 400), "\r".join(["a b c"] * 400), "\x1c" * 600, " ".join("ab" for _ in range(900)),
     "a\n" * 70 + "x " * 2000, "x " * 2000 + "\n" * 50, "{" * 3000, "😀" * 1200, "﻿x = 1\n" * 300],
)
def test_any_text(code):
    check(code)


def test_very_long_line():
    check("word+" * 60_000)


def best_by_hand(n, at, penalty, limit, overlap):
    """The best cuts by trying all, ties for the longest last piece, then the longest before it."""
    points = {0: 0, **{a: p for a, p in zip(at, penalty) if a >= overlap}, n: 0}
    memo = {0: (0, [])}
    for j in sorted(points)[1:]:
        options = []
        for i in sorted(points):
            size = j - i + (overlap if i else 0)
            if i < j and size <= limit and i in memo:
                options.append((memo[i][0] + 10 * limit**2 + 10 * (limit - size) ** 2 + points[j] * limit**2, i))
        if options:
            cost, i = min(options)
            memo[j] = (cost, memo[i][1] + [i])
    return [c for c in memo[n][1] if c]


def test_cuts_are_optimal():
    r = random.Random(3)
    for _ in range(60):
        n, limit, overlap = r.randrange(21, 60), 20, 4
        at = sorted({*r.sample(range(1, n), min(n - 1, r.randrange(8, 13))), *range(8, n, 10)})
        penalty = [r.choice([0, 3, 10]) for _ in at]

        def cost(chosen):
            edges = [0, *[at[k] for k in chosen], n]
            if chosen and edges[1] < overlap:
                return None
            total = 0
            for a, b in zip(edges, edges[1:]):
                size = b - a + (overlap if a else 0)
                if size > limit:
                    return None
                total += 10 * limit**2 + 10 * (limit - size) ** 2
            return total + sum(penalty[k] for k in chosen) * limit**2

        every = [c for m in range(1, 7) for chosen in combinations(range(len(at)), m) if (c := cost(chosen)) is not None]
        got = cuts(n, np.array(at), np.array(penalty), limit, overlap)
        if every and len(got) <= 6:
            assert cost([at.index(c) for c in got]) == min(every)


def test_ties_are_broken_alike_at_every_size():
    r = random.Random(5)
    for k in range(120):
        n, limit, overlap = r.choice([60, 700, 4000]), 50, 6
        at = sorted({*range(6, n, r.choice([3, 7, 10])), *r.sample(range(1, n), 9)})
        penalty = [r.choice([0, 0, 3, 10]) for _ in at]
        assert cuts(n, np.array(at), np.array(penalty), limit, overlap) == best_by_hand(n, at, penalty, limit, overlap), k
    code = "".join(function(r, f"f{i}", r.randrange(3, 25)) for i in range(40))
    starts = np.array([m.start() for m in TOKEN.finditer(code)])
    at, penalty = boundaries(code, starts)
    assert cuts(len(starts), at, penalty) == best_by_hand(len(starts), at.tolist(), penalty.tolist(), LIMIT, OVERLAP)


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "x\n" * 600), (4, "x\n" * 600)]
    df = spark.createDataFrame([(i, c, 9) for i, c in rows], "id int, code string, piece_no int")
    got = split_oversized(df, "id", "code").collect()
    assert sorted((r["item_id"], r["piece_no"], r["n_pieces"]) for r in got) == [(2, 1, 1), (3, 1, 1), (4, 1, 2), (4, 1, 2), (4, 2, 2), (4, 2, 2)]
    code = "x\n" * 600
    assert all(r["piece"] == code[r["start_char"] : r["end_char"]] for r in got if r["item_id"] == 4)
    assert split_oversized(df.limit(0), "id", "code").count() == 0
