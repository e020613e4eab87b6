"""Total-fit breaking against all ways to break, and page filling against its rules."""

import itertools
import random
from fractions import Fraction

from quirefold.operators import flow_layout as fl


def plain_best(words, measure):
    """Best ways to all breaks, every start tried, in fractions; ties go to the longer line."""
    size, half = [Fraction(len(w), 2) for w in words], Fraction(1, 2)
    for tolerance in (200, 10_000, None):
        best = {0: (0, None, 1)}
        for end in range(1, len(words) + 1):
            for start in range(end):
                if start not in best:
                    continue
                gaps = end - start - 1
                free = measure - sum(size[start:end]) - half * gaps
                if end == len(words):
                    ratio = Fraction(0 if free >= 0 else -9)
                elif free >= 0:
                    ratio = free / ((gaps + 1) * half * half)
                else:
                    ratio = free / (gaps * half / 3) if gaps else Fraction(-9)
                bad = 100 * abs(ratio) ** 3
                if ratio < -1 or (tolerance is not None and bad > tolerance):
                    continue
                kind = 0 if ratio < -half else 1 if ratio <= half else 2 if ratio <= 1 else 3
                total = best[start][0] + (10 + bad) ** 2 + (10_000 if abs(kind - best[start][2]) > 1 else 0)
                if end not in best or total < best[end][0]:
                    best[end] = (total, start, kind)
        if len(words) in best:
            ends, at = [], len(words)
            while at:
                ends.append(at - 1)
                at = best[at][1]
            return ends[::-1]
    return None


def test_total_fit():
    rng = random.Random(3)
    for _ in range(300):
        words = ["x" * rng.randint(1, 9) for _ in range(rng.randint(1, 25))]
        measure = rng.choice([4, 7, 8, 12])
        assert fl.total_fit(words, float(measure)) == plain_best(words, measure)
    assert fl.total_fit([], 8) is None and fl.total_fit(["x" * 40], 8) is None and fl.total_fit(["a"], 8) == [0]


def test_first_fit():
    assert fl.first_fit("aa bb cc".split(), 2.5) == ["aa bb", "cc"] and fl.first_fit(["w" * 50, "a"], 2) == ["w" * 50, "a"] and fl.first_fit([], 5) == []


def test_fill_keeps_lines_and_rules():
    rng = random.Random(5)
    for _ in range(40):
        blocks = [(i, rng.random() < 0.3, ["x"] * rng.choice([0, 1, 1, 2, 3, 7, 40, 90])) for i in range(30)]
        rules = fl.Rules(frames=((50, 400, 200), (50, 400, 200)))
        placed = list(fl.fill(blocks, rules))
        for seq, heading, lines in blocks:
            mine = [p for p in placed if p.seq == seq]
            assert sum(p.n_lines for p in mine) == len(lines)
            assert [p.first_line for p in mine] == list(itertools.accumulate([p.n_lines for p in mine], initial=0))[:-1]
            for p in mine:
                assert p.y + p.n_lines * 1.2 * (14 if heading else 10) <= 400.02
            if len(mine) > 1:
                assert mine[0].n_lines >= 2 and mine[-1].n_lines >= 2
        spots = [(p.page, p.frame, p.y) for p in placed]
        assert spots == sorted(spots)
        for p, q in itertools.pairwise(placed):
            if blocks[p.seq][1] and q.seq != p.seq and len(blocks[p.seq][2]) < 10 and blocks[p.seq + 1][2]:
                assert (p.page, p.frame) == (q.page, q.frame) or len(blocks[q.seq][2]) > 1


def test_layout_table(spark):
    rows = [(1, 0, True, "Head"), (1, 1, False, "word " * 3000), (1, 2, None, None), (2, 0, False, ""), (None, 0, False, "x"), (3, 5, False, "tail"), (3, 5, False, "tail")]
    blocks = spark.createDataFrame(rows, "d int, n int, h boolean, t string")
    got = fl.layout(blocks, "d", "n", "h", "t").orderBy("d", "seq", "page").collect()
    assert {r["d"] for r in got} == {1, 3} and sum(len(r["lines"]) for r in got if r["d"] == 1 and r["seq"] == 1) == 150
    assert " ".join(w for r in got if r["d"] == 1 and r["seq"] == 1 for w in r["lines"]) == ("word " * 3000).strip()
    assert fl.layout(blocks.limit(0), "d", "n", "h", "t").count() == 0
