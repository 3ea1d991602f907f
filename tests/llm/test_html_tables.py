"""Spans, styles and lists of the page renderer, against a plain grid and on hostile pages."""

import random
import time

import pytest

from galena.llm.html_text import Table, _letters, ordinal, render


def plain_places(rows):
    """Places by marking every column of every span."""
    taken, out = {}, []
    for r, row in enumerate(rows):
        at, places, below = 0, [], []
        for _, span, down in row:
            while taken.get(at, 0) > r:
                at += 1
            places.append(at)
            if down != 1:
                below.append((at, span, r + down if down else len(rows)))
            at += span
        for a, span, until in below:
            for c in range(a, a + span):
                if taken.get(c, 0) <= r:
                    taken[c] = until
        out.append(places)
    return out


def test_spans_against_a_grid():
    rng = random.Random(3)
    for _ in range(400):
        table = Table()
        table.rows = [[([f"{r}.{k}"], rng.choice([1, 1, 1, 2, 3, 7]), rng.choice([1, 1, 1, 0, 2, 3, 5])) for k in range(rng.randrange(5))] for r in range(rng.randrange(1, 9))]
        assert [[at for at, _, _ in row] for row in table.placed()] == plain_places(table.rows)


def plain_lines(rows, places):
    width = {}
    for row, at in zip(rows, places, strict=True):
        for (cell, span, _), a in zip(row, at, strict=True):
            if span == 1:
                width[a] = max([width.get(a, 0), *map(len, cell)])
    out = []
    for row, at in zip(rows, places, strict=True):
        for k in range(max((len(c) for c, _, _ in row), default=0)):
            line, have, column = "", 0, 0
            for (cell, span, _), a in zip(row, at, strict=True):
                for c in range(column, a):
                    have += width.get(c, 0) + 2
                own = cell[k] if k < len(cell) else ""
                if own:
                    line = line.ljust(have) + own
                have = max(have + sum(width.get(a + i, 0) + 2 for i in range(span)), len(line) + 2 if own else 0)
                column = a + span
            out.append(line.rstrip())
    return out


def test_lines_against_a_grid():
    rng = random.Random(4)
    for _ in range(300):
        table = Table()
        table.rows = [[([rng.choice(["", "a", "bcd", "efghij"]) for _ in range(rng.randrange(4))], rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 0, 2])) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 6))]
        assert table.lines(None) == plain_lines(table.rows, plain_places(table.rows))


@pytest.mark.parametrize("cell", ["<td rowspan=0 colspan=1000>a", "<td rowspan=%d colspan=1000>a", "<td rowspan=%d>a<td rowspan=2>b", "<td colspan=1000 rowspan=2>a<td>b<td rowspan=0>c"])
def test_spans_take_time_in_proportion(cell):
    def seconds(n):
        html = "<table>" + "".join("<tr>" + (cell % (n - k + 1) if "%" in cell else cell) for k in range(n))
        began = time.process_time()
        text = render(html)
        return time.process_time() - began, len(text)

    took, size = seconds(2000)
    assert took < 2 and size < 2000 * 3 * 1010
    assert render("<table>" + "<tr>" + "<td>x" * 20_000 + "<td>" + "y<br>" * 20_000).count("y") == 20_000


def test_blanks():
    html = "<table>" + "<tr><td rowspan=0 colspan=1000>a" * 3
    assert render(html, most_blank=None).split("\n") == ["a", " " * 2000 + "a", " " * 4000 + "a"]
    assert render(html).split("\n") == ["a", " " * 1000 + "a", " " * 1000 + "a"]
    deep = "<ul><li>" * 40 + "x"
    assert render(deep).count(" ") < render(deep, most_indent=None).count(" ")


@pytest.mark.parametrize("html, want", [
    ("<style>div.x{display:none}</style><div class=x>a</div><p class=x>b</p>", "b"), ("<style>#i.x.y{display:none}</style><p id=i class='y x'>a</p><p id=i class=x>b</p>", "b"),
    ("<style>p{display:none} p.x{display:block} .x{display:none}</style><p class=x>a", "a"), ("<style>.x{display:none} *.x{display:block}</style><p class=x>a", "a"), ("<style>p.x{display:none!important} #i{display:block}</style><p id=i class=x>a", ""),
    ("<style>p .x{display:none}</style><p><b class=x>a</b>", "a"), ("<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b<tr><td>c</tbody><thead><tr><td>h</table>", "h\nb\nc\nf"), ("<table><caption>t</caption><tfoot><tr><td>f<tbody><tr><td>b</table>", "t\nb\nf"),
    ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"), ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"), ("<ol type=I reversed start=4><li>x<li value=9>y<li>z", "IV. x\nIX. y\nVIII. z"),
])
def test_styles_feet_and_numbers(html, want):
    assert render(html) == want


def test_many_rules_take_time_in_proportion():
    sheet = "".join(f".a{k}.b{k % 50}{{display:none}}" for k in range(5000))
    began = time.process_time()
    assert render(f"<style>{sheet}</style>" + "".join(f"<p class='b{k % 50} a{k + 1}'>x" for k in range(5000))).count("x") == 5000
    assert time.process_time() - began < 5


def test_ordinals():
    assert [ordinal(n, "a") for n in (1, 26, 27, 702, 703)] == ["a", "z", "aa", "zz", "aaa"] and ordinal(0, "a") == "0" and _letters(28) == "ab"
    assert [ordinal(n, "i") for n in (1, 4, 9, 1994, 4000)] == ["i", "iv", "ix", "mcmxciv", "4000"] and ordinal(3, "1") == ordinal(3, None) == "3"
