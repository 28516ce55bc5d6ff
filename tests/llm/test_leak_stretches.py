"""Stretches of benchmark items wherever they begin."""

import random

from tidemark.llm import decontaminate


def holds(item, text, size, edits):
    """Every begin and end of a stretch, by the plain table of edit distances."""
    for i in range(len(item)):
        row = [0] * (len(text) + 1)
        for j in range(i, len(item)):
            new = [j - i + 1]
            for t, c in enumerate(text, 1):
                new.append(min(row[t] + 1, new[-1] + 1, row[t - 1] + (item[j] != c)))
            row = new
            if j - i + 1 >= size and min(row) <= edits * (j - i + 1) + 1e-9:
                return True
    return False


def test_local_alignment(monkeypatch):
    monkeypatch.setattr(decontaminate, "ROWS", 7)
    rng, found = random.Random(1), 0
    for _ in range(150):
        item = "".join(rng.choice("abcd") for _ in range(rng.randrange(5, 24)))
        text = [*item[rng.randrange(3) :]]
        for _ in range(rng.randrange(6)):
            p = rng.randrange(len(text))
            text[p : p + rng.randrange(2)] = rng.choice(["", "a", "bc"])
            text = text or ["a"]
        text, size = "da" + "".join(text) + "ab", len(item) // 2 + 1
        want = holds(item, text, size, 0.1)
        assert decontaminate.stretch_found(item, text, -len(item), len(item) + len(text) + 1, size, 0.1) == want
        found += want
    assert 30 < found < 150


def test_half_an_item_off_the_grid():
    rng = random.Random(4)
    for n, at in ((400, 25), (233, 15)):
        item = "".join(rng.choice("abcdefgh") for _ in range(n))
        half, short = item[at : at + n // 2 + 1], item[at : at + 2 * n // 5]
        matcher = decontaminate.Matcher([(1, item)], 0.06, 0.5, 50)
        assert matcher.search(["z" * 77 + half + "y" * 60, "z" * 77 + short + "y" * 60, half]) == [[1], [], [1]]


def test_template_lines_and_small_limits(monkeypatch):
    """However few pairs are counted at once, the same items are found."""
    rng = random.Random(6)
    template = "this line of the template is in every item of the benchmark "
    items = [(i, template + " ".join(str(rng.randrange(10**6)) for _ in range(20))) for i in range(60)]
    repeated = (60, "ab" * 100)
    texts = [template * 40, items[7][1] + " and " + items[8][1], "ab" * 300, "no words of these", template + "ab" * 20]
    want = decontaminate.Matcher([*items, repeated], 0.06, 0.5, 50).search(texts)
    assert want[1] == [7, 8] and want[2] == [60] and want[3] == []
    for limit in (10, 500, 20_000):
        monkeypatch.setattr(decontaminate, "LIMIT", limit)
        assert decontaminate.Matcher([*items, repeated], 0.06, 0.5, 50).search(texts) == want
