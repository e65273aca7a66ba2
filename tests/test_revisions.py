"""Edits between revisions: fewest, in order, and right."""

import random

from jobloom.operators import lifecycle, revisions


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def replay(before, made):
    gone, now = {e[1] for e in made if e[0] == "-"}, {e[2]: e[3] for e in made if e[0] == "+"}
    kept = iter([x for i, x in enumerate(before) if i not in gone])
    return [now[j] if j in now else next(kept) for j in range(len(before) - len(gone) + len(now))]


def test_edits_are_fewest_and_right():
    rng = random.Random(3)
    for k in range(600):
        letters = "abcdefgh"[: 1 + k % 8]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(14))] for _ in range(2))
        made = revisions.edits(a, b)
        assert replay(a, made) == b
        assert len(made) == len(a) + len(b) - 2 * lcs(a, b)


def test_moved_and_doubled_sentences():
    assert revisions.edits(["a", "b", "c"], ["b", "c", "a"]) == [("-", 0, None, "a"), ("+", None, 2, "a")]
    assert [e[0] for e in revisions.edits(["a", "b"], ["a", "a", "b"])] == ["+"]
    assert revisions.edits([], []) == [] and revisions.edits(["a"], ["a"]) == []


def test_long_lists():
    """Memory is linear, and what stands on one side only costs nothing."""
    a = [f"s{k}" for k in range(60_000)]
    b = [x for k, x in enumerate(a) if k % 1000] + ["new"]
    assert len(revisions.edits(a, b)) == 61
    assert len(revisions.edits(a, [f"t{k}" for k in range(60_000)])) == 120_000


def test_pages(spark):
    rows = [
        (1, 1, "One. Two. Three."), (1, 2, "One. Two. Three."), (1, 3, "Two! Two. Three. One."), (2, 5, "Alone."), (3, 1, None), (3, 2, "Now.\nHere? Yes"),
        (4, 1, "Same. Text."), (4, 2, "Same. Text."), (5, 1, "Gone. All."), (5, 2, None), (6, 1, "x. " * 500), (6, 2, "y" * 5000 + ". " + "x. " * 400),
    ]
    compared = revisions.with_edits(revisions.last_two(spark.createDataFrame(rows, "page_id long, scan long, text string").repartition(4)))
    got = {r.page_id: (r.removed, r.added, r.same) for r in revisions.counted(compared).collect()}
    assert got == {1: (1, 2, False), 3: (1, 3, False), 4: (0, 0, True), 5: (2, 1, False), 6: (100, 1, False)}
    again = compared.select("now", revisions.applied(compared.before, compared.edits).alias("again")).collect()
    assert all(r.now == r.again for r in again)
    found = revisions.hunks(compared)
    assert [(r.op, r.text) for r in found.where("page_id = 1").orderBy("place").collect()] == [("-", "One."), ("+", "Two!"), ("+", "One.")]
    seen = revisions.shown(found).where("page_id = 6").collect()
    assert len(seen) == 60 and max(len(r.text) for r in seen) == 600
    assert revisions.counted(compared.where("false")).collect() == []


def test_only_changes_are_stored(spark):
    schema = "page_id long, scan long, text string"
    old = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "A"), (3, 1, None)], schema)
    found = spark.createDataFrame([(1, 3, "A"), (2, 2, "A"), (3, 2, ""), (4, 1, None)], schema)
    assert sorted((r.page_id, r.text) for r in lifecycle.to_store(found, old).collect()) == [(1, "A"), (4, None)]
