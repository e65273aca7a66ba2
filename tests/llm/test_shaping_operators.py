"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from jobloom.llm import fill_in_middle, mixing, vector_codes

UNIT = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
LONG = " ".join(f"w{k % 977}é😀" for k in range(80_000))
TEXTS = [
    "the cat sat on the mat", "", None, " \t\n ", "one", " lead and trail \n", "a b c d \x0b e\x0c\rf", "with <P> inside", "a <S>", "<M>", "less < than <P almost",
    "😀 emoji 😀😀 über\r\nlines\n\nend", LONG, "\x00 nul \x1f x", "<", "<P", "a<" * 50,
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- operator 11


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    made = [" ".join(rng.choice(["a", "bb<", "\n", "c\t", ">d", "é"]) for _ in range(rng.randrange(30))) for _ in range(150)]
    return list(enumerate(TEXTS + made)) + [(None, "text without an id and more words"), (20, "same id"), (20, "same id")]


def rearranged(doc_id, text):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], "doc_id long, text string, n int, form string, output string").repartition(3)
    got = fill_in_middle.digest(fill_in_middle.rearranged(df)).collect()
    want = []
    for i, t in texts:
        n, form, p, m, out = rearranged(i, t)
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_outputs(spark, texts):
    """The operator itself keeps all columns and gives whole texts; all rearranged, every text comes back."""
    df = spark.createDataFrame([(i, t, "kept") for i, t in texts], "doc_id long, text string, note string")
    got = fill_in_middle.rearranged(df, rate=100, suffix_first=50)
    assert got.columns == ["doc_id", "text", "note", *fill_in_middle.COLUMNS]
    back = got.select("text", fill_in_middle.restored(got.output, got.form).alias("back")).collect()
    assert len(back) == len(texts) and all(r.back == (r.text or "") for r in back)
    assert fill_in_middle.digest(fill_in_middle.rearranged(df.where("false"))).collect() == []


def test_unit_ends_are_sparse():
    """Only spaces and sentinels are events: a text without any has none, however long."""
    assert list(fill_in_middle.automaton().iter("x" * 10_000)) == []
    ends, marked = fill_in_middle.unit_ends("ab  c<M>d \t")
    assert ends.tolist() == [2, 9, 11] and marked


# --- operator 12


def mixed(rows):
    """By the contract: targets by sharing the excess again and again."""
    size = {k: len(WORD.findall(t or "")) for k, (_, t, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(size[k] for k, r in enumerate(rows) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    free, left, target = set(sources), 1.5 * sum(total.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level >= 2 * total[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left, free = left - sum(2 * total[s] for s in full), free - full
    return size, total, target


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(12)
    rows = [(k, " ".join("w" for _ in range(rng.randrange(120))), rng.choice(["hot", "hot", "hot", "b", "c", None, "ü", "Z"])) for k in range(600)]
    return rows + [(None, "no id one", "b"), (None, "no id two words", "b"), (7, "twice the same", "c"), (7, "twice the same", "c"), (601, None, "b"), (602, "", "empty"), (603, "one", "tiny"), (604, "x " * 30_000, "hot")]


def test_mixing(spark, sourced):
    df = spark.createDataFrame([(*r, 5, "s", 1) for r in sourced], "doc_id long, text string, source string, size int, s string, h int").repartition(4)
    got = mixing.taken(df).collect()
    size, total, target = mixed(sourced)
    want = sorted(((r[0], size[k], total[r[2]]) for k, r in enumerate(sourced)), key=repr)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=repr) == want
    by_size = {v: k for k, v in total.items()}
    assert len(by_size) == len(total)
    sums = Counter()
    for r in got:
        source = by_size[r.source_size]
        assert math.isclose(r.target, target[source], rel_tol=1e-12, abs_tol=1e-9) and 0 <= r.taken <= 2 * r.size
        sums[source] += r.taken
    assert all(abs(sums[s] - target[s]) <= 1 for s in total)
    again = mixing.taken(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_mix_is_a_schedule(spark, sourced):
    """Spans lie in their documents, no word is taken more than twice, slots are whole blocks, and every beginning of the mix is near the weights."""
    df = spark.createDataFrame(sourced, "doc_id long, text string, source string").repartition(4)
    sizes = mixing.sized(df)
    shares = mixing.targets(sizes)
    slots, words = mixing.schedule(shares, 64)
    spans = mixing.mix(mixing.streams(sizes), shares, 64).collect()
    target = {r.s: r.target for r in shares.collect()}
    total = sum(target.values())
    seen, per_slot = Counter(), Counter()
    for r in spans:
        assert 0 <= r.first_word and r.first_word + r.n_words <= r.size and r.n_words > 0
        per_slot[r.slot] += r.n_words
        for w in range(r.first_word, r.first_word + r.n_words):
            seen[r.s, r.at, w] += 1
    assert max(seen.values()) <= 2 and max(per_slot.values()) <= words
    order = sorted((r.slot, r.s) for r in slots.collect())
    assert len({slot for slot, _ in order}) == len(order)
    n, so_far = 1 << (len(order).bit_length() - 1), Counter()
    for k, (_, s) in enumerate(order[:n], 1):
        so_far[s] += 1
        assert all(abs(so_far[x] - k * target[x] / total) < 2 + math.log2(n) for x in target)
    ranks = defaultdict(list)
    for r in sorted(slots.collect(), key=lambda r: r.slot):
        ranks[r.s].append(r.rank)
    assert all(x == list(range(len(x))) for x in ranks.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one two three", "a")]])
def test_mixing_small(spark, rows):
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == [(i, 4 if t and t.strip() else 0) for i, t, _ in rows]


def test_mixing_plan_is_native(spark, sourced):
    df = mixing.taken(spark.createDataFrame(sourced, "doc_id long, text string, source string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# --- operator 13


def coded(rows, parts=16, entries=64, rounds=2):
    """Every vector's parts against every entry."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[near(v, p)[1]].append(cut(v, p))
            for k, vs in got.items():
                books[p][k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out, labels = [], Counter()
    for i, v, lab in kept:
        best = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), lab))
        labels[lab] += out[-1][2]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(i, c, e, labels[lab], digest) for i, c, e, lab in out]


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(13)
    vec = lambda: [rng.randrange(-40, 40) / 128 for _ in range(32)]
    common = vec()
    rows = [(k, vec() if k % 3 else common, rng.choice([0, 1, 2, None])) for k in range(300)]
    bad = [(301, None, 1), (302, [None, *common[1:]], 1), (303, [math.nan, *common[1:]], 1), (304, [math.inf, *common[1:]], 2), (305, [], None)]
    return rows + bad + [(5, vec(), 1), (5, vec(), 1), (None, vec(), None), (7, rows[7][1], rows[7][2])]


def test_vector_codes(spark, vectors):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in vectors], "vec_id long, embedding array<float>, label int, code string, part int, row int").repartition(5)
    got = vector_codes.compressed(df).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(coded(vectors), key=repr)


def test_vector_codes_decode(spark, vectors):
    rows = vector_codes.integers(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"))
    found = vector_codes.distinct_parts(rows)
    assert found.groupBy("part").sum("c").where(f"`sum(c)` != {rows.count()}").count() == 0
    books = vector_codes.fit(found, vector_codes.first_codebooks(rows))
    both = vector_codes.decoded(vector_codes.encoded(rows, found, books), books).join(rows.select("row", "ints"), "row").collect()
    assert both and all(r.error == sum((round(256 * x) - y) ** 2 for x, y in zip(r.vector, r.ints, strict=True)) for r in both)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [0.5] * 16, None), (2, [1.0] * 15, 1), (3, [1e30] * 16, 1)], [(1, [0.5] * 7, 1)]])
def test_vector_codes_small(spark, rows):
    """No vector, one, some of other lengths, one of huge components."""
    got = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.vec_id, r.error) for r in sorted(got)] == [(i, 0) for i, v, _ in rows if v and len(v) == 16]
