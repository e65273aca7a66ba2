"""Operators against brute force on small tables, with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from jobloom.llm import decontamination, licences, lm_scoring, quality, sharding, simhash

SPACE_WORD = re.compile("[^\\x20\\x09-\\x0D]+")
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(6000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ROWS = [
    (1, "the cat sat on the mat and the dog sat on the log near the mat", "a"),
    (2, "The cat sat on the mat and the dog sat on the log near the MAT", "a"),
    (3, "", "a"),
    (4, None, None),
    (5, None, "a"),
    (6, LONG, "b"),
    (6, LONG, "b"),
    (None, "some text without an id", None),
    (7, f"before {PASSAGE} after", "c"),
    (8, f"x {PASSAGE.upper()} y {PASSAGE}", "c"),
    (9, "same line\nsame line\nsame line\nother # $ % line", "c"),
    (10, "a b c d e a b c d e a b c d e f", "c"),
    (11, "é ü ñ ß — ’ word é ü ñ ß — ’ word", "c"),
    (12, "All rights reserved. CC-BY cc by cc by, GNU General Public License", "d"),
    (13, "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception\nrest", "d"),
    (14, " \t\n ", "d"),
    (15, "three word text", "d"),
    (16, "three word text", "d"),
    (100, "the quick brown fox jumps over the lazy dog again and again", "e"),
    (101, "the quick brown fox jumps over the lazy dog again and", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(*r, 1, "x", None, 0.5) for r in ROWS], "doc_id long, text string, source string, row int, fp string, host string, n double"
    ).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


# --- operator 1


def test_lm_scores(spark, docs):
    many = [(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(k % 40))) for k in range(400)] + [(r[0], r[1]) for r in ROWS]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    count, total = Counter(), 0
    for i, t in many:
        if fold(i, 5) != 1:
            count.update([*SPACE_WORD.findall(lower(t)), "</s>"])
    total = sum(count.values())
    floor = math.log10(total + 0.5 * (len(count) + 1))
    want = []
    for i, t in many:
        ts = [*SPACE_WORD.findall(lower(t)), "</s>"]
        want.append((i, fold(i, 5) == 1, len(ts), sum(count[w] > 0 for w in ts), total, round(sum(math.log10(count[w] + 0.5) - floor for w in ts), 6)))
    got = lm_scoring.score(df).collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=repr) == sorted(want, key=repr)
    held = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_model_sums_to_one():
    """The weights of every bucket are a distribution, and unseen contexts give the bigram none."""
    import numpy as np

    weights = lm_scoring.learn(np.array([[0, 300.0, 0, 0.01], [3, 200.0, 0.5, 0.01], [3, 50.0, 0.0, 0.0], [5, 10.0, 0.2, 0.1]]), 100)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0 and weights[3, 0] > 0.5


def test_lm_empty(empty):
    assert lm_scoring.score(empty).collect() == []


@pytest.mark.parametrize("frequent", [1, 8, 20_000])
def test_lm_hot_word(spark, frequent):
    """Frequent words (none, some or all) are dealt out over the shards, and their counts still meet."""
    many = [(k, "hot " * (k % 50) + f"w{k % 7}") for k in range(300)]
    got = lm_scoring.score(spark.createDataFrame(many, "doc_id long, text string").repartition(4), frequent=frequent).collect()
    count = Counter()
    for i, t in many:
        if fold(i, 5) != 1:
            count.update([*t.split(), "</s>"])
    floor = math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    want = {i: sum(math.log10(count[w] + 0.5) - floor for w in [*t.split(), "</s>"]) for i, t in many}
    assert len(got) == 300 and all(abs(want[r.doc_id] - r.base_score) < 1e-6 for r in got)


@pytest.mark.parametrize("frequent", [1, 500])
def test_lm_contexts_are_words(spark, frequent):
    """Scores with the counts of the previous words themselves, of so many words that classes of them would collide."""
    import random

    import numpy as np

    rng = random.Random(21)
    many = [(k, " ".join(f"w{min(rng.randrange(20_000), rng.randrange(20_000))}" for _ in range(rng.randint(0, 90)))) for k in range(800)]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(many, "doc_id long, text string").repartition(4), frequent=frequent).collect()}
    texts = {i: ["</s>", *t.split(), "</s>"] for i, t in many}

    def counts(folds):
        chosen = [t for i, t in texts.items() if fold(i, 5) in folds]
        return Counter(w for t in chosen for w in t[1:]), Counter(w for t in chosen for w in t[:-1]), Counter(p for t in chosen for p in zip(t, t[1:], strict=False))

    words, contexts, pairs = counts({0, 3, 4})
    sums = defaultdict(lambda: np.zeros(3))
    for i, t in texts.items():
        for a, b in zip(t, t[1:], strict=False) if fold(i, 5) == 2 else ():
            two, one = pairs[a, b] / max(contexts[a], 1), words[b] / sum(words.values())
            key = tuple(int(f(np.array([v]))[0]) for f, v in ((lm_scoring.bucket, contexts[a]), (lm_scoring.level, two), (lm_scoring.level, one)))
            sums[key] += [1, two, one]
    words, contexts, pairs = counts({0, 2, 3, 4})
    weights = lm_scoring.learn(np.array([[k[0], n, two / n, one / n] for k, (n, two, one) in sums.items()]), len(words))
    for i, t in texts.items():
        p = [w[0] * pairs[a, b] / max(contexts[a], 1) + w[1] * words[b] / sum(words.values()) + w[2] / (len(words) + 1)
             for a, b in zip(t, t[1:], strict=False) for w in [weights[int(lm_scoring.bucket(np.array([contexts[a]]))[0])]]]
        assert abs(got[i] - sum(map(math.log10, p))) < 1e-6, i


# --- operator 3


def brute_print(text):
    words = SPACE_WORD.findall(lower(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable over links of four bits or fewer; prints: (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = d if least[root(i)] is None else min(least[root(i)], d)
    return [(d, fp, least[root(i)]) for i, (d, fp) in enumerate(prints)]


def test_near_duplicates(docs):
    want = brute_components([(r[0], brute_print(r[1])) for r in ROWS])
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("part", [4096, 16])
def test_links_lose_nothing(spark, monkeypatch, part):
    """Clusters and chains of fingerprints, with large cells cut into parts."""
    import random

    rng = random.Random(part)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(700):
        x = rng.choice(prints[:20] + prints[-5:])
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "SMALL", 8)
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    from jobloom.llm.common import components

    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = defaultdict(set)
    for d, _, c in brute_components(list(enumerate(prints))):
        want[c].add(simhash.signed(prints[d]))
    got = defaultdict(set)
    for x in map(simhash.signed, prints):
        got[root.get(x, x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []


# --- operator 4


def plain_fill(names, slots):
    """Each shard's whole order written down; by turns each takes the first slot of its order that is free."""
    orders = []
    for name in names:
        digest = hashlib.sha256(name.encode()).hexdigest()
        offset, step = int(digest[:16], 16) % slots, int(digest[16:32], 16) % (slots - 1) + 1
        orders.append(iter([(offset + k * step) % slots for k in range(slots)]))
        assert len({(offset + k * step) % slots for k in range(slots)}) == slots
    owner, turn = {}, 0
    while len(owner) < slots:
        slot = next(s for s in orders[turn % len(names)] if s not in owner)
        owner[slot], turn = turn % len(names), turn + 1
    return [owner[s] for s in range(slots)]


def test_sharding(docs, empty):
    got = sharding.place(docs)
    assert len(got.collect()) == len(ROWS) and set(docs.columns) < set(got.columns)
    assert sharding.place(empty).collect() == []
    owner = sharding.fill([f"s{k}" for k in range(7)], 1021)
    assert owner == plain_fill([f"s{k}" for k in range(7)], 1021)
    assert sharding.fill([f"shard-{k}" for k in range(sharding.SHARDS)]) == plain_fill([f"shard-{k}" for k in range(sharding.SHARDS)], sharding.SLOTS)
    sizes = Counter(owner)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill([f"s{k}" for k in range(6)], 1021)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 0.1 * 1021
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad, 1021)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 1000)


# --- operator 6


def brute_phrases(text):
    words = TERM.findall(lower(text))
    hits = [(k, label) for p, label in licences.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_licences(docs, empty):
    got = licences.digest(licences.scan(docs)).collect()
    want = sorted([(r[0], *brute_phrases(r[1])) for r in ROWS], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=repr) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert {r.labels for r in got if r.doc_id == 13} == {"apache,mit"}
    assert licences.scan(empty).collect() == []


def test_licence_hits_by_brute_force():
    """All hits and scores of random texts of phrases, parts of phrases and tags, in words and by hand."""
    import random

    rng = random.Random(15)
    parts = [*licences.BASE, *licences.NOTICES, "cc", "by", "general public", "license", "mit", "x", "SPDX-License-Identifier: MIT", "spdx-license-identifier: gpl-3.0-only OR isc\n", "(c)", "-", "\n"]
    tags = {"SPDX-License-Identifier: MIT": [("mit", 0.1)], "spdx-license-identifier: gpl-3.0-only OR isc\n": [("isc", 0.1)]}
    for _ in range(300):
        chosen = [rng.choice(parts) for _ in range(rng.randint(0, 12))]
        chosen = [c + "\n" if c in tags else c for c in chosen]
        text = " ".join(chosen)
        words = TERM.findall(lower(text))
        want = {(kind, label, k, len(p.split())) for kind, named in (("base", licences.BASE), ("notice", licences.NOTICES)) for p, label in named.items()
                for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}
        want_tags, at = [], ""
        for c in chosen:
            if (c.rstrip("\n") in tags) or c in tags or c[:-1] in tags:
                found = tags.get(c) or tags.get(c[:-1]) or tags.get(c.rstrip("\n"))
                want_tags += [("tag", label, len(TERM.findall(lower(at))) + 3, 1) for label, _ in found]
            at += c + " "
        n, hits, score = licences.scan_text(text.encode())
        assert n == len(words) and {h for h in hits if h[0] != "tag"} == want and [h for h in hits if h[0] == "tag"] == want_tags, text
        assert score == max([licences.RESTRICTS[x] for _, x, _, _ in want] + [0.1 for _ in want_tags], default=0.0)


@pytest.mark.parametrize(
    "text,want",
    [
        ("mit", ["mit"]),
        ("mit or gpl-3.0", ["mit"]),
        ("gpl-2.0+ and bsd-3-clause", ["gpl", "bsd"]),
        ("gpl-2.0 with classpath-exception-2.0", ["gpl"]),
        ("mit or apache-2.0 and gpl-3.0", ["mit"]),
        ("( mit or apache-2.0 ) and gpl-3.0", ["mit", "gpl"]),
        ("mit or", None),
        ("( mit", None),
        (") mit", None),
        ("", None),
        ("mit and apache-2.0 the end", ["mit", "apache"]),
    ],
)
def test_licence_expressions(text, want):
    found = licences.expression(text.split())
    assert want == (found if found is None else [x for x, _ in found])


# --- operator 7


def brute_contamination(docs, items):
    windows = []
    for item, t in items:
        w = TERM.findall(lower(t))
        windows += [(item, w[k : k + 13]) for k in range(max(1, len(w) - 12))] if w else []
    out = []
    for d, t in docs:
        words, hit, found = TERM.findall(lower(t)), set(), set()
        for item, w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def test_decontamination(spark, docs, empty, monkeypatch):
    items = [(1, PASSAGE), (2, "three word text"), (3, None), (4, ""), (10, PASSAGE + " sixteen"), (11, "the cat sat on the mat and the dog sat on the log near the mat"),
             (12, "word"), (13, "e a b c d e a b c d e a b c"), (13, PASSAGE), (14, "nowhere at all to be found in any of these documents or others here")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    want = sorted(brute_contamination([(r[0], r[1]) for r in ROWS], items), key=repr)
    for size in (1 << 24, 200):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = decontamination.digest(decontamination.search(docs, bench)).drop("d", "k")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "POSTINGS", 3)
    got = decontamination.digest(decontamination.search(docs, bench)).drop("d", "k")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert decontamination.search(empty, bench).collect() == []
    assert {r.n_hit for r in decontamination.digest(decontamination.search(docs, bench.where("false"))).collect()} == {0}


def test_near_items(spark):
    """Near items against brute force: any 13 words with enough of a window's terms are found, in whichever window and whatever was substituted."""
    import random

    rng = random.Random(8)
    items = [(k, [f"q{rng.randrange(60)}" for _ in range(rng.randint(5, 40))] + ["absent"] * (k % 2)) for k in range(30)]
    docs = []
    for k in range(150):
        words = list(rng.choice(items)[1])
        a = rng.randrange(len(words))
        words = [w if rng.random() < 0.85 and w != "absent" else f"x{rng.randrange(9)}" for w in words[a : a + rng.randint(5, 20)]]
        docs.append((k, [f"y{rng.randrange(9)}" for _ in range(rng.randint(0, 15))] + words + [f"z{rng.randrange(9)}" for _ in range(rng.randint(0, 15))]))
    found = decontamination.search(
        spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    )
    got = {r.doc_id: set(r.near_items) for r in found.collect()}
    windows = [(str(i), set(w[k : k + 13])) for i, w in items for k in range(max(1, len(w) - 12))]
    for k, words in docs:
        near = lambda spans: {i for i, w in windows if any(100 * len(w & x) >= 75 * len(w) for x in spans)}  # noqa: E731, B023
        assert near([set(words[j : j + 13]) for j in range(len(words))]) <= got[k] <= near([set(words[max(0, j - 12) : j + 13]) for j in range(len(words))]), k
    assert sum(map(bool, got.values())) > 20


def test_postings_are_places_that_can_match(spark, monkeypatch):
    """A posting is stored only where an anchor's neighbours stand around it: a benchmark's words alone, however frequent, leave none."""
    kept, real = {}, decontamination.cut
    monkeypatch.setattr(decontamination, "cut", lambda df, name: kept.setdefault(name, real(df, name)))
    words = [f"b{k}" for k in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[30:]))], "item_id long, text string")
    loose = [(k, " ".join(f"{words[(7 * k + i) % 60]} or so" for i in range(200))) for k in range(50)]  # too few of the neighbours are an item's
    rows_ = [*loose, (100, "so " + " ".join(words[5:18]) + " it goes"), (101, " ".join(words[30:45])), (102, ""), (103, None)]
    found = {r.doc_id: (r.n_words, [tuple(x) for x in r.spans], r.items) for r in decontamination.search(spark.createDataFrame(rows_, "doc_id long, text string"), items).collect()}
    assert found[100] == (16, [(1, 14)], ["1"]) and found[101] == (15, [(0, 15)], ["2"]) and found[102] == found[103] == (0, [], [])
    assert all(not spans for k, (_, spans, _) in found.items() if k < 100)
    stored = {r.doc_id: r.n for r in kept["postings"].selectExpr("doc_id", "size(postings) as n").collect()}
    assert stored[100] and stored[101] and not any(n for k, n in stored.items() if k < 100)


# --- operator 8


def brute_counts(text):
    words = SPACE_WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_quality(docs, empty):
    got = quality.judge(docs).collect()
    want = sorted([(r[0], *brute_counts(r[1])) for r in ROWS], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=repr) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.judge(empty).collect() == []


def test_quality_hosts(spark):
    """A condemned host loses the documents that fail a rule; its clean ones stay."""
    clean = " ".join(f"word{k}" for k in range(40))
    rows_ = [(k, "only three words", "bad") for k in range(200)] + [(200, clean, "bad"), (201, clean + " # $ % & | < > # $ %", "bad")]
    rows_ += [(300 + k, clean + f" tail{k}", "good") for k in range(50)] + [(400, clean + " # $ % & | < > # $ %", "good")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()}
    assert got[200] and not got[201] and got[400] and all(got[300 + k] for k in range(50)) and not got[0]
