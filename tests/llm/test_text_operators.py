"""Line dedup, pieces, suffix dedup, toxicity and the pipeline, against brute force, round trips and planted cases."""

import os
import random
import zlib

import numpy as np
import pytest
import xxhash

from jobloom.llm import line_dedup, pieces, suffix_dedup, toxicity

ROWS = [
    (1, "alpha beta gamma\nsecond line here\nthird", "a"),
    (2, "", "a"),
    (3, None, None),
    (None, "text without id", "b"),
    (4, "é ü ß — 漢字 \U0001f600 ▁ marker  double  space \n\ttab", "b"),
    (4, "é ü ß — 漢字 \U0001f600 ▁ marker  double  space \n\ttab", "b"),
    (5, " ", "b"),
    (6, "x" * 5000 + " " * 300 + "y", "b"),
]


def frame(spark, rows, parts=3):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, t, s, 1, "k", None, -1) for i, t, s in rows], "doc_id long, text string, source string, d int, k string, ids string, score int"
    ).repartition(parts)


def texts(rng, n, vocabulary=300):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- operator 2


def brute_lines(rows, words=line_dedup.WORDS):
    """Texts without the windows that start earlier already, each with the longest stretch that follows any earlier one too; by (id, text)."""
    hashed = lambda t: line_dedup.signed(xxhash.xxh64_intdigest(t.encode(), 42))
    docs = sorted({(-(1 << 63) if i is None else i, t or "") for i, t, *_ in rows}, key=lambda x: (x[0], hashed(x[1])))
    lines, places, gone = {}, {}, {}
    for key in docs:
        lines[key] = [(n, x.encode().strip(), len(x.encode().split())) for n, x in enumerate(key[1].split("\n")) if x.encode().split()]
    for key in docs:
        body = lines[key]
        for start in range(len(body)):
            end, held = start, 0
            while end < len(body) and held < words:
                held += body[end][2]
                end += 1
            if held < words:
                break
            content = tuple(x[1] for x in body[start:end])
            most = -1
            for other, at in places.setdefault(content, []):
                n, held, at = 0, 0, at + end - start
                # The tail reaches as far as the operator looks: until the words of one more window are passed.
                while end + n < len(body) and held < words and at + n < len(lines[other]) and lines[other][at + n][1] == body[end + n][1]:
                    held += body[end + n][2]
                    n += 1
                most = max(most, n)
            places[content].append((key, start))
            if most >= 0:
                gone.setdefault(key, set()).update(range(start, end + most))
    return {k: "\n".join(x for n, x in enumerate(k[1].split("\n")) if n not in {lines[k][i][0] for i in gone.get(k, ())}) for k in docs}


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(1, 25))) for _ in range(25)]
    rows = ROWS + [(10 + k, "\n".join(rng.choice(pool) if rng.random() < 0.9 else "" for _ in range(rng.randint(0, 30))), "s") for k in range(60)]
    passage = "\n".join(" ".join(f"p{j}{k}" for k in range(20)) for j in range(3))
    rows += [(100, f"unique start\n{passage}\nunique end", "s"), (101, passage, "s"), (102, passage + "\n" + passage, "s"), (102, passage + "\n" + passage, "s")]
    # A hot passage whose earliest copy goes on otherwise than the later ones do among themselves; one id with several texts.
    tails = ["\n".join(f"tail{j} {k}" for k in range(4)) for j in range(3)]
    rows += [(200 + k, f"own{k}\n{passage}\n{tails[k % 3]}\nend{k}", "s") for k in range(30)]
    rows += [(150, f"{passage}\n{tails[k % 3]}\nsame id{k}", "s") for k in range(5)]
    want = brute_lines(rows)
    got = line_dedup.remove(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts_of = lambda i: sorted(t for j, t, _ in rows if j == i)
    for i in {i for i, _, _ in rows if i is not None and i >= 10}:
        assert sorted(r.text for r in got if r.doc_id == i) == sorted(want[i, t] for t in texts_of(i)), i
    kept = {r.doc_id: r.text for r in got}
    assert kept[100] == f"unique start\n{passage}\nunique end" and kept[101] == "" and kept[102] == "" and kept[3] is None and kept[2] == ""
    assert line_dedup.remove(frame(spark, rows).where("false")).collect() == []


def test_windows_choose_minima():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(0, 30)
        hashes, sizes = [rng.randint(0, 9) for _ in range(n)], [rng.randint(1, 9) for _ in range(n)]
        for start, end, at in line_dedup.windows(hashes, sizes, 12):
            assert start <= at < end and hashes[at] == min(hashes[start:end]) and sum(sizes[start:end]) >= 12 > sum(sizes[start : end - 1])


# --- operator 5


def test_pieces_round_trip(spark):
    rng = random.Random(1)
    rows = ROWS + [(10 + k, t, "s") for k, t in enumerate(texts(rng, 40))]
    got = pieces.decoded(pieces.encoded(frame(spark, rows))).collect()
    assert len(got) == len(rows) and all(r.decoded == r.text for r in got) and all((r.ids is None) == (r.text is None) for r in got)
    assert pieces.digest(pieces.decoded(pieces.encoded(frame(spark, rows).where("false")))).collect() == []
    assert all(r.restored for r in pieces.digest(pieces.decoded(pieces.encoded(frame(spark, rows)))).collect())


def test_viterbi_is_optimal():
    """Against the best of all segmentations, with a small set of pieces."""
    raw = [b"", *(bytes([b]) for b in range(256)), b" ", b"a", b"b", b"ab", b"ba", b" a", b" ab", b"aba", b"\xc3\xa9"]
    rng = random.Random(2)
    scores = [-np.inf] * 257 + [-rng.uniform(1, 6) for _ in range(len(raw) - 257)]
    use = pieces.Codec(raw, scores, list(range(1, 257)))
    named = {raw[i]: scores[i] for i in range(257, len(raw))}

    def brute(text):
        if not text:
            return 0.0
        best = max((named[text[:n]] + brute(text[n:]) for n in range(1, len(text) + 1) if text[:n] in named), default=-np.inf)
        size = 2 if text[0] >= 0x80 else 1
        return max(best, (use.unknown + brute(text[size:])) if text[:size] not in named else -np.inf)

    for _ in range(100):
        text = " " + "".join(rng.choice(["a", "b", "c", "é", "ü"]) for _ in range(rng.randint(1, 9)))
        ids, total, data = use.best(text.encode()), 0.0, text.encode()
        assert b"".join(raw[i] for i in ids) == data
        k = 0
        while k < len(ids):
            if ids[k] > 256:
                total, k = total + scores[ids[k]], k + 1
            else:
                total, k = total + use.unknown, k + (2 if raw[ids[k]][0] >= 0x80 else 1)
        assert abs(total - brute(data)) < 1e-9


def test_words_together_and_alone_alike(spark):
    """best_many() gives what best() gives, whatever words are decoded together; encode() joins them."""
    rng = random.Random(6)
    use = pieces.codec(spark)()
    words = [(" " + "".join(rng.choice("abcdeéü漢\U0001f600stnro") for _ in range(rng.randint(1, 11)))).encode() for _ in range(400)]
    words = [w for w in words if len(w) <= pieces.SHORT]
    assert [np.frombuffer(x, np.int32).tolist() for x in use.best_many(words)] == [use.best(w) for w in words]
    text = b"".join(words[:50])[1:]
    assert use.encode(text).tolist() == [i for w in words[:50] for i in use.best(w)]


def test_trie_finds_all_pieces():
    rng = random.Random(4)
    entries = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))) for _ in range(3000)}
    trie = pieces.Trie([(x, i) for i, x in enumerate(sorted(entries))])
    for x in entries:
        text = x + b"zz"
        assert {text[:end] for end, _ in trie.prefixes(text, 0)} == {text[:n] for n in range(1, len(text) + 1) if text[:n] in entries}


# --- operator 9


def brute_removed(docs, length):
    seen = {}
    for i, t in enumerate(docs):
        for k in range(len(t) - length + 1):
            seen.setdefault(t[k : k + length], []).append((i, k))
    gone = [bytearray(len(t)) for t in docs]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + length] = b"\1" * length
    return [(len(t), sum(g), sum(1 for k in range(len(g)) if g[k] and (not k or not g[k - 1])), bytes(c for c, x in zip(t, g, strict=True) if not x)) for t, g in zip(docs, gone, strict=True)]


@pytest.mark.parametrize("many", [1000, 2])
def test_suffix_dedup(spark, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    rng = random.Random(7)
    base = [" ".join(texts(rng, 8)) for _ in range(6)]
    rows = list(ROWS)
    for k in range(60):
        t = rng.choice(base)
        a = rng.randrange(max(1, len(t) - 150))
        piece = list(t[a : a + rng.randint(150, 1500)])
        for _ in range(rng.choice([0, 0, 1, 3])):
            if piece:
                piece[rng.randrange(len(piece))] = rng.choice("é#xyz")
        rows.append((100 + k, rng.choice(texts(rng, 1)) + "".join(piece) + rng.choice(texts(rng, 1)), "s"))
    rows += [(300, base[0], "s"), (301, base[0], "s"), (302, "ab" * 700, "s"), (303, "z" * 201, "s"), (304, "q" * 200, "s")]
    want = brute_removed([(t or "").encode() for _, t, _ in rows], suffix_dedup.LENGTH)
    want = sorted([(i, *w) for (i, _, _), w in zip(rows, want, strict=True)], key=repr)
    got = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == want
    assert any(w[2] for w in want)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.digest(suffix_dedup.remove(frame(spark, ROWS).where("false"))).collect() == []


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(300):
        t = bytes(97 + rng.randrange(rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 60)))
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_common_prefixes():
    rng = random.Random(6)
    for _ in range(200):
        t = bytes(97 + rng.randrange(rng.choice([1, 2])) for _ in range(rng.randint(0, 90))) + b"\0" * rng.randint(0, 3)
        order = suffix_dedup.suffix_array(t)
        want = []
        for i, j in zip(order.tolist(), order[1:].tolist(), strict=False):
            n = 0
            while n < 20 and max(i, j) + n < len(t) and t[i + n] == t[j + n]:
                n += 1
            want.append(n)
        assert suffix_dedup.common_prefixes(t, order, 20).tolist() == want


# --- operator 10


def toxic_rows(rng, n=900):
    words = ["".join(rng.choice(["an", "er", "on", "th", "es", "in", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["idiot", "scumbag", "moronic", "pathetic"]
    rows = []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                body.insert(rng.randrange(len(body)), rng.choice(bad))
        rows.append((k, " ".join(body), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(random.Random(9))
    docs = frame(spark, [(i, t, "s") for i, t, _ in rows] + [(None, "idiot text", "s"), (5000, None, "s"), (5001, "", "s"), (5002, "you 1d10t there", "s"),
                 (5003, "you are an i d i o t today", "s"), (5004, "what a m0r0n1c thing", "s"), (5005, "that is p@th3tic", "s"), (5006, "an idiooooot here", "s")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    assert len(got) == len(rows) + 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.predicted == y for r, y in held) >= 0.97 * len(held)
    assert [got[k].predicted for k in (5002, 5003, 5004, 5005, 5006)] == [1] * 5 and got[5000].predicted == got[5001].predicted == 0


def test_readings_are_the_best():
    """Viterbi against all paths through the lattice, for stretches of look-alikes, letters held down and words spelled out."""
    rng = random.Random(12)
    counts = np.array([[[rng.randint(0, 9) for _ in range(28)] for _ in range(28)] for _ in range(28)], np.int64)
    model = toxicity.letter_model(counts)
    assert np.allclose(np.exp(model).sum(axis=2), 1, atol=0.05)

    def brute(token):
        best = (-np.inf, None)
        paths = [("", 0.0)]
        for step in toxicity.lattice(token):
            paths = [(text + x, cost + c) for text, cost in paths for x, c in step]
        for text, cost in paths:
            letters = [0, 0, *(int(toxicity.CLASS[ord(c)]) for c in text), 0]
            p = sum(model[a][b][c] for a, b, c in zip(letters, letters[1:], letters[2:], strict=False)) - cost
            best = max(best, (p, text))
        return best

    def score(token, text):
        paths = {"": 0.0}
        for step in toxicity.lattice(token):
            new = {}
            for t, cost in paths.items():
                for x, c in step:
                    if text.startswith(t + x):
                        new[t + x] = min(new.get(t + x, np.inf), cost + c)
            paths = new
        letters = [0, 0, *(int(toxicity.CLASS[ord(c)]) for c in text), 0]
        return sum(model[a][b][c] for a, b, c in zip(letters, letters[1:], letters[2:], strict=False)) - paths[text]

    for _ in range(150):
        token = "".join(rng.choice(["a", "b", "c", "1", "0", "$", "!!", "|", "aaa", "e", "s"]) for _ in range(rng.randint(1, 6))).encode()
        got = toxicity.decode(token, model.tolist())
        assert abs(score(token, got) - brute(token)[0]) < 1e-9, (token, got)
    assert set(toxicity.suspicious(b"a$$ worthle55 (5hit hello 2024 10:30 soooo i d i o t")) == {b"a$$", b"worthle55", b"5hit", b"soooo", b"i d i o t"}
    long_ = toxicity.decode(b"a1" * 200_000, model.tolist())
    assert len(long_) >= 200_000


def test_conflicting_labels_are_toxic(spark):
    rows = [(k, "same text here", k % 2) for k in range(1, 40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert [(r.text, r.toxic) for r in toxicity.sample(docs, labels).collect()] == [("same text here", 1)]


def test_toxicity_without_labels(spark):
    docs = frame(spark, ROWS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.judged(docs, none).collect()} == {0}
    assert toxicity.judged(docs.where("false"), none).collect() == []


# --- memory of the pipeline's workers


def test_pipeline_bounds_what_workers_hold(spark):
    """A stage bounds the batches that go to workers by their bytes, unless the session does; a worker's stretches are bounded too, with the same ids."""
    import corpus_pipeline
    import pyarrow as pa
    from jobloom.llm import common

    before = spark.conf.get(common.BATCH_BOUND, None)
    try:
        spark.conf.unset(common.BATCH_BOUND)
        wide = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat('wide ', 400) as text", "'en' as lang", "'s' as source")
        corpus_pipeline.encoded(spark, wide, "")
        sizes = wide.select("text").mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
        sizes = [r.n for r in sizes.collect()]
        assert len(sizes) > 1 and max(sizes) < common.ARROW_BYTES + (1 << 16)
        spark.conf.set(common.BATCH_BOUND, "1m")
        corpus_pipeline.encoded(spark, wide, "")
        assert spark.conf.get(common.BATCH_BOUND) in ("1m", "1048576", "1048576b")
    finally:
        spark.conf.unset(common.BATCH_BOUND) if before is None else spark.conf.set(common.BATCH_BOUND, before)
    codec = pieces.Codec(*pieces.read())
    texts = [" ".join(f"n{i}" for i in range(k, k + 50_000)).encode() for k in range(0, 200_000, 50_000)]
    ids = [codec.encode(t) for t in texts]
    assert len(codec.cache) <= 120_000
    assert [codec.decode(x) for x in ids] == texts


# --- all operators


def test_very_long_texts(spark):
    """Unbroken stretches, one long line and many short ones, of a size that is rare; each operator gives a row a document, and what can be told of it."""
    from jobloom.llm import decontamination, licences, lm_scoring, quality, sharding, simhash

    unbroken, line = "a1" * 100_000, " ".join(f"w{k % 5000}" for k in range(60_000))
    many = "\n".join(f"line {k % 700} of many" for k in range(20_000))
    rows = [(1, unbroken, "a"), (2, line, "a"), (3, many, "b"), (4, "SPDX-License-Identifier: mit " * 5000, "b"), (5, line + " end", "b")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    assert {r.doc_id: r.n_tokens for r in lm_scoring.score(docs).collect()} == {i: len(t.split()) + 1 for i, t, _ in rows}
    assert {r.doc_id for r in line_dedup.remove(docs).where("doc_id = 3 and n_lines_removed > 19000").collect()} == {3}
    assert len({r.component_id for r in simhash.near_duplicates(docs).where("doc_id in (2, 5)").collect()}) == 1
    assert sharding.place(docs).count() == 5
    assert all(r.restored for r in pieces.digest(pieces.decoded(pieces.encoded(docs))).collect())
    assert {r.doc_id: (r.n_base, r.labels) for r in licences.digest(licences.scan(docs)).collect()}[4] == (0, "mit")
    assert {r.doc_id: r.n_hit for r in decontamination.digest(decontamination.search(docs, bench)).collect()} == {1: 0, 2: 40 * 12, 3: 0, 4: 0, 5: 40 * 12}
    assert {r.doc_id: r.n_words for r in quality.judge(docs).collect()} == {i: len(t.split()) for i, t, _ in rows}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.digest(suffix_dedup.remove(docs)).collect()} == {i: n for (i, _, _), (_, n, _, _) in zip(rows, brute_removed([t.encode() for _, t, _ in rows], 200), strict=True)}
    assert toxicity.judged(docs, labels).count() == 5


# --- the pipeline


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    rows = [(i, t, "en", "s", len(t)) for i, t, _ in toxic_rows(rng)]
    clean = " ".join(f"clean{k}" for k in range(60))
    rows += [(2000, clean, "en", "s", len(clean)), (2001, clean, "en", "s", len(clean)), (2001, clean, "en", "s", len(clean)), (2002, None, None, None, None), (2003, "", "en", "s", 0)]
    bench = " ".join(f"question{k}" for k in range(20))
    rows += [(2004, f"some words before {bench} and after", "en", "s", 0), (2005, "scumbag idiot " + clean, "en", "s", 0)]
    # Missing and repeated ids: what happens to one row does not happen to its namesake.
    own = [" ".join(f"own{j}word{k}" for k in range(40)) for j in range(6)]
    rows += [(None, own[0], "en", "s", 1), (None, f"{bench} and more", "en", "s", 1), (2004, own[1], "en", "s", 1), (2000, own[2], "en", "s", 1)]
    rows += [(2010, own[3], "en", "s", 1), (2010, own[4], "en", "s", 1), (2011, own[4].upper(), "en", "s", 1), (None, own[4].title(), "en", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic_rows(random.Random(11))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {(r.doc_id, r.text) for r in out}
    assert all(r.restored for r in out) and len(kept) == len(out) and sum(1 for r in out if not r.text) == 1
    assert (2000, clean) in kept and (2000, own[2]) in kept and (2004, own[1]) in kept and (None, own[0]) in kept and (2010, own[3]) in kept
    assert not [t for _, t in kept if t and (bench in t or "scumbag" in t)]
    near = [(i, t) for i, t in kept if t and t.lower() == own[4]]
    assert near == [(2010, own[4])]
    assert os.path.exists(tmp_path)


def test_long_stretches_are_read_as_a_whole(monkeypatch):
    """Writing out what is settled changes no reading: stretches of 2,000 runs, with letters that make ways differ for long."""
    rng = random.Random(17)
    for trial in range(40):
        counts = np.array([[[rng.choice([0, 0, 1, 40]) for _ in range(28)] for _ in range(28)] for _ in range(28)], np.int64)
        model = toxicity.letter_model(counts).tolist()
        token = "".join(rng.choice(["a", "b", "1", "0", "$", "!!", "|", "aaa", "e", ". ", "5"]) for _ in range(2000 if trial < 8 else 300)).encode()
        monkeypatch.setattr(toxicity, "PIECE", 1 << 40)
        whole = toxicity.decode(token, model)
        for piece in (1, 7, 64, 512):
            monkeypatch.setattr(toxicity, "PIECE", piece)
            assert toxicity.decode(token, model) == whole


def test_suffixes_are_sorted_in_bounded_memory():
    """What is held while suffixes are sorted is less than 130 times the text, whose order is that of its suffixes."""
    import random
    import tracemalloc

    from jobloom.llm.suffix_dedup import DEPTH, suffix_array

    rng = random.Random(3)
    words = [bytes(rng.choices(b"etaoinshrdlu", k=rng.randrange(1, 9))) for _ in range(2000)]
    text = b" ".join(rng.choice(words) for _ in range(40_000))[: 1 << 17]
    tracemalloc.start()
    order = suffix_array(text).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys = [text[i : i + DEPTH] for i in order]
    assert sorted(order) == list(range(len(text))) and all(a <= b for a, b in zip(keys, keys[1:], strict=False))
    assert peak < 130 * len(text)
