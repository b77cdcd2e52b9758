"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from plumbline.llm import bpe, mixing, neardup, ngrams, quality, substring, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DDL = "doc_id long, text string, source string, n_chars long, size long, score double, kept string"


def make(spark, texts, source=None):
    rows = [(i, t, (source[i] if source else f"s{(i or 0) % 3}"), len(t or ""), -1, -1.0, "x") for i, t in texts]
    return spark.createDataFrame(rows, DDL).repartition(3)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiousté") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    for i in range(6):
        texts[i] = texts[i] + "\n" + passage + " \t " + texts[i]
    for i in range(20, 26):
        words = texts[30].split(" ")
        words[len(words) // 2] = f"edit{i}"
        texts[i] = " ".join(words)
    texts[40] = texts[41]
    out = list(enumerate(texts))
    out += [(100, None), (101, ""), (102, " \t\n "), (103, "One"), (104, "one"), (105, "a b c d"), (106, "A B C D"), (107, "a b c d"), (107, "a b c d"), (None, "a b c d"), (108, "word " * 3000), (109, "it's   we'll　x  're don't\n\n 12² \U0001f600")]
    return out


@pytest.fixture(scope="module")
def texts():
    return corpus()


def words(t):
    return (t or "").encode().split()


def test_pretokens_equal_the_pattern():
    rng = random.Random(4)
    alphabet = list("abst'’ \n\t\r 　é1²٣.,!relvmd漢\U0001f600\x85  ") + ["'s", "'re", "'ll", "'d", "'ve", "'t", "'m"]
    many = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    raw = [x.encode() for x in many]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    starts = bpe.pretoken_starts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    first, data, pattern = np.searchsorted(starts, offsets), b"".join(raw), regex.compile(public_tokenizers.PATTERN)
    for i, x in enumerate(many):
        at = starts[first[i] : first[i + 1]]
        assert [data[a:b].decode() for a, b in zip(at, [*at[1:], offsets[i + 1]])] == pattern.findall(x)


def test_bpe_equals_the_library_and_decodes(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = make(spark, texts)
    want = sorted((str(i), len(k := lib.encode_ordinary(t or "")), hashlib.sha256(np.array(k, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    got = bpe.encode_digests(df, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.data)) for r in back) == sorted((str(i), (t or "").encode()) for i, t in texts)


def test_token_files_round_trip(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    folder, manifest = token_files.write(make(spark, texts), RANKS, public_tokenizers.PATTERN, 50256)
    want = sorted((str(i), len(lib.encode_ordinary(t or ""))) for i, t in texts)
    for block in (7, 100, 1 << 20):
        got = manifest.join(token_files.scan(spark, folder, 50256, block_tokens=block), ["file", "place"]).collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_open_last_document_and_empty_files(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.bin").write_bytes(b"")
    got = token_files.scan(spark, f"file://{tmp_path}", 9, block_tokens=2).orderBy("place").collect()
    assert [(r.place, r.n_tokens, r.closed) for r in got] == [(0, 2, True), (1, 0, True), (2, 1, False)]


def brute_groups(texts, percent=85):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = [i for i, _ in texts]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(str(i), len(s), str(least[root(k)] if i is not None else None), i is None or i == least[root(k)]) for k, (i, s) in enumerate(zip(ids, sets))]


def test_near_duplicates_equal_brute_force(spark, texts):
    got = neardup.near_duplicates(make(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(brute_groups(texts))


def test_near_duplicates_with_hot_values(spark, monkeypatch):
    """Long lists, a common passage and a group of near copies that link through others only."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(w)))
    for i in range(90, 180):
        texts.append((i, " ".join([f"x{rng.randint(0, 10**6)}" for _ in range(60)] + passage)))
    monkeypatch.setattr(neardup, "HOT", 20)
    got = neardup.near_duplicates(make(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(brute_groups(texts))


def test_hot_lists_pair_only_sets_that_may_link(spark, monkeypatch):
    """Sets that share most of a large group's words, but too few with any one of it, aren't paired with each."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]

    def edited(i, at):
        return i, " ".join(f"e{i}_{k}" if k in at else w for k, w in enumerate(base))

    far = [sorted(rng.sample(range(80, 145, 5), 3)) for _ in range(12)]
    texts = [edited(i, {5 + i}) for i in range(60)] + [edited(60 + i, set(at)) for i, at in enumerate(far)]
    # These link with one of the group, by common words alone.
    texts += [edited(80 + i, {5 + 12 * i, 82 + 12 * i, 140}) for i in range(4)]
    rows, across = [], neardup._hot_across
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(neardup, "_hot_across", lambda *x: rows.append(across(*x).select("a", "b", "shared").collect()) or across(*x))
    got = neardup.near_duplicates(make(spark, texts), percent=80).collect()
    truth = brute_groups(texts, 80)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(truth)
    assert {t[2] for t in truth if int(t[0]) < 60 or int(t[0]) >= 80} == {"0"} and len({t[2] for t in truth}) > 8
    (pairs,) = rows
    assert pairs and len(pairs) <= 40 and len({(r.a, r.b) for r in pairs}) == len(pairs)


def test_marks_differ_in_no_more_bits_than_values():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 6000).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (0, 1, 40, 41, 900, 3000, 5000)] + [pool[:700], pool[20:700]]
    edges = np.cumsum([0] + [len(x) for x in sets])
    every = np.full(1 << 19, 0xFFFFFFFF, np.uint32)
    marks = np.unpackbits(neardup.hot_marks(np.concatenate(sets), edges, np.arange(len(sets)), every), axis=1)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert int((marks[i] ^ marks[j]).sum()) <= len(np.setxor1d(x, y))
    assert int((marks[-1] ^ marks[-2]).sum()) >= 16


def brute_repeats(texts, window=35):
    seen = collections.Counter()
    for _, t in texts:
        w = words(t)
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] += 1
    out = []
    for i, t in texts:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, texts):
    got = substring.repeat_digests(make(spark, texts)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute_repeats(texts))
    full = substring.remove_repeats(make(spark, texts))
    assert full.columns == ["doc_id", "text", "source", "n_chars", "size", "score", "n_words", "n_removed", "kept"]
    for r in full.collect():
        assert (r.kept == r.text) if not r.n_removed else hashlib.sha256(r.kept.encode()).hexdigest() in {x[3] for x in brute_repeats(texts)}


def test_backoff_scores_equal_brute_force(spark, texts):
    counts = [collections.Counter() for _ in range(3)]
    split = [(i, (t or "").encode().lower().split()) for i, t in texts]
    for _, w in split:
        for n in range(1, 4):
            counts[n - 1].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, want = sum(counts[0].values()), []
    for i, w in split:
        own = [collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in range(1, 4)]
        c = lambda g: counts[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        s = 0.0
        for k in range(len(w)):
            for dropped, n in enumerate(range(min(3, k + 1), 0, -1)):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    s += math.log(max(c(g), 1) / max(total - len(w), 1)) + dropped * math.log(0.4)
                elif c(g) > 0:
                    s += math.log(c(g) / max(c(g[:-1]), 1)) + dropped * math.log(0.4)
                    break
        want.append((str(i), len(w), round(s / len(w), 8) if w else None))
    got = ngrams.backoff_scores(make(spark, texts)).collect()
    assert sorted(map(repr, ((str(r.doc_id), r.n_words, None if r.score is None else round(r.score, 8)) for r in got))) == sorted(map(repr, want))


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(["w"] * rng.randint(0, 60))) for i in range(1500)] + [(5000, None), (5001, ""), (None, "a b"), (7, "a a")]
    source = {i: (None if (i or 0) % 50 == 3 else "big" if (i or 0) % 3 == 0 else f"s{(i or 0) % 5}") for i, _ in texts}
    df = make(spark, texts, source)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts) and rows == mixing.mix(df).collect() or sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(df).collect()))
    total, by, taken = sum(len(words(t)) for _, t in texts), collections.Counter(), collections.Counter()
    for r in rows:
        by[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 3 * r["size"] and r["size"] == len(words(r.text))
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, fixed = {}, {}
    while True:
        free = [s for s in order if s not in fixed]
        target = {**fixed, **{s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}}
        over = {s: 3.0 * by[s] for s in free if target[s] > 3 * by[s]}
        if not over:
            break
        fixed |= over
    for r in rows:
        assert r.source_size == by[r.source] and r.target == pytest.approx(target[r.source])
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s] + 180
    assert mixing.emit(mixing.mix(df), df.columns).count() == sum(r.copies for r in rows)


def test_quality_rules_learn_and_compile(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "tree", "house"]) + rng.choice(["", ",", "."]) for _ in range(rng.randint(8, 200)))) for i in range(0, 700)]
    bad = [(i, " ".join("".join(rng.choice("ABC#$%") for _ in range(4)) + "!!" for _ in range(rng.randint(8, 200)))) for i in range(700, 1000)]
    edge = [(2000, None), (2001, ""), (2002, "x" * 50_000), (None, "of the"), (3, "the house")]
    df = make(spark, good + bad + edge)
    labels = spark.createDataFrame([(i, int(i < 700)) for i, _ in good + bad] + [(None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model)
    assert got.columns.count("score") == 1 and got.count() == len(good + bad + edge)
    rows = [r for r in got.withColumn("h", quality.held_out(F.col("doc_id"))).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.h and r.doc_id is not None and r.doc_id < 1000]
    assert sum((r.doc_id < 700) == (r.predicted == 1) for r in held) >= 0.97 * len(held)
    stats = quality.statistics(F.col("text"))
    x = df.select("doc_id", *[c.alias(n) for n, c in stats.items()]).toPandas()
    want = model.predict(x[list(stats)].to_numpy(float), list(stats))
    assert np.allclose(sorted(want), sorted(r.score for r in rows), atol=1e-12)
    none = quality.fit(df, labels.filter("quality = 7"))
    assert [r.score for r in quality.score(df.limit(2), none).collect()] == [1.0, 1.0]


def test_empty_tables(spark):
    df = spark.createDataFrame([], DDL)
    assert bpe.encode_digests(df, RANKS, public_tokenizers.PATTERN).count() == 0
    assert neardup.near_duplicates(df).count() == 0
    assert substring.repeat_digests(df).count() == 0
    assert ngrams.backoff_scores(df).count() == 0
    assert mixing.mix(df).count() == 0
    folder, manifest = token_files.write(df, RANKS, public_tokenizers.PATTERN, 50256)
    assert manifest.count() == 0 and token_files.scan(spark, folder, 50256).count() == 0
    assert quality.score(df, quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
