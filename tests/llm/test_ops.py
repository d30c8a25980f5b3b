"""Each operator against brute force, the library it must equal, or held-out labels; and the edge rows that every operator must take."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framescope.llm import components, embeddings, language, licenses, lm, merges, neardup, packing, quality, sentencepiece, sharding, toxicity, word_tokens

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = "lorem ipsum dolor sit amet " * 4000
SCHEMA = "doc_id long, text string, lang string, source string, score double, ids string, shard string, node string, _id string, _part int, _best int, kept string"
#: Null and empty texts, blanks, one word, a very long text, repeated rows, a null id; and columns named like the operators' own.
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "word", "en", None), (5, LONG, "en", "a"), (6, "The same text, twice and more.", "en", "a"),
    (6, "The same text, twice and more.", "en", "a"), (7, "The same text, twice and more.", "fr", "b"), (None, "no id here at all", "en", "a"), (8, "é漢😀 <s> ﬁ x", "xx", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, 0.5, "i", "s", "n", "own", 7, 8, "k") for r in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(n=120, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéstu") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    return [" ".join(rng.choices(vocab, k=rng.randint(1, 80))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def labels_of(spark):
    return spark.createDataFrame([(6, 1), (7, 0), (None, 1), (5, 0)], "doc_id long, toxic int")


OPERATORS = {
    "sentencepiece": lambda spark, d: sentencepiece.decode(sentencepiece.encode(d, PIECES), PIECES),
    "language": lambda spark, d: language.label_languages(d, language.train(*language.training_windows(d), steps=3)),
    "lm": lambda spark, d: lm.lm_scores(d, F.col("doc_id") % 2 == 0, F.col("doc_id") % 4 == 0),
    "packing": lambda spark, d: packing.pack_documents(d, WORDS),
    "sharding": lambda spark, d: sharding.number_slots(sharding.assign_shards(d, "doc_id", [1.0] * 5, 1.0), "shard", ["doc_id"]),
    "neardup": lambda spark, d: neardup.near_duplicates(d),
    "licenses": lambda spark, d: licenses.scan_licenses(d),
    "toxicity": lambda spark, d: toxicity.score_toxicity(d, toxicity.learn_lexicon(d, labels_of(spark))),
    "quality": lambda spark, d: quality.quality_rules(d),
    "drop_toxic": lambda spark, d: toxicity.drop_toxic(d, toxicity.Lexicon({"word": 1.0}), least=2.0),
    "vectors": lambda spark, d: embeddings.near_vectors(d.withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double"))).withColumnRenamed("node", "raw"), id_col="doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, edge, empty, name):
    out = OPERATORS[name](spark, edge).collect()
    ids = Counter(r["doc_id"] for r in out)
    if name == "packing":
        assert set(ids) == {r[0] for r in EDGE}
    else:
        assert ids == Counter(r[0] for r in EDGE)
    assert OPERATORS[name](spark, empty).count() == 0


def test_pieces_equal_the_library(spark):
    import sentencepiece as library

    rng = random.Random(3)
    alphabet = " aabbeé▁\n\t  xy漢字😀​\x00<s>0x0A.,́ﬁ 　"
    rows = texts(40) + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a" * 1500, " " * 300, "", None, "<s> </s> <unk> <0x0A>"]
    lib = library.SentencePieceProcessor(model_file=PIECES)
    out = {r.doc_id: r for r in sentencepiece.decode(sentencepiece.encode(frame(spark, rows), PIECES), PIECES).collect()}
    for k, text in enumerate(rows):
        ids = lib.encode(text or "")
        assert out[k].ids == ids and out[k].decoded == lib.decode(ids), text


def by_agenda(pairs, symbols):
    """One merge after the other: the least rank, the leftmost of equals."""
    symbols = list(symbols)
    while found := [(pairs[p][0], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]:
        k = min(found)[1]
        symbols[k : k + 2] = [pairs[symbols[k], symbols[k + 1]][1]]
    return symbols


def test_rounds_merge_like_one_by_one():
    rng = np.random.default_rng(0)
    # the second table's joined symbols merge on before other places do
    for pairs in ({(0, 1): (1, 2), (2, 0): (2, 3), (1, 0): (3, 4), (0, 0): (4, 5)}, {(0, 1): (3, 2), (2, 0): (0, 3), (1, 0): (2, 4), (0, 0): (1, 5), (3, 1): (4, 6)}):
        table = merges.MergeTable(pairs)
        sizes = rng.integers(0, 150, 60)
        symbols = rng.integers(0, 2, sizes.sum())
        ids, counts = table.merge(symbols, sizes)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [by_agenda(pairs, x.tolist()) for x in np.split(symbols, np.cumsum(sizes)[:-1])]


def test_long_segment_equals_the_library():
    import sentencepiece as library

    rng = random.Random(8)
    lib, model = library.SentencePieceProcessor(model_file=PIECES), sentencepiece.load(PIECES)[0]
    for text in ("".join(rng.choices("etaoinshrdlu", k=100_000)), "ab" * 50_000):
        assert model.encode_batch([text], merges.SegmentStore(10))[0].tolist() == lib.encode(text)


def test_word_ids_equal_the_library():
    import pyarrow as pa

    rng = random.Random(2)
    alphabet = " aAbB'sS'tRe\n\t 019,.!éÉßİıǅ漢Σς<|endoftext|>\x85\xa0\x1ćª²½Ⅷ_"
    rows = texts(30) + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["don't I'LL we'Ve '''s", "x<|endoftext|>y", ""]
    t = word_tokens.load(WORDS)
    flat, at = t.encode_batch(pa.array(rows))
    for k, text in enumerate(rows):
        assert flat[at[k] : at[k + 1]].tolist() == t.library.encode(text, add_special_tokens=False).ids, text


def test_language_gradient_and_held_out_accuracy(spark):
    rng = random.Random(5)
    words = {"aa": ["the", "and", "thing", "with", "over"], "bb": ["der", "und", "schlich", "über", "nicht"], "cc": ["que", "los", "ción", "para", "ñame"]}
    docs = [(k, " ".join(rng.choices(words[lang], k=30)), lang) for k in range(240) for lang in [list(words)[k % 3]]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    windows, target, langs = language.training_windows(df.where("doc_id % 5 <> 0"))
    net = language.Network.start(langs, 4, np.random.default_rng(0))
    codes, valid = windows[:4].T.astype(np.int64), (windows[:4].T > 0).astype(np.float32)
    _, grad = net.gradients(codes, target[:4], valid)
    for name in ("inp", "rec", "out", "bias"):
        a, at = getattr(net, name), np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        a[at] += 1e-2
        up, _ = net.gradients(codes, target[:4], valid)
        a[at] -= 2e-2
        down, _ = net.gradients(codes, target[:4], valid)
        a[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[name][at]) < 1e-3 + 0.02 * abs(grad[name][at])
    out = language.label_languages(df, language.train(windows, target, langs, steps=60)).collect()
    held = [(r.lang_pred, docs[r.doc_id][2], r.score) for r in out if r.doc_id % 5 == 0]
    assert sum(a == b for a, b, _ in held) >= 0.95 * len(held) and all(0 <= s <= 1 for *_, s in held)
    assert set(language.position_labels(language.train(windows, target, langs, steps=60), "der und nicht über")) <= set(langs)


def test_lm_counts_and_gain(spark):
    rows = texts(150, 4)
    rows = [f"{t} {t}" for t in rows]
    df = frame(spark, rows)
    out = {r.doc_id: r for r in lm.lm_scores(df, F.col("doc_id") % 7 != 2, F.col("doc_id") % 7 == 3).collect()}
    tokens = {k: [*t.split(), None] for k, t in enumerate(rows)}
    counts = Counter(w for k, t in tokens.items() if k % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for k, t in tokens.items():
        r = out[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trained) == (len(t), sum(counts[w] > 0 for w in t), n, k % 7 != 2)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [r for r in out.values() if not r.trained]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 1e-6
    block = lm.Block.of(np.array([5, 7, 5, lm.END], np.uint64), np.array([4]))
    left, right, _, of = block.pairs()
    assert block.words[left[of]].tolist() == [int(lm.END), 5, 7, 5] and block.words[right[of]].tolist() == [5, 7, 5, int(lm.END)]
    values = np.array([0, 3, 70000, 2], np.int64)
    assert lm.unpack(lm.pack(values)).tolist() == values.tolist()


def test_lm_weights_find_the_better_estimate():
    assert lm._bucket_of(np.array([0, 1 << 47, (1 << 48) - 1], np.uint64), 48, 1000).tolist() == [0, 500, 999]
    w = lm.fit_weights(np.zeros(2, np.int64), np.array([0.5, 0.4]), np.array([0.01, 0.01]), 1e-3, np.array([5.0, 5.0]))
    assert w[0, 0] > 0.95 and np.allclose(w.sum(axis=1), 1)


def test_packing_windows():
    assert sum(n * k for n, k in packing.fill_window({7: 1, 5: 2, 4: 1, 3: 9}, 16)) == 16
    rng = random.Random(1)
    for _ in range(50):
        counts = Counter(rng.randint(1, 20) for _ in range(rng.randint(1, 8)))
        cap = rng.randint(20, 60)
        got = packing.fill_window(counts, cap)
        assert all(k <= counts[n] for n, k in got)
        rest = counts - Counter({max(counts): 1})
        best = {0}
        for n in rest.elements():
            best |= {s + n for s in best if s + n <= cap - max(counts)}
        assert sum(n * k for n, k in got) == max(best) + max(counts)
    packer = packing.WindowPacker(64, 500)
    sizes = [rng.randint(1, 63) for _ in range(300)]
    out = [s for k, n in enumerate(sizes) for s in packer.add(n, k)] + list(packer.finish())
    seen = Counter()
    for s in out:
        total = sum(b - a for _, a, b in s)
        assert total <= 64
        for k, a, b in s:
            seen.update((k, i) for i in range(a, b))
    assert set(seen.values()) == {1} and len(seen) == sum(sizes)


def test_packed_pieces(spark):
    rows = texts(60) + [LONG, "", None]
    out = packing.pack_documents(frame(spark, rows), WORDS, capacity=256, pool=2000).collect()
    lib = word_tokens.load(WORDS).library
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(rows):
        want = np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        got = b"".join(bytes(r.ids) for r in sorted(by[k], key=lambda r: r.start))
        assert zlib.crc32(got) == zlib.crc32(want.tobytes()) and all(r.doc_tokens == want.size for r in by[k])
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


def test_shards(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    out = sharding.number_slots(sharding.assign_shards(df, "doc_id", [1.0, 1.0, 2.0, 4.0], 1.0), "shard", ["doc_id"], part_rows=300, least_parts=2).collect()
    sizes = Counter(r.shard for r in out)
    assert all(abs(sizes[s] / 4000 - w / 8) < 0.03 for s, w in enumerate((1, 1, 2, 4)))
    assert all(r.grown_shard in (r.shard, 4) for r in out) and abs(sum(r.grown_shard == 4 for r in out) / 4000 - 1 / 9) < 0.03
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    by_hand = {}
    for k in range(50):
        draw = lambda s: (int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: B023, E731
        by_hand[k] = max(range(4), key=lambda s: (1, 1, 2, 4)[s] / -math.log(draw(s)))
    assert {r.doc_id: r.shard for r in out if r.doc_id < 50} == by_hand


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    rng = random.Random(9)
    rows = texts(40, 8) + ["a b c d e f g h i", "a b c d e f g h"]  # 5 and 4 shingles
    for base in rows[:12]:  # chains of near copies, across the threshold both ways
        words = base.split()
        for _ in range(8):
            words = list(words)
            for _ in range(rng.choice((0, 1, 1, 3))):
                words[rng.randrange(len(words))] = f"w{rng.random():.4f}"
            rows.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    rows = [t.replace("É", "é") for t in rows]
    sets = []
    for t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split(" ")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    out = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, rows), percent=percent, block=4).collect()}
    assert {k: r.component_id for k, r in out.items()} == {k: find(k) for k in range(len(rows))}
    assert all(out[k].n_shingles == len(sets[k]) and out[k].kept == (find(k) == k) for k in out)
    assert len(set(find(k) for k in out)) < len(rows) - 10


def test_near_duplicates_link_through_rows_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    chain = [" ".join(words), " ".join(words[:-4]), " ".join(words[:-8])]  # the ends are apart but for the middle
    df = spark.createDataFrame([(1, chain[0]), (None, chain[1]), (2, chain[2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, percent=90).collect()} == {1: 1, 2: 1, None: None}
    assert [neardup.least_set(p) for p in (50, 80, 85, 95)] == [1, 4, 6, 19] and neardup.banding(85) == (25, 5)


def test_drop_near_duplicates_keeps_columns(spark, edge):
    left = neardup.drop_near_duplicates(edge)
    assert left.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, k) for k in (1, 2, 3, 4, 5, 6, 8)] + [(True, 0)]


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:3000]), np.unique(pool[600:3600])
    ra, rb = neardup.sketches([a, b])
    assert abs(neardup.estimate((ra == rb).sum()) - 2400 / 3600) < 0.15
    assert (neardup.sketches([a[::400]]) > 0).all()
    with pytest.raises(ValueError):
        neardup.banding(5)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (5, 5), (7, 6), (6, 8), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 6: 6, 7: 6, 8: 6, 9: 6}
    path = spark.range(1, 200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components.connected_components(path).collect()} == {1}


def test_license_expressions():
    assert licenses.to_postfix("MIT OR (Apache-2.0 AND BSD-3-Clause WITH exception)") == ["mit", "apache-2.0", "bsd-3-clause", "exception", "with", "and", "or"]
    told = lambda x, *permitted: licenses.evaluate(licenses.to_postfix(x), permitted)
    assert told("MIT OR (Apache-2.0 AND BSD-3-Clause)", "apache-2") == ({"mit", "apache-2", "bsd-3-clause"}, False)
    assert told("MIT OR (Apache-2.0 AND BSD-3-Clause)", "apache-2", "bsd-3-clause")[1] and told("GPL-2.0 WITH linking-exception", "gpl-2.0") == ({"gpl-2.0 with linking-exception"}, True)
    many = told(" AND ".join(f"(A-{k} OR B-{k})" for k in range(40)), *(f"b-{k}" for k in range(40)))
    assert len(many[0]) == 80 and many[1]
    assert licenses.to_postfix("GPL-3.0 and so on") == ["gpl-3.0"] and licenses.to_postfix("(MIT") is None and licenses.to_postfix("") is None


def test_license_scan(spark):
    rows = ["Under THE mit-license, under the\nMIT license", "CC-BY-NC cc by nc", "é apache license, version 2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0\nx", "summit license", None]
    out = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (out[0].n_words, out[0].base_starts, out[0].base_labels) == (8, [0, 4], ["mit"])
    assert (out[1].base_starts, out[1].labels) == ([0, 3], ["cc-by-nc"])
    assert (out[2].base_starts, out[2].base_labels) == ([1], ["apache-2"])
    assert (out[3].labels, out[3].expressions, out[3].base_starts, out[3].permitted) == (["apache-2", "mit"], ["mit apache-2.0 or"], [], True)
    assert out[4].labels == [] and out[4].score == 0 and out[5].n_words == 0


def test_toxicity(spark):
    assert toxicity.fold("Ѕtupíd, 1d10t! the 5th a-b") == ["stupid", "idiot", "the", "sth", "a", "b"]
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(400):
        words = rng.choices(["alpha", "beta", "gamma", "delta", "rho", "tau"], k=rng.randint(5, 60))
        if k % 8 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["grubble", "Grubb1e", "grübble"]))
        elif k % 40 == 1:
            words += ["mild", "grubble"]
        rows.append(" ".join(words))
        marks.append((k, int(k % 8 == 0)))
    df, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(df.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 <> 0"))
    assert "grubble" in lexicon.weights
    out = {r.doc_id: r.score for r in toxicity.score_toxicity(df, lexicon).collect()}
    assert all((out[k] >= 0.5) == bool(m) for k, m in marks)
    assert "mild grubble" in lexicon.exceptions and lexicon.score(["alpha", "mild", "grubble", "beta"])[1] == 0
    for k, text in enumerate(rows):  # by hand: words and stems, less those in an exception
        words = toxicity.fold(text)
        free = [w for i, w in enumerate(words) if not any(" ".join(words[max(0, i - m) : i - m + n]) in lexicon.exceptions for n in (2, 3) for m in range(n))]
        total = sum(v for w in free for key, v in lexicon.weights.items() if (w.startswith(key[:-1]) if key.endswith(toxicity.STEM) else w == key))
        assert math.isclose(out[k], 1 / (1 + math.exp(-(lexicon.bias + lexicon.slope * math.log1p(total / len(words) ** lexicon.power)))), rel_tol=1e-9)
    assert {r.doc_id for r in toxicity.drop_toxic(df, lexicon).collect()} == {k for k, m in marks if not m}


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8))
    x = np.concatenate([x, x[:60] + 0.15 * rng.normal(size=(60, 8)), x[:20]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    out = {r.vec_id: r for r in embeddings.near_vectors(df, block=40).collect()}
    same = (x == x[0]).all(axis=1) | close[0]  # the row without an id repeats row 0
    low = list(range(len(x)))
    for _ in range(len(x)):
        for i in range(len(x)):
            low[i] = min([low[i], *(low[j] for j in np.flatnonzero(close[i]))])
    for k in range(len(x)):
        assert out[k].n_links == close[k].sum() + same[k] and out[k].component_id == low[k] and out[k].kept == (low[k] == k)
    assert all((out[k].n_links, out[k].component_id) == (0, k) for k in range(900, 905))
    assert out[905].n_links == 1 and out[906].component_id == 905 and out[None].component_id is None
    assert embeddings.near_vectors(df.where("vec_id < 0")).count() == 0


def test_quality_statistics(spark):
    rng = random.Random(6)
    rows = texts(30) + ["a b c d e f a b c d e", "x y\nx y\n\n \nz", " ".join(rng.choices("abc", k=200)), "##$$ %|<> a", "one two three four five one two three four five one"]
    kept = quality.text_statistics(frame(spark, rows), "text", ["doc_id"]).collect()
    for r in kept:
        t = rows[r.doc_id]
        w = t.split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        counts = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_quality_outliers(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("abcdefgh  ") for _ in range(400)) + "\n" + " ".join(rng.choices(["ab", "cd", "efg"], k=rng.randint(20, 40))), "en", "hot" if k % 3 else f"s{k % 4}") for k in range(900)] + [(2000, " ".join("$$$%%%" for _ in range(50)) + " a b c d e f g h i j k", "xx", "alone")]
    rows += [(1000 + k, " ".join(f"word{rng.random():.6f}$$$&&&%%%" for _ in range(120)), "en", "hot") for k in range(30)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sum(not r.kept and not r.base_failed for r in out if r.doc_id >= 1000) == 30
    assert sum(not r.kept and not r.base_failed for r in out if r.doc_id < 1000) <= 3
    assert all((r.distance is None) == r.base_failed for r in out)
    assert math.isclose(quality.chi2_quantile(0.95, 3), 7.814728, abs_tol=1e-4)


def test_long_texts_of_no_learnt_language_go(spark):
    import corpus_pipeline

    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    alphabets = {"cyrillic": "абвгдежзийклмнопрстуфхцчшщыьэюя", "consonants": "bcdfghjklmnpqrstvwxz", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "hex": "0123456789abcdef"}
    other = [(-k - 1, " ".join("".join(rng.choices(a, k=rng.randint(2, 8))) for _ in range(400))) for k, a in enumerate(list(alphabets.values()) * 5)]
    df = docs.unionByName(spark.createDataFrame(other, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, df, "").select("doc_id").collect()}
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.octet_length("text").alias("n")).collect()}
    assert {k for k, n in sizes.items() if n < 64} <= kept
    assert len(set(sizes) & kept) >= 0.995 * len(sizes)
    assert len({r[0] for r in other} & kept) <= 1


def test_license_names_of_letters_and_open_brackets(spark):
    tag = "SPDX-License-Identifier: "
    rows = [tag + "PostgreSQL", tag + "MIT AND Ruby", f"# {tag}(MIT OR\n#   Apache-2.0)\n# more", tag + "MIT and so on", "the license expression of this file", tag + "\nplain text", tag + "(MIT\nand prose", tag + "NCSA OR Vim\nOR curl"]
    out = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (out[0].labels, out[0].permitted) == (["postgresql"], False) and out[0].score > 0.9
    assert (out[1].labels, out[1].permitted) == (["mit", "ruby"], False)
    assert (out[2].expressions, out[2].permitted) == (["mit apache-2.0 or"], True)
    assert out[3].labels == ["mit"] and all(out[k].labels == [] for k in (4, 5, 6)) and out[7].labels == ["ncsa", "vim"]


def test_mcd_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 2]]), rng.normal(8, 1, (40, 3))])
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "_g string, a double, b double, c double")
    got = quality.mcd_estimates(rows, list("abc"), [0.1] * 3, 0.75, 4).first()
    low = lambda v, share: np.sort(v)[int(np.ceil(share * len(v))) - 1]
    centre = np.array([low(v, 0.5) for v in x.T])
    cov = np.diag([(1.4826 * low(np.abs(v - m), 0.5)) ** 2 + 0.01 for v, m in zip(x.T, centre)])
    for _ in range(4):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        best = x[d <= low(d, 0.75)]
        centre, cov = best.mean(axis=0), np.cov(best.T, bias=True) * quality.consistency(0.75, 3) + 0.01 * np.eye(3)
    factor = np.linalg.cholesky(cov)
    assert np.allclose(quality.cholesky(cov.tolist())[2], factor[2])
    whole = quality.pooled(rows, list("abc"), [0.1] * 3, 0.75, 4)
    assert all(math.isclose(whole[f"c_{i}_{j}"], cov[i, j], rel_tol=1e-6, abs_tol=1e-8) for i in range(3) for j in range(i + 1))
    assert all(math.isclose(got[f"m_{i}"], centre[i], rel_tol=1e-6, abs_tol=1e-8) for i in range(3))
    assert all(math.isclose(got[f"l_{i}_{j}"], factor[i, j], rel_tol=1e-6, abs_tol=1e-8) for i in range(3) for j in range(i + 1))


def test_dual_traversal_measures_few_pairs():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 64)), 40, axis=0) + 0.02 * rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    walk = embeddings.DualTraversal(embeddings.CoverTree(x), None, 0.9)
    found = {(min(p), max(p)) for left, right in walk.links() for a in left.tolist() for b in right.tolist() for p in [(a, b)]}
    assert found == set(zip(*[v.tolist() for v in np.nonzero(np.triu(x @ x.T >= 0.9, 1))])) and walk.measured < 1200 * 1199 / 2 / 8


def test_position_probabilities_equal_a_plain_network():
    net = language.Network.start(["a", "b", "c"], 4, np.random.default_rng(2))
    text = "Ünder the sea, where it is all quiet and the fish swim by themselves for ever"
    sigmoid, data = lambda v: 1 / (1 + np.exp(-v)), text.encode()
    total = np.zeros(3)
    for s in range(0, len(data), 64):
        window = data[s : s + 64].ljust(64, b"\0")
        states = []
        for side, order in ((0, range(64)), (1, range(63, -1, -1))):
            h, out = np.zeros(4), {}
            for t in order:
                x, g = net.inp[side][window[t]], h @ net.rec[side]
                z, r = sigmoid(x[:4] + g[:4]), sigmoid(x[4:8] + g[4:8])
                h = (1 - z) * np.tanh(x[8:] + r * g[8:]) + z * h
                out[t] = h
            states.append(out)
        for t in range(len(data[s : s + 64])):
            v = np.exp(states[0][t] @ net.out[0] + states[1][t] @ net.out[1] + net.bias)
            total += v / v.sum()
    import pyarrow as pa

    assert np.allclose(language.text_scores(net, pa.array([text, ""]))[0], total / len(data), atol=1e-5)


def test_copies_of_a_text_are_drawn_once(spark):
    rows = [(k, "the same text for ever " * 3, "en") for k in range(3000)] + [(5000 + k, f"other words {k}", f"l{k % 90}") for k in range(180)]
    windows, target, langs = language.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(langs) == 91 and (target == langs.index("en")).sum() <= 8 and len(windows) <= 8 + 8 * 180


def test_base_phrases_equal_brute_force(spark):
    rng = random.Random(11)
    parts = ["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "é", "x-y", "\n"]
    rows = [" ".join(rng.choices(parts, k=rng.randint(0, 30))) + rng.choice(["", " under the mit license. Apache License, Version 2!"]) for _ in range(200)]
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        words = "".join(c.lower() if c.isascii() else c for c in rows[r.doc_id])
        words = [w for w in "".join(c if c.isalnum() or not c.isascii() else " " for c in words).split()]
        places = sorted((k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.base_starts, r.base_labels) == (len(words), [k for k, _ in places], sorted({x for _, x in places}))


def test_long_licence_expression_is_read_once():
    import time

    began = time.perf_counter()
    postfix = licenses.to_postfix("mit OR " * 200_000 + "mit")
    assert len(postfix) == 400_001 and time.perf_counter() - began < 10  # in place of hours


def test_draws_stay_bounded():
    from framescope.llm.common import drawn_below

    assert drawn_below(1.0) == (1 << 63) - 1 == drawn_below(7.0) and drawn_below(0.0) == -(1 << 63) and drawn_below(0.5) == -1
    assert drawn_below(400 / 1e12) - -(1 << 63) == pytest.approx(400 / 1e12 * 2**64)
