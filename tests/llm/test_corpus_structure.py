"""Manifest, spelling variants and toxic passages against brute force.

The fixture has null ids, texts, groups and sources, empty texts, one long
text, repeated rows, ties, and extra columns named like internal ones.
"""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import manifest, toxicity, variants
from fathom.llm.common import stored, training_fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, pos string, node string, word string, n string, segments string"


def rows():
    rng = random.Random(5)
    texts = [None, "", "Straßen straßen STRASSEN", "naïveté naivete naïvete " * 6, "harbour harbor harbours " * 9 + "harbour " * 60, "×÷ ab"]
    texts += ["".join(rng.choice("Aaabé ") for _ in range(900)) for _ in range(40)] + ["Long WORDS of one text " * 20_000]
    out = [(i, t, [None, "en", "fr", "", "en", "en"][i % 6], [None, "a", ""][i % 3], i * 7 if i % 5 else None) for i, t in enumerate(texts)]
    out += [out[4], out[4], (None, "No id", "en", "a", 1), (None, None, None, None, None), (-3, "Minus", "only", "b", 2)]
    return [(*r, "x", "y", "z", "w", "v", "u") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame(rows(), SCHEMA), "fixture").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def brute_manifest(data):
    """The definition: whole trees in memory."""
    def leaf(i, text, lang, source, n):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def way(levels, at):
        for nodes in levels[:-1]:
            first = at // 8 * 8
            yield nodes[first:at], nodes[at + 1:first + 8]
            at //= 8

    groups = defaultdict(list)
    for i, text, lang, source, n, *_ in data:
        spoilt = leaf(i, low(text), lang, source, n) if text is not None and crc(i) % 3 == 0 else None
        groups[lang].append(((i is not None, i), leaf(i, text, lang, source, n), spoilt))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    for j, g in enumerate(order):
        for k, ((_, i), node, spoilt) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            steps = [*way(trees[g], k), *way(top, j)]
            now = spoilt or node
            for before, after in steps:
                now = sha(*before, now, *after)
            yield i, node, trees[g][-1][0], top[-1][0], sha(*[x for b, a in steps for x in b + a]), now, now == top[-1][0]


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest(docs, levels):
    got = manifest.manifest(docs, tampered=training_fold("doc_id", 3, 0), block_levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_manifest(rows()))


def test_manifest_of_many_groups_and_levels(spark):
    data = [(i, f"Text {i}", f"g{i % 70}" if i % 3 else "hot", "s", i) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest.manifest(docs, tampered=training_fold("doc_id", 3, 0), block_levels=1)
    assert Counter(map(tuple, got.collect())) == Counter(brute_manifest(data))


def test_manifest_of_one_row(spark):
    docs = spark.createDataFrame([(7, "One", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    r = manifest.manifest(docs).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified


def brute_variants(data, least_n, damage):
    n = Counter()
    for i, text, *_ in data:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_n}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    forms = {}
    for w in n:
        near = [v for v in n if v != w and abs(len(v) - len(w)) <= 1 and one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = (best if near and n[best] >= 5 * n[w] else None, len(near))
    for w, (form, count) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        yield w, form, root, n[w], count, n.get(form)


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants(docs, symbols):
    got = variants.variants(docs, damage=19, least_n=2, k=symbols)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = set(brute_variants(rows(), 2, 19))
    assert set(map(tuple, got.collect())) == want and len(want) > 100 and sum(w[1] is not None for w in want) > 3


def test_variant_roots_follow_chains(spark):
    words = [("aaaaaaa", 3125), ("aaaaaab", 625), ("aaaaabb", 125), ("aaaabbb", 25), ("aaabbbb", 5), ("zzzzzz", 5), ("zzzzzy", 5)]
    docs = spark.createDataFrame([(i, f"{w} " * n) for i, (w, n) in enumerate(words)], "doc_id long, text string")
    got = {r.word: r for r in variants.variants(docs).collect()}
    assert {got[w].root for w, _ in words[:5]} == {"aaaaaaa"} and got["aaabbbb"].form == "aaaabbb"
    assert got["zzzzzz"].form is None and got["zzzzzz"].root == "zzzzzz" and got["zzzzzz"].n_near == 1


def test_neighbourhoods_are_full_and_distinct():
    rng = np.random.default_rng(2)
    for n in (1, 2, 6, 30):
        s = rng.integers(1, 4, (4, n)).astype(np.uint64)
        row, key = variants.neighbourhoods(s, 3)
        for i in range(4):
            w = tuple(s[i].tolist())
            want = {w} | {w[:j] + w[j + 1:] for j in range(n)} | {w[:j] + (x,) + w[j + 1:] for j in range(n) for x in (1, 2, 3)}
            want |= {w[:j] + (x,) + w[j:] for j in range(n + 1) for x in (1, 2, 3)}
            keys = {int(variants.reduced_keys(np.array([v], np.uint64).reshape(1, -1))[0]) for v in want}
            assert sorted(key[row == i].tolist()) == sorted(keys)


def brute_segments(s):
    """Recursive definition: the best segment (shortest of equal ones), then what is left and right of it."""
    def go(a, b):
        best = max(((sum(s[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return go(a, i) + [(i, j, best[0])] + go(j, b)
    return go(0, len(s))


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = rng.integers(-5, 5, rng.integers(0, 25)).astype(float) + rng.random() / 7
        got = toxicity.maximal_segments(s)
        want = brute_segments(s.tolist())
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_maximal_segments_are_linear():
    s = np.tile([1.0, -0.5, -0.6], 400_000)
    assert len(toxicity.maximal_segments(s)) == 400_000
    assert len(toxicity.maximal_segments(np.tile([1.0, -0.5], 400_000))) == 1


def test_decay_solves_its_equation():
    score, n = np.array([2.0, -1.0, 0.5]), np.array([1, 20, 3])
    x = toxicity.decay(score, n)
    assert abs((n * np.exp(x * score)).sum() / n.sum() - 1) < 1e-9 and x > 0
    assert toxicity.decay(np.array([-1.0]), np.array([5])) == 1.0 == toxicity.decay(np.array([1.0]), np.array([5]))


def corpus():
    rng = random.Random(11)
    usual = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    bad = ["vile", "rotten", "wretch"]
    out, labels = [], []
    for i in range(600):
        words = [rng.choice(usual) for _ in range(rng.randint(20, 90))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad).upper() if rng.random() < 0.3 else rng.choice(bad) for _ in range(3)]
        out.append((i, " ".join(words), "x"))
        if i % 4:
            labels.append((i, int(toxic)))
    out += [(1000, None, "x"), (1001, "", "x"), (1002, "12 !!", "x"), (None, "vile rotten wretch", "x"), (0, out[0][1], "x"), (1003, "é wordaa " * 50_000, "x")]
    return out, [*labels, (1, 0), (1, 1), (None, 1), (7, None)]


def test_toxicity(spark):
    data, labels = corpus()
    docs = spark.createDataFrame(data, "doc_id long, text string, segments string")
    found = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, found))
    assert got.columns == ["doc_id", "score", "predicted", "n_tokens", "passages"]
    out = got.collect()
    assert len(out) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    text = dict((i, t) for i, t, _ in data)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 600 and crc(r.doc_id) % 5 == 0]
    assert len(held) > 80 and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    for r in held:
        if r.predicted:
            words = " ".join(text[r.doc_id][p.start:p.end] for p in r.passages).lower().split()
            assert sum(w in ("vile", "rotten", "wretch") for w in words) == 3 and len(words) <= 6
        else:
            assert not r.passages
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert by[1000][0].score == by[1001][0].score == by[1002][0].score < 0.5 and by[1000][0].n_tokens == 0
    assert by[None][0].predicted == 1 and by[0][0].score == by[0][1].score and by[1003][0].n_tokens == 100_000


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id long, text string")
    for labels, score in (([], 0.001), ([(i, 0) for i in range(9)], 0.001), ([(i, 1) for i in range(9)], 0.999)):
        got = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert len(got) == 9 and all(abs(r.score - score) < 1e-9 and r.passages == [] for r in got)


def test_empty_tables(empty, spark):
    assert manifest.manifest(empty).count() == 0 == variants.variants(empty).count()
    model = toxicity.train(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0
    null = empty.sparkSession.createDataFrame([(None,) * len(empty.columns)], SCHEMA)
    assert manifest.manifest(null).where("verified").count() == 1 and variants.variants(null).count() == 0
    assert toxicity.score(null, model).where(F.col("predicted") == 0).count() == 1
