"""The operators' kernels against brute force, without Spark."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from flowloom.llm import ann, bpe, dedup, licenses, packing, ppm, quality, toxicity  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    theirs, ours, rng = Tokenizer.from_file(VOCABULARY), bpe.WordBPE(VOCABULARY), random.Random(3)
    parts = ["a", "B", "'s", "'LL", "Σ", "ς", "İ", "1", "²", "\t", "\n", "\x1c", "\x85", "é", "👍🏽", "中文", "#$%", "the", "ing", "<|endoftext|>", "|", "\x00", "\ufb01"]
    texts = ["", "x" * 5000, "#%" * 3000] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    assert bpe.LibraryBPE(VOCABULARY).encode(texts[5]) == ours.encode(texts[5])


def test_pair_tree_root_is_the_minimum():
    rng = random.Random(1)
    for n in (1, 2, 3, 9, 64):
        leaves = [rng.randrange(1000) for _ in range(n)]
        tree = bpe.PairTree(list(leaves))
        for _ in range(50):
            k = rng.randrange(n)
            leaves[k] = rng.choice([bpe.NO_PAIR, rng.randrange(1000)])
            tree.put(k, leaves[k])
            assert tree.root() == min(leaves)


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    for shared in (0, 500, 800, 1000):
        a = np.unique(base[:1000])
        b = np.unique(np.concatenate([base[:shared], base[1000 : 2000 - shared]]))
        true = shared / (2000 - shared)
        equal = (dedup.registers(a) == dedup.registers(b)).mean()
        assert abs(dedup.estimate(np.array([equal]), np.array([len(a)]), np.array([len(b)]))[0] - true) < 0.12


def test_shingle_sets():
    assert len(dedup.shingle_set(b"", 2)) == len(dedup.shingle_set(b" \n\t", 2)) == 0
    assert (dedup.shingle_set(b"One two THREE", 2) == dedup.shingle_set(b"one\x0btwo  three", 2)).all()
    assert len(dedup.shingle_set(b"one", 2)) == 1
    assert len(dedup.shingle_set(b"a b a b a", 2)) == 2


@pytest.mark.parametrize("limits", [{}, {"score": "dot"}, {"max_docs": 3}, {"max_cost": 3_000_000}, {"max_docs": 2, "max_cost": 2_500_000, "score": "dot"}])
def test_best_fit_meets_every_constraint(limits):
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 1500, 3000))[::-1]
    seq, offset = packing.best_fit(lengths, 2048, **limits)
    for s in np.unique(seq):
        own = np.flatnonzero(seq == s)
        order = own[np.argsort(offset[own])]
        assert (offset[order] == np.cumsum(lengths[order]) - lengths[order]).all()
        assert lengths[own].sum() <= 2048
        assert len(own) <= limits.get("max_docs", 10**9)
        assert (lengths[own].astype(float) ** 2).sum() <= limits.get("max_cost", 1e18)
    if not limits:
        assert len(np.unique(seq)) <= 1.01 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_takes_the_best_sequence_of_all(score):
    rng = np.random.default_rng(11)
    lengths = np.sort(rng.integers(1, 300, 400))[::-1]
    caps, weights = np.array([300.0, 6.0, 50_000.0]), (1.0, 0.5, 2.0)
    seq, _ = packing.best_fit(np.where(lengths**2 > 50_000, 200, lengths), 300, 6, 50_000, score, weights)
    lengths = np.where(lengths**2 > 50_000, 200, lengths)
    free = {}
    for size, own in zip(lengths.tolist(), seq.tolist(), strict=True):
        item = np.array([size, 1.0, size**2]) / caps
        value = {b: -(weights * (f - item) ** 2).sum() if score == "norm" else (weights * f * item).sum() for b, f in free.items() if (f - item >= -1e-9).all()}
        if value:
            assert value.get(own, -np.inf) >= max(value.values()) - 1e-9
        else:
            assert own not in free
        free[own] = free.get(own, np.ones(3)) - item


def test_best_fit_edges():
    assert len(packing.best_fit(np.empty(0, np.int64), 8)[0]) == 0
    assert packing.best_fit(np.array([8, 8, 1]), 8)[0].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        packing.best_fit(np.array([9]), 8)


def test_exact_binomial_tail():
    from math import comb

    for n, k, p in ((10, 0, 0.1), (50, 3, 0.05), (7, 7, 0.3), (30, 12, 0.5)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certified_cutoffs_keep_the_bound():
    # 1000 good documents, of which the steps are the first to reject 0, 0, 1, 39; 100 bad.
    good, bad = np.array([0, 0, 1, 39, 960]), np.array([5, 55, 1, 39, 0])
    assert quality.certified(good, bad, 0.01, 0.01) == (1, 2)
    assert quality.certified(np.array([0, 0, 0, 0, 50]), bad, 0.01, 0.01) == (-1, -1)
    assert quality.certified(np.array([0, 0, 0, 0, 58]), bad, 0.05) == (-1, -1) and quality.certified(np.array([0, 0, 0, 0, 59]), bad, 0.05) == (3, 3)


def test_upper_bound_is_clopper_pearson():
    for k, n, level in ((0, 59, 0.05), (3, 50, 0.01), (7, 900, 0.0125)):
        at = quality.upper_bound(k, n, level)
        assert quality.binomial_tail(k, n, at) == pytest.approx(level, rel=1e-6)
    assert quality.upper_bound(0, 59, 0.05) == pytest.approx(1 - 0.05 ** (1 / 59)) and quality.upper_bound(4, 4, 0.05) == 1.0


def test_path_tightens_what_catches_junk():
    rules, steps = len(quality.RULES), len(quality.LADDER)
    none = [steps] * rules
    first = np.array([[5, *none[1:]], [none[0], 7, *none[2:]], none, [9, *none[1:]]])
    assert quality.learn_path(first, np.array([0, 0, 20, 1]), np.array([10, 4, 0, 0])) == [(0, 5), (1, 7)]
    assert quality.learn_path(first, np.array([0, 0, 20, 1]), np.array([10, 4, 0, 4])) == [(0, 5), (0, 9), (1, 7)]
    assert quality.learn_path(first, np.array([1, 1, 20, 1]), np.array([2, 3, 0, 0])) == []
    assert quality.learn_path(first[:0], np.empty(0, int), np.empty(0, int)) == []


def test_quality_counts():
    text = ("a b c d e f g h " * 3 + "\nx\nx\n \n#|<>").encode()
    f = quality.features(text)
    assert f[:5] == (27, 30, 4, 1, 24)
    assert quality.features(b"")[:5] == (0, 0, 0, 0, 0)


def test_noisy_or_learns_words_and_locates_sentences():
    rng = random.Random(5)
    plain = ["river", "stone", "green", "walk", "paper", "light"]
    texts, labels = [], []
    for k in range(600):
        sentences = [" ".join(rng.choices(plain, k=6)) for _ in range(5)]
        if k % 4 == 0:
            sentences[rng.randrange(5)] = "you vile " + rng.choice(plain)
        texts.append(". ".join(sentences) + ".")
        labels.append(int(k % 4 == 0))
    model = toxicity.fit(texts[:500], labels[:500])
    assert all((model.score(t)[0] >= 0.5) == bool(y) for t, y in zip(texts[500:], labels[500:], strict=True))
    score, spans = model.score("green stone. You vile paper! light.")
    assert score > 0.5
    assert [x[:2] for x in spans if x[2] >= 0.5] == [(12, 27)]
    assert model.score("")[0] == pytest.approx(model.leak) and model.leak < 0.5
    assert toxicity.fit([], []).score("x")[0] == 0


def brute_probability(tries, context, symbol):
    import math

    out, gone = 0.0, set()
    for order in (3, 2, 1, 0):
        seen = {s: n for s, n in tries[order].get(context[3 - order :], {}).items() if s not in gone}
        if not seen:
            continue
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return out + math.log10(seen[symbol] / (total + kinds))
        out += math.log10(kinds / (total + kinds))
        gone |= set(seen)
    return out - math.log10(256 - len(gone))


def test_code_lengths_equal_a_trie_and_sum_to_one():
    from collections import Counter, defaultdict

    texts = [b"abracadabra", b"banana band", b"", b"\x00\xff odd"]
    tries = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        z = b"\0\0\0" + t + b"\0"
        for k in range(3, len(z)):
            for order in range(4):
                tries[order][z[k - order : k]][z[k]] += 1
    counts = Counter(g for t in texts for g in ppm.grams([t])[0].tolist())
    first = np.zeros((256, 256))
    for g, n in counts.items():
        first[(g >> 8) & 255, g & 255] += n
    for context in (b"abr", b"xbr", b"xyr", b"xyz", b"\0\0\0"):
        own = {g: n for g, n in counts.items() if (g >> 8) & 255 == context[2]}
        for s in range(256):
            own.setdefault(int.from_bytes(context + bytes([s]), "big"), 0)
        keys = np.array(sorted(own))
        got = dict(zip(keys.tolist(), ppm.code_lengths(keys, np.array([own[k] for k in keys.tolist()]), context[2], first), strict=True))
        mine = [got[int.from_bytes(context + bytes([s]), "big")] for s in range(256)]
        assert mine == pytest.approx([brute_probability(tries, context, s) for s in range(256)])
        assert sum(10**x for x in mine) == pytest.approx(1)


def test_grams_of_texts():
    code, sizes = ppm.grams([b"ab", b""])
    assert sizes.tolist() == [3, 1]
    assert [int(c).to_bytes(4, "big") for c in code] == [b"\0\0\0a", b"\0\0ab", b"\0ab\0", b"\0\0\0\0"]
    find = ppm.lookup(np.array([5, 1 << 20, 7]), np.array([0.5, 1.5, 2.5]))
    assert find(np.array([7, 5, 1 << 20], np.uint32)).tolist() == [2.5, 0.5, 1.5]


def test_fifth_order_equals_a_trie_and_sums_to_one():
    import math
    from collections import Counter, defaultdict

    texts = [b"abracadabra", b"cadabra abracadabra", b"banana band", b"", b"\x00\xff odd"]
    seen = [defaultdict(Counter) for _ in range(6)]
    for t in texts:
        z = b"\0" * 5 + t + b"\0"
        for k in range(5, len(z)):
            for order in range(6):
                seen[order][z[k - order : k]][z[k]] += 1

    def brute(context, symbol):
        out, gone = 0.0, set()
        for order in range(5, -1, -1):
            left = {s: n for s, n in seen[order].get(context[5 - order :], {}).items() if s not in gone}
            if not left:
                continue
            if symbol in left:
                return out + math.log10(left[symbol] / (sum(left.values()) + len(left)))
            out += math.log10(len(left) / (sum(left.values()) + len(left)))
            gone |= set(left)
        return out - math.log10(256 - len(gone))

    counts = Counter(ppm.grams(texts, 5)[0].tolist())
    first = np.zeros((256, 256))
    for g, n in counts.items():
        first[(g >> 8) & 255, g & 255] += n
    contexts = [b"dabra", b"xabra", b"xxbra", b"xxxra", b"xxxxa", b"xxxxx", b"\0\0\0\0\0"]
    asked = {int.from_bytes(c + bytes([s]), "big"): (c, s) for c in contexts for s in range(256)}
    keys = np.array(sorted(asked.keys() | counts.keys()))
    got = dict(zip(keys.tolist(), ppm.code_lengths(keys, np.array([counts[k] for k in keys.tolist()]), (keys >> 8) & 255, first, 5), strict=True))
    assert [got[k] for k in asked] == pytest.approx([brute(*v) for v in asked.values()])
    for c in contexts:
        assert sum(10 ** got[k] for k, v in asked.items() if v[0] == c) == pytest.approx(1)


def test_packed_columns_come_back():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 1000))
    assert (ppm.unpacked_keys(ppm.packed_keys(keys), len(keys)) == keys).all()
    logs = np.linspace(-9, 0, 77, dtype=np.float32)
    assert (ppm.unpacked(ppm.packed(logs), 77, np.float32) == logs).all()
    find = ppm.lookup(keys, keys.astype(np.float64))
    assert (find(keys[::-1]) == keys[::-1]).all()
    with pytest.raises(KeyError):
        find(np.array([keys[0] + 1 if keys[0] + 1 not in keys else keys[0] + 2]))


def test_alignment_tolerates_gaps():
    s = licenses.Scanner({"A": "one two three four five six seven eight nine ten"})
    assert s.scan(b"zero one two THREE four five six seven eight nine ten end") == [("A", 1.0, 10, 5, 53)]
    (found,) = s.scan("é one two three x four five seven eight nine ten".encode())
    assert found[:3] == ("A", 0.9, 9) and found[3] == 2
    assert s.scan(b"one two three") == s.scan(b"") == []
    assert len(s.scan(b"one two three four five six seven eight nine ten " * 3)) == 3
    assert licenses.Scanner({}).scan(b"one two three four") == []


def test_scans_equal_an_unbanded_alignment():
    """Whole texts of licenses with words changed, left out or added: coverage and place as by aligning all against all."""
    rng, scanner = random.Random(7), licenses.Scanner(licenses.TEMPLATES)
    filler = [f"word{k}" for k in range(50)]
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        for edits in (0, 2) if len(words) > 20 else (0,):
            planted = list(words)
            for _ in range(edits):
                at = rng.randrange(2, len(planted) - 2)
                planted[at : at + 1] = rng.choice([[], ["changed"], [planted[at], "added"]])
            before, after = rng.choices(filler, k=rng.randrange(40)), rng.choices(filler, k=rng.randrange(40))
            text = " ".join([*before, "é.", *planted, "x.", *after])
            found = scanner.scan(text.encode())
            ids = [scanner.vocabulary.get(w, 0) for w in licenses.TOKEN.findall(text.encode().lower())]
            best = {}
            for t, own in enumerate(scanner.templates):
                matched, first, last = licenses.align(ids, own, 0, len(ids) + len(own))
                if matched >= (len(own) if len(own) < licenses.SHORT else 0.8 * len(own)):
                    best[scanner.names[t]] = (matched, matched / len(own))
            want = max(best, key=lambda n: (best[n], [-ord(c) for c in n]))
            assert [(f[0], f[2]) for f in found] == [(want, best[want][0])], (name, edits)
            span = text[found[0][3] : found[0][4]]
            assert name != want or edits or span.lower().strip('".') == template.lower().strip('".')


def test_short_notices_match_whole():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert scanner.scan(b"Released under the BSD License. SPDX-License-Identifier: BSD-4-Clause") == []
    assert [f[0] for f in scanner.scan(b"SPDX-License-Identifier: AGPL-3.0-only")] == ["SPDX-AGPL-3.0-only"]


def test_rotation_and_search_find_the_nearest():
    rng = np.random.default_rng(4)
    assert np.allclose(ann.rotation(16) @ ann.rotation(16).T, np.eye(16))
    v = rng.standard_normal((3000, 32))
    centre = v.mean(axis=0)
    codes, scalars = ann.encode(v, centre)
    found = ann.search(v[:40], v, codes, scalars, np.arange(3000), centre, 11)
    hits = 0
    for q, (near, d) in zip(v[:40], found, strict=True):
        exact = np.sqrt(((v - q) ** 2).sum(axis=1))
        hits += len(set(near) & set(np.argsort(exact)[:11]))
        assert np.allclose(d, exact[near])
    assert hits >= 0.97 * 440
