"""Whole operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from flowloom.llm import ann, bpe, chat, common, dedup, licenses, packing, ppm, quality, toxicity, urls  # noqa: E402

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, key string, n long, kept string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", None, 1, "k", 2, "x") for i, t, lang in rows], DOCS)


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 80))) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        t = base[i % len(base)].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t), "en"))
    return rows + [(1000, None, None), (1001, "", "en"), (1002, " \n", "en"), (1003, "one", "en"), (1004, "ONE", "en"), (1005, "long " * 30000 + "end", "en"), (0, rows[0][1], "en"), (None, rows[0][1], "en"), (None, "alone here", "en")]


def brute_components(rows, k):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return sorted(((i, len(s), low.get(find(a))) for a, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = corpus()
    got = dedup.near_duplicates(docs_of(spark, rows), k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)
    assert dedup.near_duplicates(docs_of(spark, []), k).count() == 0


def test_blocks_link_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 4)
    rows = corpus(7, 200)
    got = dedup.near_duplicates(docs_of(spark, rows), 2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, 2)


def test_keep_one(spark):
    rows = corpus()
    # Copies without an id, of a text that no other row has; an id with two texts, one of them another's copy.
    rows += [(None, "alone again " * 9, "en")] * 3 + [(3000, "a text of its own here", "en"), (3000, rows[5][1], "en"), (3000, "a text of its own here", "en"), (None, "", "en"), (None, None, "en"), (3001, "", "en"), (3001, "", "en")]
    out = dedup.keep_one(docs_of(spark, rows), 2)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = sorted(i for i, _, c in set(brute_components(rows, 2)) if i is not None and i == c)
    got = out.collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(set(want))
    assert sorted(r["text"] or "" for r in got if r["doc_id"] is None) == ["", "", "alone again " * 9, "alone here"]
    assert [r["text"] for r in got if r["doc_id"] == 3000] == ["a text of its own here"]
    assert dedup.keep_one(docs_of(spark, []), 2).count() == 0


def shuffled(spark):
    """Bytes that stages have written for shuffles so far, by stage."""
    gate = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return {(s := stages.apply(k)).stageId(): s.shuffleWriteBytes() for k in range(stages.size())}


def test_keep_one_shuffles_only_the_texts_of_candidates(spark):
    """Also where no join may broadcast, as on large tables."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(600)), "en") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "en") for i in range(8)] + [(2000 + i, rows[i][1] + " end", "en") for i in range(4, 12)]
    docs = docs_of(spark, rows)
    before, limit = max(shuffled(spark), default=-1), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = {r["doc_id"] for r in dedup.keep_one(docs, 5).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert kept == set(range(400))
    assert sum(b for k, b in shuffled(spark).items() if k > before) < 0.5 * sum(len(t) for _, t, _ in rows)


def test_parted_rows(spark, monkeypatch):
    """No key's row is taken for another; more rows than bits only make the second part longer."""
    keys = spark.range(0, 50_000, 7).selectExpr("id AS k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    rows = spark.range(50_000).selectExpr("id", "-id AS _PART", "'x' AS _mask").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L, 'y'"))
    for most in (common.MOST_BITS, 1 << 15):
        monkeypatch.setattr(common, "MOST_BITS", most)
        none, some = common.parted(rows, "id", keys)
        assert none.columns == some.columns == rows.columns
        a, b = ([r["id"] for r in part.collect()] for part in (none, some))
        assert sorted(a + b, key=str) == sorted([*range(50_000), None], key=str) and None in b
        assert not any(i % 7 == 0 for i in a) and len(b) < (9_000 if most > 1 << 15 else 20_000)
    none, some = common.parted(rows, "id", keys.limit(0))
    assert (none.count(), some.count()) == (50_001, 0)


def test_quality(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for i in range(2000):
        good = i % 5 > 0
        w = rng.choices(words, k=40)
        rows.append((i, " ".join(w if good else [x + "###" for x in w]), "en"))
        labels.append((i, int(good), 0))
    rows += [(5000, None, None), (5001, "", "xx"), (5002, "short", "en"), (0, rows[0][1], "en")]
    docs = docs_of(spark, rows)
    known = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.judge(docs, known).collect()}
    assert all(out[i]["kept"] == (i % 5 > 0) for i in range(2000))
    assert all(out[i]["base_failed"] and not out[i]["kept"] for i in (5000, 5001, 5002))
    kept = quality.filter_quality(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}
    assert quality.choose_cutoffs(quality.measured(docs), known.limit(0)).count() == 0
    assert quality.judge(docs, known.limit(0)).where("kept").count() == sum(len((t or "").split()) >= 20 for _, t, _ in rows)
    assert quality.judge(docs.limit(0), known).count() == 0 == quality.filter_quality(docs.limit(0), known).count()


def test_quality_bounds_every_stratum(spark):
    """Three languages: one whose junk the rules catch, one whose good texts look like that junk, one of few labels."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows, labels = [], []
    for i in range(1800):
        lang, good = ("en", "de", "fr")[i % 3], i % 4 > 0
        w = rng.choices(words, k=40)
        marked = not good or (lang == "de" and i % 8 < 3)
        rows.append((i, " ".join(x + "#" if marked else x for x in w), lang))
        if lang != "fr" or i < 150:
            labels.append((i, int(good), 0))
    docs = docs_of(spark, rows)
    # Every label given three times is still one vote.
    known = spark.createDataFrame(labels * 3, "doc_id long, quality int, toxic int")
    scored = quality.measured(docs)
    by = {r["lang"]: r for r in quality.choose_cutoffs(scored, known).collect()}
    part = {r["doc_id"]: r["train"] for r in quality.votes(scored, known).collect()}
    assert len(part) == len(labels)
    for lang in ("en", "de", "fr"):
        assert by[lang]["good"] == sum(q and rows[i][2] == lang and not part[i] for i, q, _ in labels)
    assert by["en"]["symbol_ratio"] and by["en"]["rejected"] == 0 and by["en"]["bound"] <= quality.ALLOWED
    assert not any(by[lang][r] for lang in ("de", "fr") for r in quality.RULES) and by["fr"]["good"] < 59
    kept = {r["doc_id"] for r in quality.judge(docs, known).where("kept").collect()}
    assert kept == {i for i in range(1800) if i % 3 or i % 4 > 0}


def test_quality_counts_equal_a_plain_count(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choices(["a", "bé", "c#", "|", "中文", "D!"], k=rng.choice([0, 1, 3, 9, 30]))) for _ in range(rng.randint(0, 12))]
        rows.append((i, rng.choice(["\n", "\n\n", "\t", "\x85"]).join(lines), "en"))
    rows += [(900, None, None), (901, "x " * 60000 + "\u00a0y", "en")]
    for r in quality.measured(docs_of(spark, rows)).collect():
        text = rows[r["doc_id"]][1] if r["doc_id"] < 900 else {900: "", 901: rows[-1][1]}[r["doc_id"]]
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = {x for x, n in Counter(windows).items() if n > 1}
        inside = {k + j for k, x in enumerate(windows) if x in often for j in range(8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        assert tuple(r[c] for c in quality.COUNTS) == want


def test_toxicity(spark):
    rows = [(i, f"calm words here {i}. " + ("what a vile thing" if i % 3 == 0 else "nice day"), "en") for i in range(300)]
    docs = docs_of(spark, [*rows, (900, None, "en"), (901, "", "en"), (902, "so vile", None), (902, "so vile", None)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0 and r["doc_id"] < 900 or r["doc_id"] == 902) for r in out)
    assert {r["doc_id"]: r["spans"] for r in out}[902][0]["start"] == 0
    assert toxicity.filter_toxic(docs, labels).columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs, labels.limit(0)).leak == 0
    # Neither repeated rows nor repeated labels change what is learnt.
    again = toxicity.learn(docs.union(docs), labels.union(labels))
    assert again.weights == model.weights and again.leak == model.leak


def test_toxicity_finds_held_out_documents_and_their_sentences(spark):
    rng = random.Random(12)
    words, bad = [f"w{k}" for k in range(400)], ["vile", "scum", "filth", "wretch"]
    rows, labels, where = [], [], {}
    for i in range(1500):
        sentences = [" ".join(rng.choices(words, k=rng.randint(4, 15))) for _ in range(rng.randint(1, 12))]
        if i % 6 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(bad) + " " + rng.choice(words)
            where[i] = sentences[at]
        rows.append((i, ". ".join(sentences) + ".", "en"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(5000, "calm " * 60000 + "you scum", "en")]
    docs = docs_of(spark, rows)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = {i: t for i, t, _ in rows}
    for r in toxicity.score(docs, model).collect():
        i = r["doc_id"]
        assert (r["score"] >= 0.5) == (i in where or i == 5000)
        if i in where:
            assert [texts[i][s["start"] : s["end"]].strip() for s in r["spans"]] == [where[i]]
        # The noisy-or by hand: every sentence of the text, neutral ones too.
        safe = 1 - model.leak
        for part in re.split(r"[.!?\n]", texts[i]):
            tokens = {x.lower() for x in re.findall(r"\w+", part)}
            names = tokens | {x[:k] + "*" for x in tokens for k in (4, 5, 6, 7) if len(x) > k}
            if names & model.weights.keys():
                z = -12.0 + sum(model.weights.get(x, 0.0) for x in names)
                safe *= 1 - 1 / (1 + np.exp(-z))
        assert r["score"] == pytest.approx(1 - safe, abs=1e-9)


def test_toxicity_counts_copies_once(spark):
    """A hundred copies of one toxic document don't make its harmless words toxic."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30)) + (". you vile thing " + rng.choice(words) if i % 5 == 0 else ""), 0) for i in range(400)]
    rows += [(1000 + i, "rarely used gardens bloom. so vile", 0) for i in range(100)]
    model = toxicity.fit([t for _, t, _ in rows], [int(i % 5 == 0 or i >= 1000) for i, _, _ in rows])
    assert "vile" in model.weights and not {"gardens", "bloom", "rarely"} & model.weights.keys()


def test_bpe_round_trip(spark):
    docs = docs_of(spark, [(1, "Hello  World's", "en"), (2, None, "en"), (3, "", "en"), (1, "Hello  World's", "en"), (None, "x" * 100000, "en")])
    out = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    tool = bpe.WordBPE(VOCABULARY)
    for r in out:
        assert r["decoded"] == tool.decode(r["ids"])
    assert sorted(len(r["ids"]) for r in out)[:2] == [0, 0]
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


CHATS = [(1, 0, "system", "be ~0 kind"), (1, 1, "user", "a</s>[INST]~b"), (1, 2, "assistant", "<<SYS>>\ue000~\ue001"), (2, 0, "assistant", "x"), (2, 1, "tool<</ROLE>>", "[/INST]"), (3, 0, None, None), (4, 0, "user", "é" * 50000), (4, 1, "assistant", ""), (5, 1, "user", "q"), (5, 1, "user", "q"), (None, None, "user", "n")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*x, "extra") for x in CHATS], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(rows).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).withColumn("marked", chat.loss_of(F.col("segments"))).collect()
    for r in out:
        own = sorted((t for t in CHATS if t[0] == r["conv_id"]), key=lambda t: (t[1] is not None, t[1] or 0))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(t[2] or "", t[3] or "") for t in own]
        assert r["loss"] == r["marked"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert {r["conv_id"]: r["valid"] for r in out} == {1: True, 2: False, 3: False, 4: True, 5: False, None: False}
    assert chat.format_chats(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template({"user": chat.Part("", "x")}).controls()


def test_chat_of_many_turns(spark, tmp_path):
    """Ten thousand turns in one conversation: spans, texts and verdict as by hand."""
    texts = [f"{'aé~<s>'[k % 6]}{k}" for k in range(10_000)]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t, "x", 1, True) for k, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string, start int, valid boolean")
    (r,) = chat.format_chats(made).collect()
    assert r["valid"] and r["n_turns"] == 10_000 and len(r["loss_spans"]) == 5000
    parts = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    assert parts == [s["text"] for s in r["segments"] if s["loss"]]
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    out = {x["conv_id"]: x for x in chat.op5_chat(spark, str(tmp_path)).collect()}
    assert out[1]["loss_sha256"] == hashlib.sha256("".join(texts[1::2]).encode()).hexdigest()


def test_licenses(spark):
    docs = docs_of(spark, [(1, "text. Released under the MIT License. more", "en"), (2, None, "en"), (3, "nothing", "en"), (1, "text. Released under the MIT License. more", "en"), (None, "", "en"), (9, "word " * 50000 + licenses.TEMPLATES["ISC-text"], "en")])
    out = licenses.scan(docs).collect()
    assert sorted(((r["doc_id"], [(m["license_id"], m["start"], m["end"]) for m in r["matches"]]) for r in out), key=str) == [(1, [("MIT", 6, 36)])] * 2 + [(2, []), (3, []), (9, [("ISC-text", 250_000, 250_000 + len(licenses.TEMPLATES["ISC-text"]) - 1)]), (None, [])]
    assert licenses.scan(docs.limit(0)).count() == 0


PACKED = [(900, None, "en"), (901, "word " * 5000, "en"), (3, "again", "en"), (3, "again", "en"), (None, "no id", "en"), (2**60 + 1, "a large id", "en")]


def packed_by_hand(rows):
    """Pieces by the tokenizers library."""
    from tokenizers import Tokenizer

    tool, want = Tokenizer.from_file(VOCABULARY), []
    for i, t, _ in rows:
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    return sorted(want, key=str)


def sequences(out):
    """Pieces by sequence, in the order of their offsets, which leave no gap."""
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
    return [[length for _, length in sorted(b)] for b in bins.values()]


def test_packing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(0, 400))), "en") for i in range(200)] + PACKED
    out = packing.pack_documents(docs_of(spark, rows), VOCABULARY).collect()
    want = packed_by_hand(rows)
    assert sorted((tuple(r)[:5] for r in out), key=str) == want
    bins = sequences(out)
    assert all(sum(b) <= 2048 for b in bins)
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.pack_documents(docs_of(spark, []), VOCABULARY).count() == 0
    # Tighter limits hold too, each on its own, whatever the order of the groups.
    monkeypatch.setattr(packing, "GROUP", 50)
    for limits in ({"max_docs": 3}, {"max_docs": 5, "score": "dot"}, {"max_docs": None, "max_cost": None}):
        out = packing.pack_documents(docs_of(spark, rows), VOCABULARY, **limits).collect()
        assert sorted((tuple(r)[:5] for r in out), key=str) == want
        assert all(sum(b) <= 2048 and len(b) <= (limits["max_docs"] or 10**9) for b in sequences(out))


def test_op7_meets_every_constraint(spark, tmp_path):
    rows = [(i, "the cat sat " * (i % 400), "en") for i in range(300)] + PACKED
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.op7_packing(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == packed_by_hand(rows)
    for b in sequences(out):
        assert sum(b) <= 2048 and len(b) <= 2048 and sum(x * x for x in b) <= 2048**2


URLS = [(1, "HTTP://WWW.Example.COM/en/1?x#y"), (2, "http://a.example.com/en/2"), (3, "http://b.net/fr/3"), (4, "http://b.net/de/3"), (5, None), (6, "no scheme"), (7, "x://casino-farm.org/en/9"), (7, "x://casino-farm.org/en/9"), (8, "http://com/"), (9, "http://com"), (10, "a://b.org/c?u=http://x.com/en/"), (None, "http://c.net/es/" + "a/" * 20000)]


def test_urls(spark):
    out = urls.judge(spark.createDataFrame([(*p, "h", "l", 1) for p in URLS], "page_id long, url string, html string, label string, n int")).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(URLS)
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[3] == ("b.net", "/fr/3", "net/fr/", "block")
    assert got[4] == ("b.net", "/de/3", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    # No word of a host decides.
    assert got[7][2:] == (None, "allow")
    assert got[8] == ("com", "/", "com/", "allow") and got[9] == ("com", "", None, "allow")
    assert got[10][:3] == ("b.org", "/c", None)
    assert got[None][2:] == ("net/es/", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def url_verdicts(spark, rows, **options):
    """``{url: (template, verdict)}`` of ``(url, mark)`` rows."""
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, mark int")
    out = urls.judge(pages, **{"rules": (), "labels": F.col("mark")} | options).collect()
    return {rows[r["page_id"]][0]: (r["template"], r["verdict"]) for r in out}


def test_url_templates_merge_like_branches(spark):
    """Two kinds of branches with labels and two without: each kind is a cluster of its own."""
    rows = []
    for w in "abcdefgh":
        for k in range(60):
            tail = f"/{k}" if w in "abef" else f"/list/{k}/more"
            rows.append((f"http://h.org/{w}{tail}", None if w in "efgh" else int(w in "ab")))
    out = url_verdicts(spark, rows)
    assert {(u[13], *v) for u, v in out.items()} == {
        ("a", "/{a}/*", "block"), ("b", "/{a}/*", "block"), ("c", "/{c}/list/*/more", "allow"), ("d", "/{c}/list/*/more", "allow"),
        ("e", "/{e}/*", "allow"), ("f", "/{e}/*", "allow"), ("g", "/{g}/list/*/more", "allow"), ("h", "/{g}/list/*/more", "allow"),
    }


def test_urls_keep_many_sections_apart(spark):
    words = [a + b for a in "abcdefghij" for b in "abcdefghij"]
    # One host: 100 even sections, two blocked and the rest unknown. Another: one blocked, the rest allowed.
    rows = [(f"http://h.org/{w}/{k}", 1 if w in ("aa", "jj") else None) for w in words for k in range(4)]
    rows += [(f"http://i.org/{w}/{k}", int(w == "aa")) for w in words for k in range(4)]
    rows += [("http://j.org/one/1", 1), ("http://j.org/two/1", 1), ("http://j.org/six/1", None)]
    out = url_verdicts(spark, rows)
    assert {u.split("/")[2] + "/" + u.split("/")[3] for u, v in out.items() if v[1] == "block"} == {"h.org/aa", "h.org/jj", "i.org/aa", "j.org/one", "j.org/two"}


def test_urls_generalise_from_labelled_to_unlabelled_pages(spark):
    """The tree decides pages without a label: by variables with digits, by variable words, by sections, each per host."""
    names = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(f"http://shop.org/deal/{k}", 1 if k < 12 else None) for k in range(40)] + [(f"http://shop.org/help/{k}", 0 if k < 12 else None) for k in range(40)]
    rows += [(f"http://forum.org/member/{n}/links", 1 if i % 4 == 0 else None) for i, n in enumerate(names)] + [(f"http://forum.org/topic/{n}", 0 if i % 4 == 0 else None) for i, n in enumerate(names)]
    rows += [(f"http://other.org/deal/{k}", None) for k in range(40)]
    out = url_verdicts(spark, rows)
    assert {u for u, v in out.items() if v[1] == "block"} == {u for u, _ in rows if "shop.org/deal" in u or "member" in u}
    assert out["http://forum.org/member/ab/links"][0] == "/member/*/links"


def test_url_purity_leans_on_the_tree_above(spark):
    """One blocked label in an allowed section isn't enough; in a blocked section it is."""
    rows = [(f"http://h.org/good/{w}/{k}", 0) for w in ("aa", "bb", "cc") for k in range(9)] + [("http://h.org/good/new/1", 1), ("http://h.org/good/new/2", None)]
    rows += [(f"http://h.org/bad/{w}/{k}", 1) for w in ("aa", "bb", "cc") for k in range(9)] + [("http://h.org/bad/new/1", 1), ("http://h.org/bad/new/2", None)]
    out = url_verdicts(spark, rows)
    assert out["http://h.org/good/new/2"][1] == "allow" and out["http://h.org/bad/new/2"][1] == "block"


def test_url_rules_are_no_evidence_about_other_sections(spark):
    rows = [(f"http://hot.net/{w}/{k}", None) for w in ("es", "fr", "de", "en", "it") for k in range(30)]
    out = url_verdicts(spark, rows, rules=urls.RULES, labels=None)
    assert {u.split("/")[3] for u, v in out.items() if v[1] == "block"} == {"es", "fr"}


def test_urls_read_paths_to_their_end(spark):
    rows = [(f"http://h.org/a/b/c/{w}/{k}", v) for w, v in (("spam", 1), ("news", 0)) for k in range(9)] + [("http://h.org/a/b/c/news/99", None), ("http://h.org/a/b/c/spam/99", None)]
    assert set(url_verdicts(spark, rows).values()) == {("/a/b/c/spam/*", "block"), ("/a/b/c/news/*", "allow")}
    pages = spark.createDataFrame([], "page_id long, url string, mark int")
    assert urls.judge(pages, rules=(), labels=F.col("mark")).count() == 0


def test_url_sql_equals_the_tree(spark, tmp_path):
    import duckdb

    rng = random.Random(6)
    made = [f"http://{rng.choice(['a.net', 'b.example.com', 'c.org', 'www.d.net'])}/" + "/".join(rng.choice(["es", "en", "fr", "x", "y", f"p{rng.randrange(40)}", f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randint(0, 4))) for _ in range(1500)]
    rows = [r for r in URLS if r[0] is not None] + [(100 + i, u) for i, u in enumerate(made)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.sql(urls.op8_sql()).fetchall(), key=str)
    got = sorted((tuple(r) for r in urls.op8_urls(spark, str(tmp_path)).collect()), key=str)
    assert got == want and len({r[5] for r in got}) > 50 and any("{" in r[5] for r in got)


def test_lm_scores(spark):
    import math

    rows = [(i, f"the cat {i % 7} sat on THE mat", "en") for i in range(60)] + [(200, None, "en"), (201, "", "en"), (77, "again the cat", "en"), (77, "again the cat", "en"), (300, "unseen ünïcode " * 4000, "en")]
    docs = docs_of(spark, rows)
    out = ppm.score(docs, ppm.crc_mod("doc_id", 7) == 2).collect()
    assert len(out) == len(rows)
    counts, ends = {}, 0
    for i, t, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ends += 1
            for w in (t or "").encode().lower().split():
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    texts = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        base = sum(math.log10((counts.get(x, 0) + 1) / (total + kinds + 1)) for x in w) + math.log10((ends + 1) / (total + kinds + 1))
        texts.setdefault(i, (len(w) + 1, sum(x in counts for x in w) + 1, base))
    for r in out:
        n, known, base = texts[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    assert ppm.score(docs.limit(0), F.lit(False)).count() == 0
    none = ppm.score(docs_of(spark, [(1, "abc", "en")]), F.lit(True)).first()
    assert none["score"] == pytest.approx(-4 * math.log10(256), rel=1e-6) and none["n_known"] == 0


def test_chunks_do_not_change_scores(spark, monkeypatch):
    docs = docs_of(spark, [(i, f"some words {i} " * (i % 9), "en") for i in range(90)])
    held = F.col("doc_id") % 3 == 0
    whole = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in ppm.score(docs, held).collect()}
    monkeypatch.setattr(ppm, "CHUNK", 500)
    monkeypatch.setattr(ppm, "PART", 100)
    parts = {r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in ppm.score(docs, held).collect()}
    assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k], rel=1e-6) for k in whole)


def test_scores_use_five_bytes_of_context(spark, monkeypatch):
    rows = [(i, "axbcd1" if i % 2 else "aybcd2", "en") for i in range(40)] + [(100, "axbcd1", "en"), (101, "axbcd2", "en")]
    docs, held = docs_of(spark, rows), F.col("doc_id") >= 100
    whole = {r["doc_id"]: r["score"] for r in ppm.score(docs, held).collect()}
    # With the byte four places back, the last one is all but certain; with three bytes both are alike.
    assert whole[100] - whole[101] > 1
    monkeypatch.setattr(ppm, "CHUNK", 20)
    monkeypatch.setattr(ppm, "FAN", 2)
    parts = {r["doc_id"]: r["score"] for r in ppm.score(docs, held).collect()}
    assert all(parts[k] == pytest.approx(whole[k], rel=1e-6) for k in whole)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[50:90] = v[0]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(400, None, 0), (500, [0.0] * 8, 0), (501, [float("nan")] * 8, 0), (502, [None] * 8, 0), (600, [1.0, 2.0], 0), (700, [1.0, 2.5], 0), (None, rows[3][1], 0)]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "vec_id long, embedding array<float>, label int, key string, cid int")
    out = ann.nearest(table, F.col("vec_id") % 10 == 0).collect()
    m = v.astype(np.float64)
    for q in range(0, 300, 10):
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = sorted((d[i], i) for i in range(300) if i != q)[:10]
        got = [(r["score"], r["vec_id"]) for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])]
        assert [x[1] for x in got] == [x[1] for x in want]
        assert np.allclose([x[0] for x in got], [x[0] for x in want])
    assert [(r["vec_id"], r["score"]) for r in out if r["query_id"] == 600] == [(700, 0.5)]
    assert not [r for r in out if r["query_id"] in (400, 500)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def brute_recall(spark, v, monkeypatch, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(ann, name, value)
    table = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    out = ann.nearest(table, F.col("vec_id") % 25 == 0).collect()
    hits = 0
    for q in range(0, len(v), 25):
        d = ann.distances(v[q], v)
        d[q] = np.inf
        want = np.lexsort((np.arange(len(v)), d))[:10]
        got = {r["vec_id"]: r["score"] for r in out if r["query_id"] == q}
        assert len(got) == 10 and all(got[i] == d[i] for i in got)
        hits += len(set(want.tolist()) & got.keys())
    return hits / (10 * len(range(0, len(v), 25)))


def test_neighbours_over_many_blocks(spark, monkeypatch):
    """Several lists, blocks and blocks of queries: on vectors without structure, and on clustered ones."""
    rng = np.random.default_rng(9)
    plain = rng.standard_normal((1200, 24))
    assert brute_recall(spark, plain, monkeypatch, BLOCK=150, QUERIES=7) >= 0.95
    grouped = rng.standard_normal((12, 24))[rng.integers(0, 12, 1200)] * 6 + rng.standard_normal((1200, 24))
    assert brute_recall(spark, grouped, monkeypatch, BLOCK=100, QUERIES=5) >= 0.95


def test_neighbour_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16)).astype(np.float32)
    v[7] = v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (600, [0.0] * 16), (700, [float("nan")] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(tuple(r) for r in ann.op10_ann(spark, str(tmp_path)).collect()) == sorted(db.sql(ann.op10_sql()).fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        t = " ".join(rng.choices(words, k=40))
        rows.append((i, t + (" vile." if i % 9 == 0 else ""), "en"))
    rows += [(1000 + i, rows[i][1], "en") for i in range(0, 400, 10)] + [(2000, "w1", "en")]
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "toxicity", "near_dedup", "best_fit_packing"]
    got = {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()}
    assert got == {i for i in range(400) if i % 9}
    for _, f in cp.STAGES[:3]:
        assert f(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == docs.columns


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, no labels, clashing columns; and empty tables."""
    import corpus_pipeline as cp

    words = [f"w{k}" for k in range(90)]
    texts = {i: " ".join(random.Random(i).choices(words, k=40)) for i in range(20)}
    rows = [(i, t, None if i % 2 else "en") for i, t in texts.items()] + [(3, texts[3], "en"), (50, None, "en"), (51, "", None), (None, texts[4], "en"), (None, "only " + texts[5][::-1], "en"), (60, " ".join(f"x{k}" for k in range(30_000)), "en")]
    docs = docs_of(spark, rows).withColumnsRenamed({"uid": "features", "key": "_stratum", "n": "row"})
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    out = cp.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] for r in out} == {*range(20), 60, None} and sum(r["doc_id"] is None for r in out) == 1
    assert sum(r["piece"] == 0 for r in out) == 22
    stage = cp.near_dedup(spark, docs, "")
    assert stage.columns == docs.columns
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0


def test_op5_equals_hashlib(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "assistant", "ye")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in chat.op5_chat(spark, str(tmp_path)).collect()}
    assert out[1]["loss_sha256"] == hashlib.sha256(b"yoye").hexdigest() and out[1]["loss_chars"] == 4
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyo\nassistant\nye\n").hexdigest()
    assert out[-7]["turns_sha256"] == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
