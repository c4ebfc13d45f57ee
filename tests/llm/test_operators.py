"""The corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelane.llm import bpe, decontaminate, language_id, license_scan, minhash, quality_classifier, quality_rules, suffix_dedup, suffix_tree_lm, url_filter
from tidelane.llm.bytetext import utf8_block
from tidelane.llm.suffix_array import suffix_array

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(400)]
say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
PASSAGE, LONG = say(60), say(3000)
BASE = say(80)
NEAR = BASE.replace(BASE.split(" ")[40], "changed", 1)
TEXTS = [None, "", "one", "one", BASE, NEAR, BASE, say(30) + " " + PASSAGE + " " + say(9), say(12) + " " + PASSAGE, LONG, LONG + " tail", "Größe ñandú " + say(20), say(50), "Released under the MIT License. " + say(5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, -1.0, "x") for i, t in enumerate(TEXTS)]
    rows.append(rows[4])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept string").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, limit=85):
    ids, sets = [r[0] for r in rows], [shingles(r[1]) for r in rows]
    root = dict(zip(ids, ids, strict=True))
    for _ in ids:
        for a, x in zip(ids, sets, strict=True):
            for b, y in zip(ids, sets, strict=True):
                if x and y and 100 * len(x & y) >= limit * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in zip(ids, sets, strict=True)}


def test_near_dedup(spark, docs, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute_components(list(enumerate(TEXTS)))
    assert minhash.near_duplicates(docs).count() == len(TEXTS) + 1
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_dedup_chains_and_tiles(spark):
    base = say(120).split(" ")
    rows, own = [], base
    for i in range(60):
        own = list(own)
        own[rng.randrange(len(own))] = f"edit{i}"
        rows.append((i, " ".join(own)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=7)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)


def brute_removed(rows, n=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                cover[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        out[i] = (len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(docs, nothing, hot):
    found = suffix_dedup.suffix_dedup(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert len(found) == len(TEXTS) + 1
    assert {r[0]: tuple(r)[1:] for r in found} == brute_removed(list(enumerate(TEXTS)))
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


def test_suffix_array():
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(4)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        suffix = lambda p: strings[(r := int(np.searchsorted(bounds, p, "right") - 1))][p - bounds[r] :]  # noqa: E731, B023
        order = suffix_array(np.frombuffer(b"".join(strings), np.uint8), bounds).tolist()
        assert order == sorted(range(int(bounds[-1])), key=lambda p: (suffix(p), p))


def test_lm_score(docs, nothing):
    held = F.col("doc_id") % 5 == 0
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    tokens = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] + [None]
    counts = Counter(x for i, t in rows if i % 5 for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for r in suffix_tree_lm.score_corpus(docs, held).collect():
        own = tokens(TEXTS[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(counts[x] > 0 for x in own), n, r.doc_id % 5 == 0)
        assert abs(r.base_score - sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)) < 1e-6
        assert r.score < 0
    assert suffix_tree_lm.score_corpus(nothing, held).count() == 0


def test_lm_states_grow_with_the_corpus(spark):
    """A context that is rare in the whole corpus, but often enough seen, scores as the definition says, whatever the buckets."""
    DEPTH = suffix_tree_lm.DEPTH
    strange = "zqzq vyvy xwxw zuzu"
    rows = [(i, say(120)) for i in range(500)] + [(1000 + i, strange) for i in range(40)] + [(2000, strange + " " + say(20)), (2001, say(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") >= 2000
    symbols = lambda t: b"".join(w.encode() + b" " for w in t.split(" ")) + b"\n"
    grams = Counter()
    for i, t in rows:
        for k in range(len(s := symbols(t))) if i < 2000 else ():
            grams.update((s[j:k] if j >= 0 else b"\n" + s[:k], s[k]) for j in range(max(k - DEPTH, -1 if k < DEPTH else 0), k + 1))
    total = Counter()
    for (context, _), n in grams.items():
        total[context] += n
    after = {}
    for (context, symbol), n in grams.items():
        after.setdefault(context, []).append((symbol, n))
    gain = lambda c: sum(n * np.log(n / total[c] / (grams[c[1:], x] / total[c[1:]])) for x, n in after[c])
    states = {c for c in total if len(c) <= suffix_tree_lm.SHALLOW}
    for c in total:
        if len(c) > suffix_tree_lm.SHALLOW and total[c] >= suffix_tree_lm.MIN_COUNT and gain(c) >= suffix_tree_lm.MIN_GAIN:
            states |= {c[k:] for k in range(len(c))}

    def p(c, x):
        if not c:
            return (grams[c, x] + 0.1) / (total[c] + 25.6)
        return (grams[c, x] + suffix_tree_lm.PARENT * p(c[1:], x)) / (total[c] + suffix_tree_lm.PARENT)

    def longest(before):
        for c in (before[k:] for k in range(max(len(before) - DEPTH, 0), len(before) + 1)):
            if c in states and all(c[k:] in states for k in range(len(c) + 1)):
                return c

    rare = [c for c in states if len(c) > 2 and total[c] < 2e-4 * total[b""]]
    assert any(b"zq" in c for c in rare) and max(map(len, states)) > 4
    for buckets in (1, 5):
        got = {r.doc_id: r.score for r in suffix_tree_lm.score_corpus(docs, held, buckets=buckets).collect()}
        for i, t in rows[-3:]:
            s = symbols(t)
            want = sum(log10(p(longest(b"\n" + s[:k]), s[k])) for k in range(len(s)))
            assert abs(got[i] - want) < 1e-3


def test_bpe_equals_library(docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    for r in bpe.encode_documents(docs).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(nothing).count() == 0


def test_decontaminate(spark, docs, nothing):
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split(" ")[5:40])), (2, "one"), (3, None), (4, say(20))], "item_id int, text string")
    found = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert found[7]["items"] == ["1"] and found[7].n_hit == 35 and found[2]["items"] == ["2"] and found[0].n_words == 0 and found[9].n_hit == 0
    assert decontaminate.decontaminate(nothing, bench).count() == 0 and decontaminate.decontaminate(docs, bench.where("false")).where("n_hit > 0").count() == 0


def brute_hits(text, items, n=10):
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    own, hit, found = words(text), set(), set()
    for name, t in items:
        w = words(t)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            g = w[s : s + n]
            for p in range(len(own) - len(g) + 1):
                if own[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    if name is not None:
                        found.add(str(name))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("most", [decontaminate.SHARED_BYTES, 1])
def test_decontaminate_in_passes(spark, docs, most):
    cut = PASSAGE.split(" ")
    items = [(1, " ".join(cut[5:40])), (2, "one"), (3, None), (4, " ".join(cut[30:55])), (None, " ".join(cut[50:])), (10, " ".join(cut[38:52])), (2, "one")]
    bench = spark.createDataFrame(items, "item_id int, text string").repartition(3)
    found = decontaminate.decontaminate(docs, bench, limit=20, most=most).collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(TEXTS[r.doc_id], items)


def test_counts_of_quality_rules(docs):
    """The five counts and the base verdict against the definition."""
    forest = quality_rules.Forest(base=9.0)
    for r in quality_rules.judge(docs.where("doc_id NOT IN (9, 10)"), forest).collect() + quality_rules.judge(docs.sparkSession.createDataFrame([(-1, "a b\n\na b\n #x| a b c d e f g h a b c d e f g h i\n \na b"), (-2, "é ü\té #*$%&|<>\n" * 3)], "doc_id long, text string"), forest).collect():
        text = TEXTS[r.doc_id] if r.doc_id >= 0 else {-1: "a b\n\na b\n #x| a b c d e f g h a b c d e f g h i\n \na b", -2: "é ü\té #*$%&|<>\n" * 3}[r.doc_id]
        text = text or ""
        split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        words, seen, dup = split(text), set(), 0
        for line in text.split("\n"):
            dup += bool(split(line)) and line in seen
            seen.add(line)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside))
        assert r.base_failed == failed and r.kept == (not failed)


def test_forest_is_monotonic_where_asked():
    draw = np.random.default_rng(3)
    x = draw.uniform(size=(400, 2))
    y = ((x[:, 0] + 0.3 * draw.normal(size=400) < 0.5) ^ (draw.uniform(size=400) < 0.1)).astype(int)
    forest = quality_rules.fit(x, y, [-1, 0])
    grid = np.linspace(0, 1, 50)
    for other in (0.1, 0.5, 0.9):
        p = forest.probability(np.column_stack([grid, np.full(50, other)]))
        assert (np.diff(p) <= 1e-12).all() and p[0] > 0.5 > p[-1]


def test_classifier_scores_by_its_definition():
    """The folded score is the softmax over the mean of the vectors of all features."""
    draw = np.random.default_rng(5)
    model = quality_classifier.Classifier(draw.normal(size=quality_classifier.BUCKETS).astype(np.float32), 0.25)
    block = utf8_block(pa.array(["one two two", None, "x"]))
    f = quality_classifier.features(block)
    for i, p in enumerate(model.score(block)):
        own = [b for w in f.inverse[f.row_bounds[i] : f.row_bounds[i + 1]] for b in f.bucket[f.bounds[w] : f.bounds[w + 1]]] + [b for b in f.pair[f.row_bounds[i] : f.row_bounds[i + 1]] if b >= 0]
        odds = 0.25 + (np.mean(model.gain[own].astype(np.float64)) if own else 0)
        assert abs(p - 1 / (1 + np.exp(-odds))) < 1e-6


def test_language_posterior_and_text_ids(spark):
    """A text's posterior is the product of its words' sums over all segmentations; ids may be text or null."""
    trie = language_id.Trie.of([b"a", b"b", b"ab", b"\0", b"\0a"])
    w = np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 0.2], [0.25, 0.2], [0.15, 0.2]])
    word = lambda t, j: sum(np.prod([w[[b"a", b"b", b"ab", b"\0", b"\0a"].index(c), j] for c in cut]) for cut in {"ab": [(b"\0", b"a", b"b"), (b"\0", b"ab"), (b"\0a", b"b")], "a": [(b"\0", b"a"), (b"\0a",)]}[t])
    got = language_id.Model(["x", "y"], w, trie).posterior(utf8_block(pa.array(["ab a", "a"])))
    for row, own in zip(got, (["ab", "a"], ["a"]), strict=True):
        p = np.array([np.prod([word(t, j) for t in own]) for j in (0, 1)])
        assert np.allclose(row, p / p.sum())
    rows = spark.createDataFrame([("k1", "the and", "en", 1), ("k2", "les eau", "fr", 0), (None, "the", "en", None)], "doc_id string, text string, lang string, quality int")
    assert language_id.identify(rows, language_id.train(rows)).count() == 3
    assert quality_classifier.score(rows, quality_classifier.train(rows, rows.select("doc_id", "quality"))).count() == 3
    assert quality_rules.judge(rows, quality_rules.train(rows, rows.select("doc_id", "quality"))).count() == 3


def test_language_id(spark, docs, nothing):
    train = spark.createDataFrame([(i, " ".join(rng.choice(w) for _ in range(30)), k) for i in range(60) for k, w in (("en", ["the", "and", "with"]), ("fr", ["les", "eau", "dans"]))], "doc_id long, text string, lang string")
    model = language_id.train(train)
    asked = spark.createDataFrame([(1, "the and"), (2, "dans les eau"), (3, None), (4, "12 34"), (5, "the" * 500)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(asked, model).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("en", "fr", "und", "und") and got[5] in ("en", "fr")
    assert language_id.identify(docs, language_id.train(docs.where("false"))).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(nothing, model).count() == 0


def test_forward_sums_all_segmentations():
    trie = language_id.Trie.of([b"a", b"b", b"ab", b"\0", b"\0a"])
    w = np.array([[0.1], [0.2], [0.3], [0.25], [0.15]])
    data = np.frombuffer(b" ab", np.uint8)
    got = np.exp(language_id.Model(["x"], w, trie).words(data, np.array([1]), np.array([3])))[0, 0]
    assert abs(got - (0.25 * 0.1 * 0.2 + 0.25 * 0.3 + 0.15 * 0.2)) < 1e-12


def test_words_of_any_length_are_summed_over_all_segmentations(monkeypatch):
    """Words of up to 3000 bytes, some with a byte that no piece has, against a plain forward pass; stretches change nothing."""
    pieces = [b"\0", b"a", b"b", b"c", b"ab", b"abc", b"\0a", b"bcab", b"aaaaaa"]
    model = language_id.Model(["x", "y"], np.random.default_rng(5).dirichlet(np.ones(len(pieces)), 2).T * 1e-3, language_id.Trie.of(pieces))
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 2, 30, 63, 64, 65, 97, 128, 129, 500, 501, 3000)]
    words += [b"ab" * 40, b"abcab" * 100]

    def plain(word: bytes) -> np.ndarray:
        sums = np.full((len(word) + 1, 2), -np.inf)
        sums[0] = 0
        for end in range(1, len(word) + 1):
            for i, piece in enumerate(pieces):
                if word[:end].endswith(piece):
                    sums[end] = np.logaddexp(sums[end], sums[end - len(piece)] + np.log(model.weight[i]))
        return sums[-1]

    data = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size
    asked = [plain(b"\0" + w) for w in words]
    for stretch in (language_id.STRETCH, 100, 7):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        assert np.allclose(model.words(data, start, start + size), asked)
    broken = np.frombuffer(b" " + b"ab" * 60 + b"z" + b"ab" * 60, np.uint8)
    assert np.allclose(model.words(broken, np.array([1]), np.array([len(broken)])), np.log(1e-300))


def test_license_scan(docs, nothing):
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert (found[13].n_base, found[13].first_word, found[13].base_labels, found[13].labels, found[13].score) == (1, 3, "mit", "mit", 1.0)
    assert found[0].n_words == 0 and found[0].labels == "" and len(found) == len(TEXTS)
    assert license_scan.scan_licenses(nothing).count() == 0


def test_license_scan_of_neighbouring_names_and_long_notices(spark):
    long = license_scan.NOTICES[8][1].split(" ")
    inserted = " ".join([*long[:20], "really", *long[20:]])
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0", "licensed under cc by 4.0", "Licensed under the Apache License", " ".join(long), inserted, " ".join(long[:30]), inserted + " mit license", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[0]), (None, texts[0])]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == len(rows)
    labels = {r.doc_id: r["labels"] for r in found}
    assert labels == {0: "cc by nc", 1: "cc by sa", 2: "cc by", 3: "apache", 4: "mit", 5: "mit", 6: "", 7: "mit", 8: "", None: "cc by nc"}
    spans = {r.doc_id: [(x["label"], x["first_word"], x["n_words"]) for x in r.spans] for r in found}
    assert spans[4] == [("mit", 0, len(long))] and spans[5] == [("mit", 0, len(long))] and {r.doc_id: r.n_base for r in found}[7] == 1


def test_url_filter(spark):
    urls = ["http://example.com/en/x?y", "https://WWW.example.com/en/", "http://a.net/es/1", "http://a.net/de/", "nonsense", None, "http://example.com", "http://notexample.com/en/", "http://example.com/en"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {0: ("example.com/en/", "block"), 1: ("www.example.com/en/", "allow"), 2: ("net/es/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("com/", "allow"), 8: ("com/", "allow")}
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0 and url_filter.judge_urls(pages, rules.where("false")).where("rule IS NULL").count() == len(urls)


def test_quality_models(spark, docs, nothing):
    rows = [(i, say(60) if i % 2 else " ".join(x + "$$$" for x in say(60).split(" ")), i % 2) for i in range(120)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = texts.select("doc_id", "quality")
    model = quality_classifier.train(texts, labels)
    judged = {r.doc_id: r.predicted for r in quality_classifier.score(texts, model).collect()}
    assert sum(judged[i] == i % 2 for i in range(120)) >= 110
    assert quality_classifier.score(docs, model).where("score BETWEEN 0 AND 1").count() == len(TEXTS) + 1
    forest = quality_rules.train(texts, labels)
    kept = {r.doc_id: r for r in quality_rules.judge(texts, forest).collect()}
    assert sum(kept[i].kept == bool(i % 2) for i in range(120)) >= 110
    assert quality_rules.judge(docs, forest).where("doc_id < 4 AND kept").count() == 0 and quality_rules.judge(nothing, forest).count() == 0
    assert quality_classifier.score(nothing, quality_classifier.train(texts, labels.where("false"))).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language_id.op6_language_id(spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got if r.lang_pred != "und"]) > 0.95
