"""Token counts, importance resampling and the prefix trie on small tables, against the library and brute force."""

import hashlib
import random
import re
import zlib
from math import floor, log

import pytest
from pyspark.sql import functions as F

from tidelane.llm import conversation_trie, importance_resampling, token_counts
from tidelane.llm.bpe import default_tokenizer
from tidelane.llm.checkpoints import Tables

rng = random.Random(3)
BITS = ["a", "the ", " ", "  ", "\n", "'re", "'r", "'", "ll", "Größe", "日本", "----", "123", "<|endoftext|>", "<|endo", "\t", "é", "😀", "'s", "aaaa"]
TEXTS = [None, "", " ", "one", "one", "ab" * 40_000, *("".join(rng.choice(BITS) for _ in range(rng.randint(1, 14))) for _ in range(60)), " ".join(rng.choice(BITS) for _ in range(900_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x", 0.5) for i, t in enumerate(TEXTS)]
    rows.append(rows[9])
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, `a.b` string, score double").repartition(3).cache()


def test_token_counts(docs):
    from tokenizers import Tokenizer

    count = lambda t, own=Tokenizer.from_file(default_tokenizer()): len(own.encode(t, add_special_tokens=False).ids)
    found = token_counts.count_tokens(docs, budget=7, prefixes=True)
    assert found.columns == ["doc_id", "text", "a.b", "score", "n_bytes", "n_tokens", "fit_chars", "prefix_tokens"]
    rows = found.select("*", token_counts.tokens_of_prefix(F.col("prefix_tokens"), 3).alias("three"), token_counts.longest_prefix(F.col("prefix_tokens"), 7).alias("fits")).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), count(t))
        assert r.fit_chars == r.fits and r.three == count(t[:3])
        if len(t) < 1000:
            want = [count(t[:k]) for k in range(len(t) + 1)]
            assert r.prefix_tokens == want
            assert r.fit_chars == max(k for k, n in enumerate(want) if n <= 7)
    assert token_counts.count_tokens(docs.where("false")).count() == 0


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_draw(rows, target, percent, buckets, least, seed):
    def of(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for b in of(text):
                counts[b] += 1
    gain = [floor(1000 * log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out, able = [], []
    for i, text in rows:
        f = of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 2**32)))))
        able.append(len(words(text)) >= least)
    best = sorted((k for k, ok in enumerate(able) if ok), key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0, -out[k][1]))
    rank = {k: n + 1 for n, k in enumerate(best[: percent * len(best) // 100])}
    return sorted(((*o, rank.get(k)) for k, o in enumerate(out)), key=str)


def test_importance_resampling(spark):
    vocabulary = ["".join(rng.choice("abcdeéZ") for _ in range(rng.choice([1, 3, 6, 64, 65, 90]))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, say(rng.randint(0, 40))) for i in range(60)] + [(60, None), (61, ""), (None, say(30)), (5, "5 6"), (62, say(60_000))]
    rows += [rows[3], (63, rows[3][1]), (63, rows[3][1])]
    target = [say(25), None, "", say(3)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rank int, `a.b` string").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance_resampling.resample(docs, wanted, percent=40, buckets=97, least_words=12)
    assert found.columns == ["doc_id", "text", "a.b", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    want = brute_draw(rows, target, 40, 97, 12, 7)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    # rows equal in id, score and features may swap their ranks
    assert sorted(g[4] or 0 for g in got) == sorted(w[4] or 0 for w in want)
    assert {g for g in got if g[0] != 63} == {w for w in want if w[0] != 63}
    assert importance_resampling.resample(docs.where("false"), wanted).count() == 0
    assert {r[0] for r in importance_resampling.resample(docs, wanted.where("false"), buckets=97).select("weight").distinct().collect()}


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for key, ids in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        ends = ",".join(str(c) for c in sorted(ids) if built[c] == key)
        out.append((min(ids), len(key), min(members[key[:-1]]) if key else None, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_of(spark, rows):
    tables = Tables(spark)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    found = conversation_trie.prefix_trie(*conversation_trie.branch_off(conversation_trie.ordered_turns(table, tables)), tables)
    return sorted(tuple(r) for r in found.collect())


def test_prefix_trie(spark):
    rows = [(c, rng.choice([None, t, t, 3]), rng.choice(["u", None, "a"]), rng.choice(["x", "y", "x", "", None, "zé" * 9])) for c in [*range(-2, 45), 100, 101, 150, 199, 250] for t in range(rng.randint(0, 12))]
    rows += [(None, 1, "u", "x")] * 3 + [(7, 1, "u", "x")] * 4
    rows += [(c, t, "u", "same") for c in range(300, 360) for t in range(8)]
    rows += [(400, t, "u", "long") for t in range(9000)]
    assert trie_of(spark, rows[:-9000]) == brute_trie(rows[:-9000])
    got = [r for r in trie_of(spark, rows) if r[0] == 400 and r[1] > 20]
    assert len(got) == 9000 - 20 and {r[6] for r in got} == {0} and {r[4] for r in got if r[1] < 9000} == {1}
    assert trie_of(spark, []) == []


def test_columns_of_any_name_pass_through(spark):
    from tidelane.llm import bpe, language_id, quality_classifier, quality_rules

    rows = [(1, "one two three", "x", 7, 1.0), (2, None, "y", 8, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, __letters long, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = {
        "score": quality_classifier.score(docs, quality_classifier.train(docs, none)), "kept": quality_rules.judge(docs, quality_rules.train(docs, none)), "decoded": bpe.encode_documents(docs),
        "lang_pred": language_id.identify(docs, language_id.train(docs.withColumn("lang", F.lit("en")))),
    }
    for name, found in made.items():
        assert name in found.columns and {"a.b", "__letters"} < set(found.columns)
        assert sorted((r["doc_id"], r["a.b"], r["__letters"]) for r in found.collect()) == [(1, "x", 7), (2, "y", 8)]
