import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from landsift.llm import bpe, chat_format, components, exact_dedup, mixing, near_dedup, quality, queries, recurrent_lm, topk, url_filter, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def sentences(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.execute(queries.oracle_sql()[name]).fetchdf()[list(got.columns)]
    rows = lambda d: sorted(map(str, d.astype(str).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


# 1 ---------------------------------------------------------------------------------------------------------------
def brute_top(rows, asked, k):
    """Every row that is asked for against every other row, in Python's integers."""
    out = []
    for n, (q, own) in enumerate(rows):
        if asked(q):
            scores = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=False)))), i) for m, (i, v) in enumerate(rows) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(i % 7, 1) for _ in range(6)]) for i in range(600)]
    vectors += [(i, vectors[3][1]) for i in range(600, 900)]  # copies and ties
    vectors += [(5, vectors[5][1]), (5, vectors[6][1]), (200, vectors[200][1]), (200, vectors[9][1]), (1100, []), (7, []), (1400, [200000.0, 1.0]), (1500, [0.0, -3e5, 2.0])]
    rows = [(i, v, "x") for i, v in vectors] + [(1000, None, ""), (1200, [1.0, None], ""), (1300, [float("nan")], ""), (1301, [float("inf")], ""), (None, [1.0] * 6, "")]
    schema = "vec_id long, embedding array<double>, score string"
    df = spark.createDataFrame(rows, schema)
    want = brute_top([(i, [math.floor(1024 * x) for x in v]) for i, v in vectors], lambda i: i % 100 == 0, 10)
    for shard_rows in (100, 10_000):
        got = topk.top_k(df, lambda c: c % 100 == 0, shard_rows=shard_rows).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.top_k(df.filter("false"), lambda c: c % 100 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id in (100, 7)"), lambda c: c % 100 == 0).count() == 2


def test_top_k_beyond_float(spark):
    """Components whose products float64 can't hold exactly, next to small ones."""
    rng = random.Random(6)
    vectors = [(i, [float(rng.choice([1, 3, 2**28 + 1, 2**29 + 7])) * rng.choice([-1, 1]) for _ in range(4)]) for i in range(0, 60)] + [(100, [2.0**33 + 1, 1.0]), (101, [-(2.0**33), 5.0]), (102, [1e18, 1.0]), (200, [1.5] * 4)]
    want = brute_top([(i, [math.floor(1024 * x) for x in v]) for i, v in vectors], lambda i: i % 100 == 0, 10)
    for shard_rows in (7, 10_000):
        got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), lambda c: c % 100 == 0, shard_rows=shard_rows).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


# 2 ---------------------------------------------------------------------------------------------------------------
def test_language_model(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the cat sat.", "a dog ran,", "der Hund lief.", f"rare{i}"]) for _ in range(rng.randint(1, 40)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "É x\x1cy\xa0z THE"), (903, LONG), (None, "the cat"), (7, rows[7][1])]
    got = recurrent_lm.score_documents(docs(spark, rows), task_tokens=20_000).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    toks = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", toks(t)), ""]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = words(t)
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    out = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert recurrent_lm.score_documents(docs(spark, [])).count() == 0


def test_every_training_document_is_learnt_from(spark):
    """The documents that the rounds' jobs read, by their plans' filters, are all training documents."""
    import inspect

    default = {k: v.default for k, v in inspect.signature(recurrent_lm.score_documents).parameters.items()}
    rows = docs(spark, [(i, f"word{i} again") for i in range(300)]).select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(None, "none")], "id long, text string"))
    lex = recurrent_lm.build_lexicon(recurrent_lm.count_tokens(rows))
    read = set()

    class Noted:
        sparkSession = spark

        def filter(self, condition):
            read.update(r["id"] for r in rows.filter(condition).collect())
            return rows.filter(condition)

    recurrent_lm.train(Noted(), lex, spark.sparkContext.broadcast(lex), default["rounds"], default["slices"], 10, 0.08)
    assert read == {i for i in [*range(300), None] if not recurrent_lm.is_held_out(i)}


def test_texts_are_coded_once_for_learning_and_scoring(spark):
    """What is learnt from the codes is what is learnt from the texts; codes, rows and unknown words are held."""
    rng = random.Random(5)
    texts = [None, "", "One TWO one \u00e9", *(" ".join(f"w{rng.randint(0, 40)}" for _ in range(60)) for _ in range(80))]
    rows = docs(spark, list(enumerate(texts))).select(F.col("doc_id").alias("id"), "text").coalesce(1)
    lex = recurrent_lm.build_lexicon(recurrent_lm.count_tokens(rows.filter("id > 2")))
    shared = spark.sparkContext.broadcast(lex)
    table = recurrent_lm.coded(rows, shared)
    got, known = {r["id"]: r for r in table.collect()}, recurrent_lm.Words(lex.words)
    assert len({r["row"] for r in got.values()}) == len(texts)
    for i, text in enumerate(texts):
        words = recurrent_lm.tokens(text)
        assert np.frombuffer(got[i]["codes"], np.int32).tolist() == [known[w] for w in words]
        assert [bytes(w) for w in got[i]["tail"]] == [w for w in words if known[w] < 0]
    one, other = (recurrent_lm.train(d, lex, shared, 1, 1, 10**9, 0.3) for d in (rows, table.select("id", "codes")))
    assert all(np.array_equal(one[k], other[k]) for k in one) and not np.array_equal(one["wo"], recurrent_lm.start_weights(lex)["wo"])


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """Counts and codes come of the same parts, whatever their size, and looks are the same by word and by array."""
    words = [b"", b"a", b"abcde", b"abcdef.", b"abcdefghi,", b"\xc3\xa9t\xc3\xa9!", b'"', "\u00e9".encode() * 40, b"x" * 70 + b"-", b"\x7f"]
    names = pa.array([b"left out", *map(recurrent_lm.named, words)], pa.binary())[1:]
    assert recurrent_lm.surfaces(names).tolist() == [recurrent_lm.surface(recurrent_lm.named(w)) for w in words]
    assert recurrent_lm.surfaces(pa.array([], pa.binary())).tolist() == []
    texts = [None, "", *(f"One w{i % 7} \u00e9{i} " + "y" * 70 for i in range(60))]
    rows = docs(spark, [*enumerate(texts), (None, "one")]).select(F.col("doc_id").alias("id"), "text").coalesce(1)
    want = Counter(recurrent_lm.named(w) for i, t in [*enumerate(texts), (None, "one")] if not recurrent_lm.is_held_out(i) for w in recurrent_lm.tokens(t))
    monkeypatch.setattr(recurrent_lm, "by_size", lambda batches, column, *_, cut=recurrent_lm.by_size: cut(batches, column, 10))
    for size, rows_ in ((1, 7), (10**6, 1)):
        monkeypatch.setattr(recurrent_lm, "PART", size)
        parts = recurrent_lm.cut(recurrent_lm.split(rows))
        assert parts.count() == rows_
        assert {bytes(r["token"]): r["c"] for r in recurrent_lm.counted(parts).collect()} == want
        lex = recurrent_lm.build_lexicon(recurrent_lm.counted(parts))
        got, known = recurrent_lm.recoded(parts, spark.sparkContext.broadcast(lex)).collect(), recurrent_lm.Words(lex.words)
        assert {r["id"]: np.frombuffer(r["codes"], np.int32).tolist() for r in got} == {i: [known[w] for w in recurrent_lm.tokens(t)] for i, t in [*enumerate(texts), (None, "one")]}


def test_language_model_beats_its_base_by_a_tenth(spark):
    """Held-out log10 a token on the 1,000 documents of sf0.01, each training document learnt from once."""
    got = recurrent_lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] >= 0.1


def test_probabilities_sum_to_one_and_gradients():
    words = [f"w{i}".encode() for i in range(50)]
    counts = np.arange(100, 50, -1.0)
    totals = np.zeros(recurrent_lm.SURFACE)
    for w, c in zip([*words, recurrent_lm.END, b"tail."], [*counts, 20, 3], strict=True):
        totals[recurrent_lm.surface(w)] += c + 0.5
    lex = recurrent_lm.Lexicon([*words, recurrent_lm.END], np.append(counts, 20.0), totals, 1.0, 1.0)
    w = recurrent_lm.start_weights(lex)
    rng = np.random.default_rng(0)
    w = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in w.items()}
    hs = rng.normal(0, 1, (1, recurrent_lm.HIDDEN)).astype(np.float32)
    heads = np.arange(lex.head)
    p = np.exp(recurrent_lm.log_probs(w, lex, np.repeat(hs, lex.head, 0), lex.class_of[heads], heads)[0]).sum()
    rest = np.arange(len(lex.edges), len(lex.mass))
    p += np.exp(recurrent_lm.log_probs(w, lex, np.repeat(hs, len(rest), 0), rest, np.full(len(rest), -1))[0]).sum()
    assert abs(p - 1) < 1e-5
    one = recurrent_lm.Trainer(lex, {k: v.copy() for k, v in w.items()}, 0.0)
    one.nominal, seen = 1, {}
    one._step = lambda name, at, g: seen.update({name: (at, g)})
    ids = rng.integers(0, 50, (6, 3))
    begin = np.zeros((6, 3), bool)
    begin[3, 1] = True
    h = rng.normal(0, 1, (3, recurrent_lm.HIDDEN)).astype(np.float32)
    one.window(ids, np.roll(ids, -1, 0), np.ones((6, 3), bool), begin, h)

    def loss(x):
        states = recurrent_lm.forward(x, recurrent_lm.split_codes(lex, ids)[1], begin, h)[0]
        t = np.roll(ids, -1, 0).ravel()
        return -recurrent_lm.log_probs(x, lex, states.reshape(-1, recurrent_lm.HIDDEN), lex.class_of[t], t)[0].sum()

    for name, at in (("u", (2, 5)), ("u", (3, 40)), ("b", (7,)), ("wc", (1, 2)), ("wo", (4, 3))):
        big = {k: v.astype(np.float64) for k, v in w.items()}
        up, down = ({**w, name: big[name].copy()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        numeric = (loss(up) - loss(down)) / 2e-2
        assert abs(numeric - seen[name][1][at]) < 2e-2 * max(1, abs(numeric))


def test_long_lanes_score_like_single_documents():
    words = [f"w{i}".encode() for i in range(30)]
    lex = recurrent_lm.Lexicon([*words, recurrent_lm.END], np.ones(31), np.full(recurrent_lm.SURFACE, 40.0), 31.0, 31.0)
    w = recurrent_lm.start_weights(lex)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 31, n).astype(np.int32) for n in (1, 5, 300, 40, 2, 77)]
    both = recurrent_lm.score_codes(lex, w, texts, 30, lanes=2, size=7)
    assert np.allclose(both, [recurrent_lm.score_codes(lex, w, [t], 30)[0] for t in texts], atol=1e-3)


# 3 ---------------------------------------------------------------------------------------------------------------
def test_url_filter(spark):
    urls = {1: "http://a.Example.com/en/7198#x", 2: "https://example.com/en/6?q=1", 3: "http://b.net/de/81", 4: "x://sub.example.net/de/8/9", 5: "ftp://site.org/es/", 6: "http://com/en/", 7: "http://xcom/en/", 8: None, 9: "no scheme", 10: "http://HOST.org?x/es/", 11: "http://é.org/es/1", 12: "", 13: "http://a.com/EN/1", 14: "http://a.com" + "/x" * 20_000, 15: "://net/de/"}
    df = spark.createDataFrame([(i, u, "h") for i, u in urls.items()] + [(1, urls[1], "h")], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert {i: (r["host"], r["rule"], r["verdict"]) for i, r in got.items() if r["rule"]} == {1: ("a.example.com", "example.com/en/7", "allow"), 2: ("example.com", "com/en/", "block"), 3: ("b.net", "net/de/", "block"), 4: ("sub.example.net", "example.net/de/8", "block"), 5: ("site.org", "org/es/", "block"), 6: ("com", "com/en/", "block"), 11: ("é.org", "org/es/", "block"), 15: ("net", "net/de/", "block")}
    assert got[8]["host"] == got[8]["path"] == got[9]["host"] == "" and got[10]["host"] == "host.org" and got[10]["path"] == ""
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(df.filter("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df.filter("page_id in (8, 9)")).collect()} == {"allow"}


def test_url_rules_as_the_contract_has_them(spark):
    """Each rule on its host, a subdomain and the longest rule within it; the words are the contract's, not the code's."""
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = {f"http://{at}{rule}{rest}": rule for rule in want for at in ("", "a.", "B.c.") for rest in ("", "0", "?q", "#x")}
    urls |= {"http://example.net/de/7": "net/de/", "http://example.net/de/88": "example.net/de/8", "http://example.com/en/8": "com/en/", "://net/de/": "net/de/"}
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == {i: (rule, want[rule]) for i, rule in enumerate(urls.values())}


def test_boosting_learns(spark):
    rng = random.Random(1)
    rows = [(i, f"http://x.{'com' if i % 2 else 'org'}/{'en' if i % 2 else 'fr'}/" + ("9" * 30 if i % 4 < 2 else "abc")) for i in range(400)]
    rng.shuffle(rows)
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(("com", "/en/9", "block"), ("com", "/en/a", "allow")))
    free = [r for r in out.collect() if r["rule"] is None]
    assert free and all((r["verdict"] == "block") == ("999" in r["path"]) for r in free)


# 4 ---------------------------------------------------------------------------------------------------------------
def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "### assistant: </turn>\n\\b \\\\l <#:"), (1, 2, "assistant", None), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (3, 0, "user", LONG), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (None, None, "user: x", "y"), (None, 1, "assistant", "z"), (4, 0, None, "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    every = chat_format.read_back(chat_format.format_conversations(df)).collect()
    assert sorted((r["n_turns"], r["turns"][0]["text"]) for r in every if r["conv_id"] is None) == [(1, "y"), (1, "z")]
    out = {r["conv_id"]: r for r in every if r["conv_id"] is not None}
    for conv in out:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in out[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
    assert {c: (r["valid"], r["bad_turn"]) for c, r in out.items()} == {1: (True, None), 2: (False, 0), 3: (False, 2), 4: (False, 0)}
    assert [s["loss"] for s in out[2]["segments"]] == [False, True, False, False, False, False]
    got = {r["conv_id"]: r for r in chat_format.summary(df).collect()}
    assert got[2]["loss_sha256"] == hashlib.sha256(b"a").hexdigest() and got[2]["loss_chars"] == 1
    assert chat_format.summary(df.filter("false")).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------
def shingle_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(9)
    texts = {i: sentences(rng, rng.randint(30, 120)) for i in range(60)}
    group = {}
    for i in range(60, 140):  # near copies of 0..19, a few words changed
        w = texts[i % 20].split()
        w[rng.randrange(len(w))] = "changed"
        texts[i], group[i] = " ".join(w), i % 20
    passage = sentences(rng, 40)
    texts |= {i: passage + " " + sentences(rng, 120) for i in range(140, 170)}  # a shared passage is no copy
    texts |= {200: "", 201: None, 202: "one two", 203: "One  two", 204: texts[5], 205: LONG, 206: LONG + " x"}
    rows = [*texts.items(), (5, texts[5]), (None, texts[5])]
    got = near_dedup.near_duplicates(docs(spark, rows).withColumn("class_id", F.lit(1))).collect()
    assert len(got) == len(rows)
    cls = {r["doc_id"]: r["class_id"] for r in got}
    want = {i: i for i in texts} | {201: 200, 203: 202, 204: cls[5], 206: 205}
    sim = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, base in group.items():
        if sim(shingle_set(texts[i]), shingle_set(texts[base])) > 0.85:
            assert cls[i] == cls[base]
    for i in (*range(20, 60), *range(140, 170), 201, 203, 204, 206):
        assert cls[i] == want[i]
    assert cls[None] == cls[5]
    stay = near_dedup.distinct_documents(docs(spark, [r for r in rows if r[0] is not None])).collect()
    assert {r["doc_id"] for r in stay} == {c for i, c in cls.items() if i is not None}
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_lose_no_link(spark, monkeypatch):
    """Variants of one text whose similarities lie around 0.8: a leader refuses some that others accept."""
    rng = random.Random(21)
    base, rows = sentences(rng, 300).split(), []
    for i in range(120):
        w = list(base)
        for at in rng.sample(range(300), rng.choice([1, 3, 5, 7, 9])):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    df = docs(spark, rows)
    idf = near_dedup.idf_table(df, "text", 0.25, 5)
    own = {}
    for i, t in rows:
        h, times, _, _ = near_dedup.shingles([t], 5)
        own[i] = h, near_dedup.weights(idf, h, times)
    root = {i: i for i in own}
    for a in own:
        for b in range(a):
            if root[a] != root[b] and near_dedup.weighted_jaccard(own[a], own[b]) >= 0.8:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert 1 < len(set(root.values())) < 100
    for partners in (64, 1):
        monkeypatch.setattr(near_dedup, "PARTNERS", partners)
        monkeypatch.setattr(near_dedup, "GROWTH", 1 + partners)
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == root


def test_long_texts_and_words_hash_alike(monkeypatch):
    """Pieces of long texts give the hashes of whole ones, and a word that is longer than a piece counts as one word."""
    from landsift.llm import _words

    texts = ["a b  c\n" * 200 + "é" * 40 + " end", "", " x ", "w" * 5000 + " y " + "w" * 5000]
    want, lengths = _words.word_hashes(texts)
    monkeypatch.setattr(_words, "CHUNK", 64)
    monkeypatch.setattr(_words, "LONG_WORD", 1000)
    got, again = _words.word_hashes(texts)
    assert list(lengths) == list(again) == [602, 0, 1, 3]
    assert (got[:603] == want[:603]).all() and got[603] == got[605] != got[604] == want[604]


def boilerplate_group(rng, n):
    """n texts that share 300 words (similarity about 0.73); every second one has half of its predecessor's own words."""
    passage, rows = sentences(rng, 300), []
    for i in range(n):
        own = sentences(rng, 60).split()
        if i % 2:
            own[:38] = rows[-1][1].split()[300:338]
        rows.append((i, passage + " " + " ".join(own)))
    return rows


def test_near_duplicates_of_one_large_key(spark):
    """Pairs above 0.8 among texts that all share bands with all others, but are no copies of them."""
    rng = random.Random(33)
    rows = boilerplate_group(rng, 1600)
    df = docs(spark, rows)
    idf = near_dedup.idf_table(df, "text", 0.25, 5)
    own = []
    for _, t in rows:
        h, times, _, _ = near_dedup.shingles([t], 5)
        own.append((h, near_dedup.weights(idf, h, times)))
    assert all(near_dedup.weighted_jaccard(own[i], own[i + 1]) >= 0.8 for i in range(0, 1600, 2))
    others = [rng.sample(range(1600), 2) for _ in range(5000)]
    assert all(near_dedup.weighted_jaccard(own[a], own[b]) < 0.8 for a, b in others if a // 2 != b // 2)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert sum(got[i] != i - i % 2 for i in got) == 0


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    a = np.sort(rng.integers(0, 1 << 57, 4000).astype(np.uint64))
    w1, w2 = rng.uniform(0.5, 3, 4000).astype(np.float32), rng.uniform(0.5, 3, 4000).astype(np.float32)
    same = total = 0.0
    for at in range(0, 4000, 20):
        h = a[at : at + 20]
        same += (near_dedup.samples(h, w1[at : at + 20], np.array([20])) == near_dedup.samples(h, w2[at : at + 20], np.array([20]))).mean()
        total += near_dedup.weighted_jaccard((h, w1[at : at + 20]), (h, w2[at : at + 20]))
    assert abs(same - total) / 200 < 0.03


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if find(x) != x or any(find(y) == x and y != x for f in edges for y in f)}


def test_small_tables_are_written_by_few_tasks(spark, monkeypatch):
    """However many partitions shuffles have: the files of components and of verified pairs; results as by hand."""
    rng, written = random.Random(8), []
    texts = {i: sentences(rng, 30) for i in range(0, 120, 2)}
    rows = [(i, t) for i, t in texts.items()] + [(i + 1, t + " end.") for i, t in texts.items()] + [(1, sentences(rng, 30)), (3, texts[0])]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(keep, ("97", "false"), strict=True):
        spark.conf.set(k, v)
    monkeypatch.setattr(components, "remove", lambda df: written.append(df.rdd.getNumPartitions() and len(df.inputFiles())))
    try:
        roots = components.components(spark.createDataFrame([(i, i + 1) for i in range(300) if i % 10], "a long, b long"))
        assert {r["id"]: r["root"] for r in roots.collect()} == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 301)}
        df = docs(spark, rows).select(F.col("doc_id").alias("id"), "text")
        idf = near_dedup.idf_table(df, "text", 0.25, 5)
        pairs = near_dedup.cut(spark.createDataFrame([(i, i + 1) for i in texts], "leader long, member long").repartition(97))
        pairs_ = near_dedup.verified(df, pairs, idf, 0.8, 5)
        got = {(r["leader"], r["member"]): r["linked"] for r in pairs_.collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert got == {(i, i + 1): True for i in texts} and pairs_.count() == len(texts)
    assert written[1:] and max([*written[1:], len(roots.inputFiles())]) <= cores and len(pairs_.inputFiles()) <= 4 * cores < 97


# 6 ---------------------------------------------------------------------------------------------------------------
def test_tokenizer(spark):
    ranks, pattern = bpe.tokenizer()
    codec, own = bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    alphabets = ["ab", "thein ", "éñüß æ", "a", "\n \t\x1c\x85\xa0", "中文字符😀", "".join(map(chr, range(700))), "'s'll 12³½"]
    for i in range(1500):
        t = "".join(rng.choice(rng.choice(alphabets) if i % 3 else alphabets[i % 8]) for _ in range(rng.choice([1, 5, 40, 300, 2000])))
        assert list(codec.encode(t)) == own.encode_ordinary(t) and codec.decode(codec.encode(t)) == t.encode()
    for _ in range(500):
        a, b = (bytes(rng.choice(b"abcdth\xc3\xa9") for _ in range(rng.randint(0, 60))) for _ in range(2))
        assert codec.join(codec.tree(a), codec.tree(b)) == codec.tree(a + b) == codec.merged(a + b)
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "x" * 200_000), (5, LONG), (1, "Hello there")]
    df = docs(spark, rows).withColumn("ids", F.lit("clash"))
    out = bpe.round_trip(df, ranks, pattern)
    for r in out.collect():
        assert r["ids"] == own.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    back = bpe.decode(out.drop("decoded"), ranks).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    got = {r["doc_id"]: r for r in bpe.digests(spark, df).collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["ids_sha256"] == hashlib.sha256(",".join(map(str, own.encode_ordinary("Hello there"))).encode()).hexdigest()
    assert bpe.digests(spark, docs(spark, [])).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------
def test_exact_dedup(spark):
    rows = [(3, "a"), (1, "a"), (9, "A"), (4, None), (5, ""), (7, LONG), (8, LONG), (None, "n"), (2, "a "), (3, "a"), (None, "n"), (8, LONG)]
    df = docs(spark, rows).withColumn("kept", F.lit("clash"))
    for keep, hashed in (("max", exact_dedup.content_hash), ("min", exact_dedup.content_hash), ("max", lambda c: F.lit(b"x"))):
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.duplicate_groups(df, keep=keep, hashed=hashed).collect())
        want = Counter()
        for at, (i, t) in enumerate(rows):
            own = [j for j, u in rows if (u or "") == (t or "")]
            ids = [j for j in own if j is not None]
            best = (max if keep == "max" else min)(ids, default=None)
            first = next(n for n, (j, u) in enumerate(rows) if (u or "") == (t or "") and j == best)
            want[i, best, len(own), at == first, hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert got == want
    stay = exact_dedup.distinct_documents(df).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in stay) == sorted([("1", "a"), ("9", "A"), ("4", ""), ("7", LONG), ("None", "n"), ("2", "a ")])
    assert exact_dedup.duplicate_groups(docs(spark, [])).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------
def test_quality(spark):
    rng = random.Random(6)
    rows = [(i, sentences(rng, 60).capitalize() + "." if i % 3 else "BUY!!! " * 30 + sentences(rng, 5)) for i in range(600)] + [(900, None), (901, ""), (902, LONG)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(3, None), (None, 1), (12345, 1)], "doc_id long, quality int")
    got = quality.classify(docs(spark, rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 50 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs(spark, rows), flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)
    assert {r["score"] for r in quality.classify(docs(spark, rows[:9]), labels.filter("false")).collect()} == {1.0}
    assert quality.classify(docs(spark, []), labels).count() == 0
    kept = quality.kept_documents(docs(spark, rows), labels).collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in got if r["predicted"]} and kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_isotonic():
    got = quality.isotonic(np.array([0, 3, 0, 1, 4.0]), np.array([2, 4, 0, 4, 4.0]))
    assert np.allclose(got[[0, 1, 3, 4]], [0, 0.5, 0.5, 1]) and np.isnan(got[2])


# 9 ---------------------------------------------------------------------------------------------------------------
def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, sentences(rng, rng.randint(1, 30)), rng.choice(["en", "de", None]), rng.choice("aaaab"), i) for i in range(900)] + [(None, None, "en", "a", 0), (5000, "", "de", "b", 0), (5001, LONG, "en", "b", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("topic", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    given = {"lang": {"en": 0.6, "de": 0.3}, "topic": {"even": 0.5, "odd": 0.5}}
    out = mixing.probabilities(df, given, budget=None, topic=F.col("topic")).collect()
    assert len(out) == len(rows)
    total = sum(r["n_tokens"] * r["probability"] for r in out)
    share = lambda c, v: sum(r["n_tokens"] * r["probability"] for r in out if r[c] == v) / total
    assert abs(share("lang", "en") - 0.6) < 1e-4 and abs(share("lang", "") - 0.1) < 1e-4 and abs(share("topic", "odd") - 0.5) < 1e-2
    by = Counter()
    for r in out:
        by[r["source"]] += r["n_tokens"]
    roots = {s: math.sqrt(n) for s, n in by.items()}
    assert abs(share("source", "a") - roots["a"] / sum(roots.values())) < 1e-4 and max(r["probability"] for r in out) <= 1
    half = mixing.probabilities(df, given, budget=0.5, topic=F.col("topic")).collect()
    assert abs(sum(r["n_tokens"] * r["probability"] for r in half) / sum(r["n_tokens"] for r in half) - 0.5) < 1e-3
    chosen = {r["doc_id"] for r in half if r["selected"]}
    kept = mixing.mixed(df, given, budget=0.5, topic=F.col("topic"))
    assert {r["doc_id"] for r in kept.collect()} == chosen and kept.columns == df.columns
    got = sum(r["n_tokens"] for r in half if r["selected"] and r["doc_id"] != 5001)
    want = sum(r["n_tokens"] * r["probability"] for r in half if r["doc_id"] != 5001)
    assert abs(got - want) < 0.15 * want
    assert mixing.probabilities(df.filter("false")).count() == 0 and mixing.mixed(df.filter("false")).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title><script>var t='</p>';</script></head><body><!-- no --><p>One &lt;two&gt;<br>three</p><a href='/x?a=1&amp;b'>é</a></body></html>"
    rows = [(1, "http://a.com/", page), (2, None, None), (3, "http://b.com/\r\nX: y", ""), (4, "u", "<p>" + LONG), (1, "http://a.com/", page)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, kind string")
    made = warc.responses(df)
    out = warc.derive(made).collect()
    assert Counter(r["id"] for r in out) == {1: 4, 2: 2, 3: 2, 4: 2}
    sources = {r["id"]: next(warc.parse(bytes(r["record"]))) for r in made.collect()}
    for r in out:
        headers, block = next(warc.parse(bytes(r["record"])))
        origin, payload = sources[r["id"]]
        assert headers["warc-refers-to"] == r["refers_to"] == origin["warc-record-id"] and headers["warc-type"] == r["kind"]
        assert headers["x-source-payload-digest"] == origin["warc-payload-digest"] == warc.digest(payload.partition(b"\r\n\r\n")[2])
        assert headers["warc-block-digest"] == warc.digest(block) and headers.get("warc-target-uri") == origin.get("warc-target-uri") and headers["warc-date"] == origin["warc-date"]
    by = {(r["id"], r["kind"]): r["block"] for r in out}
    assert by[1, "conversion"] == "A & B\nOne <two>\nthree\né" and by[2, "conversion"] == ""
    assert "title: A & B\r\n" in by[1, "metadata"] and "outlink: /x?a=1&b\r\n" in by[1, "metadata"] and "http-header-content-type: text/html; charset=utf-8" in by[1, "metadata"]
    assert len({r["record_id"] for r in out}) == 8
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r["record"]) for r in made.collect()))
    again = warc.derive(warc.read_warc(spark, str(tmp_path)))
    assert Counter(r["block"] for r in again.collect()) == Counter(r["block"] for r in out)
    assert list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")) == [] and warc.derive(warc.responses(df.filter("false"))).count() == 0


def test_warc_records_read_by_other_means(spark):
    """Derivatives of real pages, taken apart by the standard library's e-mail and HTML parsers."""
    from email.parser import BytesParser
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden, self.links = [], 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "noscript", "template")
            self.links += [v or "" for k, v in attrs if tag == "a" and k == "href"]

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "noscript", "template")

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r["page_id"]: r for r in pages.collect()}
    made = {r["id"]: bytes(r["record"]) for r in warc.responses(pages).collect()}
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(made) == len(html) and Counter(r["id"] for r in rows) == dict.fromkeys(html, 2)

    def taken_apart(data):
        first, rest = data.split(b"\r\n", 1)
        head, rest = rest.split(b"\r\n\r\n", 1)
        headers = BytesParser().parsebytes(head + b"\r\n\r\n", headersonly=True)
        assert first == b"WARC/1.1" and rest.endswith(b"\r\n\r\n") and len(rest) == int(headers["Content-Length"]) + 4
        assert headers["WARC-Block-Digest"] == "sha1:" + __import__("base64").b32encode(hashlib.sha1(rest[:-4]).digest()).decode()
        return headers, rest[:-4]

    same = 0
    for r in rows:
        source, block = taken_apart(made[r["id"]])
        headers, body = taken_apart(bytes(r["record"]))
        assert headers["WARC-Refers-To"] == source["WARC-Record-ID"] == r["refers_to"] and headers["WARC-Target-URI"] == html[r["id"]]["url"]
        assert block.split(b"\r\n\r\n", 1)[1] == html[r["id"]]["html"].encode() and headers["X-Source-Payload-Digest"] == source["WARC-Payload-Digest"]
        words = Words()
        words.feed(html[r["id"]]["html"])
        if r["kind"] == "conversion":
            same += "".join(body.decode().split()) == "".join(words.words)
        else:
            assert re.findall(r"^outlink: ?(.*)\r$", body.decode(), re.M) == [" ".join(x.split()) for x in words.links]
    assert same >= 0.9 * len(html)


def test_warc_skips_damage_and_unpacks_bodies():
    import gzip
    import zlib

    good = [warc.response(f"http://a/{i}", f"<p>page {i}</p>") for i in range(3)]
    for data in (good[0] + b"WARC/1.1\r\nContent-Length: 99999\r\n\r\ncut" + b"\r\n" + good[1] + good[2], b"junk\r\n" + b"".join(good), gzip.compress(good[0]) + gzip.compress(good[1]) + gzip.compress(good[2])):
        assert [h["warc-target-uri"] for h, _ in warc.parse(data)] == ["http://a/0", "http://a/1", "http://a/2"]
    assert len(list(warc.parse(gzip.compress(good[0]) + gzip.compress(good[1])[:-9]))) >= 1
    page = "<p>über</p>".encode()
    chunks = b"4\r\n" + page[:4] + b"\r\n" + f"{len(page) - 4:x}".encode() + b"\r\n" + page[4:] + b"\r\n0\r\n\r\n"
    for extra, body in ((b"", page), (b"Content-Encoding: gzip", gzip.compress(page)), (b"Content-Encoding: deflate", zlib.compress(page)), (b"Transfer-Encoding: chunked", chunks), (b"Content-Encoding: gzip", page)):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + extra + (b"\r\n" if extra else b"") + b"\r\n" + body
        made = warc.derivatives({"warc-record-id": "x"}, block)
        assert next(warc.parse(made[1][3]))[1].decode() == "über" and made[1][3].count(warc.digest(body).encode()) == 1


# second implementations -------------------------------------------------------------------------------------------
def test_url_features_and_rates_by_hand(spark):
    urls = ["https://a.Example.com:80/en/7198/x?a=1&b=2#top", "http://b.net/de/", "no scheme", "", "x://h", "http://é.org/a%20b?", "http://c.org/es/9", None] + [f"http://s{i}.{'com' if i % 3 else 'net'}/{'en' if i % 2 else 'de'}/{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rule, given = url_filter.rule_columns()
    rows = url_filter.lexical(url_filter.with_parts(df)).withColumns({"rule": rule, "given": given}).collect()
    for r in rows:
        u = r["url"] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        query = m[1] if (m := re.search(r"\?([^#]*)", u)) else ""
        counts = Counter(u)
        entropy = -sum(c / len(u) * math.log2(c / len(u)) for c in counts.values())
        want = [len(u), len(host), len(path), path.count("/"), host.count(".") + 1, sum(c in "0123456789" for c in u) / max(1, len(u)), entropy, query.count("&") + 1 if query else 0, len(query), sum(c in "-_.~%+=&" for c in u), u.lower().startswith("https:"), "#" in u]
        assert np.allclose([r[f] for f in url_filter.FEATURES[:12]], want), u
    y = {r["page_id"]: float(r["given"] == "block") for r in rows if r["given"]}
    labelled = spark.createDataFrame([(r["suffix"], y[r["page_id"]]) for r in rows if r["page_id"] in y], "suffix long, y double")
    got, overall = url_filter.suffix_statistics(labelled)
    by = {}
    for r in rows:
        if r["page_id"] in y:
            by.setdefault(r["suffix"], []).append(y[r["page_id"]])
    assert overall == pytest.approx(sum(y.values()) / len(y))
    assert {r["suffix"]: (round(r["suffix_rate"], 9), round(r["suffix_seen"], 9)) for r in got.collect()} == {k: (round((sum(v) + 10 * overall) / (len(v) + 10), 9), round(math.log1p(len(v)), 9)) for k, v in by.items()}


def test_trees_by_exhaustive_search(spark):
    """Boosting against a plain search over all splits of all rows."""
    rng = np.random.default_rng(3)
    n = len(url_filter.FEATURES)
    x = rng.integers(0, 4, (80, n))
    p = np.where(x[:, 2] > 1, 0.8, 0.2) + 0.15 * (x[:, 5] > 2)
    size = rng.integers(1, 5, 80).astype(float)
    y = np.minimum(size, rng.binomial(size.astype(int), np.minimum(p, 1)).astype(float))
    train = spark.createDataFrame([(*map(int, r), float(a), float(b)) for r, a, b in zip(x, y, size, strict=True)], ", ".join(f"b{i} int" for i in range(n)) + ", y double, n double")
    got = url_filter.boost(train, 3, 0.5, 1.0, 0.0)
    margin, want = np.zeros(80), []

    def best(rows):
        g, h = (y - size * q)[rows], (size * q * (1 - q))[rows]
        found, split = 1e-9, None
        for i in range(n):
            for b in sorted(set(x[rows, i]))[:-1]:
                left = x[rows, i] <= b
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                if gain > found + 1e-9:
                    found, split = gain, (i, int(b), 0.5 * g[left].sum() / (h[left].sum() + 1), 0.5 * g[~left].sum() / (h[~left].sum() + 1))
        return split or 0.5 * g.sum() / (h.sum() + 1)

    for _ in range(3):
        q = 1 / (1 + np.exp(-margin))
        i, b, *_ = best(np.ones(80, bool))
        want.append((i, b, best(x[:, i] <= b), best(x[:, i] > b)))
        for side, part in ((x[:, i] <= b, want[-1][2]), (x[:, i] > b, want[-1][3])):
            margin = margin + np.where(side, np.where(x[:, part[0]] <= part[1], part[2], part[3]) if isinstance(part, tuple) else part, 0)
    flat = lambda t: [v for node in t for v in (flat(node) if isinstance(node, tuple) else [node])]
    assert np.allclose(flat(got), flat(want))


def test_url_filter_on_held_out_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2
    rows = [r for r in url_filter.judge(pages, learn=~held("_id")).filter(held("page_id")).collect() if r["rule"]]
    good, bad = ([r["score"] for r in rows if r["verdict"] == v] for v in ("allow", "block"))
    assert good and bad and sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad)) > 0.8
    assert {r["verdict"] for r in url_filter.judge(pages).collect() if r["rule"] is None} == {"allow", "block"}


def test_ridge_and_calibration_by_dense_algebra(spark):
    rng = random.Random(12)
    rows = [(i, sentences(rng, 40) + ("." if i % 3 else " BUY!!! $$$")) for i in range(240)]
    labels = [(i, int(i % 3 > 0) if i % 11 else int(i % 2)) for i in range(240)]
    x = np.array([quality.statistics(t) for _, t in rows])
    learnt = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    model = quality.Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6))
    z = model.lift(x[learnt])
    target = np.array([labels[i][1] for i in learnt], dtype=float)
    n, size = len(learnt), z.shape[1]
    stacked = np.concatenate([z, np.sqrt(quality.RIDGE * n) * np.diag(np.append(0, np.ones(size - 1))), np.sqrt(1e-9 * n) * np.eye(size)])
    beta = np.linalg.lstsq(stacked, np.append(target, np.zeros(2 * size)), rcond=None)[0]
    raw = model.lift(x) @ beta
    bins = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    good, all_ = np.bincount(bins[learnt], target, quality.BINS), np.bincount(bins[learnt], minlength=quality.BINS)
    full = np.flatnonzero(all_)
    fit = [max(min(good[a : b + 1].sum() / all_[a : b + 1].sum() for b in full if b >= i) for a in full if a <= i) for i in full]  # the max-min form of isotonic regression
    want = np.interp(raw, quality.LOW + (full + 0.5) * (quality.HIGH - quality.LOW) / quality.BINS, fit)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    off = np.abs(np.array([got[i] for i, _ in rows]) - want)
    assert (off < 1e-6).mean() > 0.98  # a raw score at a bin's edge may fall on its other side


def test_bounded_raking_by_hand(spark):
    """Budget 0.5: dealt shares by plain water-filling, reached ones within 1e-3 or named, no cell beyond its tokens."""
    rng = random.Random(17)
    rows = [(i, sentences(rng, rng.randint(1, 60)), rng.choice(["en", "en", "en", "de", "fr"]), rng.choice("aaaabbc") if i > 30 else "rare", i) for i in range(1200)]
    df = spark.createDataFrame(rows, DOC)
    given = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.3}, "source": {"rare": 0.3, "a": 0.3, "b": 0.2, "c": 0.2}}
    got = mixing.marginals(df, given, budget=0.5, topic=F.lit("one")).collect()
    tokens = {}
    for _, t, lang, source, _ in rows:
        for d, v in (("lang", lang), ("source", source), ("topic", "one")):
            tokens[d, v] = tokens.get((d, v), 0) + len(t.split())
    budget = 0.5 * tokens["topic", "one"]
    for d in ("lang", "source", "topic"):
        shares = given.get(d, {"one": 1.0})
        full, left = set(), budget
        while True:
            rest = sum(s for v, s in shares.items() if v not in full)
            left = budget - sum(tokens[d, v] for v in full)
            over = {v for v, s in shares.items() if v not in full and left * s / rest >= tokens[d, v]}
            if not over:
                break
            full |= over
        for r in got:
            if r["dim"] == d:
                want = tokens[d, r["value"]] if r["value"] in full else left * shares[r["value"]] / rest
                assert r["tokens"] == tokens[d, r["value"]] and abs(r["target"] - shares[r["value"]]) < 1e-9 and abs(r["dealt"] - want / budget) < 1e-6
    assert all(abs(r["reached"] - r["dealt"]) < 1e-3 for r in got) and {r["status"] for r in got if r["value"] == "rare"} == {"short"}
    out = mixing.probabilities(df, given, budget=0.5, topic=F.lit("one")).collect()
    assert max(r["probability"] for r in out) <= 1
    for r in got:
        reached = sum(o["n_tokens"] * o["probability"] for o in out if o[{"source": "source", "lang": "lang", "topic": "topic"}[r["dim"]]] == r["value"])
        assert abs(reached / budget - r["reached"]) < 1e-6
    both = spark.createDataFrame([(i, "w " * 9, "en" if i < 40 else "de", "a" if i < 40 else "b", 0) for i in range(100)], DOC)
    with pytest.warns(UserWarning, match="raking ended"):
        barred = mixing.marginals(both, {"lang": {"en": 0.5, "de": 0.5}, "source": {"a": 0.3, "b": 0.7}}, budget=0.5, topic=F.lit("one")).collect()
    assert "barred" in {r["status"] for r in barred}
    clash = df.withColumns({"_mix": F.col("doc_id"), "_mix_": F.lit("x"), "probability": F.lit(2)})
    kept = mixing.mixed(clash, given, budget=0.5, topic=F.lit("one"))
    assert kept.columns == clash.columns and {(r["doc_id"], r["_mix"]) for r in kept.collect()} == {(r["doc_id"], r["doc_id"]) for r in out if r["selected"]}
    with pytest.warns(UserWarning, match="raking ended"):
        mixing.probabilities(df, {"lang": {"en": 0.01, "de": 0.98, "fr": 0.01}}, budget=None, topic=F.lit("one"), sweeps=1)


def test_raking_of_few_cells_takes_few_jobs(spark, monkeypatch):
    """A sweep over few cells is one write and one look at the misses; cells beyond SMALL get the same probabilities."""
    rng = random.Random(23)
    rows = [(i, sentences(rng, rng.randint(1, 60)), rng.choice(["en", "en", "en", "de", "fr", None]), rng.choice("aaaabbc"), i) for i in range(600)]
    df, given = spark.createDataFrame(rows, DOC), {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2}}

    def made(group, budget):
        spark.sparkContext.setJobGroup(group, group)
        try:
            out = {r["doc_id"]: r["probability"] for r in mixing.probabilities(df, given, budget=budget).collect()}
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    cut, written = mixing.cut, []
    monkeypatch.setattr(mixing, "cut", lambda *a: written.append(1) or cut(*a))
    for budget in (0.5, None):
        written.clear()
        few, jobs = made(f"few-{budget}", budget)
        assert jobs <= 30 + 3 * len(written)
        sweeps = len(written)
        with monkeypatch.context() as m:
            m.setattr(mixing, "SMALL", 0)
            written.clear()
            many, more = made(f"many-{budget}", budget)
        assert len(written) > sweeps and more > jobs
        assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-9 for i in few)


def test_language_model_scores_by_loops():
    """score_codes against one token after another in plain float64."""
    words = [f"w{i}".encode() for i in range(70)]
    lex = recurrent_lm.Lexicon([*words, recurrent_lm.END], np.arange(71, 0, -1.0), np.full(recurrent_lm.SURFACE, 400.0), 2556.0, 71.0)
    rng = np.random.default_rng(5)
    w = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in recurrent_lm.start_weights(lex).items()}
    texts = [rng.integers(-recurrent_lm.SURFACE, 71, n).astype(np.int32) for n in (1, 9, 130, 40)]
    k, heads, end = recurrent_lm.HIDDEN, len(lex.edges), 70

    def row(code):
        return code if 0 <= code < lex.head else lex.head + (-1 - code if code < 0 else lex.surface_of[code])

    def plain(codes):
        h, last, total = np.zeros(k), end, 0.0
        for c in codes:
            x, a = w["x"][row(last)].astype(float) + w["b"], h @ w["u"].astype(float)
            z, r = (1 / (1 + np.exp(-(x[i : i + k] + a[i : i + k]))) for i in (0, k))
            n = np.tanh(x[2 * k :] + r * a[2 * k :])
            h = (1 - z) * n + z * h
            logits = h @ w["wc"] + w["bc"]
            inside = next((i for i, (lo, hi) in enumerate(lex.edges) if lo <= c < hi), None)
            cls = inside if inside is not None else heads + (row(c) - lex.head)
            total += logits[cls] - np.log(np.exp(logits).sum())
            if inside is not None:
                lo, hi = lex.edges[inside]
                own = w["wo"][lo:hi] @ h + w["bo"][lo:hi]
                total += own[c - lo] - np.log(np.exp(own).sum())
            last = c
        return total

    assert np.allclose(recurrent_lm.score_codes(lex, w, texts, end), [plain(t) for t in texts], atol=2e-3)


def test_state_goes_on_through_parts_of_a_long_text():
    """With a rate of 0, the states at which parts begin are those of the whole text."""
    words = [f"w{i}".encode() for i in range(30)]
    lex = recurrent_lm.Lexicon([*words, recurrent_lm.END], np.ones(31), np.full(recurrent_lm.SURFACE, 40.0), 31.0, 31.0)
    w, rng = recurrent_lm.start_weights(lex), np.random.default_rng(2)
    codes = rng.integers(0, 31, 95).astype(np.int32)
    waiting, short = [(codes, 0, np.zeros(recurrent_lm.HIDDEN, np.float32))], (codes[:7], 0, np.zeros(recurrent_lm.HIDDEN, np.float32))
    one, starts = recurrent_lm.Trainer(lex, w, 0.0), []
    waiting.append(short)
    while waiting:
        waiting = one.learn(waiting, 30, 2, 8, 40)
        starts += [(at, h) for _, at, h in waiting]
    assert [at for at, _ in starts] == [40, 80]
    rows = np.append(30, codes[:-1])[:, None]
    whole = recurrent_lm.forward(w, rows, np.arange(95)[:, None] == 0, np.zeros((1, recurrent_lm.HIDDEN), np.float32))[0]
    assert all(np.allclose(h, whole[at - 1, 0], atol=1e-5) for at, h in starts)


def test_frequencies_are_counted_apart_from_the_crowd(spark):
    """The sketch's estimate of what many texts share, among many rare shingles."""
    rng = random.Random(4)
    passage = sentences(rng, 12)
    rows = [(i, (passage + " " if i % 10 == 0 else "") + sentences(rng, 300)) for i in range(1500)]
    idf = near_dedup.idf_table(docs(spark, rows), "text", 1.0, 5)
    h, times, _, _ = near_dedup.shingles([passage], 5)
    common = near_dedup.weights(idf, h, times)
    assert np.allclose(common, 1 + np.log1p(1500 / 150) / np.log1p(1500), atol=0.03)
    h, times, _, _ = near_dedup.shingles([rows[1][1]], 5)
    assert np.median(near_dedup.weights(idf, h, times)) > 1.85


def test_empty_tables_and_clashing_names(spark):
    empty, labels = docs(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    ranks, pattern = bpe.tokenizer()
    for out in (quality.kept_documents(empty, labels), near_dedup.distinct_documents(empty), exact_dedup.distinct_documents(empty), mixing.mixed(empty), bpe.decode(bpe.round_trip(empty, ranks, pattern), ranks)):
        assert out.count() == 0
    rows = docs(spark, [(1, "a b c d e f"), (2, None), (3, "a b c d e f")]).withColumns({"id": F.lit("x"), "row": F.lit(1), "score": F.lit("s"), "kept": F.lit(2), "_dropped": F.lit(3), "x": F.lit(4), "token": F.lit("t")})
    assert {r["doc_id"] for r in near_dedup.distinct_documents(rows).collect()} == {1, 2}
    assert {r["doc_id"] for r in recurrent_lm.score_documents(rows).collect()} == {r["doc_id"] for r in quality.classify(rows, labels).collect()} == {1, 2, 3}
    assert quality.kept_documents(rows, labels).columns == rows.columns and exact_dedup.distinct_documents(rows).columns == rows.columns


# pipeline --------------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    now, seen = source, []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, now, SF).collect()
        seen.append({r["doc_id"] for r in rows})
        if name != "tokens":
            assert rows and set(rows[0].asDict()) == set(source.columns)
            now = spark.createDataFrame(rows, source.schema)
    texts = {r["doc_id"]: r["text"] for r in source.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.classify(source, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert seen[0] == {i for i, x in scores.items() if x >= 0.7}
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    assert len(seen[0] & good) > 0.9 * len(good)
    assert seen[1] == set({texts[i]: i for i in sorted(seen[0], reverse=True)}.values())
    idf = near_dedup.idf_table(source.filter(F.col("doc_id").isin(*seen[1])), "text", 0.25, 5)
    own = {}
    for i in seen[1]:
        h, times, _, _ = near_dedup.shingles([texts[i] or ""], 5)
        own[i] = h, near_dedup.weights(idf, h, times)
    root = {i: i for i in own}
    for a in sorted(own):
        for b in sorted(own):
            if a < b and root[a] != root[b] and near_dedup.weighted_jaccard(own[a], own[b]) >= 0.8:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert seen[2] == set(root.values())
    chosen = mixing.probabilities(source.filter(F.col("doc_id").isin(*seen[2]))).collect()
    assert seen[3] == {r["doc_id"] for r in chosen if r["selected"]}
    ranks, pattern = bpe.tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    done = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(done) == seen[4] == seen[3]
    assert all(r["ids"] == own.encode_ordinary(texts[i] or "") and bytes(r["decoded"]) == (texts[i] or "").encode() for i, r in done.items())
