import hashlib
import os
import random
import zlib

import ahocorasick  # noqa: F401  the operators need it
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from veldspar.llm import bpe, chains, common, decontaminate, exact, graph, language, learn, minhash, quality, shard, suffix, toxicity

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
EXTRA = "doc_id long, text string, score string, digest string, n_words string, spans string"


def frame(spark, texts, start=0):
    """doc_id from `start`, with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in enumerate(texts, start)], EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", " \n\t", "a", "Été naïve ß 中文 \U0001f600", "x" * 30_000, "same text", "same text"]


# byte-level BPE


@pytest.fixture(scope="module")
def own():
    blob = open(RANKS, "rb").read()
    return bpe.Codec(blob, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(blob), special_tokens={})


@pytest.mark.parametrize("text", ["hello world", "  two  spaces ", "a" * 3000, "ab" * 999, "zyxw" * 5000, "日本語" * 300, "it's 123 +++ \x00\x1c\xa0 é", "<|endoftext|>"])
def test_bpe_agrees_with_the_library(own, text):
    codec, library = own
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_of_random_pieces(own):
    codec, library = own
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("abcdeé中 \n'12!") for _ in range(draw.randint(0, 60)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_frames(spark, own):
    df = frame(spark, ODD)
    got = table(bpe.digests(df, RANKS, P.PATTERN))
    for i, t in enumerate(ODD):
        ids = own[1].encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = table(bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN))
    assert [bytes(back[i].decoded) for i in range(len(ODD))] == [(t or "").encode() for t in ODD] and back[0].score == "x"
    assert bpe.digests(empty(spark), RANKS, P.PATTERN).count() == 0


# decontamination


def brute_hits(text, items, width=10):
    words = decontaminate.words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        for w in decontaminate.windows((t or "").encode(), width):
            w = w.split()
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), found


def test_decontamination_against_brute_force(spark):
    draw = random.Random(5)
    word = lambda: draw.choice(["aa", "B", "c", "dé", "e1"])
    items = [(i, " ".join(word() for _ in range(draw.randint(1, 14)))) for i in range(12)] + [(12, None), (13, " - "), (None, "aa"), (3, "zz top")]
    docs = [", ".join(word() for _ in range(draw.randint(0, 200))) for _ in range(40)] + [None, "", "ZZ-top", items[0][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 120):
        got = table(decontaminate.decontaminate(frame(spark, docs), bench, ["doc_id"], block_bytes=block))
        for i, t in enumerate(docs):
            n, hits, found = brute_hits(t, [x for x in items if x[0] is not None])
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hits, len(found), hits > 0)
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    assert decontaminate.decontaminate(empty(spark), bench, ["doc_id"]).count() == 0
    assert not table(decontaminate.decontaminate(frame(spark, ["aa"]), bench.limit(0), ["doc_id"]))[0].contaminated


def test_offsets_are_those_of_the_original(spark):
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    r = decontaminate.decontaminate(frame(spark, ["é one, TWO -- three! four"]), bench, ["doc_id", "text"], with_spans=True).first()
    assert [r.text.encode()[s.start : s.stop].decode() for s in r.spans] == ["TWO -- three"]


# language


def test_language(spark):
    draw = random.Random(1)
    make = {"de": ["ung", "sch", "der", "ein"], "fr": ["eau", "oux", "les", "ment"]}
    rows = [(i, " ".join("".join(draw.choice(make[g]) for _ in range(2)) for _ in range(40)), g, "x", "y") for i, g in enumerate(["de", "fr"] * 40)]
    rows += [(100, None, "de", "x", "y"), (101, "", "de", "x", "y"), (102, "123 !!", "fr", "x", "y"), (103, "der", None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, rejected string")
    found = language.fit(df, F.col("doc_id") % 4 != 2)
    got = table(language.classify(df, found, ["doc_id"]))
    assert all(got[i].lang_pred == g for i, _, g, _, _ in rows[:80])
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (100, 101, 102))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.classify(df, {}, ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert language.fit(df.limit(0), F.lit(True)) == {}
    assert language.classify(df.limit(0), found, ["doc_id"]).count() == 0
    twice = language.classify(df.unionAll(df).withColumn("score", F.lit("mine")), found, ["doc_id", "score", "lang"])
    assert twice.columns == ["doc_id", "lang", "lang_pred", "score", "rejected"] and twice.distinct().count() == df.count()
    many = language.fit(df, F.lit(True), sample_bytes=1000, total_bytes=1000)
    assert all(8 <= len(v) <= 500 for v in many.values()) and set(many) == {"de", "fr"}
    assert set(language.fit(spark.createDataFrame([(1, "a", "xx"), (2, "b" * 40_000, "yy")], "doc_id long, text string, lang string"), F.lit(True))) == {"xx"}


def test_language_of_held_out_rows(spark):
    """Accuracy on rows that the fit doesn't see."""
    draw = random.Random(8)
    made = {g: ["".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(300)] for g, letters in (("de", "aeinrstußä"), ("fr", "aeiloupéèc"), ("es", "aeosnrñíld"))}
    rows = [(i, " ".join(draw.choice(made[g]) for _ in range(draw.choice([6, 30, 300, 20_000 if i < 3 else 40]))), g) for i, g in enumerate(["de", "fr", "es"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    got = language.classify(df.where(held), language.fit(df, ~held), ["doc_id", "lang"]).collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


# shards


def test_shards(spark):
    draw = random.Random(2)
    rows = [(draw.randint(0, 500), "é" * draw.randint(0, 300)) for _ in range(700)] + [(None, "n"), (None, None), (7, None), (7, "dup"), (7, "dup"), (900, "y" * 40_000)]
    got = shard.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i is not None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, upto = sum(r.size for r in got), 0
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.shard == min(7, (2 * upto + r.size) * 8 // (2 * total))
        upto += r.size
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert shard.shard_by_bytes(empty(spark)).count() == 0
    clash = spark.createDataFrame([(i, "t" * i, "p", 7, "b") for i in range(20)], "doc_id long, text string, part string, size int, before string")
    out = shard.shard_by_bytes(clash, 4, ["doc_id", "part", "size", "before"])
    assert out.columns == ["doc_id", "part", "before", "size", "text_crc32", "shard", "slot"] and {(r.part, r.before) for r in out.collect()} == {("p", "b")}


def test_blocks_of_cuts(spark):
    cuts = sorted(random.Random(5).sample(range(1000), 150))
    got = spark.range(1000).withColumnRenamed("id", "doc_id").select("doc_id", shard._below(cuts, 16).alias("n")).collect()
    assert all(r.n == sum(c < r.doc_id for c in cuts) for r in got)


# exact dedup


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(str.maketrans(exact_upper, exact_upper.lower())), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


exact_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPIES = [(1, "Aé"), (2, "aé"), (3, "aÉ"), (4, None), (5, ""), (6, "zz"), (7, "b" * 9000), (8, "B" * 9000), (9, "qq"), (None, "aé"), (None, "only"), (9, "qq")]


@pytest.mark.parametrize("digest", [exact.sha256, F.length])
def test_exact_dedup(spark, digest):
    """With a digest that clashes, the check of full bytes tells the texts apart."""
    got = exact.deduplicate(spark.createDataFrame([(i, t, "x") for i, t in COPIES], "doc_id long, text string, keep_id string"), digest).drop("locator")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_exact(COPIES)


def test_exact_dedup_of_nothing(spark):
    assert exact.deduplicate(empty(spark)).count() == 0


def test_dedup_state_outlives_a_batch(spark, tmp_path):
    kinds = "doc_id long, digest string, text_sha256 string, locator string"
    state = lambda: exact.DedupState(spark, f"file://{tmp_path}/state")
    put = lambda *rows: spark.createDataFrame(list(rows), kinds).write.mode("append").parquet(f"file://{tmp_path}/in")
    put((1, "a", "a", "f#1"), (2, "b", "b", "f#2"))
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    state().update(f"file://{tmp_path}/in", schema)
    put((5, "a", "a", "g#5"))
    got = table(exact.latest(state().update(f"file://{tmp_path}/in", schema)), "digest")
    assert (got["a"].keep_id, got["a"].group_size, got["a"].locator, got["b"].group_size) == (5, 2, "g#5", 1)


# near duplicates


def brute_near(rows, percent):
    sets = {i: set(minhash.shingles_of([(t or "").encode()])[0].tolist()) for i, t in rows}
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in keys}


def near_copies(draw, n):
    word = lambda: draw.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(draw.randint(0, 30))
    out = []
    for _ in range(6):
        base = [word() for _ in range(draw.randint(3, 120))]
        for _ in range(n):
            t = list(base)
            for _ in range(draw.randint(0, 4)):
                t[draw.randrange(len(t))] = word()
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("most", "block"), [(256, 256), (3, 256), (0, 5)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, most, block):
    monkeypatch.setattr(minhash, "MOST_PAIRS", most)
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_copies(random.Random(8), 14) + [None, "", " \t", "One Two", "one two", "one two three", "w " * 6000]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows] + [(None, "one two", "x", "y")], "doc_id long, text string, n string, component string")
    got = minhash.near_duplicates(df, 85).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == brute_near(rows, 85)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_min_max_signature():
    x = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    s = minhash.signature(x)
    assert len(s) == 2 * minhash.PERMUTATIONS
    y = np.concatenate([x[50:], np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)])
    assert abs((s == minhash.signature(y)).mean() - 450 / 550) < 0.12


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 260)]
    root = {}
    for a, b in links:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(len(links)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k in linked}


# suffix-array dedup


def brute_repeats(rows, length):
    seen = {}
    key = lambda t, i: xxhash.xxh3_64_intdigest(t[i : i + length])
    for _, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - length + 1):
            seen[key(t, i)] = seen.get(key(t, i), 0) + 1
    out = {}
    for d, t in rows:
        t = (t or "").encode()
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[key(t, i)] > 1:
                cover[i : i + length] = b"\1" * length
        runs = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out[d] = (len(t), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("most", [1500, 4])
def test_repeats_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_MEMBERS", most)
    draw = random.Random(5)
    base = ["".join(draw.choice("ab é") for _ in range(draw.randint(150, 600))) for _ in range(12)]
    texts = [("x" * draw.randint(0, 30)).join([draw.choice(base)[draw.randint(0, 100) : draw.randint(100, 600)] for _ in range(draw.randint(0, 4))]) + str(i) for i in range(120)]
    texts += [None, "", "a" * 3000, "a" * 199, "é" * 400, "copy " * 60, "copy " * 60]
    got = table(suffix.remove_repeats(frame(spark, texts)))
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_repeats(list(enumerate(texts)), 200)


def test_repeats_of_rows_that_share_or_lack_an_id(spark):
    draw = random.Random(15)
    part = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    one, two = part(230), part(260)
    rows = [(1, part(40) + one), (None, part(30) + one + part(50)), (2, part(10)), (2, two + part(9)), (3, part(77) + two), (2, two + one), (4, part(300)), (4, part(300)), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    got = suffix.remove_repeats(df).collect()
    want = brute_repeats([(k, t) for k, (_, t) in enumerate(rows)], 200)
    assert sorted(map(tuple, got), key=repr) == sorted(((rows[k][0], *v) for k, v in want.items()), key=repr)


@pytest.mark.parametrize("most", [1500, 4])
def test_repeats_leave_only_what_the_result_reads(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_MEMBERS", most)
    draw, made, freed = random.Random(25), [], []
    stored, free = common.stored, common.free
    monkeypatch.setattr(common, "stored", lambda df, name: made.append((name, out := stored(df, name))) or out)
    monkeypatch.setattr(common, "free", lambda session, *tables: freed.append(len(made)) or free(session, *tables))
    part = "".join(draw.choice("abcdefgh") for _ in range(260))
    texts = [part[draw.randint(0, 20) :] + "".join(draw.choice("abcdefgh") for _ in range(draw.randint(9, 90))) for _ in range(30)] + ["z" * 300] * 2
    found = suffix.remove_repeats(frame(spark, texts))
    there = {name for name, t in made if os.path.exists(t._veldspar_path.removeprefix("file:"))}
    assert there == {"heads", "copies", "done"}
    assert max(b - a for a, b in zip([0, *freed], [*freed, len(made)], strict=True)) <= 3  # the driver forgets finished plans after each step
    assert {i: tuple(r)[1:] for i, r in table(found).items()} == brute_repeats(list(enumerate(texts)), 200)


def test_no_repeats_of_nothing(spark):
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_maximal_repeats_list_all_occurrences():
    words = [b"xabcde", b"yabcdf", b"xabcde", b"zzzzzz"]
    members = [(w[:1][::-1], w[1:]) for w in words]
    got = {(left, right, tuple(sorted(who))) for left, right, who in suffix.maximal_repeats(members, 3)}
    assert (0, 4, (0, 1, 2)) in got and (1, 5, (0, 2)) in got


def test_anchors_depend_on_content_only():
    draw = random.Random(2)
    body = bytes(draw.choice(b"abcdef") for _ in range(900))
    a = {p: h for h, p, _, _ in suffix.anchors(body)}
    b = {p - 37: h for h, p, _, _ in suffix.anchors(b"#" * 37 + body)}
    assert sum(b.get(p) == h for p, h in a.items()) >= len(a) - 2


# chains


def test_chain_prefers_collinear_runs():
    path = [(i, 100 + i, 5) for i in range(0, 60, 6)]
    assert chains.chain([*path, (10, 500, 5), (30, 3, 5), (55, 700, 5)])[0] == path
    far = chains.chain([(0, 0, 5), (5, 5, 5), (400, 400, 5), (405, 405, 5)])
    assert sorted(map(len, far)) == [2, 2]
    x = np.array([3, 4, 9, 40, 2])
    assert sorted(chains.runs(x, x + np.array([7, 7, 7, 7, 9]))) == [(2, 11, 5), (3, 10, 11), (40, 47, 5)]


def test_chain_of_overlapping_runs_is_the_best_one():
    draw = random.Random(12)
    for _ in range(60):
        found = sorted({(draw.randint(0, 60), draw.randint(0, 60), draw.randint(5, 12)) for _ in range(9)})

        def best(run, rest):
            x, y, n = run
            return n + max([0, *(best(q, rest) - chains.GAP * (x + y - q[0] - q[1] - 2 * q[2]) for q in rest if q[0] + q[2] - 4 <= x and q[1] + q[2] - 4 <= y)])

        path = chains.chain(found)[0]
        score = path[0][2]
        for (x, y, n), (u, v, m) in zip(path, path[1:], strict=False):
            assert x + n - 4 <= u and y + n - 4 <= v
            score += m - chains.GAP * (u + v - x - y - 2 * n)
        assert abs(score - max(best(r, found) for r in found)) < 1e-9


def test_fuzzy_passages(spark):
    draw = random.Random(9)
    word = lambda: "w" + str(draw.randint(0, 5000))
    passage = [word() for _ in range(80)]
    texts = []
    for i in range(12):
        p = list(passage)
        for _ in range(3):
            p[draw.randrange(80)] = word()
        texts.append(" ".join([word() for _ in range(draw.randint(20, 90))] + p + [word() for _ in range(50)]))
    texts += [" ".join(word() for _ in range(200)) for _ in range(10)] + [" ".join([*(word() for _ in range(60)), *passage[:20], *(word() for _ in range(60))]), None, "", "the same words", " ".join(passage[:60]), " ".join(passage[:60])]
    got = table(chains.fuzzy_passages(frame(spark, texts)))
    assert set(got) == {*range(12), 26, 27}
    for i in range(12):
        assert got[i].n_passages == 1 and 60 <= got[i].n_covered <= 90
    assert (got[26].n_covered, got[27].n_links >= 1) == (60, True)
    assert chains.fuzzy_passages(empty(spark)).count() == 0


def _similar_windows(a, b, least, similarity):
    """Brute force: is there a stretch of `least` words or more on any diagonal with so many words equal?"""
    x, y = np.array(a), np.array(b)
    for shift in range(least - len(b), len(a) - least + 1):
        u, v = x[max(0, shift) :], y[max(0, -shift) :]
        n = min(len(u), len(v))
        total = np.concatenate(([0], np.cumsum(u[:n] == v[:n])))
        for k in range(least, min(n, 2 * least) + 1):
            if (total[k:] - total[:-k] >= similarity * k).any():
                return True
    return False


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _pair(draw, word, similarity, n):
    p = [word() for _ in range(n)]
    q = list(p)
    for i in draw.sample(range(n), round(n * (1 - similarity))):
        q[i] = word()
    return [[word() for _ in range(draw.randint(0, 60))] + x + [word() for _ in range(draw.randint(0, 60))] for x in (p, q)]


def test_fuzzy_passages_against_brute_force(spark):
    """Every passage found is one; with every seed all are found that have five equal words in a row, with one in four 95 of 100 at least."""
    draw = random.Random(4)
    word = lambda: "w" + str(draw.randint(0, 50_000))
    texts = [t for s in (0.7, 0.8, 0.82, 0.85, 0.9, 0.95) for n in (50, 60, 80) for _ in range(5) for t in _pair(draw, word, s, n)]
    df = frame(spark, list(map(" ".join, texts)))
    wanted = [i for i in range(0, len(texts), 2) if _similar_windows(texts[i], texts[i + 1], chains.LEAST_WORDS, chains.SIMILARITY)]
    assert len(wanted) > 70
    for density, share in ((1, 1.0), (chains.DENSITY, 0.95)):
        got = table(chains.fuzzy_passages(df, density=density))
        assert sum(i in got and i + 1 in got for i in wanted) >= share * len(wanted)
        for i in (i for i in range(0, len(texts), 2) if i in got):  # with gaps it may be similar where no diagonal is
            s, t = got[i].passages[0], got[i + 1].passages[0]
            a, b = texts[i][s.start : s.stop], texts[i + 1][t.start : t.stop]
            assert min(len(a), len(b)) >= chains.LEAST_WORDS and 2 * _lcs(a, b) >= chains.SIMILARITY * (len(a) + len(b)) - 1e-9


def test_fuzzy_passages_of_stock_phrases_against_all_pairs(spark):
    """Every line stands in many documents, so no seed is rare; what all pairs of documents share is found all the same."""
    draw = random.Random(21)
    word = lambda: "w" + str(draw.randint(0, 50_000))
    lines = [[word() for _ in range(12)] for _ in range(14)]
    texts = []
    for i in range(240):
        t = [w for _ in range(3) for w in draw.choice(lines)]
        texts.append([word() for _ in range(draw.randint(20, 40))] + t + [word() for _ in range(draw.randint(20, 40))])
    for i in range(0, 40, 2):
        shared = [w for k in draw.sample(range(14), 6) for w in lines[k]]
        for j in (i, i + 1):
            texts[j] = texts[j][:20] + shared + texts[j][-20:]
    got = table(chains.fuzzy_passages(frame(spark, list(map(" ".join, texts)))))
    held = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 49):
            held.setdefault(tuple(t[k : k + 50]), set()).add((i, k))
    want = {}
    for where in held.values():
        if len({i for i, _ in where}) > 1:
            for i, k in where:
                want.setdefault(i, set()).update(range(k, k + 50))
    assert len(want) >= 40
    for i, words in want.items():  # exactly repeated words are covered
        assert i in got, i
        assert not words - {w for s in got[i].passages for w in range(s.start, s.stop)}, i


def test_fuzzy_passages_of_a_common_line_against_all_pairs(spark, monkeypatch):
    """One line stands in all documents; around it some pairs are similar without five equal words in a row, so that line is their only seed."""
    draw = random.Random(31)
    word = lambda: "w" + str(draw.randint(0, 50_000))
    line, texts = [word() for _ in range(12)], []
    for i in range(120):
        before, after = [word() for _ in range(60)], [word() for _ in range(60)]
        if i % 4 == 1 and i < 80:  # the one before, with every fifth word another
            before, after = ([w if k % 5 else word() for k, w in enumerate(x)] for x in near)
        near = before, after
        texts.append([*before, *line, *after])
    want = {i for i in range(80) if i % 4 < 2}
    for block in (chains.BLOCK, 32):
        monkeypatch.setattr(chains, "BLOCK", block)
        got = table(chains.fuzzy_passages(frame(spark, list(map(" ".join, texts)), 0), density=1))
        assert set(got) == want
        assert {i: r.component_id for i, r in got.items()} == {i: i // 4 * 4 for i in want}


def test_fuzzy_passages_of_a_large_family(spark):
    """Near copies in a group of one hot seed after the other: one class, and the stretch that two of them alone share longer is covered."""
    draw = random.Random(32)
    word = lambda: "w" + str(draw.randint(0, 50_000))
    core = [word() for _ in range(70)]
    texts = [[*(word() for _ in range(40)), *core, *(word() for _ in range(40))] for _ in range(150)]
    texts[90][110:125] = texts[30][110:125]
    got = table(chains.fuzzy_passages(frame(spark, list(map(" ".join, texts)), 0)))
    assert set(got) == set(range(150)) and {r.component_id for r in got.values()} == {0}
    assert all(any(s.start <= 40 and s.stop >= (125 if i in (30, 90) else 110) for s in r.passages) for i, r in got.items())
def test_matched_counts_as_common_does():
    draw = np.random.default_rng(5)
    for n, m in ((64, 64), (64, 5), (7, 64), (0, 64)):
        a, b = draw.integers(0, 9, n).astype(np.uint32), draw.integers(0, 9, (40, m)).astype(np.uint32)
        ia, ib = draw.random(n) < 0.8, draw.random((40, m)) < 0.8
        got = chains._matched(a, ia, b, ib)
        assert got.tolist() == [chains._common(a[ia], y[i]) for y, i in zip(b, ib, strict=True)]


def test_places_with_equal_words_in_another_order_are_not_aligned(monkeypatch):
    side = np.arange(chains.REACH, dtype=np.uint32)
    other = side.reshape(-1, 2)[::-1].ravel()  # the same word pairs, last first: words and neighbours are shared, no passage is
    words = np.stack([np.concatenate((x, 900 + np.arange(chains.WIDTH, dtype=np.uint32), 100 + x)) for x in (side, other)])
    tried = []
    monkeypatch.setattr(chains, "align", lambda *a, f=chains.align, **b: tried.append(a) or f(*a, **b))
    assert not len(chains.meet(words, np.ones(words.shape, bool), np.array([1, 2]), 0, chains.LEAST_WORDS, chains.SIMILARITY))
    assert not tried




def _around(draw, n, equal):
    """Surroundings of n places of one seed: words that differ from place to place but where `equal` says so."""
    words = draw.integers(0, 2**32, (n, 2 * chains.REACH + chains.WIDTH), dtype=np.uint32)
    words[:, equal] = words[0, equal]
    words[:, chains.REACH : chains.REACH + chains.WIDTH] = 7
    return words


def test_places_with_too_few_words_in_any_stretch_are_not_aligned(monkeypatch):
    n, tried = 40, []
    words = _around(np.random.default_rng(6), n, np.arange(2 * chains.REACH + chains.WIDTH) % 4 < 2)  # half of the words in order, nowhere four in five
    monkeypatch.setattr(chains, "align", lambda *a, f=chains.align, **b: tried.append(a) or f(*a, **b))
    assert not len(chains.meet(words, np.ones(words.shape, bool), np.arange(n), 0, chains.LEAST_WORDS, chains.SIMILARITY))
    assert len(tried) <= n  # of 780 pairs, one a place


@pytest.mark.parametrize(("least", "similarity"), [(50, 0.8), (60, 0.83), (20, 0.9), (4, 0.8)])
def test_bound_on_alignment_loses_no_passage(least, similarity):
    draw = np.random.default_rng(7)
    words, n = draw.integers(0, 4, (300, 2 * chains.REACH + chains.WIDTH)).astype(np.uint32), 4000
    for k in range(1, 300):  # near copies of one another, with words lost and added
        row = [w for w in words[k - 1].tolist() if draw.random() > 0.06] + [0] * 200
        words[k] = [w if draw.random() > 0.06 else 5 + k for w in row[: words.shape[1]]]
    words[:, chains.REACH : chains.REACH + chains.WIDTH] = 7
    inside = np.abs(np.arange(words.shape[1]) - chains.REACH) <= draw.integers(chains.WIDTH, 2 * chains.REACH, (300, 1))
    words[~inside] = 0
    i, j = draw.integers(0, 300, n), draw.integers(0, 300, n)
    may = chains._may_align(words, inside, i, j, least, similarity)
    at = [int(x) for x in inside[:, : chains.REACH].sum(axis=1)]
    found = [bool(chains.align(words[x][inside[x]], words[y][inside[y]], [(at[x], at[y], chains.WIDTH)], least=least, similarity=similarity)) for x, y in zip(i, j, strict=True)]
    assert not (np.array(found) & ~may).any() and any(found)


def _runs_of_one_word(draw, n):
    """Texts that have runs of the word 7 between stretches that some of them share, often with the word 7 close by."""
    shared = [draw.integers(8, 11 if k % 2 else 60, 12).tolist() for k in range(6)]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(draw.integers(1, 3)):
            text += shared[draw.integers(6)][: draw.integers(4, 13)] + [7] * int(draw.integers(0, 5)) + draw.integers(8, 10**6, draw.integers(0, 9)).tolist() + [7] * int(draw.integers(5, 30))
        texts.append(np.array(text + shared[draw.integers(6)], np.uint32))
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_one_word_meet_like_all_their_places(seed):
    texts, least, similarity = _runs_of_one_word(np.random.default_rng(seed), 8), 22 + seed, 0.8
    mid, rows, places = chains.REACH, [], []
    for d, t in enumerate(texts):
        at = [k for k in range(len(t) - 4) if (t[k : k + 5] == 7).all()]
        places += [(d, k) for k in at]
        for k in at:
            if k - 1 not in at:
                n = next((m for m in range(k, len(t)) if t[m] != 7), len(t)) - k
                rows.append((d, k, n, t[max(0, k - mid) : k], t[k + n : k + n + mid]))
    words, inside = np.zeros((len(rows), 2 * mid + chains.WIDTH), np.uint32), np.zeros((len(rows), 2 * mid + chains.WIDTH), bool)
    for row, ok, (_, _, _, before, after) in zip(words, inside, rows, strict=True):
        row[mid : mid + chains.WIDTH] = 7
        row[mid - len(before) : mid], row[mid + chains.WIDTH : mid + chains.WIDTH + len(after)] = before, after
        ok[mid - len(before) : mid + chains.WIDTH + len(after)] = True

    def classes(pairs):
        up = list(range(len(texts)))
        for _ in texts:
            for x, y in pairs:
                up[x] = up[y] = min(up[x], up[y])
        return up

    links, want = set(), set()
    for d, p in places:
        for e, q in places:
            if d < e and chains.align(texts[d], texts[e], [(p, q, chains.WIDTH)], least=least, similarity=similarity):
                links.add((d, e))
                want |= {(d, p), (e, q)}
    docs, size = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    for split in (0, len(rows) // 2):
        found, got = set(), set()
        for part, halves in ((slice(0, len(rows)), split), *([(slice(0, split), 0), (slice(split, None), 0)] if split else [])):
            for i, j, oi, oj, n in chains.meet_runs(words[part], inside[part], size[part], docs[part], halves, least, similarity).tolist():
                (d, p, *_), (e, q, *_) = rows[part][i], rows[part][j]
                assert d != e and oi + n <= size[part][i] and oj + n <= size[part][j]
                assert chains.align(texts[d], texts[e], [(p + oi, q + oj, n)], least=least, similarity=similarity)
                found.add((d, e))
                got |= {(d, p + oi + k) for k in range(n - 4)} | {(e, q + oj + k) for k in range(n - 4)}
        assert classes(found) == classes(links) and got == want and links


def test_matches_of_a_run_of_one_word_grow_with_its_length_only(spark):
    draw = random.Random(34)
    word = lambda: "w" + str(draw.randint(0, 50_000))
    texts = [" ".join([*(word() for _ in range(30)), *["of"] * (100 + i), *(word() for _ in range(30))]) for i in range(60)]
    docs = frame(spark, texts, 0)
    h, n = chains.seeds(common.hashed_words([b"of of of of of"])[0], np.array([5]), 1)[0].view(np.int64)[0], 60 * 96 + sum(range(60))
    places = spark.createDataFrame([(int(h), i, list(range(30, 126 + i))) for i in range(60)], "h long, doc_id long, ps array<int>")
    sizes = spark.createDataFrame([(int(h), n, 60)], "h long, n long, starts long")
    ids = chains._profiles(docs, 1).where("p < 0").select("doc_id", "t")
    found = chains._hot(docs, places, sizes, ids, chains.LEAST_WORDS, chains.SIMILARITY).collect()
    assert {i for r in found for i in (r.a, r.b)} == set(range(60)) and len(found) < n  # all places of all runs were handed on before, each with a match of its own
    got = table(chains.fuzzy_passages(docs, density=1))
    assert {r.component_id for r in got.values()} == {0} and all(got[i].n_covered >= 100 + i for i in range(60))


def test_meet_keeps_what_all_pairs_connect():
    draw = np.random.default_rng(5)
    n, width, mid = 90, 2 * chains.REACH + chains.WIDTH, chains.REACH
    words = draw.integers(0, 2**32, (n, width), dtype=np.uint32)
    words[:, mid : mid + chains.WIDTH] = 7
    for i in range(0, 60):  # a chain of families, each of which has one stretch in common with the next
        low = mid - (i % 4) * 16
        words[i, low : low + 69] = np.random.default_rng(i // 20).integers(0, 2**32, 200, dtype=np.uint32)[low - 16 : low + 53]
        words[i, mid : mid + chains.WIDTH] = 7
    inside, docs = np.ones((n, width), bool), np.arange(n)

    def linked(x, y):
        found = [chains.align(words[x], words[y], [(mid, mid, chains.WIDTH)])]
        return bool(found[0])

    def classes(pairs):
        up = list(range(n))
        for _ in range(n):
            for x, y in pairs:
                up[x] = up[y] = min(up[x], up[y])
        return up

    want = classes([(x, y) for x in range(n) for y in range(x) if linked(x, y)])
    for split in (0, 35):
        got = [(x, y) for x, y in chains.meet(words, inside, docs, split, chains.LEAST_WORDS, chains.SIMILARITY).tolist() if linked(x, y)]
        if split:
            assert all(x < split <= y for x, y in got)
            for part in (slice(0, 35), slice(35, n)):
                more = chains.meet(words[part], inside[part], docs[part], 0, chains.LEAST_WORDS, chains.SIMILARITY) + (part.start or 0)
                got += [(x, y) for x, y in more.tolist() if linked(x, y)]
        assert classes(got) == want and len(set(want)) < n


def test_fuzzy_passages_free_what_they_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    draw = random.Random(33)
    passage = " ".join("w" + str(draw.randint(0, 50_000)) for _ in range(70))
    assert chains.fuzzy_passages(frame(spark, [passage + " one", passage + " two", "three"], 0)).count() == 2
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "veldspar").iterdir()} <= {"heads", "texts-found"}


def test_fuzzy_passages_of_odd_rows(spark):
    draw = random.Random(2)
    word = lambda: "w" + str(draw.randint(0, 50_000))
    one, two = ([word() for _ in range(70)] for _ in range(2))
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one + [word() for _ in range(9)])), (3, " ".join([word() for _ in range(9)] + two)), (None, " ".join(one)), (4, " ".join(two)), (4, " ".join(two)), (5, " ".join([*one, *two] + [word() for _ in range(30_000)])), (6, None), (7, "")]
    got = chains.fuzzy_passages(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, h string, passages string")).collect()
    assert len({r.doc_id for r in got}) == len(got) and {2, 3, 4, 5} <= {r.doc_id for r in got} <= {1, 2, 3, 4, 5}
    assert [(s.start, s.stop) for r in got if r.doc_id == 5 for s in r.passages] == [(0, 140)]


# toxicity and quality


def labelled(spark):
    draw = random.Random(6)
    word = lambda: draw.choice("stone river light walk house green paper often".split())
    rows, marks = [], []
    for i in range(300):
        toxic, poor = i % 3 == 0, i % 5 == 0
        t = [word() for _ in range(40)]
        if toxic:
            t[draw.randrange(40)] = draw.choice(["dolt", "blockheads", "blockheaded"])
            t[draw.randrange(40)] = "dolt"
        text = " ".join(t) if not poor else " ".join(x + "###" for x in t)
        rows.append((i, text, "x"))
        marks.append((i, int(not poor), int(toxic)))
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 30_000, "x")]
    marks += [(901, None, None), (5000, 1, 1), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    g = toxicity.train(docs, labels, F.lit(True))
    got = table(toxicity.score(docs, g, ["doc_id"]))
    assert sum(got[i].predicted == (i % 3 == 0) for i in range(300)) >= 297
    assert got[900].predicted == got[901].predicted == got[902].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    plain = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert toxicity.score(docs, plain, ["doc_id"]).where("predicted = 1").count() == 0


def test_toxic_marks_carry_their_context():
    g = toxicity.Grammar({"=dolt": 3.0}, np.zeros(len(toxicity.KINDS) + 5))
    kinds = lambda t: [toxicity.KINDS[k] for c in g.clauses(t) for k, _ in c]
    assert kinds("a dolt") == ["I"] and kinds("you utter dolt") == ["Id"]
    assert kinds("not a dolt") == ["In"] and kinds("she said you dolt") == ["Idr"]
    assert kinds("he said. a dolt") == ["I"] and kinds("kill them") == ["Td"] and kinds("you kill") == ["Td"]
    assert kinds("she said: you dolt") == ["Idr"] and kinds('he said, "you dolt"') == ["Idr"] and kinds("you dolt, he said") == ["Idr"]
    assert kinds("kill") == ["T"] and kinds("dolt you are") == ["Id"] and kinds("a dolt, not one") == ["I"] and kinds("no one will kill you") == ["Tdn"]


@pytest.mark.parametrize(("op", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_learned_scores_of_held_out_rows(spark, op, label):
    docs, labels = labelled(spark)
    held = common.crc_mod(F.col("doc_id"), 3) == 1
    model = op.train(docs, labels, ~held)
    marks = {r.doc_id: r[label] for r in labels.where("doc_id < 300").collect()}
    got = table(op.score(docs.where(held), model, ["doc_id"]))
    assert len(got) > 80 and sum(got[i].predicted == marks[i] for i in got if i in marks) >= 0.95 * len(set(got) & set(marks))
    assert op.score(docs.limit(0), model, ["doc_id"]).count() == 0
    twice = op.score(docs.union(docs), model, ["doc_id", "score"])
    assert twice.columns == ["doc_id", "score", "predicted"] and twice.distinct().count() == docs.count()


def test_quality(spark):
    docs, labels = labelled(spark)
    r = quality.train(docs, labels, F.lit(True))
    got = table(quality.score(docs, r, ["doc_id"]))
    assert sum(got[i].predicted == (i % 5 != 0) for i in range(300)) >= 295
    assert all(0 <= x.score <= 1 for x in got.values())
    none = quality.train(docs, labels.limit(0), F.lit(True))
    assert {x.score for x in table(quality.score(docs, none, ["doc_id"])).values()} == {0.5}


def test_quality_learns_from_every_label(spark):
    """Knots and threshold are order statistics of all rows, long texts too, and every row stands in a pair."""
    draw = random.Random(8)
    texts = [" ".join("Word" + str(draw.randint(0, 99)) for _ in range(draw.randint(5, 60))) + (". Good" if i % 3 else " ## 77 ##") * 3 for i in range(7000)]
    texts[1] = "Long words. " * 4000
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(7000)], "doc_id long, quality int")
    r = quality.train(docs, labels, F.lit(True))
    x = np.array([quality.features(t) for t in texts])
    assert np.array_equal(r.knots, np.quantile(x, quality.KNOTS, axis=0, method="lower"))
    assert np.allclose(r.scale, np.maximum(x.std(axis=0), 1e-6))
    raw = np.sort(r.raw(x))
    poor = sum(i % 3 == 0 for i in range(7000))
    assert abs(r.threshold - (raw[poor - 1] + raw[poor]) / 2) < 1e-6
    for y in ([1] * 7 + [0] * 2, [0] * 9 + [1], [1, 0]):
        a, b = quality.pairs_of(np.array(y))
        assert sorted({*a.tolist(), *b.tolist()}) == list(range(len(y))) and len(a) == len(b)



def test_samples_are_bounded(spark):
    docs, labels = labelled(spark)
    assert learn.sample(docs, labels, "toxic", F.lit(True), 10).count() == 20


def test_pair_of_rows_with_both_labels_is_left_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in learn.sample(docs, labels, "toxic", F.lit(True)).collect()) == [2, 3]


def test_memory_of_words_is_bounded():
    m = common.Memo(len, 1000)
    assert [m["a" * i] for i in range(200)] == list(range(200)) and len(m) + len(m.old) <= 12
    assert [m["a" * i] for i in range(200)] == list(range(200))


def test_hashed_words_do_not_depend_on_what_stands_around():
    words = ["a", "B", "ab", "ba", "é", "x" * 700_000]
    want = {w.lower(): int(common.hashed_words([w.encode()])[0][0]) for w in words}
    assert len(set(want.values())) == len(words)
    draw = random.Random(1)
    texts = [[draw.choice(words) for _ in range(draw.randint(0, 6))] for _ in range(60)]
    h, n = common.hashed_words([None, *(("\t" + " \n".join(t)).encode() for t in texts)])
    assert n.tolist() == [0, *map(len, texts)] and h.tolist() == [want[w.lower()] for t in texts for w in t]
