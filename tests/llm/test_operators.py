import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import chat, decontamination, jaccard_join, language_id, mixing, quality, queries, tiff, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "ñ", "es", "a"), (5, "a b", "en", "b"), (5, "a b", "en", "b"), (6, "x" * 200_000, "en", "b"), (None, "word " * 30, None, "c")]
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).selectExpr("*", "'x' score", "1 n_shingles", "2 component_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    links = {i: {j for j, b in sets.items() if i != j and a and den * len(a & b) >= num * len(a | b)} for i, a in sets.items()}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), min(seen), len(links[i]))
    return out


def test_sets_that_link_share_a_shingle_of_their_prefixes():
    rnd = np.random.default_rng(7)
    for num, den in ((9, 10), (4, 5)):
        sets = []
        for n in [*range(1, 60), 300, 2500]:
            a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            for _ in range(8):
                gone = int(rnd.integers(0, max(1, n * (den - num) // den) + 1))
                new = rnd.integers(0, 40, int(rnd.integers(0, gone + 2)), dtype=np.uint64) << np.uint64(30)
                sets.append(np.unique(np.concatenate([a[gone:], new])))
        keys, counts = jaccard_join._keys(sets)
        level = jaccard_join.levels(counts)
        got = [jaccard_join.ordered(s, level[np.searchsorted(keys, s >> np.uint64(16))], num, den) for s in sets]
        seen = collections.Counter()
        for x, (s, (v, p)) in enumerate(zip(sets, got, strict=True)):
            for t, (w, r) in zip(sets[:x], got[:x], strict=True):
                o = len(np.intersect1d(s, t))
                if o and den * o >= num * (len(s) + len(t) - o) and len(s) + len(t) > 2 * o:
                    assert len(np.intersect1d(v[:p], w[:r]))
                    seen["linked"] += 1
        assert seen["linked"] > 100


def test_packed_keys_round_trip():
    keys = np.unique(np.random.default_rng(9).integers(0, 1 << 48, 500, dtype=np.uint64))
    for x in (keys, keys[:1], np.array([0, (1 << 48) - 1], dtype=np.uint64)):
        assert (jaccard_join.unpack_keys(jaccard_join.pack_keys(x)) == x).all()
    bucket, at = jaccard_join._slices(keys, 5)
    assert at[-1] == len(keys) and all((keys[i:j] >> np.uint64(43) == b).all() for b, i, j in zip(bucket, at[:-1], at[1:], strict=True))


def test_a_walk_in_parts_finds_the_same_links(monkeypatch):
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 1 << 63, 80, dtype=np.uint64)
    sets = [np.unique(np.where(rnd.random(80) < 0.04, rnd.integers(0, 40, 80, dtype=np.uint64), base)) for _ in range(90)]
    whole = sorted(zip(*jaccard_join.trie_links(sets, 9, 10), strict=True))
    monkeypatch.setattr(jaccard_join, "WALK_BYTES", 500)
    assert whole and sorted(zip(*jaccard_join.trie_links(sets, 9, 10), strict=True)) == whole
    assert len(jaccard_join.trie_links(sets[:3], 1, 10)[0]) == 3


@pytest.mark.parametrize("block", [512, 64])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A b"), (904, "a")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == brute(rows, 3, 9, 10)


def test_jaccard_join_of_rows_repeated_whole_in_equal_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXT", 2000)
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        if i % 4 == 0:
            base = [f"w{rnd.randrange(3000)}" for _ in range(60)]
        w = list(base)
        w[rnd.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(w)))
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    d = spark.read.parquet(f"{tmp_path}/docs")  # two scans in a union keep their partitions
    want = {i: (n, c, 2 * links + 1) for i, (n, c, links) in brute(rows, 3, 8, 10).items()}
    got = jaccard_join.near_duplicates(d.union(d), 3, 8, 10).collect()
    assert len(got) == 240 and max(links for *_, links in want.values()) > 1
    assert all((r.n_shingles, r.component_id, r.n_links) == want[r.doc_id] for r in got)


def test_language_id(spark, docs, odd, empty):
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.detect(docs, model).collect()}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in docs.collect()]) > 0.95
    assert {r.doc_id: r.lang_pred for r in language_id.detect(odd, model).collect() if r.doc_id in (1, 2, 3)} == dict.fromkeys((1, 2, 3), "und")
    assert language_id.keep_identified(odd, model, 0.05).columns == odd.columns
    assert language_id.detect(empty, language_id.learn(empty)).count() == 0
    # The bundle is the sum of the bound vectors of the trigrams, counted one by one.
    import pyarrow as pa

    code = [0, 1, 2, 0]
    v = language_id._letters()
    want = sum(np.roll(v[a], 2).astype(int) * np.roll(v[b], 1) * v[c] for a, b, c in zip(code, code[1:], code[2:], strict=False))
    assert (next(language_id.bundles(pa.array(["Ab"])))[2][0][: len(want)] == want).all()


def test_a_bundle_does_not_depend_on_the_rows_beside():
    texts = ["ñ", "", "a", None, "the end", " ", "a", "x" * 50, "the end"]
    vectors = np.concatenate([v for _, _, v in language_id.bundles(pa.array(texts))])
    alone = np.concatenate([v for t in texts for _, _, v in language_id.bundles(pa.array([t], pa.string()))])
    assert np.array_equal(vectors, alone)
    assert [bool(v.any()) for v in vectors] == [any(c.isalpha() for c in t or "") for t in texts]
    letters = [0, *(ord(c) - 96 if c.isalpha() else 0 for c in "the end"), 0]
    grams = np.array([a << 12 | b << 6 | c for a, b, c in zip(letters, letters[1:], letters[2:])])
    assert np.array_equal(vectors[4], language_id._bound(grams).astype(np.int64).sum(axis=0))


def test_quality(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels)
    joined = got.join(labels, "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in joined]) > 0.95
    assert quality.keep_good(docs, labels).count() == got.where("keep").count()
    assert quality.classify(odd, labels).count() == len(ODD) and quality.classify(empty, labels.limit(0)).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_sparse_sites_shrink_toward_the_prior(spark):
    rows = [("big", "p", 3.0)] * 400 + [("bad", "p", -3.0)] * 400 + [("tiny", "p", -3.0)] + [(f"h{i}", "p", 2.0 if i % 2 else -2.0) for i in range(40)]
    s = {r.host: r.path_posterior for r in quality.sites(spark.createDataFrame(rows, "host string, path string, evidence double"), 0.0).collect()}
    assert s["bad"] < 0.2 < 0.3 < s["tiny"] < s["big"]


def test_toxicity_restores_and_scores(spark, odd, empty):
    rnd = random.Random(5)
    plain = ["the", "onion", "reads", "thing", "state", "horse", "later", "river", "paper", "great", "lost", "ideas", "audio", "ride", "pilot", "riot"]
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            w[rnd.randrange(30)] = "idiot"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn_characters(d)
    assert [toxicity.decode(x, model)[0] for x in ("idi0t", "idiiiiot", "l0$t")] == ["idiot", "idiot", "lost"]
    lexicon = toxicity.learn_lexicon(d, spark.createDataFrame(labels, "doc_id long, toxic int"), model)
    test = spark.createDataFrame([(1, "you idi0t"), (2, "a great river"), (3, None), (4, "i d i o t"), (5, "IDIOT!!")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(test, model, lexicon).collect()}
    assert min(got[1], got[4], got[5]) >= 0.3 > max(got[2], got[3]) and all(0 <= v <= 1 for v in got.values())
    assert toxicity.toxicity(odd, model, lexicon).count() == len(ODD) and toxicity.toxicity(empty, model, lexicon).count() == 0


@pytest.fixture(scope="module")
def insults(spark):
    """The model and the lexicon of made-up texts, and what scores texts by them."""
    rnd = random.Random(5)
    plain = "a you the onion reads thing state horse later river paper great lost ideas audio pilot riot young yours about fat tall old small are our un una el que muy tonto".split()
    rows, labels = [], []
    for i in range(600):
        w = [rnd.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            for bad in ("idiot", "loser", "stupid", "cabrón"):
                w[rnd.randrange(30)] = bad
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn_characters(d)
    lexicon = toxicity.learn_lexicon(d, spark.createDataFrame(labels, "doc_id long, toxic int"), model)
    return lambda texts: dict(zip(texts, toxicity.score(pa.array(texts), model, lexicon, {}), strict=True))


def test_toxicity_restores_stretched_and_long_words(insults):
    bad = ["l" + "o" * 40 + "ser", "you id" + "i" * 500 + "ot", "L" + "O" * 3000 + "s3r", "st" + "u" * 30 + "p" + "!" * 30 + "d", "1diot" + "-horse" * 10]
    good = ["h" + "o" * 60 + "rse", "x" * 200_000, "http://onion/" + "riv3r/" * 20]
    got = insults(bad + good)
    assert min(got[x] for x in bad) >= 0.3 > max(got[x] for x in good)


def test_toxicity_restores_what_is_spelt_out(insults):
    apart = " ".join
    bad = [apart("astupididiot"), apart("youidiot"), "1 d 1 o t", "s t u p ! d", "l 0 $ e r", "i.d.i.o.t", "i-d-i-o-t", "i_d_i_o_t", "you-i.d.i.o.t!!", "(I D I O T!!)", "un c a b r ó n", "the s. t. u. p. i. d. river"]
    bad += [apart("theriver" * n + "stupid" + "theriver" * n) for n in (2, 5, 60)] + [apart("theriver" * 4 + "thestupidpaper"), apart("youstuuuuupid"), apart("aloserreads")]
    good = [apart("thegreatriver"), "a b c d e f g", "1 2 3 4 a 5", "a | b | c | d", "! ! ! ! !", "e.g. U.S.A. i.e.", "é ñ ó ü"]
    got = insults(bad + good)
    assert {x for x in bad if got[x] < 0.3} == set() == {x for x in good if got[x] >= 0.3}


def test_decontamination_equals_full_scoring(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    tok = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) if w]
    items = {r.item_id: tok(r.text) for r in bench.collect()}
    n, avg = len(items), np.mean([len(w) for w in items.values()])
    df = collections.Counter(t for w in items.values() for t in set(w))
    grams = lambda w, k: {tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))}
    want = set()
    for d, text in rows:
        w = tok(text)
        for i, x in items.items():
            tf = collections.Counter(x)
            s = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / avg)) for t, c in tf.items()}
            q, a = map(tok, decontamination.split_item(next(r.text for r in bench.where(f"item_id = {i}").collect()))) if set(x) <= set(w) else (None, None)
            if q is None and sum(v for t, v in s.items() if t in set(w)) < 0.6 * sum(s.values()):
                continue
            if q is None:
                q, a = map(tok, decontamination.split_item(next(r.text for r in bench.where(f"item_id = {i}").collect())))
            for p in range(0, max(1, len(w)), 64):
                part, around = set(w[p : p + 128]), w[max(0, p - 64) : p + 192]
                if sum(v for t, v in s.items() if t in part) >= 0.6 * sum(s.values()):
                    have = lambda part, k, around=around: np.mean([g in grams(around, len(g)) for g in grams(part, k)])
                    if have(q, 3) >= 0.5 and have(a, 2) >= 0.5:
                        want.add((d, i))
    assert got == want and want
    assert decontamination.leaks(odd, bench).count() == 0 and decontamination.drop_leaks(odd, bench).count() == len(ODD)
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.leaks(empty, bench).count() == 0
    assert decontamination.drop_leaks(docs, bench).count() == docs.count() - len({d for d, _ in got})


def test_decontamination_finds_long_items(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" + "." * (i % 20 == 19) for i in range(n))
    items = [(n, text(n)) for n in (20, 100, 250, 300, 600, 1000)]
    docs = [(i, f"{text(rnd.randrange(400))} {t} {text(rnd.randrange(400))}") for i, t in items] + [(-1, text(3000)), (-2, items[-1][1][:1500])]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == {(i, i) for i, _ in items}
    assert {r.doc_id for r in decontamination.drop_leaks(docs, bench).collect()} == {-1, -2}


def test_decontamination_in_shards_and_slices(spark, monkeypatch):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randrange(900)}" + "." * (i % 20 == 19) for i in range(n))
    items = [(i, text(rnd.choice((15, 40, 90, 200)))) for i in range(60)] + [(100, None), (101, " . "), (102, "word " * 30), (None, text(25))]
    items += [(200 + i, items[0][1]) for i in range(3)] + [items[1]] * 3
    docs = [(i, f"{text(300)} {t or ''} {text(rnd.randrange(900))}") for i, t in items] + [(-1, None), (-2, ""), (-3, text(4000)), (-4, " ".join(t for _, t in items[:60]))]
    d, bench = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item_id", "2 score"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' id", "'y' t")
    whole = sorted((tuple(r) for r in decontamination.leaks(d, bench).collect()), key=repr)
    pairs = {(a, b) for a, b, *_ in whole}
    assert pairs >= {(i, i) for i, t in items if i not in (100, 101)} | {(-4, i) for i in range(60)} | {(0, 201), (200, 0)} and not {-1, -2, -3} & {a for a, _ in pairs}
    for name, value in (("SHARD_ITEMS", 9), ("PASS_SHARDS", 2), ("PASSAGES", 3)):
        monkeypatch.setattr(decontamination, name, value)
    assert sorted((tuple(r) for r in decontamination.leaks(d, bench).collect()), key=repr) == whole
    assert {r.doc_id for r in decontamination.drop_leaks(d, bench).collect()} == {i for i, _ in docs} - {a for a, _ in pairs}


def test_blocks_that_are_skipped_hold_nothing(spark):
    rnd = random.Random(10)
    word = lambda: f"w{rnd.randrange(1500)}" if rnd.random() < 0.8 else f"c{rnd.randrange(5)}"
    texts = [" ".join(word() for _ in range(rnd.randrange(10, 50))) for _ in range(40)]
    df = collections.Counter(x for t in texts for x in set(decontamination._item_hashes(t).view(np.int64).tolist()))
    (index,) = decontamination.build_indexes(list(range(40)), texts, df, 40, 30.0)
    passages = [" ".join(word() for _ in range(500)) + " " + t for t in texts]
    for _, _, w in decontamination.tokens(pa.array(passages)):
        at = np.minimum(np.searchsorted(index.terms, w.hash), len(index.terms) - 1)
        term = np.where(index.terms[at] == w.hash, at, -1)
        halves = -(-w.count // index.half)
        row = np.repeat(np.arange(len(w.count)), w.count)
        half = np.concatenate([[0], np.cumsum(halves)])[row] + (np.arange(len(term)) - w.first[row]) // index.half
        half_row = np.repeat(np.arange(len(w.count)), halves)
        opened, n = set(decontamination._pivots(index, term, half, half_row, 0.6)), 0
        for p in range(len(half_row)):
            own = set(term[(half == p) | ((half == p + 1) & (half_row[np.minimum(half, len(half_row) - 1)] == half_row[p]))].tolist())
            for b in range(len(index.slack)):
                shares = np.add.reduceat(index.block_shares[b] * np.array([t in own for t in index.block_terms[b]]), index.block_starts[b])
                n += (shares >= 0.6).any()
                assert (p, b) in opened or not (shares >= 0.6).any()
        assert n >= 40 and len(opened) < len(half_row) * len(index.slack)


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <<SYS>> kind \\"), (1, 1, "user", None), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (2, 0, None, "<"), (2, 1, "tool<", "x" * 5000), (2, 2, "assistant", "b"), (2, 2, "assistant", "a"), (None, 0, "user", "q")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 50) for i in range(1, 40)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.format_conversations(d, budget=200, history=60)
    assert w.where("window > 0 and n_repeated > 0").count() > 0 and w.where("conv_id = 3 and n_tokens > 200").count() == 0
    got = {r.conv_id: r for r in chat.digests(w).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest() and got[conv].n_turns == len(mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(d.limit(0))).count() == 0


def test_every_later_window_starts_with_the_system_turn():
    turns = [("system", "s " * 20), ("user", "u " * 60), ("assistant", "a " * 1000), ("user", "v " * 1010), ("assistant", "b " * 30)]
    got = list(chat.windows(iter(turns), 1024, 200, chat.counter()))
    assert [(repeated, n, tokens) for repeated, n, tokens, *_ in got] == [(0, 2, 80), (1, 2, 1020), (1, 2, 1030), (1, 2, 50)]
    assert len({text.split("<</SYS>>")[0] for *_, text, _ in got}) == 1


def test_warc(spark):
    big = "<p>é</p>" * 40
    rows = [(i, f"http://a{i % 7}.example.org/{i}?q\t%", big if i % 3 else f"{i}") for i in range(3000)] + [(9000, None, None), (9001, "no scheme", big), (None, "http://x/", big)]
    got = {r.page_id: r for r in warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and i != 1
        assert tuple(got[i])[1:] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None)
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tiff(spark, odd, empty):
    rnd = random.Random(1)
    for n in (0, 1, 300, 20_000):
        for letters in (2, 256):
            raw = bytes(rnd.randrange(letters) for _ in range(n))
            assert tiff.lzw_decode(tiff.lzw_encode(raw)) == raw and tiff.packbits_decode(tiff.packbits_encode(raw)) == raw
    got = tiff.digests(tiff.pages(tiff.store_texts(odd))).collect()
    assert len(got) == len(ODD)
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: (r.n_bytes, r.doc_id or 0)), sorted(ODD, key=lambda x: (len((x[1] or "").encode()), x[0] or 0)), strict=True):
        raw = (text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert tiff.digests(tiff.pages(tiff.store_texts(empty))).count() == 0
    long = bytes(rnd.randrange(256) for _ in range(192 * 5000))
    pages = tiff.directories(tiff.write(long))
    assert len(pages) == 2 and b"".join(tiff.pixels(tiff.write(long), f).tobytes() for f in pages) == long
    broken = tiff.pages(spark.createDataFrame([(1, b"II*\0junk"), (2, None)], "id int, media binary")).collect()
    assert len(broken) == 2 and all(r.error and r.page is None for r in broken)


def test_tiff_layouts(spark):
    rnd = random.Random(2)
    raw = bytes(rnd.choice((0, 0, 0, 7, rnd.randrange(256))) for _ in range(192 * 300))
    layouts = [(c, p, t, s) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (False, True) for s in (1, 2)]
    for layout in layouts:
        for order in "<>":
            got = tiff.read(tiff.write(raw, lambda _, x=layout: x, order))
            assert [r[7] for r in got] == [raw] and got[0][:7] == (0, 1, 64, 300, 3, layout[0], layout[1])
    # Every layout of the writer's choice is used, whatever the size of the pages.
    for rows in (1, 40):
        chosen = collections.Counter(tiff.choice(bytes(rnd.randrange(256) for _ in range(192 * rows))) for _ in range(400))
        assert len(chosen) == 24 and all(80 < sum(n for x, n in chosen.items() if x[0] == c) < 190 for c in (tiff.LZW, tiff.DEFLATE, tiff.PACKBITS))


def test_tiff_damage(spark):
    rnd = random.Random(3)
    page = tiff.PAGE_ROWS * tiff.ROW
    raw = bytes(rnd.randrange(4) for _ in range(2 * page + 192 * 5))
    good = tiff.write(raw, lambda _: (tiff.LZW, 1, False, 1))
    fields = tiff.directories(good)
    strip = fields[1][273][3]
    damaged = good[:strip] + b"\xff" * 40 + good[strip + 40 :]
    assert [(r[0], r[1], r[7] is None, r[8] is None) for r in tiff.read(damaged)] == [(0, 3, False, True), (1, 3, True, False), (2, 3, False, True)]
    assert [r[0] for r in tiff.read(good[: fields[2][273][0]])][:2] == [0, 1]
    small = tiff.write(b"a" * 192, lambda _: (tiff.NONE, 1, False, 1))
    at = small.index((256).to_bytes(2, "little") + (4).to_bytes(2, "little"))
    for width in (0, 1 << 31):
        bad = small[: at + 8] + width.to_bytes(4, "little") + small[at + 12 :]
        assert tiff.read(bad)[0][0] == 0 and tiff.read(bad)[0][8]
    bomb = zlib.compress(b"\0" * 10_000_000)
    assert len(tiff.unpack(bomb, tiff.DEFLATE, 100)) == 100
    files = spark.createDataFrame([(1, 5, 5, "h", damaged), (2, 5, 5, "h", small), (3, 5, 5, "h", b"II*\0junk")], "doc_id long, n_bytes long, media_bytes long, media_sha256 string, media binary")
    got = {r.doc_id: r for r in tiff.digests(tiff.pages(files)).collect()}
    assert got[1].payload_sha256 is None and got[3].payload_sha256 is None and got[2].payload_sha256 == hashlib.sha256(b"a" * 192).hexdigest()


def test_language_of_letters_beyond_the_basic_plane(spark):
    gothic, han = "\U00010330\U00010331\U00010332\U00010333 ", "\U00020000\U00020001\U00020002"
    rows = [(1, gothic * 9, "got"), (2, han * 9, "zh"), (3, "the end of it " * 9, "en"), (4, "Ελληνικά γράμματα " * 9, "el"), (5, "русские буквы " * 9, "ru")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.detect(d, language_id.learn(d)).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, _, x in rows} and min(s for _, s in got.values()) > 0.99


def test_predictions_equal_brute_force(spark, docs):
    """Prototypes and cosines recomputed text by text, gram by gram."""
    rows = [(r.text or "", r.lang) for r in docs.limit(60).collect()]
    v, classes = language_id._letters().astype(int), language_id._letter_classes()
    two, one = np.roll(v, 2, axis=1), np.roll(v, 1, axis=1)

    def bundle(text):
        code = [0]
        for c in text:
            k = int(classes[ord(c)])
            if k or code[-1]:
                code.append(k)
        code += [0] if code[-1] else []
        out = np.zeros(language_id.DIMENSIONS)
        for (a, b, c), n in collections.Counter(zip(code, code[1:], code[2:], strict=False)).items():
            out += n * two[a] * one[b] * v[c]
        return out

    vectors = [bundle(t) for t, _ in rows]
    sums = {}
    for x, (_, lang) in zip(vectors, rows, strict=True):
        if lang is not None and x.any():
            sums[lang] = sums.get(lang, 0) + x / np.linalg.norm(x)
    names = sorted(sums)
    proto = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    langs, scores = language_id.classify(pa.array([t for t, _ in rows]), *model)
    assert model[0] == names
    for x, lang, s in zip(vectors, langs, scores, strict=True):
        if x.any():
            cosine = proto @ x / np.linalg.norm(x)
            assert names[int(cosine.argmax())] == lang and np.isclose(max(0, cosine.max()), s, atol=1e-4)
        else:
            assert (lang, s) == ("und", 0)


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("net", "", "allow"), ("com", "/", "allow"), ("example.com", "/", "block"), ("example.org", "/d", "block"), ("example.org", "/de/1", "allow")]
    urls = ["http://A.Example.NET/en/x?y", "https://net/", "http://net", "http://xnet/", "ftp://example.org/de/12#z", "http://b.example.org/de", "http://example.com?x=http://net/", None, "nothing", "http:///a", "http://com/\n/x"]

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fit = [(len(h + p), a, h + p) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else "allow"

    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls + urls)}


def test_mixing(spark, docs, odd, empty):
    for d in (docs, odd):
        rows = mixing.plan(d).collect()
        assert len(rows) == d.count()
        sizes = collections.Counter()
        for r in rows:
            sizes[r.source] += r.size
        order = sorted(sizes, key=lambda s: (s is None, s))
        weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
        left, pool, target = 1.5 * sum(sizes.values()), set(order), {}
        while pool:
            share = {s: left * weight[s] / sum(weight[x] for x in pool) for s in pool}
            over = {s for s in pool if share[s] > 2 * sizes[s]}
            for s in over or pool:
                target[s] = 2.0 * sizes[s] if over else share[s]
                left -= target[s] if over else 0
            pool -= over or pool
        for s in order:
            mine = [r for r in rows if r.source == s]
            assert np.isclose(mine[0].target, target[s])
            assert abs(sum(r.size * r.copies for r in mine) - target[s]) <= max(r.size for r in mine) + 1e-6
        assert all(0 <= r.copies <= 2 for r in rows)
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, mixing.plan(docs).collect()))
    assert mixing.plan(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11))


def test_mixing_copies_equal_brute_force(spark, monkeypatch):
    """The dual is solved and the rounding redone in plain Python; buckets of a few rows."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rnd = random.Random(11)
    rows = [(i, " ".join("w" * rnd.choice((1, 2, 3, 5, 8, 13, 40))), rnd.choice("abcde")) for i in range(600)] + [(600 + i, "w w w", "b") for i in range(300)] + [(1000, None, "a"), (1001, "", None)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 id", "2 key", "3 copies", "4 bucket")).collect()
    assert len(got) == len(rows)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        target, sizes = mine[0].target, np.array([r.size for r in mine], dtype=float)
        scale = sizes[sizes > 0].mean() if (sizes > 0).any() else 1.0
        lo, hi = -1e4, 1e4
        rate = lambda lam, sizes=sizes, scale=scale: np.where(sizes > 0, 2 / (1 + np.exp(-np.clip(lam * sizes / scale, -700, 700))), 0)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (sizes * rate(mid)).sum() < target else (lo, mid)
        r = rate(lo)
        taken = {s: sum(x.copies for x in mine if x.size == s) for s in set(sizes.tolist())}
        # Along sizes, copies keep up with the running sum of rates to within one.
        run = copies = 0.0
        for s in sorted(taken):
            run, copies = run + r[sizes == s].sum(), copies + taken[s]
            assert abs(run - copies) < 1 + 1e-3
        assert all(np.floor(x - 1e-4) <= c.copies <= np.ceil(x + 1e-4) for x, c in zip(r, mine, strict=True))


def test_sources_are_ranked_by_code_point(spark):
    names = ["b", "a", "é", "z", "A", "", "\U0001f600", "￿", None, *(f"s{i}" for i in range(200))]
    got = {r.source: r["rank"] for r in mixing.ranked(spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    order = sorted(names, key=lambda s: (s is None, s or ""))
    assert got == {s: i for i, s in enumerate(order)}


def test_url_rules_that_nest_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SALT_ROWS", 40)
    rnd = random.Random(12)
    host = lambda: ".".join(rnd.choice(("a", "b", "a-b", "ab", "é", "A")) for _ in range(rnd.randrange(1, 5)))
    path = lambda: rnd.choice(("", "/", "/a", "/a/", "/a/b", "/ab", "/\U0010ffff", "/é", "/a/b/c"))
    rules = [(host(), path(), rnd.choice(("allow", "block"))) for _ in range(120)] + [("", "/", "block"), (None, "/", "block"), ("b", None, "block")]
    urls = [None, "", "://", "x://a.b", "no scheme"] * 3 + [f"http://{host()}{path()}{rnd.choice(('', '?q', '#f', 'x'))}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.b/a")], "page_id long, url string").selectExpr("*", "1 host", "'k' key", "2 at")
    rule_rows = spark.createDataFrame(rules, "host string, path string, action string")
    lower = lambda h: re.sub("[A-Z]", lambda m: m[0].lower(), h)
    plain = [(lower(h), p or "", a) for h, p, a in rules if h]
    for r in url_filter.judge(pages, rule_rows, "block").collect():
        url = "http://a.b/a" if r.page_id is None else urls[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        h = re.split("[/?#]", rest, maxsplit=1)[0]
        p, h = re.split("[?#]", rest[len(h) :], maxsplit=1)[0], lower(h)
        fit = [(len(x + y), a, x + y) for x, y, a in plain if h and (h == x or h.endswith("." + x)) and p.startswith(y)]
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, max(fit)[2] if fit else None, max(fit)[1] if fit else "block")
    assert url_filter.judge(pages, rule_rows.limit(0)).where("rule is not null or verdict <> 'allow'").count() == 0
    assert url_filter.judge(pages.limit(0), rule_rows).count() == 0


def test_warc_of_text_ids_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    big = "<p>x</p>" * 40
    rows = [(f"é<{i}>\n\"", f"http://h{i % 3}.org/{i % 5}", big) for i in range(90)] + [("", "http://h0.org/0", "tiny"), (None, None, big)]
    pages = spark.createDataFrame(rows + rows[:5], "page_id string, url string, html string").selectExpr("*", "1 id", "'k' key", "2 digest", "3 first")
    for most in (warc.MOST_BROADCAST, 0):  # repeated payloads by broadcast and by shuffle
        monkeypatch.setattr(warc, "MOST_BROADCAST", most)
        got = collections.Counter(tuple(r) for r in warc.archive_and_read(pages).collect())
        first = min(i for i, _, h in rows if i is not None and h == big)
        want = collections.Counter()
        for i, _, h in rows + rows[:5]:
            again = h == big and i != first
            want[i, len(h), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", first if again else None] += 1
        assert got == want


def test_viterbi_equals_the_best_of_all_paths(spark, docs):
    model = toxicity.learn_characters(docs.limit(50))

    def paths(word):
        runs = [m[0] for m in re.finditer(r"(.)\1*", word)]
        options = []
        for run in runs:
            n, sign = len(run), run[0] in toxicity.LEET
            letters = toxicity.LEET.get(run[0], run[0] if run[0].isalpha() else "")
            own = [("", toxicity.NOISE * n)] if sign or not letters else []
            for x in letters:
                cost = toxicity.READ * n if sign else 0.0
                own += [(x * n, cost)] if n <= 2 else []
                own += [(x, cost + toxicity.SINGLE), (x * 2, cost + toxicity.DOUBLE)] if n >= 2 and (sign or n >= 3) else []
            options.append(own)
        for chosen in itertools.product(*options):
            a = b = 0
            p = sum(c for _, c in chosen)
            for x in "".join(t for t, _ in chosen):
                k = toxicity._class(x)
                p, a, b = p + float(model[a, b, k]), b, k
            yield p + float(model[a, b, 0]), "".join(t for t, _ in chosen)

    rnd = random.Random(13)
    words = ["idi0t", "l00$er", "st!!!pid", "m0r0n", "x", "1", "2+2", "ñoo0"] + ["".join(rnd.choice("abestir013$!") for _ in range(rnd.randrange(1, 8))) for _ in range(60)]
    for word in words:
        plain, p = toxicity.decode(word, model)
        best = max(paths(word))
        assert np.isclose(p, best[0], atol=1e-3) and any(x == plain and np.isclose(q, best[0], atol=1e-3) for q, x in paths(word))


DISGUISES = ("1d10t", "st00pid l0$er", "id iot", "l o s e r", "s.t.u.p.i.d", "idiiiiot", "lo ser", "stu pid", "i-d-i-o-t", "id i ot")


def test_recall_of_disguises_comes_from_the_decoder(insults, monkeypatch):
    texts = [f"the old river {x} reads paper" for x in DISGUISES if x != "st00pid l0$er"] + ["the l0$er reads"]
    assert min(insults(texts).values()) >= 0.3
    monkeypatch.setattr(toxicity, "decode", lambda word, model, spelt=False: (" ".join(word) if spelt else word, 0.0))  # all as it stands
    monkeypatch.setattr(toxicity, "_mended", lambda *a: iter(()))
    assert sum(v >= 0.3 for v in insults(texts).values()) <= 1
    monkeypatch.undo()
    plain = ["my id is old", "an id of iota", "the lost era", "low service", "stuck pidgin"]
    assert max(insults(plain).values()) < 0.3


def test_labels_that_contradict_each_other_teach_nothing(spark):
    d = spark.createDataFrame([(i, ("good words here " if i % 2 else "#$% @@@ ### ") * 5) for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(30)]
    both = [(i, 1 - i % 2) for i in range(10)]
    of = lambda rows: quality.fit(d, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert np.allclose(of(labels + both), of(labels[10:])) and np.allclose(of(both + labels), of(labels[10:]))


def test_quality_equals_brute_force(spark):
    """Site posteriors and scores recomputed in plain Python from the evidence."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    own = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    y = [r.quality for r in labels.collect() if r.quality is not None]
    base = np.log((sum(v > 0 for v in y) + 1) / (sum(v <= 0 for v in y) + 1))
    p = {r.doc_id: 1 / (1 + np.exp(-(r.evidence + base))) for r in rows}
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for i, v in p.items():
        paths[own[i].source, own[i].lang].append(v)
        hosts[own[i].source].append(v)

    def pseudo(groups, parent, lost):
        n = np.array([len(g) for g in groups.values()], dtype=float)
        m = np.array([parent(k) for k in groups])
        got = np.array([np.mean(g) for g in groups.values()])
        if len(n) <= lost or n.sum() <= (n**2).sum() / n.sum():
            return quality.MOST_PRIOR
        v = (n * m * (1 - m)).sum() / n.sum()
        between = ((n * (got - m) ** 2).sum() - (len(n) - lost) * v) / (n.sum() - (n**2).sum() / n.sum())
        return quality.MOST_PRIOR if between <= 0 else float(np.clip(v / between - 1, quality.LEAST_PRIOR, quality.MOST_PRIOR))

    mean = np.mean(list(p.values()))
    k = pseudo(hosts, lambda h: mean, 1)
    post = {h: (k * mean + sum(g)) / (k + len(g)) for h, g in hosts.items()}
    k2 = pseudo({x: g for x, g in paths.items() if len(hosts[x[0]]) > len(g)}, lambda x: np.mean(hosts[x[0]]), len(hosts))
    for r in rows:
        g, h = paths[own[r.doc_id].source, own[r.doc_id].lang], post[own[r.doc_id].source]
        want = (k2 * h + sum(g)) / (k2 + len(g))
        assert np.isclose(r.host_posterior, h) and np.isclose(r.path_posterior, want)
        assert np.isclose(r.score, 1 / (1 + np.exp(-(r.evidence + np.log(want / (1 - want)))))) and r.keep == (r.score >= 0.5)


def test_one_row_of_each_group_stays(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(7, base, "a"), (3, base, "b"), (3, base, "b"), (None, base, "c"), (None, "other words that stand alone in this small table here", "d"), (None, "other words that stand alone in this small table here", "e"), (9, None, "f"), (9, None, "f"), (10, "", "g"), (11, "x", "h"), (11, "y", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "1 `group`", "2 id", "3 stays", "4 place")
    got = jaccard_join.keep_one(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text, r.row) for r in got.collect()), key=repr) == sorted([(3, base, "b"), (None, rows[4][1], "d"), (9, None, "f"), (9, None, "f"), (10, "", "g"), (11, "x", "h"), (11, "y", "h")], key=repr)
    assert jaccard_join.keep_one(d.limit(0)).count() == 0


def test_gibberish_and_unknown_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.learn(docs)
    least = language_id.least_cosines(docs, model)
    rnd = random.Random(14)
    gibberish = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(3000)) for _ in range(5)]
    code = "for (int i = 0; i < n; i++) { buf[i] = fgetc(fp); if (x == NULL) return -1; } while (ptr->next) ptr = ptr->next; " * 10
    greek = "Ελληνικά γράμματα και λέξεις που δεν έχει κανένα κείμενο " * 20
    rows = list(enumerate([*gibberish, code, greek, None, "", "123"])) + [(100, "A."), (101, "Avec."), (102, "All rights reserved.")]
    kept = {r.doc_id for r in language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), model, least).collect()}
    assert kept == {100, 101, 102}
    assert language_id.keep_identified(docs, model, least).count() >= 0.995 * docs.where("text rlike '[a-zA-Z]'").count()


def test_least_cosines_come_from_all_labelled_rows(spark, empty):
    rnd = random.Random(15)
    words = {x: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(300)] for x, letters in (("de", "aeinrstz"), ("en", "aehiotwy"))}
    rows = [(" ".join(rnd.choices(words[x], k=rnd.choice((3, 12, 40)))), x) for x in ("de", "en") for _ in range(13_000)]
    rows += [(rows[0][0], "en")] * 3000 + [("zq " * rnd.randint(1, 90), None) for _ in range(500)] + [(None, "en"), ("", "de"), ("12 34", "en"), ("Ωμέγα και άλφα", "de")]
    rnd.shuffle(rows)
    d = spark.createDataFrame(rows, "text string, lang string").repartition(7).cache()
    model = language_id.learn(d)
    texts = [t for t, x in rows if t is not None and x is not None]
    langs, scores = language_id.classify(pa.array(texts), *model)
    by_length = collections.defaultdict(list)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        if lang != language_id.UNDETERMINED:
            by_length[len(t.encode()).bit_length()].append(score)
    want = np.full(64, language_id.LEAST_COSINE)
    for digits, cosines in by_length.items():
        if len(cosines) >= 200:
            want[digits] = max(language_id.LEAST_COSINE, language_id.SLACK * np.percentile(cosines, 100 * language_id.LOWEST))
    assert len(texts) > 20_000 and len(np.unique(want)) > 3
    assert np.allclose(language_id.least_cosines(d, model), np.maximum.accumulate(want), rtol=0, atol=1e-6)
    assert (language_id.least_cosines(empty, language_id.learn(empty)) == language_id.LEAST_COSINE).all()


def test_lowest_cosines_are_exact_percentiles(spark):
    rnd = np.random.default_rng(16)
    cosines = {3: np.zeros(5), 5: np.array([0.25]), 8: np.repeat([0.5, 0.75], [1, 999]), 9: rnd.random(5000), 10: 0.6 + rnd.random(4000) / 1e5, 12: np.append(rnd.random(300), 1.0)}
    cosines = {d: c.astype(np.float32) for d, c in cosines.items()}
    keys = spark.createDataFrame([(d << 32 | int(bits),) for d, c in cosines.items() for bits in c.view(np.int32)], "key long").repartition(5)
    for share in (0.0, 0.001, 0.37, 1.0):
        got = language_id._lowest(keys, share)
        assert [(d, n) for d, n, _ in got] == [(d, len(c)) for d, c in cosines.items()]
        assert np.allclose([low for *_, low in got], [np.percentile(c.astype(float), 100 * share) for c in cosines.values()], rtol=0, atol=1e-12)
    assert language_id._lowest(keys.limit(0), 0.001) == []
