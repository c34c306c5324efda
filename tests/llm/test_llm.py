"""Small cases of the training-data operators: nulls, empty tables, ties, repeats, clashing columns, brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from stratalog.llm import bpe, eliasfano, exactdedup, htmltext, mixing, ngramlm, patricia, quality, simhash, sstable, toxicity, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, t string, sha string, keep_id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", None, "y", 3) for i, t, s in rows], SCHEMA)


def some(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épée", "zeta", "eta.", "theta", "iota", "kappa", "<b>", "don't"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))), f"s{i % 4}") for i in range(60)]
    rows += [(60, None, None), (61, "", "s0"), (62, " \n\t", "s1"), (63, rows[3][1], "s2"), (64, rows[3][1].replace(" ", "\n"), "s3"), (64, "again here", "s3"), (None, "no id", "s0"), (65, "long " * 30_000, "s1")]
    return rows


CALLS = {
    "simhash": (simhash.near_groups, simhash.keep_one),
    "exact": (exactdedup.exact_groups, exactdedup.keep_owners),
    "mixing": (mixing.plan, mixing.mix),
    "quality": (quality.judge, quality.keep_good),
    "bpe": (bpe.digest, None),
    "sstable": (sstable.round_trip, None),
    "ngramlm": (ngramlm.score, None),
}


@pytest.mark.parametrize("name", CALLS)
def test_odd_rows_and_empty_tables(spark, name):
    query, stage = CALLS[name]
    rows = some(spark)
    assert query(docs(spark, rows)).count() == len(rows)
    assert query(docs(spark, rows).limit(0)).count() == 0
    if stage:
        kept = stage(docs(spark, rows))
        assert kept.columns == docs(spark, rows).columns and kept.count() > 0
        assert stage(docs(spark, rows).limit(0)).count() == 0


def test_exact_groups_against_brute_force(spark):
    rows = some(spark)
    norm = lambda t: "".join((t or "").split()) if (t or "").isascii() else "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    want = {}
    for i, t, _ in rows:
        g = want.setdefault(norm(t), [0, None])
        rank = (-len(t or ""), i is None, i or 0)
        g[0] += 1
        g[1] = min(g[1] or (rank, i), (rank, i), key=lambda x: x[0])
    got = sorted((r.keep_id is None, r.keep_id or 0, r.group_size) for r in exactdedup.exact_groups(docs(spark, rows), trie_bytes=2000).collect())
    assert got == sorted((want[norm(t)][1][1] is None, want[norm(t)][1][1] or 0, want[norm(t)][0]) for _, t, _ in rows)


def test_patricia():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(400)]
    trie = patricia.PatriciaTrie(lambda a, b: a + b)
    for k in keys:
        trie.insert(k, 1)
    found = dict(trie.evict()) | dict(trie.items())
    assert found == {k: keys.count(k) for k in keys}


def test_gray_index_against_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(rng.integers(0, 60))) ^ np.uint64(1 << int(rng.integers(0, 60))) for _ in range(12)]))
    index = simhash.GrayIndex(fps, np.zeros(len(fps), np.int64))
    label = index.components(4)
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for i, a in enumerate(index.fps):
        for j in np.flatnonzero(np.bitwise_count(index.fps ^ a) <= 4):
            group[root(i)] = root(int(j))
    parts = lambda f: sorted(sorted(int(i) for i in range(len(fps)) if f(i) == r) for r in {f(i) for i in range(len(fps))})
    assert parts(lambda i: int(label[i])) == parts(root)


def test_fingerprint_by_definition():
    for t in ("", " \n", "One two", "A b C d e f É g h", "w " * 90):
        words = t.encode().lower().split()
        sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        assert simhash.fingerprint(t.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_bpe_equals_library():
    c = bpe.codec(bpe.vocabulary_path())
    for t in ("", "Hello, WORLD's 12", "<|endoftext|>x", "İstanbul ﬁ é", "日本語 a\u200bb", "\x1c a\x00", "a<|startoftext|> b"):
        ids = c.library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(c.encode(t), "<u4").tolist() == ids
        assert c.decode(c.encode(t)) == c.library.decode(ids, skip_special_tokens=False)


def test_shard_lookup(tmp_path):
    rows = sorted((i * 3 - 50, np.arange(i % 7, dtype="<u4").tobytes()) for i in range(500)) + [(1447, np.array([70000], "<u4").tobytes()), (1447, b""), (None, b"")]
    with open(tmp_path / "x", "wb") as f:
        w = sstable.ShardWriter(f, 256)
        for k, v in rows:
            w.add(k, v)
        w.close()
    with open(tmp_path / "x", "rb") as f:
        r = sstable.ShardReader(f)
        assert list(r) == rows
        assert r.get(-50) == [b""] and r.get(-49) == [] and sorted(r.get(1447)) == sorted([v for k, v in rows if k == 1447]) and r.get(None) == [b""]


def test_shards_against_the_library(spark):
    rows = [r for r in some(spark) if r[0] is not None and r[0] != 64] + [(70000, "x", "s"), (-5, "first", "s")]
    library = bpe.codec(bpe.vocabulary_path()).library
    table = docs(spark, rows)
    want, ids, start = [], {}, 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids[i] = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.append((i, start, len(ids[i]) // 4, zlib.crc32(ids[i])))
        start += len(ids[i]) // 4
    assert sorted(map(tuple, sstable.round_trip(table).collect())) == want
    manifest = sstable.write_shards(table, sstable.new_folder(spark, "sst"), shard_bytes=20_000)
    assert manifest.count() > 6
    wanted = spark.createDataFrame([(i,) for i in (-5, 0, 3, 3, 64, 65, 70000, 99999, None)], "doc_id long")
    assert {r.doc_id: bytes(r.ids) for r in sstable.lookup(manifest, wanted).collect()} == {i: ids[i] for i in (-5, 0, 3, 65, 70000)}
    double = sstable.write_shards(docs(spark, [(4, f"text {k}", "s") for k in range(30)] + [(None, "none", "s")]), sstable.new_folder(spark, "sst"))
    assert sstable.lookup(double, spark.createDataFrame([(4,), (None,)], "doc_id long")).count() == 31


def test_elias_fano():
    for vals in (np.zeros(0, np.uint64), np.array([0, 5, 2**63, 2**64 - 1], np.uint64), np.unique(np.random.default_rng(1).integers(0, 2**40, 3000, dtype=np.uint64))):
        e = eliasfano.EliasFano(eliasfano.EliasFano.build(vals))
        assert (e.access(np.arange(len(vals))) == vals).all() and (e.find(vals) == np.arange(len(vals))).all()


def test_quantised_values_come_from_all():
    x = np.zeros((1 << 21) + 2)  # a step through these would see the zeros alone
    x[1::2] = np.arange(len(x) // 2) % 200 + 1.0
    code, table = ngramlm.quantise(x)
    assert np.abs(table[code] - x).max() < 1


def test_lm_base_and_probability(spark):
    rows = some(spark)
    train, found = {}, {}
    for i, t, _ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            for w in [*(t or "").encode().lower().split(), None]:
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    got = ngramlm.score(docs(spark, rows), shards=3).collect()
    for i, t, _ in rows:
        words = [*(t or "").encode().lower().split(), None]
        found.setdefault(i, []).append((len(words), sum(w in train for w in words), round(sum(np.log10((train.get(w, 0) + 1) / (n + v + 1)) for w in words), 4)))
    for r in got:
        assert r.train_tokens == n and (r.n_tokens, r.n_known, round(r.base_score, 4)) in found[r.doc_id] and r.score <= 1e-6


def _plain_spelling(train):
    """Log10 probability of a spelling from the words that occur once, in dictionaries."""
    counts = {}
    for t in train:
        for w in (t or "").encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
    n3, n2, n1 = {}, {}, {}
    for w in (w for w, c in counts.items() if c == 1):
        c = [256, 256, *w, 256]
        for i in range(2, len(c)):
            for d, g in ((n3, tuple(c[i - 2 : i + 1])), (n2, (c[i - 1], c[i])), (n1, c[i])):
                d[g] = d.get(g, 0) + 1
    whole = sum(n1.values())

    def p(a, b, c):
        p1 = (n1.get(c, 0) + 1) / (whole + 257)
        p2 = (n2.get((b, c), 0) + 2 * p1) / (sum(k for g, k in n2.items() if g[0] == b) + 2)
        return (n3.get((a, b, c), 0) + 2 * p2) / (sum(k for g, k in n3.items() if g[:2] == (a, b)) + 2)

    return lambda w: sum(np.log10(p(*c)) for c in zip([256, 256, *w], [256, *w], [*w, 256], strict=False))


def _plain_scores(train, texts):
    """Interpolated absolute discounting over all n-grams, in dictionaries."""
    split = lambda t: [None, *(t or "").encode().lower().split(), None]
    uni, bi, tri = {}, {}, {}
    for t in train:
        w = split(t)
        for i in range(1, len(w)):
            for d, g in ((uni, w[i]), (bi, (w[i - 1], w[i])), (tri, tuple(w[i - 2 : i + 1]) if i > 1 else None)):
                d[g] = d.get(g, 0) + 1
    tri.pop(None, None)
    n, once, twice = sum(uni.values()), *(sum(c == k for c in uni.values()) for k in (1, 2))
    d1 = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    left2 = {a: 1 - sum(c - 0.75 for g, c in bi.items() if g[0] == a) / uni[a] for a in uni}
    left3 = {g: 1 - sum(c - 0.75 for h, c in tri.items() if h[:2] == g) / bi[g] for g in bi}
    spelling = _plain_spelling(train)

    def p1(w):
        return (uni[w] - d1) / n if w in uni else d1 * len(uni) / n

    def p2(a, w):
        return max(bi.get((a, w), 0) - 0.75, 0) / uni[a] + left2[a] * p1(w) if a in uni else p1(w)

    def p3(g, w):
        return max(tri.get((*g, w), 0) - 0.75, 0) / bi[g] + left3[g] * p2(g[1], w) if g in bi else p2(g[1], w)

    def token(w, i):
        return np.log10(p3((w[i - 2], w[i - 1]), w[i]) if i > 1 else p2(w[0], w[1])) + (0 if w[i] in uni else spelling(w[i]))

    return [sum(token(w, i) for i in range(1, len(w))) for w in map(split, texts)]


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_lm_scores_against_dictionaries(spark, shards):
    """Unquantised counts, with n-grams that occur once and hot contexts over several shards."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["the"] * 40
    rows = [(i, " ".join(rng.choices(words, k=12)) + f" only{i}", "s") for i in range(60)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in rows]
    train = [t for (_, t, _), h in zip(rows, held, strict=True) if not h]
    rows += [(i, t + " new Onlyx", "s") for i, t in zip([k for k in range(100, 300) if zlib.crc32(str(k).encode()) % 7 == 2], train, strict=False)]
    want = dict(zip([r[0] for r in rows], _plain_scores(train, [r[1] for r in rows]), strict=True))
    for r in ngramlm.score(docs(spark, rows), shards=shards).collect():
        assert abs(r.score - want[r.doc_id]) < 0.02 * r.n_tokens, (r, want[r.doc_id])
    if shards > 1:
        folder = ngramlm.new_folder(spark, "ngrams")
        info = ngramlm.train(spark.createDataFrame([(t,) for t in train], "t string"), folder, shards)
        assert max(info["hot2"]["parts"]) > 1 and (shards < 7 or len(info["hot2"]["ids"]) > 1 and len(info["hot3"]["ids"]) > 0)


def test_lm_takes_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=300)), "s") for i in range(12)] + [(50, "a " + "x" * 5_000 + " b c", "s")]
    whole = {r.doc_id: r for r in ngramlm.score(docs(spark, rows), shards=2).collect()}
    for chunk in (40, 1000):
        monkeypatch.setattr(ngramlm, "CHUNK", chunk)
        parts = list(ngramlm.pieces(rows[0][1].encode()))
        assert len(parts) > 1 and sum(len(p.split()) - lead for p, lead, _ in parts) == 300
        lv_rows = []
        for _, first, n, tok, final in ngramlm.chunks(iter([pa.RecordBatch.from_pydict({"t": [r[1] for r in rows]})]), 0):
            lv_rows.append((first, int(tok.counted.sum()), final))
        assert sum(n for _, n, _ in lv_rows) == sum(r.n_tokens for r in whole.values())
        monkeypatch.undo()
    monkeypatch.setattr(ngramlm, "CHUNK", 500)
    folder = ngramlm.new_folder(spark, "ngrams")
    info = ngramlm.train(spark.createDataFrame([(t,) for _, t, _ in rows], "t string"), folder, 2)
    lv = ngramlm.Levels(folder, info, 3)
    for _, t, _ in rows[:12]:
        split = [ngramlm._score(lv, ngramlm.Tokens([p], lead, final)) for p, lead, final in ngramlm.pieces(t.encode())]
        one = ngramlm._score(lv, ngramlm.Tokens([t.encode()]))
        assert len(split) > 1 and all(abs(sum(x[k][0] for x in split) - one[k][0]) < 1e-6 for k in range(4))


def test_url_rules(spark):
    rows = [(1, "http://WWW.Example.com/en/a?x"), (2, "https://a.example.com/en/"), (3, "http://b.com"), (4, "http://x.net/es/1"), (5, "http://example.net/de/"), (6, None), (7, "no scheme"), (8, "http://notexample.com/en/"), (9, "a://b.com/q#://c")]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(1, 10)] == ["www.example.com/en/", "example.com/en/", None, "net/es/", None, None, None, "com/", "com/"]
    assert got[1].host == "www.example.com" and got[1].path == "/en/a" and got[3].path == "" and got[6].host == "" and got[2].verdict == "block"
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_scores_equal_exact_counts(spark):
    rng = random.Random(4)
    hosts = ["a.com", "b.net", "c.org", "www.example.com", "example.com"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr'])}/{rng.getrandbits(60):x}") for i in range(900)] + [(900, "\x00\x02\x03"), (901, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id for r in pages.where("pmod(xxhash64(url), 5L) = 0").collect()}
    got = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    allow = {h + p: a for a, h, p in urlfilter.RULES}
    counts = ({}, {})

    def grams(u):
        d = b"\x02" * 5 + u.encode() + b"\x03"
        return [[(d[i - k : i + 1], ("context", d[i - k : i])) for k in range(6)] for i in range(5, len(d))]

    for i, u in rows:
        if got[i].rule is not None and i not in out:
            c = counts[allow[got[i].rule]]
            for x in (x for g in grams(u) for pair in g for x in pair):
                c[x] = c.get(x, 0) + 1

    def plain(u):
        total = 0.0
        for g in grams(u):
            for sign, c in ((-1, counts[0]), (1, counts[1])):
                p = 1 / 256
                for gram, context in g:
                    p = (c.get(gram, 0) + 2 * p) / (c.get(context, 0) + 2)
                total += sign * np.log(p)
        return total / len(grams(u)) if u else 0.0

    means = [np.mean([plain(u) for i, u in rows if i in out and got[i].rule is not None and allow[got[i].rule] == a]) for a in (False, True)]
    free = [(i, u) for i, u in rows if got[i].rule is None]
    assert len(free) > 200 and all(counts)
    for i, u in free:
        assert abs(got[i].score - plain(u)) < 1e-9 and got[i].verdict == ("allow" if plain(u) >= sum(means) / 2 else "block")


def test_label_model_recovers_rates_of_both_polarities(spark):
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    p1, p0 = np.array([0.7, 0.6, 0.5, 0.8, 0.1, 0.05]), np.array([0.02, 0.05, 0.01, 0.03, 0.5, 0.6])
    fires = rng.random((4000, 6)) < np.where(y[:, None], p1, p0)
    fires = np.c_[fires[:, :4], fires[:, 3], fires[:, 4:]]  # a voter that copies the fourth
    rows = [([int(i) for i in np.flatnonzero(f)],) for f in fires]
    ballots = spark.createDataFrame(rows, "votes array<int>").groupBy("votes").count().withColumnRenamed("count", "n")
    model = toxicity.fit_labels(ballots, toxicity.LabelModel(7, 5, 0.2))
    assert np.abs(model.p1[:7] - np.r_[p1[:4], p1[3], p1[4:]]).max() < 0.15 and np.abs(model.p0[:7] - np.r_[p0[:4], p0[3], p0[4:]]).max() < 0.1
    assert (model.weight[3:5] < 0.75).all() and (model.weight[[0, 1, 2, 5, 6, 7]] > 0.95).all()
    flat, at = np.array([i for (v,) in rows for i in v]), np.r_[0, np.cumsum([len(v) for (v,) in rows])]
    assert ((model.posterior(flat, at) > 0.5) == y).mean() > 0.9
    # a round's sums, in dictionaries
    post, want = model.posterior(flat, at), np.zeros((2, 9))
    for (v,), q in zip(rows, post, strict=True):
        for i in [*v, *([7] if all(x >= 5 for x in v) else []), 8]:
            want[:, i] += q, 1 - q
    assert np.allclose(model.sums(flat, at, np.ones(4000, np.int64)), want)
    key, both = model.together(flat, at, np.ones(4000, np.int64))
    assert {divmod(int(k), 7): round(float(b), 6) for k, b in zip(key, both[0], strict=True)} == {(i, j): round(float(post[fires[:, i] & fires[:, j]].sum()), 6) for i in range(7) for j in range(i + 1, 7) if (fires[:, i] & fires[:, j]).any()}


def test_linear_classifier_against_plain_descent():
    rng = np.random.default_rng(6)
    x = (rng.random((3000, 3)) < 0.4).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.5]) - 0.7)))
    w = toxicity.train_linear(x, y, np.ones(3000), ridge=0.0)
    assert np.allclose(w, [2.0, -1.0, 0.5, -0.7], atol=1e-3)
    v, full = np.zeros(4), np.c_[x, np.ones(3000)]
    for _ in range(4000):
        v -= full.T @ (1 / (1 + np.exp(-full @ v)) - y) / 3000
    assert np.allclose(w, v, atol=1e-2)


def test_patterns_of_texts():
    assert toxicity.patterns(b"") == set() and toxicity.patterns(b"LOUD WORDS HERE!!!") == {"#capitals", "#bangs"}
    assert toxicity.patterns(b"see http://x.org or a@b.c") == {"#link", "#mail"} and toxicity.patterns(b"12345 a") == {"#digits"}


def test_toxicity_learns_a_lexicon(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choices(words, k=40) + rng.choices(["vilest", "horrid", "dreadful"], k=3) * bad), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "s"), (901, "", "s")]
    got = {r.doc_id: r for r in toxicity.score(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert len(held) > 100 and sum(got[i].predicted == (i % 5 == 0) for i in held) >= 0.95 * len(held) and got[900].predicted == got[901].predicted == 0
    assert toxicity.score(docs(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")).where("predicted = 1").count() == 0


def test_html():
    e = htmltext.extract
    assert e(None) == e("") == "" and e("<p>a<p>b&amp;c") == "a\n\nb&c" and e("<ul><li>x<li>y</ul>") == "  - x\n  - y"
    assert e("<table><tr><td>a<td>bbb<tr><th>cccc</th><td>d</table>") == "a     bbb\ncccc  d"
    assert e("<head><title>t</title><body>v<script>if(a<b)x()</script><i hidden>n</i><span style='display:none'>n</span>w") == "vw"
    assert e("a" + "<div>" * 3000 + "deep") == "a\ndeep" and e("x <!-- never ends") == "x"


def test_lines_that_fail():
    fails = lambda t: len(quality.clean_lines(t.encode())[0]) == 0
    for t in ("a ## b", "so so!!", "one two three four five six seven eight", "LOUD WORDS HERE.", "Home | News | Mail", "see http://x.org", "no no no no.", "Alle Rechte vorbehalten.", "Tous droits réservés."):
        assert fails(t), t
    for t in ("One two.", "one two three four five six seven eight.", "Title of a page", "a - b is a difference of two.", "see http://x.org for more of it."):
        assert not fails(t), t
    stay, dup, lost = quality.clean_lines(b"Home\nNews\n\nMail\nA sentence.\nShort one\nA sentence.")
    assert stay == [b"", b"A sentence.", b"Short one"] and dup == 1 and lost == 12 + 10


def test_cleaned_texts_and_rejected_documents(spark):
    rows = [(1, "A good sentence of ten words stays here as it is.\nClick here", "s"), (2, "Home | News | Mail | Home\n" * 5, "s"), (3, None, "s")]
    assert {r.doc_id: r.clean_text for r in quality.cleaned(docs(spark, rows)).collect()} == {1: "A good sentence of ten words stays here as it is.", 2: "", 3: ""}
    assert [(r.doc_id, r.text) for r in quality.keep_good(docs(spark, rows)).collect()] == [(1, rows[0][1])]


def test_repeated_words_of_long_texts_equal_short_ones():
    rng = random.Random(3)
    for size in (10, 300, 1500):
        words = [rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(size)]
        assert quality._repeated_many(words, 5) == quality.repeated(words)


def test_html_oddities():
    e = htmltext.extract
    assert e('<p>before <a title="x>link</a> after</p>') == "before" and e("<a title=it's>hello</a> we don't <b>") == "hello we don't"
    assert e("<head><title>x</title>text <b>bold</b>") == "text bold" and e("<pre>\nx\n\n y</pre>z") == "x\n\n y\n\nz"
    assert e("a<br><br>b<br></p>c") == "a\n\nb\n\nc" and e("<div hidden><div>x</div>secret</div>v") == "v" and e("<b><p>x</b>y</p>z") == "xy\n\nz"
    assert e("<noscript>n</noscript><dialog>d</dialog><dialog open>D</dialog><details><summary>S</summary>b</details><details open>B</details>") == "D\nS\nB"
    assert e("<div style='visibility:hidden'>no<i style='visibility:visible'>yes</i></div>") == "yes" and e("<svg><text>draw</text></svg><math><mi>x</mi></math>") == "drawx"
    assert e("<table><tr><td colspan=2>wide one</td></tr><tr><td>a</td><td>b</td></tr><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table>") == "wide one\na  b\nr  1\n   2"
    assert e("<table><tr><td>a<br>b</td><td><ul><li>x<li>y</ul></td><td>z</td></tr><tr><td>longer cell</td><td>q</td></table>") == "a              - x  z\nb              - y\nlonger cell  q"
    assert e("<ol start=3><li>a<li value=9>b<li>c<ul><li>n</ul></ol>") == "  3. a\n  9. b\n  10. c\n    - n" and e("1 < 2 <![CDATA[no]]>") == "1 < 2"


@pytest.mark.parametrize("piece", ["<ul><li>", "<div>", "<b>", "<table><tr><td>", "<p>", "</p>", "<a b='", "<!--", "<", "<span><div></span>", "<li>x", '<a b="c>', "<dl><dt>a<dd>", "<font><p>", "<td>", "<br>", "<table><tr><td colspan=9 rowspan=9>x"])
def test_html_is_linear(piece):
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        htmltext.extract(piece * n + "x")
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.01)  # 8 where time is in proportion, 64 where it is quadratic


def _plain_layout(tree, out, indent=0, mark=None):
    """A recursive renderer of (tag, kids) over words, for trees without implied tags."""
    for kid in tree[1]:
        if isinstance(kid, str):
            if out["now"] is None:
                out["lines"] += [""] * (out["gap"] > 1 and bool(out["lines"]))
                out["gap"], out["now"] = 0, "  " * indent + (mark.pop() if mark else "")
                out["now"] += kid
            else:
                out["now"] += " " + kid
        elif kid[0] == "b":
            _plain_layout(kid, out, indent, mark)
        elif kid[0] != "hidden":
            gap = {"p": 2, "ul": 1 if indent else 2}.get(kid[0], 1)

            def edge(gap=gap):
                out["lines"] += [] if out["now"] is None else [out["now"]]
                out["now"], out["gap"] = None, max(out["gap"], gap)

            edge()
            _plain_layout(kid, out, indent + (kid[0] == "ul"), ["- "] if kid[0] == "li" else mark)
            edge()
    return out


def test_html_against_a_plain_renderer():
    rng = random.Random(12)

    def grow(tag, depth):
        allowed = {"ul": ["li"], "p": ["b", "hidden"], "b": ["b"], "hidden": ["b"]}.get(tag, ["div", "p", "ul", "b", "hidden"])
        kids = []
        for _ in range(rng.randint(0, 4)):
            if tag != "ul" and (depth == 0 or rng.random() < 0.5):
                kids.append(f"w{rng.randint(0, 99)}")
            elif depth:
                kids.append(grow(rng.choice(allowed), depth - 1))
        return (tag, kids)

    def spell(tree):
        inside = " ".join(k if isinstance(k, str) else spell(k) for k in tree[1])
        return f"<b hidden> {inside} </b>" if tree[0] == "hidden" else f"<{tree[0]}> {inside} </{tree[0]}>"

    for _ in range(300):
        tree = ("div", [grow("div", 5)])
        out = _plain_layout(tree, {"lines": [], "now": None, "gap": 0})
        assert htmltext.extract(spell(tree)) == "\n".join(out["lines"]), spell(tree)


def test_mix_keeps_within_bounds(spark):
    got = mixing.plan(docs(spark, some(spark))).collect()
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - target) <= 0.5 for t, target in taken.values())
    assert abs(sum(t for _, t in taken.values()) - 1.5 * sum(r.size for r in got)) <= len(taken)


@pytest.mark.parametrize("words", [600_000, 6_000])
def test_mix_serves_small_sources(spark, words):
    rows = [(i, "a b c d e", f"s{i}") for i in range(6)] + [(10 + i, "w " * 1_000, "t") for i in range(words // 1_000)]
    got = mixing.plan(docs(spark, rows)).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 7 and all(abs(r[1] - r[2]) <= 0.5 and r[1] > 0 for r in got)


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix_follows_the_slots(spark, block):
    rng = random.Random(block)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), f"s{i % 3}") for i in range(50)] + [(99, "one two", "tiny")]
    plan = {r.doc_id: r for r in mixing.plan(docs(spark, rows), block=block).collect()}
    streams, targets = {}, {}
    for i, t, s in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).digest(), r[0])):
        streams.setdefault(s, []).extend([i] * len(t.split()))
        targets[s] = plan[i].target
    names, whole = sorted(streams), sum(targets.values())
    highs = [int(sum(targets[x] for x in names[: k + 1]) / whole * 2**32) for k in range(len(names))]
    n_slots = int(-(-1.5 * sum(map(len, streams.values())) // block))
    row = {s: [] for s in names}
    for slot in range(n_slots):
        s = next((n for n, h in zip(names, highs, strict=True) if slot * mixing.GOLDEN % 2**32 < h), None)
        if s is not None:
            row[s].append(slot)
    taken, slots = {i: 0 for i, _, _ in rows}, {}
    for s, given in row.items():
        stop = int(targets[s] + 0.5)
        need = -(-stop // block)
        given += [int((j + 0.5) / need * n_slots) + 0.5 for j in range(len(given), need)]
        for w in range(stop):
            i = streams[s][w % len(streams[s])]
            taken[i] += 1
            at = (given[w // block], w)
            slots[i, w // len(streams[s])] = min(slots.get((i, w // len(streams[s])), at), at)
    assert {i: r.taken for i, r in plan.items()} == taken
    assert {i: r.slots or [] for i, r in plan.items()} == {i: sorted(slots[i, e][0] for e in range(2) if (i, e) in slots) for i in plan}
    times = {i: int(taken[i] / plan[i].size + 0.5) if plan[i].size else 0 for i in plan}
    got = [r.doc_id for r in mixing.mix(docs(spark, rows), block=block).collect()]
    assert sorted(got) == sorted(i for i, n in times.items() for _ in range(n)) and len(got) > 50
    first = {i: min(slots[i, e][0] for e in range(2) if (i, e) in slots) for i in times if times[i]}
    seen = list(dict.fromkeys(got))
    assert [first[i] for i in seen] == sorted(first[i] for i in seen)


def test_dedup_stages_know_rows_not_identifiers(spark):
    rows = [(None, "the quick brown fox jumps over", "a"), (None, "an entirely other text is here now", "b"), (5, "one two three four five six", "c"), (5, "seven eight nine ten eleven twelve", "d"), (6, "one two three four five six", "e"), (5, "one two three four five six", "c")]
    kept = sorted(r.text for r in simhash.keep_one(docs(spark, rows)).collect())
    assert kept == sorted({t for _, t, _ in rows})
    rows = [(5, "a b c", "x"), (5, "a  b  c", "y"), (5, "abc", "z"), (None, "q", "x"), (None, "r", "x"), (7, " a b c", "x"), (5, "a  b  c", "y")]
    assert sorted((r.doc_id or 0, r.text) for r in exactdedup.keep_owners(docs(spark, rows)).collect()) == [(0, "q"), (0, "r"), (5, "a  b  c")]
    got = exactdedup.exact_groups(docs(spark, rows)).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 1, True), (0, 1, True), (5, 5, False), (5, 5, False), (5, 5, False), (5, 5, True), (5, 5, True)]
