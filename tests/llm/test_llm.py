"""The operators of lodestone.llm on small rows: brute force, round trips, and odd input."""

import collections
import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, classifier, common, embed_dedup, html_text, licenses, minhash, mixing, quality_rules, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns.
CLASHING = ("row", "key", "doc", "q", "part", "size", "rank", "node", "copies", "label", "ids", "starts", "all", "rep", "kept", "gone_id", "a", "b", "n", "quality", "component_id")


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in CLASHING})


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, odd rows."""
    rng = random.Random(5)
    texts = [" ".join(words(rng, rng.randrange(1, 160))) for _ in range(60)]
    passage = " ".join(words(rng, 45))
    texts += [texts[3], texts[3], texts[7]]
    for k in (11, 12, 13):
        own = texts[k].split()
        for _ in range(3):
            near = list(own)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += [" ".join(words(rng, 10)) + " " + passage + "\n" + " ".join(words(rng, 12)) for _ in range(5)]
    texts += [passage + " x " + passage, None, "", "   ", "\n\t", "word", "Word", "a b", " ".join(words(rng, 4000, 50)), "the same " * 60]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[20]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def classes(ids, edges):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


# -- 1


def test_bpe_merges_exactly():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own, other = bpe.ByteBpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "ab", "é", " ", "  ", "\n", "'s", "12", "中文", "😀", "!?", "x" * 40, "Straße", "ing", "<|endoftext|>"]
    for text in ["", "a" * 20_000, *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(600))]:
        ids = memoryview(own.packed(text)).cast("I").tolist()
        assert ids == other.encode_ordinary(text)
        assert own.decode(own.packed(text)).decode() == text
    long_ = " ".join(rng.choices(["wort", "mot ", "palabra\n", "word  "], k=120_000))
    assert memoryview(own.packed(long_)).cast("I").tolist() == other.encode_ordinary(long_)


def test_bpe_rows(docs, empty):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    none = hashlib.sha256(b"").hexdigest()
    rows = bpe.digests(docs, path).collect()
    assert len(rows) == docs.count()
    assert sum(r.ids_sha256 == none and r.n_tokens == 0 for r in rows) == 2
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(hashlib.sha256(given[r.doc_id].encode()).hexdigest() == r.decoded_sha256 for r in rows)
    back = bpe.decode(bpe.encode(docs.withColumns({"ids": F.lit("own"), "row": F.lit(1)}), path).drop("text"), path).collect()
    assert all(r.text == given[r.doc_id] and r.row == 1 for r in back)
    assert bpe.digests(empty, path).count() == 0 and bpe.encode(empty, path).count() == 0


# -- 2


def test_mixing(spark, docs, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and rows == rows
    again = mixing.mixed(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    per = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        p = per[source[r.doc_id]]
        p[0] += r.size
        p[1] += r.taken
        p[2] = r.target
        p[3] = max(p[3], r.size)
        assert r.taken <= 3 * r.size
    total = sum(p[0] for p in per.values())
    assert sum(p[2] for p in per.values()) == pytest.approx(total)
    assert all(p[2] <= 3 * p[0] + 1e-6 and abs(p[1] - p[2]) <= 2 * p[3] for p in per.values())
    assert mixing.mixed(empty).count() == 0
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    out = mixing.mix(clashing(docs))
    assert out.columns == clashing(docs).columns
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v}
    assert mixing.mix(empty).count() == 0


def test_targets_stop_at_three_sizes(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1000), (None, 1), ("z", 0)], "source string, size long")
    t = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert (t["b"], t[None], t["z"]) == (30, 3, 0) and t["a"] == 30 and t["c"] == 1021 - 63
    zero = spark.createDataFrame([("a", 0), (None, 0)], "source string, size long")
    assert {r.target for r in mixing.source_targets(zero).collect()} == {0.0}


# -- 3


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, None, None), (5, 0, "user", "a<|im_end|>"), (None, 0, "user", "n"), (6, 0, "x", "t"), (6, 0, "x", "t")]
    rows += [(7, i, "user", str(i)) for i in range(300)] + [(8, i, "user", str(i)) for i in range(299)]
    out = chat.render(clashing(spark.createDataFrame(rows, schema))).collect()
    assert sorted((r.conv_id or -1, r.segment) for r in out) == [(-1, 0), (2, 0), (4, 0), (5, 0), (6, 0), (7, 0), (7, 1)]
    text = {(r.conv_id, r.segment): r.text for r in out}
    assert text[2, 0] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert text[4, 0] == "<|im_start|>unknown\n<|im_end|>\n" and text[5, 0].count("<|im_end|>") == 1 and text[6, 0].count("im_start") == 2
    assert (text[7, 0] + text[7, 1]).count("im_start") == 300
    assert chat.render(spark.createDataFrame([], schema)).count() == 0


# -- 4


def counted(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    found = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if found[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, empty):
    given = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.verdicts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(given[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.verdicts(empty).count() == 0 and quality_rules.keep(empty).count() == 0
    own = clashing(docs)
    assert quality_rules.keep(own).columns == own.columns


def test_quality_verdicts(spark):
    rng = random.Random(3)
    prose = [" ".join(rng.choices(["the", "house", "stood", "quiet", "near", "river,", "and", "people", "walked", "slowly."], k=9)) + f" item{i}a item{i}b thing{i}" for i in range(80)]
    junk = [" ".join(f"{w}$$$" for w in rng.sample([f"ab{k}" for k in range(90)], 30)) for _ in range(8)] + [" ".join(w.upper() + "!!" for w in rng.sample([f"abc{k}" for k in range(90)], 30)) for _ in range(8)]
    rows = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.keep(rows).collect()}
    assert kept == set(range(80))


def test_estimation_prefers_agreement():
    share, good, bad = quality_rules.estimate([((1, 1, 1), 80), ((-1, -1, 1), 20)], 3)
    assert bad[0] > bad[2] and 0.7 < share < 0.95
    assert quality_rules.estimate([], 3)[0] == quality_rules.PRIOR


# -- 5


def test_starts_travel_packed():
    docs = np.arange(-500, 500)
    packed = substring._starts_rows(docs, docs + 1, (docs % 7).astype(np.uint32), 8)
    assert len(packed) == 8
    found = [np.concatenate(c) for c in zip(*(substring._unpack(r["payload"]) for r in packed), strict=True)]
    assert sorted(zip(*map(np.ndarray.tolist, found[2:]), strict=True)) == [(d, d + 1, d % 7) for d in range(-500, 500)]


def test_substrings(spark, docs, corpus, empty, monkeypatch):
    first = {}
    split = {i: WORD.findall(t or "") for i, t, *_ in corpus}
    for i in sorted(split):
        for k in range(len(split[i]) - 19):
            first.setdefault(tuple(split[i][k : k + 20]), (i, k))

    def wanted(i):
        w, gone = split[i], set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (i, k):
                gone.update(range(k, k + 20))
        return len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()

    for held in (1 << 20, 50):
        monkeypatch.setattr(substring, "HELD", held)
        rows = substring.removed(docs).collect()
        assert len(rows) == len(corpus)
        assert all((r.n_words, r.n_removed, r.kept_sha256) == wanted(r.doc_id) for r in rows)
    assert substring.removed(empty).count() == 0 and substring.strip(empty).count() == 0
    own = clashing(docs)
    out = substring.strip(own)
    assert out.columns == own.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, *_ in corpus if wanted(i)[0] == 0 or wanted(i)[1] < wanted(i)[0])
    null = spark.createDataFrame([(None, " ".join(f"v{k}" for k in range(25))), (1, " ".join(f"v{k}" for k in range(25)))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.removed(null).collect()} == {None: 0, 1: 25}


# -- 6


def test_embeddings(spark, monkeypatch):
    g = np.random.default_rng(2)
    centres = g.normal(size=(6, 16))
    x = np.concatenate([centres[g.integers(6, size=260)] + 0.09 * g.normal(size=(260, 16)), g.normal(size=(60, 16))]).astype(np.float32)
    x = np.concatenate([x, x[:30], x[:4] * 2])
    labels = [int(v) for v in g.integers(3, size=len(x))]
    rows = [(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, labels, strict=True))]
    rows = [*rows[:-34], *[(r[0], r[1], labels[k]) for k, r in enumerate(rows[-34:-4])], *rows[-4:]]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (None, rows[0][1], rows[0][2])]
    schema = "vec_id long, embedding array<float>, label int"
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    near = (v @ v.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(near, False)
    comp = classes(range(n), list(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True)))
    assert near.sum() > 500
    for block in (512, 16):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        monkeypatch.setattr(embed_dedup, "LEAF", 8)
        out = {r.vec_id: r for r in embed_dedup.linked(spark.createDataFrame(rows + odd, schema).withColumns({"rep": F.lit(1), "h1": F.lit(2)})).collect()}
        assert len(out) == n + len(odd)
        assert all((out[i].n_links, out[i].component_id, out[i].kept) == (int(near[i].sum()), comp[i], comp[i] == i) for i in range(n))
        assert all(out[r[0]].n_links == 0 and out[r[0]].component_id == r[0] and out[r[0]].kept for r in odd)
    assert embed_dedup.linked(spark.createDataFrame([], schema)).count() == 0


def test_written_leaves_no_shuffle_files(spark):
    dirs = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in dirs for p in d.rglob("shuffle_*")}
    before = files()
    out = common.written(spark.range(100_000).groupBy((F.col("id") % 5000).alias("x")).agg(F.count("*").alias("n")))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 5000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in classes({x for e in edges for x in e}, edges).items() if i != 7} | {7: 0}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 7


def test_classifier(spark, empty):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "house", "walked", "quiet", "under"]) for _ in range(rng.randrange(5, 300)))
    bad = lambda: " ".join(rng.choice(["RIVER!!", "HOUSE!!", "WALKED!!"]) for _ in range(rng.randrange(5, 300)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(240)]
    rows += [(300, None), (301, ""), (302, "x" * 400_000), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in classifier.scores(docs, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [i for i in range(240) if out[i].held_out]
    assert 40 < len(held) < 120 and out[None].held_out is False
    assert sum(out[i].predicted == (i % 4 > 0) for i in held) >= 0.95 * len(held)
    none = classifier.scores(docs, labels.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.scores(empty, labels).count() == 0


def test_network_scores_in_slabs(monkeypatch):
    net = classifier.Network()
    text = bytes(random.Random(1).randrange(256) for _ in range(5000))
    whole = net.score(text)
    monkeypatch.setattr(classifier, "SLAB", classifier.STRIDE * 3)
    assert net.score(text) == pytest.approx(whole, abs=1e-6)


# -- 8


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(map(tuple, [w])) if w else set()


@pytest.mark.parametrize("small", [200, 2])
def test_minhash(spark, docs, corpus, empty, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    sets = {i: shingles(t) for i, t, *_ in corpus}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = classes(sets, edges)
    rows = minhash.linked(clashing(docs)).collect()
    assert len(rows) == len(corpus)
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id) for r in rows)
    if small > 2:
        assert minhash.linked(empty).count() == 0
        own = clashing(docs)
        out = minhash.keep(own)
        assert out.columns == own.columns and minhash.keep(empty).count() == 0
        null = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "A b  c")], "doc_id long, text string")
        assert {r.doc_id: (r.component_id, r.kept) for r in minhash.linked(null).collect()} == {None: (None, True), 1: (1, True), 2: (1, False)}


def test_minhash_writes_cells_without_sketches(spark, monkeypatch):
    """A document is in many cells, and its sketch is longer than a row of these."""
    seen, write = [], minhash.written
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "written", lambda df: seen.append(df.columns) or write(df))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:50], f"x{i}", *words[50:]])) for i in range(6)] + [(9, "another text")]
    out = {r.doc_id: r.component_id for r in minhash.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict.fromkeys(range(6), 0) | {9: 9}
    assert any("cell" in c for c in seen) and not any("sketch" in c and {"cell", "node"} & set(c) for c in seen)
    assert {len(r.tokens) for r in minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {2 * minhash.COORDINATES}


def test_minhash_compares_a_group_once(spark, monkeypatch):
    """Near copies too far apart for most to link are together in nodes of all trees; these are cut as one."""
    rng, made, likeliest = random.Random(3), [], minhash.likeliest
    monkeypatch.setattr(minhash, "SMALL", 8)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "likeliest", lambda cells, least: made.append(cells.count()) or likeliest(cells, least))
    texts = {}
    for i in range(90):
        own = set(rng.sample(range(80), 7 if i < 40 else 0))
        texts[i] = " ".join([*(f"x{i}{k}" if k in own else f"w{k}" for k in range(80)), f"y{i}"])
    out = {r.doc_id: r.component_id for r in minhash.linked(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert out == classes(sets, edges)
    assert made[0] < 5000  # 10,728 when each node is cut by itself


# -- 9


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES["MIT-text"]
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, "Intro\n\n" + mit.replace(". ", ".\n") + "\n\nEnd of it"), (3, "nothing of the kind"), (4, None), (5, ""), (6, mit.replace("person", "body")), (7, "Licensed under CC BY-NC 4.0.\nlicensed under the apache license version 2.0")]
    rows += [rows[0], (8, "word " * 50_000)]
    out = {r.doc_id: r for r in licenses.scan(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {k: r.licences for k, r in out.items()} == {1: "MIT", 2: "MIT-text", 3: "", 4: "", 5: "", 6: "MIT-text", 7: "Apache-2.0,CC-BY-NC-4.0", 8: ""}
    assert out[3].best is None and out[3].best_dice == 0 and out[1].best_dice == 1.0 and 0.9 < out[6].best_dice < 1
    assert licenses.scan(empty).count() == 0


def test_licenses_across_lines(spark):
    t = licenses.TEMPLATES
    other = " ".join(f"w{i} x{i % 7}" for i in range(100))
    cut = lambda text, *at: "\n\n".join(" ".join(text.split()[a:b]) for a, b in zip((0, *at), (*at, None), strict=True))
    apache = "".join(f" * {' '.join(t['Apache-2.0-header'].split()[i : i + 11])}\n" for i in range(0, 99, 11))
    rows = [
        (1, f"{other}\n\n{cut(t['MIT-text'], 55, 82)}\n\n{other}"),
        (2, f"{other}\n\n{cut(t['BSD-2-Clause'], 23, 40, 70)}\n{other}"),
        (3, f"/*\n{apache} */\nimport a.b.c;\n\nclass A {{ {other} }}"),
        (4, f"{other} The files here are released under the MIT License. {other}"),
        (5, f"{other} under the license {other} of the software {other} released by them {other}"),
    ]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: set(r.licences.split(",")) - {"Apache-2.0"} for k, r in out.items()} == {1: {"MIT-text"}, 2: {"BSD-2-Clause"}, 3: {"Apache-2.0-header"}, 4: {"MIT"}, 5: {""}}
    assert all(out[k].best_dice == 1.0 for k in (1, 2, 4)) and out[3].best_dice > 0.95

    def best(text, template):  # every run of words
        w, have = re.sub(r"[\W_]+", " ", text.lower()).split(), set(licenses.bigrams_of(template))
        b = [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]
        return max(2 * len(have & set(b[i:j])) / (len(have) + len(set(b[i:j]))) for i in range(len(b)) for j in range(i + 1, len(b) + 1))

    rng = random.Random(5)
    own = {"A": "a b c d e f g", "B": "b a b d e"}
    texts = [" ".join(rng.choice(["a b", "c d", "e f", "g", "a", "d e", "x"]) for _ in range(rng.randrange(2, 16))) for _ in range(60)]
    got = {r.doc_id: r.best_dice for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own, 0.7).collect()}
    want = {i: max(best(x, y) for y in own.values()) if " " in x else 0 for i, x in enumerate(texts)}
    assert got == {i: d if d >= 0.7 else 0 for i, d in want.items()} and 5 < sum(d > 0 for d in got.values()) < 60


def test_licenses_repeated(spark):
    t = licenses.TEMPLATES
    thrice = lambda text: "\n".join(x for i in range(0, len(text.split()), 20) for x in [" ".join(text.split()[i : i + 20])] * 3)
    rows = [(1, "Released under the MIT License. Released under the MIT License."), (2, " ".join([t["MIT-text"]] * 5)), (3, thrice(t["BSD-2-Clause"])), (4, t["Apache-2.0"].replace("Apache", "Apache " * 40))]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.licences for k, r in out.items()} == {1: "MIT", 2: "MIT-text", 3: "BSD-2-Clause", 4: "Apache-2.0"}
    assert out[1].best_dice == out[2].best_dice == 1.0


# -- 10

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=1>Home</a></nav><div class="cookie-notice">We use cookies here, a lot of them, in each and every page.</div>
<main><article><header><h1>Head &amp; shoulders</h1></header><p>First  paragraph with a <a href=x>link</a> in&nbsp;it, and<br>a break.<p><b>Second one, bold
and unclosed, of some length to count.<ul><li>Item one of the list<li>Item two</ul><script>if (a < b) { "</p>" }</script><div class="ad">Buy this now, it is cheap and good.</div><form>Name <input></form></article></main>
<aside>Related things to read</aside><section id="comments"><article class="comment"><p>Nice post, thank you very much for writing it down.</p></article></section><footer>(c) 2020</footer></body></html>"""


def test_html():
    want = "Head & shoulders\n\nFirst paragraph with a link in it, and a break.\n\nSecond one, bold and unclosed, of some length to count.\n\nItem one of the list\n\nItem two"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><nav>x</nav>") == ""
    assert html_text.main_text("plain text, no tags") == "plain text, no tags"
    assert html_text.main_text("<p>one</p><p>two <a hr") == "one\n\ntwo"
    deep = "<div>" * 20_000 + "<p>deep text</p>" + "</div>" * 20_000
    assert html_text.main_text(deep) == "deep text"


def test_html_beside_the_densest():
    text = lambda k, c: (c * 9 + " ") * (k // 9)
    paragraphs = lambda n, k, c: "".join(f"<p>{text(k, c)}</p>" for _ in range(n))
    kept = lambda html: set(html_text.main_text(html).replace("\n\n", " ").split())
    links = "<ul>" + "<li><a href=x>qqqqqqqqq</a></li>" * 9 + "</ul>"
    lead = f"<h1>{text(27, 'h')}</h1><p>{text(63, 'l')}</p><ul><li>{text(36, 'i')}</li></ul>"
    for outer in ("main", "article", "div", "section"):
        assert kept(f"<body><nav>menu</nav><{outer}>{lead}<div>{paragraphs(10, 300, 'a')}</div></{outer}></body>") == {c * 9 for c in "hlia"}, outer
        assert kept(f"<body><{outer}><section>{paragraphs(5, 400, 'a')}</section><section>{paragraphs(5, 150, 'b')}</section></{outer}>{links}</body>") == {c * 9 for c in "ab"}, outer
    deep = f"<section>{paragraphs(5, 400, 'a')}<section><section>{paragraphs(2, 60, 'b')}</section></section></section>"
    assert kept(f"<body><article><header><h1><a href=x>{text(27, 'h')}</a></h1></header><div class=entry-content>{deep}</div></article></body>") == {c * 9 for c in "hab"}
    assert kept(f"<body><h1>{text(27, 'h')}</h1><article>{paragraphs(5, 400, 'a')}</article><article>{paragraphs(2, 60, 'b')}</article><div>{text(18, 'z')}</div></body>") == {c * 9 for c in "hab"}
    assert kept(f"<body><div><div>{links}<p>{text(63, 'l')}</p></div><div>{paragraphs(9, 300, 'a')}</div></div></body>") == {c * 9 for c in "la"}


def test_html_never_fails():
    assert html_text.main_text("<p>x</p><![foo[x]]><p>y</p>") == "x\n\ny" == html_text.main_text("<p>x</p><![ x><p>y</p>")
    assert html_text.main_text("<article><p>As <math><mi>x</mi></math> grows, so does the rest of it.</p></article>") == "As x grows, so does the rest of it."
    rng = random.Random(8)
    odd = ["<![", "<!", "<!-", "<!--", "]]>", "<![CDATA[", "<!DOCTYPE [", "&#x110000;", "&#", "</", "<a <b", "<p/>", "\0", "<?x", '<i a="', "</article>", "<svg/>", "<![if", "\ud7ff"]
    for _ in range(400):
        page = PAGE
        for _ in range(rng.randrange(1, 9)):
            i = rng.randrange(len(page))
            page = page[:i] + rng.choice(odd) + page[i + rng.randrange(12) :]
        assert isinstance(html_text.main_text(page), str)


def test_html_names():
    body, rest = "<p>The body of the page has a few words.</p>" * 9, "<p>Some other text.</p>"
    whole = html_text.main_text(f"<article>{body}</article>")
    for name in ("content no-sidebar", "has-banner", "share-price", "comment-free", "sidebar", "widget"):
        assert html_text.main_text(f'<body><article><h1>T</h1><div class="{name}">{body}</div></article></body>') == "T\n\n" + whole, name
    assert html_text.main_text(f'<body><div id="ad-hoc-queries">{body}</div></body>') == whole
    for name in ("no-sidebar", "has-banner", "share-price", "comment-free", "ad-hoc-queries"):  # small ones as well
        assert "Some other text." in html_text.main_text(f'<body><article>{body}<div class="{name}">{rest}</div></article></body>'), name
    for name in ("sidebar", "site-footer", "post-comments", "ad_1", "cookie-notice", "left-sidebar x", "main-nav", "ad-slot"):
        assert html_text.main_text(f'<body><article>{body}<div class="{name}">{rest}</div></article></body>') == whole, name
    assert html_text.main_text(f'<body><article>{rest}</article><div id="comments">{body}</div></body>') == "Some other text."


def test_html_rows(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x y</p>")]
    out = html_text.extract(spark.createDataFrame(rows, schema).withColumns({"text": F.lit("own")})).collect()
    assert len(out) == 4 and {(r.page_id, r.n_chars) for r in out} >= {(2, 0), (None, 3)}
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


# -- the pipeline


def test_pipeline(spark, corpus, empty):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_copies", "passages", "mixture", "tokens"]
    docs = spark.createDataFrame([*corpus, (900, corpus[0][1], None, None, None)], DOCS)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = common.written(stage(spark, docs, ""))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out
    assert docs.count() and docs.where("NOT round_trip").count() == 0
    docs = empty
    for _, stage in pipeline.STAGES:
        docs = common.written(stage(spark, docs, ""))
    assert docs.count() == 0
