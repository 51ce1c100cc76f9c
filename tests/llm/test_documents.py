"""Decontamination, near-duplicates, toxicity, language model, search and archives, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from docmill.llm import decontamination, katz, neardup, topk, toxicity, warc
from docmill.llm.shared import new_path
from docmill.llm.textvec import hash_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rep int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], SCHEMA)


def sentence(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# -- decontamination


def spelt(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def contaminated(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = spelt(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, ids = spelt(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[x]
        names = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, most):
    rng = random.Random(3)
    items = [(k, sentence(rng, rng.choice([1, 3, 9, 10, 11, 25]), 60)) for k in range(25)] + [(100, None), (101, "..!"), (102, "Éa, É-b"), (None, "q r s t")]
    items += items[:3]
    docs = [(k, sentence(rng, rng.randrange(0, 900), 60)) for k in range(40)]
    docs += [(50 + k, "Intro. " + (t or "").upper().replace(" ", ", ") + " end") for k, (_, t) in enumerate(items)]
    docs += [(200, None), (201, ""), (202, "x" * 50_000 + " q r S-t"), (None, "q r s t"), (200, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(documents(spark, docs).repartition(3), bench, most).collect()
    assert sorted((tuple(r) for r in got), key=str) == contaminated(docs, items)
    clean = decontamination.decontaminate(documents(spark, docs), bench, most)
    assert clean.columns == documents(spark, []).columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((r[0] for r in contaminated(docs, items) if not r[5]), key=str)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.find_contamination(documents(spark, [(1, "a b")]), bench).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontamination.find_contamination(documents(spark, []), bench).count() == 0


# -- near-duplicates


def shingle_set(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def grouped(docs, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return sorted((i, len(x), root(i), root(i) == i) for i, x in sets)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rng = random.Random(n)
    docs, i = [], 0
    for family in range(6):
        base = sentence(rng, rng.choice([30, 90, 150])).split()
        for _ in range(25):
            docs.append((i := i + 1, edited(rng, base, rng.randrange(0, 8))))
    passage = sentence(rng, 60)
    docs += [(i := i + 1, passage + " " + sentence(rng, rng.randrange(5, 40))) for _ in range(30)]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c"), (906, "x" * 3000), (907, docs[0][1].upper())]
    got = neardup.near_duplicates(documents(spark, docs).repartition(5), n, 80).collect()
    assert sorted(tuple(r) for r in got) == grouped(docs, n, 80)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 6)
    rng = random.Random(9)
    base = sentence(rng, 120).split()
    docs = [(k, edited(rng, base, 3 + k % 7)) for k in range(80)]
    got = neardup.near_duplicates(documents(spark, docs), 4, 80).collect()
    assert sorted(tuple(r) for r in got) == grouped(docs, 4, 80)


def test_near_duplicates_repeats_and_nulls(spark):
    docs = [(5, "a b c d e f g"), (5, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (8, "something else that stands alone here")]
    got = sorted((tuple(r) for r in neardup.near_duplicates(documents(spark, docs), 4).collect()), key=str)
    assert got == sorted([(5, 4, 3, False), (5, 4, 3, False), (3, 4, 3, True), (None, 4, None, True), (8, 3, 8, True)], key=str)
    kept = neardup.deduplicate(documents(spark, docs), 4)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 8, None] and kept.columns == documents(spark, []).columns
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_matrix_and_pairwise_intersections_agree():
    rng = np.random.default_rng(1)
    left, home = ([np.unique(rng.integers(0, 90, 40).astype(np.uint64)) for _ in range(k)] for k in (7, 30))
    full = neardup._intersections(left, home, np.ones((7, 30), dtype=bool))
    assert all(full[i, j] == len(np.intersect1d(left[i], home[j])) for i in range(7) for j in range(30))
    few = np.zeros((7, 30), dtype=bool)
    few[2, 3] = True
    assert neardup._intersections(left, home, few)[2, 3] == full[2, 3]


# -- toxicity


def test_toxicity_learns_words_and_spares_clean(spark):
    rng = random.Random(5)
    bad = ["vile", "grotty", "scummer", "dolt"]

    def text(toxic):
        w = sentence(rng, rng.randrange(40, 120), 200).split()
        for _ in range(6 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    rows = [(k, text(k % 4 == 0), k % 4 == 0) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(t)) for k, _, t in rows], "doc_id long, quality int, toxic int")
    docs = [(k, t) for k, t, _ in rows] + [(1001, None), (1002, ""), (1003, "vile " * 20_000), (None, "dolt")]
    out = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, docs), labels).collect()}
    truth = {k: int(t) for k, _, t in rows}
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in truth)
    held = [k for k in truth if out[k]["held_out"]]
    assert sum(out[k]["predicted"] == truth[k] for k in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out.values())
    assert out[1001]["predicted"] == out[1002]["predicted"] == 0 and out[1003]["predicted"] == 1
    kept = toxicity.drop_toxic(documents(spark, docs), labels)
    assert kept.columns == documents(spark, []).columns and kept.count() == sum(r["predicted"] == 0 for r in out.values())


def test_toxicity_learns_from_a_sample_far_below_the_labels(spark, monkeypatch):
    """The smallest digests of many labels all begin with the same digit; either part still holds both classes."""
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 60)
    rng = random.Random(7)
    rows = [(k, sentence(rng, 60, 200) + (" vile grotty scummer dolt" * 2 if k % 2 else ""), k % 2) for k in range(4000)]
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in rows], "doc_id long, quality int, toxic int")
    some = [(k, t) for k, t, _ in rows]
    out = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, some), labels).collect()}
    held = [(out[k]["predicted"], t) for k, _, t in rows if out[k]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.97


def test_toxicity_learns_from_long_texts_and_labels_that_have_a_document(spark, monkeypatch):
    """Toxic texts beyond 20,000 characters, and most of the labels for documents that the table lacks."""
    monkeypatch.setattr(toxicity, "SAMPLE_TOXIC", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_ORDINARY", 60)
    rng = random.Random(11)
    rows = [(k, sentence(rng, 6000 if k % 2 else 60, 200) + " vile grotty scummer dolt" * (k % 2 * 30), k % 2) for k in range(240)]
    assert min(len(t) for _, t, toxic in rows if toxic) > 20_000
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(6000)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, [r[:2] for r in rows]), labels).collect()}
    assert np.mean([out[k]["predicted"] == t for k, _, t in rows if out[k]["held_out"]]) > 0.97


def test_toxicity_sample_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, late, odds: (texts.to_pylist(), toxic.tolist()))
    rows = [(k, "ä" * (600 if k == 3 else 50)) for k in range(60)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    texts, toxic = toxicity.train_on(documents(spark, rows), labels)
    assert set(texts) == {"ä" * 50} and sorted(toxic) == [0] * 10 + [1] * 10


def test_toxicity_calibrates_on_a_quarter_of_each_class():
    toxic = np.array([0] * 40 + [1] * 20 + [0] * 4)
    late = toxicity.calibration_rows(toxic)
    assert late[toxic == 0].sum() == 11 and late[toxic == 1].sum() == 5
    assert toxicity.calibration_rows(np.array([], dtype=int)).sum() == 0


def test_toxicity_equals_brute_force(spark):
    """Counts word by word under freshly opened dictionaries, and thresholds one by one."""
    rng = random.Random(23)
    texts = [sentence(rng, rng.randrange(0, 90), 250) + (" Vile, GROTTY!" if k % 3 == 0 else "") for k in range(300)]
    toxic = np.array([int(k % 3 == 0) for k in range(300)])
    model = toxicity.train(pa.array(texts), toxic, toxicity.calibration_rows(toxic), 0.25)
    settings = zstandard.ZstdCompressionParameters.from_level(
        toxicity.LEVEL, hash_log=toxicity.TABLE_BITS, chain_log=toxicity.TABLE_BITS,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    squeeze = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings) for c in model.contents]

    def score(text):
        n = bad = 0
        for word in spelt(text):
            raw = np.frombuffer(word.encode() + b"\0" * 8, np.uint8)
            window = toxicity.codes(hash_words(raw, np.array([0]), np.array([len(raw) - 8])))
            n += 1
            bad += len(squeeze[0].compress(window)) - len(squeeze[1].compress(window)) >= toxicity.GAIN
        x = max(bad - model.rate * n, 0) / math.sqrt(model.rate * n + 1)
        return max((share for least, share in zip(*model.steps) if x >= least), default=model.steps[1][0])

    cases = [*texts[:60], None, "", "...", "vile " * 500, "GROTTY"]
    assert np.allclose(model.score(pa.array(cases, pa.string())), [score(t) for t in cases])
    assert list(model.steps[1]) == sorted(model.steps[1])


def test_toxicity_of_repeated_ids_does_not_depend_on_order(spark):
    rng = random.Random(29)
    rows = [(k, sentence(rng, 50, 100) + (" vile grotty" if k % 2 else "")) for k in range(200)]
    rows += [(k, sentence(rng, 20 + k % 50, 100)) for k in range(0, 200, 3)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    models = [toxicity.train_on(documents(spark, some), labels) for some in (rows, rows[::-1])]
    assert models[0].contents == models[1].contents and models[0].rate == models[1].rate
    assert all(np.array_equal(a, b) for a, b in zip(models[0].steps, models[1].steps))


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(documents(spark, [(1, "a"), (2, None)]), labels).collect()
    assert [(r["score"], r["predicted"]) for r in rows] == [(0.0, 0), (0.0, 0)]
    assert toxicity.score_documents(documents(spark, []), labels).count() == 0


# -- language model


def katz_scores(docs):
    end = "\0end"
    tokens = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UPPER)) + [end]
    one, two = Counter(), Counter()
    for i, t in docs:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            w = tokens(t)
            one.update(w)
            two.update(zip([end, *w], w))
    top, train = 5, sum(one.values())

    def turing(counts):
        """r* / r by the Good-Turing formula with Katz's correction, half a count less where it gives nothing."""
        n = Counter(counts.values())
        out = {r: (r - 0.5) / r for r in range(1, top + 1)}
        for r in range(1, top + 1):
            if n[1] and n[r] and (a := (top + 1) * n[top + 1] / n[1]) < 1:
                x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
                out[r] = x if 0 < x < 1 else out[r]
        return out

    d1, d = turing(one), turing(two)
    cut = lambda d, c: c * d.get(c, 1.0)
    spare = sum(c - cut(d1, c) for c in one.values())
    shrink, unknown = (1.0, spare / train) if spare > 0 else (train / (train + 1), 1 / (train + 1))
    single = lambda w: shrink * cut(d1, one[w]) / train if one[w] else unknown
    after = defaultdict(dict)
    for (a, b), c in two.items():
        after[a][b] = c
    weight = {}
    for a, c in after.items():
        left = sum(x - cut(d, x) for x in c.values())
        scale = 1.0 if left > 0 else one[a] / (one[a] + 1)
        weight[a] = scale, (left / one[a] if left > 0 else 1 - scale) / (1 - sum(map(single, c)))
        total = sum(scale * cut(d, x) / one[a] for x in c.values()) + weight[a][1] * (sum(single(w) for w in one if w not in c) + unknown)
        assert total == pytest.approx(1)
    assert sum(map(single, one)) + unknown == pytest.approx(1)
    out = []
    for i, t in docs:
        w, score = tokens(t), 0.0
        for a, b in zip([end, *w], w):
            p = single(b) if not one[a] else weight[a][0] * cut(d, two[a, b]) / one[a] if (a, b) in two else weight[a][1] * single(b)
            score += math.log10(p)
        base = sum(math.log10((one[x] + 0.1) / (train + 0.1 * (len(one) + 1))) for x in w)
        out.append((i, len(w), sum(one[x] > 0 for x in w), train, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, part", [(500_000, 3_000_000), (20, 500)])
def test_katz_equals_brute_force(spark, monkeypatch, hot, part):
    monkeypatch.setattr(katz, "HOT_COUNT", hot)
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    rng = random.Random(11)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(rng.randrange(0, 200)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "Only ONCE here é " + "y" * 2000), (500, None), (None, "w1 w2")]
    got = katz.score_documents(documents(spark, docs).repartition(3)).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    for a, b in zip(got, katz_scores(docs), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("docmill_chunks")]


def test_katz_without_training_rows_or_rows(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = katz.score_documents(documents(spark, [(held, "a b")])).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (True, 3, 0, 0, 0.0)
    assert katz.score_documents(documents(spark, [])).count() == 0


# -- search


def nearest(rows, k):
    v = {i: [math.floor(64 * float(x)) for x in e] for i, e in rows}
    out = []
    for q in v:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("cell", [65_536, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "ANNULUS", 16)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=12)]) for k in range(300)] + [(300 + k, [0.5] * 12) for k in range(150)] + [(600, [1.0] * 5), (601, [])]
    bad = [(700, None), (701, [1.0, None]), (702, [float("nan")]), (703, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(rows + bad + rows[:30], "vec_id long, embedding array<float>")
    exact = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    got = topk.top_k(df.repartition(4), k=7).collect()
    assert sorted(tuple(r) for r in got) == nearest(exact, 7)


def test_top_k_skips_annuli_of_clustered_data(spark, monkeypatch):
    """Far clusters: nearly all annuli are closed by their bound, and later steps find them so."""
    monkeypatch.setattr(topk, "ANNULUS", 16)
    monkeypatch.setattr(topk, "STEPS", (2, 4))
    monkeypatch.setattr(topk, "discard", lambda *tables: None)  # they are counted below
    seen = {"topk-visits": [], "topk-queries": []}
    monkeypatch.setattr(topk, "save", lambda df, name, keep=topk.save: seen.setdefault(name, []).append(out := keep(df, name)) or out)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 50
    rows = [(k, [float(x) for x in centres[k % 40] + rng.normal(size=8) * 0.1]) for k in range(1200)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    assert sorted(tuple(r) for r in got) == nearest(rows, 5)
    queries, visits = seen["topk-queries"][0].count(), [v.count() for v in seen["topk-visits"]]
    annuli = seen["topk-annuli"][0].select("pivot", "annulus").distinct().count()
    assert len(visits) == 3 and annuli > 60 and sum(visits) < queries * annuli / 4


def test_top_k_of_few_large_and_none(spark):
    df = spark.createDataFrame([(0, [1e6, -3.0]), (1, [2e6, 5.0]), (20, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == nearest([(r[0], r[1]) for r in df.collect()], 20)
    assert topk.top_k(df.limit(0)).count() == 0


# -- archives


def test_warc_round_trip(spark):
    big, other, lone = "é" * 700, "b" * 1200, "c" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/ b\n", big), (3, None, None), (9, "http://a/9", big), (4, "u", "small"), (5, "u", "small"), (4, "u", "small"), (None, "n", other), (None, "n", lone), (None, "m", lone)]
    rows += [(7, "x", other), (7, None, other), (7, "x", other), (6, "y", other), (6, "y", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    named = defaultdict(list)
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            named[h].append(i)
    want, spent = [], set()
    for i, _, h in rows:
        payload = (h or "").encode()
        first = h not in named or (i == max(named[h]) and h not in spent)
        spent |= {h} if first else set()
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "response" if first else "revisit", None if first else max(named[h])))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_deals_one_heavy_id_to_several_shards(spark):
    rng = random.Random(2)
    rows = [(5 if k % 3 else None if k % 2 else k, f"http://h/{k}", sentence(rng, 300)) for k in range(240)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for n in (1, 5):
        folder = new_path(spark, "warc-hot")
        manifest = warc.write_archive(df.repartition(n, "html"), folder, shard_bytes=20_000).collect()
        found.append(sorted((r["name"], r["sha1"]) for r in manifest))
        assert max(r["n_records"] for r in manifest) < 80 and sum(r["n_records"] for r in manifest) == 240
        back = warc.read_archive(spark, folder)
        assert back.rdd.getNumPartitions() == len(manifest)
        assert sorted(str(r["page_id"]) for r in back.collect()) == sorted(str(r[0]) for r in rows)
    assert found[0] == found[1]


def test_warc_files_are_the_same_however_dealt(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12) if k % 5 else k, f"http://h/{k}", sentence(rng, 400)) for k in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for n in (1, 7):
        folder = new_path(spark, "warc-test")
        manifest = warc.write_archive(df.repartition(n, "html"), folder, shard_bytes=20_000, roll_bytes=5_000)
        found.append(sorted((r["name"], r["sha1"], r["n_records"]) for r in manifest.collect()))
        ids = [r["page_id"] for r in warc.read_archive(spark, folder).orderBy("file").collect()]
        assert sorted(ids) == sorted(r[0] for r in rows)
    assert found[0] == found[1] and len(found[0]) > 5 and len({n.split("-")[1] for n, _, _ in found[0]}) > 2


def test_warc_reader_refuses_damage():
    member = warc.page_record(1, "http://a/", b"x" * 50, None)
    plain = zlib.decompress(member, 31)
    assert warc.parse_record(plain)[:4] == (1, 50, hashlib.sha1(b"x" * 50).hexdigest(), "response")
    with pytest.raises(ValueError):
        warc.parse_record(plain.replace(b"xxx", b"xyx", 1))
