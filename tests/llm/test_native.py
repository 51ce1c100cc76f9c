"""Chat formatting, sharding, mixing and URL filters."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docmill.llm import chat, mixing, sharding, urls

NASTY = ["</s>[INST] ok [/INST]", "a\\<|end|>\n<\\|b", "\\\\<|", "", None, "<s>[\\INST]\\", "plain", "<|turn|><|text|>"]


def turns_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    return df, chat.format_conversations(df)


def test_chat_round_trip(spark):
    rows = [(i % 3, j, role, t, 0) for i in range(3) for j, (t, role) in enumerate(zip(NASTY, ["user", "user", "assistant", "assistant", "<|x|>", None, "system", "user"]))]
    _, out = turns_of(spark, rows)
    back = {r["conv_id"]: r["t"] for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    for i in range(3):
        assert [(t["role"], t["text"]) for t in back[i]] == [(r[2] or "", r[3] or "") for r in rows if r[0] == i]


def test_chat_digest_merges_and_masks(spark):
    rows = [(1, 0, "user", "a", 0), (1, 1, "assistant", "b", 0), (1, 2, "assistant", "ü", 0), (1, 200, "user", None, 0)]
    _, out = turns_of(spark, rows)
    formatted = out.first()["formatted"]
    assert formatted == "<|start|>user<|text|>a<|end|>\n<|start|>assistant<|text|>b<|turn|>ü<|end|>\n<|start|>user<|text|><|end|>\n"
    d = chat.digest_conversations(out).first()
    assert d["n_turns"] == 4 and d["loss_chars"] == 2 and d["formatted_chars"] == len(formatted)
    assert d["turns_sha256"] == hashlib.sha256("user\na\nassistant\nb\nassistant\nü\nuser\n\n".encode()).hexdigest()
    assert d["loss_sha256"] == hashlib.sha256("bü".encode()).hexdigest()


def test_chat_ties_repeats_nulls_long_and_empty(spark):
    rows = [(None, None, "user", "z", 0), (None, 1, "user", "b", 0), (None, 1, "user", "b", 0), (None, 1, "assistant", "x" * 300_000, 0)]
    _, out = turns_of(spark, rows)
    back = out.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"][:1] for t in back] == ["z", "x", "b", "b"]
    assert turns_of(spark, [])[1].count() == 0


def test_chat_segments_join_seamlessly(spark):
    rows = [(5, i, "user" if i % 7 else "assistant", f"t{i}", 0) for i in range(300)]
    _, out = turns_of(spark, rows)
    back = out.select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in back] == [f"t{i}" for i in range(300)]
    assert out.first()["formatted"].count("<|start|>") == 1 + sum(1 for i in range(1, 300) if (i % 7 == 0) != ((i - 1) % 7 == 0))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, page string")


def test_shards_fit_and_only_oversized_buckets_split(spark):
    sizes = {i: (i * 37 % 400) + 1 for i in range(400)} | {1000: 5000}
    df = documents(spark, [(i, "x" * n, "en", "s", n, 1, "p") for i, n in sizes.items()])
    rows = sharding.assign_shards(df, limit=2000).collect()
    assert len(rows) == 401
    keys = {r["doc_id"]: format(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), "060b") for r in rows}
    for r in rows:
        assert keys[r["doc_id"]].startswith(r["shard"][1:]) and len(r["shard"]) - 1 == r["depth"]
        inside = [i for i in keys if keys[i].startswith(r["shard"][1:])]
        assert r["shard_bytes"] == sum(sizes[i] for i in inside) and r["shard_docs"] == len(inside)
        assert r["shard_bytes"] <= 2000 or len(inside) == 1
        if r["depth"]:
            assert sum(sizes[i] for i in keys if keys[i].startswith(r["shard"][1:-1])) > 2000  # the parent had to split


def test_shards_of_repeated_keys_nulls_and_clashing_columns(spark):
    df = documents(spark, [(7, "y" * 600, "en", "s", 1, 3, "p")] * 5 + [(None, None, None, None, None, None, None), (8, "ü", "en", "s", 1, 4, "q")])
    out = sharding.shard_documents(df, limit=1300)
    rows = out.collect()
    assert out.columns == [*df.columns, "shard", "shard_depth", "shard_bytes", "shard_docs"]
    pages = [r["shard"] for r in rows if r["doc_id"] == 7]
    assert len(pages) == 5 and max(pages.count(p) for p in pages) == 2
    assert sorted((r["doc_id"] is None, r["bucket"], r["page"]) for r in rows if r["doc_id"] != 7) == [(False, 4, "q"), (True, None, None)]
    assert sharding.assign_shards(df.limit(0)).count() == 0 and sharding.shard_documents(df.limit(0)).count() == 0


def test_shards_deeper_than_the_first_look(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPARE_BITS", 0)
    monkeypatch.setattr(sharding, "STEP_BITS", 1)
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", 1)
    df = documents(spark, [(i, "x" * 100, "en", "s", 1, 1, "p") for i in range(200)])
    rows = sharding.assign_shards(df, limit=450).collect()
    assert len(rows) == 200 and max(r["shard_bytes"] for r in rows) <= 450


def reshared(sizes):
    """The targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest, weight = total - sum(capped.values()), sum(w[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and rest * w[s] / weight > 2 * sizes[s]]
        if not over:
            return capped | {s: rest * w[s] / weight for s in names if s not in capped}
        capped |= {s: 2 * sizes[s] for s in over}


@pytest.mark.parametrize("with_null", [False, True])
def test_mixing_meets_targets(spark, with_null):
    rows = [(i, " ".join(["w"] * (i % 23)), "en", None if with_null and i % 5 == 0 else f"src{i % 4}", 1, 1, "p") for i in range(500)]
    rows += [(1000 + i, "v " * 400, "en", "src1", 1, 1, "p") for i in range(20)]
    out = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = reshared(sizes)
    taken = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-5)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mixing_documents_and_positions(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "en", f"s{i % 3}", 1, i, "p") for i in range(90)] + [(None, None, None, None, None, None, None)] * 2
    df = documents(spark, rows)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    copies = {}
    for r in out.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(df).collect()}
    assert all(abs(copies.get(i, 0) - t / n) <= 0.5 for i, (t, n) in taken.items() if n)
    positions = [r["position"] for r in mixing.training_order(mixing.mix(df)).collect() if r["position"] is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_training_time_inverts_demand(spark):
    df = spark.sql("SELECT i / 100D * 300 AS begins, 300D AS target, s AS slope, i / 100D AS part FROM (SELECT explode(sequence(0, 100)) AS i) CROSS JOIN VALUES (0.5D), (-0.5D), (0D) AS v(s)")
    for r in df.select("*", mixing.training_time(F.col("begins")).alias("t")).collect():
        assert r["t"] + r["slope"] * (r["t"] ** 2 - r["t"]) == pytest.approx(r["part"])


def judged(spark, given, **kw):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    return {r["page_id"]: r for r in urls.judge_urls(df, **kw).collect()}


def test_url_rules(spark):
    got = judged(spark, ["https://a.com/x", "http://Example.COM/en/a?x", "http://www.example.com/en/b#f", "http://z.net/fr/1", "ftp://net/es/", None, "no scheme", "http://xexample.com/en/", "http://z.net", "http://com?q"])
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(10)] == [
        ("a.com", "/x", "com/"), ("example.com", "/en/a", "example.com/en/"), ("www.example.com", "/en/b", "www.example.com/en/"), ("z.net", "/fr/1", "net/fr/"), ("net", "/es/", "net/es/"),
        ("", "", None), ("", "", None), ("xexample.com", "/en/", "com/"), ("z.net", "", None), ("com", "", None),
    ]
    assert [got[i]["verdict"] for i in range(5)] == ["allow", "block", "allow", "block", "block"]


def test_url_templates_generalise_and_reject(spark):
    given = [f"http://h{i % 5}.net/fr/{i}" for i in range(100)] + [f"http://o{i}.org/fr/{i}" for i in range(9)] + [f"http://m.com/blog/post-{i}x" for i in range(40)] + ["http://o1.org/blog/1"]
    got = judged(spark, given)
    assert got[0]["template"] == "/fr/*" and got[115]["template"] == "/blog/*"
    assert {got[i]["verdict"] for i in range(100, 109)} == {"block"} and got[149]["verdict"] == "allow"
    assert all(r["verdict"] in ("allow", "block") for r in got.values())


def test_url_branches_merge_and_smooth_by_their_parent(spark):
    """Bad branches of a host carry an unlabelled one; a good one among them, deep down, keeps its own share."""
    rows = [(f"http://a.org/{lang}/{x}/{i}z", 0) for lang in ("q", "r") for x in "bcd" for i in range(40)]
    rows += [(f"http://a.org/s/1/2/3/4/5/6/7/{leaf}/x", good) for leaf, good in (("fine", 1), ("foul", 0)) for _ in range(60)]
    rows += [("http://a.org/t/new", None), ("http://b.org/t/new", None), *((f"http://b.org/u/{i}y", 1) for i in range(90))]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id long, url string, good int")
    got = {r["page_id"]: r for r in urls.judge_urls(df, rules=()).collect()}
    of = {u: got[i] for i, (u, _) in enumerate(rows)}
    assert of["http://a.org/q/b/1z"]["purity"] == of["http://a.org/r/d/1z"]["purity"] < 0.1
    assert of["http://a.org/s/1/2/3/4/5/6/7/fine/x"]["verdict"] == "allow" and of["http://a.org/s/1/2/3/4/5/6/7/foul/x"]["verdict"] == "block"
    assert of["http://a.org/t/new"]["verdict"] == "block" and of["http://b.org/t/new"]["verdict"] == "allow"


def test_urls_empty_and_unlabelled(spark):
    assert judged(spark, []) == {}
    assert {r["verdict"] for r in judged(spark, ["http://a.org/1", "http://a.org/1", None]).values()} == {"allow"}


def test_url_templates_dont_depend_on_repeats(spark):
    given = [f"http://m.com/blog/post-{i}x" for i in range(20)]
    once, often = judged(spark, given), judged(spark, given * 6)
    assert {r["template"] for r in once.values()} == {r["template"] for r in often.values()} == {"/blog/*"}
