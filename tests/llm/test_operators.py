"""The corpus operators against their plain versions: supplied tables, and small ones with every odd case."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, embed_dedup, line_dedup, minhash, packing, quality, secrets, sharding, suffix_dedup, token_output
from graphloom.llm import queries as registered
from graphloom.llm._graph import components
from graphloom.llm._text import stored
from graphloom.llm._tok import default_path
from graphloom.llm.suffix_array import suffix_array

from ..conftest import DATA
from . import brute

SF = f"{DATA}/sf0.001"
CLASHING = "doc_id long, text string, block long, shard int, n long, v string, spans string, _row string, _all int, kept string, rest string"


def odd_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(70))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    near_copies = []
    for _ in range(45):
        w = base[0].split()
        w[r.randrange(len(w))] = word()
        near_copies.append(" ".join(w))
    lines = "\n".join(" ".join(word() for _ in range(14)) for _ in range(5))
    changed = lines.split("\n")
    changed[1] = " ".join([*changed[1].split()[:5], "zz", *changed[1].split()[6:]])
    changed[2] = " ".join(changed[2].split()[1:])
    return [None, "", "   ", "\n\n", "a", "one two three", "one two three", passage, f"{base[1]} {passage} {base[2]}", base[3] + passage[:49], *base, base[0], *near_copies, lines, "\n".join(changed), lines.upper(), "x" * 200_000, " ".join(word() for _ in range(20_000)), "ab" * 300, "don't we'll 12 345\t  　 naïve 日本語", "API_KEY = 'abcdefghijkl0123'", "AKIA" + "Q" * 16 + " 0123456789abcdef0"]


@pytest.fixture(scope="module")
def odd():
    return [(3 * i + 1, t) for i, t in enumerate(odd_texts())]


@pytest.fixture(scope="module")
def odd_df(spark, odd):
    rows = [(i, t, None, 1, 2, "v", None, "r", 5, None, "q") for i, t in odd]
    return stored(spark.createDataFrame(rows, CLASHING).repartition(3), "odd")


@pytest.fixture(scope="module")
def empty_df(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def both(given, odd_df, odd):
    return [given, (odd_df, odd)]


def test_op1_suffix_dedup(given, odd_df, odd, empty_df):
    for df, rows in both(given, odd_df, odd):
        assert got(suffix_dedup.dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)
    assert suffix_dedup.dedup(empty_df).count() == 0


def test_op1_spans_and_kept_bytes(odd_df, odd):
    text = {i: (t or "").encode() for i, t in odd}
    for r in suffix_dedup.dedup(odd_df, with_text=True).collect():
        gone = np.zeros(len(text[r.doc_id]), bool)
        for s in r.spans:
            gone[s.s : s.e] = True
        assert bytes(np.frombuffer(text[r.doc_id], np.uint8)[~gone]) == bytes(r.kept_bytes)


@pytest.mark.parametrize("seed", range(6))
def test_op1_suffix_array_by_induced_sorting(seed):
    r = np.random.default_rng(seed)
    t = r.integers(0, 2 + seed, 300) if seed else np.zeros(50, np.int64)
    assert suffix_array(t, 10).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_op2_records(spark, given, odd_df, odd, empty_df):
    path = default_path()
    for df, rows in both(given, odd_df, odd):
        folder = token_output.write_records(df, file_bytes=20_000)
        want = brute.records(rows, path)
        assert got(token_output.read_records(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == want
        shuffled = token_output.read_records(spark, folder, seed=4, with_ids=True)
        ids = {r.doc_id: list(r.ids) for r in shuffled.collect()}
        assert ids == dict(brute.encoded(rows, path))
    assert token_output.read_records(spark, token_output.write_records(empty_df)).count() == 0


def test_op2_checksum_is_crc32c():
    data = np.frombuffer(b"123456789" + b"" + b"a" * 1000, np.uint8)
    crc = token_output.crc32c(data, np.array([0, 9, 9, 1009]))
    assert int(crc[0]) == 0xE3069283 and int(crc[1]) == 0


def test_op2_damage_is_found(spark, odd_df):
    folder = token_output.write_records(odd_df)
    fs, root = token_output.file_system(folder)
    from pyarrow import fs as pafs

    name = next(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".bin") and f.size > 40)
    raw = bytearray(fs.open_input_file(name).read())
    raw[len(raw) // 2] ^= 1
    with fs.open_output_stream(name) as f:
        f.write(bytes(raw))
    with pytest.raises(Exception, match="damaged record"):
        token_output.read_records(spark, folder).collect()


def test_op3_packing(given, odd_df, odd, empty_df):
    path = default_path()
    for df, rows in both(given, odd_df, odd):
        out = got(packing.pack(df), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
        assert sorted(r[:5] for r in out) == brute.pieces(rows, path)
        bins: dict[int, list] = {}
        for r in out:
            bins.setdefault(r[5], []).append((r[6], r[3]))
        for parts in bins.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 2048
        assert len(bins) <= brute.best_fit_bins([r[3] for r in out])
    assert packing.pack(empty_df).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_op3_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 100) for _ in range(400)]
    rows = packing.plan({n: lengths.count(n) for n in set(lengths)}, 100)
    used = {s0 + k for _, r0, r1, s0, _ in rows for k in range(r1 - r0)}
    assert len(used) == brute.best_fit_bins(lengths, 100)


def test_op4_decontamination(spark, given, odd_df, odd, empty_df):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs, rows = given
    assert got(decontaminate.report(decontaminate.find(docs, items)), *cols) == brute.contamination(rows, [tuple(r) for r in items.select("item_id", "text").collect()])
    text = dict(odd)
    own = [(7, text[22][:150]), (10, "ONE two"), (2, None), (3, ""), (7, "one, two; THREE"), (11, " ".join(text[25].split()[5:20]))]
    small = spark.createDataFrame(own, "item_id long, text string")
    want = brute.contamination(odd, own)
    assert any(r[-1] for r in want)
    assert got(decontaminate.report(decontaminate.find(odd_df, small)), *cols) == want
    assert got(decontaminate.report(decontaminate.find(odd_df, small, block_bytes=40)), *cols) == want
    assert decontaminate.find(empty_df, small).count() == 0
    assert decontaminate.report(decontaminate.find(odd_df, small.limit(0))).filter("contaminated").count() == 0


def test_op5_line_dedup(given, odd_df, odd, empty_df):
    for df, rows in both(given, odd_df, odd):
        out = line_dedup.dedup(df)
        assert out.columns == [*df.columns, "_lines", "_removed"]
        key = lambda r: (r[0], r[1], r[2], r[3] or "")
        assert sorted(got_raw(out), key=key) == sorted(brute.lines(rows), key=key)
    assert line_dedup.dedup(empty_df).count() == 0
    same = odd_df.select("rest", "_row", "_all").distinct().collect()
    assert line_dedup.dedup(odd_df).select("rest", "_row", "_all").distinct().collect() == same


def got_raw(out):
    return [tuple(r) for r in out.select("doc_id", "_lines", "_removed", "text").collect()]


def test_op6_near_documents(given, odd_df, odd, empty_df):
    for df, rows in both(given, odd_df, odd):
        for k in (4, 5):
            assert got(minhash.dedup(df, k=k), "doc_id", "n_shingles", "component_id", "kept") == brute.near(rows, k)
    assert minhash.dedup(empty_df).count() == 0


def test_op6_long_lists_and_hot_groups(spark):
    """More near copies than a list may hold, in two groups that share a passage."""
    r = random.Random(3)
    one, two = ([f"w{r.randint(0, 999)}" for _ in range(80)] for _ in range(2))
    rows = []
    for i in range(160):
        w = list(one if i % 2 else two)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = f"z{r.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    assert got(minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept") == brute.near(rows)


def test_op7_near_vectors(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 24))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 60] * r.uniform(0.1, 9) + r.normal(size=24) * r.choice([0.02, 0.3])], i % 3) for i in range(900)]
    rows += [(900 + i, rows[5][1], None) for i in range(40)]
    odd_rows = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [math.nan] * 24), (2004, [math.inf] + [1.0] * 23), (2005, [None] + [1.0] * 23), (2006, [1.0]), (2007, [-0.0, 1.0])]
    rows += [(i, v, 0) for i, v in odd_rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {x.vec_id: x for x in embed_dedup.links(df).collect()}
    assert len(out) == len(rows)
    want, links = brute.cosine_links([(i, v) for i, v, _ in rows])
    root = brute.roots(want, links)
    assert all(out[i].n_links <= n for i, n in want.items())
    assert sum(x.n_links for x in out.values()) >= 0.95 * sum(want.values()) > 0
    assert sum(out[i].component_id == c for i, c in root.items()) >= 0.98 * len(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in out.values())
    assert embed_dedup.links(df.limit(0)).count() == 0


def test_op8_secrets(given, odd_df, odd, empty_df):
    for df, rows in both(given, odd_df, odd):
        assert got(secrets.scan(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == brute.secrets(rows)
    assert secrets.scan(empty_df).count() == 0


def test_op8_network_on_held_out_findings(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    net, told = secrets.trained(docs)
    assert told["made_found"] >= 0.96 * told["made_secrets"] and told["made_false"] <= 0.02 * told["made_others"]
    assert told["texts_false"] <= 0.02 * told["texts_others"]


def test_op8_scores_every_candidate_and_leaves_prose_alone(spark):
    key = "sk-aB3dE5fG7hJ9kL1mN3pQ5rS7"
    long_key = "q7Rk2LmX9vTz4BnC8wYp3HsD6fGjK1aE5uQoZxN0iVbMlWcJtRySdFhPgUeAk"
    texts = ["the key " + key + " is set", "auth " + long_key + " end", "supercalifragilistic expialidocious word", "token: abcdefABCDEF1234"]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].spans == f"model:8:{8 + len(key)}" and out[1].spans == f"model:5:{5 + len(long_key)}"
    assert out[2].spans == "" and out[3].spans == "assign:0:23" and out[3].n_model == 0


def test_op2_ids_and_marks(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>  z", "<|endof", "text|>", "don't<|endoftext|>'s"]
    rows = [(None, "null id"), (-(1 << 63), "least"), ((1 << 63) - 1, "most"), (5, "same"), (5, "same"), (5, "other"), (None, None), *enumerate(texts, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = token_output.read_records(spark, token_output.write_records(df), with_ids=True).collect()
    path = default_path()
    want = sorted((i is not None, i or 0, ids) for i, ids in brute.encoded(rows, path))
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in out) == want
    order = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [r[0] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:k]) for k in range(len(order))]
    assert [r.ids_crc32 for r in order] == [brute.crc(list(r.ids)) for r in order]
    pieces = got(packing.pack(df.filter("doc_id is not null")), "doc_id", "piece", "start", "length", "ids_crc32")
    assert pieces == brute.pieces([r for r in rows if r[0] is not None], path)


def test_op4_null_items_mark_words_without_a_name(spark):
    docs = spark.createDataFrame([(None, "one two three"), (2, "two"), (2, "two")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), (7, "two")], "item_id long, text string")
    rows = decontaminate.report(decontaminate.find(docs, items)).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in rows) == [(0, 2, 1), (2, 1, 1), (2, 1, 1)]


def test_op9_against_plain_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(None, "null id"), (999_999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    weights, ratio = brute.log_weights(rows, [tuple(r) for r in labels.collect()])
    assert np.allclose(model["ratio"], ratio)
    out = quality.resample(quality.judged(df, model), 25).collect()
    noise = brute.gumbel([r.doc_id for r in out])
    for r, g in zip(out, noise, strict=True):
        assert math.isclose(r.log_weight, weights[r.doc_id], rel_tol=1e-9, abs_tol=1e-7)
        assert math.isclose(r.gumbel, r.log_weight + g, rel_tol=1e-9, abs_tol=1e-9)
    order = sorted(out, key=lambda r: (-r.gumbel, r.doc_id is None, r.doc_id or 0))
    assert {(r.doc_id, r.gumbel) for r in out if r.sampled} == {(r.doc_id, r.gumbel) for r in order[:25]} and sum(r.sampled for r in out) == 25


def test_op9_takes_exactly_k_among_ties(spark):
    rows = [(i % 5, "same text", float(i % 2)) for i in range(50)]
    scores = spark.createDataFrame(rows, "doc_id long, text string, log_weight double")
    for k in (0, 1, 7, 23, 49, 50, 60):
        out = quality.resample(scores, k).collect()
        assert len(out) == 50 and sum(r.sampled for r in out) == min(k, 50)
        if 0 < k < 50:
            assert min(r.gumbel for r in out if r.sampled) >= max(r.gumbel for r in out if not r.sampled)


def test_op9_importance_resampling(spark, given, odd_df, empty_df):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.resample(quality.judged(docs, model), 300).join(labels, "doc_id").toPandas()
    good = out[(out.quality == 1) & (out.toxic == 0)]
    junk = out[out.quality == 0]
    assert good.kept.mean() >= 0.98 and junk.kept.mean() <= 0.15
    every = quality.resample(quality.judged(docs, model), 300).select("doc_id", "gumbel", "sampled").toPandas()
    want = set(every.sort_values(["gumbel", "doc_id"], ascending=[False, True]).doc_id[:300])
    assert set(every[every.sampled].doc_id) == want
    judged = quality.judged(odd_df, model, ["rest"])
    assert judged.count() == odd_df.count() and judged.filter("not kept and n_grams = 0").count() == 0
    assert quality.judged(empty_df, model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert quality.judged(docs, none).filter("not kept").count() == 0


def test_op10_shards(spark, given, odd_df, empty_df):
    import zlib

    docs, rows = given
    for df, pairs in ((docs, rows), (odd_df.withColumn("source", F.lit(None).cast("string")), [tuple(r) for r in odd_df.select("doc_id", "text").collect()])):
        out = sharding.interleave(df).collect()
        assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs)
        shards: dict[int, list] = {}
        for r in out:
            shards.setdefault(r.shard, []).append(r.slot)
        assert set(shards) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
        sizes = [len(shards.get(k, [])) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1
    per = docs.groupBy("source").count().collect()
    out = sharding.interleave(docs, shards=4).groupBy("source", "shard").count().collect()
    for p in per:
        n = [r["count"] for r in out if r.source == p.source]
        assert max(n) - (min(n) if len(n) == 4 else 0) <= 2
    assert sharding.interleave(empty_df.withColumn("source", F.lit("a"))).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(200)]
    want = brute.roots({x for e in links for x in e}, links)
    out = components(spark.createDataFrame(links, "a long, b long"))
    real = {x for e in links for x in e if e[0] != e[1]}
    assert {r.node: r.component for r in out.collect()} == {k: v for k, v in want.items() if k in real}


def test_every_operator_is_registered():
    names = registered.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
