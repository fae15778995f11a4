"""Chats, embeddings, and the pipeline against plain versions."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import plain_versions
from veilstat.llm import langid, quality, queries
from veilstat.llm.chat import chat_digest, format_chats, masked, parse_chats
from veilstat.llm.decontaminate import Decontaminator
from veilstat.llm.embeddings import EmbeddingJoin
from veilstat.llm.store import Scratch

DATA = "/root/testdata/sf0.001"


def test_chats_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "a\\b [\\NEXT] <s>"), (1, 2, "user", "second"), (1, 3, "assistant", "é😀"), (1, 4, "assistant", ""), (1, 5, "user", None),
        (2, 1, "assistant", said), (2, 0, "user", said), (3, 0, "[/ROLE]</s>", "odd [ROLE] role"), (4, 0, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, "user", "first"),
        (None, 0, "user", "x"), (6, 0, "assistant", "long " * 20_000), (7, 0, "user", "<"), (7, 1, "user", "/s>"), (7, 2, "assistant", "["), (7, 3, "assistant", "NEXT]"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, blocks string")
    got = format_chats(df).withColumn("turns", parse_chats(F.col("formatted"))).withColumn("own", masked(F.col("formatted"), F.col("loss"))).collect()
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.own == [x[3] or "" for x in own if x[2] == "assistant"]
    assert "[NEXT]second[/INST]" in next(r for r in got if r.conv_id == 1).formatted
    digest = {r.conv_id: r for r in chat_digest(spark, df).collect()}
    assert digest[2].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and digest[2].loss_chars == len(said) and digest[1].n_turns == 6
    assert chat_digest(spark, df.where("false")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] + rng.normal(scale=0.04 + 0.02 * (k % 8), size=64)).tolist(), (k % 5) % 2) for k in range(120)]
    rows += [(300, base[0].tolist(), 0), (301, base[0].tolist(), 1), (302, (base[0] * 3).tolist(), 0), (303, None, 0), (304, [0.0] * 64, 0), (305, [float("nan")] + [1.0] * 63, 0), (306, base[0].tolist(), None), (307, [1.0, 0.0], 0), (308, [1.0, 0.01], 0), (309, [float("inf")] + [1.0] * 63, 0), (310, [None] + [1.0] * 63, 0), (None, base[0].tolist(), 0), (311, base[3].tolist(), 1), (311, base[3].tolist(), 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, cell string")
    got = EmbeddingJoin(spark).run(df).collect()
    assert len(got) == len(rows)
    ok = [k for k, (i, v, label) in enumerate(rows) if i is not None and v is not None and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = {}
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links[rows[a][0]] = links.get(rows[a][0], 0) + (1 if rows[a][0] != 311 else 0.5)
                p, q = find(rows[a][0]), find(rows[b][0])
                root[max(p, q)] = min(p, q)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (int(links.get(r.vec_id, 0)), find(r.vec_id), find(r.vec_id) == r.vec_id), r
    assert EmbeddingJoin(spark).run(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
class TestTables:
    def test_sql(self, spark):
        duck = duckdb.connect()
        for name in os.listdir(DATA):
            duck.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
        for name, sql in queries.SQL.items():
            want = duck.sql(sql)
            df = queries.QUERIES[name](spark, DATA).select(*want.columns)
            assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want.fetchall())), name

    def test_pipeline(self, spark):
        """Every stage on the whole table against a plain version of it."""
        import public_tokenizers
        from tokenizers import Tokenizer

        docs = queries.table(spark, DATA, "documents")
        columns = docs.columns
        stages = dict(corpus_pipeline.STAGES)

        def rows_of(df):
            return {r.doc_id: r.text for r in df.collect()}

        before, left = rows_of(docs), docs
        model = quality.train(spark, left, queries.table(spark, DATA, "labels").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
        left = Scratch(spark, "t").save("a", stages["quality classifier"](spark, left, DATA))
        now = rows_of(left)
        assert left.columns == columns and set(now) == {i for i, t in before.items() if plain_versions.quality_score(model, t) >= 0.3}
        before, left = now, Scratch(spark, "t").save("b", stages["n-gram Jaccard join"](spark, left, DATA))
        now, group = rows_of(left), plain_versions.jaccard_groups(list(before.items()))
        assert left.columns == columns and set(now) == {i for i, g in group.items() if i == g} and len(now) < len(before)
        bench = [(r.item_id, r.text) for r in queries.table(spark, DATA, "benchmark").collect()]
        before, left = now, Scratch(spark, "t").save("c", stages["benchmark decontamination"](spark, left, DATA))
        now = rows_of(left)
        assert left.columns == columns and set(now) == set(before) - {i for i, _ in plain_versions.leaks(list(before.items()), bench)} and len(now) < len(before)
        before, out = now, stages["secret scans"](spark, left, DATA)
        left = Scratch(spark, "t").save("d", out)
        now = rows_of(left)
        spans = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in queries.report(spark, spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()}
        for i, t in before.items():
            cut, end = [], 0
            for _, a, b in spans[i]:
                if int(a) >= end:
                    cut += [t[end : int(a)], "[secret]"]
                end = max(end, int(b))
            assert now[i] == "".join(cut) + t[end:], i
        assert left.columns == columns and any(spans.values()) == any("[secret]" in t for t in now.values()) and all(r.n_chars == len(r.text) for r in left.collect())
        lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in now.items()}
        assert {r.doc_id: r.ids for r in stages["BPE encoding"](spark, left, DATA).collect()} == want
        got = corpus_pipeline.run(spark, DATA)
        assert {r.doc_id: r.ids for r in got.collect()} == want and set(got.columns) >= {"doc_id", "ids", "n_tokens"}

    def test_leaks(self, spark):
        docs, bench = queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "benchmark")
        got = {(r.doc_id, r.item_id): (r.n_windows, r.n_verbatim, r.n_item_windows) for r in queries.QUERIES["op7_benchmark_decontamination"](spark, DATA).collect()}
        assert got == plain_versions.leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
        assert len(got) >= 3

    def test_classifiers(self, spark):
        docs = {r.doc_id: r.text for r in queries.table(spark, DATA, "documents").collect()}
        labels = queries.table(spark, DATA, "labels")
        model = quality.train(spark, queries.table(spark, DATA, "documents"), labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
        for r in queries.QUERIES["op8_quality_classifier"](spark, DATA).collect():
            assert r.score == pytest.approx(plain_versions.quality_score(model, docs[r.doc_id]), abs=1e-5)
            assert r.held_out == (plain_versions.held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3)
        model = langid.train(queries.table(spark, DATA, "documents").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
        for r in queries.QUERIES["op10_language_id"](spark, DATA).collect():
            lang, score = plain_versions.language(model, docs[r.doc_id])
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-5) and r.held_out == (plain_versions.held(r.doc_id, 3) == 1)


def test_leaks_in_random_texts(spark):
    """Items copied, cut, edited, re-cased and re-filled into random texts of a small vocabulary, so that windows meet by chance too."""
    rnd = random.Random(21)
    vocab = ["the", "a", "of", "red", "blue", "runs", "to", "and", "km", "12", "7", "Paris", "Rome", "Ann", "$", "kg", "été"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 30)))) for k in range(40)]
    docs = []
    for i in range(150):
        own = []
        for _ in range(rnd.randrange(4)):
            w = rnd.choice(items)[1].split()
            kind = rnd.randrange(5)
            if kind == 1:
                w = [{"Paris": "Oslo", "Rome": "New York", "12": "99"}.get(x, x) for x in w]
            elif kind == 2:
                w = w[: len(w) // 2] + ["zz"] * rnd.randrange(1, 7) + w[len(w) // 2 + rnd.randrange(3) :]
            elif kind == 3:
                w = [x.upper() for x in w]
            elif kind == 4:
                w = w[rnd.randrange(5) :]
            own += w + [rnd.choice(vocab) for _ in range(rnd.randrange(6))]
        docs.append((i, " ".join(own)))
    for small in (0, 32 << 20):
        d = Decontaminator(spark, small=small)
        rows = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id): (r.n_windows, r.n_verbatim, r.n_item_windows) for r in rows} == plain_versions.leaks(docs, items)
        assert len(rows) > 50


def test_pipeline_on_odd_tables(spark):
    """Nulls, repeats with equal and with different texts, an empty table, extra columns with the names that stages use inside."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "en"), (1, long, "en"), (1, long + " more words", "en"), (2, long + " x", "en"), (3, "something else " * 9, None), (3, "not like the other one at all here", None), (4, None, None), (4, None, None), (None, long, "de"), (None, "clean text", "de"), (5, "", "en"), (6, 'password="hunter22" ' + long[::-1], "fr")]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or ""), "a", "b", "c") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, __score string, __spans string, __key string")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, DATA)
    assert kept.columns == docs.columns
    one = stages["n-gram Jaccard join"](spark, docs, DATA)
    got = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
    near = [(i, t) for i, t in got if i in (1, 2)]
    assert near == [(2, long + " x")]
    assert [x for x in got if x[0] not in (1, 2)] == sorted(set((i, t) for i, t, _ in rows if i not in (1, 2)), key=str)
    bench = stages["benchmark decontamination"](spark, docs, DATA)
    assert bench.count() == len(rows) and bench.columns == docs.columns
    secret = stages["secret scans"](spark, docs, DATA)
    assert secret.columns == docs.columns and next(r.text for r in secret.collect() if r.doc_id == 6).startswith("[secret]")
    assert stages["BPE encoding"](spark, docs, DATA).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), DATA).count() == 0, name


def test_leaking_rows_without_an_id_go_alone(spark):
    item = "why do the leaves of most trees turn red and yellow when the days get short"
    docs = spark.createDataFrame([(None, item), (None, "clean"), (7, None)], "doc_id long, text string")
    left = Decontaminator(spark).clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in left.fillna("", "text").fillna(0, "doc_id").collect()) == [(0, "clean"), (7, "")]


def test_labels_with_commas_do_not_meet(spark):
    rows = [(1, [2.0, 3.0], "1"), (2, [3.0], "1,2.0"), (3, [3.0, 4.5], "x"), (4, [2.0, 3.0], "x,y"), (5, [4.0, 6.0], "x")]
    got = EmbeddingJoin(spark).run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (0, 4), 5: (1, 3)}


def test_crowded_embeddings(spark, monkeypatch):
    """Pieces far smaller than a cell's vectors: counts and components stay those of all pairs."""
    from veilstat.llm import embeddings

    monkeypatch.setattr(embeddings, "PIECE", 5)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 20))
    x = np.concatenate([b + rng.normal(scale=0.12, size=(40, 20)) for b in base])
    x = np.concatenate([x, x[:4], 2 * x[:3]])
    got = {r.vec_id: r for r in EmbeddingJoin(spark).run(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(near, root, len(x)).min(axis=1))
    assert near.sum() > 200
    assert [(got[k].n_links, got[k].component_id) for k in range(len(x))] == [(int(near[k].sum()), int(root[k])) for k in range(len(x))]
