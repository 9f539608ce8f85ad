"""The registered queries against their SQL, or against properties and brute force over a whole table."""

import collections
import re
import zlib

import pytest

from barloom.llm.catalog import LLM_QUERIES
from check_oracle import compare, connect

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def duck(small_sf):
    return connect(small_sf)


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in LLM_QUERIES.items() if sql])
def test_query_equals_sql(spark, small_sf, duck, name):
    run, sql = LLM_QUERIES[name]
    assert compare(run(spark, small_sf).toPandas(), duck.execute(sql).df()) == "ok"


def run(spark, small_sf, name):
    return LLM_QUERIES[name][0](spark, small_sf).toPandas()


def feasible(sizes, capacity, shards):
    used, room = 1, capacity
    for size in sizes:
        if size > capacity:
            return False
        if size > room:
            used, room = used + 1, capacity
        room -= size
    return used <= shards


def test_op1_smallest_capacity(spark, small_sf, texts):
    import hashlib

    from barloom.llm.sharding import shard_documents

    found = shard_documents(spark.read.parquet(f"{small_sf}/documents.parquet")).toPandas()
    sizes = collections.Counter()
    for text in texts.values():
        sizes[hashlib.sha256(text.encode()).digest()] += len(text.encode()) + 1
    ordered = [sizes[k] for k in sorted(sizes)]
    capacity = int(found.capacity[0])
    assert feasible(ordered, capacity, 8) and not feasible(ordered, capacity - 1, 8)
    assert found.groupby("shard")["size"].sum().max() <= capacity
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    assert found.groupby("text_crc32").shard.nunique().max() == 1
    assert all(zlib.crc32(texts[d].encode()) == c for d, c in zip(found.doc_id, found.text_crc32))


def test_op2_held_out_accuracy(spark, duck):
    found = run(spark, "/root/testdata/sf0.01", "op2_quality_classifier")
    labels = connect("/root/testdata/sf0.01").execute("select doc_id, quality from labels").df()
    told = found[found.held_out].merge(labels, on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    good, bad = told[told.quality == 1], told[told.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.7
    assert (bad.score.to_numpy()[:, None] < good.score.to_numpy()[None]).mean() > 0.97
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()


def ids_by_tokenizers(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: [*e.ids, 0] for d, e in zip(texts, encoder.encode_batch(list(texts.values()), add_special_tokens=False))}


def test_op3_packing(spark, small_sf, texts):
    import numpy as np

    from barloom.llm.bins import lower_bound

    found, ids = run(spark, small_sf, "op3_best_fit_packing"), ids_by_tokenizers(texts)
    assert sorted(found.doc_id.unique()) == sorted(ids)
    for row in found.itertuples():
        piece = ids[row.doc_id][row.start : row.start + row.length]
        assert len(piece) == row.length and zlib.crc32(np.array(piece, "<u4").tobytes()) == row.ids_crc32
    for doc_id, g in found.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.start.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() == len(ids[doc_id])
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 2048
    assert found.sequence_id.nunique() <= lower_bound(found.length.tolist(), 2048) + 1


def test_op4_components(spark, small_sf, texts):
    found = run(spark, small_sf, "op4_near_dedup").set_index("doc_id")
    sets = {}
    for d, text in texts.items():
        words = WORD.findall(text.translate(UP))
        sets[d] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {d: find(d) for d in sets} == found.component_id.to_dict()
    assert {d: len(s) for d, s in sets.items()} == found.n_shingles.to_dict()
    assert (found.kept == (found.index == found.component_id)).all()


def test_op9_round_trip(spark, small_sf, texts):
    from barloom.llm.token_matrix import restore

    matrix, ids = LLM_QUERIES["op9_token_matrix"][0](spark, small_sf), ids_by_tokenizers(texts)
    restored = {r["doc_id"]: r["ids"] for r in restore(matrix).collect()}
    assert restored == {d: i[:-1] for d, i in ids.items()}
    for row in matrix.toPandas().itertuples():
        assert len(row.ids) == 2048 and row.cu_seqlens[-1] == row.n_tokens <= 2048
        for a, b in zip(row.cu_seqlens, row.cu_seqlens[1:]):
            assert list(row.position_ids[a:b]) == list(range(b - a))
        assert not any(row.ids[row.n_tokens :])


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = host.translate(UP)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_op10_rules_and_verdicts(spark, small_sf, duck):
    found = run(spark, small_sf, "op10_url_filter").set_index("page_id")
    for page_id, url in duck.execute("select page_id, url from pages").fetchall():
        row, (host, path, rule, verdict) = found.loc[page_id], judged(url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or ("block" if row.p_block >= 0.5 else "allow"))


def test_pipeline_keeps_what_it_should(spark, small_sf, texts):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, small_sf).toPandas()
    first = packed[packed.piece == 0]
    scored = run(spark, small_sf, "op2_quality_classifier").set_index("doc_id")
    assert set(first.doc_id) <= set(scored.index[scored.predicted == 1])
    assert len({texts[d].translate(UP) for d in set(first.doc_id)}) == first.doc_id.nunique()
    assert first.doc_id.value_counts().max() <= 2
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
