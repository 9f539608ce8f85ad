"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import (
    exact_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sharding, token_matrix, url_filter,
)

LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "The same text is here", "en", "a", 1, "x"), (2, "the SAME text is here", "en", "a", 1, "x"),
    (3, "the same text is here", None, None, None, None), (4, None, "en", "b", 1, "y"), (5, "", "en", "b", 1, "y"),
    (None, "a text of no id", "en", "b", 1, "z"), (6, LONG, "en", "c", 1, "z"), (7, LONG + " end", "en", "c", 1, "z"),
    (8, "x" * 50_000, "en", "c", 1, "z"), (9, " \n\t ", "en", "a", 1, "z"), (9, " \n\t ", "en", "a", 1, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    # further columns clash with what the operators name their own
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in ("row", "size", "print", "node", "name", "token", "rule")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 0), (None, 1, None), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def pages(spark):
    urls = [None, "", "no scheme", "http://", "https://X.Example.com/en/1?a=b#c", "ftp://h.net", "http://a.net/es/", "http://" + "a" * 9000]
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[-2:])], "page_id long, url string, rule string")


OPERATORS = {
    "shards": sharding.shard_documents, "exact": exact_dedup.exact_duplicates, "near": near_dedup.near_duplicates,
    "mix": mixing.mix, "pack": packing.pack, "spans": pii.digest, "rules": quality_rules.judge, "matrix": token_matrix.token_matrix,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_shards(docs):
    rows = sharding.shard_documents(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    assert {r["size"] for r in rows if r["doc_id"] in (4, 5)} == {1}
    # one group each, whatever its share
    assert len({r["shard"] for r in rows if r["doc_id"] == 9}) == 1


def test_one_group_with_most_bytes_leaves_the_rest_even(spark):
    texts = ["g" * 100] * 40 + [f"{i:04d}" * 20 for i in range(200)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=8).toPandas()
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() == rows.capacity[0]
    # only the shard that ends where the group begins is short of an even share
    others = sizes.nsmallest(7).iloc[1:]
    assert others.max() < 1.1 * others.min()


def test_exact(docs):
    rows = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs, block_bytes=64).collect()}
    assert [rows[i]["keep_id"] for i in (1, 2, 3, 4, 5, 9)] == [3, 3, 3, 5, 5, 9]
    assert rows[9]["group_size"] == 2 and rows[None]["kept"] and rows[6]["keep_id"] == 6
    kept = exact_dedup.drop_exact_duplicates(docs, block_bytes=64)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 5, 6, 7, 8, 9]


def test_exact_names_are_collision_free(spark):
    # same blocks in another order, and one text the prefix of another
    texts = ["ab" * 8 + "cd" * 8, "cd" * 8 + "ab" * 8, "ab" * 8, "ab" * 16, "ab" * 8 + "cd" * 8]
    rows = exact_dedup.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=16).collect()
    assert {r["doc_id"]: r["keep_id"] for r in rows} == {0: 4, 1: 1, 2: 2, 3: 3, 4: 4}


def test_near(docs):
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert [rows[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 9)] == [1, 1, 1, 4, 5, 6, 6, 9]
    assert rows[4]["n_shingles"] == 0 and rows[None]["kept"] and not rows[7]["kept"]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9]


def test_near_chain_and_group_without_links_inside(spark):
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[4 * k : 4 * k + 100]) for k in range(12)]  # neighbours are similar, the ends are not
    apart = [" ".join(base[:70] + [f"u{k}x{i}" for i in range(60)]) for k in range(30)]  # a long passage in common
    texts = chain + apart
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert all(found[k] == 0 for k in range(12)) and all(found[k] == k for k in range(12, 42))


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4  # a repeated row counts twice


def test_mix_meets_targets(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    got = mixing.mix(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"))
    for r in got.collect():
        assert abs(r["taken"] - r["target"]) <= 80 and r["target"] <= 2 * r["size"]


def test_pack_and_matrix(docs):
    rows = packing.pack(docs, islands=2).toPandas()
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    assert rows[rows.doc_id == 4].length.tolist() == [1] and (rows.doc_id == 9).sum() == 2
    matrix = token_matrix.token_matrix(docs, buffer=4).toPandas()
    assert matrix.n_tokens.sum() == rows.length.sum()


def test_only_the_first_piece_of_a_document_is_short(spark):
    from barloom.llm.packing import CAPACITY
    from barloom.llm.tokens import Encoder, crc

    texts = {1: "lorem ipsum dolor " * 1700, 2: "short", 3: " a" * (2 * CAPACITY - 1), 4: " a" * (CAPACITY - 1)}
    found = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas()
    assert len(Encoder()(texts[1])) % CAPACITY and len(Encoder()(texts[3])) == 2 * CAPACITY
    for doc_id, pieces in found.sort_values("piece").groupby("doc_id"):
        ids = Encoder()(texts[doc_id])
        assert pieces.piece.tolist() == list(range(-(-len(ids) // CAPACITY)))
        assert pieces.length.tolist()[0] == (len(ids) % CAPACITY or CAPACITY) and (pieces.length[1:] == CAPACITY).all()
        assert pieces.start.tolist() == (pieces.length.cumsum() - pieces.length).tolist()
        assert [crc(ids[a : a + n]) for a, n in zip(pieces.start, pieces.length)] == pieces.ids_crc32.tolist()


def test_genetic_search_never_loses_items():
    import numpy as np

    from barloom.llm import bins as B

    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 700, 60).tolist()
    bound = B.lower_bound(lengths, 1000)
    first = B.start(lengths, 1000, 4, rng)
    found = B.evolve(first, lengths, 1000, 60, rng, bound)
    for packing_ in found:
        assert sorted(i for b in packing_ for i in b) == list(range(60))
        assert max(sum(lengths[i] for i in b) for b in packing_) <= 1000
    assert bound <= len(found[0]) <= len(first[0])


def test_best_fit_decreasing_against_scan():
    import numpy as np

    from barloom.llm.token_matrix import best_fit_decreasing

    lengths = np.random.default_rng(1).integers(1, 100, 300).tolist()
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= size]
        room = min(fits) if fits else 100
        if fits:
            rooms.remove(room)
        rooms.append(room - size)
    rows = best_fit_decreasing(lengths, 100)
    assert len(rows) == len(rooms) and sorted(i for r in rows for i in r) == list(range(300))


def test_encoder_equals_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    from barloom.llm.tokens import Encoder

    plain, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Encoder()
    for text in ("", " ", "a  b\n\n c\t", "x<|endoftext|>y", "日本語    é é", "it's We'LL 12 345!?", "\x00\x85᠎﻿", "a" * 3000, "🙂🙃" * 9):
        assert own(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0], text


def test_spans(spark):
    texts = {
        1: "mail a.b+c@x-y.example.com_c@d.org now", 2: "at 1.2.3.4.5 and 999.1.2.3 and 010.0.0.255", 3: "4111 1111-1111 1111, 4111111111111112",
        4: "+1 (017) 555-7713.", 5: "konto DE89 3704 0044 0532 0130 00, DE89 3704 0044 0532 0130 01", 6: 'token = "' + "0f" * 20 + '" ' + "0f" * 20,
        7: None, 8: "é@ü 😀 x@y.zz", 9: " ".join(f"u{i}@h.com" for i in range(500)), 10: "1" * 20_000 + "@" + "a" * 20_000,
    }
    rows = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows[1]["spans"] == "email:5:26,email:26:34" and rows[2]["spans"] == "ip:3:10,ip:31:42"
    assert rows[3]["spans"] == "card:0:19" and rows[4]["spans"] == "phone:0:17" and rows[5]["spans"] == "iban:6:33" and rows[6]["spans"] == "secret:9:49"
    assert rows[7]["spans"] == "" and rows[8]["spans"] == "email:6:12" and rows[9]["n_email"] == 500 and rows[10]["n_card"] == 0


def test_rules(docs):
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert rows[4]["n_words"] == 0 and rows[4]["base_failed"] and rows[6]["n_words"] == 30_000


def test_classifier(docs, labels, spark):
    rows = quality_classifier.score_documents(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert {r["score"] for r in quality_classifier.score_documents(docs, none).collect()} == {0.5}
    assert quality_classifier.keep_good(docs, none).count() == len(ROWS)
    assert quality_classifier.score_documents(docs.limit(0), labels).count() == 0


def test_classifier_fits_on_every_label(spark):
    ids = spark.range(32_000, numPartitions=4)
    # the good documents of the higher ids are longer, so that weights and threshold of a part differ from those of all
    words = F.when(F.col("id") % 8 == 0, F.lit(3)).otherwise(20 + F.col("id") / 400).cast("int")
    docs = ids.select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.concat(F.lit("w"), "id"), words), " ").alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 8 == 0, 0).otherwise(1).alias("quality"))
    told = quality_classifier.described(docs)
    model = quality_classifier.fit(told, labels)
    good = told.where("doc_id % 8 <> 0").where(quality_classifier.remainder() != 0)
    low = good.agg(F.percentile(model.worth(), quality_classifier.LOSS)).first()[0]
    bad = told.where("doc_id % 8 = 0").where(quality_classifier.remainder() != 0)
    high = bad.agg(F.percentile(model.worth(), 1 - quality_classifier.LOSS)).first()[0]
    assert good.count() > 20_000 and model.threshold == pytest.approx(low if high >= low else (low + high) / 2, rel=1e-12)
    rows = quality_classifier.labelled(labels).withColumn("x", F.lit(0))
    places = quality_classifier.placed(rows).orderBy("good", F.xxhash64("doc_id", F.lit(7)), "doc_id").collect()
    assert [r["place"] for r in places] == [*range(bad.count()), *range(good.count())]


@pytest.mark.parametrize("values, share", [([3.0], 0.005), ([1.0, 2.0], 0.3), ([0.0] * 50_000 + [1.0] * 60, 0.999), (range(30_000), 0.005), (range(30_000), 0.995)])
def test_quantile_is_exact(spark, values, share):
    rows = spark.createDataFrame([(float(v),) for v in values], "w double")
    exact = rows.agg(F.percentile("w", share)).first()[0]
    assert quality_classifier.quantile(rows, F.col("w"), share) == pytest.approx(exact, rel=1e-12)


def test_urls(pages):
    rows = url_filter.judge(pages).orderBy("page_id").collect()
    assert len(rows) == 10 and rows[4]["rule"] == "example.com/en/" and rows[4]["host"] == "x.example.com" and rows[5]["path"] == ""
    assert rows[0]["host"] == "" and rows[6]["verdict"] == "block"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_repeated_words_of_the_classifier_equal_brute_force():
    import random

    from barloom.llm.text_features import describe, repeated_words

    draw = random.Random(5)
    for size in (0, 7, 8, 9, 40, 300):
        words = [draw.choice("ab") for _ in range(size)] + [f"w{draw.randrange(60)}" for _ in range(size)]
        words += words[3 : 3 + size // 3]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert repeated_words(words) == len(covered)
    assert describe(None) == describe("") and set(describe("")[:4]) == {0.0}
    assert all(0 <= x <= 1 for text in ("A! #", "x " * 50, "\n\n", "é" * 9000) for x in describe(text))


def test_no_rows_are_lost_with_shared_or_missing_ids(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, words(1)), (None, words(2)), (None, words(3)), (7, words(4)), (7, words(5)), (None, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.drop_near_duplicates(docs).collect()
    # rows that share an id are one document; unrelated ones without an id all stay
    assert sorted(r["text"] or "" for r in kept if r["doc_id"] != 7) == sorted(["", "", words(1), words(2), words(3)])
    assert sum(r["doc_id"] == 7 for r in kept) == 1
    # copies without an id are one, a named copy comes first
    again = near_dedup.drop_near_duplicates(spark.createDataFrame([(None, words(1)), (None, words(1)), (3, words(1) + " end")], "doc_id long, text string"))
    assert [r["doc_id"] for r in again.collect()] == [3]


def test_matrix_restores_rows_that_share_an_id(spark):
    from barloom.llm.tokens import Encoder

    rows = [(1, "first text"), (1, "another one " * 900), (None, "no id"), (None, "no id"), (2, None)]
    matrix = token_matrix.token_matrix(spark.createDataFrame(rows, "doc_id long, text string"), buffer=2)
    found = sorted(((r["doc_id"] or 0, r["ids"]) for r in token_matrix.restore(matrix).collect()))
    assert found == sorted((d or 0, Encoder()(t)[:-1].tolist()) for d, t in rows)


def test_write_matrix(spark, docs, tmp_path):
    token_matrix.write_matrix(docs, str(tmp_path / "matrix"))
    held = spark.read.parquet(str(tmp_path / "matrix"))
    assert token_matrix.restore(held).count() == len(ROWS)
    assert {len(r["ids"]) for r in held.collect()} == {token_matrix.WIDTH}


def test_mixed_rows_stay_with_their_source(spark):
    rows = [(1, "one two", "a"), (1, "one two", "b"), (2, "three", None), (2, "three", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.planned(docs, weights=(1,), share=1.5).groupBy("source").agg(F.sum("copies").alias("n"))
    drawn = mixing.mixed_documents(docs, weights=(1,), share=1.5).groupBy("source").agg(F.count("*").alias("n"))
    assert {r["source"]: r["n"] for r in drawn.collect()} == {r["source"]: r["n"] for r in planned.collect() if r["n"]}


def test_empty_tables_of_filters(docs, labels):
    none = docs.limit(0)
    assert quality_classifier.keep_good(none, labels).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert near_dedup.drop_near_duplicates(none).count() == exact_dedup.drop_exact_duplicates(none).count() == 0


def test_numbers_before_upper_case_words(spark):
    texts = {
        1: "iban ES9121000418450200051332 BIC", 2: "iban AT611904300234573201 BIC", 3: "konto BE68 5390 0754 7034 KBC",
        4: "bank DE89370400440532013000 BIC", 5: "iban NO9386011117947 X", 6: "iban ZZ9386011117947",
    }
    docs = spark.createDataFrame([*texts.items(), (6, texts[6])], "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in ("body", "iban", "spans")})
    found = {r["doc_id"]: r["spans"] for r in pii.digest(docs).collect()}
    assert [found[k] for k in range(1, 7)] == ["iban:5:29", "iban:5:25", "iban:6:25", "iban:5:27", "iban:5:20", ""]


def test_url_sample_is_bounded_by_urls_and_keeps_the_rarer_label(spark, monkeypatch):
    hot = [(i, "http://hot.org/a") for i in range(500)]
    some = [(1000 + i, f"http://h{i}.org/x{i}") for i in range(300)] + [(2000 + i, f"http://bad{i}.net/es/") for i in range(6)]
    pages = spark.createDataFrame(hot + some, "page_id long, url string")
    labels = spark.createDataFrame(
        [("http://hot.org/a", 0)] + [(u, int("net" in u)) for _, u in some], "url string, label int")
    seen = []
    plain = url_filter.written

    def counted(df, name):
        out = plain(df, name)
        if name == "labelled-urls":
            seen.append({r["label"]: r["count"] for r in out.groupBy("label").count().collect()})
        return out

    monkeypatch.setattr(url_filter, "written", counted)
    rows = url_filter.judge(pages, labels, rules=(), sample=100, trees=3, depth=2).collect()
    assert len(rows) == len(hot) + len(some)
    assert seen[0][1.0] == 6 and 60 < seen[0][0.0] < 140


def test_pipeline_over_odd_rows(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} <= {r[0] for r in ROWS} and packed
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "empty" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_frequent_blocks_and_groups_keep_their_names(spark, monkeypatch):
    from barloom.operators import perfile

    monkeypatch.setattr(perfile, "SMALL", 0)
    texts = ["hot " * 40] * 300 + ["Hot " * 40 + f"tail {i % 7}" for i in range(200)] + [f"text {i} " * 9 for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for heavy in (4, 256):
        monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
        last = {}
        for i, t in enumerate(texts):
            last[t.lower()] = i
        found = exact_dedup.exact_duplicates(docs, block_bytes=16).collect()
        assert {r["doc_id"]: r["keep_id"] for r in found} == {i: last[t.lower()] for i, t in enumerate(texts)}
        assert {r["group_size"] for r in found if r["doc_id"] < 300} == {300}


def test_salted_groups_equal_a_plain_join(spark):
    from barloom.operators.perfile import with_group

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    plain = sorted(map(tuple, rows.join(groups.drop("n"), "k").collect()))
    for small in (0, 100_000):
        assert sorted(map(tuple, with_group(rows, groups, "k", "id", small=small).select("k", "id", "top").collect())) == plain
