"""The registered queries and the pipeline over small tables: columns, whole rows, cases planted in them."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanweave.llm import queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, hits string, n_lines int, __key int"


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    return " ".join(rng.choice(words) for _ in range(n))


ITEM = prose(40, 1)
COPY = prose(80, 2)
SHARED = prose(60, 3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    texts = [prose(60, 10 + i) + (" vilest slur" if i % 4 == 1 else "") for i in range(120)]
    texts += [COPY, COPY, COPY + " more", None, "", "one", "start " + ITEM + " end", SHARED + " " + prose(30, 4), prose(20, 5) + " " + SHARED, prose(30, 6) + "\n" + prose(12, 7), "x " + prose(30, 8) + "\n" + prose(12, 7)]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "own", i, 7) for i, t in enumerate(texts)] + [(None, prose(50, 9), None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "few words")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h{i % 3}.com/a", "") for i in range(20)] + [(90, None, None)], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    vectors = [*base, *(base[i % 5] + 0.1 * rng.standard_normal(16) for i in range(40))]
    rows = [(i * 3 % 61, v.astype(np.float32).tolist(), 1) for i, v in enumerate(vectors)] + [(61, None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    return where


COLUMNS = {
    "op1_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op6_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op12_spelling": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13_near_vectors": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_url_filters": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, folder, name):
    got = queries.queries()[name](spark, folder)
    types = {f.name: f.dataType.simpleString() for f in got.schema}
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    source = {"op10_url_filters": "pages", "op13_near_vectors": "embeddings"}.get(name, "documents")
    assert name == "op12_spelling" or len(rows) == spark.read.parquet(f"{folder}/{source}.parquet").count()
    if name == "op1_lm_scoring":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows if r.doc_id is not None) and all(r.score < 0 for r in rows)
    if name == "op3_substring_dedup":
        assert {r.doc_id: r.n_removed for r in rows}[127] == 60 and {r.doc_id: r.n_removed for r in rows}[0] == 0
    if name == "op6_sharding":
        assert all(r.text_crc32 >= 0 for r in rows)
    if name == "op8_decontamination":
        hit = {r.doc_id: r for r in rows if r.contaminated}
        assert set(hit) == {126} and hit[126].n_hit == 40 and hit[126].n_items == 1
    if name == "op9_toxicity":
        wrong = [r for r in rows if r.doc_id is not None and r.doc_id < 120 and r.predicted != int(r.doc_id % 4 == 1)]
        assert len(wrong) <= 4 and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_says_the_same(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = queries.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = lambda found: sorted(repr(tuple(r)) for r in found)
    if name in ("op3_substring_dedup", "op8_decontamination"):  # their SQL joins by id, where nulls don't meet
        got, want = got.where("doc_id is not null"), want.filter("doc_id is not null")
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in seen.collect()}
        seen = stage(spark, seen, folder).cache()
        now = {r.doc_id: r for r in seen.collect()}
        assert seen.columns == columns and set(now) <= before and all(r.hits in ("own", None) for r in now.values())
        if name == "toxicity":
            clean = {i for i in before if i is not None and i < 120 and i % 4 != 1}
            assert len(clean & set(now)) >= len(clean) - 2 and sum(i % 4 == 1 for i in now if i is not None and i < 120) <= 2
        if name == "line dedup":
            assert set(now) == before and now[121].text == "" and "\n" not in now[130].text and now[130].n_chars == len(now[130].text)
        if name == "near dedup":
            assert len(now.keys() & {121, 123, 124}) == 1 and 120 in now
        if name == "decontamination":
            assert 126 not in now and set(now) == before - {126}
    out = corpus_pipeline.STAGES[-1][1](spark, seen, folder)
    assert out.columns == ["doc_id", "piece_ids", "n_pieces", "round_trip"] and out.count() == seen.count()
    assert out.where(~F.col("round_trip")).count() == 0


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_very_long_lines(spark):
    """Lines of over 200,000 characters with few changes are one group, quickly."""
    from spanweave.llm import lines

    words = prose(40_000, 70).split()
    changed = words[:100] + ["new"] + words[100:20_000] + ["other"] + words[20_001:]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(prose(40_000, 71).split()))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()} == {1: 0, 2: 1, 3: 0}
