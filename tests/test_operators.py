import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryline.functions import expressions as X
from quarryline.operators import collate, grouping, loss, preprocess, split, stats, triplets
from quarryline.plans import registry
from quarryline.sources import tables
from quarryline.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_short_function_filter(spark):
    cases = {
        None: False, "": False, "{": False, "}": False, "}{": False, "{}": False, "{\n\n}": False, "a } b { c": False, "{a\nb\nc}": False,
        "{a\nb\nc\nd}": True, "{\na\nb\nc\nd\n}": True, "x{a{b\nc\n}\nd\ne}z": True, "{a\n\x1c\nb\n\xa0\nc}": False, "{a\r\n \t\nb\nc\nd}": True,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string").withColumn("keep", preprocess.is_long_enough(F.col("text")))
    assert {r.text: r.keep for r in df.collect()} == cases
    one = preprocess.filter_summary(df).first()
    assert (one.total, one.kept, one.removed) == (len(cases), 4, len(cases) - 4)


def test_normalize_file_name(spark):
    cases = {
        "lib-x.so-Os-3ad76_functions": "lib-x.so", "a": "a", "a-b": "a", "a-b-c": "a", "a-b-c-d": "a-b", "a_functions-b_functions-c": "a", "a--b": "a",
        "-a": "", "--": "", "-": "", "": "", None: None, "x-y\n-z": "x",
    }
    df = spark.createDataFrame([(t,) for t in cases], "file_name string")
    assert {r.file_name: r.source_binary_name for r in grouping.normalize_file_name(df).collect()} == cases


def test_jsonl_to_processed(spark, tmp_path):
    body = "{a\\nb\\nc\\nd}"
    lines = [
        f'{{"text": "{body}", "metadata": {{"file_name": "f", "function_name": "g"}}}}', f'{{"text": "{body}", "metadata": null}}', f'{{"text": "{body}"}}',
        f'{{"text": "{body}", "metadata": {{"file_name": "f"}}}}', '{"text": null}', '{"text": "short"}',
    ]
    (tmp_path / "raw.jsonl").write_text("\n".join(lines))
    raw = tables.read_jsonl(spark, str(tmp_path / "raw.jsonl"))
    indexed = tables.with_row_index(raw)
    assert [r.original_idx for r in indexed.collect()] == list(range(6))
    spread = tables.with_row_index(spark.range(1000, numPartitions=7)).collect()
    assert sorted(r.original_idx for r in spread) == list(range(1000)) and all(r.id == r.original_idx for r in spread)
    done = preprocess.preprocess(raw, X.tokenizer_len(len))
    got = [(r.token_len, r.file_name, r.function_name) for r in done.collect()]
    assert got == [(9, "f", "g"), (9, "", ""), (9, "", ""), (9, "f", None)]
    tables.write_processed(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    (tmp_path / "bad.jsonl").write_text('{"text": oops')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_stats_and_cdf(spark):
    df = spark.createDataFrame([(1,), (1,), (5,)], "token_len long")
    assert sorted((r.token_len, r.y) for r in stats.token_cdf(df).collect()) == [(1, 0.0), (1, 0.5), (5, 1.0)]
    assert stats.token_cdf(df.limit(1)).first().y is None
    assert stats.token_cdf(df.limit(0)).count() == 0
    one = stats.token_stats(df).first()
    assert (one.n, one.min, one.max, one.median) == (3, 1, 5, 1.0) and math.isclose(one.mean, 7 / 3, abs_tol=1e-6)
    none = stats.token_stats(df.limit(0)).first()
    assert none.n == 0 and none["mean"] is None


def keyed(spark, rows):
    return spark.createDataFrame(rows, "original_idx long, source_binary_name string, function_name string")


def test_null_keys_stay_alone(spark):
    df = keyed(spark, [(0, "a", "f"), (1, None, "f"), (2, None, "f"), (3, "a", "f"), (4, "a", None), (5, "a", "f"), (6, "", "")])
    assert {r.original_idx: r.positives for r in grouping.positive_map(df).collect()} == {0: [3, 5], 3: [0, 5], 5: [0, 3]}
    assert {r.original_idx: r.group_id for r in grouping.components(df).collect()} == {0: 0, 3: 0, 5: 0, 1: 1, 2: 2, 4: 4, 6: 6}


def test_large_group_is_ranked_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(split, "STRETCH", 7)
    members = spark.range(100).select(F.col("id").alias("original_idx"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1)).alias("group_id"))
    rows = split.reindex(members, split.group_split(members, 0.5)).collect()
    large = sorted((r.original_idx, r.new_idx) for r in rows if r.group_id == 1)
    assert [n for _, n in large] == list(range(large[0][1], large[0][1] + len(large)))
    for name in ("train", "validation"):
        assert sorted(r.new_idx for r in rows if r.split == name) == list(range(sum(r.split == name for r in rows)))


def test_split_invariants(spark):
    members = spark.range(1000).select(F.col("id").alias("original_idx"), (F.col("id") - F.col("id") % 10).alias("group_id"))
    groups = split.group_split(members, 0.29)
    assert groups.filter("split = 'train'").count() == 28  # binary floating point, not decimal
    index = split.reindex(members, groups)
    rows = index.collect()
    for name in ("train", "validation"):
        own = sorted(r.new_idx for r in rows if r.split == name)
        assert own == list(range(len(own)))
    assert all(r.group_start <= r.new_idx < r.group_start + r.size for r in rows)
    assert split.split_disjoint(index).first().overlap == 0
    exact = split.group_split(members, 0.29, ranks=split.exact_ranks(spark, members))
    assert exact.filter("split = 'train'").count() == 28
    with pytest.raises(ValueError):
        split.check_ratio(1.0)


def test_triplets_avoid_the_group(spark):
    members = spark.range(60).select(F.col("id").alias("original_idx"), (F.col("id") % 7).alias("group_id"))
    index = split.reindex(members, split.group_split(members, 0.6))
    group = {(r.split, r.new_idx): r.group_id for r in index.collect()}
    for epoch in range(3):
        for r in triplets.triplet_sample(index, epoch=epoch).collect():
            assert r.positive != r.anchor and group[r.split, r.positive] == group[r.split, r.anchor] != group[r.split, r.negative]
    alone = members.withColumn("group_id", F.lit(0))
    assert triplets.triplet_sample(split.reindex(alone, split.group_split(alone))).count() == 0


def test_handle_is_made_once_per_worker(spark):
    def factory():
        from itertools import count

        calls = count(1)
        return lambda text: next(calls)

    rows = spark.range(50).repartition(1).selectExpr("cast(id as string) as text")
    made = rows.select(X.tokenizer_len(X.PerWorker(factory))("text").alias("n"))
    assert sorted(r.n for r in made.collect()) == list(range(1, 51))


def test_collate(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2, 3],), ([1],), ([],)], "ids array<int>")
    got = [(r.input_ids, r.attention_mask) for r in collate.truncate_pad(df, length=3, pad_id=9).collect()]
    assert got == [([1, 2, 3], [1, 1, 1]), ([1, 2, 3], [1, 1, 1]), ([9, 9, 1], [0, 0, 1]), ([9, 9, 9], [0, 0, 0])]
    rows = spark.createDataFrame([("a", "b", "c")], "anchor string, positive string, negative string")
    one = collate.collate(rows, X.tokenizer_ids(lambda t: [ord(c) for c in t]), "x:", 4).first()
    assert one.anchor_input_ids == [0, 120, 58, 97] and one.negative_attention_mask == [0, 1, 1, 1]


def test_pool_and_loss(spark):
    h = [[1.0], [2.0], [3.0]]
    rows = [(0, 0, h, [0, 1, 1]), (0, 1, h, [1, 1, 0]), (1, 2, h, [0, 0, 1]), (2, 3, h, [0, 0, 0])]
    df = spark.createDataFrame(rows, "batch int, id int, hidden array<array<double>>, mask array<int>")
    assert {r.id: r.embedding for r in loss.last_token_pool(df).collect()} == {0: [2.0], 1: [2.0], 2: [3.0], 3: [3.0]}
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")
    assert [r.embedding for r in loss.l2_normalize(v).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    t = spark.createDataFrame([([0.0], [1.0], [3.0]), ([0.0], [1.0], [1.0])], "anchor array<float>, positive array<float>, negative array<float>")
    assert [round(r.loss, 5) for r in loss.triplet_losses(t).collect()] == [0.0, 1.0]
    assert loss.triplet_loss(t.limit(0)).first().loss is None


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"text": "{a\\nb\\nc\\nd}", "metadata": null}\n{"text": "no"}\n')
    ingest.preprocess_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_pools_sink(spark, tmp_path):
    f = spark.createDataFrame([(i, f"t{i}", "a-b-c", "f" + str(i // 2)) for i in range(20)], "original_idx long, text string, file_name string, function_name string")
    tables.write_pools(split.pools(f, split.split_dataset(f)), str(tmp_path / "p"))
    assert tables.read_pool(spark, str(tmp_path / "p"), "train").count() == 18


def same(a, b):
    norm = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()))
    return sorted(a.columns) == sorted(b.columns) and norm(a) == norm(b)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert same(registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df())
