import json

from quarryline import cli, config


def test_from_jsonl_to_triplets(spark, tmp_path):
    body = "define @f{i} {{\na\nb\nc\nd {i}\n}}"
    rows = [{"text": body.format(i=i), "metadata": {"file_name": f"lib-{i % 4}.so-O{i % 3}-hash_functions", "function_name": f"f{i // 12}"}} for i in range(120)]
    (tmp_path / "raw.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = cli.run_preprocess(spark, str(tmp_path / "raw.jsonl"), str(tmp_path / "done"))
    assert out["summary"].first().kept == 120 and out["stats"].first().n == 120 and out["cdf"].count() == 120
    cli.main(["split", str(tmp_path / "done"), str(tmp_path / "split"), "--ratio", "0.8"])
    pool = spark.read.parquet(str(tmp_path / "split/pool"))
    assert pool.count() == 120 and pool.select("split").distinct().count() == 2
    maps = spark.read.parquet(str(tmp_path / "split/positive_map"))
    assert maps.count() == 120 and all(len(r.positives) == 2 for r in maps.collect())
    cli.main(["triplets", str(tmp_path / "split"), str(tmp_path / "t"), "--epoch", "1"])
    made = spark.read.parquet(str(tmp_path / "t")).collect()
    assert len(made) == 120 and all(r.anchor != r.positive and r.anchor != r.negative for r in made)


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"model": {"max_length": 7, "quantization_bits": 4}, "training": {"triplet_margin": 2.0}}))
    s = config.read(str(tmp_path / "c.json"))
    assert (s.model.max_length, s.model.instruction, s.training.triplet_margin, s.training.seed) == (7, "", 2.0, 42)
    assert config.from_mapping({}).model.instruction.startswith("Represent")
