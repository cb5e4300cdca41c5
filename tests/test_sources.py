"""Readers of nested records, file fingerprints, and sinks whose writer is killed."""

import pytest
from pyspark.sql import functions as F

from ventura.sources import files, records, sinks

YAML = """# a site
version: 1
domain: "x.vc"   # quoted
seed_urls:
- https://www.x.vc/#team
- 'https://x.vc/it''s'
preferred_strategy: single_page
fallback_order: [single_page, "probe, all"]
empty: []
last_success:
  run_id: a_1
  at: '2026-06-12T14:30:48Z'
  record_count: 42
  valid_name_ratio: 1.0
  deeper:
    people:
      - name: Ann
        tags:
          - a
          - b
      - name: "Bob: the #1"
    -
notes: |
  two
   lines
flag: yes it is
nothing: null
---
domain: y.vc
last_success:
  record_count: 7
"""


def test_yaml():
    one, two = records.parse(YAML.replace("    -\n", ""))
    assert one["domain"] == "x.vc" and one["seed_urls"] == ["https://www.x.vc/#team", "https://x.vc/it's"] and one["fallback_order"] == ["single_page", "probe, all"]
    assert one["last_success"] == {"run_id": "a_1", "at": "2026-06-12T14:30:48Z", "record_count": 42, "valid_name_ratio": 1.0, "deeper": {"people": [{"name": "Ann", "tags": ["a", "b"]}, {"name": "Bob: the #1"}]}}
    assert (one["notes"], one["flag"], one["nothing"], one["empty"]) == ("two\n lines\n", "yes it is", None, [])
    assert two == {"domain": "y.vc", "last_success": {"record_count": 7}}
    assert records.parse("") == [] and records.parse("# only\n") == [] and records.parse("- a\n- b: 1\n") == ["a", {"b": 1}]
    assert records.parse('{"a": 1}\n{"a": 2}\n') == [{"a": 1}, {"a": 2}] and records.parse('\ufeff[{"a": {"b": [1]}}]') == [{"a": {"b": [1]}}]


def test_yaml_equals_the_library():
    yaml = pytest.importorskip("yaml")
    text = "a:\n  b:\n  - c: 1\n    d: [x, y]\n  - c: -2.5\n    d:\n      - z\n  e: 'it''s'\ng: true\nh: {k: v, n: 3}\n"
    assert records.parse(text)[0] == yaml.safe_load(text)


def test_records_at_any_depth(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML.replace("    -\n", ""))
    (tmp_path / "b.json").write_text('[{"domain": "z.vc", "last_success": {"record_count": 5}, "seed_urls": ["http://z.vc"]}, 3]')
    (tmp_path / "c.yaml").write_text("")
    got = {r["domain"]: r for r in files.read_site_files(spark, str(tmp_path)).collect()}
    assert {d: r["last_success"]["record_count"] if r["last_success"] else None for d, r in got.items()} == {"x.vc": 42, "y.vc": 7, "z.vc": 5, None: None}
    feeds = files.read_feeds(spark, markdown=str(tmp_path / "c.yaml"), yaml=str(tmp_path))
    assert {r["domain"] for r in feeds.collect()} == {"x.vc", "z.vc"}


def test_equal_size_with_other_bytes_stays(spark, tmp_path):
    for name, content in (("a", b"12345"), ("b", b"12345"), ("c", b"54321"), ("d", b"1"), ("e", b""), ("f", b"")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"][-1]: r["first"][-1] for r in files.distinct_files(spark, str(tmp_path)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_a_writer_killed_before_the_manifest_leaves_neither_gap_nor_copy(spark, tmp_path, monkeypatch):
    folder, rows = str(tmp_path / "t"), spark.range(10).selectExpr("id", "id % 2 AS k")
    assert sinks.commit_part(rows.filter("k = 0"), folder, "one")
    tell = sinks._tell

    def killed(*args):
        raise SystemExit("killed")

    monkeypatch.setattr(sinks, "_tell", killed)
    with pytest.raises(SystemExit):
        sinks.commit_part(rows.filter("k = 1"), folder, "two")
    seen = lambda: sorted(r["id"] for r in sinks.read_parts(spark, folder, "id long, k long").collect())
    assert seen() == [0, 2, 4, 6, 8]
    shards = spark.createDataFrame([("one",), ("two",), ("three",)], "shard string")
    assert sorted(r["shard"] for r in sinks.pending_shards(shards, folder).collect()) == ["three", "two"]
    monkeypatch.setattr(sinks, "_tell", tell)
    assert sinks.commit_part(rows.filter("k = 1"), folder, "two") and not sinks.commit_part(rows, folder, "two")
    assert seen() == list(range(10))
    assert {r["shard"]: r["count"] for r in sinks.read_parts(spark, folder, "id long, k long").groupBy("shard").count().collect()} == {"one": 5, "two": 5}
    assert {r["name"]: r["rows"] for r in sinks.manifest(spark, folder).collect()} == {"one": 5, "two": 5}
    with pytest.raises(ValueError):
        sinks.commit_part(rows, folder, "../x")


def test_a_stream_killed_between_part_and_manifest(spark, tmp_path, monkeypatch):
    source, folder, check = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "check")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    tell, calls = sinks._tell, []

    def killed(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return tell(*args)

    monkeypatch.setattr(sinks, "_tell", killed)
    with pytest.raises(Exception, match="killed"):
        sinks.stream_parts(stream(), folder, check).awaitTermination()
    assert sinks.read_parts(spark, folder, "id long").count() == 10
    sinks.stream_parts(stream(), folder, check).awaitTermination()
    assert sorted(r["id"] for r in sinks.read_parts(spark, folder, "id long").collect()) == list(range(30))


def test_replacing_shows_old_or_new_rows_only(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, folder)
    assert sinks.publish(spark.createDataFrame([(1, "a")], "k int, v string"), folder) == 1
    before = sinks.current(spark, folder)
    assert sinks.replace_by_name(folder, spark.createDataFrame([(2, 0.5)], "k int, w double")) == 2
    assert sorted((r["k"], r["v"], r["w"]) for r in sinks.current(spark, folder).collect()) == [(1, "a", None), (2, None, 0.5)]
    assert [tuple(r) for r in before.collect()] == [(1, "a")]
    failing = spark.range(5).select(F.expr("id / IF(id = 3, raise_error('broken'), 1)").alias("k"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish(failing, folder)
    assert sinks.version(spark, folder)[0] == 2 and sinks.current(spark, folder).count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.publish(spark.range(1), folder, over=1)  # made from a version that is no longer the present one
    assert sinks.version(spark, folder)[0] == 2


def test_append_new_takes_null_keys(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k int, v int")
    path = str(tmp_path / "t")
    assert files.append_new(rows, path, ["k"]).count() == 2 and files.append_new(rows, path, ["k"]).count() == 0
    assert files.read_if_there(spark, str(tmp_path / "none")) is None
    assert files.has_columns(rows, "k", "v") and not files.has_columns(rows, "x")
