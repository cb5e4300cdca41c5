import datetime
import zipfile

from pyspark.sql import functions as F

from ventura.operators import learning
from ventura.operators import merge as M
from ventura.operators.joins import as_of_backward, match_entities
from ventura.sources import files
from ventura.streaming import health as H

DIR = "/root/testdata/sf0.001"


def test_as_of_edges(spark):
    t0 = datetime.datetime(2024, 1, 1)
    at = [t0, t0 + datetime.timedelta(days=7), t0 + datetime.timedelta(days=13, hours=23)]
    rows = spark.createDataFrame([(1, i, t, float(i)) for i, t in enumerate(at)], "repo int, i int, ts timestamp, stars double")
    got = {r["i"]: r["prior"] for r in as_of_backward(rows, "repo", "ts", "stars", datetime.timedelta(days=7)).collect()}
    assert got == {0: None, 1: 0.0, 2: 0.0}  # exactly seven days counts, six days and 23 hours doesn't


def test_as_of_tolerance(spark):
    """A value is taken from lag to lag + tolerance back, both ends included."""
    hour = datetime.timedelta(hours=1)
    t0 = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, h, t0 + h * hour, float(h)) for h in (0, 1, 3, 6, 13)], "repo int, i int, ts timestamp, stars double")
    got = {r["i"]: r["prior"] for r in as_of_backward(rows, "repo", "ts", "stars", 2 * hour, 3 * hour).collect()}
    assert got == {0: None, 1: None, 3: 1.0, 6: 3.0, 13: None}
    got = {r["i"]: r["prior"] for r in as_of_backward(rows, "repo", "ts", "stars", 2 * hour, 5 * hour).collect()}
    assert got[13] == 6.0


def test_match_never_multiplies(spark):
    firms = spark.createDataFrame([(1, "a.com", "alpha"), (2, "a.com", "alpha"), (3, None, "beta")], "id long, domain string, normalized_name string")
    records = spark.createDataFrame([("A.com", "x"), (None, "beta"), (None, None)], "domain string, normalized_name string")
    assert sorted(str(r["match_id"]) for r in match_entities(records, firms).collect()) == ["1", "3", "None"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", None, "verified_cb"), ("b", "y", 0.2, "emerging_github")], "domain string, name string, ai_score double, verification_status string")
    new = spark.createDataFrame([("a", "z", 0.5, "verified_pb"), ("c", "w", None, "verified_cb")], old.schema)
    rules = {"ai_score": "greatest", "verification_status": "status"}
    once = M.upsert(old, new, "domain", rules)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, M.upsert(once, new, "domain", rules).collect()))
    assert {r["domain"]: r["verification_status"] for r in once.collect()} == {"a": "verified_cb_pb", "b": "emerging_github", "c": "verified_cb"}


def test_provenance_map_last_wins(spark):
    old = spark.createDataFrame([("k", {"a": 1, "b": 2})], "key string, sources map<string,int>")
    new = spark.createDataFrame([("k", {"b": 3})], old.schema)
    assert M.upsert(old, new, "key", {"sources": "map"}).first()["sources"] == {"a": 1, "b": 3}


def test_candidates(spark):
    rows = spark.createDataFrame([(1, "d", "A", 5, ["u1"]), (2, "d", "B", 9, ["u2"]), (3, None, "C", 1, ["u3"])], "ord int, domain string, name string, stars int, urls array<string>")
    got = sorted(map(tuple, M.candidate_dedup(rows, F.col("domain"), "ord").collect()))
    assert got == [(1, "A", 9, ["u1", "u2"]), (3, "C", 1, ["u3"])]


def test_health_rules():
    h = H.Health()
    for day, result in enumerate(["error", "error", "error"]):
        h.step(day * H.DAY, result)
    assert (h.status, h.failures, h.diagnoses, h.exclude_until) == ("excluded", 3, 1, 92 * H.DAY)
    h.step(100 * H.DAY, "success")
    assert (h.status, h.failures, h.next_at) == ("healthy", 0, 107 * H.DAY)


def test_windows_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet")
    stream = H.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{DIR}/events.parquet*"))
    got = H.run_available(stream, "windows_now", str(tmp_path / "check"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, H.windowed_counts(events).collect()))


def test_sources(spark, tmp_path):
    (tmp_path / "dump.dat").write_text('CompanyID|CompanyName\n1|A "quoted\n2|B\n')
    assert files.read_delimited(spark, str(tmp_path / "dump.dat"), ["CompanyID", "CompanyName"]).count() == 2
    (tmp_path / "feed.csv").write_text("url\nhttps://www.a.com/x\nhttps://b.org\n")
    (tmp_path / "feed.md").write_text("[A](https://a.com) and [C](https://c.net/p)\n")
    found = files.read_feeds(spark, csv=str(tmp_path / "feed.csv"), markdown=str(tmp_path / "feed.md"))
    assert {r["domain"]: r["feed"] for r in found.collect()} == {"a.com": 1, "b.org": 1, "c.net": 2}
    (tmp_path / "sites").mkdir()
    (tmp_path / "sites" / "x.yaml").write_text("domain: x.vc\npreferred_strategy: static\nlast_success:\n  record_count: 42\n")
    assert tuple(files.read_site_files(spark, str(tmp_path / "sites")).select("domain", "preferred_strategy", "last_success.record_count").first()) == ("x.vc", "static", 42)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "out")
    assert files.append_new(rows, path, ["k"]).count() == 2
    assert files.append_new(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), path, ["k"]).count() == 1
    assert spark.read.parquet(path).count() == 3
    files.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_bulk_sources(spark, tmp_path):
    (tmp_path / "auto.csv").write_text("id,score,name\n1,0.5,a\n2,1.5,b\n")
    assert files.read_inferred(spark, str(tmp_path / "auto.csv")).dtypes == [("id", "int"), ("score", "double"), ("name", "string")]
    (tmp_path / "awards.csv").write_text('company,award_year,company_website,state\nAcme Inc.,2004,,MA\n"ACME, Inc",2001,acme.com,NY\nAcme,x,late.com,MA\n,2000,,\nBolt LLC,2010,,\n')
    got = {r["key"]: r for r in files.fold_awards(spark, str(tmp_path / "awards.csv")).collect()}
    assert sorted(got) == ["acme", "bolt"]
    acme = got["acme"]
    assert (acme["awards"], acme["first_year"], acme["last_year"], acme["website"], acme["states"]) == (3, 2001, 2004, "acme.com", ["MA", "NY"])
    assert (got["bolt"]["website"], got["bolt"]["states"]) == (None, [])


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "grants.zip", "w") as z:
        z.writestr("project.csv", 'id;title\n1;"Deep; learning"\n2;Bridges\n3;\n')
        z.writestr("organization.csv", "projectID;name;country\n1;A;DE\n1;B;FR\n2;C;IT\n;D;ES\n")
    with zipfile.ZipFile(tmp_path / "other.zip", "w") as z:
        z.writestr("readme.txt", "nothing")
    got = files.grant_firms(spark, str(tmp_path), "deep|machine")
    assert sorted((r["name"], r["country"], r["organizationURL"]) for r in got.collect()) == [("A", "DE", None), ("B", "FR", None)]


def test_corrected_draws(spark):
    """With a near-perfect test the corrected share is the observed one; a test worse than chance gives no share."""
    counts = spark.createDataFrame([("good", 3000, 10000, 5000, 0, 0, 5000), ("bad", 3000, 10000, 0, 500, 500, 0)], "bucket string, ai long, n long, tp long, fp long, fn long, tn long")
    rows = learning.corrected_draws(counts, "bucket", 200, 1)
    got = {r["bucket"]: r for r in rows.groupBy("bucket").agg(F.avg("share").alias("mean"), F.count("share").alias("known"), F.count("*").alias("n")).collect()}
    assert abs(got["good"]["mean"] - 0.3) < 0.005 and got["good"]["known"] == 200
    assert (got["bad"]["known"], got["bad"]["n"]) == (0, 200)
    assert rows.exceptAll(learning.corrected_draws(counts.repartition(3), "bucket", 200, 1)).count() == 0
