import json

from lumenquarry.__main__ import main
from lumenquarry.operators import match
from lumenquarry.streaming import matching, monitor


def test_match_keeps_state_over_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    say = lambda kind, **p: json.dumps({"type": kind, "payload": p})
    lines = [say("data_result", topic="t", seq=1, feasibility_score=0.5, datasets=["x"]), "", "broken", say("lit_result", topic="t", seq=2, significance_score=1.0, counts=[1, 2]), say("data_result", topic="u", seq=3, feasibility_score=0.1), say("lit_done")]
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines))
    run = ["match", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "state"), "--files", "1", "--log", str(tmp_path / "log")]
    assert main(run) == 0
    (r,) = spark.read.json(str(tmp_path / "out")).collect()
    assert (r["topic"], r["scores"]["combined"], r["why"]["datasets"], r["why"]["pub_trend"]) == ("t", 0.7, ["x"], [1, 2])
    # state goes on over runs: the waiting message meets its match in the next
    (tmp_path / "in/b.jsonl").write_text(say("lit_result", topic="u", seq=4, significance_score=0.2))
    assert main(run) == 0
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert "match ends" in (tmp_path / "log").read_text()


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("a\nb")
    progress = monitor.watch(spark)
    run = matching.run_to_end(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert monitor.settle(progress, run)
    spark.streams.removeListener(progress)
    kept = list(progress.reports)
    assert progress.rate() >= 0 and progress.frame(spark).count() == len(kept) and sum(r[2] for r in kept) == 2


def test_feed_then_match(spark, tmp_path):
    (tmp_path / "topics.txt").write_text("\n".join([*match.TOPICS, "", match.TOPICS[0]]))
    assert main(["feed", str(tmp_path / "topics.txt"), str(tmp_path / "messages")]) == 0
    assert main(["match", str(tmp_path / "messages"), "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "state")]) == 0
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert {r["topic"] for r in rows} == set(match.TOPICS) and {r["scores"]["combined"] for r in rows} == {0.788}
    assert all(r["why"]["pub_trend"] == [120, 140, 155, 170, 182] and r["why"]["variables"]["age"] == 1200 for r in rows)


def test_analyze_and_clean(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"title": "T", "text": "We ask whether this holds for all of us here."}))
    plugins = ["--embedder", "plugins:letters", "--entities", "plugins:capitals", "--works", "plugins:work"]
    assert main(["analyze", str(tmp_path / "p.jsonl"), "--out", str(tmp_path / "o"), "--splitter", "smart", "--context", *plugins]) == 0
    (q,) = spark.read.json(str(tmp_path / "o/explicit_rqs.jsonl")).collect()
    assert q["openalex"]["openalex_id"] == "W:T" and q["entities"][0]["text"] == "We" and len(q["embedding"]) == 26
    m = spark.read.json(str(tmp_path / "o/metrics.json")).first()
    assert m["rqs"] == 1 and m["secs"] > 0.5  # the work is timed, not the making of plans
    (tmp_path / "l.csv").write_text("sentence,label\na,1\n")
    assert main(["clean", str(tmp_path / "l.csv"), str(tmp_path / "c")]) == 0


def test_no_inputs(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n")
    assert main(["analyze", str(tmp_path / "p.jsonl"), "--out", str(tmp_path / "o")]) == 1
