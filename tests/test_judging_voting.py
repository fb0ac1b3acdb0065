import json

import pytest
from pyspark.sql import functions as F

from tillscope.operators import evaluate as E
from tillscope.operators import judging as J
from tillscope.operators import sampling as R
from tillscope.operators import voting as V
from tillscope.schemas import SKILLS

GOOD = {"label": "fake", "confidence": 85, "reasons": ["a", "b"], "skill_results": {"typography": "fail", "math_consistency": "odd", "mine": "pass"}, "flags": ["TAX_ERROR", "NOPE"], "risk_level": "HIGH"}


@pytest.fixture(scope="module")
def parsed(spark):
    raws = {
        "good": json.dumps(GOOD), "fenced": "Here:\n```json\n" + json.dumps(GOOD | {"label": "MAYBE", "confidence": 150}) + "\n```", "text": "no json", "null": None, "list": "[1]",
        "short": '{"label": "REAL", "reasons": "one", "risk_level": "odd"}', "bad": '{"label": "REAL", "confidence": "high"}', "quotes": "{'label': 'REAL'}", "many": json.dumps(GOOD | {"reasons": list("abcdef"), "confidence": -3}),
    }
    d = spark.createDataFrame([(k, v, "kept?") for k, v in raws.items()], "k string, raw_response string, label string")
    return {r.k: r for r in J.parse_responses(d).collect()}


def test_parse_good(parsed):
    r = parsed["good"]
    assert (r.label, r.confidence, r.reasons, r.flags, r.risk_level, r.parse_error) == ("FAKE", 85.0, ["a", "b"], ["TAX_ERROR"], "high", None)
    assert r.skill_results == {s: "uncertain" for s in SKILLS} | {"typography_analysis": "fail", "mine": "pass"}


def test_parse_coercions(parsed):
    assert (parsed["fenced"].label, parsed["fenced"].confidence) == ("UNCERTAIN", 100.0)
    assert parsed["short"].reasons == ["one", "No reason provided"] and parsed["short"].risk_level == "low" and parsed["short"].confidence == 0.0
    assert parsed["many"].reasons == list("abcd") and parsed["many"].confidence == 0.0


def test_parse_failures(parsed):
    for k in ("text", "null", "list", "bad", "quotes"):
        r = parsed[k]
        assert (r.label, r.confidence, r.reasons, r.flags) == ("UNCERTAIN", 0.0, J.ERROR_REASONS, []) and r.parse_error and set(r.skill_results) == set(SKILLS)


def test_nan_confidence(spark):
    assert spark.range(1).select(J.coerce_confidence(F.lit(float("nan")))).first()[0] == 100.0


def votes(spark, rows):
    s = dict.fromkeys(SKILLS, "pass")
    d = [(i, "r", f"j{i}" if len(x) < 4 else x[3], x[0], float(x[1]), s, x[2] if len(x) > 2 else [], "low") for i, x in enumerate(rows)]
    return spark.createDataFrame(d, "result_id int, receipt_id string, judge_id string, label string, confidence double, skill_results map<string,string>, flags array<string>, risk_level string")


@pytest.mark.parametrize(
    "rows,label,tally,u",
    [
        ([("FAKE", 90), ("FAKE", 80), ("REAL", 70)], "FAKE", "FAKE (2/3)", 0.2617),
        ([("REAL", 90), ("REAL", 85), ("FAKE", 60)], "REAL", "REAL (2/3)", None),
        ([("FAKE", 60), ("REAL", 60), ("UNCERTAIN", 40)], "UNCERTAIN", "UNCERTAIN (1/3)", 0.5933),
        ([("UNCERTAIN", 40), ("UNCERTAIN", 35), ("FAKE", 80)], "UNCERTAIN", "UNCERTAIN (2/3)", None),
    ],
)
def test_vote(spark, rows, label, tally, u):
    r = V.vote(votes(spark, rows)).first()
    assert (r.label, r.tally) == (label, tally) and (u is None or r.verdict_uncertainty == u) and 0 <= r.verdict_uncertainty <= 1


def test_vote_flags_and_duplicate_judge(spark):
    r = V.vote(votes(spark, [("FAKE", 90, ["B", "A"]), ("REAL", 30, ["A", "C"], "j9"), ("FAKE", 70, None, "j9")])).first()
    assert r.all_flags == ["B", "A", "C"] and r.n == 3 and set(r.judge_uncertainties) == {"j0", "j9"} and r.vote_counts == {"FAKE": 2, "REAL": 1}


def test_vote_empty_and_nulls(spark):
    v = votes(spark, [("FAKE", 90)])
    assert V.vote(v.limit(0)).count() == 0
    n = v.select("result_id", "receipt_id", "judge_id", *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("confidence", "double"), ("skill_results", "map<string,string>"), ("flags", "array<string>"), ("risk_level", "string"))])
    assert V.vote(n).first().label == "UNCERTAIN"


def test_evaluation(spark):
    v = spark.createDataFrame([("a", "FAKE", None), ("b", "REAL", None), ("c", "FAKE", None), ("d", "UNCERTAIN", "FAKE"), ("e", "REAL", None)], "receipt_id string, label string, ground_truth string")
    t = spark.createDataFrame([("a", "FAKE"), ("b", "FAKE"), ("c", "REAL")], "receipt_id string, gt_label string")
    r = E.summary(E.with_truth(v, t)).first()
    assert (r.total_evaluated, r.accuracy, r.precision_fake, r.recall_fake, r.f1_fake, r.uncertain) == (4, 0.25, 0.5, 0.5, 0.5, 1)
    assert E.confusion_map(E.with_truth(v, t)).first()[0] == {"TP": 1, "FP": 1, "FN": 1, "UNCERTAIN": 1}
    assert E.summary(E.with_truth(v.limit(0), t)).first().accuracy == 0.0


def test_sampling(spark):
    d = spark.createDataFrame([(f"real_{i:03}", "REAL") for i in range(50)] + [(f"fake_{i:03}", "FAKE") for i in range(30)], "id string, label string")
    a = {r.id for r in R.stratified(d, {"REAL": 10, "FAKE": 10}).collect()}
    assert a == {r.id for r in R.stratified(d.orderBy(F.desc("id")).repartition(3), {"REAL": 10, "FAKE": 10}).collect()} and len(a) == 20 and sum(x[0] == "f" for x in a) == 10
    for few in ("REAL", "FAKE"):
        with pytest.raises(ValueError, match=f"Not enough {few}"):
            R.stratified(d, {few: 60})
    doc = R.sample_document(R.stratified(d, {"REAL": 2, "FAKE": 1}), 42, "train").first()
    assert (doc.total, doc.real_count, doc.fake_count, len(doc.receipts)) == (3, 2, 1, 3)


def test_skills(spark):
    d = spark.createDataFrame([(["layout_structure", "math_consistency", "math_consistency"],), (None,)], "s array<string>")
    assert [r[0] for r in d.select(J.normalise_skills(F.col("s"))).collect()] == [["math_consistency", "layout_structure"], SKILLS]
    with pytest.raises(Exception, match="unknown or empty"):
        spark.createDataFrame([(["odd"],)], "s array<string>").select(J.normalise_skills(F.col("s"))).collect()


def test_messages_and_artifacts(spark):
    d = spark.createDataFrame([("p", ["data:1"], "FULL"), ("p", [], "READING")], "p string, i array<string>, m string")
    m = [json.loads(r[0]) for r in d.select(J.message(F.col("p"), F.col("i"), F.lit("You judge."), False)).collect()]
    assert m[0][0] == {"role": "system", "content": "You judge."} and [c["type"] for c in m[0][1]["content"]] == ["text", "image_url"] and len(m[1][1]["content"]) == 1
    first = json.loads(d.select(J.message(F.col("p"), F.col("i"))).first()[0])
    assert [c["type"] for c in first[0]["content"]] == ["image_url", "text"]
    got = [r[0] for r in d.select(J.supporting_images(F.col("m"), F.lit(["noise/noise_heat.png", "x.png", "mela/mela_heat.png"]))).collect()]
    assert got == [["mela/mela_heat.png", "noise/noise_heat.png"], []] and J.client_for("any") is J.RuleJudge


def test_calls_retry(spark):
    def client():
        seen = {}

        def call(row):
            seen[row["k"]] = seen.get(row["k"], 0) + 1
            if row["k"] == "never" or seen[row["k"]] < 2:
                raise OSError("down")
            return "{}"

        return call

    r = {x.k: x for x in J.call_judges(spark.createDataFrame([("once",), ("never",)], "k string"), client).collect()}
    assert (r["once"].raw_response, r["once"].attempts) == ("{}", 2) and r["never"].raw_response is None and "down" in r["never"].call_error


def test_run_end_to_end(spark, tmp_path):
    from tillscope.plans.pipeline import ReceiptAudit

    judges = spark.createDataFrame([("j1", "One", ["math_consistency"], "READING"), ("j2", "Two", None, "FULL")], "judge_id string, judge_name string, focus_skills array<string>, forensic_mode string")
    rec = spark.createDataFrame([("a", "01/02/2024\nSUBTOTAL 10.00\nTAX 1.00\nTOTAL 11.00\n"), ("b", "01/02/2024\nMILK 4.00\nSUBTOTAL 10.00\nTAX 1.00\nTOTAL 99.00\n")], "receipt_id string, text string")
    run, out = ReceiptAudit(spark, judges), str(tmp_path / "v")
    run.run(rec, out)
    got = {r.receipt_id: r.label for r in spark.read.parquet(out).collect()}
    assert got == {"a": "REAL", "b": "FAKE"}
    run.run(rec, out, spark.read.parquet(out))
    assert spark.read.parquet(out).count() == 2


def test_answers_that_are_asked_for_again(spark):
    answers = ['{"confidence": "high"}', '{"flags": null}', '{"skill_results": [1]}', '```json\n{"label": "REAL", "confidence": 90}\n```']
    assert [J.acceptable(a) for a in [*answers, None, "", "no object", "[1]", "{broken"]] == [False, False, False, True, True, True, True, True, True]

    def client():
        left = iter(answers)
        return lambda row: next(left)

    got = J.call_judges(spark.createDataFrame([("r",)], "receipt_id string").coalesce(1), client, max_attempts=4).first()
    assert (got.raw_response, got.attempts, got.call_error) == (answers[3], 4, None)
    worst = J.call_judges(spark.createDataFrame([("r",)], "receipt_id string").coalesce(1), client, max_attempts=2, at_once=4).first()
    assert (worst.raw_response, worst.attempts) == (None, 2) and "invalid answer" in worst.call_error


def test_templates_and_presets(spark):
    assert J.skill_text("#### Sums\n- add\n", "x") == "#### Sums\n- add"
    with pytest.raises(ValueError):
        J.skill_text("text\n### Sums\n", "x")
    rules = '3. keep\n4. `"skill_results"` MUST have **all 5 skills**\n5. keep\n4. other'
    assert J.with_constraint(rules, ["a", "b"]).splitlines()[1].endswith("each of these 2: a, b.") and J.with_constraint(rules, ["a"]).splitlines()[2:] == ["5. keep", "4. other"]
    assert J.with_constraint("4. nothing of that kind", ["a"]) == "4. nothing of that kind"
    evidence = spark.createDataFrame([("r", "READING", "{}"), ("r", "GRAPHIC", "{}")], "receipt_id string, mode string, evidence string")
    got = {r.judge_id: r.skills for r in J.prompts(evidence, J.presets(spark)).collect()}
    assert got == {"judge_1": ["math_consistency", "contextual_validation"], "judge_2": ["typography_analysis", "visual_authenticity", "layout_structure"]}


def test_receipt_without_votes_is_an_error(spark):
    v = spark.createDataFrame([(1, "a", "j", "REAL", 80.0, None, None, "low")], "result_id long, receipt_id string, judge_id string, label string, confidence double, skill_results map<string,string>, flags array<string>, risk_level string")
    assert [r.label for r in V.vote_all(v.select("receipt_id"), v).collect()] == ["REAL"]
    with pytest.raises(Exception, match="no votes for receipt b"):
        V.vote_all(spark.createDataFrame([("a",), ("b",)], "receipt_id string"), v).collect()
