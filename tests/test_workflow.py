"""Workflow operators on hand-made tables."""

from datetime import datetime, timedelta

from foliolith.operators import diffs, inference, relational as R, workflow as W
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 3)], "k int, v string, n int")
    assert rows(R.upsert(old, new, ["k"], keep=["n"]), "k", "v", "n") == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]
    assert rows(R.upsert(old, new, ["k"]), "k", "n")[1] == (2, None)


def test_pages_have_stable_ties(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(20)], "at int, id int")
    seen, after = [], None
    while True:
        page = R.keyset_page(df, ["at", "id"], 6, after).collect()
        seen += [r["id"] for r in page[:6]]
        if len(page) <= 6:
            break
        after = (page[5]["at"], page[5]["id"])
    assert seen == list(range(19, -1, -1))


def paper_tables(spark):
    sub = spark.createDataFrame([(1, 9, "under_review", 100), (2, 9, "submitted", None)], "submission_id int, conference_id int, status string, submitter_id int")
    mem = spark.createDataFrame([(9, 7, "owner"), (9, 8, "reviewer"), (9, 6, "reviewer"), (9, 100, "author"), (9, 55, "author"), (9, 5, "owner")], "conference_id int, user_id int, role string")
    usr = spark.createDataFrame([(7, True), (8, True), (6, False), (100, True), (55, True), (5, True)], "user_id int, is_active boolean")
    col = spark.createDataFrame([(1, 55, False), (2, 56, True), (1, 77, True)], "submission_id int, user_id int, can_edit boolean")
    asg = spark.createDataFrame([(1, 1, 8, "pending", 1), (2, 1, 6, "pending", 1), (3, 2, 8, "declined", 1), (4, 1, 8, "completed", 2)], "assignment_id int, submission_id int, reviewer_id int, status string, assigned_at int")
    con = spark.createDataFrame([(1, 5, None), (1, 8, 3)], "submission_id int, reviewer_id int, resolved_at int")
    return sub, mem, usr, col, asg, con


def test_permissions(spark):
    sub, mem, usr, col, asg, con = paper_tables(spark)
    # An outsider who collaborates (77) reads nothing; a paper without a submitter is for chairs.
    assert rows(W.can_read(sub, mem, col, asg), "submission_id", "user_id") == [(1, 100), (1, 5), (1, 55), (1, 6), (1, 7), (1, 8), (2, 5), (2, 7)]
    assert rows(W.can_edit(sub, mem, col), "submission_id", "user_id") == [(1, 100), (1, 5), (1, 7), (2, 5), (2, 7)]
    assert rows(W.free_chairs(sub, mem, col, con), "submission_id", "user_id") == [(1, 7), (2, 5), (2, 7)]
    assert rows(W.valid_assignments(asg, sub, mem, usr, col, con), "assignment_id") == [(4,)]
    assert rows(W.actor_roles(spark.createDataFrame([(1, 7), (1, 55), (1, 8), (1, 1), (1, None)], "submission_id int, user_id int"), sub, mem, col), "user_id", "actor_role") == [
        (1, "participant"), (55, "author"), (7, "chair"), (8, "reviewer"), (None, "system")]
    acts = W.allowed_actions(W.can_read(sub, mem, col, asg), sub, W.free_chairs(sub, mem, col, con), W.can_edit(sub, mem, col), W.managers(sub, mem))
    got = {(r[0], r[1]): r[2] for r in acts.collect()}
    assert got[1, 7] == ["accepted", "changes_requested", "rejected", "withdrawn"] and got[1, 5] == ["withdrawn"] and got[1, 100] == ["withdrawn"] and (1, 8) not in got


def test_rate_limit_windows_begin_with_their_first_hit(spark):
    t0 = datetime(2024, 1, 1)
    hits = [(1, t0 + timedelta(seconds=s)) for s in (0, 10, 59, 61, 70, 119, 121, 200)]
    got = R.rate_limited(spark.createDataFrame(hits, "u int, at timestamp"), ["u"], "at", 60, 2).first()
    assert (got["hits"], got["windows"], got["rejected"]) == (8, 4, 2)


def test_transitions_and_gates(spark):
    e = spark.createDataFrame([(1, 1, "draft"), (1, 2, "submitted"), (1, 3, "accepted"), (2, 1, "draft"), (2, 2, "draft")], "p int, n int, s string")
    assert rows(W.invalid_transitions(e, ["p"], "s", F.col("n")), "p", "from_state", "to_state") == [(1, "submitted", "accepted")]
    g = spark.createDataFrame([(None, None), ("failed", "require_pass"), ("failed", None), ("passed", "require_pass"), ("passed_with_warnings", None)], "s string, g string")
    none = F.array().cast("array<string>")
    assert [r[0] for r in g.select(W.eligibility(F.col("s"), F.col("g"), none)["eligible"]).collect()] == [False, False, True, True, True]
    assert g.limit(1).select(W.eligibility(F.lit("passed"), F.col("g"), F.array(F.lit("title")))["reason"]).first()[0] == "metadata: title"


def test_reviews(spark):
    sub, mem, usr, col, asg, con = paper_tables(spark)
    r = spark.createDataFrame([(1, 1, 4, 8, 11, "submitted"), (2, 1, 2, 6, 11, "submitted")], "review_id int, submission_id int, assignment_id int, reviewer_id int, revision_id int, state string")
    v = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True)], "review_id int, version int, submitted boolean")
    rel = spark.createDataFrame([(1, 2)], "review_id int, version int")
    valid = W.valid_rows(asg, sub, mem, usr, col, con)
    seen = W.visible_versions(W.can_read(sub, mem, col, asg), r, v, rel, valid, W.free_chairs(sub, mem, col, con), W.authors(sub, col), sub.select("submission_id"))
    # The inactive reviewer (6) sees nothing, the conflicted chair (5) neither; peers only valid ones.
    assert rows(seen, "user_id", "review_id", "version", "view") == [(100, 1, 2, "released"), (55, 1, 2, "released"), (7, 1, 2, "chair"), (7, 2, 1, "chair"), (8, 1, 1, "own"), (8, 1, 2, "own")]
    current = spark.createDataFrame([(1, 11)], "submission_id int, revision_id int")
    assert rows(W.review_progress(valid, r, current), "eligible", "submitted", "missing") == [(1, 1, 0)]
    p = spark.createDataFrame([(1, 1, True, None), (2, 1, False, "maybe")], "review_id int, form_id int, submit boolean, recommendation string")
    a = spark.createDataFrame([(1, "c1", 9.0, None), (1, "cx", 1.0, None), (1, "t1", None, " "), (2, "t1", 2.0, None)], "review_id int, criterion string, score double, text string")
    c = spark.createDataFrame([(1, "c1", "score", True, 1.0, 5.0), (1, "c2", "score", True, 1.0, 5.0), (1, "c3", "score", False, 1.0, 5.0), (1, "t1", "text", True, 1.0, 5.0)], "form_id int, criterion string, kind string, required boolean, minimum double, maximum double")
    rec = spark.createDataFrame([(1, "accept")], "form_id int, recommendation string")
    assert rows(W.answer_problems(p, a, c, rec), "review_id", "criterion", "problem") == [
        (1, "c1", "out_of_bounds"), (1, "c2", "missing"), (1, "cx", "unknown"), (1, "recommendation", "missing"), (1, "t1", "missing"), (2, "recommendation", "not_allowed"), (2, "t1", "text_required")]


def test_notifications_follow_their_type(spark):
    sub, mem, usr, col, asg, con = paper_tables(spark)
    n = spark.createDataFrame([(1, 8, "member_added", 9, "x"), (2, 8, "review_assignment", 9, "x"), (3, 8, "issue_status", 50, "x"), (4, 7, "submission_verdict", 1, "x"), (5, 5, "submission_verdict", 1, "x"), (6, 8, "member_added", 1, "x")],
                              "notification_id int, user_id int, type string, related_id int, body string")
    issues = spark.createDataFrame([(50, 1)], "issue_id int, submission_id int")
    private = spark.createDataFrame([(4,), (5,)], "notification_id int")
    got = W.visible_notifications(n, mem, issues, W.can_read(sub, mem, col, asg), private, W.free_chairs(sub, mem, col, con))
    assert rows(got, "notification_id", "related_id") == [(1, 9), (3, 1), (4, 1)] and got.filter("body = 'x'").count() == 0
    sent = W.fan_out(spark.createDataFrame([(1, 100)], "submission_id int, actor_id int"), sub, mem, usr, W.can_read(sub, mem, col, asg))
    assert rows(sent, "user_id") == [(5,), (55,), (7,), (8,)]


def test_findings_diff_states(spark):
    s = "p int, id string, status string, severity string, expected string, actual string, confidence string"
    row = lambda p, i, st, sev="warning": (p, i, st, sev, "e", "a", "high")
    old = spark.createDataFrame([row(1, "a", "failed"), row(1, "b", "missing"), row(1, "c", "failed"), row(1, "d", "failed"), row(1, "e", "passed"), row(1, "f", "passed"), row(2, "x", "failed"), row(2, "x", "passed")], s)
    new = spark.createDataFrame([row(1, "a", "passed"), row(1, "b", "failed", "blocking"), row(1, "c", "not_applicable"), row(1, "e", "failed"), row(1, "f", "passed"), row(2, "x", "failed")], s)
    got = {(r["p"], r["id"]): (r["state"], r["changed_fields"]) for r in diffs.compare_findings(old, new, ["p"]).collect()}
    assert got == {(1, "a"): ("resolved", "status"), (1, "b"): ("remaining", "status,severity"), (1, "c"): ("not_evaluated", "status"), (1, "d"): ("not_evaluated", ""), (1, "e"): ("newly_reported", "status"), (2, None): ("unavailable", None)}


def test_missing_is_not_zero(spark):
    a, b = spark.createDataFrame([(1, None, 0)], "k int, x int, y int"), spark.createDataFrame([(1, 0, 0)], "k int, x int, y int")
    assert rows(diffs.compare_properties(a, b, ["k"], ["x", "y"]), "field", "state") == [("x", "unavailable"), ("y", "unchanged")]


def test_text_hunks(spark):
    p = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc"), (2, "same", "same"), (3, "y" * 100_001, "z"), (4, None, "new")], "pair_id bigint, before string, after string")
    got = {r["pair_id"]: r for r in diffs.text_diff(p).collect()}
    assert got[1]["lines"] == " a\n-b\n+x\n c" and 2 not in got and got[3]["header"] == "too large" and got[4]["lines"] == "+new"


def test_inference(spark):
    b = spark.createDataFrame([(True, "x"), (False, "a@b"), (False, "The University of X"), (False, "open text")], "a boolean, t string")
    assert [r[0] for r in b.select(inference.infer_blinding(F.col("a"), F.col("t"))["required"]).collect()] == [False, False, False, True]
    p = {r["rules_id"]: r["rules"] for r in inference.presets_frame(spark).collect()}
    assert len(p) == 3 and p["IEEE two-column (anonymous)"]["sections"]["min_references"] == 5 and p["Springer LNCS (visible authors)"]["pages"]["margins"]["left"] == 124.7
    r = inference.presets_frame(spark).select("rules_id", inference.apply_policy(F.col("rules"), F.lit(True)).alias("r"))
    got = {x["rules_id"]: x["r"] for x in r.collect()}
    assert got["ACM single-column (anonymous)"]["sections"]["abstract_max_words"] == 150 and got["IEEE two-column (anonymous)"]["sections"]["abstract_max_words"] == 250 and got["IEEE two-column (anonymous)"]["pages"]["max_pages"] == 8
    assert ("pages", "pages.margins.top", "number") in rows(inference.rule_schema(spark), "group", "path", "type")
    t = spark.createDataFrame([("Figure 3 shows", "Body"), ("Acknowledgments. We", "Body"), ("Plain text", "Body"), ("Plain", "References")], "t string, n string")
    assert [x[0] for x in t.select(inference.is_body(F.col("n"), F.col("t"))).collect()] == [False, False, True, False]


def test_stored_files_and_rules(spark):
    import hashlib

    side = lambda x, ok=True: {"content": x, "sha256": hashlib.sha256(x).hexdigest() if ok else "0", "size": len(x)}
    kind = "struct<content:binary,sha256:string,size:int>"
    p = spark.createDataFrame([(1, side(b"a\r\nb"), side(b"a")), (2, side(b"a", False), side(b"a"))], f"pair_id bigint, before {kind}, after {kind}")
    assert [(r["intact"], r["before"]) for r in diffs.text_pairs(p).orderBy("pair_id").collect()] == [(True, "a\nb"), (False, None)]
    r = spark.createDataFrame([('{"a": 1, "b": null, "c": [], "d": {}}',)], "j string")
    assert r.select(diffs.stripped(F.col("j"))).first()[0] == {"a": "1"}
