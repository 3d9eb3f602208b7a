"""Notifications and the inbox by hand-worked cases."""

from datetime import datetime

from pyspark.sql import functions as F

from crestline.operators import inbox

NOW = datetime(2024, 3, 15)


def day(n):
    return datetime(2024, 3, n)


def sources(spark):
    events = [(1, "info", " Ann added to the pool", None, day(14), 7), (2, "upload", "x", None, day(14), 7), (3, None, "Upload queued: a.pdf", None, day(14), 7), (4, " ", " ", " /a ", day(1), 7), (5, "info", "other", None, day(14), 8), (6, "info", "none", None, day(14), None)]
    events += [(100 + i, "info", "Resume upload (3)", None, day(13), 7) for i in range(38)]
    jobs = [(1, " Data Analyst ", day(10), 7), (2, "", day(12), 7), (3, "Old", datetime(2024, 2, 1), 7), (4, "Else", day(12), 8)]
    runs = [(1, 11, 0.5, 0.1, day(9)), (1, 12, 0.5, 0.2, day(9)), (1, 13, 0.9, 0.9, day(8)), (4, 11, 0.5, 0.1, day(9))]
    given = [(1, 1, 11, "Select", day(11)), (2, 1, 12, "not_a_fit", day(11)), (3, 3, 99, "", day(2)), (4, 1, 11, "hold", datetime(2024, 2, 29)), (5, 4, 11, "hold", day(11)), (6, 2, 12, None, day(3))]
    return (
        spark.createDataFrame(events, "event_id long, kind string, message string, href string, created_at timestamp, workspace_id int"),
        spark.createDataFrame(jobs, "job_id long, title string, created_at timestamp, workspace_id int"),
        spark.createDataFrame(runs, "job_id long, candidate_id long, score double, similarity double, run_at timestamp"),
        spark.createDataFrame(given, "feedback_id long, job_id long, candidate_id long, action string, created_at timestamp"),
        spark.createDataFrame([(11, "Ann"), (12, " Bo "), (13, "Cy")], "candidate_id long, full_name string"),
    )


def test_four_sources_with_limits_noise_and_horizon(spark):
    got = inbox.notifications(*sources(spark), 7, F.lit(NOW)).collect()
    said = {r["id"]: (r["kind"], r["message"], r["href"]) for r in got}
    # The newest 40 events are taken before the noise goes, so the old one is beyond them.
    assert said.pop("event-1") == ("info", "Ann added to the pool", None)
    assert said.pop("job-1") == ("job", "New job: Data Analyst", "/jobs/1")
    assert said.pop("job-2") == ("job", "New job: 2", "/jobs/2")
    assert said.pop("rank-1-2024-03-09T00:00:00") == ("ranking", "Ranking updated for Data Analyst (2 candidates scored) — top match: Bo", "/jobs?job=1")
    assert said.pop("feedback-1") == ("select", "Ann marked as selected for Data Analyst", "/jobs/1")
    assert said.pop("feedback-2") == ("reject", "Bo marked not a fit for Data Analyst", "/jobs/1")
    assert said.pop("feedback-3") == ("feedback", "A candidate: update — Old", "/jobs/3")
    assert said.pop("feedback-6") == ("feedback", "Bo: update — 2", "/jobs/2")
    assert not said
    assert [r["at"] for r in got] == sorted((r["at"] for r in got), reverse=True)


def test_inbox_names_marks_and_tabs(spark):
    users = spark.createDataFrame([(7, "me@x.org", "Me"), (8, "Cli@x.org", "U8"), (9, "can@x.org", " "), (10, "raw@x.org", "")], "user_id long, email string, full_name string")
    clients = spark.createDataFrame([(1, "CLI@x.org", day(2), ["Late", "B"]), (2, "cli@X.org", day(1), [" ", "Firm"]), (3, "cli@x.org", None, ["Unknown when", ""])], "id long, email string, created_at timestamp, names array<string>")
    people = spark.createDataFrame([(5, "Can@x.org", day(1), [None, ""])], "id long, email string, created_at timestamp, names array<string>")
    rows = [
        (1, 8, 7, " Hi ", "there ", "Clients", day(5), None, False, False), (2, 9, 7, "", "x" * 250, "candidates", day(6), day(7), False, False), (3, 7, 10, None, None, "pool", day(7), None, False, True),
        (4, 8, 7, "", "hidden", None, day(8), None, False, True), (5, 7, 8, "", "b", None, day(9), None, False, False), (6, 77, 7, "", "no user", None, day(9), None, False, False),
    ]
    sent = spark.createDataFrame(rows, "message_id long, sender_id long, recipient_id long, subject string, body string, chat_scope string, created_at timestamp, read_at timestamp, hidden_for_sender boolean, hidden_for_recipient boolean")
    alerts = inbox.notifications(*sources(spark), 7, F.lit(NOW))
    read = spark.createDataFrame([("event-1",), ("event-1",), ("job-9",)], "item_key string")
    found = inbox.inbox(alerts, read, sent, clients, people, users, 7).cache()
    got = {r["id"]: r for r in found.collect()}
    assert len(got) == 8 + 4
    assert got["event-1"]["read"] and not got["job-1"]["read"]
    assert (got["msg-1"]["message"], got["msg-1"]["peer_path"], got["msg-1"]["read"]) == ("New message from Firm — Hi: there", "/clients/2", False)
    assert got["msg-2"]["message"] == "New message from can@x.org — " + "x" * 199 + "…" and got["msg-2"]["peer_path"] == "/candidates/5" and got["msg-2"]["read"]
    assert (got["msg-3"]["message"], got["msg-3"]["read"], got["msg-3"]["chat_scope"]) == ("Message to raw@x.org — (empty message)", True, "general")
    assert (got["msg-5"]["peer_name"], got["msg-5"]["peer_path"]) == ("U8", None)
    in_tab = lambda tab: {r["id"] for r in found.where(inbox.in_tab(tab)).collect()}
    assert in_tab("candidates") == {"msg-2"} and len(in_tab(" Alerts ")) == 8 and len(in_tab("")) == 12 and not in_tab("spam")
