"""Small hand-derived cases of message semantics."""

import warnings

import pytest
from pyspark.sql import functions as F

from postsieve.functions import fields, predicates
from postsieve.functions.regex import translate
from postsieve.operators import dlp, enrich, policy, stats, verdicts
from postsieve.operators.order import number_messages
from postsieve.operators.policy import Policy, apply_policy, rule
from postsieve.plans import policies
from postsieve.sources import inbox, mailbox, messages, parse, sinks
from postsieve.streaming import feeds

MAIL = "sender string, subject string, body string, spam_score double"


def made(spark, *rows):
    """Messages of (sender, subject, body, spam_score), of which the last may be left out."""
    rows = [(n, *r, *("", "", "", 0.0)[len(r) :]) for n, r in enumerate(rows, 1)]
    headers = F.create_map(F.lit("From"), F.col("sender"), F.lit("Subject"), F.col("subject"))
    return messages.from_columns(spark.createDataFrame(rows, "message_num long, " + MAIL), {"headers": headers})


def first(df, *names):
    row = df.first()
    return row[names[0]] if len(names) == 1 else tuple(row[n] for n in names)


@pytest.mark.parametrize(
    ("sender", "subject", "score", "actions", "accepted", "reason"),
    [
        ("spam@evil.com", "Buy Viagra Now!!!", 0.0, ["log:Checking message from: spam@evil.com", "log:Spam keywords detected in subject", "fileinto:Spam"], False, "Classified as spam"),
        ("admin@example.com", "Monthly Report", 0.0, ["log:Checking message from: admin@example.com", "log:Trusted sender domain", "add_header:X-Trusted:yes", "accept"], True, ""),
        ("spam@example.com", "Cheap deals!!!", 8.5, ["log:Checking message from: spam@example.com", "log:High spam score: 8.5", "quarantine"], False, "Message quarantined"),
        ("a@b.org", "Hello", 7.0, ["log:Checking message from: a@b.org", "accept"], True, ""),
    ],
)
def test_spam_policy(spark, sender, subject, score, actions, accepted, reason):
    rows = verdicts.verdict(apply_policy(made(spark, (sender, subject, "", score)), policies.spam_policy()))
    assert first(rows, "actions", "accepted", "reason") == (actions, accepted, reason)


@pytest.mark.parametrize(
    ("sender", "subject", "body", "actions"),
    [
        ("test@example.com", "Test", "", ["log:External email from: test@example.com", "add_header:X-External-Mail:yes", "accept"]),
        ("a@company.com", "Test", "", ["accept"]),
        ("x@evil.com", "URGENT: verify your account", "", ["log:External email from: x@evil.com", "add_header:X-External-Mail:yes", "log:Potential phishing email", "fileinto:Quarantine"]),
        ("a@company.com", "x", "my number é123-45-6789 is", ["log:SSN pattern detected", "set_dlp:quarantine:compliance@company.com"]),
        ("a@company.com", "x", "4111 1111-1111 1111", ["log:Credit card pattern detected", "set_dlp:quarantine:compliance@company.com"]),
    ],
)
def test_corporate_policy(spark, sender, subject, body, actions):
    assert first(apply_policy(made(spark, (sender, subject, body)), policies.corporate_policy()), "actions") == actions


def test_large_bodies_bounce(spark):
    rows = apply_policy(made(spark, ("a@company.com", "s", "ö" * 6)), policies.corporate_policy(most_bytes=11))
    assert first(rows, "actions") == ["log:Large attachment blocked: 12 bytes", "bounce"]


@pytest.mark.parametrize(
    ("actions", "first_reason", "last_reason"),
    [
        (["fileinto:SpamTrap", "quarantine"], "Classified as spam", "Message quarantined"),
        (["accept", "drop"], "Message dropped", "Message dropped"),
        (["smtp_error:550", "fileinto:Quarantine", "divert_to:x"], "", "Message accepted"),
        ([], "", "Message accepted"),
        (["bounce", "discard"], "Message bounced", "Message discarded by filter"),
    ],
)
def test_verdicts(spark, actions, first_reason, last_reason):
    df = spark.createDataFrame([(actions, None)], "actions array<string>, error string")
    good = first_reason == ""
    assert first(verdicts.verdict(df), "accepted", "reason") == (good, first_reason)
    assert first(verdicts.verdict(df, "last"), "accepted", "reason") == (good, last_reason)


def test_errors_drop_effects(spark):
    rows = made(spark, ("a@b.c", "s")).withColumn("error", F.lit("execution error: x"))
    rows = apply_policy(rows, Policy([rule(True, policy.log_entry("m"), policy.add_header("a", "b"))], default_accept=True))
    assert first(rows, "actions", "logs", "modified_headers") == ([], [], {})
    assert first(verdicts.verdict(rows), "accepted", "reason") == (False, "Script execution error")
    assert first(verdicts.verdict(rows, "last"), "accepted", "reason") == (False, "Script error: execution error: x")


def test_rules(spark):
    rows = made(spark, ("a@b.c", "s"))
    null = F.lit(None).cast("boolean")
    rules = [rule(null, policy.drop(), stop=True), rule(True, policy.accept()), rule(True, policy.drop(), stop=True), rule(True, policy.bounce())]
    assert first(apply_policy(rows, Policy(rules)), "actions") == ["accept", "drop"]
    assert first(apply_policy(rows, Policy([])), "actions") == []
    assert first(apply_policy(rows, Policy([], default_accept=True)), "actions") == ["accept"]
    assert first(apply_policy(rows, Policy([rule(True, stop=True), rule(True, policy.drop())])), "actions") == []
    edits = [policy.add_header("a", "1"), policy.add_header("b", "2"), policy.add_header("a", "3")]
    assert first(apply_policy(rows, Policy([rule(True, *edits)])), "modified_headers") == {"a": "3", "b": "2"}
    assert first(apply_policy(rows, Policy([rule(True, policy.fileinto(F.lit(None).cast("string")))])), "actions") == ["fileinto:"]


def test_many_rules(spark):
    rules = [rule(predicates.regex_match(f"word{i}x", F.col("body")), policy.fileinto(f"f{i}"), stop=True) for i in range(200)]
    rows = apply_policy(made(spark, ("a@b.c", "s", "has word150x and word30x")), Policy(rules))
    assert first(rows, "actions") == ["fileinto:f30"]


@pytest.mark.parametrize(
    ("sender", "raw", "address"),
    [("a@b.c", "b.c", "b.c"), ("none", "", ""), ("a@b@c", "", ""), ("Bob <b@evil.com>", "evil.com>", "evil.com"), ("", "", ""), ("@", "", "")],
)
def test_sender_domain(spark, sender, raw, address):
    df = spark.createDataFrame([(sender,)], "s string")
    assert df.select(fields.sender_domain(F.col("s")), fields.sender_domain(F.col("s"), "address")).first() == (raw, address)


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [
        (r"company\.com$", "u@company.com\n", False), (r"(?m)com$", "u@company.com\nx", True), (r"\b\d{3}-\d{2}-\d{4}\b", "é123-45-6789", True), ("a.b", "a\u0085b", True),
        ("a.b", "a\nb", False), ("(?s)a.b", "a\nb", True), (r"a\sb", "a\x0bb", False), (r"a[\s]b", "a\tb", True), ("(?i)k", "\u212a", True), ("(", "(", False), ("a(?=b)", "ab", False),
        (r"(a)\1", "aa", False), ("a++", "aa", False), ("a**", "aa", False), ("*a", "a", False), ("[[:digit:]]+x", "12x", True), ("[a[]", "[", True), ("[a&&b]", "&", True), ("x{,2}", "x{,2}", True),
        ("x{2}", "xx", True), ("x{1001}", "x", False), (r"(?P<n>a)b", "ab", True), (r"\Aab\z", "ab", True), ("a|", "zzz", True), (r"\x41", "A", True), (r"\101", "A", True), ("(?i:A)b", "ab", True), ("(?i:A)b", "aB", False),
        ("(?m)^$", "a\n", True), (r"[^\S]", "a", False), (r"[\S]", "\x0b", True), (r"\B", "ab", True), (r"(?i)\bk", "\u212a", False),
        (r"(?i)\bof the\b", "kind OF THE x", True), (r"\bd+\b", "ad", False), (r"a\b\b", "a-", True), (r"a*\b", "-", False), (r"x?\by", "xy", False), (r"\w\b", "aé", True), (r"\b\d", "é1", True), (r"\b\d", "a1", False),
    ],
)
def test_patterns(spark, pattern, text, hit):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(predicates.regex_match(pattern, F.col("t"))).first()[0] is hit


def test_unsupported_patterns():
    assert translate("(") is None
    for p in (r"\pN", r"\Qa\E", "(?U)a+"):
        with pytest.raises(NotImplementedError):
            translate(p)


def test_nulls_in_conditions(spark):
    df = spark.createDataFrame([(None,)], "body string")
    assert df.select(predicates.body_contains("a"), predicates.regex_match("a", F.col("body"))).first() == (False, False)


def parsed(spark, raw, mode="first"):
    return parse.parse_messages(spark.createDataFrame([(raw,)], "raw string"), mode).first()


def test_parse(spark):
    raw = "message-id: 1\r\nFROM: a@b.c\r\nX-Long: one\r\n  two\r\nReceived: x: y\r\nX-Long: three\r\nreceived: z\r\n\r\nbody\r\n\r\nmore"
    row = parsed(spark, raw)
    assert row.headers == {"Message-Id": "1", "From": "a@b.c", "X-Long": "one two", "Received": "x: y"}
    assert row.body == "body\r\n\r\nmore" and row.received_headers == ["x: y", "z"] and row.sender_domain == "b.c" and row.error is None
    row = parsed(spark, raw, "last")
    assert row.headers == {"message-id": "1", "FROM": "a@b.c", "X-Long": "three", "Received": "x: y", "received": "z"} and row.sender == ""


@pytest.mark.parametrize(
    ("raw", "headers", "body", "error"),
    [
        ("\nbody", {}, "body", None), ("From: a", {"From": "a"}, "", None), ("From: a\nno colon\n\nb", {}, "", "parse error: malformed header line: no colon"),
        ("", {}, "", "parse error: EOF"), (None, {}, "", "parse error: EOF"), ("A: 1\n\n", {"A": "1"}, "", None), ("A b: 1\n\nx", {"A b": "1"}, "x", None),
    ],
)
def test_parse_edges(spark, raw, headers, body, error):
    row = parsed(spark, raw)
    assert (row.headers, row.body, row.error) == (headers, body, error)


def test_gateway_passes_bad_lines_over(spark):
    row = parsed(spark, "A: 1\nno colon\nA: 2\n\nb", "last")
    assert row.headers == {"A": "2"} and row.body == "b" and row.error is None


def test_mbox(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("From x\nFrom y\nSubject: 1\n\none\n\nFrom z\nSubject: 2\n\n>From me\ntwo")
    (tmp_path / "b.mbox").write_text("From x\nSubject: 3\n\nthree\n")
    rows = mailbox.read_mbox(spark, str(tmp_path), numbered=True).orderBy("message_num").collect()
    assert [(r.message_num, r.raw) for r in rows] == [(1, "Subject: 1\n\none\n\n"), (2, "Subject: 2\n\n>From me\ntwo"), (3, "Subject: 3\n\nthree\n")]
    assert [r.raw for r in mailbox.read_mbox(spark, str(tmp_path), limit=2, unquote=True).orderBy("message_num").collect()][1] == "Subject: 2\n\nFrom me\ntwo"
    assert mailbox.read_mbox(spark, str(tmp_path), limit=0).count() == 3


def test_maildir(spark, tmp_path):
    for f in ("cur", "new", "tmp", "cur/sub"):
        (tmp_path / f).mkdir()
    for name, text in (("cur/b", "S: 1\n\nb"), ("cur/a", "S: 2\n\na"), ("new/0", "S: 3\n\n0"), ("tmp/x", "S: 4\n\nx"), ("cur/sub/y", "S: 5\n\ny")):
        (tmp_path / name).write_text(text)
    rows = mailbox.read_maildir(spark, str(tmp_path), numbered=True).orderBy("message_num").collect()
    assert [r.raw[-1] for r in rows] == ["a", "b", "0"] and [r.message_num for r in rows] == [1, 2, 3]
    assert mailbox.read_maildir(spark, str(tmp_path), limit=2).count() == 2
    few = mailbox.read_maildir(spark, str(tmp_path), limit=2)
    many = mailbox.read_maildir(spark, str(tmp_path), limit=mailbox.MOST_LISTED + 1)
    assert [(r.message_num, r.raw[-1]) for r in few.orderBy("message_num").collect()] == [(1, "a"), (2, "b")] and few.columns == many.columns
    assert [(r.message_num, r.raw[-1]) for r in many.orderBy("message_num").collect()] == [(1, "a"), (2, "b"), (3, "0")]
    assert all("cur/" in f for f in few.inputFiles())
    assert mailbox.read_maildir(spark, str(tmp_path / "cur"), limit=2).count() == 0


def test_streams_of_mailboxes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mbox").write_text("From x\nSubject: 1\nFrom: a@b.c\n\none\nFrom z\nSubject: 2\nFrom: c@d.e\n\ntwo")
    rows = parse.parse_messages(mailbox.read_mbox(spark, str(tmp_path / "in"), stream=True))
    results = sinks.result_rows(apply_policy(rows, Policy([rule(True, policy.accept())])).withColumn("message_num", F.lit(0)))
    sinks.write_results(results, str(tmp_path / "out"), None, checkpoint=str(tmp_path / "progress")).awaitTermination()
    assert sorted(r["from"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a@b.c", "c@d.e"]


def test_inbox(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"sender":"a@b.c","subject":"s","raw_headers":"Subject: t\\nX: 1","body_plain":"","body_html":"h","spam_score":1.5}\n{"sender":5}\n{}\n')
    rows = inbox.read_inbox_json(spark, str(tmp_path)).orderBy(F.desc("spam_score")).collect()
    assert rows[0].headers == {"From": "a@b.c", "Subject": "t", "X": "1"} and rows[0].body == "h" and rows[0].sender_domain == "b.c" and rows[0].mime_type == "text/plain"
    assert all(r.body == "" and r.spam_score == 0.0 and r.headers["From"] == r.headers["Subject"] == "" for r in rows[1:]) and len(rows) == 3
    (tmp_path / "b.json").write_text('{"sender":5,"subject":true,"body_plain":{"a":1},"spam_score":"7"}\n{"sender":null,"spam_score":3}\nno json\n')
    rows = inbox.read_inbox_json(spark, str(tmp_path / "b.json")).collect()
    assert sorted((r.headers["From"], r.headers["Subject"], r.body, r.spam_score) for r in rows) == [("", "", "", 0.0), ("", "", "", 0.0), ("", "", "", 3.0)]
    (tmp_path / "c.json").write_text('[{"sender":"a@b.c","body_plain":"x"},\n {"sender":["a"]}]')
    assert sorted(r.sender for r in inbox.read_inbox_json(spark, str(tmp_path / "c.json"), multi_line=True).collect()) == ["", "a@b.c"]


def test_requests_without_fields(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "`from` string, to array<string>, headers map<string,string>, body string, forward_to_upstream boolean")
    row = messages.from_requests(df).first()
    assert row.headers == {"X-Envelope-From": "", "X-Envelope-To": ""} and row.body == "" and row.virus_status == "clean" and row.dns_resolved is True


def test_columns(spark):
    with pytest.raises(ValueError, match="no such"):
        messages.from_columns(spark.range(1), {"nothing": F.lit(1)})
    row = messages.from_columns(spark.range(1), {"message_num": "id"}).first()
    assert row.message_num == 0 and row.headers == {} and row.mx_records == [] and row.error is None


def test_lookups(spark):
    rows = made(spark, ("a@one.x",), ("b@two.x",), ("nobody",))
    names = spark.createDataFrame([("one.x", "1.1.1.1"), ("one.x", "1.1.1.0")], "domain string, ip string")
    hosts = spark.createDataFrame([("one.x", 20, "b", "2.2.2.2"), ("one.x", 10, "c", "fd00::1"), ("two.x", 5, "d", None)], "domain string, pref int, host string, ip string")
    listed = spark.createDataFrame([("1.1.1.0", "z"), ("1.1.1.0", "a"), ("fd00::1", "m")], "ip string, zone string")
    found = enrich.enrich_rbl(enrich.enrich_mx_rbl(enrich.enrich_mx_family(enrich.enrich_mx(enrich.enrich_dns(rows, names), hosts), hosts), hosts, listed), listed)
    got = [tuple(r) for r in found.orderBy("message_num").select("dns_resolved", "sender_ip", "mx_records", "valid_mx", "is_mx_ipv4", "is_mx_ipv6", "mx_in_rbl", "rbl_listed", "rbl_name").collect()]
    assert got == [(True, "1.1.1.0", ["c", "b"], True, True, True, True, True, "a"), (False, "", ["d"], True, False, False, False, False, ""), (False, "", [], False, False, False, False, False, "")]
    assert enrich.enrich_rbl(enrich.enrich_dns(rows, names), listed, "none").where("rbl_listed").count() == 0
    with pytest.raises(ValueError, match="mx"):
        enrich.resolve_domain(rows, names, verify=True)


def test_routes(spark):
    df = spark.createDataFrame([(1, ["add_header:n:v:w", "rbl_check:fd00::1:zen", "domain_resolve:s:true", "accept", "auto_reply:a:b"])], "message_num long, actions array<string>")
    rows = [(r.pos, r.kind, r.arg1, r.arg2) for r in verdicts.route_actions(df).orderBy("pos").collect()]
    assert rows == [(0, "add_header", "n", "v:w"), (1, "rbl_check", "fd00::1", "zen"), (2, "domain_resolve", "s", "true"), (3, "accept", None, None), (4, "auto_reply", "a:b", None)]


def test_statistics_by_path(spark):
    rows = [("smtp", True, None, 5), ("smtp", False, "e", 7), ("rpc", True, None, 11), ("rpc", False, "e", 13), ("rpc", False, None, 17)]
    df = spark.createDataFrame(rows, "path string, accepted boolean, error string, bytes long")
    assert tuple(stats.gateway_stats(df).first()) == (4, 2, 2, 12)
    assert tuple(stats.gateway_stats(df.limit(0)).first()) == (0, 0, 0, 0)


def test_dlp(spark):
    row = first(dlp.dlp_scan(made(spark, ("a", "s", "é123-45-6789 4111111111111111 4111-1111-1111-1111")), dlp.PATTERNS | {"bad": "("}), "dlp_counts", "dlp_hits")
    assert row == ({"card": 2, "ssn": 1, "bad": 0}, ["card", "ssn"])


def test_numbers_are_gapless(spark):
    rows = number_messages(spark.range(0, 1000, 1, 7).withColumn("b", F.col("id") % 13), [F.col("b")], "id").orderBy("message_num").collect()
    assert [r.message_num for r in rows] == list(range(1, 1001)) and [(r.b, r.id) for r in rows] == sorted((r.b, r.id) for r in rows)


def test_columns_with_clashing_names_stay(spark):
    """Helper columns of operators make way for a user's columns of the same names."""
    names = "_to _ip _zone _hosts key_ found_ holds_ stop_ edits_ block0_ block0_start_ n_ before_ parts_ blank_ _holds _stop _edits path_ bytes_".split()
    rows = made(spark, ("a@one.x", "Viagra"), ("b@two.x",)).withColumns({n: F.lit(f"mine {n}") for n in names})
    names_ = spark.createDataFrame([("one.x", "1.1.1.1")], "domain string, ip string")
    hosts = spark.createDataFrame([("one.x", 20, "b", "2.2.2.2")], "domain string, pref int, host string, ip string")
    listed = spark.createDataFrame([("1.1.1.1", "z")], "ip string, zone string")
    out = enrich.enrich_rbl(enrich.enrich_mx(enrich.enrich_dns(rows, names_), hosts), listed)
    out = apply_policy(out, policies.spam_policy())
    out = number_messages(out, [F.col("sender_domain")], "sender", "place")
    got = out.orderBy("place").collect()
    assert [r.rbl_listed for r in got] == [True, False] and [r.place for r in got] == [1, 2] and got[0].actions[-1] == "fileinto:Spam"
    assert all(r[n] == f"mine {n}" for r in got for n in names)
    raw = spark.createDataFrame([("A: 1\n\nb", "p", "q")], "raw string, parts_ string, blank_ string")
    row = parse.parse_messages(raw).first()
    assert (row.parts_, row.blank_, row.body) == ("p", "q", "b")
    counted = feeds.running_stats(out.withColumn("accepted", F.lit(True)), "smtp").first()
    assert counted.processed == 2


def test_conditions_after_a_stop_are_not_worked_out(spark):
    fails = F.raise_error(F.lit("worked out")).cast("boolean")
    rows = apply_policy(made(spark, ("a@b.c",)), Policy([rule(True, policy.accept(), stop=True), rule(fails, policy.drop(), stop=True), rule(fails, policy.discard())]))
    assert first(rows, "actions") == ["accept"]


def test_accepted_and_rejected_add_up(spark):
    rows = feeds.process_stream(made(spark, ("a@b.c", "Viagra"), ("a@example.com", "x"), ("q", "", "", 9.0)), policies.spam_policy(), "first")
    total, good = rows.count(), rows.where("accepted").count()
    assert (total, good, rows.where(~F.col("accepted")).count()) == (3, 1, 2)
