"""Linear patterns, tables of rules, limits, streams and repeated runs: cases that the registered queries do not show."""

import os
import random
import re
import time
import warnings

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_semantics import made

from postsieve.functions import predicates, regex
from postsieve.operators import dlp, enrich, policy, rule_table, stats, verdicts
from postsieve.operators.policy import Policy, apply_policy, rule, vectorised
from postsieve.plans import fixtures, ongoing, policies, suite
from postsieve.sources import maildir, mailbox, parse, sinks
from postsieve.streaming import feeds

# patterns


@pytest.mark.parametrize(
    ("pattern", "piece", "end", "hit"),
    [
        (r"^(?:a|b)+c", "ab", "c", True), (r"^(?:a|b)+c", "ab", "d", False), (r"(a+)+$", "a", "", True), (r"(a+)+$", "a", "!", False), (r"\d+x", "1", "", False), (r"(?:[a-z]+\.)*com$", "b.", "com", True),
        (r"^(\w+\s?)*$", "word ", "!", False), (r"(?s).*a.*b.*c", "xa", "b", False), (r"(.)(.)*?z", "q", "", False), (r"(?i)(?:foo|foobar)*baz", "fooFOOBAR", "baz", True), (r"\b(?:\d[ -]*?){13,16}\b", "1", "x", False),
        ("a?" * 30 + "a{30}", "a", "", True), (r"(x*)*y", "x", "", False), (r"((a*)*)*b", "a", "", False), (r"^a*b", "a", "c", False), (r"^[^@]+@", "n", "@", True),
    ],
)
def test_long_texts_take_linear_time(spark, pattern, piece, end, hit):
    text = piece * (1_000_000 // len(piece)) + end
    began = time.time()
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(predicates.regex_match(pattern, F.col("t")).alias("hit"), predicates.regex_count(pattern, F.col("t")).alias("n"))
    rows = df.collect()
    assert (rows[0].hit, rows[0].n > 0) == (hit, hit) and (rows[1].hit, rows[1].n) == (False, 0)
    assert time.time() - began < 30


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [
        (r"\pL+\d", "xé7", True), (r"^\pN$", "\u0664", True), (r"\p{Greek}", "abc", False), (r"\p{Greek}", "aβc", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False), ("(?U)a+$", "aa", True),
        (r"\C", "a", False), (r"\\C", "\\C", True), (r"\p{Nonsense}", "a", False),
    ],
)
def test_patterns_that_only_re2_reads(spark, pattern, text, hit):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert spark.createDataFrame([(text,)], "t string").select(predicates.regex_match(pattern, F.col("t"))).first()[0] is hit


@pytest.mark.parametrize(
    ("pattern", "kept"),
    [
        (r"(?i)\b(viagra|cialis)\b", True), (r"@(example\.com|trusted\.org)$", True), (dlp.PATTERNS["card"], True), (r"^The.*\.$", True), ("(ab)?c", True), ("(ab){1}c", True), ("[]+*]x", True), (r"\(\+\*", True),
        ("(ab)*c", False), ("(ab){2}c", False), ("a+", False), ("^a+|b", False), ("(?m)^a+", False), ("^a+b+", False), ("a?" * 13, False), ("(a|b|c)(d|e|f)" * 6, False), ("(a?){3}", False),
    ],
)
def test_which_patterns_stay_in_java(pattern, kept):
    assert regex.bounded(pattern) == kept


def test_own_patterns_on_long_texts(spark):
    """Header parsing, boundaries and the shipped policies on a megabyte of what their patterns repeat."""
    for piece in ("a: b\n", "a: b\n c\n", "Received: x [1.2.3.4]\n", "\n", "\r\n", ":", " ", "1", "1-", "123-45-", "@company.com", "From ", ">From ", "é", "a\tb"):
        text = piece * (1_000_000 // len(piece))
        rows = parse.parse_messages(spark.createDataFrame([(text,), (text + "\n\n" + text,)], "raw string")).withColumn("spam_score", F.lit(0.0))
        rows = apply_policy(apply_policy(rows, policies.corporate_policy()).drop("actions"), policies.spam_policy())
        rows = dlp.dlp_scan(rows)
        assert rows.select(F.size("actions"), F.size("dlp_hits"), F.length("body"), F.size("received_headers")).count() == 2
        rows.write.format("noop").mode("overwrite").save()
    names = spark.createDataFrame([("/box/cur/" + "a" * 1_000_000 + ":2,S",), ("/box/cur/" + "/" * 1_000_000,)], "p string")
    assert names.select(F.length(mailbox.base_name(F.col("p")))).first()[0] == 1_000_000


# rules as a table


def brute_first(rows, rules):
    cut = lambda t: set(rule_table._WORD.findall((t or "").translate(rule_table._FOLD)))
    known = sorted((n, cut(w)) for n, w in rules if n is not None and cut(w))
    return [next((n for n, w in known if w <= cut(t)), None) for t in rows]


@pytest.mark.parametrize("broadcast", [200_000, 10])
def test_ten_thousand_rules(spark, monkeypatch, broadcast):
    """By the index in memory and by the join, in the same way as one rule after the other."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)] + ["straße", "ÉTÉ", "x"]
    rules = [(n, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for n in range(10_000)]
    rng.shuffle(rules)
    rules += [(None, "w1"), (20_000, None), (20_001, ""), (20_002, " - "), (-5, "W7 w7 w8")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))).upper() for _ in range(150)] + [None, "", "w7-w8", "w7 w7", "nothing here", "ÉtÉ"]
    monkeypatch.setattr(rule_table, "BROADCAST_WORDS", broadcast)
    table = spark.createDataFrame(rules, "rule_no long, words string")
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate([*texts, texts[0]])], "id long, body string, word string")
    found = rule_table.first_rule(rows, table)
    assert found.columns == ["id", "body", "word", "rule_no"]
    assert [r.rule_no for r in found.orderBy("id").collect()] == brute_first([*texts, texts[0]], rules)
    assert rule_table.first_rule(rows.limit(0), table).count() == 0
    assert [r.rule_no for r in rule_table.first_rule(rows, table.limit(0)).collect()] == [None] * (len(texts) + 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # messages are not shuffled for an index in memory; rules are for the join
    assert plan.count("Exchange hashpartitioning(key") == (0 if broadcast > 10 else 1)


def test_rule_table_actions(spark):
    rules = spark.createDataFrame([(1, "lottery win", "fileinto:Spam"), (2, "win", "quarantine"), (2, "winner", "drop")], "rule_no long, words string, action string")
    rows = made(spark, ("a@b", "s", "You WIN the lottery"), ("a@b", "s", "win"), ("a@b", "s", "no"), ("a@b", "s", "win")).withColumn("error", F.when(F.col("message_num") == 4, "bad"))
    found = rule_table.apply_rule_table(rows, rules).orderBy("message_num").collect()
    assert [r.actions for r in found] == [["fileinto:Spam"], ["drop"], ["accept"], []] and [r.rule_no for r in found] == [1, 2, None, 2]
    assert [r.actions for r in rule_table.apply_rule_table(rows, rules, default=None).orderBy("message_num").collect()][2] == []
    assert verdicts.verdict(rule_table.apply_rule_table(rows, rules)).where("accepted").count() == 1


def test_rule_table_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "win a prize"), (2, "hello")], "id long, body string").write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([(7, "prize")], "rule_no long, words string")
    stream = spark.readStream.schema("id long, body string").parquet(str(tmp_path / "in"))
    sinks.write_results(rule_table.first_rule(stream, rules), str(tmp_path / "out"), None, checkpoint=str(tmp_path / "progress")).awaitTermination()
    assert sorted((r.id, r.rule_no) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 7), (2, None)]


# conditions in Python


def test_vectorised_rules_see_living_messages_only(spark, tmp_path):
    seen = str(tmp_path)

    def odd(body, subject):
        import uuid

        with open(f"{seen}/{uuid.uuid4()}", "w") as f:
            f.writelines(f"{s}\n" for s in subject)
        return (body.str.len() % 2 == 1).where(subject != "null", None)

    rows = made(spark, ("a@b", "stopped", "x"), ("a@b", "even", "xx"), ("a@b", "odd", "xxx"), ("a@b", "null", "x"), ("a@b", "error", "x")).withColumn("error", F.when(F.col("message_num") == 5, "bad"))
    condition = vectorised(odd, F.col("body"), F.col("headers")["Subject"])
    rules = [
        rule(F.col("headers")["Subject"] == "stopped", policy.drop(), stop=True),
        rule(True, policy.log_entry("on")),
        rule(condition, policy.fileinto("Odd"), stop=True),
        rule(vectorised(lambda s: s == "even", F.col("headers")["Subject"]), policy.quarantine()),
        rule(True, policy.accept(), stop=True),
    ]
    found = [r.actions for r in apply_policy(rows, Policy(rules)).orderBy("message_num").collect()]
    assert found == [["drop"], ["log:on", "quarantine", "accept"], ["log:on", "fileinto:Odd"], ["log:on", "accept"], []]
    assert {line for p in tmp_path.iterdir() for line in p.read_text().split()} == {"even", "odd", "null"}
    assert apply_policy(rows.limit(0), Policy(rules)).count() == 0
    assert apply_policy(rows, Policy(rules)).columns == [*rows.columns, "actions", "logs", "modified_headers"]


# mailboxes


def test_limits_read_the_first_files_only(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"{i:03}.mbox").write_text("".join(f"From x\nSubject: {i}-{k}\n\nbody\n" for k in range(3 if i else 1)))
    (tmp_path / "001.mbox").write_text("From x\nFrom y\n")  # no message at all
    whole = {r.message_num: r.raw for r in mailbox.read_mbox(spark, str(tmp_path), numbered=True).collect()}
    for limit, files in ((1, 1), (2, 4), (10, 16), (200, 100), (1000, 100)):
        rows = mailbox.read_mbox(spark, str(tmp_path), limit=limit)
        assert len(rows.inputFiles()) == files
        assert {r.message_num: r.raw for r in rows.collect()} == {n: raw for n, raw in whole.items() if n <= limit}


def test_moved_messages_come_once(spark, tmp_path):
    box = tmp_path / "box"
    for folder in ("cur", "new"):
        (box / folder).mkdir(parents=True)

    def read():
        rows = mailbox.read_maildir(spark, str(box), stream=True)
        sinks.write_results(rows, str(tmp_path / "out"), None, checkpoint=str(tmp_path / "progress")).awaitTermination()
        return sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (box / "new" / "17.a.host").write_text("S: 1\n\none")
    (box / "new" / "18.b.host").write_text("S: 2\n\ntwo")
    assert len(read()) == 2
    (box / "new" / "17.a.host").rename(box / "cur" / "17.a.host:2,S")
    (box / "new" / "19.c.host").write_text("S: 3\n\nthree")
    assert read() == ["S: 1\n\none", "S: 2\n\ntwo", "S: 3\n\nthree"]
    (box / "cur" / "17.a.host:2,S").rename(box / "cur" / "17.a.host:2,RS")
    (box / "new" / "18.b.host").rename(box / "cur" / "18.b.host:2,")
    (box / "cur" / "20.d.host:2,").write_text("S: 4\n\nfour")
    assert len(read()) == 4
    # a batch reads names with flags too, and numbers them by these names
    assert mailbox.read_maildir(spark, str(box)).where("error is null").count() == 4
    for limit in (2, 100, mailbox.MOST_LISTED + 1):
        rows = mailbox.read_maildir(spark, str(box), limit=limit).orderBy("message_num").collect()
        assert [r.raw[-3:] for r in rows] == ["one", "two", "our", "ree"][:limit] and [r.error for r in rows] == [None] * len(rows)


def test_moved_messages_are_not_opened_again(spark, tmp_path):
    box = tmp_path / "box"
    mailbox.write_maildir(spark.range(5).select(F.concat(F.lit("S: 1\n\n"), "id").alias("raw")), f"file://{box}")
    opened = []
    for move in (False, True):
        if move:
            (box / "new").rename(box / "cur")
            mailbox.write_maildir(spark.range(5, 8).select(F.concat(F.lit("S: 1\n\n"), "id").alias("raw")), f"file://{box}")
        query = sinks.write_results(mailbox.read_maildir(spark, str(box), stream=True), str(tmp_path / "out"), None, checkpoint=str(tmp_path / "progress"))
        query.awaitTermination()
        opened.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert opened == [5, 3]
    assert sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"S: 1\n\n{i}\n" for i in range(8)]


def test_names_can_be_forgotten(spark, tmp_path):
    (tmp_path / "box" / "new").mkdir(parents=True)
    (tmp_path / "box" / "new" / "1.a").write_text("S: 1\n\none")
    rows = mailbox.read_maildir(spark, str(tmp_path / "box"), stream=True, forget_after="30 days")
    sinks.write_results(rows, str(tmp_path / "out"), None, checkpoint=str(tmp_path / "progress")).awaitTermination()
    assert [(r.raw, r.folder_rank, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("S: 1\n\none", 1, None)]


def test_maildir_is_delivered_and_read_in_few_tasks(spark, tmp_path):
    texts = ["S: 1\n\none", "S: 2\n\nzw\u00f6lf\r\n", "", None] * 100
    raw = spark.createDataFrame([(t,) for t in texts], "raw string").repartition(3)
    name = "spark.sql.files.openCostInBytes"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "4m")
        for folder in ("cur", "new", "new"):
            mailbox.write_maildir(raw, f"file://{tmp_path}/a box".replace(" ", "%20"), folder)
        box = tmp_path / "a box"
        assert [len(list((box / f).iterdir())) for f in ("cur", "new", "tmp")] == [400, 800, 0]
        (box / "new" / "21.host.gz").write_text("S: 3\n\nnot packed")
        rows = mailbox.read_maildir(spark, str(box))
        assert int(spark.conf.get(name)) <= mailbox.OPEN_COST
        spark.conf.set(name, "1000")
        mailbox.read_maildir(spark, str(box))
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, was)
    found = rows.groupBy("raw", "folder_rank", "error").count().collect()
    assert {(r.raw, r.folder_rank): r["count"] for r in found} == {(f"{t}\n", rank): n * (1 + (t == "")) for t in texts[:3] for rank, n in ((0, 100), (1, 200))} | {("S: 3\n\nnot packed", 1): 1}
    assert {r.error for r in found} == {None}


def test_a_failed_delivery_leaves_no_message(spark, tmp_path):
    raw = spark.range(0, 100, 1, 2).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("S: 1\n\none").alias("raw"))
    with pytest.raises(Exception, match="lost"):
        mailbox.write_maildir(raw, f"file://{tmp_path}")
    assert not (tmp_path / "new").exists()


@pytest.mark.parametrize("kind", ["file://", ""])
def test_a_stream_of_local_files_keeps_no_file_index(spark, tmp_path, kind):
    box, new = f"{kind}{tmp_path}/box", tmp_path / "box" / "new"

    def read():
        rows = mailbox.read_maildir(spark, box, stream=True)
        sinks.write_results(rows, str(tmp_path / "out"), None, checkpoint=str(tmp_path / "progress")).awaitTermination()
        return sorted((r.raw, r.folder_rank, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    mailbox.write_maildir(spark.range(4).select(F.concat(F.lit("S: 1\n\n"), "id").alias("raw")), box)
    assert read() == [(f"S: 1\n\n{i}\n", 1, None) for i in range(4)]
    assert not [f for f in tmp_path.glob("progress/sources/**/*") if f.is_file() and b"box/new" in f.read_bytes()]  # Spark's source logs each file
    (tmp_path / "box" / "cur").mkdir()
    for i, file in enumerate(sorted(new.iterdir())):
        file.rename(tmp_path / "box" / "cur" / f"{file.name}:2,{'S' * (i % 2)}")
    (new / "21.z\u00fc").write_text("S: 1\n\n4\n")
    (new / ".hidden").write_text("S: 1\n\n5\n")
    assert read() == read() == [(f"S: 1\n\n{i}\n", 1, None) for i in range(5)]
    rows = mailbox.read_maildir(spark, box, stream=True, forget_after="30 days")
    sinks.write_results(rows, str(tmp_path / "out2"), None, checkpoint=str(tmp_path / "progress2")).awaitTermination()
    assert sorted(r.raw for r in spark.read.parquet(str(tmp_path / "out2")).collect()) == [f"S: 1\n\n{i}\n" for i in range(5)]


def test_lists_of_a_stream_are_kept_for_a_batch_that_is_handled_again(tmp_path):
    (tmp_path / "new").mkdir()
    for i in range(3):
        (tmp_path / "new" / f"{i}.a").write_text("S: 1\n\n")
    reader = maildir._NamesReader(str(tmp_path), str(tmp_path / "lists"), False)
    names = lambda offset, start={"list": ""}: sorted(n for p in reader.partitions(start, offset) for b in reader.read(p) for n in b.column("name").to_pylist())
    first = reader.latestOffset()
    (tmp_path / "new" / "3.a").write_text("S: 1\n\n")
    second = reader.latestOffset()
    assert names(first) == [b"0.a", b"1.a", b"2.a"] and names(second) == [b"0.a", b"1.a", b"2.a", b"3.a"]
    assert names(second, first) == [b"3.a"] and names(second, {"list": str(tmp_path / "lost")}) == names(second)
    os.utime(tmp_path / "new", (1, 1))
    third = reader.latestOffset()
    assert reader.latestOffset() == third != second  # nothing has changed since, for long
    reader.commit(second)
    assert {f"{tmp_path}/lists/{n}" for n in os.listdir(tmp_path / "lists")} == {second["list"], third["list"]} and names(third, second) == []
    empty = maildir._NamesReader(str(tmp_path / "none"), str(tmp_path / "lists"), True)
    assert empty.latestOffset() == empty.initialOffset() and empty.partitions({}, empty.latestOffset()) == []


def test_a_message_that_moves_after_it_was_listed_is_found(spark, tmp_path):
    for f in ("cur", "new"):
        (tmp_path / f).mkdir()
    for i in range(4):
        (tmp_path / "new" / f"{i}.a").write_text(f"S: 1\n\n{i}")
    names = maildir.list_names(spark, str(tmp_path))
    (tmp_path / "new" / "1.a").rename(tmp_path / "cur" / "1.a:2,S")
    (tmp_path / "new" / "2.a").unlink()
    rows = {r.file_path[-3:]: (r.raw, r.error is None) for r in maildir.read_files(names, str(tmp_path)).collect()}
    assert rows == {"0.a": ("S: 1\n\n0", True), "1.a": ("S: 1\n\n1", True), "2.a": ("", False), "3.a": ("S: 1\n\n3", True)}


@pytest.mark.parametrize("kind", ["file://", ""])
def test_local_messages_are_read_without_a_file_index_and_a_join(spark, tmp_path, kind):
    box = f"{kind}{tmp_path}/box"
    raw = spark.range(100).select("id", F.concat(F.lit("S: 1\n\n"), "id").alias("raw"))
    mailbox.write_maildir(raw, box, F.when(F.col("id") % 4 == 0, "cur").otherwise("new"))
    assert [len(list((tmp_path / "box" / f).iterdir())) for f in ("cur", "new", "tmp")] == [25, 75, 0]
    rows = mailbox.read_maildir(spark, box)
    assert not any("box" in f for f in rows.inputFiles()) and "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((int(r.raw[6:]), r.folder_rank, r.error) for r in rows.collect()) == [(i, int(i % 4 > 0), None) for i in range(100)]
    with pytest.raises(Exception, match="goes to cur or to new"):
        mailbox.write_maildir(raw, box, F.lit("tmp"))


def test_local_messages_are_those_that_spark_reads(spark, tmp_path, monkeypatch):
    local = maildir.local_root
    monkeypatch.setattr(maildir, "local_root", lambda spark, path: local(spark, path) if path.startswith("file:") else None)
    for f in ("cur", "new", "cur/sub"):
        (tmp_path / "a box" / f).mkdir(parents=True)
    for name in ("cur/17.a:2,S", "cur/\u00fc 5%41.x", "cur/a#b?c", "cur/q[1]{2}^|\"<>`\\z", "cur/nb\u00a0sp", "cur/tab\tx", "cur/.hid", "cur/_hid", "cur/sub/y", "new/\u00e9"):
        (tmp_path / "a box" / name).write_bytes(b"S: 2\n\n" + name.encode() + b"\xff")
    for how in ({}, {"numbered": True}):
        ours, theirs = (mailbox.read_maildir(spark, f"{kind}{tmp_path}/a box", **how) for kind in ("file://", ""))
        assert ours.columns == theirs.columns and sorted(ours.collect()) == sorted(theirs.collect()) and ours.count() == 7
    for limit in (3, mailbox.MOST_LISTED + 1):
        assert sorted(mailbox.read_maildir(spark, f"file://{tmp_path}/a box", limit=limit).collect()) == sorted(ours.where(F.col("message_num") <= limit).collect())
    assert mailbox.read_maildir(spark, f"file://{tmp_path}/none", limit=2).count() == 0 == mailbox.read_maildir(spark, f"file://{tmp_path}/none").count()


def test_what_failed_attempts_have_written_is_not_delivered(spark, tmp_path):
    for target in (tmp_path / "new", tmp_path / "old"):
        held = tmp_path / "held"
        held.mkdir()
        for name in ("w.0.1.0", "w.0.1.1", "w.0.7.0"):
            (held / name).write_text("S: 1\n\n")
        if target.name == "old":
            target.mkdir()
        maildir._handed_over(spark, [Row(folder=0, attempt="w.0.1", n=2), Row(folder=0, attempt="w.1.2", n=0)], str(held), str(target))
        assert sorted(f.name for f in target.iterdir()) == ["w.0.1.0", "w.0.1.1"] and not list(tmp_path.glob("held*"))


def test_headers_end_at_the_first_blank_line(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["\n", "\r", "\r\n", "\n\n", "\r\n\r\n", "a: b", " ", "x", "\u00e9"]) for _ in range(draw.randint(0, 9))) for _ in range(2000)]
    rows = parse.parse_messages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string"), "last").collect()
    parts = [re.split(r"(?:^|\r?\n)\r?\n", texts[r.i], maxsplit=1) for r in rows]
    assert [[r.header_block, r.body] for r in rows] == [[p[0], p[1] if len(p) == 2 else ""] for p in parts]


# streams


def results_of(spark, path):
    return feeds.process_stream(spark.readStream.schema("message_num long, body string, headers map<string,string>, error string").option("maxFilesPerTrigger", 1).parquet(path), Policy([rule(F.col("body") == "bad", policy.drop())]))


def add_messages(spark, path, *bodies):
    spark.createDataFrame([(1, b, {}, None) for b in bodies], "message_num long, body string, headers map<string,string>, error string").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("name", ["running_stats", "stored_counters", "stream_equals_batch", "monitor"])
def test_files_of_a_feed_grow_in_number(spark, tmp_path, monkeypatch, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    fed, made, tasks, real, mail = [], [], [0], suite._fed, fixtures.mail

    def feed(rows, key, path, *rest):
        fed.append((path, real(rows, key, path, *rest)))
        return fed[-1][1]

    monkeypatch.setattr(suite, "_fed", feed)
    monkeypatch.setattr(fixtures, "mail", lambda spark, sf_dir: mail(spark, sf_dir).repartition(tasks[0], "message_num") if tasks[0] else mail(spark, sf_dir))
    for tasks[0] in (0, 1, 5):
        docs.limit(120 if tasks[0] else 0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        made.append(sorted(ongoing.QUERIES[name](spark, str(tmp_path)).collect()))
    kind = "json" if name == "monitor" else "parquet"
    files = [len(spark.read.option("recursiveFileLookup", True).format(kind).load(path).inputFiles()) for path, _ in fed]
    assert [share for _, share in fed] == [1, 1, 5] and files[0] == 1 and files[1] == 4 and 16 < files[2] <= 20
    assert made[1] == made[2] and (made[0] == [] or made[0][0].processed == 0)


def test_a_task_of_a_stream_reads_no_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(100).coalesce(1)
    paths, largest, real = [], [], fixtures.scratch

    def scratch(spark, what):
        paths.append((what, real(spark, what)))
        return paths[-1][1]

    monkeypatch.setattr(fixtures, "scratch", scratch)
    cost, folder = "spark.sql.files.openCostInBytes", tmp_path / "labels.parquet"
    was = spark.conf.get(cost)
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(folder))
    try:
        spark.conf.set(cost, str(1 << 30))  # each file of documents is a task
        for copies in (2, 8):
            for k in range(copies):
                docs.withColumn("doc_id", F.col("doc_id") + k * 10**6).write.mode("append" if k else "overwrite").parquet(str(tmp_path / "documents.parquet"))
            rows = ongoing.QUERIES["stream_equals_batch"](spark, str(tmp_path))
            assert rows.count() == rows.select("message_num").distinct().count() == 100 * copies
            feed = next(path for what, path in reversed(paths) if what == "feed")
            largest.append(spark.read.parquet(feed).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
    finally:
        spark.conf.set(cost, was)
    assert largest[1] < 100 and largest[1] < 1.5 * largest[0]  # rows of a file


def test_counters_survive_a_killed_batch(spark, tmp_path, monkeypatch):
    feed, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    add_messages(spark, feed, "a", "bad", "ccc")
    feeds.store_stats(results_of(spark, feed), store, progress, "smtp").awaitTermination()
    assert tuple(feeds.stored_stats(spark, store).first()) == (3, 2, 1, 7)
    add_messages(spark, feed, "bad", "dd")
    real = feeds.running_stats

    def killed(batch, path):
        # the row of the batch is there, but the stream has not noted that the batch is done
        real(batch, path).write.mode("overwrite").parquet(f"{store}/batch=1")
        raise RuntimeError("killed")

    monkeypatch.setattr(feeds, "running_stats", killed)
    with pytest.raises(Exception, match="killed"):
        feeds.store_stats(results_of(spark, feed), store, progress, "smtp").awaitTermination()
    monkeypatch.setattr(feeds, "running_stats", real)
    feeds.store_stats(results_of(spark, feed), store, progress, "smtp").awaitTermination()
    assert tuple(feeds.stored_stats(spark, store).first()) == (5, 3, 2, 12)
    add_messages(spark, feed, "e")
    add_messages(spark, feed, "f")
    feeds.store_stats(results_of(spark, feed), store, progress, "smtp").awaitTermination()
    assert tuple(feeds.stored_stats(spark, store).first()) == (7, 5, 2, 14)


def test_lookups_use_the_newest_version_and_repeat_the_noted_one(spark, tmp_path):
    feed, out, progress, lists = (str(tmp_path / n) for n in ("in", "out", "progress", "rbl"))
    listed = lambda *ips: spark.createDataFrame([(ip, "zen") for ip in ips], "ip string, zone string")
    failing = [True]

    def look_up(batch, tables):
        if failing[0]:
            failing[0] = False
            raise RuntimeError("killed")
        return enrich.enrich_rbl(batch, tables["rbl"]).select("n", "rbl_listed")

    stream = lambda: spark.readStream.schema("n long, sender_ip string").parquet(feed)
    run = lambda: feeds.enriched_stream(stream(), {"rbl": lists}, look_up, out, progress).awaitTermination()
    spark.createDataFrame([(1, "1.1.1.1"), (2, "2.2.2.2")], "n long, sender_ip string").write.parquet(feed)
    feeds.store_snapshot(listed("1.1.1.1"), lists, 1)
    with pytest.raises(Exception, match="killed"):
        run()
    feeds.store_snapshot(listed("2.2.2.2"), lists, 2)  # too late for the batch that was begun
    run()
    spark.createDataFrame([(3, "1.1.1.1"), (4, "2.2.2.2")], "n long, sender_ip string").write.mode("append").parquet(feed)
    run()
    rows = {r.n: r.rbl_listed for r in spark.read.parquet(f"{out}/rows").collect()}
    assert rows == {1: True, 2: False, 3: False, 4: True}


# sinks


def test_a_repeated_run_leaves_its_rows_once(spark, tmp_path):
    rows = apply_policy(made(spark, ("a@b", "s", "x"), ("a@b", "s", "bad")), Policy([rule(F.col("body") == "bad", policy.drop())]))
    out = str(tmp_path / "out")
    sinks.write_results(rows, out, run="2024-01-01")
    sinks.write_results(rows.where("body = 'bad'"), out, run="b")
    for _ in range(2):
        sinks.write_results(rows.where("body = 'x'"), out, run="2024-01-01")
    assert sorted((str(r.run), r.body, r.disposition) for r in spark.read.parquet(out).collect()) == [("2024-01-01", "x", "inbox"), ("b", "bad", "drop")]
    with pytest.raises(ValueError, match="not a name"):
        sinks.write_results(rows, out, run="../x")


def test_runs_of_a_stream(spark, tmp_path):
    feed, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_messages(spark, feed, "a", "bad")
    for _ in range(2):
        sinks.write_results(results_of(spark, feed), out, run="feed", checkpoint=str(tmp_path / "progress")).awaitTermination()
        add_messages(spark, feed, "c")
    assert sorted((r.body, r.run) for r in spark.read.parquet(out).collect()) == [("a", "feed-0"), ("bad", "feed-0"), ("c", "feed-1")]


def test_a_report_reads_its_source_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            reads.add(len(part))
            yield part

    source = spark.range(40).mapInPandas(counted, "id long").select(F.col("id").alias("message_num"), F.when(F.col("id") % 4 == 0, "bad").otherwise("x").alias("body"))
    rows = apply_policy(source.withColumns({"headers": F.create_map(F.lit("From"), F.lit("a")), "error": F.when(F.col("message_num") == 3, "failed")}), Policy([rule(F.col("body") == "bad", policy.drop(), policy.log_entry("x:y")), rule(True, policy.accept())]))
    summary = sinks.write_report(rows, str(tmp_path)).first()
    assert reads.value == 40
    assert (summary.total_processed, summary.succeeded, summary.kinds) == (40, 39, {"drop": 10, "log": 10, "accept": 39})
    assert spark.read.json(f"{tmp_path}/messages").count() == 40
    assert stats.action_kind_counts(rows).count() == 3
    assert sinks.write_report(rows.limit(0), str(tmp_path / "none")).first().total_processed == 0
