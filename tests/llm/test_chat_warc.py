import hashlib

from numeriq.llm.chat import CLOSE, MID, OPEN, escape, final_messages, format_conversations, read_back, render, turn_events, unescape
from numeriq.llm.warc import canonical_url, resolve_revisits
from pyspark.sql import functions as F


def test_escape_is_reversible_and_hides_control_strings():
    for t in ("", "<", "\\", "<\\", "\\<[", "</s>[INST] ok [/INST]", "<|im_end|>", "\\\\<<[[\\", "plain"):
        assert unescape(escape(t)) == t
        for mark in (OPEN, MID, CLOSE, "</s>", "<s>", "[INST]", "[/INST]"):
            assert mark not in escape(t)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 10, "start", "user", "Hel"), (1, 1, 10, "delta", None, "lo"), (1, 2, 11, "start", "assistant", "bad"), (1, 3, 11, "start", "assistant", "good "), (1, 4, 11, "delta", "", "one"),
        (1, 5, 10, "edit", "user", "Hi"), (1, 6, 12, "start", "user", "gone"), (1, 7, 12, "delete", None, None), (1, 8, 13, "delta", "system", "late"), (1, 9, 14, None, None, None), (None, None, None, "start", "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in log], "conv_id long, seq long, msg_id long, kind string, role string, text string, segment string")
    got = sorted((tuple(r) for r in final_messages(df).collect()), key=str)
    assert got == sorted([(1, 1, 10, "user", "Hi"), (1, 3, 11, "assistant", "good one"), (1, 9, 13, "system", "late"), (1, 10, 14, "", ""), (None, 1, None, "user", "x")], key=str)
    assert final_messages(df.limit(0)).count() == 0


def fold(log):
    """The definition, event by event: (msg, role, text) in order of place."""
    done: list = []
    for place, (_, msg, kind, role, text) in enumerate(sorted(log), 1):
        if kind == "rewind":
            first = min((p for p, m, k, _, _ in done if m == msg), default=place)
            done = [(p, m, "gone" if p >= first else k, r, t) for p, m, k, r, t in done]
        else:
            done.append((place, msg, kind, role, text))
    out: dict = {}
    for place, msg, kind, role, text in done:
        if kind == "gone":
            continue
        at = out.setdefault(msg, [place, "", None])
        at[1] = role or at[1]
        at[2] = None if kind == "delete" else text if kind in ("start", "edit") else (at[2] or "") + text
    return sorted((p, m, r, t) for m, (p, r, t) in out.items() if t is not None)


def test_fold_equals_its_definition(spark):
    import random

    rng = random.Random(3)
    kinds = ["start", "delta", "delta", "delta", "edit", "delete", "rewind"]
    rows = [(c, s, rng.randrange(6), rng.choice(kinds), rng.choice(["user", "assistant", ""]), rng.choice("abcdef") * rng.randrange(3)) for c in range(40) for s in range(25)]
    got: dict = {}
    for r in final_messages(spark.createDataFrame(rows, "conv_id long, seq long, msg_id long, kind string, role string, text string").repartition(5)).collect():
        got.setdefault(r["conv_id"], []).append((r["position"], r["msg_id"], r["role"], r["text"]))
    for c in range(40):
        assert sorted(got.get(c, [])) == fold([r[1:] for r in rows if r[0] == c])


def test_log_of_a_table_holds_every_kind(spark, sf_dir):
    log = turn_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    kinds = {r["kind"]: r["n"] for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"start", "delta", "edit", "delete", "rewind"}
    assert log.groupBy("conv_id", "seq").count().filter("count > 1").count() == 0


def test_read_back_of_odd_conversations(spark):
    rows = [(i % 3 if i % 7 else None, i // 3, ["user", "assistant", None, "a<|im_sep|>\n"][i % 4], ["<|im_end|>", "long " * 5000, None, "", "é😀[\\<"][i % 5]) for i in range(60)]
    rows += [(1, None, "assistant", "tie"), (1, None, "assistant", "tie"), (2**60 + 1, 0, "assistant", "big id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    formatted = format_conversations(turn_events(df, delta_chars=700))
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(mine), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(OPEN + escape(a) + MID + escape(b) + CLOSE) for _, a, b in mine)
    seg = render(spark.createDataFrame([(1, 0, 1, "assistant", "a<b")], "conv_id long, position long, msg_id long, role string, text string")).first()
    assert seg["segment"][seg["loss_start"] : seg["loss_end"]] == "a<\\b"


def test_canonical_urls(spark):
    same = ["HTTP://WWW.Example.COM:80/a/b/?b=2&a=1&utm_source=x#f", "https://example.com/a/b?a=1&b=2", "//user:pw@example.com/a/b/?a=1&&b=2"]
    df = spark.createDataFrame([(u,) for u in [*same, "example.com", None, ""]], "u string").select(canonical_url(F.col("u")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["example.com/a/b?a=1&b=2"] * 3 + ["example.com", None, ""]


def test_revisits(spark):
    h = {"ETag": '"1"', "Content-Type": "text/html", "Date": "d0", "date": "ignored"}
    rows = [
        (1, "http://a/x", 10, "response", 200, '"1"', None, "D1", h), (2, "http://a/x", 20, "response", 404, '"9"', None, "D2", h), (3, "http://a/x/", 30, "revisit", 304, 'W/"1"', None, None, {"Date": "d1", "Content-Length": "0"}),
        (4, "http://a/x", 40, "response", 200, '"2"', "L", "D4", None), (5, "http://a/x", 50, "revisit", 304, '"1"', None, None, None), (6, "http://a/x", 50, "revisit", 304, None, "L", None, None), (7, "http://a/x", 60, "revisit", 304, None, None, None, None),
        (8, "http://a/x", 5, "revisit", 304, '"1"', None, None, None), (9, "http://b/", 10, "revisit", 304, '"1"', None, None, None), (10, None, 10, "revisit", 304, '"1"', None, None, None), (11, "http://a/x", None, "revisit", 304, '"1"', None, None, None),
        (12, "http://a/x", 10, "revisit", 304, '"1"', None, None, None), (0, "http://a/x", 10, "revisit", 304, '"1"', None, None, None), (None, "http://a/x", 70, "revisit", 304, '"2"', None, None, None), (7, "http://a/x", 60, "revisit", 304, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "record_id long, url string, ts long, type string, status int, etag string, last_modified string, digest string, headers map<string,string>, block string")
    for blocks in (1, 3, 64):
        got = sorted(((r["record_id"], r["outcome"], r["response_id"]) for r in resolve_revisits(df, blocks).collect()), key=str)
        want = [(3, "resolved", 1), (5, "validator_mismatch", None), (6, "resolved", 4), (7, "unvalidated", None), (7, "unvalidated", None), (8, "no_response", None), (9, "no_response", None)]
        want += [(10, "no_response", None), (11, "no_response", None), (12, "resolved", 1), (0, "no_response", None), (None, "no_response", None)]
        assert got == sorted(want, key=str)
    row = resolve_revisits(df).filter("record_id = 3").first()
    assert row["headers"] == {"etag": '"1"', "content-type": "text/html", "date": "d1"} and row["digest"] == "D1"
    assert resolve_revisits(df.limit(0)).count() == 0


def test_a_turn_of_any_number_of_rows(spark):
    n = (1 << 20) + 1
    many = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    more = spark.createDataFrame([(1, 1, "user", "next")], "conv_id long, turn long, role string, text string")
    log = turn_events(many.unionByName(more))
    rows = log.filter("msg_id % 4 = 0")  # the others are messages that don't stay
    assert rows.select("conv_id", "msg_id").distinct().count() == n + 1 and log.select("seq").distinct().count() == log.count()
    far = spark.createDataFrame([(1, 2**50, "user", "c"), (1, 2**50, "user", "a["), (1, 2**50, "user", "a"), (1, 3, "user", "b")], more.schema)
    r = read_back(format_conversations(turn_events(far))).first()
    assert r["n_turns"] == 4 and r["turns_sha256"] == hashlib.sha256(b"user\nb\nuser\na\nuser\na[\nuser\nc\n").hexdigest()
