"""Operators that judge or number single rows, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopfloor.llm.chat_format import escape, fold_events, format_chats, read_loss, read_turns, unescape
from shopfloor.llm.html_extract import DEFAULT_WEIGHTS, learn_weights
from shopfloor.llm.line_dedup import dedup_lines
from shopfloor.llm.quality_rules import quality_rules
from shopfloor.llm.sharding import assign_shards, permute, unpermute
from tests.llm.conftest import pairs

SPACE = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------ quality rules
def repeats(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    return len({j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)})


def test_quality_counts(spark):
    rnd = random.Random(5)
    texts = ["", None, " ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\ny\ny\ny"]
    texts += [" ".join(rnd.choice("abcd#|") for _ in range(rnd.randint(0, 90))) + rnd.choice(["", "\n", "."]) for _ in range(150)]
    texts += ["\n".join(rnd.choice(["a b.", "a b. ", "", " ", "c | d | e | f"]) for _ in range(12)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules(docs).collect():
        text = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeats(words), text
        assert r["base_failed"] == (len(words) < 50 or 100 * repeats(words) > 50 * len(words))


def test_quality_verdict_by_lines(spark):
    prose = "\n".join(f"A{i} sentence{i} number{i} that{i} says{i} something." for i in range(12))
    menu = "Home | About | News | Contact | Shop"
    texts = {
        1: prose,
        2: prose + "\n" + menu + "\nWe use cookies to make this site better.",
        3: "\n".join([menu] * 30 + ["word " * 60 + "."]),
        4: "\n".join("a title without an end " + str(i) for i in range(30)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == prose and got[1]["lost"] == 0
    assert got[2]["kept"] and got[2]["clean_text"] == prose
    assert not got[3]["kept"] and not got[4]["kept"] and got[4]["clean_text"] == ""


def test_quality_odd_rows(odd_docs):
    out = quality_rules(odd_docs, prefix="q_")
    assert set(odd_docs.columns) < set(out.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd_docs.count()
    assert rows[3]["q_n_words"] == 0 and rows[3]["q_clean_text"] == "" and not rows[3]["q_kept"]
    assert rows[6]["q_n_words"] == 40_000
    assert quality_rules(odd_docs.limit(0), prefix="q_").count() == 0


# --------------------------------------------------------------- line dedup
def brute_lines(rows, min_chars=20, min_docs=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(low)
    held = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(d)
    rank = lambda d: -1 if d is None else d
    keeper = {k: max(v, key=rank) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_brute_force(spark):
    rnd = random.Random(3)
    pool = [f"Common line number {i} of the pool" for i in range(8)] + ["  COMMON line number 1 of the pool\t", "short", "", "\x0b"]
    rows = [(i, "\n".join(rnd.choice(pool + [f"an own line of {i}"]) for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def test_line_dedup_odd_rows(odd_docs):
    out = dedup_lines(odd_docs, kept_col="q_text", lines_col="q_lines", dropped_col="q_dropped")
    got = [tuple(r) for r in out.select("doc_id", "q_lines", "q_dropped", "q_text").collect()]
    assert sorted(got, key=repr) == brute_lines(pairs(odd_docs))
    assert set(odd_docs.columns) < set(out.columns)
    assert dedup_lines(odd_docs.limit(0), kept_col="q", lines_col="r", dropped_col="s").count() == 0


# ------------------------------------------------------------------ sharding
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    places = permute(np.arange(n), n, seed=9)
    assert sorted(places.tolist()) == list(range(n))
    assert unpermute(places, n, seed=9).tolist() == list(range(n))
    if n > 500:
        assert (places != permute(np.arange(n), n, seed=8)).any()


def test_sharding(spark, odd_docs):
    out = assign_shards(odd_docs, 4).collect()
    assert len(out) == odd_docs.count()
    by_shard = collections.defaultdict(list)
    for r in out:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    sizes = [len(by_shard.get(s, [])) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(r["row"] for r in out) == list(range(len(out)))
    want = collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in pairs(odd_docs))
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    again = assign_shards(odd_docs.repartition(7), 4, partitions=3).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    assert assign_shards(odd_docs.limit(0), 4).count() == 0


# ---------------------------------------------------------------------- chat
def test_chat_events(spark):
    rows = [
        (1, 1, "m1", "message", "user", "Hi"),
        (1, 2, "m2", "message", "assistant", ""),
        (1, 3, "m2", "delta", "assistant", "Hel"),
        (1, 4, "m2", "delta", "assistant", "lo"),
        (1, 5, "m1", "edit", "user", "Hi there"),
        (1, 6, "m2", "regenerate", "assistant", None),
        (1, 7, "m2", "delta", "assistant", "Good "),
        (1, 8, "m2", "delta", "assistant", "day"),
        (1, 9, "m3", "message", "user", "gone"),
        (1, 10, "m3", "delete", "user", None),
        (2, 1, "m1", "delta", "assistant", "never opened"),
        (2, 2, "m1", None, None, None),
    ]
    log = spark.createDataFrame(rows, "conv_id long, turn long, msg string, kind string, role string, text string")
    folded = fold_events(log.repartition(4), kind_col="kind", message_col="msg")
    chats = {r["conv"]: r for r in format_chats(folded).select("conv", "formatted", read_turns(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in chats[1]["t"]] == [("user", "Hi there"), ("assistant", "Good day")]
    assert [tuple(t) for t in chats[2]["t"]] == [("assistant", "")]
    assert chats[1]["formatted"].startswith("<|im_start|>user<|im_sep|>Hi there<|im_end|>\n")


def test_chat_round_trip(spark):
    rnd = random.Random(2)
    bits = ["\\", "<|", "<|im_end|>\n", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<", "|", "a", "\n", " ", "é", "\\\\"]
    texts = ["", *["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(300)]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", r["e"])
    roles = ["user", "assistant", "system", None, "a<|b"]
    rows = [(i % 20, i, rnd.choice(roles), t if i % 7 else None) for i, t in enumerate(texts)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = format_chats(fold_events(log.withColumn("conv", F.lit("x")).withColumn("at", F.lit(1))))
    got = chats.select("conv", read_turns(F.col("formatted")).alias("t"), read_loss(F.col("segments")).alias("l"), "formatted", "segments")
    for r in got.collect():
        own = [(role or "", t or "") for c, _, role, t in rows if c == r["conv"]]
        assert [tuple(t) for t in r["t"]] == own
        assert r["l"] == "".join(t for role, t in own if role == "assistant")
        assert "".join(s["piece"] for s in r["segments"]) == r["formatted"]
    assert format_chats(fold_events(log.limit(0))).count() == 0


def test_chat_ties_and_nulls(spark):
    rows = [(None, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (1, None, "user", "first")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: [x["text"] for x in r["t"]] for r in format_chats(fold_events(log)).select("conv", read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {None: [""], 1: ["first", "a", "a", "b"]}


def test_weights_come_from_labelled_pages(spark):
    plain = [(f"u{i}", "<div><p>some words here</p></div>") for i in range(2000)]
    named = [(f"n{i}", "<nav>a b</nav><article><p>many words of the text</p></article><div>c</div>") for i in range(3)]
    named.append(("r", '<div role="main">more words</div><footer>x y z</footer>'))
    learn = lambda rows: learn_weights(spark.createDataFrame(rows, "url string, html string"), "url", "html", 20)
    want = learn(named)
    assert want != DEFAULT_WEIGHTS
    # neither pages without labels nor repeated keys take up the sample
    assert learn(plain + named) == want
    assert all(learn([*named, *[row] * 100]) == want for row in named)
