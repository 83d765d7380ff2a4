"""BPE and prefix counts against the library, HTML on hand-made pages."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shopfloor.llm.bpe import encode_documents, load
from shopfloor.llm.html_extract import DEFAULT_WEIGHTS, best_stretch, extract_main_text, main_text
from shopfloor.llm.token_counts import count_tokens, counter, truncate_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
POOLS = [
    "abcdeABCDE'strvemlld ", "àéîÀÉßΣσςİıǅﬁ", "é̀ ", "\t\n\x0b\x0c\r\x1c\x85\xa0 　", "1234²½Ⅷ", "!?.,#$%&*<>|_-\"",
    "日本語中文한국어", "😀👍🏽", "<|endoftext|>", "<|startoftext|>", "<|", "ЖдиΩψ", "\x00\x7f", "aaaaaaa!!!!!!!!",
]


def odd_text(rnd):
    parts = []
    for _ in range(rnd.randint(0, 50)):
        pool = rnd.choice(POOLS)
        parts.append(pool if pool.startswith("<|") else "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 6))))
    return "".join(parts)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    return [odd_text(rnd) for _ in range(800)] + ["a" * 1000, "ab" * 700 + "!" * 999, "", "  ", "<|endoftext|>" * 5, "日本語" * 400]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_decoding(texts, library):
    for (coded, decoded), want in zip(load(PATH).encode_texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coded == " ".join(map(str, want.ids))
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_prefix_counts(texts, library):
    c = counter(PATH)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    assert [sum(n) for n in c.text_counts(texts)] == [count(t) for t in texts]
    for word in ("internationalization", "thblethnand", "aaaaaaab", "éßstraße"):
        raw = word.encode()
        whole = c.prefixes(raw)[1]
        for n in range(len(raw) + 1):
            part = raw[:n].decode(errors="ignore")
            if part.encode() == raw[:n]:
                assert whole[n] == count(part)
    words = [w for t in texts for s in load(PATH).segments(t)[::2] for w in load(PATH).words(s)]
    raws = [w.encode() for w in sorted(set(words)) if len(w.encode()) <= 48]
    assert c.count_many(raws).tolist() == [c.prefixes(r)[1][-1] for r in raws]


def test_truncation(texts, library):
    c, rnd = counter(PATH), random.Random(4)
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for t in texts[:150]:
        if "<|" in t:
            continue
        budget = rnd.randint(0, 25)
        assert len(c.truncate(t, budget)) == max(n for n in range(len(t) + 1) if count(t[:n]) <= budget)


def test_documents(odd_docs, library):
    ids = {}
    for r in encode_documents(odd_docs, PATH, prefix="q_").collect():
        ids.setdefault(r["doc_id"], []).append(r)
    counts = {r["doc_id"]: r for r in count_tokens(odd_docs, PATH, limit=3, keep_prefixes=True, prefix="q_").collect()}
    for r in odd_docs.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        if r["doc_id"] is None:
            continue
        got = next(x for x in ids[r["doc_id"]] if x["kept"] == r["kept"])
        assert list(got["q_ids"]) == want and got["q_n_tokens"] == len(want)
        assert got["q_ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        n = counts[r["doc_id"]]
        assert n["q_n_tokens"] == len(want) and n["q_n_bytes"] == len((r["text"] or "").encode())
        assert n["q_over_limit"] == (len(want) > 3) and (n["q_ends"][-1] if n["q_ends"] else 0) == len(want)
    assert len(ids[8]) == 2
    for r in truncate_documents(odd_docs.select("doc_id", "text"), PATH, 4).collect():
        assert len(library.encode(r["text"], add_special_tokens=False).ids) <= 4
    assert encode_documents(odd_docs.limit(0), PATH, prefix="q_").count() == 0
    assert count_tokens(odd_docs.limit(0), PATH, prefix="q_").count() == 0


# ---------------------------------------------------------------------- html
PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var a="<p>no</p>"</script></head><body>
<div id="menu"><a href=x>Home</a> <a>About</a></div><header>Site head</header><div class="cookie-notice">We set cookies.</div>
%s<h2>Big&nbsp;title</h2><p>A long par<b>a</b>graph with many words, AT&amp;T &eacute;&#233; and more.<p>Second <i>one</i>,
 words too.<aside>side bar</aside><form><label>Mail</label><input></form><ul><li>item one<li>item two</ul>%s
<section class="comments"><p>A reader says that this is a very nice article indeed, on and on and on.</p></section>
<div class=sidebar>links</div><!-- <p>gone</p> --><footer>&copy; 2020 all of it</footer>"""
WANT = "Big title A long paragraph with many words, AT&T éé and more. Second one, words too. item one item two"


@pytest.mark.parametrize("holder", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_page(holder):
    # such weights as labelled pages give: a tag costs less than a word brings
    assert main_text(PAGE % holder, {"word": 10.0, "excluded": -11.0, "tag": -6.0})[0] == WANT
    assert main_text(PAGE % holder, DEFAULT_WEIGHTS)[0] == WANT


def test_page_without_a_holder():
    """The stretch itself, which ends before the form."""
    weights = {"word": 10.0, "excluded": -11.0, "tag": -6.0}
    assert main_text(PAGE % ("", ""), weights)[0] == WANT[: WANT.index(" item one")]


def test_stretch():
    assert best_stretch([]) == (0, 0, 0.0) and best_stretch([-1.0, -2.0]) == (0, 0, 0.0)
    rnd = random.Random(6)
    for _ in range(200):
        s = [float(rnd.randint(-4, 4)) for _ in range(rnd.randint(1, 14))]
        a, b, total = best_stretch(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert total == best == sum(s[a:b])


def test_pages(spark):
    rows = [
        (1, "a", PAGE % ("<article>", "</article>"), "x", 1),
        (1, "a", PAGE % ("<article>", "</article>"), None, 1),
        (2, None, None, None, None),
        (None, "c", "", "x", 2),
        (3, "d", "<p>", "x", 2),
        (4, "e", "plain words < 5 and > 3", "x", 2),
        (5, "f", "<nav>only a menu</nav>", "x", 2),
        (6, "g", "<article>" + "<p>long words here. " * 30_000, "x", 2),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, score int")
    out = [r for r in extract_main_text(pages, key_col="url", prefix="q_").collect()]
    got = {r["page_id"]: r["q_text"] for r in out}
    assert len(out) == 8 and got[1] == WANT and got[2] == got[None] == got[3] == got[5] == ""
    assert got[4] == "plain words < 5 and > 3" and got[6] == " ".join(["long words here."] * 30_000)
    assert all(r["q_n_chars"] == len(r["q_text"]) for r in out)
    assert extract_main_text(pages.limit(0), key_col="url", prefix="q_").count() == 0
