"""Operators that work row by row, against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from textmine.llm import bpe, html_text, licenses, pii
from textmine.llm.queries import BYTE_BPE, MULTI_BPE, QUERIES

DOCUMENTS = "doc_id long, text string, token_ids string"
ODD = [
    "",
    None,
    "a@b.c+x@d.e a@b@c.d a..b@c..d x@y.z.",
    "1.2.3.4.5.6.7.8.9 256.1.1.1 001.002.003.004 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111-2 4111  1111",
    "+1 (017) 555-7713 +12345678901234567 ++44 20 7946 0958.",
    "\U0001f600 a@b.co \U0001f600 4111111111111111",
    "9" * 20000,
    "a@" + "b." * 9000 + "c",
    "1 " * 9000,
    "x@y.z" * 400,
    "<|endoftext|>hi <|endoftext|>",
    " " * 300 + "x",
    "don't I'LL 12345 \n\n\t x y",
    "CC BY-SA. All rights reserved. the GNU General Public License, cc  by",
    "Licensed under the Apache License, Version 2.0.",
    "licenKe cc byK All Rights\nReserved",
]


def random_texts(n: int) -> list[str]:
    rng = random.Random(3)
    return ["".join(rng.choice("0123456789.@- +ab(4)1") for _ in range(50)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = ODD + random_texts(60)
    return [(i, t, "clash") for i, t in enumerate([*texts, texts[2]])]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_against_the_library(spark, folder, rows):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(BYTE_BPE)
    own.no_padding()
    own.no_truncation()
    got = QUERIES["op7_bpe_round_trip"](spark, folder(documents=(rows, DOCUMENTS))).collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        assert found[i] == (len(ids), sha(",".join(map(str, ids))), sha(decoded)), text


def test_bpe_keeps_columns_and_takes_rank_files(spark, rows):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(MULTI_BPE, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding(
        "own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    frame = spark.createDataFrame(rows, DOCUMENTS)
    out = bpe.encode(frame, MULTI_BPE)
    assert out.columns == ["doc_id", "text", "token_ids"]
    for r in out.collect():
        assert r["token_ids"] == own.encode_ordinary(r["text"] or "")
    assert bpe.encode(frame.limit(0), MULTI_BPE).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert bpe.decode(nulls, MULTI_BPE).first()["decoded"] == ""


def test_long_words_and_full_tables(monkeypatch):
    """Runs without a space, in several scripts, and tables that turn over at every batch."""
    import random

    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 50)
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    signs = letters + letters.upper() + "0123456789+/"
    texts = [
        "漢字仮名" * 200,
        "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(2000)),
        "".join(draw.choice(signs) for _ in range(6000)),
        "".join(draw.choice(letters) for _ in range(70_000)),
        "ab" * 2000 + "a" * 3001,
        *(" ".join(draw.choice(letters) * n + draw.choice(letters) for n in range(80)) for _ in range(9)),
        None,
        "",
    ]
    with open(BYTE_BPE, "rb") as file:
        content = file.read()
    own = bpe.Encoder(bpe.Vocabulary.parse(content))
    library = tokenizers.Tokenizer.from_buffer(content)
    for text in [*texts, *texts]:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert own.encode([text])[0].tolist() == want
        assert own.count([text]).tolist() == [len(want)]
    assert max(len(own.chunks), len(own.words)) < 400


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                total = sum(d - 9 if d > 9 else d for d in doubled)
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_against_brute_force(spark, folder, rows):
    got = QUERIES["op10_personal_data"](spark, folder(documents=(rows, DOCUMENTS))).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        spans = brute_spans(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        own = [s for s in found[i]["spans"].split(",") if s and not s.startswith("term")]
        assert ",".join(own) == joined
        assert found[i]["base_sha256"] == sha(joined)
        assert found[i]["n_card"] == sum(k == "card" for k, _, _ in spans)


def test_terms_that_disclose_an_entity(spark):
    """A term that stands with one address only gives it away; a common one does not."""
    common = [(100 + i, f"plain words about nothing in particular {i}") for i in range(40)]
    told = [
        (1, "write to zanzibar person at ab@cd.ef about plain words"),
        (2, "dear zanzibar friend, ab@cd.ef is known for words"),
        (3, "dear zanzibar friend, ab@cd.ef is known for words"),
    ]
    frame = spark.createDataFrame(common + told, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame).collect()}
    terms = {told[d - 1][1][s["start"] : s["end"]] for d in (1, 2) for s in spans[d] if s["kind"] == "term"}
    assert "zanzibar" in terms and "words" not in terms
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert "[EMAIL]" in clean[1] and "zanzibar" not in clean[1] and clean[100] == common[0][1]
    assert pii.sanitise(frame.limit(0)).count() == 0


def test_terms_anywhere_in_documents_with_the_entity(spark):
    """A short name, and one with a digit, far from the address and at several places."""
    far = " plain words about nothing in particular" * 5
    told = [
        (1, f"Bo came with r2d2.{far} write to ab@cd.ef about words"),
        (2, f"ab@cd.ef is known for words.{far} bo, r2d2 and again BO"),
    ]
    common = [(100 + i, f"plain words about nothing in particular {i}") for i in range(40)]
    frame = spark.createDataFrame(told + common, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(frame).collect()}
    for i, text in told:
        got = [text[s["start"] : s["end"]].lower() for s in spans[i] if s["kind"] == "term"]
        assert got.count("bo") == i and got.count("r2d2") == 1 and "words" not in got
    assert not any(spans[i] for i, _ in common)


def test_sanitised_rows_without_or_with_equal_ids(spark):
    rows = [(None, f"{'x ' * i}write to u{i}@cd.ef") for i in range(5)]
    rows += [(7, "call me, a@b.cd"), (7, "b@c.de calls"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["text"] or "" for r in pii.sanitise(frame).collect())
    wanted = [f"{'x ' * i}write to [EMAIL]" for i in range(5)]
    assert got == sorted([*wanted, "call me, [EMAIL]", "[EMAIL] calls", ""])


def test_licence_phrases_against_brute_force(spark, folder, rows):
    got = QUERIES["op2_license_scan"](spark, folder(documents=(rows, DOCUMENTS))).collect()
    found = {r["doc_id"]: r for r in got}
    for i, text, _ in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [
            (at, label)
            for phrase, label in licenses.PHRASES
            for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        ]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == min((p for p, _ in places), default=None)
        assert r["last_word"] == max((p for p, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert 0 <= r["score"] <= 1
    apache = next(i for i, t, _ in rows if t and t.startswith("Licensed"))
    assert (found[apache]["labels"], found[apache]["score"]) == ("apache-2.0", 1.0)


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>'
    '<a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy</div><header>top</header>'
    "<article><h1>Head &amp; more</h1><p><b>One\n two.<br><p>Three&nbsp;four</p>"
    '<div class="comments"><p>I disagree</p></div><script>var t="</p>";</script></article>'
    '<aside>side</aside><form>mail</form><footer>&copy; x</footer></body></html>'
)


def test_main_text_of_pages(spark, folder):
    other = PAGE.replace("article", "div")
    plain = "<div class=menu>m</div><div id=story><p>Long text of the page.</p><p>More.</p></div>"
    pages = [
        (1, "http://a.b/1", PAGE, "x"),
        (2, "http://a.b/2", PAGE.replace("One", "Uno"), "x"),
        (3, "http://c.d/1", None, "x"),
        (4, None, "", "x"),
        (5, "http://e.f/1", plain, "x"),
        (6, "http://e.f/2", plain.replace("More", "Mehr " * 5000), "x"),
        (7, "http://g.h/1", other, "x"),
        (7, "http://g.h/1", other, "x"),
        (8, "http://g.h/2", "no markup <b>at all", "x"),
    ]
    schema = "page_id long, url string, html string, text string"
    got = QUERIES["op3_html_text"](spark, folder(pages=(pages, schema))).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages)
    assert text[1] == "Head & more\nOne two.\nThree four"
    assert text[2] == "Head & more\nUno two.\nThree four"
    assert text[3] == text[4] == ""
    assert text[5] == "Long text of the page.\nMore."
    assert text[6].startswith("Long text of the page.\nMehr Mehr") and len(text[6]) > 20000
    assert text[7] == "Head & more\nOne two.\nThree four"
    assert text[8] == "no markup at all"
    empty = spark.createDataFrame([], schema)
    assert html_text.extract(empty).count() == 0
    assert html.unescape("&amp") == "&"


def test_tokens_are_counted_without_encoding_plain_texts(monkeypatch):
    with open(BYTE_BPE, "rb") as file:
        own = bpe.Encoder(bpe.Vocabulary.parse(file.read()))
    parts = ["Hello", "don't", "Stühle,", "23", "###", "a.\nThe", "x", "", "\n", "\t", "<|endoftext|>", "\0"]
    rng = random.Random(4)
    odd = [" ".join(rng.choices(parts, k=rng.randrange(6))) for _ in range(600)]
    odd += [None, " ", "a ", " a", "a b\n", "a b \n", "a b\n\n", "a\x1c b", "a b\x1c", "a b!\x1c\n"]
    _, offsets = own.encode(odd)
    monkeypatch.setattr(bpe, "KEPT_SIZES", 5)
    for _ in range(2):  # with tables from before as well
        assert own.count(pa.array(odd, pa.string())).tolist() == np.diff(offsets).tolist()

    plain = ["Hello Stühle, don't worry", "one.\nThe end\n", "word", ""]
    want = np.diff(own.encode(plain)[1]).tolist()
    monkeypatch.setattr(bpe.Encoder, "_packed", None)
    assert own.count(plain).tolist() == want
