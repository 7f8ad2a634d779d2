"""Token files and pages: added tokens, unassigned codepoints, and page parts that belong to the text."""

import numpy as np
import pytest

from memloom.llm import html, tokenfile


def test_texts_with_added_tokens_are_encoded_whole():
    from tokenizers import Tokenizer

    path = tokenfile.default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = ["hello<|endoftext|> world", "hello world", "", "<|endof", "text|> a", "caf\u00e9 \u0378\u0378 x", "<|endoftext|><|endoftext|>", "\U0001f600 ok"]
    data = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, at = tokenfile.Library(path).encode(np.frombuffer(b"".join(data), np.uint8), off)
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in got[0]


LINE = "Some words of a paragraph that is long enough to be the text of this page, with more to follow."


def test_dense_parts_beside_the_largest_container_are_kept():
    lead, body = " ".join([LINE] * 3), [f"{k} " + " ".join([LINE] * 5) for k in range(10)]
    page = f"<body><div><div class=intro><p>{lead}</p></div><div class=content>" + "".join(f"<p>{b}</p>" for b in body) + "</div></div></body>"
    assert html.main_text(page) == "\n".join([lead, *body])


def test_title_and_lead_of_main_are_kept_with_its_article():
    body = [f"{k} {LINE}" for k in range(8)]
    article = "<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"
    assert html.main_text(f"<main><h1>Title</h1><p>{LINE}</p>{article}</main>") == "\n".join(["Title", LINE, *body])
    assert html.main_text(f"<main><h1>T</h1>{article}</main>") == "\n".join(["T", *body])


BODY = "".join(f"<p>{k} {LINE}</p>" for k in range(6))
TEXT = "\n".join(f"{k} {LINE}" for k in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id='page' class='site has-sidebar'>{BODY}</div></body>",
        f"<body><div class='no-comments layout'>{BODY}</div></body>",
        f"<body><div class='widget'>{BODY}</div></body>",
        f"<body><div>{BODY}</div><div class='user-comments'><p>{LINE * 30}</p></div></body>",
        f"<body><div>{BODY}</div><div class='site-footer'><p>{LINE}</p></div></body>",
        f"<body><article>{BODY}<div><h3>12 Comments</h3><p>{LINE}</p></div></article></body>",
        f"<body><article>{BODY}<h3>Comments (3)</h3><p>{LINE}</p><div><p>{LINE}</p></div></article></body>",
        f"<body><article>{BODY}<div class='ad-slot'><p>{LINE}</p></div><p class='advert'>{LINE}</p></article></body>",
    ],
)
def test_names_of_wrappers_and_comments(page):
    assert html.main_text(page) == TEXT


def test_names_that_are_no_parts_of_the_page():
    page = f"<article>{BODY}<section id='related-work'><h2>Related work</h2><p>{LINE}</p></section><p class='form-of-life'>{LINE}</p></article>"
    assert html.main_text(page) == "\n".join([TEXT, "Related work", LINE, LINE])


def test_long_slices_and_small_caches_are_tiktoken(monkeypatch):
    import base64

    import pyarrow as pa
    import public_tokenizers
    import tiktoken

    from memloom.llm import bpe
    from memloom.llm.base import flat

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé 1!"), int(rng.integers(1, 9)))) for _ in range(3000)]
    texts = [" ".join(words[k : k + 40]) for k in range(0, 3000, 40)] + [base64.b64encode(rng.bytes(30_000)).decode(), "x" * 5000, "漢字" * 2000, "the" * 900, " ".join(words)] * 2
    for kind in (bpe.Ranks, tokenfile.Library):
        monkeypatch.setattr(kind, "CACHED", 200)
        monkeypatch.setattr(kind, "PLACES", 6)
    ranks = bpe.Ranks(bpe.default_ranks())
    library = tokenfile.Library(tokenfile.default_tokenizer())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    for a in range(0, len(texts), 7):
        buf, off = flat(pa.array(texts[a : a + 7]))
        for tokenizer, expected in ((ranks, plain.encode_ordinary), (library, lambda t: library.tokenizer.encode(t, add_special_tokens=False).ids)):
            ids, at = tokenizer.encode(buf, off)
            assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == [expected(t) for t in texts[a : a + 7]]


def test_categories_of_all_codepoints():
    import unicodedata

    from memloom.llm import bpe

    assert all(unicodedata.category(chr(k)) == c for k, c in enumerate(bpe.categories().tolist()))


def test_passages_of_negative_and_null_ids(spark, tmp_path):
    import duckdb

    from memloom.llm import substrings

    text = " ".join(f"w{k}" for k in range(20))
    rows = [(-5, text), (3, text), (4, text + " more"), (-9, "other " * 15), (-8, "other " * 15), (0, None), (7, ""), (-1, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in substrings.op3_repeated_passages(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(connection.execute(substrings.OP3_SQL).fetchall()) and {(i, n) for i, _, n, _ in got} >= {(-5, 0), (3, 20), (4, 20), (-9, 0), (-8, 15)}
    nulls = spark.createDataFrame([(None, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(nulls).collect()) == [("1", 0), ("2", 20), ("None", 0), ("None", 0)]


def test_very_long_texts_have_whole_sets():
    """A text of many chunks: its words, windows and signature are those of plain Python."""
    import pyarrow as pa

    from memloom.llm import neardup
    from memloom.llm.base import Words, flat

    words = [f"w{k % 70001}" for k in range(400_000)]
    buf, off = flat(pa.array([" ".join(words)], pa.large_string()))
    found = Words(buf, off)
    first = {}
    for word, h in zip(words, found.hash.tolist(), strict=True):
        assert first.setdefault(word, h) == h
    assert len(set(first.values())) == len(first)
    h, at = neardup.shingles(buf, off, 2)
    assert len(h) == len(set(zip(words, words[1:]))) == at[-1]
    assert np.isfinite(neardup.superminhash(h, at, 200)).all()
