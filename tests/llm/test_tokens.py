"""The fast encoders against the library, text by text."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokens = pytest.importorskip("bramble.llm.tokens")
pytest.importorskip("public_tokenizers")

HARD = [
    None,
    "",
    " ",
    "   ",
    "a",
    "it's I'm we'll they've you're he'd don't IT'S",
    "it''s '' 's 'st 'tre 'relish 'lll ' s",
    " 's \n's !'s  's\t've",
    "a  b   c\n\nd \n e\t\tf  ",
    "x y　z  w",
    "1234 56 7a8 ½ Ⅷ ٣",
    "<|endoftext|>",
    "a<|endoftext|> b <|endoftext|><|endoftext|>  c <|startoftext|>d's",
    "<|endoftext| <endoftext|>",
    "Straße İstanbul ΣΊΣΥΦΟΣ ﬁ é é ͅ ǅ",
    "日本語のテキスト 한국어 עברית 😀😀 👩‍👩‍👧",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20,
    "\x00\x01\x7f\x85\x1c\x1d",
    "word " * 3000,
    "!!!???...  ,,, '-' --'s",
]


def same(path, texts):
    library = tokens._library(path)
    ids, bounds = tokens.encode(path, texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)[:200]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_hard_texts(name):
    path = tokens.default_path(name)
    assert tokens.encoder(path) is not None
    same(path, HARD)
    same(path, HARD[::-1])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("'stremvld  \n\tAa1!é"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_texts(name, texts):
    same(tokens.default_path(name), texts)


def test_bounded_memory():
    path = tokens.default_path("byte_bpe_50k.json")
    fast = tokens.encoder(path)
    small = type(fast)(fast.specials, fast.keep_blanks, fast.make, None, most=50)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for t in texts:
        ids, bounds = small.ids([t])
        assert ids.tolist() == tokens._library(path).encode(t, add_special_tokens=False).ids
        assert np.array_equal(bounds, [0, len(ids)])


def test_many_special_strings():
    """Time grows with the text, not with the text times its special strings."""
    path = tokens.default_path("byte_bpe_50k.json")
    special = next(iter(tokens.encoder(path).specials))
    same(path, [special, f"a{special}{special} b", special[:-1] + special, f"x {special}" * 30_000])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_in_parts(monkeypatch, name):
    """Texts that are worked on piece by piece give the ids of the whole."""
    import public_tokenizers

    from bramble.llm import pretokens, token_counts

    path = str(public_tokenizers.path(name))
    hard = [(" ".join(x for x in HARD if x) + " plain words it's here ") * 3, "no cut" * 50, "日本語" * 60, "a b" * 100, None]
    whole = [tokens._library(path).encode(t or "", add_special_tokens=False).ids for t in hard]
    for long in (20, 100):
        monkeypatch.setattr(pretokens, "LONG", long)
        ids, bounds = tokens.encode(path, hard)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == whole
        if name.startswith("byte"):
            assert token_counts.count_tokens(path, hard).tolist() == [len(x) for x in whole]
