"""Words of one letter, and letters beyond the table."""

from strandspark.llm import langid


def test_one_letter_words_and_rare_letters_have_n_grams():
    g = langid.Grams()
    assert len(g.of("A.")) == len(g.of("b")) == 1
    assert g.of("A.") == g.of("(a)")
    assert g.of("a") != g.of("b")
    assert len(g.of("a b c")) == 3
    assert set(g.of("a").tolist()) <= set(g.of("the a house").tolist())
    assert len(g.of("\U00030000\U00030001")) == len(g.of("xy")) > 0
    assert len(g.of("\U00030000")) == 1
    assert len(g.of("1 !")) == len(g.of("")) == len(g.of("\U000E0001")) == 0
