"""Documents' windows are looked up only where all their tokens are known, and none that matches is passed over."""

import random

import numpy as np

from tapewatch.llm import templates

WORDS = ["plain", "Words", "İstanbul", "ﬁne", "naïve", "K", "Σας", "ΑΣ", "12", "3.5", "kg", "€5", "Ünder", "don't", "x.y", "ǅ", "“quoted”", "e-mail", "ſo", "A"]


def texts(seed, n, words):
    draw = random.Random(seed)
    return [" ".join(draw.choice(words) + draw.choice(["", "", ".", "!\n", ",", "\t"]) for _ in range(words_in)) for words_in in range(n)]


def test_tokens_of_no_item_are_not_looked_up():
    every = np.full(64, 255, dtype=np.uint8)  # a filter that lets all windows through
    for text in texts(1, 40, WORDS + ["unknown", "Unheard"]):
        all_tokens = templates.tokens(text)
        known = [t for w in WORDS for c, raw in templates.tokens(f"{w} {w}") for t in (c, templates._verbatim(raw))]
        got = set(templates._Matcher(every, [3], known).places(text))
        want = {(3, i, verbatim) for verbatim in (False, True) for i in range(len(all_tokens) - 2)
                if all((templates._verbatim(raw) if verbatim else c) in known for c, raw in all_tokens[i:i + 3])}
        assert got == want
        assert len(templates._Matcher(every, [3]).places(text)) == 2 * max(0, len(all_tokens) - 2)


def test_words_of_a_text_equal_the_plain_way():
    for text in texts(2, 60, WORDS):
        words = {w for raw in templates._LETTERS.findall(text) for w in templates._letters(raw)}
        for word in {w for raw in templates._LETTERS.findall(" ".join(WORDS)) for w in templates._letters(raw)}:
            assert templates.may_hold(text, {word: [frozenset([word])]}) == (word in words), (text, word)
        assert templates.may_hold(text, {"": [frozenset()]})
