import random

import numpy as np

from foliant.llm.encoding import WordEncoder
from foliant.llm.queries import tokenizer_path


def test_forms_of_a_word_are_kept_once():
    own = WordEncoder(tokenizer_path())
    own.ids([b"Word word, WORD. (word) \"word\""])
    assert [w for w in own.words if b"word" in w.lower()] == [b"word"] and len(own.words) == 6


def test_cut_texts_have_the_ids_of_whole_ones():
    own, rng = WordEncoder(tokenizer_path(), kept=500), random.Random(3)
    letters = ["a", "B", "th", "É", "ß", "ÿ", "×", "÷", "7", "42", ".", ",", ")", "...", "-", "_", "<", "|", "'", "'s", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "Ω", "́", "ı", "<|endoftext|>"]
    for most in (14, 22, len(letters)):
        texts = ["".join(rng.choice(letters[:most] + [" "]) for _ in range(rng.randrange(60))) for _ in range(400)]
        whole = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        for at in range(0, 400, 40):
            assert own.ids([t.encode() for t in texts[at:at + 40]]) == whole[at:at + 40]
