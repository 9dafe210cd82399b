"""Words of letters go to the tokenizers library many to a text, and each piece of a text is looked up once."""

import public_tokenizers

from reelspan.llm.token_blocks import Encoder


class Counting:
    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_words_are_encoded_together_with_the_ids_they_have_alone():
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [a + b for a in ("an", "Be", "ét", "ª", "zß", "loñ") for b in ("ka", "TI", "mü", "or", "s", "'s", ",", "1", "º") for _ in range(2)]
    text = " ".join(f"{w}{i % 40 * 'x'}" for i, w in enumerate(words * 5)) + " , ,, it's, 中文 12"
    want = [x.ids for x in e.library.encode_batch([text, text[:99], ""], add_special_tokens=False)]
    e.library = Counting(e.library)
    got = e.encode([text, text[:99], ""])
    assert [memoryview(x).cast("I").tolist() for x in got] == want
    before = e.library.texts
    letters = sorted({"".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7)) + "q" * (i % 9) for i in range(2000)})
    apart = e.apart(letters)
    assert e.library.texts - before <= len(letters) // 256 + 1
    assert apart == e.plain(letters)
