"""Word-at-a-time encoding of op9 against the library, and what it hands to the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidewatch.llm import op9_simple8b

PATH = public_tokenizers.path("word_bpe_49k.json")


def word(n: int) -> str:
    """Five or more letters that tell n."""
    out = ""
    while n or len(out) < 5:
        n, k = divmod(n, 26)
        out += chr(97 + k)
    return out


def test_words_met_before_do_not_go_to_the_library(monkeypatch):
    """The check tool's tables have some 250,000 distinct words in 17 MB: a worker that forgets most of them encodes them again in each task."""
    enc = op9_simple8b.WordEncoder(PATH)
    texts = pa.array([" ".join(word(n) for n in range(k, k + 2000)) for k in range(0, 200_000, 2000)])
    first, ends = enc.encode(texts, 2)
    sent = []
    monkeypatch.setattr(enc, "letters", lambda words, f=enc.letters: (sent.extend(words), f(words))[1])
    again, same_ends = enc.encode(texts, 2)
    assert sent == []
    assert (first == again).all() and (ends == same_ends).all()


def test_word_encoder_gives_the_librarys_ids():
    """Letters with and without ASCII and case, punctuation after them short, long and mixed, marks, digits, special strings, white space of all kinds."""
    rng = random.Random(5)
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    pools = ["abcdefghij", "ABCxyz", "éüßñÅÉ", "İIiı", "ﬁﬀ", "éö", "漢字", "0189", ",.;:!?|%*#&$", "'\"-_()@/", "'s't'll", "  ​", "\U0001f600"]
    odd = ["<|endoftext|>", "<|startoftext|>", "a" * 300, "stop" + "." * 40, "what?!", "yes" + "?!" * 5, "don't", "", "w,.", "naïve,", "ÉCOLE;;"]
    words = odd + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 12))) for _ in range(6000)]
    words += [word(n) + "".join(rng.choice(",.;:!?|%*#&$") for _ in range(n % 13)) for n in range(0, 10**8, 99991)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "  ", "\x0b\x0c\r"]) for _ in range(rng.randrange(40))) for _ in range(900)]
    enc = op9_simple8b.WordEncoder(PATH)
    for k in (0, 300, 0, 600):  # words that are remembered, too
        ids, ends = enc.encode(pa.array(texts[k : k + 300]), 2)
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts[k : k + 300]]
        assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert ids.tolist() == [i for w in want for i in w]


def test_blocks_fill_their_words():
    """Each word takes the selector of most ids whose widths it holds, the last word of a block too; decoding gives the ids back."""
    rng = np.random.default_rng(8)
    for case in range(120):
        n = int(rng.integers(1, 700))
        ids = [rng.integers(0, 50_000, n), rng.integers(0, 1 << int(rng.integers(1, 28)), n), np.zeros(n, np.int64), (rng.random(n) < 0.02) * rng.integers(0, 300, n)][case % 4].astype(np.int64)
        words, at = op9_simple8b.encode_block(ids), 0
        for w in words.tolist():
            fits = [k for k, (size, bits) in enumerate(op9_simple8b.SLOTS) if all(x >> bits == 0 for x in ids[at : at + size].tolist())]
            assert w >> 60 == fits[0]
            at += op9_simple8b.SLOTS[fits[0]][0]
        assert at >= n > at - op9_simple8b.SLOTS[fits[0]][0]
        assert (op9_simple8b.decode_block(words, n) == ids).all()
