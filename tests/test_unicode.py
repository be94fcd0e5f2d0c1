"""Unicode tokens against a plain reading, one character after the other."""

import random
import re
import time
import unicodedata

from tessera.functions import text as T


def plainly(raw):
    def cut(text):
        out, current = [], ""
        for k, c in enumerate(text):
            p, n = text[k - 1] if k else "", text[k + 1] if k + 1 < len(text) else ""
            cjk, was = (bool(re.match(f"[{T._CJK}]", x)) for x in (c, p or " "))
            case = p.islower() and c.isupper() or p.isupper() and c.isupper() and n.islower()
            edge = p and (case or p.isalpha() and c.isdigit() or p.isdigit() and c.isalpha() or p.isalpha() and c.isalpha() and cjk != was)
            word = c.isalnum() or unicodedata.category(c)[0] == "M"
            if edge or not word:
                out.append(current)
                current = ""
            if word:
                current += c
        return [t for t in (*out, current) if t]

    fold = lambda t: unicodedata.normalize("NFKC", t.casefold())
    return [t for first in cut(unicodedata.normalize("NFKC", raw or "")) for t in cut(fold(first))]


def test_same_tokens():
    rng = random.Random(7)
    signs = "aBcDZé߯İıſΣςǅ09²½٣Ⅷ漢かカ한ｶﾞㄱ \t\n　 -_.,'’🅐🄰ⓐ́ͅ‍🙂ªµ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 70))) for _ in range(4000)]
    texts += ["".join(chr(k) for k in range(at, at + 37) if not 0xD800 <= k < 0xE000) for at in range(0, 0x20000, 37)]
    for raw in [*texts, None, "", " "]:
        assert T._python_tokens(raw) == plainly(raw)


def test_words_that_repeat_are_cut_once():
    text = " ".join(f"Wort{k % 50}fuerWort, " for k in range(20_000))
    T._python_tokens(text[:2000])
    began = time.process_time()
    plainly(text[: len(text) // 10])
    before, began = 10 * (time.process_time() - began), time.process_time()
    T._python_tokens(text)
    assert time.process_time() - began < before / 4
