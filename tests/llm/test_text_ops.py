"""Quality rules, BPE, token counts and URL rules against plain versions."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from querymill.llm import bpe, quality_rules, text as tx, token_counts, url_filter
from querymill.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "a", "  a b  c\n\n d　e", "x" * 300, "abc " * 50, "l1\nl2\nl1\n \n \nl1", "naïve café\x1c\x1d'll don't 12³½Ⅷ", "<|endoftext|> a<|endoftext|>", "日本語 テキスト 🙂🙂", "tab\tand\x0bvt\x85nel", " lead", "trail ", "a  \n b"]


def random_texts(n, seed=1):
    r = random.Random(seed)
    alphabet = "abcde  \n\t.'é$#" + "日🙂"
    return ["".join(r.choices(alphabet, k=r.randint(0, 120))) for _ in range(n)] + [" ".join(r.choices(["aa", "b", "cc", "d"], k=r.randint(5, 60))) for _ in range(n)]


def plain_measures(t):
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]


def test_measures_equal_a_plain_version():
    texts = ODD + random_texts(200)
    found = quality_rules.measure([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert [int(found[k][i]) for k in quality_rules.MEASURES] == plain_measures(t), repr(t)


def test_word_hashes_do_not_depend_on_the_block():
    texts = [t.encode() for t in ODD + random_texts(50)]
    whole = tx.words(texts)
    h = tx.word_hashes(whole)
    for i, t in enumerate(texts):
        alone = tx.word_hashes(tx.words([t]))
        assert (alone == h[whole.first[i] : whole.first[i + 1]]).all()
    words = {w for t in texts for w in t.split()}
    assert len({int(tx.word_hashes(tx.words([w]))[0]) for w in words}) == len(words)


@pytest.fixture(scope="module")
def coder():
    return bpe.load(tokenizer("byte_bpe_50k.json"))


def test_bpe_equals_the_library(coder):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    lib.no_truncation()
    lib.no_padding()
    r = random.Random(5)
    wide = ["".join(chr(r.choice([r.randint(32, 127), r.randint(160, 0x24F), r.randint(0x370, 0x5FF), r.randint(0x2000, 0x2100), r.randint(0x3040, 0x30FF), r.randint(0x1F300, 0x1F64F), 9, 10, 32, 32])) for _ in range(r.randint(0, 200))) for _ in range(300)]
    for t in ODD + random_texts(200) + wide + ["ab" * 5000, "q" * 777]:
        ids = lib.encode(t, add_special_tokens=False).ids
        mine = coder.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids, repr(t)
        assert coder.decode(mine) == lib.decode(ids, skip_special_tokens=False)


def test_rank_array_and_heap_merge_alike(coder):
    r = random.Random(3)
    for _ in range(300):
        word = bytes(r.choices(b"abethr nio", k=r.randint(1, 60)))
        assert coder.merge(word) == coder.merge_long([coder.byte_id[b] for b in word])


def test_spliced_counts_equal_whole_counts():
    counter = token_counts.load(tokenizer("piece_bpe_32k.model"))
    assert counter.splits_at_space
    r = random.Random(9)
    for _ in range(60):
        t = "".join(r.choices(["the ", "oué ", "  ", " \n", "日本", "🙂", "ab", "▁", "thering ", "x" * 90, "\t"], k=r.randint(50, 600)))
        assert counter.count(t, chunk=r.choice([20, 64, 200]), overlap=r.choice([4, 16, 32])) == len(counter.model.encode(t))
    for t in ["y" * 3000, " " * 3000, "a " * 3000, "é" * 500 + " ", ("w" * 40 + " ") * 200]:
        assert counter.count(t, chunk=100, overlap=10) == len(counter.model.encode(t))


def test_url_rules_and_terms():
    j = url_filter.UrlJudge(url_filter.UrlPolicy())
    assert j.judge("https://WWW.Example.com/en/71?x=1")[:4] == ("www.example.com", "/en/71", "example.com/en/7", "allow")
    assert j.judge("https://a.example.com/en/61")[2:4] == ("com/en/", "block")
    assert j.judge("http://x.example.net/de/81#f")[2:4] == ("example.net/de/8", "block")
    assert j.judge("http://x.example.net/de/7")[2:4] == ("net/de/", "allow")
    assert j.judge("http://notnet/de/7")[2:4] == (None, "allow")
    assert j.judge("http://net/de/7")[2:4] == ("net/de/", "allow")
    assert j.judge(None)[:4] == ("", "", None, "allow")
    assert j.judge("no scheme")[:4] == ("", "", None, "allow")
    assert j.judge("casino-win.example/free-bets")[:4] == ("", "", None, "block")
    assert j.judge("http://a.org?q")[:4] == ("a.org", "", None, "allow")
    assert j.judge("http://spam-farm.example.fr/x")[3] == "block"
    assert j.judge("http://despam-farms.example.fr/x")[3] == "allow"
    assert j.judge("http://a.fr/cheap")[3] == "allow"
    assert j.judge("http://a.fr/cheap/pills")[3] == "block"
    assert j.judge("http://a.fr/cheap/cheap")[3] == "allow"


def test_digest_is_of_little_endian_ids(coder):
    assert sha256(coder.encode("a b")).hexdigest() == sha256(np.array([64, 275], "<u4").tobytes()).hexdigest()
