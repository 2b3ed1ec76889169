"""What a query does for each row or term: the work that the CPU budgets count, by numbers and not by the clock."""

import numpy as np
import pyarrow as pa

from lathework.llm import decontam, quality, repair_ids, tokens


def _plain_greedy(left, right):
    """Pairs in order, each looked at: the definition of a batch."""
    firsts, seconds, own, taken = set(), set(), set(), []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a == b:
            if a not in firsts | seconds | own:
                own.add(a)
                taken.append(i)
        elif a not in seconds | own and b not in firsts | own:
            firsts.add(a)
            seconds.add(b)
            taken.append(i)
    return taken


def test_op8_settled_pairs_are_not_looked_at_one_by_one(monkeypatch):
    looked = []
    fit = repair_ids._first_fit
    monkeypatch.setattr(repair_ids, "_first_fit", lambda a, b, side: looked.append(len(a)) or fit(a, b, side))
    rng = np.random.default_rng(5)
    for symbols, n in ((1, 1), (2, 3), (40, 300), (300, 6000)):
        pair = rng.permutation(np.unique(rng.integers(0, symbols * symbols, n)))
        left, right = pair // symbols, pair % symbols
        assert repair_ids._batch(left, right, symbols).tolist() == _plain_greedy(left.tolist(), right.tolist())
    assert sum(looked) < 0.3 * 6000
    assert len(repair_ids._batch(left[:0], right[:0], 1)) == 0


def test_op8_every_other_of_a_run_and_falling_counts():
    at = np.array([0, 1, 2, 3, 7, 8, 11, 12, 13])
    twice = np.array([1, 1, 1, 0, 1, 0, 1, 1, 0], bool)
    assert repair_ids._alternate(at, twice).tolist() == [1, 7]
    assert repair_ids._alternate(at, at < 0).tolist() == []
    for n in (np.array([3, 9, 3, 9, 1]), np.array([70_000, 2, 70_000, 90_000])):
        assert repair_ids._falling(n).tolist() == np.argsort(-n, kind="stable").tolist()
    assert repair_ids._falling(np.empty(0, np.int64)).tolist() == []


def test_op8_bytes_tell_plain_texts_and_small_letters():
    for c in map(chr, range(0x110000)):
        data = c.encode("utf-8", "surrogatepass")
        plain = not tokens._PLAIN.search(c)
        assert (not data.translate(None, tokens._PLAIN_BYTES)) == plain, hex(ord(c))
        if plain:
            assert data.translate(tokens._SMALL) == c.lower().encode()


def test_op8_plain_texts_are_not_searched_by_pattern(monkeypatch):
    encoder = tokens.encoder(tokens.default_path("word_bpe_49k.json"), False)
    texts = ["", "ÀÉ it's 12 Öl!", "a\tb\r\nWe'LL 'd x'y ''s", "ß ÿ Ý ×", "über " * 3, "日本 text", "a\x00b"]
    want = [encoder.whole(t) for t in texts]

    class Odd:
        def search(self, text):
            assert not set(text) <= set(map(chr, (9, 10, 13, *range(32, 127), *(c for c in range(192, 256) if c not in (215, 247)))))
            return True

    monkeypatch.setattr(tokens, "_PLAIN", Odd())
    assert encoder.encode_many(texts) == want


def test_op8_pieces_as_strings():
    for own in ([], ["a"], ["é", "", "日本", "x" * 70_000, "b"]):
        assert tokens._strings(pa.array(own, pa.string())) == own


def test_op5_segment_holds_every_word_in_its_place():
    texts = ["One two, ONE-two 3", None, "", " ,", "\u65e5\u672c one\u00e9 \x00x", "\ud800 one", "two " * 50]
    held = decontam._Segment()
    for k, t in enumerate(texts):
        held.add(k if k != 3 else None, t)
    row = held.batch(7, 64).to_pylist()[0]
    bodies = [decontam.words(t) for t in texts]
    assert row["segment"] == 7 and row["key"] == [0, 1, 2, None, 4, 5, 6]
    assert row["n_words"] == [len(b) for b in bodies]
    bases = np.frombuffer(row["bases"], "<u4").tolist()
    assert bases == [sum(len(b) + 64 for b in bodies[:k]) for k in range(len(bodies))]
    assert row["terms"] == sorted({w for b in bodies for w in b})
    offsets = np.frombuffer(row["offsets"], "<u4").tolist()
    places = np.cumsum(np.frombuffer(row["postings"], "<u4"), dtype=np.uint32).tolist()
    for w, lo, hi in zip(row["terms"], offsets, offsets[1:], strict=False):
        assert places[lo:hi] == [base + i for base, b in zip(bases, bodies, strict=True) for i, x in enumerate(b) if x == w]
    empty = decontam._Segment()
    empty.add(1, None)
    assert empty.batch(0, 64).to_pylist()[0]["terms"] == []


def test_op5_terms_of_a_segment_become_no_python_objects():
    import sys

    held = decontam._Segment()
    held.add(1, " ".join(f"w{i}" for i in range(50_000)))
    batch = held.batch(0, 64)
    block = decontam.Block([("a", "w7 nowhere w49999")])
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        before = sys.getallocatedblocks()
        seg = decontam.Reader(batch, 0, block.vocabulary)
        made = sys.getallocatedblocks() - before
    finally:
        sys.setprofile(None)
    assert seg.count.tolist() == [1, 0, 1]
    assert made < 1000 and len(calls) < 1000


def test_op10_words_of_latin_texts_are_cut_at_spaces(monkeypatch):
    texts = ["".join(map(chr, range(256))) * 2, "a\xa0b\x85c\x1cd_e\u00b2f", "\u0130stanbul \u1e9e", "\u65e5\u672c it\u2019s", "", "\ud800 x"]
    texts += [f"a{chr(c)}b" for c in range(0x3000)]
    want = [quality._WORD.findall(t.lower()) for t in texts]
    assert [quality.words_of(t) for t in texts] == want

    class Odd:
        def findall(self, text):
            assert max(map(ord, text)) > 255
            return ["odd"]

    monkeypatch.setattr(quality, "_WORD", Odd())
    assert quality.words_of("It's \u00c9t\u00e9, 12 x_y") == ["it", "s", "\u00e9t\u00e9", "x", "y"]
    assert quality.words_of("it\u2019s") == ["odd"]


def test_op10_bounded_counts_vote_as_whole_ones():
    rng = np.random.default_rng(3)
    parts = ["one", "ONE", "|", "a#", "#b", "!!", "\u00c9T\u00c9", "\u0416\u0416", "x.", "y,", "\u65e5", "two", "three", "$$", "Q"]
    seen = set()
    for k in range(3000):
        n = int(rng.integers(5, 60))
        weights = rng.dirichlet(np.full(len(parts), 0.2))
        text = "".join(str(w) + str(s) for w, s in zip(rng.choice(parts, n, p=weights), rng.choice([" ", "\n"], n), strict=True))
        words, own, found = quality.parse(text, quality.Lexicons().known)
        if not words:
            continue
        noise, repeats, _ = quality.votes(text, words, own, found, quality.Lexicons())
        split, m = text.split(), len(words)
        n = len(split)
        assert noise[1] == quality._vote(len(quality._MARKED.findall(text)) / n, 0.15, 0.3)
        assert noise[4] == quality._vote(sum(map(str.isupper, split)) / n, 0.4, 0.6)
        if n >= 12:
            assert noise[6] == quality._vote(split.count("|") / n, 0.1, 0.2)
        if n >= 25:
            assert noise[8] == quality._vote(len(quality._ENDS.findall(text)) / n, 0.04, 0.02)
        if m >= 12:
            pairs = list(zip(words, words[1:], strict=False))
            assert repeats[1] == quality._vote(sum(a == b for a, b in pairs) / m, 0.1, 0.25)
            assert repeats[2] == quality._vote(len(set(pairs)) / m, 0.55, 0.4)
        seen |= {(i, noise[i]) for i in (1, 4, 6)} | {(9 + i, repeats[i]) for i in (1, 2)}
    assert {(i, v) for i in (1, 4, 6, 10, 11) for v in (quality.BAD, quality.GOOD)} <= seen
