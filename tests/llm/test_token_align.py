"""Cross-tokenizer alignment against a plain version on the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sitewarden.llm import token_align as T

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, id string, block string, links string, n_a string, pairs string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"xxxxx") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(text, libraries):
    """((id, bytes) of A), ((id, bytes) of B), both empty where bytes differ from space + text."""
    a, b = libraries
    if not text:
        return [], []
    alphabet = {c: k for k, c in enumerate(T.byte_alphabet())}
    ta = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    same = b"".join(x for _, x in ta) == (" " + text).encode() == b"".join(x for _, x in tb)
    return (ta, tb) if same else ([], [])


def spans(ts):
    out, at = [], 0
    for i, x in ts:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain_version(rows, libraries):
    each, counts = [], Counter()
    for i, text in rows:
        a, b = map(spans, tokens(text, libraries))
        cuts = sorted({y for *_, y in a} & {y for *_, y in b})
        groups = [f"{','.join(str(t) for t, x, y in a if lo <= x and y <= hi)}|{','.join(str(t) for t, x, y in b if lo <= x and y <= hi)}" for lo, hi in zip([0, *cuts], cuts)]
        links, k = [], 0
        for s, x, y in a:
            while k and b[k][1] > x:
                k -= 1
            while k < len(b) and b[k][1] < y:
                if b[k][2] > x:
                    links.append((s, b[k][0]))
                k += 1
            k = max(0, k - 1)
        counts.update(links)
        each.append((i, len(a), len(b), groups, links))
    most = Counter()
    for (_, t), n in counts.items():
        most[t] = max(most[t], n)
    return [
        (i, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "", ";".join(groups))
        for i, n_a, n_b, groups, links in each
    ]


def texts(seed=1, n=400):
    rng = random.Random(seed)
    words = ["the", "alignment", "tokenizers", "of", "Ärger", "naïve", "中文字", "😀", "don't", "x1y2", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "é", "https://a.b/c?d=e", "0123456789", "--", "mississippi"]
    gaps = [" "] * 12 + ["\n", "\n", "  ", "\n\n", " \n", "\t", "\r\n", "\xa0", " ", ""]
    odd = [None, "", " ", "\n", "  ", "a", "a ", " a", "\na", "a\n", "a \n", "▁", "a▁b", "a ▁ b", "\x00", "a\x00b", "word " * 300, "x" * 3000, "é" * 500, " ", "a\x1cb", "\x85", "🏳️‍🌈 flag"]
    return odd + ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_as_in_the_plain_version(spark, libraries, monkeypatch):
    rows = [(k if k % 29 else None, t) for k, t in enumerate(texts())] + [(3, "the same twice"), (3, "the same twice")]
    want = sorted(map(str, plain_version(rows, libraries)))
    got = T.align_documents(frame(spark, rows), *PATHS, with_groups=True).collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_small_blocks_and_dictionaries(spark, libraries):
    """Many blocks give the same sums. In a worker constants are the module's, so here in one call."""
    rows = [(k, t) for k, t in enumerate(texts(5, 60))]
    want = sorted(plain_version(rows, libraries))
    got = T.align_documents(frame(spark, rows).repartition(40), *PATHS).collect()
    assert sorted(tuple(r) for r in got) == [w[:-1] for w in want]
    counted = Counter()
    for r in T.pair_counts(frame(spark, rows), *PATHS).collect():
        counted[r["a"], r["b"]] += r["n"]
    assert sum(counted.values()) == sum(w[4] for w in want) and sum(n * n for n in counted.values()) == sum(w[6] for w in want)


def test_runs_and_whole_texts_agree(libraries):
    both = T.Aligner(*PATHS)
    whole = T.Aligner(*PATHS)
    whole.by_runs = False
    ts = [t or "" for t in texts(8, 300)]
    assert both.by_runs and list(both.many(ts)) == list(whole.many(ts)) == list(both.many(ts))


def test_ranks_as_the_library(libraries):
    """The faster tokenizer on texts of all Latin characters, spaces and special tokens' strings."""
    both, rng = T.Aligner(*PATHS), random.Random(11)
    pool = [chr(c) for c in range(0x250)] + [" ", "\n", "'s", "'re", "ing", "the", "12", "<|endoftext|>"] * 20
    ts = [t for t in texts(12, 400) if t] + ["".join(rng.choices(pool, k=rng.randint(1, 80))) for _ in range(3000)] + [chr(c) + "a" + chr(c) for c in range(0x250)]
    assert both.fast
    wrong = [t for t in ts if both._a_ids(t) != libraries[0].encode(t, add_special_tokens=False).ids]
    assert not wrong, wrong[:3]


def test_kernel_on_random_cuts():
    rng = np.random.default_rng(2)
    for size in [1, 2, 7, 8, 9, 16, 64, 333] * 5:
        a, b = (np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size + 1)), size)) for _ in range(2))
        a_cut, b_cut, a_of, b_of = T.align(a, b, size)
        shared = sorted({*a.tolist()} & {*b.tolist()})
        assert a_cut.tolist() == [0] + [int((a <= c).sum()) for c in shared] and b_cut.tolist() == [0] + [int((b <= c).sum()) for c in shared]
        lows = [np.append(0, x[:-1]) for x in (a, b)]
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if lows[0][i] < b[j] and lows[1][j] < a[i]]
        assert list(zip(a_of.tolist(), b_of.tolist())) == want and len(want) == len(a) + len(b) - len(shared)


def test_empty_table(spark):
    assert T.align_documents(frame(spark, []), *PATHS).count() == 0
    got = T.align_documents(frame(spark, [(1, None), (2, "a▁b")]), *PATHS).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
