"""Cross-tokenizer alignment against a plain pass over the tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewatch.llm.alignment import Ends, Pieces, alignment, byte_letters, op13_alignment, rendered, shared_cuts

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(docs):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    rows, links, count = [], [], Counter()
    for key, text in docs:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        x = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        y = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            rows.append((key, 0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [{e: k + 1 for k, e in enumerate(np.cumsum([len(t) for t in z]).tolist())} for z in (x, y)]
        i = j = 0
        said, own = [], []
        for cut in sorted(ends[0].keys() & ends[1].keys()):
            p, q = ends[0][cut], ends[1][cut]
            said.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            own.append((a[p - 1], b[q - 1]))
            i, j = p, q
        count.update(own)
        links.append(own)
        rows.append((key, len(a), len(b), len(own), len(own), hashlib.sha256(";".join(said).encode()).hexdigest()))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(*r[:5], sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), r[5]) for r, own in zip(rows, links, strict=True)]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(op13_alignment(spark, sf).select(*COLUMNS).collect()) == ordered(plain(docs))


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_odd_texts_and_rows(spark, bound):
    rng = random.Random(7)
    signs = " ab\n\t.▁éß😀\0　​the12"
    docs = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    docs += [(1, docs[1][1]), (None, "the end"), (None, None), (400, None), (401, ""), (402, " "), (403, "   "), (404, "a <|endoftext|> b <s>"), (405, "the cat " * 20_000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, pairs string, __row long")
    assert ordered(alignment(df, bound=bound).select(*COLUMNS).collect()) == ordered(plain(docs))


def test_empty_table(spark):
    assert alignment(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitsets():
    rng = np.random.default_rng(3)
    for size in (1, 63, 64, 65, 1000):
        a, b = (np.unique(np.append(rng.integers(1, size + 1, size), size)) for _ in range(2))
        left, right = Ends(a, size), Ends(b, size)
        assert shared_cuts(left, right).tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        places = np.arange(size + 1)
        assert left.rank(places).tolist() == np.searchsorted(a, places, side="right").tolist()
    text, ends = rendered(np.array([0, 7, 10, 50257]), np.frombuffer(b",|;,", np.uint8))
    assert text == b"0,7|10;50257," and ends.tolist() == [2, 4, 7, 13]


def test_long_texts_in_parts():
    """Cut anywhere that the model allows, the ids are those of the whole text."""
    rng, model = random.Random(11), Pieces()
    for part in (1, 2, 5, 30):
        model.PART = part
        for _ in range(300):
            text = "".join(rng.choice(["a", "the ", " ", "  ", "Zug", ".", "\n", "é", "😀", " x"]) for _ in range(rng.randrange(1, 60)))
            assert model.encoded(text).tolist() == model.model.encode(text)
