import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandlake.llm import cutting, packing, tokens

PATH = tokens.default_path()


def ids_of(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


TEXTS = {
    1: None, 2: "", 3: "Hello's <|endoftext|> x", 4: "it's I'LL don't 12.5€ ½ x²", 5: "K x  日本語", 6: "a b\tc  d\x0be\x85f \xa0", 7: "ÀÉß µ ªº ÿ'S",
    8: "the quick brown fox " * 3000, 9: "e\u0301 combining", 10: "'tis 's 'S '''", 11: "İstanbul",
}


def test_words_are_encoded_as_the_tokenizer_does():
    encoder = tokens.WordEncoder(PATH)
    for _ in range(2):  # the second time from the cache
        for text, raw in zip(TEXTS.values(), encoder.encode_batch([t or "" for t in TEXTS.values()])):
            assert raw == ids_of(text)[:-1].tobytes(), text


def test_every_id_lies_in_one_piece_and_offsets_are_gapless(spark, docs_of):
    r = random.Random(2)
    docs = dict(TEXTS) | {100 + i: " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(1, 900))) for i in range(80)}
    rows = packing.pack(docs_of(docs), length=512).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for p in rows:
        pieces[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
    for i, text in docs.items():
        ids, at = ids_of(text), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512


def test_sequences_hold_the_ids_of_their_pieces(spark, docs_of):
    docs = {1: "one two three", 2: None, 3: "four " * 700}
    rows = packing.sequences(docs_of(docs), length=256).collect()
    assert all(len(r.ids) == 256 or len(r.ids).bit_count() == 1 for r in rows)
    assert sum(x == 1 for r in rows for x in r.ids) == 3


def test_repeated_rows_null_ids_and_no_rows(spark, docs_of):
    rows = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert packing.pack(docs_of({}).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cutting_stock_meets_demand_and_comes_near_the_bound(seed):
    r = np.random.default_rng(seed)
    demand = r.integers(0, 60, 64)
    plan = cutting.rounded(demand, 64)
    made = sum(p * n for p, n in plan)
    assert (made == demand).all() and all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
    program = sum(x for _, x in cutting.solve(demand, 64))
    assert program >= (demand * np.arange(1, 65)).sum() / 64 - 1
    assert sum(n for _, n in plan) <= program + 20


def test_knapsack_prices_by_dynamic_programming():
    worth, pattern = cutting.best_pattern(np.array([1.0, 2.5, 2.9]), 5)
    assert worth == pytest.approx(6.0) and (pattern * np.array([1, 2, 3])).sum() <= 5
